"""Phrase collocations: upper bounds from sketches, exact counts by delimiter-guarded automata over shards of the corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.common import shuffle_partitions, written

#: The longest phrase, in words.
LONGEST = 5
#: Stands between pieces; no UTF-8 text has this byte.
_GAP = b"\xff"
#: A-Z go to a-z, marks and line ends at which pieces end to the gap.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + _GAP * 10)
#: Odd multipliers of the hashes.
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Groups of cells of a row of a sketch, in which counts are shuffled and summed: as many for a sketch of any size, so that their rows grow with the shards only.
_GROUPS_BITS = 10


class _WordHashes(dict):
    """The hash of a word, 0 for the gap between pieces; words already met are kept, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = (xxhash.xxh64_intdigest(word, 7) | 1) if word != _GAP else 0
        return h


class Shard:
    """Words of whole texts, piece by piece, with the hashes of their phrases.

    ``texts`` are pairs (lang, text). Words stand in one list; a gap ends each piece.
    """

    def __init__(self, texts: list[tuple[str, str]], hashes: _WordHashes):
        self.words: list[bytes] = []
        spans: list[tuple[str, int]] = []
        for lang, text in texts:
            start = len(self.words)
            self.words += text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(_GAP, b" \xff ").split()
            self.words.append(_GAP)
            spans.append((lang, len(self.words) - start))
        self.spans = spans
        n = len(self.words)
        self.hash = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, n)
        self.real = self.hash != 0
        langs = np.array([xxhash.xxh64_intdigest(lang.encode(), 11) for lang, _ in spans], np.uint64)
        self.lang = np.repeat(langs, [k for _, k in spans]) if spans else np.zeros(0, np.uint64)

    def by_language(self, values: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """Of positions ``values``, ascending, those in texts of each language."""
        names = {lang: i for i, (lang, _) in enumerate(self.spans)}
        of = np.repeat(np.array([names[lang] for lang, _ in self.spans], np.int64), [k for _, k in self.spans])[values]
        for lang, i in names.items():
            yield lang, values[of == i]

    def runs(self, pairs: np.ndarray) -> Iterator[tuple[str, str]]:
        """(lang, text): all stretches of words of which each two in a row are a pair that passes, parted by gaps; a letter stands for a byte.

        ``pairs``: positions of passing pairs. A phrase of passing pairs lies within one stretch. One space parts words, and one stands at both ends.
        """
        first = np.zeros(len(self.words) + 1, bool)
        first[pairs] = True
        inside = first.copy()
        inside[1:] |= first[:-1]
        for lang, at in self.by_language(np.nonzero(inside[:-1])[0]):
            begins = np.nonzero(~first[at - 1])[0]  # position -1 is the spare last one
            told = np.insert(at, begins, len(self.words) - 1)  # the last word of all is a gap
            yield lang, (b" " + b" ".join(map(self.words.__getitem__, told.tolist())) + b" ").decode("latin-1")

    def phrases(self, passes: dict[int, Passing], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, starts, hashes) of the phrases of k words, for each k up to ``longest``, whose parts pass.

        ``passes`` tells for lengths already sketched which hashes pass; a phrase is told only if its first and its last part of the longest such length
        up to k do, and for k itself it does.
        """
        with np.errstate(over="ignore"):
            h, ok, parts = self.lang, self.real, {}
            for k in range(1, longest + 1):
                n = len(self.words) - k + 1
                if n <= 0:
                    return
                h = (h[:n] ^ (h[:n] >> np.uint64(29))) * _MIX + self.hash[k - 1 :] * _TURN
                ok = ok[:n] & self.real[k - 1 :] if k > 1 else ok
                # parts of k - 1 words, as far as they are sketched; a longer one's parts all pass if its pairs do
                if k - 1 in parts:
                    ok = ok & parts[k - 1][:n] & parts[k - 1][1 : n + 1]
                at = np.nonzero(ok)[0]
                hashed = h[at] ^ (h[at] >> np.uint64(32))
                if k in passes:
                    keep = passes[k].of(hashed)
                    at, hashed = at[keep], hashed[keep]
                    ok = np.zeros(n, bool)
                    ok[at] = True
                    parts[k] = ok
                yield k, at, hashed


class Passing:
    """Which hashes have a bound of at least the threshold in every row of a count-min sketch: one bit a cell."""

    def __init__(self, bits: int, rows: list[np.ndarray]):
        self.bits, self.rows = bits, rows

    def of(self, hashes: np.ndarray) -> np.ndarray:
        keep = np.ones(len(hashes), bool)
        for r, row in enumerate(self.rows):
            c = cells(hashes, r, self.bits)
            keep &= (row[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
        return keep


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cells of hashes in a row of the sketch."""
    with np.errstate(over="ignore"):
        mixed = hashes * (_MIX, _TURN)[row]
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[str, str]]]:
    """Runs of (lang, text) of about ``most`` characters together. A longer text is a run of its own."""
    run, held = [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if run and held + len(text) > most:
                yield run
                run, held = [], 0
            run.append((lang, text))
            held += len(text)
    if run:
        yield run


def sketch(docs: DataFrame, bits: int, least: int, lengths: range, passes: Broadcast, shard_chars: int) -> Passing:
    """The cells of a count-min sketch of the phrases of these lengths that reach ``least``, over all of ``docs`` (lang, text).

    Two rows of 2^bits cells. A task passes on its counts, each at most ``least`` (a cell that reaches it in one task passes anyway), by groups of cells: positions of three bytes and counts of one.
    Groups are summed where the shuffle brings them, one in memory at a time; what comes to the driver, and is broadcast from there, is one bit a cell.
    """
    low_bits, known = bits - _GROUPS_BITS, set(passes.value)
    group = 1 << low_bits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for run in _shards(batches, shard_chars):
            found = [h for k, _, h in Shard(run, hashes).phrases(passes.value, lengths[-1]) if k in lengths and k not in known]
            merged = np.concatenate(found) if found else np.zeros(0, np.uint64)
            for r in range(2):
                c, n = np.unique(cells(merged, r, bits), return_counts=True)
                n = np.minimum(n, least).astype(np.uint8)
                groups, first = np.unique(c >> low_bits, return_index=True)
                ends = [*first[1:], len(c)][: len(first)]
                place = c & (group - 1)
                low, high = (place & 0xFFFF).astype(np.uint16), (place >> 16).astype(np.uint8)
                data = [low[a:b].tobytes() + high[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(groups + (r << _GROUPS_BITS), pa.int64()), pa.array(data, pa.binary())], names=["g", "data"])

    def passing(held: int, sums: np.ndarray, out: list) -> None:
        if (full := sums >= least).any():
            out.append((held, np.packbits(full, bitorder="little").tobytes()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, np.zeros(group, np.int64)
        for b in batches:
            out: list[tuple[int, bytes]] = []
            for g, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if g != held:
                    if held is not None:
                        passing(held, sums, out)
                    held, sums[:] = g, 0
                n = len(data) // 4
                place = np.frombuffer(data, np.uint16, n).astype(np.int64) | np.frombuffer(data, np.uint8, n, 2 * n).astype(np.int64) << 16
                sums[place] += np.frombuffer(data, np.uint8, n, 3 * n)
            yield _bitmaps(out)
        out = []
        if held is not None:
            passing(held, sums, out)
        yield _bitmaps(out)

    parts = docs.mapInArrow(counted, "g long, data binary").repartition(shuffle_partitions(docs.sparkSession), "g").sortWithinPartitions("g")
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    for g, data in parts.mapInArrow(summed, "g long, bits binary").collect():
        r, at = divmod(g, 1 << _GROUPS_BITS)
        rows[r][at * group // 8 : (at + 1) * group // 8] = np.frombuffer(data, np.uint8)
    return Passing(bits, rows)


def _bitmaps(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["g", "bits"])


#: Buckets of phrases in which their counts are shuffled and summed; counts that a task holds before it passes them on.
_BUCKETS, _HELD = 1024, 250_000
_COUNTS = pa.struct([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def exact_counts(docs: DataFrame, passes: Broadcast, least: int, shard_chars: int, most_patterns: int) -> DataFrame:
    """(lang, phrase, words, f): exact counts, from ``least`` on, of all phrases of 1 to 5 words, overlaps included; words 0 counts a language's words.

    Each shard's phrases of two words and more that pass, in any language, go to automata of at most ``most_patterns`` patterns, guarded by a space on both sides; the shard's stretches of passing pairs
    run through them. A phrase that passes is in the automata of each shard that has it, so sums over shards are exact. Single words, which the cuts need, are counted beside. A task adds up its shards and tells its
    counts by buckets of phrases, a row each; where the shuffle brings them, one bucket at a time is summed.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = _WordHashes(), Counter()
        for run in _shards(batches, shard_chars):
            shard = Shard(run, hashes)
            patterns: dict[str, int] = {}
            rows: list[tuple[str, str, int, int]] = []
            pairs = np.zeros(0, np.int64)
            for k, at, h in shard.phrases(passes.value, LONGEST):
                if k == 1:
                    for lang, own in shard.by_language(at):
                        rows += [(lang, _text(w), 1, n) for w, n in Counter(map(shard.words.__getitem__, own.tolist())).items()]
                    continue
                pairs = at if k == 2 else pairs
                first = at[np.unique(h, return_index=True)[1]]
                patterns |= {b" ".join(shard.words[i : i + k]).decode("latin-1"): k for i in first.tolist()}
            rows += [(lang, "", 0, len(own)) for lang, own in shard.by_language(np.nonzero(shard.real)[0]) if len(own)]
            listed = list(patterns.items())
            texts = list(shard.runs(pairs))
            for i in range(0, len(listed), most_patterns):
                part = listed[i : i + most_patterns]
                machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for j, (p, _) in enumerate(part):
                    machine.add_word(f" {p} ", j)
                machine.make_automaton()
                for lang, text in texts:
                    rows += [(lang, _text(part[j][0].encode("latin-1")), part[j][1], n) for j, n in Counter(map(itemgetter(1), machine.iter(text))).items()]
            for *key, n in rows:
                held[tuple(key)] += n
            if len(held) >= _HELD:
                yield _told(held)
                held.clear()
        yield _told(held)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, Counter()
        for b in batches:
            for bucket, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if bucket != held:
                    yield _sums(sums, least)
                    held, sums = bucket, Counter()
                lang, phrase, words, n = (counts.values.field(i).to_pylist() for i in range(4))
                for key, k in zip(zip(lang, phrase, words, strict=True), n, strict=True):
                    sums[key] += k
        yield _sums(sums, least)

    parts = docs.mapInArrow(counted, "bucket int, counts array<struct<lang:string,phrase:string,words:int,n:bigint>>")
    return parts.repartition(shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(summed, "lang string, phrase string, words int, f long")


def _told(held: Counter) -> pa.RecordBatch:
    buckets: dict[int, list[tuple]] = {}
    for key, n in held.items():
        buckets.setdefault(xxhash.xxh32_intdigest(key[1].encode("utf-8", "surrogatepass")) % _BUCKETS, []).append((*key, n))
    ends = np.cumsum([0, *map(len, buckets.values())]).astype(np.int32)
    told = pa.ListArray.from_arrays(ends, _table([r for b in buckets.values() for r in b]))
    return pa.RecordBatch.from_arrays([pa.array(list(buckets), pa.int32()), told], names=["bucket", "counts"])


def _table(rows: list[tuple]) -> pa.StructArray:
    lang, phrase, words, n = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(words, pa.int32()), pa.array(n, pa.int64())], fields=list(_COUNTS))


def _sums(sums: Counter, least: int) -> pa.RecordBatch:
    kept = _table([(*key, n) for key, n in sums.items() if n >= least or key[2] == 0])
    return pa.RecordBatch.from_arrays(kept.flatten(), names=["lang", "phrase", "words", "f"])


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def _words(phrase: Column, first: Column | int, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(first) if isinstance(first, int) else first, count), " ")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, shard_chars: int = 4_000_000, most_patterns: int = 100_000, most_bits: int = 28) -> DataFrame:
    """The ``top`` best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    ``docs`` has text and lang; other columns are not read. A-Z are lower-cased, pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. Null text is empty, null lang is ``und``; repeated rows count each.
    A candidate of 2 to 5 words occurs a >= ``least`` times; of its cuts into two parts with counts l and r the one with the least score floor(1000 * a * n / (l * r)) counts (ties: the shortest first
    part), n the words of the language. Candidates inside a longer one that is as frequent are dropped. Order: score and a descending, phrase ascending (bytes).

    Three passes: a sketch of words and pairs, one of phrases of three to five whose pairs pass, then exact counts. ``least`` is at most 255. Each sketch has two rows of 2^b cells, b from 16 to ``most_bits``, about
    a cell for four words of the corpus; 2^28 cells are 64 MB of bits. Where the corpus outgrows that, more phrases pass than must and are counted, and the results stay exact.
    """
    if not 1 <= least <= 255:
        raise ValueError("least is from 1 to 255")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(16, (size // 24).bit_length()), most_bits)
    passes: dict[int, Passing] = {}
    for lengths in (range(1, 3), range(3, LONGEST + 1)):
        held = spark.sparkContext.broadcast(passes)
        found = sketch(docs, bits, least, lengths, held, shard_chars)
        passes = {**passes, **dict.fromkeys(lengths, found)}
        held.unpersist()
    held = spark.sparkContext.broadcast(passes)
    counts = written(exact_counts(docs, held, least, shard_chars, most_patterns), "phrases")
    return best_phrases(counts, top)


def best_phrases(counts: DataFrame, top: int) -> DataFrame:
    """Thresholds and scores over exact counts (lang, phrase, words, f); see ``collocations``."""
    sizes = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("words between 1 and 4").select("lang", F.col("phrase").alias("part"), "f")
    cand = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    longer = cand.where("words > 2").select("lang", F.col("a").alias("long_a"), F.explode(F.array(_words(F.col("phrase"), 1, F.col("words") - 1), _words(F.col("phrase"), 2, F.col("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("long_a").alias("long_a"))
    kept = cand.join(longer, ["lang", "phrase"], "left").where("long_a is null or 100 * long_a < 100 * a").drop("long_a")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("part", _words(F.col("phrase"), 1, F.col("k"))).join(known, ["lang", "part"]).withColumnRenamed("f", "l")
    cuts = cuts.withColumn("part", _words(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k"))).join(known, ["lang", "part"]).withColumnRenamed("f", "r")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.join(sizes, "lang").withColumns({"up": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "down": wide("l") * wide("r")}).withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = best.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(counts.sparkSession))))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top).drop("deal", "rank")
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by counting every phrase.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM lists, unnest(range(1, 6)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i)
  GROUP BY lang, k, phrase HAVING count(*) >= 100),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_parts AS (
  SELECT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase
  FROM cand, unnest(range(2, k)) AS s(j), unnest(range(1, k - j + 2)) AS t(i)),
kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inner_parts x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 100 * c.a)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, z.n, cut, p.f AS l, q.f AS r,
         (1000::HUGEINT * c.a * z.n) // (p.f::HUGEINT * q.f) AS score
  FROM kept c JOIN sizes z USING (lang), unnest(range(1, c.k)) AS s(cut), f p, f q
  WHERE p.lang = c.lang AND p.phrase = array_to_string(c.w[1:cut], ' ') AND q.lang = c.lang AND q.phrase = array_to_string(c.w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""
