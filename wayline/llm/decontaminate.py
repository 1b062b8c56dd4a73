"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import worker_cache, written

WORD = re.compile(r"\w+")
LEAK = {"item_id": ("long", pa.int64()), "similarity": ("double", pa.float64()), "start": ("long", pa.int64()), "words": ("long", pa.int64()), "distance": ("int", pa.int32())}
#: Odd multipliers that tell the places of a shingle's words apart, by rule.
PLACES = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(16)], np.uint64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Of each run of k word hashes: the sum by places, mixed."""
    n = len(h) - k + 1
    x = sum((h[i : i + n] * PLACES[i] for i in range(k)), np.zeros(max(0, n), np.uint64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bits_of(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def window_prints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each window of n shingles: a bit is 1 if set in over half of them."""
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits_of(shingles), axis=0, dtype=np.int32)])
    return np.packbits((total[starts + n] - total[starts]) * 2 > n, axis=1, bitorder="little").view(np.uint64).ravel()


class HammingBlocks:
    """Fingerprints by the eight bytes of each: any two within 23 bits have a byte at most 2 bits apart.

    A byte's table lists, for each of 256 values, the fingerprints whose byte is within 2 bits of it.
    """

    RADIUS = 23
    NEAR = np.array([sum(1 << b for b in c) for n in range(3) for c in combinations(range(8), n)], np.int64)

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, []
        at = np.repeat(np.arange(len(prints), dtype=np.int32), len(self.NEAR))
        for column in np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8).T:
            value = (column[:, None] ^ self.NEAR).ravel()
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange(257)), at[order]))

    def within(self, fp: np.uint64, radius: int) -> list[tuple[int, int]]:
        """(fingerprint, distance) of those within ``radius`` bits of one."""
        return [(int(i), int(d)) for _, items, away in self.pairs(np.array([fp], np.uint64), radius) for i, d in zip(items, away, strict=True)]

    def pairs(self, fps: np.ndarray, radius: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in ``fps``, fingerprint, distance) of all pairs within ``radius`` bits, a run of about ``most`` candidates at a time."""
        step = max(1, most // max(1, len(self.prints)))
        for lo in range(0, len(fps), step):
            part = np.ascontiguousarray(fps[lo : lo + step])
            pairs = []
            for (begin, members), value in zip(self.tables, part.view(np.uint8).reshape(-1, 8).T.astype(np.int64), strict=True):
                n = begin[value + 1] - begin[value]
                place = np.repeat(np.arange(len(part)), n)
                pairs.append(place * len(self.prints) + members[np.repeat(begin[value] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            place, item = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.prints)))
            distance = np.bitwise_count(part[place] ^ self.prints[item])
            near = distance <= radius
            yield place[near] + lo, item[near], distance[near].astype(np.int64)


class ItemIndex:
    """A block of benchmark items, small enough to broadcast."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int):
        self.vocab: dict[str, int] = {}
        self.ids, self.sums, self.size = [], [], {}
        by_length, lengths = defaultdict(list), defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            w = words_of(text)
            if not w:
                continue
            size = self.size[len(w)] = min(k, len(w))
            hashes = shingle_hashes(word_hashes(w), size)
            values, counts = np.unique(hashes, return_counts=True)
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
            for v in values.tolist():
                lengths[size][v].add(len(w))
            by_length[len(w)].append((len(self.ids), window_prints(hashes, np.zeros(1, np.int64), len(hashes))[0]))
            self.ids.append(item_id)
            self.sums.append((values, counts))
        self.known = np.concatenate([np.zeros(1, np.uint64), word_hashes(list(self.vocab))])
        self.where = {s: (np.array(sorted(d), np.uint64), [sorted(d[v]) for v in sorted(d)]) for s, d in lengths.items()}
        self.blocks = {n: (np.array([i for i, _ in rows]), HammingBlocks(np.array([f for _, f in rows], np.uint64))) for n, rows in by_length.items()}

    def find(self, text: str | None, least: float, radius: int) -> list[dict]:
        """The best window for each item that has one of at least ``least``; in order of place in the block."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))
        best: dict[int, tuple] = {}
        for size, (values, lengths) in self.where.items():
            if len(ids) < size:
                continue
            known = ids > 0
            runs = known[: len(ids) - size + 1].copy()
            for j in range(1, size):
                runs &= known[j : len(ids) - size + 1 + j]
            at = np.flatnonzero(runs)
            if not len(at):
                continue
            x = shingle_hashes_of_rows(self.known[ids[at[:, None] + np.arange(size)]])
            slot = np.minimum(np.searchsorted(values, x), len(values) - 1)
            hit = values[slot] == x
            places: dict[int, list[int]] = defaultdict(list)
            for p, s in zip(at[hit].tolist(), slot[hit].tolist(), strict=True):
                for n in lengths[s]:
                    places[n].append(p)
            for n, found in places.items():
                self._windows(words, ids, n, np.array(found), least, radius, best)
        return [{"item_id": self.ids[j], "similarity": -s, "start": start, "words": n, "distance": d} for j, (s, start, d, n) in sorted(best.items())]

    def _windows(self, words: list[str], ids: np.ndarray, length: int, places: np.ndarray, least: float, radius: int, best: dict, most: int = 4096) -> None:
        """Puts the best window of each item of ``length`` words into ``best``, of the windows that share a shingle with any of them."""
        size, n = self.size[length], min(length, len(words))
        shingles = n - size + 1
        reach = np.zeros(len(words) - n + 2, np.int64)
        np.add.at(reach, np.clip(places - shingles + 1, 0, len(words) - n), 1)
        np.add.at(reach, np.minimum(places, len(words) - n) + 1, -1)
        starts = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
        members, blocks = self.blocks[length]
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > shingles) + 1):
            for part in (run[i : i + most] for i in range(0, len(run), most)):
                lo, hi = int(part[0]), int(part[-1]) + n
                h = self.known[ids[lo:hi]]
                for j in np.flatnonzero(ids[lo:hi] == 0).tolist():
                    h[j] = xxhash.xxh64_intdigest(words[lo + j].encode("utf-8", "surrogatepass"))
                x = shingle_hashes(h, size)
                for place, item, distance in blocks.pairs(window_prints(x, part - lo, shingles), radius):
                    order = np.argsort(item, kind="stable")
                    for of in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else ():
                        self._verified(int(members[item[of[0]]]), x, part[place[of]], lo, distance[of], shingles, n, least, best)

    def _verified(self, j: int, x: np.ndarray, starts: np.ndarray, lo: int, distance: np.ndarray, shingles: int, n: int, least: float, best: dict) -> None:
        """The best of item j's windows by exact weighted similarity. Windows with too few of its shingles are passed over by a running count."""
        values, counts = self.sums[j]
        slot = np.minimum(np.searchsorted(values, x), len(values) - 1)
        own = np.where(values[slot] == x, slot, len(values))
        held = np.concatenate([[0], np.cumsum(own < len(values))])
        both_sizes = shingles + int(counts.sum())
        enough = (held[starts - lo + shingles] - held[starts - lo]) * (1 + least) >= least * both_sizes - 1e-6
        for start, d in zip(starts[enough].tolist(), distance[enough].tolist(), strict=True):
            got = np.bincount(own[start - lo : start - lo + shingles], minlength=len(values) + 1)[:-1]
            both = int(np.minimum(got, counts).sum())
            similarity = both / (both_sizes - both)
            if similarity >= least and (j not in best or (-similarity, start, d, n) < best[j]):
                best[j] = (-similarity, start, d, n)


def shingle_hashes_of_rows(h: np.ndarray) -> np.ndarray:
    """Like shingle_hashes, of a matrix with a shingle's word hashes in each row."""
    flat = np.zeros(len(h), np.uint64)
    for i in range(h.shape[1]):
        flat += h[:, i] * PLACES[i]
    x = (flat ^ (flat >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def item_blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks, and the distinct items in blocks of about ``block_chars`` characters, dealt by a hash on Spark and read one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    number = -(-(items.agg(F.sum(F.char_length("text"))).first()[0] or 0) // block_chars)
    if number > 1:
        items = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(number))), "items")

    def read() -> Iterator[list[tuple]]:
        for k in range(number):
            block = items.where(F.col("block") == k) if number > 1 else items
            yield sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))

    return number, read()


def checked(radius: int) -> int:
    if radius > HammingBlocks.RADIUS:
        raise ValueError("the Hamming blocks guarantee 23 bits at most")
    return radius


def in_passes(docs: DataFrame, benchmark: DataFrame, words: int, block_chars: int, told: Callable[[DataFrame, Callable[[], ItemIndex]], DataFrame], chained: bool = False) -> Iterator[DataFrame]:
    """``told(docs, index of a block)`` for each block; of several, each is written before the next block is read, so that one is in memory at a time.

    ``chained``: each pass takes what the last one gave.
    """
    number, blocks = item_blocks(benchmark, block_chars)
    for block in blocks:
        box, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
        out = told(docs, lambda box=box, name=name: worker_cache(("items", name), lambda: ItemIndex(box.value, words)))
        if number > 1:
            out = written(out, "leaks")
            box.destroy()
        docs = out if chained else docs
        yield out


def with_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8, radius: int = HammingBlocks.RADIUS, text_col: str = "text", block_chars: int = 4_000_000, into: str = "leaks") -> DataFrame:
    """``docs`` with the column ``into``: for each benchmark item found, its best window in the whole text.

    Words are runs of letters, digits and marks of words, lower-cased; shingles have five words and weigh as often as they occur. For an item of n
    words the windows are all runs of n words (the whole text, if shorter) that share a shingle with an item of n words: others have
    similarity 0. A window's SimHash is looked up among the items of n words by Hamming blocks, which find all within ``radius`` (23 at most) bits; each
    found is verified by the exact weighted Jaccard similarity, at least ``least``. Items of fewer than five words are one shingle. Null or empty texts and
    items match nothing; repeated items count once, repeated documents each; an existing column ``into`` is replaced, all others stay as they are. The
    benchmark goes to the tasks in blocks of about ``block_chars`` characters: one narrow pass each, no shuffle. Columns have to be of types that Arrow knows.
    """
    checked(radius)
    kind = "array<struct<" + ",".join(f"{k}:{t}" for k, (t, _) in LEAK.items()) + ">>"
    arrow = pa.list_(pa.struct([(k, t) for k, (_, t) in LEAK.items()]))
    out = docs.drop(into).withColumn(into, F.array().cast(kind))

    def told(now: DataFrame, index: Callable[[], ItemIndex]) -> DataFrame:
        names = now.columns
        at = names.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = index()
            for b in batches:
                found = [old.as_py() + items.find(t.as_py(), least, radius) for t, old in zip(b.column(at), b.column(len(b.columns) - 1), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, arrow)], names=names)

        return now.mapInArrow(run, now.schema)

    for out in in_passes(out, benchmark, words, block_chars, told, chained=True):
        pass
    return out


def leaked_documents(docs: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8, radius: int = HammingBlocks.RADIUS, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document row and benchmark item found in it: doc_id, item_id, similarity, start, words, distance; see ``with_leaks``."""
    checked(radius)
    rows, kind = docs.select("doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{k} {t}" for k, (t, _) in LEAK.items())

    def told(now: DataFrame, index: Callable[[], ItemIndex]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = index()
            for b in batches:
                found = [(i, x) for i, t in enumerate(b.column(1)) for x in items.find(t.as_py(), least, radius)]
                leaks = [pa.array([x[k] for _, x in found], t) for k, (_, t) in LEAK.items()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in found], pa.int64())), *leaks], names=["doc_id", *LEAK])

        return now.mapInArrow(run, schema)

    out = None
    for part in in_passes(rows, benchmark, words, block_chars, told):
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
