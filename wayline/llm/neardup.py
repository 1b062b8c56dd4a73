"""SimHash near duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import written
from wayline.llm.components import components

#: Bits of the three segments of a fingerprint, from the low end.
SEGMENTS = (22, 21, 21)
#: Fixed value: generator polynomial of the perfect binary Golay code of length 23, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011


def simhash(text: str | None, words: int, seed: int = 42, run: int = 1 << 16) -> int:
    """64-bit SimHash of a whole text: a bit is 1 if set in over half the hashes of its word shingles.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count as often as they occur.
    Fewer words than a shingle has: the whole sequence is the one shingle. No words: zero.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n, h = max(1, len(w) - words + 1), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, run):
        part = w[i : i + run + words - 1]
        hashes = [h(b" ".join(s), seed) for s in zip(*(part[k:] for k in range(words)), strict=False)] if n > 1 or len(w) >= words else [h(b" ".join(w), seed)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the SimHash as a signed long. One narrow Arrow pass over whole texts; null is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables by rule: syndromes of the high 12 and the low 11 bits, and for each syndrome the error patterns
    of weight up to 4 that lead to codewords: the one of weight up to 3, then, where that weight is 3, the five
    of weight 4 (else the first again)."""
    high = np.array([_remainder(v << 11) for v in range(4096)], np.int64)
    low = np.arange(2048, dtype=np.int64)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(23), weight):
            e = sum(1 << i for i in at)
            found[_remainder(e)].append(e)
    return high, low, np.array([(x + x[:1] * 6)[:6] for x in found], np.int64)


def codewords(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words: the 12-bit indices of all codewords within distance 4 (six columns, repeats allowed).

    Any two words at most 2 apart share one: the codeword nearest to the word midway is within 3 of it, so
    within 4 of both.
    """
    high, low, errors = golay()
    syndrome = high[words >> 11] ^ low[words & 2047]
    return (words[:, None] ^ errors[syndrome]) >> 11


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints (uint64), with the position of each one's fingerprint.

    At most two wrong bits leave one of the three segments whole. Key t joins segment t exactly with the
    codeword indices of the next segment, which bear the two errors: links of up to two bits share a key.
    """
    shift, segs = 0, []
    for bits in SEGMENTS:
        segs.append((fp >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1))
        shift += bits
    at, keys = [], []
    for t in range(3):
        code = np.sort(codewords(segs[(t + 1) % 3]), axis=1)
        new = np.ones(code.shape, bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        row, col = np.nonzero(new)
        keys.append((t << 35) | (segs[t][row] << 12) | code[row, col])
        at.append(row)
    return np.concatenate(keys), np.concatenate(at)


def fingerprint_links(fps: DataFrame, bucket: int = 48) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` such that all at most two bits apart are connected.

    Keys by Golay decoding. A key of up to ``bucket`` fingerprints is joined within and each pair verified. A
    fuller key would give pairs by the square: its fingerprints are tied exactly through the words midway.
    Two fingerprints within 2 bits share a word within 1 bit of both, and all those around one word are within 2
    of each other, so each is tied to the least around that word; rows grow with the fingerprints only.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 4096):
                key, at = keys_of(fp[i : i + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i : i + 4096][at])], names=["key", "fp"])

    keys = written(fps.select("fp").mapInArrow(emit, "key long, fp long"), "golay-keys")
    full = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "golay-full")
    shared = keys.join(full, "key")
    near = F.explode(F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= 2)), lambda y: F.struct(y.alias("a"), x.alias("b"))))))
    joined = shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select(near.alias("p")).select("p.a", "p.b").distinct()
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    around = crowded.select("fp", F.explode(flips).alias("mid"))
    ties = around.join(around.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1"), "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return joined.unionByName(ties)


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links.

    Fingerprints link at two or fewer differing bits; equal ones, so exact copies, always do. Exact copies
    meet as one fingerprint before any join. Null text is empty, a text without words has fingerprint
    zero and links like any other. Rows with a null id take part; the smallest id passes over nulls. Repeated
    rows stay repeated. Other columns are not read.
    """
    prints = written(fingerprints(docs, words, id_col, text_col), "prints")
    firsts = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    roots = components(fingerprint_links(firsts))
    rooted = firsts.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
