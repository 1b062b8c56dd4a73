"""Best-fit packing with certified bounds: documents as token ids into sequences of fixed capacity."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import segments, worker_cache, written

#: About the bytes that an entry of the caches takes besides its string.
ENTRY = 190


class WordIds:
    """Token ids of whole texts, word by word.

    For tokenizers whose pre-tokens never hold white space, as ``pieces_of`` asks for: the ids of a text are those of
    its runs without ASCII white space, one after the other, and each run is encoded once. Runs are encoded
    many at a time with a mark between them, which is one token wherever it stands. A tokenizer that lower-cases
    gets A-Z in lower case, so that fewer runs differ. Where the tokenizer is a byte-level BPE that parts letters, single digits
    and other marks, as a probe shows, runs of plain letters, digits and marks are parted here and each part goes to the
    model alone, without the library's normalizing. A run that would hold an added token only in lower case stays as it is, as the library
    looks for those in the text as written. Caches hold ``cache_bytes`` at most and are emptied when full.
    """

    MARK = "\x01"
    PLAIN = re.compile(r"[a-zß-öø-ÿ0-9!-&(-;=-@\[-`{}~]+")
    PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    PROBE = ["word", "été", "größe", "a1b22c", "des.%%%", "(x),", "end.", "##", "2024-01-31", "ß!?", "x@y.com", "ÿø=*"]

    def __init__(self, path: str, cache_bytes: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_bytes = Tokenizer.from_file(path), cache_bytes
        spec = json.loads(self.tokenizer.to_str())
        normal = spec.get("normalizer") or {}
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = [t.encode().lower() for t in added]
        self.lowers = not any(c.isupper() for t in added for c in t) and "Lowercase" in [n.get("type") for n in normal.get("normalizers", [normal])]
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}
        self.byte = {b: chr(b) for b in own} | rest
        self.clear()
        self.parted = self.lowers and spec["model"]["type"] == "BPE" and all(self._parted(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in self.PROBE)

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.size, self.begin, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = self.held = 0
        self.parts: dict[str, list[int]] = {}

    def forget(self, but: set[bytes]) -> None:
        """Empties the caches but for the runs of the texts at hand, in which the common ones are."""
        known = [w for w in but if w in self.at]
        ids = [self.flat[self.begin[k] : self.begin[k] + self.size[k]].tolist() for k in map(self.at.__getitem__, known)]
        parts = self.parts
        self.clear()
        self._store([w.decode() for w in known], ids)
        self.parts = {p: parts[p] for w in known for p in self.PARTS.findall(w.decode()) if p in parts} if self.parted else {}
        self.held += sum(len(p) + ENTRY + 40 * len(ids) for p, ids in self.parts.items())

    def _parted(self, word: str) -> list[int]:
        """Ids of a plain run, part by part."""
        parts, known = self.PARTS.findall(word), self.parts
        out = []
        for p in parts:
            ids = known.get(p)
            if ids is None:
                at = self.at.get(p.encode()) if len(parts) > 1 else None
                if at is not None:
                    ids = self.flat[self.begin[at] : self.begin[at] + self.size[at]].tolist()
                else:
                    ids = [t.id for t in self.tokenizer.model.tokenize(p if p.isascii() else "".join(map(self.byte.__getitem__, p.encode())))]
                    if len(parts) > 1:  # a run of one part is kept as a run
                        known[p] = ids
                        self.held += len(p) + ENTRY + 40 * len(ids)
            out += ids
        return out

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each run, by one call for all of them."""
        if self.mark is None or any(self.MARK in w for w in words):
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(ids == self.mark)
        return np.split(np.delete(ids, at), at - np.arange(len(at)))

    def _learn(self, new: list[bytes]) -> None:
        words = [w.decode() for w in new]
        fast = [self.parted and bool(self.PLAIN.fullmatch(w)) for w in words]
        for way in (True, False):
            part = [w for w, f in zip(words, fast, strict=True) if f == way]
            plain, odd = [w for w in part if self.MARK not in w], [w for w in part if self.MARK in w]
            for run in [plain[i : i + 2000] for i in range(0, len(plain), 2000)] + [odd] * bool(odd):
                self._store(run, list(map(self._parted, run)) if way else self._encode(run))

    def _store(self, words: list[str], ids: list) -> None:
        part = [w.encode() for w in words]
        n, k = np.array(list(map(len, ids)), np.int64), len(self.at)
        joined = np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))
        while len(self.size) < k + len(part):
            self.size, self.begin = np.resize(self.size, 2 * len(self.size)), np.resize(self.begin, 2 * len(self.begin))
        while len(self.flat) < self.used + len(joined):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.size[k : k + len(part)], self.begin[k : k + len(part)] = n, self.used + np.cumsum(n) - n
        self.flat[self.used : self.used + len(joined)] = joined
        self.used += len(joined)
        self.held += sum(map(len, part)) + ENTRY * len(part) + 4 * len(joined)
        self.at.update(zip(part, range(k, k + len(part)), strict=True))

    def runs(self, text: bytes) -> list[bytes]:
        """The text's runs without white space, in lower case where the tokenizer makes them so."""
        if not self.lowers:
            return text.split()
        low = text.lower()
        if not any(a in low for a in self.added):
            return low.split()
        return [w if any(a in (x := w.lower()) for a in self.added) else x for w in text.split()]

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        rows = list(map(self.runs, texts))
        new = set()
        for r in rows:
            new.update(r)
        if self.held > self.cache_bytes:
            self.forget(new)
        self._learn(sorted(new.difference(self.at)))
        for r in rows:
            k = np.fromiter(map(self.at.__getitem__, r), np.int64, len(r))
            n = self.size[k]
            total = int(n.sum())
            starts = np.repeat(self.begin[k] - (np.cumsum(n) - n), n)
            yield self.flat[starts + np.arange(total)]


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, cache_bytes: int = 128 << 20) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with ``end_id`` after them, cut every ``capacity`` ids.

    ``path``: a tokenizers file whose pre-tokens hold no white space and whose added tokens don't either. Null text is
    empty: its one piece is ``end_id`` alone. Texts are encoded in runs of about ``batch_bytes`` bytes; a longer one takes several. One narrow pass;
    the ids themselves stay in the task.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache(("word ids", path, cache_bytes), lambda: WordIds(path, cache_bytes))
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []

            def note(k: int, ids: np.ndarray) -> None:
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for p, i in enumerate(range(0, len(ids), capacity)):
                    part = ids[i : i + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(i)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))

            def told(at: list[int], texts: list[bytes]) -> None:
                for k, ids in zip(at, words.ids(texts), strict=True):
                    note(k, ids)

            at, held, size = [], [], 0
            for k, v in enumerate(b.column(1)):
                text = (v.as_py() or "").encode()
                if len(text) > batch_bytes:
                    note(k, np.concatenate([next(words.ids([part])) for part in segments(text, batch_bytes)]))
                    continue
                at.append(k)
                held.append(text)
                size += len(text)
                if size >= batch_bytes:
                    told(at, held)
                    at, held, size = [], [], 0
            told(at, held)
            ints = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *ints], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length by best-fit decreasing: the fullest bin that still has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, k, n = capacity, n, n + 1
        bins[i], offsets[i] = k, capacity - left
        if left > size:
            room[left - size].append(k)
            mask |= 1 << (left - size)
    return bins, offsets


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below, by two families of dual feasible functions.

    For each threshold a: what is above capacity - a counts as a whole bin and what is below a as nothing; and for
    k = 1 .. 50: a length counts as floor((k+1) x / capacity) / k, or as x / capacity where (k+1) x is a multiple.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    mass = count * np.arange(capacity + 1)
    c, m = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(mass)])
    a = np.arange(capacity // 2 + 1)
    above = c[-1] - c[capacity - a + 1]
    between = m[capacity - a + 1] - m[a]
    best = int((above + -(-between // capacity)).max())
    x = np.arange(capacity + 1)
    for k in range(1, 51):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, int(-(-(count * value).sum() // (k * capacity))))
    return best


def _packed(rows: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """One round: rows dealt into groups by a hash of where they stand, and best fit within each group."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=pdf["length"].to_numpy()).astype(np.int64)
        gap = len(fill) - least_bins(pdf["length"].to_numpy(), capacity)
        free = (fill < capacity) if gap else (np.arange(len(fill)) == int(fill.argmin())) & (fill < capacity)
        return pdf[columns].assign(sequence_id=(np.int64(salt) << 56) + (np.int64(key[0]) << 28) + bins, offset=offsets, free=free[bins])

    dealt = rows.select(*columns).withColumn("g", F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id"), F.col("piece"), F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("g").applyInPandas(pack, f"{kinds}, sequence_id long, offset long, free boolean")


def pack_pieces(pieces: DataFrame, capacity: int, group_rows: int = 8192, rounds: int = 3) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (length from 1 to ``capacity``).

    Pieces of full length are sequences by themselves. The others are dealt at random into groups of about
    ``group_rows`` rows, each packed best-fit decreasing and held against its bound. A group with a gap gives up the
    documents of all its bins that aren't full; a group without one only those of its emptiest bin. These
    are dealt anew into fewer groups and packed again, which is kept if it takes fewer bins; then the next round.
    """
    full = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    out, now = full, rest
    for r in range(rounds):
        n = now.count()
        packed = written(_packed(now, max(1, -(-n // group_rows)), r + 1, capacity), f"packed-{r}")
        if r:
            before, after = now.select("sequence_id").distinct().count(), packed.select("sequence_id").distinct().count()
            if after >= before:
                break
        out = out.unionByName(packed.where("not free").drop("free"))
        now = packed.where("free").drop("free")
        if n <= group_rows:
            break
    return out.unionByName(now.select(*out.columns)) if "sequence_id" in now.columns else out


def pack_documents(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and gives one piece, the end id. Repeated rows and null ids are packed like any others, each
    row with pieces of its own. Empty input gives no rows. Other columns are not read.
    """
    return pack_pieces(written(pieces_of(docs, path, capacity), "pieces"), capacity)
