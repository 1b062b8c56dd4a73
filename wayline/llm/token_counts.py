"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import by_bytes, worker_cache

#: About the bytes that an entry of a cache takes besides its string.
ENTRY = 130


class PieceCounter:
    """Counts tokens of whole texts. A text is cut before a space that a non-space follows.

    The byte-level pattern always starts a new pre-token at such a space, whatever stands before it, so that
    the counts of the pieces add up to the count of the whole text. There is no cut before the first
    character of an added token, whose neighbours are split off first. Tokenizers of another make
    (normalizer, prefix space, added tokens that take in white space) get whole texts. A cache of piece counts holds
    ``cache_bytes`` at most and is emptied when full.
    """

    def __init__(self, path: str, cache_bytes: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.cache_bytes, self.held = Tokenizer.from_file(path), {}, cache_bytes, 0
        spec = json.loads(self.tokenizer.to_str())
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.cuts = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in added)
        )
        first = "".join(sorted({regex.escape(t["content"][0]) for t in added}))
        self.unsafe = regex.compile(rf" (?=[\s\x1c-\x1f\u180e{first}]|$)")
        self.safe = regex.compile(rf" (?=[^\s\x1c-\x1f\u180e{first}])")
        self.opens = {t["content"][0] for t in added}

    def segments(self, text: str, chars: int) -> Iterator[str]:
        """The text in parts of about ``chars`` characters, cut before such spaces."""
        at = 0
        while self.cuts and len(text) - at > chars:
            m = self.safe.search(text, at + chars)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def pieces(self, text: str) -> list[str]:
        """The first piece with its own start, and the others without their leading space."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if not self.unsafe.search(text):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if not p or p[0].isspace() or p[0] == "\u180e" or p[0] in self.opens:
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str], most: int = 1 << 18) -> list[int]:
        """Tokens of each text. Calls of the model are of about ``most`` bytes."""
        rows = [self.pieces(t) for t in texts]
        heads = [n for run in by_bytes((r[0] for r in rows), most) for n in self._lengths(run)]
        if self.held > self.cache_bytes:
            self.cache.clear()
            self.held = 0
        cache = self.cache
        new = set()
        for r in rows:
            new.update(r[1:])
        for run in by_bytes(sorted(new.difference(cache)), most):
            cache.update(zip(run, self._lengths([" " + p for p in run]), strict=True))
            self.held += sum(map(len, run)) + ENTRY * len(run)
        get = cache.__getitem__
        return [h + sum(map(get, r[1:])) for h, r in zip(heads, rows, strict=True)]


def segment_runs(texts: Iterator[tuple[str, int]], counter: PieceCounter, most: int) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of segments of about ``most`` UTF-8 bytes with the number of each one's text. Texts come with their bytes."""
    at, run, held = [], [], 0
    for k, (text, size) in enumerate(texts):
        for part in counter.segments(text, most) if size > most else (text,):
            at.append(k)
            run.append(part)
            held += size if size <= most else min(size, 4 * len(part))
            if held >= most:
                yield at, run
                at, run, held = [], [], 0
    if run:
        yield at, run


def count_tokens(
    docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, cache_bytes: int = 48 << 20
) -> DataFrame:
    """Per row of ``docs``: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens above ``limit``).

    One narrow pass: no shuffle, and only lengths come back from Python. ``path`` is a tokenizers file that
    executors can read. Texts are encoded in runs of about ``batch_bytes`` bytes; a longer text takes several. Null text counts as empty (0 bytes, 0 tokens); ids may be null or repeat, each row
    gives one row, no rows give none; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(("pieces", path, cache_bytes), lambda: PieceCounter(path, cache_bytes))
        for b in batches:
            n = np.zeros(len(b), np.int64)
            texts = ((t.as_py() or "", k.as_py()) for t, k in zip(b.column(2), b.column(1), strict=True))
            for at, run in segment_runs(texts, counter, batch_bytes):
                np.add.at(n, at, counter.counts(run))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = out.mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
