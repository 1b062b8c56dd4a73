"""Language ID: averaged hashed subword embeddings with a linear softmax, fitted in numpy, with calibrated rejection."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import free_name, stretch_of, worker_cache

BITS = 15
#: ASCII that isn't a letter is a space; other bytes stay as they are.
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _bytes(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE) + b"   "


def subwords(a: np.ndarray, starts: int) -> Iterator[np.ndarray]:
    """Buckets of the 2-, 3- and 4-byte pieces of words that begin at the first ``starts`` bytes; bucket 0 is none.

    A word's two ends count as a space; a piece never spans two words.
    """
    c = [a[i : i + starts].astype(np.uint32) for i in range(4)]
    s = [x == 32 for x in c]
    packed, inner = c[0], None
    for n in (2, 3, 4):
        packed = packed | (c[n - 1] << np.uint32(8 * (n - 1)))
        inner = (s[0] & s[1]) if n == 2 else s[1] if n == 3 else s[1] | s[2]
        bucket = ((packed + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        yield np.where(inner, np.uint32(0), np.maximum(bucket, np.uint32(1)))


def sums(texts: list[str], table: np.ndarray, window: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the sum of the table's rows over its subwords, and their number. Whole texts, in windows of bytes."""
    data = [_bytes(t) for t in texts]
    edges = np.cumsum([0, *map(len, data)])
    a = np.frombuffer(b"".join(data) + b"   ", np.uint8)
    total, number = np.zeros((len(texts), table.shape[1]), np.float64), np.zeros(len(texts), np.int64)
    for lo in range(0, int(edges[-1]), window):
        hi = min(lo + window, int(edges[-1]))
        first, last = np.searchsorted(edges, lo, "right") - 1, np.searchsorted(edges, hi, "left")
        at = np.maximum(edges[first:last], lo) - lo
        for bucket in subwords(a[lo : hi + 3], hi - lo):
            total[first:last] += np.add.reduceat(table[bucket], at, axis=0)
            number[first:last] += np.add.reduceat((bucket > 0).astype(np.int64), at)
    return total, number


@dataclass
class LanguageModel:
    """``table`` holds each bucket's embedding times the softmax's weights; row 0 is zero."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        total, number = sums(texts, self.table)
        return total / np.maximum(number, 1)[:, None] + self.bias

    def shares(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts) / self.heat
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7, dim: int = 16, epochs: int = 4, rate: float = 2.0, lose: float = 0.002) -> LanguageModel:
    """Stochastic gradient descent over random stretches (20 to 400 characters) of the labelled texts.

    A fifth of the rows is held back: the softmax's heat is set on them by likelihood, and the rejection bound so
    that at most the share ``lose`` of them falls below it (at most one half). No rows, or no letters: a model without languages.
    """
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    order = rng.permutation(len(rows))
    cut = len(rows) // 5 if len(rows) >= 20 else 0
    back, train = [rows[i] for i in order[:cut]], [rows[i] for i in order[cut:]]

    def stretch(text: str) -> str:
        n = int(rng.integers(20, 400))
        i = int(rng.integers(0, max(1, len(text) - n + 1)))
        return text[i : i + n]

    e = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    of = {lang: i for i, lang in enumerate(langs)}
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            text, lang = train[k]
            a = np.frombuffer(_bytes(stretch(text)), np.uint8)
            idx = np.concatenate(list(subwords(a, len(a) - 3)))
            idx = idx[idx > 0]
            now = rate * (1 - step / steps)
            step += 1
            if not len(idx):
                continue
            x = e[idx].mean(axis=0)
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[of[lang]] -= 1
            pull = (now / len(idx)) * (w @ p)
            w -= now * 0.1 * np.outer(x, p)
            bias -= now * 0.01 * p
            np.subtract.at(e, idx, pull)
    table = (e @ w).astype(np.float32)
    table[0] = 0
    model = LanguageModel(langs, table, bias.astype(np.float64))
    if back:
        texts, want = [stretch(t) for t, _ in back], np.array([of[lang] for _, lang in back])
        z = model.logits(texts)

        def loss(heat: float) -> float:
            y = z / heat
            y = y - y.max(axis=1, keepdims=True)
            return float((np.log(np.exp(y).sum(axis=1)) - y[np.arange(len(y)), want]).mean())

        model.heat = min((0.25 * 1.25**i for i in range(20)), key=loss)
        model.least = min(0.5, float(np.quantile(model.shares(texts).max(axis=1), lose)) * 0.9)
    return model


def labelled_sample(docs: DataFrame, learn_from: Column, per_lang: int, chars: int, most_rows: int, most_langs: int, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """About ``per_lang`` stretches of each language (``most_rows`` of all together), of at most ``chars`` characters.

    Distinct texts of any length are drawn by a hash of the text, at a share that follows from their number, and one stretch out of each by the same hash;
    copies count once, so no text that many rows hold weighs more. Of more than ``most_langs`` languages those with most texts are learned.
    """
    rows = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    counts = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    each, keep = min(per_lang, most_rows // max(1, len(counts))), F.lit(0)
    for lang, n in counts.items():
        keep = F.when(F.col("lang") == lang, min(1 << 20, (each << 20) // max(1, n))).otherwise(keep)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(1 << 20)) < keep).select(F.xxhash64("text").alias("h"), stretch_of(F.col("text"), chars).alias("text"), "lang").distinct()
    return sorted((r["text"], r["lang"]) for r in drawn.collect())


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", into: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds lang_pred, score and rejected, under the names ``into``, to the columns of ``docs``; existing columns of these names are replaced.

    ``und`` with score 0 if the text is null or has no letter (or the model knows no language). ``rejected``: und, or a calibrated score below
    the model's bound. Whole texts; one narrow pass; the model (fixed size) is broadcast. Repeated rows give a row each, no rows none.
    """
    keep = [c for c in docs.columns if c not in into]
    box, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = worker_cache(("language", name), lambda: box.value)
        for part in parts:
            out, held, size = [], [], 0
            for i, v in enumerate(part):
                held.append(v.as_py() or "")
                size += len(held[-1])
                if size > 1 << 19 or i == len(part) - 1:
                    p = m.shares(held) if m.langs else np.zeros((len(held), 1))
                    best = p.argmax(axis=1)
                    for t, k, s in zip(held, best, p.max(axis=1), strict=True):
                        known = bool(m.langs) and any(map(str.isalpha, t))
                        out.append({"lang": m.langs[k], "score": float(min(1.0, s))} if known else {"lang": "und", "score": 0.0})
                    held, size = [], 0
            yield pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    said = free_name(docs, "said")
    guess = F.arrow_udf(run, "lang string, score double")
    told = docs.select(*keep, guess(F.col(text_col)).alias(said))
    lang, score = F.col(f"{said}.lang"), F.col(f"{said}.score")
    return told.select(*keep, lang.alias(into[0]), score.alias(into[1]), ((lang == "und") | (score < model.least)).alias(into[2]))


def fold(id_col: str = "doc_id"):
    """Remainder 1 of the id's crc by 3: the rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, per_lang: int = 1500, chars: int = 2000, most_rows: int = 30_000, most_langs: int = 200) -> LanguageModel:
    """The model that the queries use, fitted on rows outside the held-out fold with a known id; the parameters bound its sample."""
    return fit(labelled_sample(docs, ~fold() & F.col("doc_id").isNotNull(), per_lang, chars, most_rows, most_langs))


def language_of_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (0 to 1), rejected. Null ids are not held out, nor learned from."""
    docs = docs.select("doc_id", "text", "lang")
    said = identify(docs.select("doc_id", "text"), fit_on(docs))
    return said.select("doc_id", fold().alias("held_out"), "lang_pred", "score", "rejected")
