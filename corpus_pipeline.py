"""From documents to packed sequences: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import decontaminate, language, near_copies, packing, pii
from wayline.llm.common import free_name, table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the classifier rejects: no letters (null and empty texts too), or a calibrated score below its bound.

    Repeated rows are judged alike; no rows give none; every column of ``docs`` stays as it is, whatever its name.
    """
    names = tuple(free_name(docs, n) for n in ("lang_pred", "score", "rejected"))
    return language.identify(docs, language.fit_on(docs), into=names).where(~F.col(names[2])).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies (0.8 of five-word shingles) the document with the least doc_id stays.

    Null, empty and word-less texts are copies of one another, and of rows that repeat whole one stays; no rows give none.
    """
    return near_copies.without_copies(docs)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found. Null and empty texts and items match nothing; repeated rows go or stay alike; columns stay."""
    leaks = free_name(docs, "leaks")
    return decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), into=leaks).where(F.size(leaks) == 0).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars is that of the new text. Null texts stay null; every row and other column stays."""
    pii_ = free_name(docs, "pii")
    text = F.col(f"{pii_}.text")
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return pii.with_personal_data(docs, pii.fit_on(docs), redact=True, into=pii_).select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids into sequences of at most 2048. A null or empty text is its end id alone; repeated rows are packed each; no rows give none."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("language ID", known_language), ("SimHash near-dedup", one_of_each), ("benchmark decontamination", free_of_benchmark), ("PII", without_personal_data), ("best-fit packing", packed)]

#: Models and token ids: no SQL can express them; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
