"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.ann_graph import nearest
from wayline.llm.common import table
from wayline.llm.decontaminate import leaked_documents
from wayline.llm.language import language_of_documents
from wayline.llm.neardup import near_duplicates
from wayline.llm.packing import pack_documents
from wayline.llm.phrases import ORACLE_SQL as PHRASES_SQL
from wayline.llm.phrases import collocations
from wayline.llm.pii import personal_data
from wayline.llm.prefix_trie import ORACLE_SQL as TRIE_SQL
from wayline.llm.prefix_trie import conversation_trie
from wayline.llm.quotes import ORACLE_SQL as QUOTES_SQL
from wayline.llm.quotes import without_quotes
from wayline.llm.sharding import shard_documents
from wayline.llm.token_counts import count_tokens
from wayline.llm.url_filter import Rule, judge_urls
from wayline.llm.vector_copies import near_copies

RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, top=5)


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_quotes(table(spark, sf_dir, "conversations"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_documents(table(spark, sf_dir, "documents"))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24, seed=20240229)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language; SQL beside it."""
    return collocations(table(spark, sf_dir, "documents"), least=100, top=2000)


def op12_embedding_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9; tests hold it against all pairs."""
    return near_copies(table(spark, sf_dir, "embeddings"), least=0.9)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations, a row per node; SQL beside it."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_nn_descent, op4_quotation_linking, op5_personal_data, op6_url_filter, op7_language_id, op8_feistel_shards, op9_best_fit_packing, op10_simhash_near_duplicates, op11_phrase_collocations, op12_embedding_near_copies, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quotation_linking": QUOTES_SQL, "op11_phrase_collocations": PHRASES_SQL, "op13_prefix_trie": TRIE_SQL}
