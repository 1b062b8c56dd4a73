"""The pipeline's stages on a small table with planted rows."""

from __future__ import annotations

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    base = next(t for t in text.values() if 200 < len(t.split()) < 400)
    w = base.split()
    w[100] = "changed"
    planted = [(900001, base, "en"), (900002, " ".join(w), "en"), (900003, base[:300] + "\n" + items[0]["text"] + "\n" + base[300:600] + " its own end", "en"), (900004, "12345 67890 !!", None), (900005, None, "en"), (900006, base[:450] + " write to jo.doe@example.com now", "en")]
    new = spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in planted], docs.schema)
    at, out = docs.unionByName(new), []
    for _, f in cp.STAGES:
        at = f(spark, at, SF).checkpoint()
        out.append(at)
    return docs, base, out


def test_stage_columns(stages):
    docs, _, out = stages
    assert all(d.columns == docs.columns for d in out[:-1])


def test_decisions(stages):
    docs, base, out = stages
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in out]
    assert {900004, 900005} & ids[0] == set() and len(ids[0]) >= 0.97 * docs.count()
    assert {900001, 900002} & ids[1] == set() and {900003, 900006} <= ids[1]
    assert 900003 not in ids[2]
    assert ids[2] == ids[3] == ids[4]
    row = out[3].where("doc_id = 900006").first()
    assert "jo.doe@" not in row["text"] and "[email]" in row["text"] and row["n_chars"] == len(row["text"])
    fill = out[4].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.where("n > 2048").count() == 0


def test_whole_run(spark):
    assert cp.run(spark, SF).count() > 0


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    names = ["lang_pred", "score", "rejected", "leaks", "pii", "said", "text_hash", "gone_id", "gone_hash", "h", "n"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    odd = spark.createDataFrame([(None, None, None, None, None), (7000001, "", "en", "s", 0), (7000002, "mail a.b@c.org " + "the of and in " * 60000, "en", "s", 1), (7000003, "same text here of the and", "en", "s", 1), (7000003, "same text here of the and", "en", "s", 1)], docs.schema)
    at = docs.unionByName(odd)
    for n in names:
        at = at.withColumn(n, F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, at, SF).checkpoint()
        assert out.columns == at.columns and out.schema.simpleString() == at.schema.simpleString()
        for n in names:
            assert out.where(F.col(n) != F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))).count() == 0
        at = out
    assert at.where("doc_id = 7000003").count() == 1 and at.where("doc_id = 7000001 or doc_id is null").count() == 0
    assert "[email]" in at.where("doc_id = 7000002").first()["text"]
    assert cp.STAGES[-1][1](spark, at, SF).count() >= at.count()


def test_each_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_each_stage_takes_null_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(6).withColumn("text", F.lit(None).cast("string"))
    kept = [stage(spark, docs, SF).count() for _, stage in cp.STAGES]
    assert kept == [0, 1, 6, 6, 6]
