"""Tables as Parquet folders: append, replace by writing beside and swapping, upsert, publishing with a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.records import upserted


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Writes beside the table and swaps names by the store's own rename; if that fails, the old table is put back."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(at)
    if had and not fs.rename(at, jvm.org.apache.hadoop.fs.Path(old)):
        raise OSError(f"could not move {path}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(new), at):
        if had:
            fs.rename(jvm.org.apache.hadoop.fs.Path(old), at)
        raise OSError(f"could not replace {path}")
    if had:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def upsert(spark: SparkSession, changes: DataFrame, path: str, keys: list[str], order: str) -> None:
    replace(upserted(spark.read.parquet(path), changes, keys, order), path)


def publish(df: DataFrame, path: str, by: str, shards: int = 256) -> DataFrame:
    """Writes partitioned by a hash of ``by`` and returns the manifest: a row per shard with rows and a content hash that doesn't depend on order."""
    rows = df.withColumn("shard", F.pmod(F.xxhash64(by), F.lit(shards)).cast("int"))
    rows.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.groupBy("shard").agg(F.count("*").alias("rows"), F.sha2(F.sum(F.xxhash64(*[c for c in df.columns]).cast("decimal(38,0)")).cast("string"), 256).alias("content"))
