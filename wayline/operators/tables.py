"""Intermediate results as tables that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the context's. Where the session names none, one in this process (tests) takes a temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayline-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a step that one task takes, where they are counted.
ROWS_A_TASK = 1_000_000


def tasks(spark: SparkSession, rows: int = 0, share: int | None = None) -> int:
    """Tasks for a step that makes many rows of few: Spark would size it by the few that it reads and leave it to one or two. With ``rows``, those that it makes, as many that none takes more than its ``share``, however many there are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-rows // (share or ROWS_A_TASK)))


#: Values of a key that stand in one array, about.
SET = 256


def dealt(rows: DataFrame, key: list[str], value: str, name: str, numbered: bool = False) -> DataFrame:
    """(*key, name), ``numbered`` with the array's number __part: the values of each key in arrays of about ``SET``, as many arrays as a key needs: the other side of a join meets arrays, not values, and its task holds one of them."""
    n = rows.groupBy(*key).agg(F.ceil(F.count("*") / SET).alias("__n"))
    sets = rows.join(n, key).groupBy(*key, F.pmod(F.xxhash64(value), F.col("__n")).alias("__part")).agg(F.collect_list(value).alias(name))
    return sets if numbered else sets.drop("__part")


#: Bytes of a text file whose rows one task takes, where the files are known.
BYTES_A_TASK = 8_000_000


def file_tasks(df: DataFrame) -> int:
    """Tasks for a step on all rows of the files that df reads: as many that none takes more than its share of bytes, however large the files are."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return max(tasks(spark), -(-sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) // BYTES_A_TASK))


def forget(spark: SparkSession) -> int:
    """Deletes all tables that this application has written to the shared folder, the training-data operators' too; returns how many. For the end of a job: frames that read them can't be used after it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = [x.getPath() for x in (fs.listStatus(at) if fs.exists(at) else []) if x.getPath().getName().startswith(f"{spark.sparkContext.applicationId}-")]
    for x in own:
        fs.delete(x, True)
    return len(own)
