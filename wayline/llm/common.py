"""What the training-data operators share: the shared folder, written tables and row numbers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, at which texts part.
_SPACE = re.compile(rb"[ \t-\r]")
#: Per Python worker: what its last task has left there, under one name. Another name's takes its place.
_WORKER: dict[tuple, Any] = {}


def worker_cache(name: tuple, make: Callable[[], Any]) -> Any:
    """The object of this name that an earlier task of this Python worker made, or a new one.

    A worker keeps one such object at a time, so that workers that serve several operators don't add up their caches.
    """
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = make()
    return _WORKER[name]


def segments(text: bytes, most: int) -> Iterator[bytes]:
    """The text in parts of about ``most`` bytes, cut before ASCII white space."""
    at = 0
    while len(text) - at > most and (m := _SPACE.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def by_bytes(texts: Iterator[str], most: int) -> Iterator[list[str]]:
    """Runs of strings of about ``most`` UTF-8 bytes together; a longer string is a run of its own."""
    run, held = [], 0
    for text in texts:
        n = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
        if run and held + n > most:
            yield run
            run, held = [], 0
        run.append(text)
        held += n
    if run:
        yield run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session names none and runs in this one process (tests) a temporary folder is set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        named = tempfile.mkdtemp(prefix="wayline-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with marks after it until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stretch_of(text: Column, chars: int) -> Column:
    """A stretch of ``chars`` characters, where a hash of the text says; shorter texts whole."""
    return F.substring(text, F.lit(1) + F.pmod(F.xxhash64(text), F.greatest(F.char_length(text) - chars + 1, F.lit(1))).cast("int"), F.lit(chars))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list, name: str, to: str) -> tuple[DataFrame, int]:
    """Adds the global row number ``to`` (from 0, without gaps, in the order given) and returns the row count too.

    Rows are dealt out by ranges of the order; ties are told apart by where Spark read them, so that a key
    that a third of the rows share is dealt to many tasks. Each task numbers its own rows, and only one count
    per task meets on the driver. The dealt rows are written first, as the bounds of ranges are drawn
    anew in each run.
    """
    spark = df.sparkSession
    tie, at, part = f"__tie_{to}", f"__at_{to}", f"__part_{to}"
    dealt = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(spark), *order, F.col(tie))
        .sortWithinPartitions(*order, F.col(tie))
        .drop(tie)
        .withColumn(at, F.monotonically_increasing_id())
        .withColumn(part, F.shiftright(at, 33))
        .withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1))
    )
    dealt = written(dealt, name)
    counts = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    total, starts = 0, {}
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    rows = [F.struct(F.lit(p).cast("long").alias(part), F.lit(n).cast("long").alias(f"__start_{to}")) for p, n in starts.items() or [(0, 0)]]
    offsets = spark.range(1).select(F.inline(F.array(*rows)))
    out = dealt.join(F.broadcast(offsets), part).withColumn(to, F.col(at) + F.col(f"__start_{to}"))
    return out.drop(part, at, f"__start_{to}"), total
