"""Versioned tables: data folders that never move, and one small mark a version, put last.

``path/data/<id>`` holds the rows of one version, with what is known of it beside them; ``path/versions/<number>`` names the data folder that the version shows. A version is there once its mark is: readers take the newest mark, or the one that
they pinned, so they never meet a half-written table or none, on stores without an atomic rename too. Marks are created, never overwritten: of two writers of one version one fails.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wayline.operators.records import upserted


class Conflict(Exception):
    """Another writer has made the version first."""


class Version(NamedTuple):
    number: int
    data: str
    at: float
    rows: int
    schema: StructType


class _Store:
    """The path's own file system, as Hadoop knows it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def put(self, name: str, text: str) -> None:
        """Creates a file; raises Conflict if it is there."""
        at = self.path(name)
        try:
            out = self.fs.create(at, False)
        except Exception as e:
            if self.fs.exists(at):
                raise Conflict(name) from e
            raise
        out.write(text.encode())
        out.close()

    def text(self, name: str) -> str:
        into = self.jvm.java.io.ByteArrayOutputStream()
        source = self.fs.open(self.path(name))
        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, into, 4096, True)
        return into.toString("UTF-8")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All versions, oldest first. A mark without what it names, as a writer leaves that dies while it puts it, is no version."""
    store, out = _Store(spark, path), []
    for name in sorted(n for n in store.names(f"{path}/versions") if n.isdigit()):
        data = store.text(f"{path}/versions/{name}")
        if data and store.fs.exists(store.path(f"{path}/data/{data}/about.json")):
            about = json.loads(store.text(f"{path}/data/{data}/about.json"))
            out.append(Version(int(name), data, about["at"], about["rows"], StructType.fromJson(about["schema"])))
    return out


def commit(df: DataFrame, path: str, expect: int | None = None, at: float | None = None) -> int:
    """Writes the rows as the next version and returns its number, from 1; ``expect``: the newest version that the rows were made from (0: none), else Conflict."""
    spark = df.sparkSession
    store, data = _Store(spark, path), uuid.uuid4().hex
    folder = f"{path}/data/{data}"
    df.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{folder}/rows").count()
    store.put(f"{folder}/about.json", json.dumps({"at": time.time() if at is None else at, "rows": rows, "schema": json.loads(df.schema.json())}))
    last = max([int(n) for n in store.names(f"{path}/versions") if n.isdigit()], default=0)
    if expect is not None and max([v.number for v in versions(spark, path)], default=0) != expect:
        raise Conflict(f"{path}: version {expect} is not the newest")
    store.put(f"{path}/versions/{last + 1:012d}", data)
    return last + 1


def read(spark: SparkSession, path: str, number: int | None = None) -> tuple[DataFrame, Version]:
    """The rows of a version (the newest) and the version itself; the frame stays with that version whatever is committed later."""
    known = [v for v in versions(spark, path) if number is None or v.number == number]
    if not known:
        raise LookupError(f"{path}: no version {'' if number is None else number}".rstrip())
    return spark.read.schema(known[-1].schema).parquet(f"{path}/data/{known[-1].data}/rows"), known[-1]


def restored(spark: SparkSession, path: str, now: float, most: float = 900.0) -> DataFrame | None:
    """The newest version's rows, if it is at most ``most`` seconds old and not from the future; else None."""
    known = versions(spark, path)
    return read(spark, path, known[-1].number)[0] if known and 0 <= now - known[-1].at <= most else None


def upsert(changes: DataFrame, path: str, keys: list[str], order: str, attempts: int = 5) -> int:
    """A new version in which ``changes`` stand by key; begins anew if another writer was first."""
    for _ in range(attempts):
        rows, version = read(changes.sparkSession, path)
        try:
            return commit(upserted(rows, changes, keys, order), path, expect=version.number)
        except Conflict:
            continue
    raise Conflict(path)


def clean(spark: SparkSession, path: str, keep: int = 2, grace: float = 86_400.0) -> int:
    """Deletes all versions but the newest ``keep``, and data that no version names once it is ``grace`` seconds old (younger may be a writer's at work). Returns how many data folders went."""
    store, known = _Store(spark, path), versions(spark, path)
    kept = {v.data for v in (known[-keep:] if keep else [])}
    for v in known[:-keep] if keep else known:
        store.delete(f"{path}/versions/{v.number:012d}")
    gone = [d for d in store.names(f"{path}/data") if d not in kept and (d in {v.data for v in known} or store.age(f"{path}/data/{d}") >= grace)]
    for d in gone:
        store.delete(f"{path}/data/{d}")
    return len(gone)
