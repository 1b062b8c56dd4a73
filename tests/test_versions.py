"""Versioned tables: readers during a swap, writers that fail or meet, restoring."""

from __future__ import annotations

import pytest

from wayline.sinks import versions as v


def rows(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, x string")


def names(df):
    return sorted(r["x"] for r in df.collect())


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(LookupError):
        v.read(spark, path)
    assert v.commit(rows(spark, "a", "b"), path, expect=0) == 1
    pinned, at = v.read(spark, path)
    assert v.commit(rows(spark, "c"), path, expect=1) == 2
    assert names(pinned) == ["a", "b"] and names(v.read(spark, path)[0]) == ["c"] and names(v.read(spark, path, at.number)[0]) == ["a", "b"]
    assert [(x.number, x.rows) for x in v.versions(spark, path)] == [(1, 2), (2, 1)]
    v.commit(rows(spark, "d"), path)
    assert v.clean(spark, path, keep=2) == 1
    assert names(v.read(spark, path, 2)[0]) == ["c"] and [x.number for x in v.versions(spark, path)] == [2, 3]


def test_failure_between_data_and_mark(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    v.commit(rows(spark, "a"), path)
    put = v._Store.put

    def fails(self, name, text):
        if "/versions/" in name:
            raise OSError("lost")
        put(self, name, text)

    monkeypatch.setattr(v._Store, "put", fails)
    with pytest.raises(OSError, match="lost"):
        v.commit(rows(spark, "b"), path)
    monkeypatch.undo()
    assert names(v.read(spark, path)[0]) == ["a"]
    assert v.clean(spark, path) == 0, "the data may be a writer's at work"
    assert v.clean(spark, path, grace=0) == 1
    assert v.commit(rows(spark, "c"), path) == 2 and names(v.read(spark, path)[0]) == ["c"]


def test_a_torn_mark_is_no_version(spark, tmp_path):
    path = str(tmp_path / "t")
    v.commit(rows(spark, "a"), path)
    v._Store(spark, path).put(f"{path}/versions/{2:012d}", "")
    assert names(v.read(spark, path)[0]) == ["a"]
    assert v.commit(rows(spark, "b"), path, expect=1) == 3


def test_of_two_writers_one_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    v.commit(rows(spark, "a"), path)
    v.commit(rows(spark, "b"), path, expect=1)
    with pytest.raises(v.Conflict):
        v.commit(rows(spark, "c"), path, expect=1)
    with pytest.raises(v.Conflict):
        v._Store(spark, path).put(f"{path}/versions/{2:012d}", "x")
    assert v.upsert(spark.createDataFrame([(0, "z", 2), (7, "new", 2)], "id long, x string, ts long"), path, ["id"], "ts") == 3
    assert names(v.read(spark, path)[0]) == ["new", "z"]


def test_restore_only_what_is_fresh(spark, tmp_path):
    path = str(tmp_path / "t")
    assert v.restored(spark, path, 1000.0) is None
    v.commit(rows(spark, "a").limit(0), path, at=1000.0)
    assert v.restored(spark, path, 1900.0).count() == 0 and v.restored(spark, path, 1900.5) is None and v.restored(spark, path, 999.0) is None


def test_forget_what_a_job_has_written(spark, tmp_path, monkeypatch):
    from wayline.operators import tables

    monkeypatch.setattr(tables, "shared_folder", lambda _: str(tmp_path))
    one = tables.cut(rows(spark, "a"))
    (tmp_path / "another-job").mkdir()
    assert names(one) == ["a"] and tables.forget(spark) == 1 and [x.name for x in tmp_path.iterdir()] == ["another-job"]
