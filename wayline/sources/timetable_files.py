"""Timetable files (CSV with a header): rows without what they need are dropped, numbers that are none get their default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wayline.functions.clock import seconds_of
from wayline.functions.words import normalized
from wayline.operators.records import one_of_each
from wayline.operators.tables import file_tasks

#: Columns that a file must have.
REQUIRED = {"stops": ["stop_id", "stop_name"], "routes": ["route_id"], "trips": ["trip_id", "route_id", "service_id"], "stop_times": ["trip_id", "stop_id", "stop_sequence"], "calendar": ["service_id"], "calendar_dates": ["service_id", "date", "exception_type"], "shapes": ["shape_id", "shape_pt_sequence"]}
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def read_file(spark: SparkSession, path: str, name: str, required: bool = True) -> DataFrame | None:
    """All columns as text, found by name; a byte-order mark, blanks around values and blank lines go. Missing and not required: None.

    Spark splits large files among tasks. A row's place is kept in ``__row``: its file (of several, by name), where its block begins there, and its number within the block, so it doesn't matter how Spark packs files and
    blocks into tasks. A required column that isn't there raises.
    """
    try:
        df = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    except AnalysisException:
        if required:
            raise
        return None
    names = [c.replace("﻿", "").strip() for c in df.columns]
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"))
    df = df.select("*", place.alias("__row")).toDF(*names, "__row")
    missing = [c for c in REQUIRED[name] if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: no column {', '.join(missing)}")
    return df


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _number(df: DataFrame, name: str, kind: str, default) -> Column:
    return F.coalesce(F.expr(f"try_cast(`{name}` AS {kind})"), F.lit(default).cast(kind)) if name in df.columns else F.lit(default).cast(kind)


def _last(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row that stands last in the files. Rows are dealt by key to as many tasks as the file's bytes ask for, before any of them is ordered: a row carries its place, which is long."""
    return one_of_each(rows.repartition(file_tasks(df), key), [key], [F.col("__row")], first=False).drop("__row")


def stops(df: DataFrame) -> DataFrame:
    """Rows with id and name; of an id that repeats the last row stays."""
    rows = df.where((_text(df, "stop_id") != "") & (_text(df, "stop_name") != ""))
    out = rows.select("stop_id", _text(df, "stop_code").alias("stop_code"), "stop_name", _number(df, "stop_lat", "double", 0.0).alias("stop_lat"), _number(df, "stop_lon", "double", 0.0).alias("stop_lon"), normalized(F.col("stop_name")).alias("normalized_name"), "__row")
    return _last(df, out, "stop_id")


def routes(df: DataFrame) -> DataFrame:
    short = F.coalesce(F.nullif(_text(df, "route_short_name"), F.lit("")), F.col("route_id"))
    out = df.where(_text(df, "route_id") != "").select("route_id", short.alias("route_short_name"), _text(df, "route_long_name").alias("route_long_name"), _number(df, "route_type", "int", 3).alias("route_type"), "__row")
    return _last(df, out, "route_id")


def trips(df: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """With ``services`` (service_id) only trips of these: a semi join before anything else."""
    out = df.where((_text(df, "trip_id") != "") & (_text(df, "route_id") != ""))
    if services is not None:
        out = out.join(services, "service_id", "left_semi")
    out = out.select("trip_id", "route_id", "service_id", _text(df, "trip_headsign").alias("headsign"), _number(df, "direction_id", "int", 0).alias("direction"), _text(df, "shape_id").alias("shape_id"), "__row")
    return _last(df, out, "trip_id")


def stop_times(df: DataFrame, trip_ids: DataFrame | None = None) -> DataFrame:
    """Rows with a stop and a whole-number place; departure as arrival where it is missing, arrival as 00:00:00. Of a (trip, place) that repeats the first row stays.

    Rows meet the trips asked for, and one another, by trip, in as many tasks as the file's bytes ask for.
    """
    seq = F.expr("try_cast(stop_sequence AS int)")
    arr = F.coalesce(F.nullif(_text(df, "arrival_time"), F.lit("")), F.lit("00:00:00"))
    dep = F.coalesce(F.nullif(_text(df, "departure_time"), F.lit("")), arr)
    out = df.where((_text(df, "stop_id") != "") & seq.isNotNull()).select("trip_id", seq.alias("seq"), "stop_id", seconds_of(arr).alias("arr"), seconds_of(dep).alias("dep"), "__row")
    n = file_tasks(df)
    if trip_ids is None:
        out = out.repartition(n, "trip_id")
    else:
        out = out.join(trip_ids.select("trip_id").repartition(n, "trip_id").distinct(), "trip_id")
    return one_of_each(out, ["trip_id", "seq"], [F.col("__row")]).drop("__row")


def calendar(df: DataFrame) -> DataFrame:
    return df.where(_text(df, "service_id") != "").select(F.col("service_id").alias("service"), *[_number(df, d, "int", 0).alias(d[:3]) for d in DAYS], _text(df, "start_date").alias("start_date"), _text(df, "end_date").alias("end_date"))


def calendar_dates(df: DataFrame) -> DataFrame:
    return df.where(_text(df, "service_id") != "").select(F.col("service_id").alias("service"), "date", _number(df, "exception_type", "int", 0).alias("exc")).where("exc in (1, 2)")


def shapes(df: DataFrame) -> DataFrame:
    """(shape_id, points): each line's points in order."""
    p = F.struct(_number(df, "shape_pt_sequence", "int", 0).alias("seq"), _number(df, "shape_pt_lat", "double", 0.0).alias("lat"), _number(df, "shape_pt_lon", "double", 0.0).alias("lon"))
    out = df.where(_text(df, "shape_id") != "").groupBy("shape_id").agg(F.array_sort(F.collect_list(p)).alias("p"))
    return out.select("shape_id", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"))


def complete(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows): raises if one of the tables has no row, as a cut-off archive has."""
    counts = [(n, int(df.limit(1).count())) for n, df in tables.items()]
    empty = [n for n, k in counts if not k]
    if empty:
        raise ValueError(f"incomplete archive: no rows in {', '.join(empty)}")
    return next(iter(tables.values())).sparkSession.createDataFrame(counts, "name string, rows int")


def archive_in_force(candidates: DataFrame, now: str) -> DataFrame:
    """Of archives (name, effective YYYYMMDD) the newest in force, else the first to come."""
    known = candidates.where(F.col("effective") <= now).agg(F.max(F.struct("effective", "name")).alias("x"))
    coming = candidates.agg(F.min(F.struct("effective", "name")).alias("y"))
    return known.crossJoin(coming).select(F.coalesce("x", "y").alias("x")).select("x.*")
