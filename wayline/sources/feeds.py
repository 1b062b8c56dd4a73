"""JSON feeds and page sources as flat rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.words import number_variants, page_text

PLACE = "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>"
RUN = "struct<timestamp:bigint,trip_updates:array<struct<trip_id:string,start_date:string,agency_id:string,numbers:array<string>,cancelled:boolean,detour:boolean,stop_times:array<struct<stop_sequence:int,arrival:bigint,departure:bigint,platform:string,track:string,confirmed:boolean,cancelled:boolean>>>>>"


def map_elements(texts: DataFrame, box: tuple[float, float, float, float], column: str = "value") -> DataFrame:
    """Named map elements in a box (south, west, north, east): osm_id, lat, lon, tags. Nodes by their place, others by their centre; text that is no such JSON gives nothing."""
    e = texts.select(F.from_json(column, PLACE).alias("j")).select(F.inline("j.elements"))
    rows = e.select(F.concat_ws("/", "type", "id").alias("osm_id"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), "tags")
    south, west, north, east = box
    return rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east) & F.col("tags").isNotNull())


def addresses(elements: DataFrame) -> DataFrame:
    tag = lambda *names: F.coalesce(*[F.col("tags")[n] for n in names])
    return elements.select("osm_id", tag("addr:street", "addr:place").alias("street"), tag("addr:housenumber").alias("house"), tag("addr:city", "addr:place").alias("locality"), "lat", "lon").where("street is not null and house is not null")


def places(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Kind and category: the first of the keys, in order, that an element bears."""
    kind = F.coalesce(*[F.when(F.col("tags")[k].isNotNull(), F.lit(k)) for k in keys])
    return elements.select("osm_id", F.col("tags")["name"].alias("name"), kind.alias("kind"), F.coalesce(*[F.col("tags")[k] for k in keys]).alias("category"), "lat", "lon").where("kind is not null and name is not null")


def rail_updates(texts: DataFrame, column: str = "value") -> DataFrame:
    """(trip_id, start_date, cancelled, finished, number, last_confirmed, stop_times): a row per run and number that names it."""
    u = texts.select(F.from_json(column, RUN).alias("j")).select(F.inline("j.trip_updates"))
    confirmed = F.array_max(F.transform(F.filter("stop_times", lambda s: s["confirmed"]), lambda s: s["stop_sequence"]))
    last = F.array_max(F.transform("stop_times", lambda s: s["stop_sequence"]))
    numbers = F.array_distinct(F.flatten(F.transform("numbers", number_variants)))
    return u.select("trip_id", "start_date", F.coalesce("cancelled", F.lit(False)).alias("cancelled"), F.coalesce(confirmed == last, F.lit(False)).alias("finished"), F.explode_outer(numbers).alias("number"), confirmed.alias("last_confirmed"), "stop_times")


def news_items(texts: DataFrame, item: str = "item", column: str = "value") -> DataFrame:
    """(title, link, body) of each item of an RSS text."""
    tag = lambda x, n: page_text(F.regexp_replace(F.regexp_extract(x, rf"(?s)<{n}[^>]*>(.*?)</{n}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    rows = texts.select(F.explode(F.regexp_extract_all(column, F.lit(rf"(?s)<{item}\b[^>]*>(.*?)</{item}>"), 1)).alias("x"))
    return rows.select(tag(F.col("x"), "title").alias("title"), tag(F.col("x"), "link").alias("link"), tag(F.col("x"), "description").alias("body"))


def decoded(data: Column, charset: str = "iso-8859-2") -> Column:
    """Bytes of a charset that Spark's own decode doesn't know, as text; what can't be read becomes a mark."""

    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if v is None else v.decode(charset, "replace") for v in a.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(data)
