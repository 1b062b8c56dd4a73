"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search along it, as Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.common import numbered, written


def usable(vector: Column) -> Column:
    """True for vectors that are neither null, empty or zero nor hold null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """In double precision, on the vectors as they are."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def coded(v: Column) -> Column:
    """Direction as one signed byte a component: what the graph and the search compare by."""

    def run(a: pa.Array) -> pa.Array:
        x = np.array([v.as_py() for v in a], np.float64).reshape(len(a), -1)
        q = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
        return pa.array([r.tobytes() for r in q], pa.binary())

    return F.arrow_udf(run, "binary")(v)


def directions(codes: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(embedding, ids): each vector once with its ``keep`` smallest ids.

    Batches keep only their smallest ids of each vector, so that a vector that a third of the rows share
    never meets whole in one task.
    """
    kind = rows.schema["embedding"].dataType.simpleString()
    values = pa.float64() if kind == "array<double>" else pa.float32()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[tuple, list[int]] = {}
            for v, i in sorted(zip(map(tuple, b.column(1).to_pylist()), b.column(0).to_pylist(), strict=True), key=lambda x: x[1]):
                ids = held.setdefault(v, [])
                if len(ids) < keep:
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(list, held)), pa.list_(values)), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["embedding", "ids"])

    part = rows.select("id", "embedding").mapInArrow(least, f"embedding {kind}, ids array<long>")
    return part.groupBy("embedding").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))


def local_join(members: DataFrame, vectors: DataFrame, best: int, top: int) -> DataFrame:
    """(v, w, s): neighbour candidates found among the members of each group ``u``.

    ``members``: (u, m, fresh); ``vectors``: (node, code, worst). In a group each member v takes its ``best`` nearest other members
    w, if they are nearer than its worst neighbour so far and one of the two is fresh. A batch passes on its ``top`` for each v.
    """
    grouped = members.join(vectors, members["m"] == vectors["node"]).groupBy("u").agg(F.collect_list(F.struct("m", "fresh", "worst", "code")).alias("x")).where(F.exists("x", lambda e: e["fresh"])).select("x")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0)
            size = np.diff(x.offsets.to_numpy())
            flat = x.flatten()
            m, fresh, worst = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            y = directions(flat.field(3)) if len(flat) else None
            begin, found = np.concatenate([[0], np.cumsum(size)]), []
            for i in range(0, len(size), 256):
                n = size[i : i + 256]
                if not n.max(initial=0) > 1:
                    continue
                at = begin[i : i + len(n), None] + np.arange(n.max())
                real = np.arange(n.max()) < n[:, None]
                at = np.where(real, at, 0)
                s = np.matmul(y[at], y[at].transpose(0, 2, 1))
                ok = real[:, :, None] & real[:, None, :] & (fresh[at][:, :, None] | fresh[at][:, None, :]) & (m[at][:, :, None] != m[at][:, None, :]) & (s > worst[at][:, :, None])
                s[~ok] = -9
                k = min(best, s.shape[2])
                near = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
                score = np.take_along_axis(s, near, 2)
                g, v, _ = pick = np.nonzero(score > -9)
                found.append((m[at[g, v]], m[at[g, near[pick]]], score[pick]))
            if found:
                v, w, s = (np.concatenate(z) for z in zip(*found, strict=True))
                order = np.lexsort((w, -s, v))
                v, w, s = v[order], w[order], s[order]
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
                v, w, s = v[new], w[new], s[new]
                rank = np.arange(len(v)) - np.searchsorted(v, v)
                take = rank < top
                yield pa.RecordBatch.from_arrays([pa.array(v[take], pa.int64()), pa.array(w[take], pa.int64()), pa.array(s[take], pa.float32())], names=["v", "w", "s"])

    return grouped.mapInArrow(pairs, "v long, w long, s float")


def neighbour_graph(codes: DataFrame, total: int, k: int = 32, reverse: int = 24, best: int = 6, rounds: int = 7, old_share: float = 0.4, settled: float = 0.01) -> DataFrame:
    """(v, near): the k nearest found of each node, nearest first, as (s, w, fresh), by NN-descent.

    ``codes``: a written table (node, code), nodes numbered from 0. Starts with random groups of about k nodes. A round joins the members of
    each node's neighbourhood, its own neighbours and those it is a neighbour of, with one another: neighbours of
    neighbours become candidates. As in the published method, pairs of two old neighbours aren't compared again, old ones are
    sampled, and of the nodes that have u as a neighbour about ``reverse`` are drawn, so that no hub fills a task. Ends after ``rounds`` or when
    fewer than the share ``settled`` of the links is new.
    """
    near = F.slice(F.sort_array(F.collect_list(F.struct("s", "w", "fresh")), asc=False), 1, k).alias("near")
    groups = max(1, -(-total // k))
    start = [codes.select(F.pmod(F.xxhash64(F.lit(i), "node"), F.lit(groups)).alias("u"), F.col("node").alias("m"), F.lit(True).alias("fresh")) for i in range(2)]
    start = start[0].unionByName(start[1].withColumn("u", F.col("u") + groups))
    open_ends = codes.withColumn("worst", F.lit(-2.0).cast("float"))
    found = local_join(start, open_ends, k, k)
    state = written(found.groupBy("v", "w").agg(F.max("s").alias("s"), F.lit(True).alias("fresh")).groupBy("v").agg(near), "graph-0")
    for r in range(1, rounds + 1):
        links = state.select("v", F.explode("near").alias("e")).select("v", "e.s", "e.w", "e.fresh")
        drawn = lambda *c, r=r: F.pmod(F.xxhash64(F.lit(r), *c), F.lit(1 << 20)) / float(1 << 20)
        links = links.where(F.col("fresh") | (drawn("v", "w") < old_share))
        fans = links.groupBy("w").agg(F.count("*").alias("n"))
        back = links.join(fans, "w").where(drawn("w", "v") * F.col("n") < reverse).select(F.col("w").alias("u"), F.col("v").alias("m"), "fresh")
        members = links.select(F.col("v").alias("u"), F.col("w").alias("m"), "fresh").unionByName(back)
        members = members.groupBy("u", "m").agg(F.max("fresh").alias("fresh"))
        worst = state.select(F.col("v").alias("node"), F.when(F.size("near") < k, -2.0).otherwise(F.element_at("near", -1)["s"]).cast("float").alias("worst"))
        found = local_join(members, codes.join(worst, "node"), best, k)
        kept = state.select("v", F.explode("near").alias("e")).select("v", "e.w", "e.s", F.lit(False).alias("fresh"))
        both = kept.unionByName(found.select("v", "w", "s", F.lit(True).alias("fresh")))
        state = written(both.repartition("v").groupBy("v", "w").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh")).groupBy("v").agg(near), f"graph-{r}")
        changed = state.select(F.sum(F.size(F.filter("near", lambda e: e["fresh"])))).first()[0] or 0
        if changed < settled * k * total:
            break
    return state


def greedy_search(graph: DataFrame, codes: DataFrame, queries: DataFrame, beam: int = 192, step: int = 32, hops: int = 12) -> DataFrame:
    """(q, w, s): for each query node the best nodes found by walking the graph from the node itself.

    A query holds the ``beam`` best nodes seen. Each hop opens the ``step`` best that aren't open yet, scores their neighbours and
    keeps the best again, until all in the beam are open; ``hops`` bounds the walk at twice the hops that open a whole beam, and a walk that ends there gives the
    best seen so far. Rows in flight grow with the queries only.
    """
    links = graph.select(F.col("v"), F.transform("near", lambda e: e["w"]).alias("ws"))
    asked = queries.join(codes, queries["q"] == codes["node"]).select("q", F.col("code").alias("own"))
    place = Window.partitionBy("q").orderBy(F.desc("s"), "w")

    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.einsum("ij,ij->i", directions(a), directions(b)) if len(a) else [], pa.float32())

    scored = F.arrow_udf(score, "float")
    held = written(queries.join(graph, queries["q"] == graph["v"]).select("q", F.explode("near").alias("e")).select("q", "e.w", "e.s", F.lit(False).alias("open")), "beam-0")
    for h in range(1, hops + 1):
        turn = Window.partitionBy("q", "open").orderBy(F.desc("s"), "w")
        ranked = held.withColumn("turn", F.row_number().over(turn))
        opened = ranked.where(~F.col("open") & (F.col("turn") <= step)).select("q", F.col("w").alias("v"))
        seen = ranked.select("q", "w", "s", (F.col("open") | (F.col("turn") <= step)).alias("open"))
        reached = opened.join(links, "v").select("q", F.explode("ws").alias("w")).where("q <> w").distinct().join(held.select("q", "w"), ["q", "w"], "left_anti")
        fresh = reached.join(codes, reached["w"] == codes["node"]).join(asked, "q").select("q", "w", scored("own", "code").alias("s"), F.lit(False).alias("open"))
        best = seen.unionByName(fresh).withColumn("place", F.row_number().over(place)).where(F.col("place") <= beam).drop("place")
        held = written(best, f"beam-{h}")
        if not held.where("not open").limit(1).count():
            break
    return held.select("q", "w", "s")


def nearest(vectors: DataFrame, is_query: Column, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recheck: int = 24) -> DataFrame:
    """Per query row: query_id, rank (from 1), vec_id, score (cosine, double), of the ``top`` nearest other rows found.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id, nor vectors of another
    length than most (the longest of equally frequent lengths). Equal vectors are one node of the graph with their
    smallest ids, so copies cost no pairs; of rows equal in id and vector one counts. An id with several vectors is a candidate with each, and a query with each: it then has as many lists, each ranked from 1, and no
    row of its own id in them. The ``recheck`` best found are scored on the original vectors, floats or doubles; ties go to
    the smaller id. Fewer rows than ``top``: all that there are. Other columns are not read.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(vector_col) if single else F.col(vector_col).cast("array<double>")).alias("embedding"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0)).dropDuplicates(["id", "embedding"])
    nodes, total = numbered(distinct_vectors(rows, top + 1).withColumn("first", F.col("ids")[0]), [F.col("first")], "nodes", "node")
    nodes = written(nodes.select("node", "embedding", "ids"), "vectors")
    codes = written(nodes.select("node", coded(F.col("embedding")).alias("code")), "codes")
    asks = written(rows.where("asks").select("id", "embedding").join(nodes.select("node", "embedding"), "embedding").select(F.col("node").alias("q"), "id"), "queries")
    queries = asks.select("q").distinct()
    found = greedy_search(neighbour_graph(codes, total), codes, queries)
    short = found.withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "w"))).where(F.col("turn") <= recheck).select("q", "w")
    short = short.unionByName(queries.select("q", F.col("q").alias("w")))
    own = nodes.select(F.col("node").alias("q"), F.col("embedding").alias("own"))
    told = short.join(nodes.withColumnRenamed("node", "w"), "w").join(own, "q")
    told = told.select("q", F.explode("ids").alias("vec_id"), cosine(F.col("own"), F.col("embedding")).alias("score"))
    by_node = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = told.withColumn("turn", F.row_number().over(by_node)).where(F.col("turn") <= top + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("turn", "vec_id", "score"))).alias("x"))
    out = asks.join(listed, "q").select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("x", lambda e: e["vec_id"] != F.col("id")), 1, top)).alias("p", "e"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), "e.vec_id", "e.score")
