"""Near copies among vectors: binary codes by iterative quantisation, multi-index Hamming tables, decisions on the original vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.ann_graph import cosine, usable
from wayline.llm.common import numbered, written
from wayline.llm.components import components

#: Tables, bits of a table's part of the code, tables that one pass fills, tables that name ball leaders.
TABLES, PART, AT_ONCE, LEADING = 32, 16, 8, 8
#: Angles are held apart from the threshold by this much more than the proven error of the bytes, for float32 sums.
SLACK = 1e-4


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(embedding, m, first): each vector once, with its number of rows and smallest id. Batches add up their own first."""
    kind = rows.schema["embedding"].dataType.simpleString()
    values = pa.float64() if kind == "array<double>" else pa.float32()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[tuple, list] = {}
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = held.setdefault(tuple(v), [0, None])
                x[0] += 1
                x[1] = i if x[1] is None else x[1] if i is None else min(i, x[1])
            yield pa.RecordBatch.from_arrays([pa.array(list(map(list, held)), pa.list_(values)), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.int64())], names=["embedding", "m", "first"])

    return rows.select("id", "embedding").mapInArrow(some, f"embedding {kind}, m long, first long").groupBy("embedding").agg(F.sum("m").alias("m"), F.min("first").alias("first"))


def as_bytes(nodes: DataFrame) -> DataFrame:
    """(node, m, d, q, err): a vector's direction as a signed byte a component, and the angle between the two, rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, err, size = [], [], []
            for v in b.column(2):
                x = np.asarray(v.values, np.float64)
                x = x / np.abs(x).max()
                c = np.rint(x * 127)
                cos = x @ c / math.sqrt((x @ x) * (c @ c))
                off = x / np.linalg.norm(x) - c / np.linalg.norm(c)
                err.append(2 * math.asin(min(1, np.linalg.norm(off) / 2)) + 1e-7 if cos > 0 else math.pi)
                q.append(c.astype(np.int8).tobytes())
                size.append(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int32()), pa.array(q, pa.binary()), pa.array(err, pa.float32())], names=["node", "m", "d", "q", "err"])

    return nodes.select("node", "m", "embedding").mapInArrow(run, "node long, m long, d int, q binary, err float")


def unit(q: list[bytes], d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(q), np.int8).reshape(len(q), d).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Binary codes of one length of vectors: TABLES parts of PART bits, as columns of uint16."""

    def __init__(self, mean: np.ndarray, turn: np.ndarray):
        self.mean, self.turn = mean, turn

    def parts(self, x: np.ndarray) -> np.ndarray:
        on = (x - self.mean) @ self.turn > 0
        return np.packbits(on, axis=1, bitorder="little").view(np.uint16)

    def found(self, x: np.ndarray, y: np.ndarray) -> float:
        """The share of pairs that meet in a table."""
        return float((self.parts(x) == self.parts(y)).any(axis=1).mean()) if len(x) else 1.0


def fit(x: np.ndarray, d: int, least: float, seed: int = 5, width: int = 64, steps: int = 20, sure: float = 0.9) -> Quantiser:
    """Iterative quantisation: principal directions of the sample, then rotations learned to lose least when signs are taken.

    As many rotations of at most ``width`` directions, each from another random start, as fill the code; below 16
    directions, where all starts end alike, they stay random and a part has half as many bits, each twice. Bits are balanced by taking the mean off; where the sample lies so much to one side that of pairs with
    cosine ``least`` exactly (a sampled vector and a random one at that angle) less than the share ``sure`` would meet, half of the mean or nothing is taken off.
    """
    rng = np.random.default_rng(seed)
    bits, best = TABLES * PART, None
    noise = rng.standard_normal((len(x), d))
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    pair = least * x + math.sqrt(1 - least * least) * noise / np.where(size == 0, 1, size)
    for share in (1.0, 0.5, 0.0):
        mean = x.mean(axis=0) * share if len(x) else np.zeros(d)
        v = x - mean
        b = min(d, width)
        axes = np.linalg.eigh(v.T @ v + 1e-9 * np.eye(d))[1][:, ::-1][:, :b]
        low, turns = v @ axes, []
        for _ in range(-(-bits // b)):
            r = np.linalg.qr(rng.standard_normal((b, b)))[0]
            for _ in range(steps if b >= 16 and len(x) else 0):
                u, _, w = np.linalg.svd(np.where(low @ r > 0, 1.0, -1.0).T @ low)
                r = (u @ w).T
            turns.append(axes @ r)
        turn = np.concatenate(turns, axis=1)[:, :bits]
        if b < 16:
            turn = turn[:, [i - i % PART + i % PART % (PART // 2) for i in range(bits)]]
        got = Quantiser(mean.astype(np.float32), turn.astype(np.float32))
        rate = got.found(x.astype(np.float32), pair.astype(np.float32))
        if best is None or rate > best[0]:
            best = rate, got
        if rate >= sure:
            return got
    return best[1]


class Quantisers(dict):
    """By length of vectors; of a length that the sample lacks the rotations are random."""

    def __init__(self, held: dict[int, Quantiser], least: float):
        super().__init__(held)
        self.least = least

    def __missing__(self, d: int) -> Quantiser:
        self[d] = q = fit(np.zeros((0, d)), d, self.least)
        return q

    def __reduce__(self):
        return Quantisers, (dict(self), self.least)


def fit_on(coded: DataFrame, total: int, least: float, sample: int = 20_000, components: int = 2_000_000, lengths: int = 8) -> Quantisers:
    """Fitted on about ``sample`` vectors of all, and at most ``components`` numbers, of at most ``lengths`` most frequent lengths."""
    sizes = coded.groupBy("d").count().orderBy(F.desc("count"), "d").limit(lengths).collect()
    held = {}
    for d, n in sizes:
        most = max(1, min(sample, components // d))
        drawn = coded.where((F.col("d") == d) & (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1, most / n) * (1 << 30)))).select("q").limit(2 * most).collect()
        held[d] = fit(unit([bytes(r[0]) for r in drawn], d).astype(np.float64) if drawn else np.zeros((0, d)), d, least)
    return Quantisers(held, least)


def keys(coded: DataFrame, model: Broadcast, tables: range, carried: list[str]) -> DataFrame:
    """(d, key) and the ``carried`` columns of ``coded``, a row for each vector and table. A key is the table's number and its part of the code."""
    kind = {f.name: f.dataType.simpleString() for f in coded.schema}
    names = ["d", "q", *[c for c in carried if c != "q"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(0).to_numpy()
            q = b.column(1).to_pylist()
            code = np.zeros((len(size), TABLES), np.uint16)
            for d in np.unique(size).tolist():
                at = np.nonzero(size == d)[0]
                code[at] = model.value[d].parts(unit([q[i] for i in at], d))
            for t in tables:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code[:, t].astype(np.int64) | t << PART), *[b.column(names.index(c)) for c in carried]], names=["d", "key", *carried])

    return coded.select(*names).mapInArrow(run, ", ".join(["d int", "key long", *[f"{c} {kind[c]}" for c in carried]]))


def balls(coded: DataFrame, model: Broadcast, least: float, crowd: int) -> DataFrame:
    """(node, ball): of vectors in crowded buckets, a vector so near that all around it are linked with one another.

    A bucket of ``crowd`` or more names as leader its vector of least hash. A vector joins, of its buckets' leaders that lie within half of the linking angle for certain, the one of least hash. By
    the triangle inequality any two of a ball are linked, so a third of all vectors that are near copies costs no pairs.
    """
    half = math.acos(least) / 2 - SLACK
    light = keys(coded, model, range(LEADING), ["node"])
    named = light.groupBy("d", "key").agg(F.count("*").alias("n"), F.min(F.xxhash64("node")).alias("h")).where(F.col("n") >= crowd).drop("n")
    named = written(named, "leaders")
    heads = named.select("h", "d").distinct().join(coded.select(F.xxhash64("node").alias("h"), "d", F.col("node").alias("ball"), F.col("q").alias("ball_q"), F.col("err").alias("ball_err")), ["h", "d"])
    asked = light.join(named, ["d", "key"]).select("d", "node", "h").distinct()
    pairs = asked.join(coded.select("node", "q", "err"), "node").join(heads, ["h", "d"])

    def near(q: pa.Array, p: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.int8).astype(np.float32) for x in (q, p))
        first = np.concatenate([[0], np.cumsum([len(x.as_py()) for x in q])]).astype(int)[:-1]
        dots = [np.add.reduceat(x, first) if len(first) else x for x in (a * b, a * a, b * b)]
        return pa.array(np.arccos(np.clip(dots[0] / np.sqrt(dots[1] * dots[2]), -1, 1)) if len(first) else [], pa.float32())

    angle = F.arrow_udf(near, "float")
    inside = pairs.withColumn("angle", angle("q", "ball_q")).where(F.col("angle") + F.col("err") + F.col("ball_err") <= half)
    return inside.groupBy("node").agg(F.min_by("ball", "h").alias("ball"))


def cells(rows: DataFrame, light: DataFrame, block: int, name: str) -> DataFrame:
    """Adds to bucket rows (d, key, node, ball, ...) their block and a cell: any two of a bucket that aren't of one ball meet in one cell.

    A bucket of up to ``block`` rows is one cell. Of a larger one, balls of over half a block have blocks of their own, the rest is dealt by hash; a cell is two blocks (or one with
    itself), and there is none for blocks of one ball. So of n near copies around one vector and s others about n * s / block rows move, not n * n.
    """
    sizes = light.groupBy("d", "key", "ball").count().groupBy("d", "key").agg(
        F.sum("count").alias("n"),
        F.sum(F.when(F.col("ball").isNull() | (F.col("count") * 2 <= block), F.col("count")).otherwise(0)).alias("rest"),
        F.collect_list(F.when(F.col("ball").isNotNull() & (F.col("count") * 2 > block), F.struct("ball", F.ceil(F.col("count") / block).cast("int").alias("blocks")))).alias("large"),
    )
    begin = lambda x, i: F.aggregate(F.slice("large", 1, i), F.lit(0), lambda s, y: s + y["blocks"])
    hot = sizes.where(F.col("n") > block).select("d", "key", F.transform("large", lambda x, i: F.struct(x["ball"].alias("ball"), begin(x, i).alias("first"), x["blocks"].alias("blocks"))).alias("large"), F.ceil(F.col("rest") / block).cast("int").alias("others"))
    hot = written(hot.withColumn("taken", F.aggregate("large", F.lit(0), lambda s, y: s + y["blocks"])), f"hot-{name}")
    met = rows.join(hot, ["d", "key"], "left").withColumn("own", F.get(F.filter("large", lambda x: x["ball"] == F.col("ball")), F.lit(0)))
    dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    met = met.withColumn("block", F.when(F.col("large").isNull(), 0).when(F.col("own").isNotNull(), F.col("own.first") + dealt(F.col("own.blocks"))).otherwise(F.col("taken") + dealt(F.greatest("others", F.lit(1)))))
    all_blocks = F.sequence(F.lit(0), F.col("taken") + F.col("others") - 1)
    free = F.filter(all_blocks, lambda j: F.coalesce((j < F.col("own.first")) | (j >= F.col("own.first") + F.col("own.blocks")), F.lit(True)))
    mine = F.transform(free, lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    return met.withColumn("cell", F.explode(F.when(F.col("large").isNull(), one).otherwise(mine))).drop("large", "others", "taken", "own")


def _pairs_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within runs of these sizes."""
    begin = np.concatenate([[0], np.cumsum(sizes)])
    after = np.repeat(begin[1:], sizes) - np.arange(begin[-1]) - 1
    a = np.repeat(np.arange(begin[-1]), after)
    b = np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after) + a + 1
    return a, b


def links(celled: DataFrame, model: Broadcast, least: float, small: int = 48) -> DataFrame:
    """Links within cells, told by vector: (a, b, n, told). Where ``told``, a has ``n`` rows linked by this cell and reaches the node b (null if none); else a and b are a pair that bytes can't decide.

    A pair counts in the first table whose parts of the two codes are equal, so it counts once; pairs of one ball count elsewhere. Angles between byte directions decide where
    they are clear of the threshold by more than their errors. Cells of up to ``small`` rows are worked on together, larger ones by a product of matrices.
    """
    limit = math.acos(least)
    grouped = celled.groupBy("d", "key", "cell").agg(F.collect_list(F.struct("node", "m", "ball", "block", "q", "err")).alias("x")).where(F.size("x") > 1).select("d", "key", "x")

    def decide(r, c, s, rows, table) -> tuple[np.ndarray, np.ndarray]:
        """Of candidate pairs at cosines s: positions of links, and of pairs left open."""
        node, _, ball, block, err, code, cross = rows
        angle = np.arccos(np.clip(s, -1, 1))
        slack = err[r] + err[c] + SLACK
        keep = (angle - slack <= limit) & ((ball[r] != ball[c]) | (ball[r] < 0)) & (~cross[r] | (block[r] != block[c]))
        at = np.nonzero(keep)[0]
        earlier = (code[r[at]] == code[c[at]]) & (np.arange(TABLES) < table[r[at], None])
        at = at[~earlier.any(axis=1)]
        sure = angle[at] + slack[at] <= limit
        return at[sure], at[~sure]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2)
            size = np.diff(x.offsets.to_numpy())
            flat = x.flatten()
            node, m, block = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            ball = flat.field(2).fill_null(-1).to_numpy(zero_copy_only=False)
            err = flat.field(5).to_numpy(zero_copy_only=False).astype(np.float64)
            q = flat.field(4).to_pylist()
            table = np.repeat(b.column(1).to_numpy() >> PART, size)
            lengths = b.column(0).to_numpy()
            begin = np.concatenate([[0], np.cumsum(size)])
            count, root, open_pairs = np.zeros(len(node), np.int64), node.copy(), []
            for d in np.unique(lengths).tolist():
                of_d = np.nonzero(lengths == d)[0]
                for part in _runs(of_d, size, small):
                    at = np.concatenate([np.arange(begin[g], begin[g + 1]) for g in part])
                    u = unit([q[i] for i in at], d)
                    code = model.value[d].parts(u)
                    apart = np.array([len(np.unique(block[begin[g] : begin[g + 1]])) > 1 for g in part])
                    rows = node[at], m[at], ball[at], block[at], err[at], code, np.repeat(apart, size[part])
                    r, c = [], []
                    if len(part) == 1 and len(at) > small:
                        for i in range(0, len(at), 512):
                            s = u[i : i + 512] @ u.T
                            y, z = np.nonzero(s >= math.cos(min(math.pi, limit + 2 * err[at].max() + 2 * SLACK)))
                            keep = z > y + i
                            y, z = y[keep], z[keep]
                            sure, unsure = decide(y + i, z, s[y, z], rows, table[at])
                            r.append(y[sure] + i)
                            c.append(z[sure])
                            open_pairs += zip(node[at[y[unsure] + i]].tolist(), node[at[z[unsure]]].tolist(), strict=True)
                    else:
                        y, z = _pairs_of(size[part])
                        sure, unsure = decide(y, z, np.einsum("ij,ij->i", u[y], u[z]), rows, table[at])
                        r, c = [y[sure]], [z[sure]]
                        open_pairs += zip(node[at[y[unsure]]].tolist(), node[at[z[unsure]]].tolist(), strict=True)
                    r, c = at[np.concatenate(r)], at[np.concatenate(c)]
                    np.add.at(count, r, m[c])
                    np.add.at(count, c, m[r])
                    while True:
                        old = root[r], root[c]
                        np.minimum.at(root, r, old[1])
                        np.minimum.at(root, c, old[0])
                        if (root[r] == old[0]).all() and (root[c] == old[1]).all():
                            break
            at = np.nonzero(count)[0]
            a = [*node[at].tolist(), *[p for p, _ in open_pairs]]
            z = [*root[at].tolist(), *[p for _, p in open_pairs]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array([*count[at].tolist(), *[0] * len(open_pairs)], pa.int64()), pa.array([True] * len(at) + [False] * len(open_pairs), pa.bool_())], names=["a", "b", "n", "told"])

    return grouped.mapInArrow(run, "a long, b long, n long, told boolean")


def _runs(groups: np.ndarray, size: np.ndarray, small: int, most: int = 100_000) -> Iterator[np.ndarray]:
    """Groups over ``small`` one by one, the others together until they have ``most`` pairs."""
    run, pairs = [], 0
    for g in groups.tolist():
        if size[g] > small:
            yield np.array([g])
            continue
        run.append(g)
        pairs += size[g] * (size[g] - 1) // 2
        if pairs >= most:
            yield np.array(run)
            run, pairs = [], 0
    if run:
        yield np.array(run)


def near_copies(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", crowd: int = 16, block: int = 1024) -> DataFrame:
    """Per row: id, n_links (other rows within cosine ``least``), component_id (smallest id reachable by links), kept (id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of unlike lengths don't link; rows of equal vectors link. Repeated ids are rows of
    their own. A null id takes part and is passed over by component_id, unless its component has no other; nulls count as equal in ``kept``. Other columns are not read.

    Links found are those of pairs that agree in one of 32 parts of 16 bits of their codes (all within 31 bits of 512), and of all pairs of one ball; of pairs at the threshold
    itself about 94 % are found, at cosine 0.95 and above more than 99.8 %.
    Each vector's code is indexed; only the rotations are fitted on a sample. Work on n vectors is 32 rows each, in four passes; pairs are formed within a bucket's cells only and never leave the task but for those too near to
    the threshold for bytes, which are decided on the original vectors.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(vector_col) if single else F.col(vector_col).cast("array<double>")).alias("embedding"))
    nodes, total = numbered(distinct_vectors(rows.where(usable(F.col("embedding")))), [F.col("first").asc_nulls_last()], "vectors", "node")
    nodes = written(nodes.select("node", "embedding", "m", "first"), "distinct-vectors")
    coded = written(as_bytes(nodes), "codes")
    spark = vectors.sparkSession
    model = spark.sparkContext.broadcast(fit_on(coded, total, least))
    coded = written(coded.join(balls(coded, model, least, crowd), "node", "left"), "balls")
    found = None
    for t in range(0, TABLES, AT_ONCE):
        tables = range(t, t + AT_ONCE)
        celled = cells(keys(coded, model, tables, ["node", "m", "ball", "q", "err"]), keys(coded, model, tables, ["ball"]), block, str(t))
        part = written(links(celled, model, least), f"links-{t}")
        found = part if found is None else found.unionByName(part)
    vector = lambda side: nodes.select(F.col("node").alias(side), F.col("embedding").alias(f"v_{side}"), F.col("m").alias(f"m_{side}"))
    unsure = found.where("not told").select("a", "b").join(vector("a"), "a").join(vector("b"), "b")
    unsure = written(unsure.where(cosine(F.col("v_a"), F.col("v_b")) >= least).select("a", "b", "m_a", "m_b"), "decided")
    counts = found.where("told").select(F.col("a").alias("node"), "n").unionByName(unsure.select(F.col("a").alias("node"), F.col("m_b").alias("n"))).unionByName(unsure.select(F.col("b").alias("node"), F.col("m_a").alias("n")))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.where("told").select("a", "b").unionByName(unsure.select("a", "b")).unionByName(coded.where(F.col("ball").isNotNull()).select(F.col("node").alias("a"), F.col("ball").alias("b")))
    around = coded.where(F.col("ball").isNotNull()).groupBy("ball").agg(F.sum("m").alias("in_ball"))
    rooted = nodes.select("node", "m", "first").join(components(edges).withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    told = rooted.join(lowest, "root").join(counts, "node", "left").join(coded.select("node", "ball"), "node").join(around, "ball", "left")
    told = told.select("node", (F.coalesce("in_ball", "m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    named = nodes.select("node", "embedding").join(told, "node").drop("node")
    out = rows.where(usable(F.col("embedding"))).join(named, "embedding").select("id", "n_links", "component_id")
    rest = rows.where(~usable(F.col("embedding"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
