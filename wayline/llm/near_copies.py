"""Near-duplicate removal: SimHash segments decoded to Golay codewords, joined two at a time, verified on five-word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.common import free_name, segments, worker_cache, written
from wayline.llm.components import components
from wayline.llm.neardup import codewords

#: Keys of a fingerprint: each of two segments of 23 bits that no other key reads. Words of 64 bits for them; two words more only check.
KEYS, WORDS = 11, 8
#: Hashes of words that a Python worker keeps; only a cache, emptied when full.
CACHED_WORDS = 150_000
PRINT = "n long, c1 long, c2 long, f binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = worker_cache(("word hashes",), dict)
    if len(known) > CACHED_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def text_words(text: str | None, most: int = 1 << 20) -> tuple[np.ndarray, int]:
    """Hashes of the text's words (A-Z in lower case, parted at ASCII white space), and a name of their sequence.

    Texts of over ``most`` bytes are read in parts, so that their words don't stand in memory all at once.
    """
    data, name, hashes = (text or "").encode("utf-8", "surrogatepass"), hashlib.md5(), []
    for part in segments(data, most):
        w = part.lower().split()
        if w:
            name.update(b" " * bool(hashes) + b" ".join(w))
            hashes.append(word_hashes(w))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), int.from_bytes(name.digest()[:8], "little", signed=True)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the distinct runs of k word hashes (all, if fewer), sorted."""
    if not len(h):
        return h
    k = max(1, min(k, len(h)))
    x = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(x)]
    return np.unique(mixed(x))


def print_of(text: str | None, run: int = 255 * 32) -> tuple[int, int, int, bytes]:
    """(name of the word sequence, two check words, key words): a SimHash of 64 bits for each word, of the distinct two-word shingles."""
    h, name = text_words(text)
    if not len(h):
        return name, 0, 0, bytes(8 * WORDS)
    s = shingle_set(h, 2)
    ones = np.zeros(64 * (WORDS + 2), np.int64)
    for i in range(0, len(s), run):
        x = np.stack([mixed(s[i : i + run] ^ np.uint64(salt)) for salt in range(1, WORDS + 3)], axis=1)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            ones += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    made = np.packbits(ones * 2 > len(s), bitorder="little").tobytes()
    return name, *(int.from_bytes(made[k : k + 8], "little", signed=True) for k in (0, 8)), made[16:]


def prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n, c1, c2, f): h is a plain hash of the text, by which rows are found again; n names its sequence of words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, c1, c2, f = zip(*(print_of(t.as_py()) for t in b.column(2)), strict=True) if len(b) else ((), (), (), ())
            longs = [pa.array(x, pa.int64()) for x in (n, c1, c2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *longs, pa.array(f, pa.binary())], names=["id", "h", "n", "c1", "c2", "f"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, h long, {PRINT}")


def fuzzy_keys(f: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints with each one's position: for each two segments, a codeword within 4 bits of each."""
    bits = np.unpackbits(np.frombuffer(b"".join(f), np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little")
    segments = bits[:, : 46 * KEYS].reshape(-1, 2 * KEYS, 23) @ (1 << np.arange(23))
    codes = []
    for s in range(2 * KEYS):
        c = np.sort(codewords(segments[:, s]), axis=1)
        new = np.ones(c.shape, bool)
        new[:, 1:] = c[:, 1:] != c[:, :-1]
        codes.append((c, new))
    keys, at = [], []
    for t in range(KEYS):
        (a, new_a), (b, new_b) = codes[2 * t], codes[2 * t + 1]
        row, i, j = np.nonzero(new_a[:, :, None] & new_b[:, None, :])
        keys.append((t << 24) | (a[row, i] << 12) | b[row, j])
        at.append(row)
    return np.concatenate(keys), np.concatenate(at)


def key_rows(nodes: DataFrame) -> DataFrame:
    """(key, c1, c2) of all keys of the nodes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c1, c2, f = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for i in range(0, len(c1), 512):
                key, at = fuzzy_keys(f[i : i + 512].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c1[i : i + 512][at]), pa.array(c2[i : i + 512][at])], names=["key", "c1", "c2"])

    return nodes.select("c1", "c2", "f").mapInArrow(emit, "key long, c1 long, c2 long")


def bits_apart(c1: np.ndarray, c2: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(c1[a] ^ c1[b]) + np.bitwise_count(c2[a] ^ c2[b])


def forest(c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of places at most ``radius`` bits apart that connect all that such pairs connect.

    Each place not yet reached is tied to the first that has it in reach, in order of ``c1``: so in the keys that a group shares its members are tied
    to the same few.
    """
    order = np.argsort(c1, kind="stable")
    left, out = order, []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            todo = queue.pop(0)
            for u in todo.tolist():
                near = bits_apart(c1, c2, left, np.array([u])) <= radius
                if near.any():
                    out.append(np.stack([left[near], np.full(int(near.sum()), u)], axis=1))
                    queue.append(left[near])
                    left = left[~near]
                if not len(left):
                    break
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def pairs_of_run(key: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int, small: int = 8, some: int = 64) -> np.ndarray:
    """Of rows sorted by key: pairs of ``c1`` enough to connect what pairs of a key at most ``radius`` bits apart connect, distinct, larger first.

    Runs of up to ``small`` rows, and those of up to ``some`` rows with no more than two near pairs a row, give all near pairs; others a forest.
    """
    x1, x2 = c1.view(np.uint64), c2.view(np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(begin[1:], len(key))
    size = end - begin
    of, i, j = np.repeat(np.arange(len(size)), size), [], []
    brief = np.flatnonzero((size <= some)[of])
    for lag in range(1, int(size[size <= some].max(initial=0))):
        brief = brief[brief + lag < end[of[brief]]]
        hit = brief[(bits_apart(x1, x2, brief, brief + lag) <= radius) & (c1[brief] != c1[brief + lag])]
        i.append(hit)
        j.append(hit + lag)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))
    dense = (size > some) | (size > small) & (np.bincount(of[i], minlength=len(size)) > 2 * size)
    keep = ~dense[of[i]]
    pairs = [np.stack([i[keep], j[keep]], axis=1)] + [b + forest(x1[b:e], x2[b:e], radius) for b, e in zip(begin[dense].tolist(), end[dense].tolist(), strict=True)]
    e = c1[np.concatenate(pairs)]
    e = e[e[:, 0] != e[:, 1]]
    return np.unique(np.stack([e.max(axis=1), e.min(axis=1)], axis=1), axis=0)


def by_run(rows: DataFrame, told: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """``told`` of the columns of ``rows``, whole runs of a key at a time. The first column is the key."""
    first = rows.columns[0]
    dealt = rows.repartition(first).sortWithinPartitions(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(held[0]) < 100_000:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield told(*(c[:cut] for c in held))
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield told(*held)

    return dealt.mapInArrow(run, schema)


def crowded_keys(nodes: DataFrame, block: int) -> DataFrame | None:
    """(key, g): keys with more rows than about ``block``, told by an even draw of one node in 64, and into how many blocks they part; None if there are none."""
    drawn = key_rows(nodes.where(F.pmod(F.xxhash64("c1"), F.lit(64)) == 0)).groupBy("key").agg((F.count("*") * 64).alias("size")).where(F.col("size") > block)
    crowd = written(drawn.select("key", F.ceil(F.col("size") / block).cast("long").alias("g")), "crowded-keys")
    return crowd if crowd.limit(1).count() else None


def in_block(key: Column, block: Column) -> Column:
    """A key's block as a key of its own."""
    return key + block * (1 << 32)


def stars(pairs: np.ndarray) -> np.ndarray:
    """Each name that the pairs connect with others, and the least of those, where it isn't that itself."""
    name, of = np.unique(pairs, return_inverse=True)
    i, j = of.reshape(-1, 2).T
    least, before = np.arange(len(name)), None
    while before is None or (least != before).any():
        before = least.copy()
        m = np.minimum(least[i], least[j])
        np.minimum.at(least, i, m)
        np.minimum.at(least, j, m)
        least = least[least]
    out = np.flatnonzero(least != np.arange(len(name)))
    return np.stack([name[out], name[least[out]]], axis=1)


def connections(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b): of rows (key, c1, c2) pairs of c1 enough to connect all that share a key and differ in at most ``radius`` bits of both words.

    What the keys of one batch connect is told as a star, so the many keys that a group shares give nearly the same pairs.
    """

    def told(key: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> pa.RecordBatch:
        e = stars(pairs_of_run(key, c1, c2, radius))
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return by_run(rows.select("key", "c1", "c2"), told, "a long, b long").distinct()


def links_within(root: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of places, one for each union of groups, that tie together all groups which a pair of sets with a Jaccard similarity of at least ``least`` links.

    Exact, by counting through a table of the places that hold each element; nothing is drawn or left out. A set of groups told by ``root`` stays together.
    """
    size = np.array(list(map(len, sets)), np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    begin = np.concatenate([[True], flat[order][1:] != flat[order][:-1]]) if len(flat) else np.zeros(0, bool)
    number = np.empty(len(flat), np.int64)
    number[order] = np.cumsum(begin) - 1
    first, held, owner = np.flatnonzero(begin), np.zeros(int(begin.sum()), np.int64), owner[order]
    top = {r: r for r in root.tolist()}

    def find(r: int) -> int:
        while top[r] != r:
            top[r] = top[top[r]]
            r = top[r]
        return r

    at, out = np.concatenate([[0], np.cumsum(size)]), []
    for v, own in enumerate(root.tolist()):
        elements = number[at[v] : at[v + 1]]
        n = held[elements]
        places = np.repeat(first[elements] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[places], minlength=v)
        for u in np.flatnonzero(both / np.maximum(1, size[v] + size[:v] - both) >= least).tolist() if v else ():
            a, b = find(own), find(int(root[u]))
            if a != b:
                top[max(a, b)] = min(a, b)
                out.append((v, u))
        held[elements] += 1
    return out


def links_by_cell(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): links of ``links_within`` each cell of rows (cell, root, n, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root, name, sets, found = None, [], [], [], []

        def told() -> None:
            if len(set(root)) > 1:
                found.extend((name[i], name[j]) for i, j in links_within(np.array(root, np.int64), sets, least))

        def links() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return out

        for b in batches:
            flat, at = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy()
            for i, (c, r, n) in enumerate(zip(*(x.to_pylist() for x in b.columns[:3]), strict=True)):
                if c != now:
                    told()
                    now, root, name, sets = c, [], [], []
                root.append(r)
                name.append(n)
                sets.append(flat[at[i] : at[i + 1]].copy())
            yield links()
        told()
        yield links()

    return rows.select("cell", "root", "n", "s").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """(n, s): the sorted hashes of the distinct shingles of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingle_set(text_words(t.as_py())[0], words).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.list_(pa.int64()))], names=["n", "s"])

    return rows.select("n", "text").mapInArrow(run, "n long, s array<long>")


def with_roots(rows: DataFrame, roots: DataFrame, name: str = "n") -> DataFrame:
    """Rows with the ``root`` of the column ``name``, which is itself where ``roots`` (a, root) don't have it."""
    return rows.join(roots.withColumnRenamed("a", name), name, "left").withColumn("root", F.coalesce("root", name))


def to_blocks(rows: DataFrame, group: str, name: str = "n") -> DataFrame:
    """Adds ``block``, the number of a cell, to rows (group, g, name, root) of groups that hold several roots, so that any two rows of unlike roots meet in a cell.

    A group's rows are dealt to about g blocks: those of its largest root to blocks of their own, the others to the rest. A cell is two blocks of which one is of the others, so no cell holds more than two blocks, whatever the
    roots. A group that one root nearly fills costs no more than its rows; one of n rows without a large root costs g of each row, as all its pairs are to meet.
    """
    sizes = rows.groupBy(group, "root").agg(F.count("*").alias("k")).groupBy(group).agg(F.max(F.struct("k", "root")).alias("x"), F.count("*").alias("roots"), F.sum("k").alias("all")).where("roots > 1")
    sizes = sizes.select(group, F.col("x.root").alias("largest"), (F.col("x.k") / F.col("all")).alias("share"))
    met = rows.join(sizes, group).withColumns({"of_rest": F.greatest(F.ceil(F.col("g") * (1 - F.col("share"))), F.lit(1)).cast("long"), "of_largest": F.greatest(F.ceil(F.col("g") * F.col("share")), F.lit(1)).cast("long")})
    inside = F.col("root") == F.col("largest")
    met = met.withColumn("own", F.pmod(F.xxhash64(name), F.when(inside, F.col("of_largest")).otherwise(F.col("of_rest"))))
    cell = lambda i, j: i * (F.col("of_rest") + F.col("of_largest")) + j
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    largest = F.transform(every(F.col("of_rest")), lambda i: cell(i, F.col("of_rest") + F.col("own")))
    others = F.filter(every(F.col("of_rest")), lambda i: i != F.col("own"))
    rest = F.concat(F.transform(others, lambda i: cell(F.least(i, F.col("own")), F.greatest(i, F.col("own")))), F.transform(every(F.col("of_largest")), lambda j: cell(F.col("own"), F.col("of_rest") + j)))
    return met.withColumn("block", F.explode(F.when(inside, largest).otherwise(rest))).drop("largest", "share", "of_rest", "of_largest", "own")


def grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after ``links`` (a, b) too."""
    return components(roots.select("a", F.col("root").alias("b")).unionByName(links.select("a", "b")))


def family_roots(families: DataFrame, sets: DataFrame, least: float, block: int, elements: int = 1 << 22, few: int = 64, rounds: int = 3) -> DataFrame:
    """(a, root): all links of at least ``least`` within families (n, family).

    A family's sets come to one task, in which every pair is verified. One of over ``block`` nodes, or ``elements`` shingles, parts into blocks,
    each first by itself; then, up to ``rounds`` times and while the cells of what is left hold more than twice the nodes, ``few`` nodes of each group that was found tie the blocks; then whatever
    pairs of unlike groups are left meet (``to_blocks``). No pair of a family is left out.
    """
    held = sets.join(families, "n").withColumn("root", F.col("n"))
    sizes = held.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("s")) / elements)).cast("long").alias("g"))
    held = written(held.join(sizes, "family"), "copy-held")
    links = written(links_by_cell(held.withColumn("cell", F.xxhash64("family", F.pmod(F.xxhash64("n"), F.col("g")))), least), "copy-links")
    roots = components(links)
    large = held.where("g > 1").drop("root")
    if not large.limit(1).count():
        return roots
    nodes, rest = large.count(), None
    for salt in range(1, rounds + 1):
        rest = to_blocks(with_roots(large.select("family", "g", "n"), roots), "family").select("family", "n", "root", "block")
        if rest.count() <= 2 * nodes or not links.limit(1).count():
            break
        order = Window.partitionBy("family", "root").orderBy(F.xxhash64("n", F.lit(salt)))
        drawn = with_roots(large.select("family", "n"), roots).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= few)
        parts = drawn.groupBy("family").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
        drawn = drawn.join(parts, "family").join(large.select("family", "n", "s"), ["family", "n"])
        links = written(links_by_cell(drawn.withColumn("cell", F.xxhash64("family", F.pmod(F.xxhash64("n", F.lit(salt)), F.col("parts")))), least), "copy-links")
        roots, rest = grown(roots, links), None
    if rest is None:
        rest = to_blocks(with_roots(large.select("family", "g", "n"), roots), "family").select("family", "n", "root", "block")
    last = links_by_cell(rest.join(large.select("family", "n", "s"), ["family", "n"]).withColumn("cell", F.xxhash64("family", "block")), least)
    return grown(roots, written(last, "copy-links"))


def duplicate_groups(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 34, block: int = 1024, crowd: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, root, first): a row per document row; ``first`` marks those of the group's kept text, of which the row of the least id stays.

    Texts of equal words are one node. Nodes that share a Golay key of two segments and whose check words are within ``radius`` bits of 128 are candidates.
    What candidates connect is a family; all pairs of a family are verified by the exact Jaccard similarity of
    shingles of ``words`` words, at least ``least``. Links found this way are always true; of pairs at similarity 0.8 with their edits in one
    stretch, at most 0.7 % share no key or lie outside the radius (simulated), of pairs with spread edits none of 1,000. Keys of over ``crowd`` nodes are dealt to blocks, each row once;
    when families are known, only nodes outside a key's largest family meet all others.
    """
    rows = written(prints(docs, id_col, text_col), "copy-prints")
    nodes = written(rows.groupBy("n").agg(F.min("id").alias("rep"), F.first("c1").alias("c1"), F.first("c2").alias("c2"), F.first("f").alias("f")), "copy-nodes")
    keys, full = key_rows(nodes), crowded_keys(nodes, crowd)
    if full is not None:
        keys = keys.join(full, "key", "left")
        crowded = written(keys.where("g is not null"), "copy-crowded")
        keys = keys.where("g is null").unionByName(crowded).withColumn("key", in_block(F.col("key"), F.coalesce(F.pmod(F.xxhash64("c1", "key"), F.col("g")), F.lit(0))))
    near = components(written(connections(keys, radius), "copy-pairs"))
    if full is not None:
        cells = to_blocks(with_roots(crowded, near, "c1"), "key", "c1").withColumn("key", in_block(F.col("key"), F.col("block")))
        near = grown(near, written(connections(cells, radius), "copy-pairs"))
    named = with_roots(nodes.select("n", "rep", "c1"), near, "c1").select("n", "rep", F.col("root").alias("family"))
    several = named.groupBy("family").count().where("count > 1").select("family")
    families = written(named.join(several, "family"), "copy-families")
    wanted = families.select("n", "rep").join(rows.select("id", "h", "n"), "n").where(F.col("id").eqNullSafe(F.col("rep"))).groupBy("n").agg(F.min(F.struct("id", "h")).alias("x")).select("n", "x.*")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    wanted = wanted.select("n", F.col("id").alias("wanted_id"), F.col("h").alias("wanted_h"))
    texts = texts.join(wanted, (F.col("h") == F.col("wanted_h")) & F.col("id").eqNullSafe(F.col("wanted_id")))
    sets = written(shingle_sets(texts, words).dropDuplicates(["n"]), "copy-sets")
    roots = family_roots(families.select("n", "family"), sets, least, block).withColumnRenamed("a", "n")
    rooted = written(nodes.select("n", "rep").join(roots, "n", "left").withColumn("root", F.coalesce("root", "n")), "copy-roots")
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "n")).alias("k")).select(F.col("k.n").alias("n"), F.col("k.rep").alias("kept_id"), F.lit(True).alias("kept"))
    decided = written(rooted.select("n", "root").join(kept, "n", "left"), "copy-decided")
    told = rows.select("id", "h", "n").join(decided, "n")
    return told.select("id", "h", "root", (F.coalesce("kept", F.lit(False)) & F.col("id").eqNullSafe(F.col("kept_id"))).alias("first"))


def without_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of exact and near copies: the one with the least id (nulls last).

    Null, empty and word-less texts are copies of one another. Of rows that repeat whole one stays. All columns are kept as they are.
    """
    told = written(duplicate_groups(docs, words, least, id_col=id_col, text_col=text_col), "copy-groups")
    of, i, h = (free_name(docs, n) for n in ("text_hash", "gone_id", "gone_hash"))
    gone = told.where("not first").select(F.col("id").alias(i), F.col("h").alias(h)).distinct()
    out = docs.withColumn(of, F.xxhash64(text_col)).join(gone, (F.col(of) == F.col(h)) & F.col(id_col).eqNullSafe(F.col(i)), "left_anti")
    stay = told.where("first")
    if stay.groupBy("id", "h").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, of])
    return out.select(*docs.columns)
