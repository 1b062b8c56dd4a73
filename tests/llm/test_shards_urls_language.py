import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from wayline.llm.language import fit, fit_on, identify, language_of_documents
from wayline.llm.sharding import halves, locate, shard_documents
from wayline.llm.url_filter import Rule, judge_urls

DOCS = "doc_id long, text string, lang string"
RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]


def test_feistel_is_a_permutation():
    for total in (1, 2, 3, 7, 24, 97, 1000, 5003):
        a, b = halves(total)
        assert a * b >= total
        places = {locate(i, total, 24, 9) for i in range(total)}
        assert len(places) == total and max(slot for _, slot in places) == (total - 1) // 24


def test_shards_equal_the_python_law(spark):
    rows = [(i, "é" * (i % 7), "x") for i in range(211)] + [(None, None, None)] * 3 + [(5, "same", "x")] * 40
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).withColumn("row_number", F.lit(1))
    got = shard_documents(df, 24, 77).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 8)
    want = [(r[0], key(r)[3], key(r)[2], "rows", *locate(i, len(rows), 24, 77), None) for i, r in enumerate(sorted(rows, key=key))]
    assert Counter(map(tuple, got)) == Counter(want)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert shard_documents(spark.createDataFrame([], DOCS), 24, 77).count() == 0


def brute_url(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.rule.split("/")[0] or host.endswith("." + r.rule.split("/")[0])) and path.startswith("/" + r.rule.split("/", 1)[1])]
    rule = max(fits, key=lambda r: len(r.rule), default=None)
    return host, path, rule and rule.rule, rule and rule.verdict


URLS = [None, "", "no scheme", "http://", "://a.net", "http://A.NET/x?y#z", "https://sub.Example.net/en/1", "http://example.net/EN/", "http://notexample.com/de/", "http://x.example.com/de/#?", "http://org/fr/", "http://a.b?c/d", "http://é.net/a b\nc", "http://u@h.net:80/p/q//r?s=1&t=2", "http://a.net", "http://x.org/fr", "http://a://b.net/"]


def test_urls_equal_brute_force(spark):
    rng = random.Random(4)
    urls = URLS * 2 + [f"http://{rng.choice('abc')}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(99)}" for _ in range(400)] + ["http://x.net/" + "a1/" * 20000]
    df = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 as host", "2 as y", "'s' as suffix")
    got = sorted(judge_urls(df, RULES).collect(), key=lambda r: r["page_id"] or 0)
    for u, r in zip(urls, got, strict=True):
        host, path, rule, verdict = brute_url(u)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_score"] > 0.5 else "allow"))
    scores = {u: r["block_score"] for u, r in zip(urls, got, strict=True) if u}
    assert max(s for u, s in scores.items() if ".net/en/" in u and "example" in u) < min(s for u, s in scores.items() if u.startswith("http://a.example.com/de/"))
    again = sorted(judge_urls(df, RULES).collect(), key=lambda r: r["page_id"] or 0)
    assert again == got
    assert judge_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in judge_urls(df.where("url is null"), RULES).collect()} == {"allow"}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_of_documents(docs).join(docs, "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 250 and right / n > 0.95
    held = {r[0] for r in docs.select("doc_id").collect() if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    assert held == {r[0] for r in got.select("doc_id").collect()}


def test_language_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !?", "fr"), (None, "the of and", "en"), (4, "x", None), (4, "x", None), (5, "der die das " * 200000, "de"), (6, "é", "fr"), (7, "ß" * 100000, "de")]
    df = spark.createDataFrame(rows * 3, DOCS).selectExpr("*", "1 as score", "2 as rejected", "'q' as lang_pred")
    got = {r["doc_id"]: r for r in language_of_documents(df).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not got[None]["held_out"]
    assert language_of_documents(df.limit(0)).count() == 0
    model = fit_on(df.limit(0))
    assert {r["lang_pred"] for r in identify(df, model).collect()} == {"und"}
    assert identify(df, model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]


def test_windows_do_not_change_sums():
    import numpy as np

    from wayline.llm.language import BITS, sums

    table = np.random.default_rng(1).normal(size=(1 << BITS, 3)).astype(np.float32)
    table[0] = 0
    texts = ["Hello wörld " * 50, "", "a", "xyz" * 300]
    (a, n), (b, m) = sums(texts, table), sums(texts, table, window=17)
    assert np.allclose(a, b, atol=1e-3) and (n == m).all() and n[1] == 0
    assert fit([]).langs == []


def test_language_sample_is_bounded(spark):
    from wayline.llm.language import labelled_sample

    df = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'one hot text' else concat('text', repeat(concat(' w', id), 3000)) end as text", "case when id % 2 = 0 then 'en' else 'de' end as lang")
    got = labelled_sample(df, F.lit(True), per_lang=200, chars=50, most_rows=300, most_langs=5)
    assert 200 < len(got) < 400 and {g[1] for g in got} == {"en", "de"} and max(len(g[0]) for g in got) <= 50
    assert len(set(got)) == len(got)
    few = labelled_sample(df.where("doc_id % 3 = 0"), F.lit(True), per_lang=200, chars=50, most_rows=300, most_langs=5)
    assert sorted(few) == [("one hot text", "de"), ("one hot text", "en")]
    assert len({g[1] for g in labelled_sample(df, F.lit(True), 10, 50, 300, most_langs=1)}) == 1


def plain_boosting(rows, features, trees=8, depth=3, bins=16, rate=0.4, least=5.0):
    """The trees over rows of (features..., y), one node after the other, without histograms."""
    import math

    unit, n, ones = 1_000_000, len(rows), sum(r["y"] for r in rows)
    cuts = {}
    for f in features:
        v = sorted(r[f] for r in rows)
        cuts[f] = sorted({v[max(0, math.ceil(i / bins * n) - 1)] for i in range(1, bins)})
    base = math.log((ones + 1) / (n - ones + 1))
    margin, out = [round(base * unit)] * n, []

    def half_up(x):
        return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)

    def grown(at, level, g, h):
        best = None
        for f in features if level < depth else ():
            for b in cuts[f]:
                low = [i for i in at if rows[i][f] <= b]
                gl, hl = sum(g[i] for i in low) / unit, sum(h[i] for i in low) / unit
                ga, ha = sum(g[i] for i in at) / unit, sum(h[i] for i in at) / unit
                if min(hl, ha - hl) * 4 < least:
                    continue
                gain = gl * gl / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga * ga / (ha + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, b, -gl / (hl + 1), -(ga - gl) / (ha - hl + 1))
        if not best:
            return None
        _, f, b, low, high = best
        sides = [[i for i in at if (rows[i][f] <= b) == side] for side in (True, False)]
        return (f, b, *(grown(s, level + 1, g, h) or round(rate * v * unit) for s, v in zip(sides, (low, high), strict=True)))

    for _ in range(trees):
        p = [1 / (1 + math.exp(-m / unit)) for m in margin]
        g, h = [half_up((x - r["y"]) * unit) for x, r in zip(p, rows, strict=True)], [half_up(x * (1 - x) * unit) for x in p]
        tree = grown(range(n), 0, g, h)
        if not tree:
            break
        out.append(tree)
        for i, r in enumerate(rows):
            t = tree
            while not isinstance(t, int):
                t = t[2] if r[t[0]] <= t[1] else t[3]
            margin[i] += t
    return base, out


def test_trees_equal_plain_boosting(spark):
    import numpy as np

    from wayline.llm.url_filter import fit as boosted

    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        a, b, c = int(rng.integers(0, 30)), float(rng.integers(0, 50)) / 7, int(rng.integers(0, 3))
        rows.append({"a": float(a), "b": b, "c": float(c), "y": int(a + 3 * b + rng.normal(0, 6) > 25)})
    got = boosted(spark.createDataFrame(rows, "a double, b double, c double, y int"), ["a", "b", "c"])
    base, want = plain_boosting(rows, ["a", "b", "c"])
    assert abs(got.base - base) < 1e-12 and got.trees == want
