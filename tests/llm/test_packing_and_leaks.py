import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wayline.llm.decontaminate import HammingBlocks, leaked_documents, words_of
from wayline.llm.common import segments
from wayline.llm.packing import WordIds, best_fit, least_bins, pack_documents, pack_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
HARD = [None, "", " ", "Hello  World\n", "don't 'S it's", "<|endoftext|> x<|startoftext|>y", "İΣ ΑΣ ΑΣ.", "e\u0301 \u0301x  　z\x1cq\x85r", "12ab34!?", "word " * 5000, "q" * 4000, "ﬁ Å ½", "a\x01b \x01 \x01\x01 c", "THE The tHe\x00 \x02"]


def test_pieces_equal_the_library(spark):
    rng = random.Random(8)
    rows = list(enumerate(HARD)) + [(0, None), (None, "x y")]
    rows += [(100 + i, "".join(rng.choice([" ", "\n", "a", "B", "é", "\u0301", "<|endoftext|>", "'s", "1", "　", "Σ", "\x1c"]) for _ in range(60))) for i in range(300)]
    got = pack_documents(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as piece", "2 as g", "3 as length"), PATH, 64).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want += [(i, p, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    fills = defaultdict(list)
    for r in got:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    for seq in fills.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 64
    assert len(fills) <= least_bins(np.array([r["length"] for r in got]), 64) + 1
    assert pack_documents(spark.createDataFrame([], DOCS), PATH, 64).count() == 0


def test_special_strings_in_any_case_equal_the_library():
    rng = random.Random(9)
    t, ids = Tokenizer.from_file(PATH), WordIds(PATH, 1 << 20)
    texts = ["say <|ENDOFTEXT|> now", "A<|EndOfText|>B <|endoftext|>", "<|STARTOFTEXT|><|startoftext|>"]
    texts += ["".join(rng.choice([" ", "\n", "a", "B", "É", "<|", "|>", "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "1", "Σ"]) for _ in range(rng.randrange(30))) for _ in range(5000)]
    for x, got in zip(texts, ids.ids([x.encode() for x in texts]), strict=True):
        assert got.tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_long_texts_in_parts_and_caches_that_empty():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefÉxyz19<|.") for _ in range(rng.randrange(1, 9))) for _ in range(3000)) for _ in range(4)]
    t, small = Tokenizer.from_file(PATH), WordIds(PATH, 50_000)
    for x in texts:
        got = np.concatenate([next(small.ids([part])) for part in segments(x.encode(), 1000)])
        assert got.tolist() == t.encode(x, add_special_tokens=False).ids
        assert small.held < 150_000


def test_bound_and_best_fit():
    rng = random.Random(3)
    for _ in range(300):
        x = np.array([rng.randrange(1, 101) for _ in range(rng.randrange(1, 40))])
        bins, offsets = best_fit(x, 100)
        assert max(np.bincount(bins, weights=x)) <= 100
        assert least_bins(x, 100) <= bins.max() + 1 <= least_bins(x, 100) * 1.5 + 1
    assert least_bins(np.array([51] * 7), 100) == 7 and least_bins(np.array([34] * 7), 100) == 4 and least_bins(np.array([], int), 100) == 0


def test_exchange_lowers_the_count(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.choice([30, 40, 55, 35, 65, 100]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    one = pack_pieces(df, 100, group_rows=10, rounds=1).select("sequence_id").distinct().count()
    more = pack_pieces(df, 100, group_rows=10, rounds=4)
    assert more.count() == 400 and more.select("sequence_id").distinct().count() < one
    assert max(r[0] for r in more.groupBy("sequence_id").sum("length").selectExpr("`sum(length)`").collect()) <= 100


def brute(docs, items, least=0.8):
    """Over all windows of each item's size, without fingerprints."""

    def multiset(w):
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()

    out = []
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            v = words_of(item)
            if not v or not w:
                continue
            n, best = min(len(v), len(w)), None
            for s in range(len(w) - n + 1):
                a, b = multiset(w[s : s + n]), multiset(v)
                both = sum((a & b).values())
                j = both / (sum(a.values()) + sum(b.values()) - both)
                if j >= least and (best is None or j > best[0]):
                    best = (j, s)
            if best:
                out.append((d, i, round(best[0], 9), best[1], n))
    return Counter(out)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(40)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 3, 5, 8, 30, 30, 45])))) for i in range(15)] + [(20, None), (21, ""), (None, " ".join(say(25))), (22, "w1 w2 " * 12)]
    docs = [(1, None), (2, ""), (3, "w1 w2 " * 30), (None, items[4][1])]
    for k in range(60):
        body = say(rng.choice([0, 5, 120]))
        leak = words_of(rng.choice(items)[1])
        for _ in range(rng.randrange(3)):
            if leak:
                leak[rng.randrange(len(leak))] = "changed"
        docs.append((10 + k, ", ".join(body[:50] + leak + body[50:]).upper()))
    docs += docs[-2:]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as leaks", "'x' as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaked_documents(df, bench).collect()
    assert Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9), r["start"], r["words"]) for r in got) == brute(docs, items)
    assert leaked_documents(df, bench.limit(0)).count() == 0 and leaked_documents(df.limit(0), bench).count() == 0


def test_blocks_in_the_benchmark_do_not_change_leaks(spark):
    from wayline.llm.decontaminate import with_leaks

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one, many = (sorted((r[0], sorted(map(str, r[1]))) for r in with_leaks(docs, bench, block_chars=n).select("doc_id", "leaks").collect()) for n in (10**6, 3000))
    assert one == many


def test_hamming_blocks_find_all():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, 200, dtype=np.uint64)
    blocks = HammingBlocks(prints)
    for f in prints[:20]:
        for _ in range(20):
            g = f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 23, replace=False)))
            assert [i for i, _ in blocks.within(g, 23)] == [i for i, x in enumerate(prints) if int(x ^ g).bit_count() <= 23]


def test_items_with_one_opening_take_linear_time():
    import time

    from wayline.llm.decontaminate import ItemIndex

    rng = random.Random(4)
    opening = [f"o{i}" for i in range(12)]
    took = {}
    for n in (250, 1000):
        items = [(i, " ".join(opening + [f"w{rng.randrange(10**6)}" for _ in range(20)])) for i in range(n)]
        index = ItemIndex(items, 5)
        text = " ".join(["x"] * 30 + opening + ["y"] * 30 + words_of(items[7][1]))
        began = time.process_time()
        for _ in range(3):
            found = index.find(text, 0.8, 23)
        took[n] = time.process_time() - began
        assert [f["item_id"] for f in found] == [7]
    assert took[1000] < 10 * took[250] + 0.2


def test_long_text_of_one_item_over_and_over():
    import tracemalloc

    from wayline.llm.decontaminate import ItemIndex

    item = " ".join(f"w{i}" for i in range(50))
    index = ItemIndex([(1, item)], 5)
    text = (item + " ") * 6000
    tracemalloc.start()
    found = index.find(text, 0.8, 23)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    assert found == [{"item_id": 1, "similarity": 1.0, "start": 0, "words": 50, "distance": 0}]


def test_leaks_keep_all_other_columns(spark):
    from wayline.llm.decontaminate import with_leaks

    docs = spark.createDataFrame([(1, "a b c d e f", "x", [1]), (1, "a b c d e f", "x", [1]), (None, None, None, None)], "doc_id long, text string, leaks string, score array<int>")
    bench = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f")], "item_id int, text string")
    out = with_leaks(docs, bench, into="found")
    assert out.select(*docs.columns).exceptAll(docs).count() == 0
    assert sorted(len(r["found"]) for r in out.collect()) == [0, 1, 1]
    assert out.drop("found").schema.simpleString() == docs.schema.simpleString()
