import random

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from wayline.llm.components import components
from wayline.llm.neardup import keys_of, near_duplicates, simhash
from wayline.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [None, "", " ", "  ", "a  b", "a \n b", "x  y", "a  <|endoftext|> b", " <|endoftext|><|endoftext|>", "don't  stop 's", "tab\tx  ", "é è　 ü", "a\x1c b", "end ", "12 34  <b", "word " * 3000, "z" * 5000, "a ᠎ b"]
DOCS = "doc_id long, text string"


def test_counts_equal_the_library(spark):
    rows = list(enumerate(HARD)) + [(0, None), (None, "x y")]
    rng = random.Random(5)
    rows += [(100 + i, "".join(rng.choice([" ", " ", "\n", "a", "B", "é", "<|endoftext|>", "'s", "1", "\t", "<", " "]) for _ in range(40))) for i in range(300)]
    got = count_tokens(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n_tokens"), PATH, 10).collect()
    t = Tokenizer.from_file(PATH)
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 10) for i, x in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert count_tokens(spark.createDataFrame([], DOCS), PATH, 10).count() == 0
    parts = count_tokens(spark.createDataFrame(rows, DOCS), PATH, 10, batch_bytes=16, cache_bytes=100).collect()
    assert sorted(map(str, map(tuple, parts))) == sorted(map(str, want))


def brute(rows):
    fp = {k: simhash(x, 3) for k, (_, x) in enumerate(rows)}
    at, left = {}, set(fp)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            k = todo.pop()
            group.add(k)
            near = {j for j in left if (fp[k] ^ fp[j]).bit_count() <= 2}
            left -= near
            todo += near
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        at |= dict.fromkeys(group, min(ids) if ids else None)
    return sorted((str(rows[k][0]), f"{fp[k]:016x}", str(at[k])) for k in fp)


def test_simhash_by_hand():
    assert simhash("", 3) == simhash(None, 3) == simhash(" \n", 3) == 0
    assert simhash("Ab cD", 3) == xxhash.xxh64_intdigest(b"ab cd", 42)
    hs = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c a", b"c a b", b"a b c")]
    want = sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hs) * 2 > 4)
    assert simhash("a b c a b c", 3) == want == simhash("a b c a b c", 3, run=1)


def test_golay_keys_meet_within_two_bits():
    import numpy as np

    rng = random.Random(1)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        ka, kb = (set(keys_of(np.array([x], np.uint64))[0].tolist()) for x in (a, b))
        assert ka & kb and len(ka) <= 18


@pytest.mark.parametrize("crowd", [3, 120])
def test_components_equal_brute_force(spark, crowd):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    rows = [(5, None), (3, ""), (9, "  "), (None, "lone text here"), (7, "one"), (7, "one"), (8, "ONE")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(400)]
        for c in range(crowd if g < 2 else 3):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(400)] = rng.choice(words)
            rows.append((1000 * (g + 1) - c, " ".join(t)))
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as fingerprint", "0 as fp")
    got = sorted(tuple(map(str, r)) for r in near_duplicates(df).collect())
    assert got == brute(rows)
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == dict.fromkeys(range(1, 201), 0) | {501: 500}
