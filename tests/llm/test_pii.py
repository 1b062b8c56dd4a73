import hashlib
import random
import re

import numpy as np
import pytest

from wayline.llm.pii import KINDS, TAGS, Tagger, added_spans, base_spans, fit, joined, luhn, made_up, personal_data, redacted, tags_of, windows_of, with_personal_data

DOCS = "doc_id long, text string"


def brute(text):
    """The patterns as written, searched by the regex engine itself."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


HARD = ["", "@", "a@b", "a@b.c@d.e", "x@y..z", "a@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1", "1.2.3.4" * 3, "+1 (988) 555-2485 4539578763621486", "4539-5787-6362-1486", "4539578763621486 27.65.93.1", "++1 555 123 4567", "é@x.yz é.a@x.yz", "+1" + " " * 50 + "2", "0" * 16, "a.b@c-d.e-f x+y@z.w"]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("0012349.. --+@@ab()é") for _ in range(rng.randrange(60))) for _ in range(6000)]
    for t in texts:
        assert base_spans(t) == brute(t), t


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 100_000, "1 " * 150_000])
def test_long_runs_take_linear_time(text):
    base_spans(text)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(5)
    words = ["the", "order", "les", "und", "with", "of", "casa"]
    return fit([t for t, _ in made_up(rng, words, 150)])  # with the parameters that the query takes


def test_gradient_is_that_of_the_loss():
    m = Tagger.fresh(1, d=4, h=3, width=7)
    for k in Tagger.PARTS:
        setattr(m, k, getattr(m, k).astype(np.float64))
    r = np.random.default_rng(0)
    x, y = r.integers(0, 30, (3, 7)), r.integers(0, TAGS, (3, 7))
    grad = m.gradient(x, y)[1]
    for k in Tagger.PARTS:
        a = getattr(m, k)
        at = (x[0, 0], 0) if k == "emb" else tuple(int(r.integers(s)) for s in a.shape)
        old, loss = a[at], []
        for step in (1e-4, -1e-4):
            a[at] = old + step
            loss.append(m.gradient(x, y)[0])
        a[at] = old
        assert abs(grad[k][at] - (loss[0] - loss[1]) / 2e-4) < 1e-4


def test_viterbi_is_the_best_path():
    from itertools import product

    m = Tagger.fresh(2, d=3, h=2, width=4)
    x = np.array([[1, 2, 5, 7]])
    s = m.forward(x)[0]
    score = lambda p: m.begin[p[0]] + sum(s[t, p[t]] for t in range(4)) + sum(m.trans[p[t], p[t + 1]] for t in range(3))
    assert tuple(m.decode(x)[0]) == max(product(range(TAGS), repeat=4), key=score)


def test_held_out_spans(model):
    rows = made_up(np.random.default_rng(99), ["dans", "that", "ist", "por", "some"], 400)
    hit = total = false = 0
    for (t, spans), tags in zip(rows, tags_of([t for t, _ in rows], model), strict=True):
        got = set(added_spans(t, tags, []))
        hit, total, false = hit + len(got & set(spans)), total + len(spans), false + len(got - set(spans))
    assert hit / total > 0.8 and false / max(1, hit) < 0.06


def test_what_the_patterns_miss(model):
    text = "the order +1 (988) 555-2485 4539578763621486 with casa"
    (tags,) = tags_of([text], model)
    assert base_spans(text) == []
    assert {k for k, _, _ in added_spans(text, tags, [])} == {"phone", "card"}


def test_named_keys_are_secrets(model):
    rng = np.random.default_rng(77)
    keys = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(30)]
    texts = [f'casa les {name} = "{k}" und of' for k, name in zip(keys, ["token", "password", "secret"] * 10, strict=True)]
    hit = sum(("secret", t.index(k), t.index(k) + len(k)) in added_spans(t, g, []) for k, t, g in zip(keys, texts, tags_of(texts, model), strict=True))
    assert hit >= 27
    plain = [f"the {w} of 20{i:02d} und {i} les" for i in range(40) for w in ("token", "order")]
    assert sum(len(added_spans(t, g, [])) for t, g in zip(plain, tags_of(plain, model), strict=True)) <= 2


def test_a_text_of_digits_takes_little_memory(model):
    import tracemalloc

    rng = np.random.default_rng(6)
    text = "".join(map(str, rng.integers(0, 10, 300_000)))
    (tags,) = tags_of([text], model)
    tracemalloc.start()
    base = base_spans(text)
    added_spans(text, tags, base)
    assert sum(t.nbytes for _, t in tags) <= len(text) and tracemalloc.get_traced_memory()[1] < 25e6
    tracemalloc.stop()


def test_windows_cover_all_triggers():
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice("aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1@") for _ in range(rng.randrange(400)))
        ws = windows_of(t, 96)
        assert all(any(lo <= i < hi for lo, hi in ws) for i, c in enumerate(t) if c in "1@") and all(hi - lo <= 96 for lo, hi in ws)


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, None), (3, "mail bob.12@x.org now"), (3, "mail bob.12@x.org now"), (50, "z 1 " * 50000 + "4539578763621486")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as pii", "2 as spans")
    got = personal_data(df).collect()
    assert len(got) == len(rows)
    for (_, t), r in zip(rows, got, strict=True):
        base = brute(t or "")
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b[0] == k for b in base) for k in KINDS]
        assert set(filter(None, joined(base).split(","))) <= set(r["spans"].split(","))
        assert r["n_added"] == len(list(filter(None, r["spans"].split(",")))) - len(base)
    assert personal_data(df.limit(0)).count() == 0


def test_redaction(spark, model):
    assert redacted("ab 12 cd", [("ip", 3, 5)]) == "ab [ip] cd"
    assert redacted("abcdef", [("email", 0, 4), ("ip", 2, 6)]) == "[email]"
    df = spark.createDataFrame([(1, "to a.b@c.de or 1.2.3.4"), (2, None), (3, "plain 12 text")], DOCS)
    assert [r[0] for r in with_personal_data(df, model, redact=True).select("pii.text").collect()] == ["to [email] or [ip]", None, "plain 12 text"]
