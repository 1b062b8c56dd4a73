"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans."""

from __future__ import annotations

import hashlib
import re
import string
import uuid
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import stretch_of, worker_cache

KINDS = ("email", "ip", "card", "phone")
#: The model also knows keys and passwords, for which there is no base pattern.
ALL_KINDS = (*KINDS, "secret")
#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(ALL_KINDS)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
#: Possessive, and never from within a run of digits, where it can't match either: linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: The model reads what lies around these: every span of the four base kinds holds one, and secrets stand near one.
_TRIGGER = re.compile(r"[0-9@=]|[\[(] ?at ?[\])]")
#: Labels of secrets in the texts that the model is fitted on; never used to find any.
_NAMED_KEY = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_ -]?key)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_-]{12,})")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed and then by start; offsets in code points, end exclusive."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 3 or (len(p) == 3 and p <= "255") for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (ALL_KINDS.index(x[0]), x[1], x[2])))


_CLASSES = {c: i + 4 for i, c in enumerate(string.ascii_lowercase + string.punctuation)}
#: 0 past the text, 1 white space, 2 a digit, 3 anything else; letters without case and marks by themselves.
N_CLASSES = len(_CLASSES) + 4
_TABLE = np.full(128, 3, np.int64)
for _c in range(128):
    _TABLE[_c] = 1 if chr(_c).isspace() else 2 if chr(_c).isdigit() else _CLASSES.get(chr(_c).lower(), 3)


def classes(text: str, width: int) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(width, np.int64)
    out[: len(code)] = np.where(code < 128, _TABLE[np.minimum(code, 127)], 3)
    return out


@dataclass
class Tagger:
    """Embedding, two LSTMs side by side (forward, backward), a linear layer and CRF transitions."""

    emb: np.ndarray  # classes x d
    wx: np.ndarray  # 2 x d x 4h
    wh: np.ndarray  # 2 x h x 4h
    b: np.ndarray  # 2 x 1 x 4h
    wo: np.ndarray  # 2h x tags
    bo: np.ndarray  # tags
    trans: np.ndarray  # tags x tags
    begin: np.ndarray  # tags
    width: int = 96

    PARTS = ("emb", "wx", "wh", "b", "wo", "bo", "trans", "begin")

    @staticmethod
    def fresh(seed: int, d: int = 12, h: int = 20, width: int = 96) -> Tagger:
        r = np.random.default_rng(seed)
        n = lambda *s: r.normal(0, 0.25, s).astype(np.float32)
        b = np.zeros((2, 1, 4 * h), np.float32)
        b[:, :, h : 2 * h] = 1
        return Tagger(n(N_CLASSES, d), n(2, d, 4 * h), n(2, h, 4 * h), b, n(2 * h, TAGS), np.zeros(TAGS, np.float32), n(TAGS, TAGS) * 0.1, np.zeros(TAGS, np.float32), width)

    def forward(self, x: np.ndarray, keep: bool = False):
        """Scores (rows x width x tags) of class rows; with ``keep`` also what the gradient needs."""
        rows, width = x.shape
        h = self.wh.shape[1]
        both = np.stack([self.emb[x], self.emb[x[:, ::-1]]])
        inputs = np.matmul(both.reshape(2, rows * width, -1), self.wx).reshape(2, rows, width, 4 * h) + self.b[:, :, None]
        state, cell = np.zeros((2, rows, h), np.float32), np.zeros((2, rows, h), np.float32)
        out, steps = np.empty((2, rows, width, h), np.float32), []
        for t in range(width):
            z = inputs[:, :, t] + np.matmul(state, self.wh)
            gates = 1 / (1 + np.exp(-np.clip(z[..., : 3 * h], -30, 30)))
            new = np.tanh(z[..., 3 * h :])
            before, cell_before = state, cell
            cell = gates[..., h : 2 * h] * cell + gates[..., :h] * new
            bent = np.tanh(cell)
            state = gates[..., 2 * h :] * bent
            out[:, :, t] = state
            if keep:
                steps.append((gates, new, before, cell_before, bent))
        joint = np.concatenate([out[0], out[1][:, ::-1]], axis=2)
        scores = joint @ self.wo + self.bo
        return (scores, joint, both, steps) if keep else scores

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag path of each row (Viterbi)."""
        scores = self.forward(x)
        rows, width, tags = scores.shape
        best, back = scores[:, 0] + self.begin, np.zeros((rows, width, tags), np.int8)
        for t in range(1, width):
            step = best[:, :, None] + self.trans
            back[:, t] = step.argmax(axis=1)
            best = step.max(axis=1) + scores[:, t]
        path = np.zeros((rows, width), np.int8)
        path[:, -1] = best.argmax(axis=1)
        for t in range(width - 1, 0, -1):
            path[:, t - 1] = back[np.arange(rows), t, path[:, t]]
        return path

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag rows and its gradient, by forward-backward and back-propagation through time."""
        scores, joint, both, steps = self.forward(x, keep=True)
        rows, width, tags = scores.shape
        h = self.wh.shape[1]
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        s = scores.astype(np.float64)
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0] + self.begin
        for t in range(1, width):
            alpha[:, t] = lse(alpha[:, t - 1][:, :, None] + self.trans, 1) + s[:, t]
        for t in range(width - 2, -1, -1):
            beta[:, t] = lse(self.trans[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        grad_s = np.exp(alpha + beta - z[:, None, None])
        grad_begin = grad_s[:, 0].sum(axis=0) - np.bincount(y[:, 0], minlength=tags)
        pair = np.exp(alpha[:, :-1, :, None] + self.trans + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        r, t = np.arange(rows)[:, None], np.arange(width)
        gold = s[r, t, y].sum() + self.begin[y[:, 0]].sum() + self.trans[y[:, :-1], y[:, 1:]].sum()
        grad_s[r, t, y] -= 1
        grad_s = (grad_s / rows).astype(np.float32)
        out = {"trans": pair / rows, "begin": grad_begin / rows, "wo": joint.reshape(-1, 2 * h).T @ grad_s.reshape(-1, tags), "bo": grad_s.sum(axis=(0, 1))}
        grad_joint = grad_s @ self.wo.T
        grad_out = np.stack([grad_joint[..., :h], grad_joint[:, ::-1, h:]])
        grad_in = np.empty((2, rows, width, 4 * h), np.float32)
        grad_wh = np.zeros_like(self.wh)
        d_state, d_cell = np.zeros((2, rows, h), np.float32), np.zeros((2, rows, h), np.float32)
        for k in range(width - 1, -1, -1):
            gates, new, before, cell_before, bent = steps[k]
            d = grad_out[:, :, k] + d_state
            d_cell = d_cell + d * gates[..., 2 * h :] * (1 - bent * bent)
            g = np.concatenate([d_cell * new, d_cell * cell_before, d * bent], axis=2) * gates * (1 - gates)
            g = np.concatenate([g, d_cell * gates[..., :h] * (1 - new * new)], axis=2)
            grad_in[:, :, k] = g
            grad_wh += np.matmul(before.transpose(0, 2, 1), g)
            d_state, d_cell = np.matmul(g, self.wh.transpose(0, 2, 1)), d_cell * gates[..., h : 2 * h]
        flat = grad_in.reshape(2, rows * width, 4 * h)
        out |= {"wh": grad_wh, "b": flat.sum(axis=1, keepdims=True), "wx": np.matmul(both.reshape(2, rows * width, -1).transpose(0, 2, 1), flat)}
        grad_emb = np.zeros_like(self.emb)
        back = np.matmul(flat, self.wx.transpose(0, 2, 1))
        np.add.at(grad_emb, x.ravel(), back[0])
        np.add.at(grad_emb, x[:, ::-1].ravel(), back[1])
        out["emb"] = grad_emb
        return float((z.sum() - gold) / rows), out


def made_up(rng: np.random.Generator, words: list[str], n: int) -> list[tuple[str, list[Span]]]:
    """Labelled stretches: written forms of the four kinds, alone or side by side, and numbers and keys that are none."""

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def pick(*xs):
        return xs[int(rng.integers(len(xs)))]

    def name() -> str:
        return "".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(2, 9))))

    def email() -> str:
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" [at] ", "."))
        return f"{name()}{pick('', '.', '_')}{pick(digits(2), name())}{at}{name()}{pick('', digits(1))}{dot}{pick('', 'example' + dot)}{pick('com', 'net', 'org')}"

    def card() -> str:
        body = pick("4", "5") + digits(14)
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        c = body + last
        sep = pick("", "", "", " ", "-")
        return sep.join(c[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+{pick('1', '44', '49')} ({a}) {b}-{c}", f"+{pick('1', '33')} {a} {b} {c}", f"({a}) {b}-{c}", f"+{digits(2)}-{a}-{b}-{c}", f"({a}) {b} {c}")

    def key() -> str:
        k = "".join(rng.choice(list(pick("0123456789abcdef", "0123456789abcdef", string.ascii_letters + string.digits)), int(rng.integers(16, 49))))
        return pick(k, k.upper(), k)

    def secret() -> tuple[str, str]:
        """What stands before the key, and what after it."""
        named = pick("token", "secret", "password", "api_key", "API key", "passwd", "TOKEN", "Token")
        open_, close = pick(('"', '"'), ('"', '"'), ("'", "'"), ("", ""))
        return named + pick(" = ", "=", ": ", ":", " := ") + open_, close

    def none() -> str:
        return pick(f"20{digits(2)}-0{pick('1', '7')}-1{digits(1)}", f"v{digits(1)}.{digits(2)}.{digits(1)}", key(), f"id {key()}", f"{name()} = {digits(2)}", f'{name()} = "{name()}"', f"{name()}={name()}", f"the {pick('token', 'password', 'secret')} {name()}", digits(16), digits(int(rng.integers(1, 7))), f"{digits(2)},{digits(2)} %", f"@{name()}", f"{digits(2)}:{digits(2)}", f"{digits(3)}.{digits(3)}", f"(at {digits(2)})", digits(int(rng.integers(20, 30))))

    makers = {"email": email, "ip": lambda: ".".join(str(int(v)) for v in rng.integers(0, 256, 4)), "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = " ".join(rng.choice(words, int(rng.integers(0, 8)))), []
        for _ in range(int(rng.integers(1, 4))):
            text += pick(" ", " ", " ", "\n", ": ", ", ") if text else ""
            kind = pick(*ALL_KINDS, None, None)
            if kind == "secret":
                before, after = secret()
                value = key()
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(value)))
                text += before + value + after
            elif kind:
                value = makers[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += none()
            if rng.random() < 0.6:
                text += pick(" ", ", ", ". ", "\n") + " ".join(rng.choice(words, int(rng.integers(1, 5))))
        out.append((text, spans))
    return out


def windows_of(text: str, width: int) -> list[tuple[int, int]]:
    """Overlapping stretches that cover ``width``/2 - 8 characters to both sides of every trigger, in steps of half a width."""
    side, out, lo, hi = width // 2 - 8, [], None, 0
    areas = []
    for m in _TRIGGER.finditer(text):
        if lo is None or m.start() - side > hi:
            if lo is not None:
                areas.append((lo, hi))
            lo = max(0, m.start() - side)
        hi = min(len(text), m.end() + side)
    if lo is not None:
        areas.append((lo, hi))
    for lo, hi in areas:
        at = lo
        while True:
            out.append((at, min(at + width, hi)))
            if at + width >= hi:
                break
            at += width // 2
    return out


def labelled(text: str) -> list[Span]:
    """Spans that a text teaches: those of the base patterns and keys that bear a name."""
    base = base_spans(text)
    return base + [("secret", *m.span(1)) for m in _NAMED_KEY.finditer(text) if not any(s < m.end(1) and m.start(1) < e for _, s, e in base)]


def fit(texts: list[str], seed: int = 11, made: int = 1500, per_text: int = 6, epochs: int = 10, batch: int = 50, rate: float = 0.04) -> Tagger:
    """Adam on stretches of the given texts, ``per_text`` of each at random, labelled by ``labelled``, and on made-up ones in the words of the texts."""
    rng = np.random.default_rng(seed)
    words = sorted({w for t in texts for w in t.split() if w.isalpha()})
    words = [words[i] for i in rng.permutation(len(words))[:2000]] or ["word", "and", "the", "line"]
    rows = made_up(rng, words, made)
    model = Tagger.fresh(seed)
    for t in texts:
        spans, places = labelled(t), windows_of(t, model.width)
        for lo, hi in (places[i] for i in rng.permutation(len(places))[:per_text]):
            rows.append((t[lo:hi], [(k, max(s, lo) - lo, min(e, hi) - lo) for k, s, e in spans if s < hi and e > lo]))
    x, y = np.zeros((len(rows), model.width), np.int64), np.zeros((len(rows), model.width), np.int64)
    for i, (t, spans) in enumerate(rows):
        x[i] = classes(t[: model.width], model.width)
        for kind, s, e in spans:
            tag = 1 + 2 * ALL_KINDS.index(kind)
            y[i, s:e] = tag + 1
            if s < model.width:
                y[i, s] = tag
    m = {k: np.zeros_like(getattr(model, k), np.float64) for k in Tagger.PARTS}
    v = {k: np.zeros_like(getattr(model, k), np.float64) for k in Tagger.PARTS}
    step, steps = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            take = order[i : i + batch]
            _, grad = model.gradient(x[take], y[take])
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                pull = rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
                setattr(model, k, (getattr(model, k) - pull).astype(np.float32))
    return model


def tags_of(texts: list[str], model: Tagger, rows: int = 256) -> list[list[tuple[int, np.ndarray]]]:
    """Per text: the tags of its characters by areas around triggers, each with its begin; characters outside them have none.

    Equal stretches are decoded once. Where stretches overlap, a character takes the tag of the one in which it
    stands farthest from both ends that cut the text; so a span is one path wherever the stretches began.
    """
    places = [windows_of(t, model.width) for t in texts]
    known: dict[str, int] = {}
    for t, p in zip(texts, places, strict=True):
        for lo, hi in p:
            known.setdefault(t[lo:hi], len(known))
    names, paths = list(known), np.zeros((len(known), model.width), np.int8)
    for i in range(0, len(names), rows):
        paths[i : i + rows] = model.decode(np.stack([classes(n, model.width) for n in names[i : i + rows]]))
    out = []
    for t, p in zip(texts, places, strict=True):
        areas: list[tuple[int, np.ndarray]] = []
        for k in np.split(np.arange(len(p)), [i for i in range(1, len(p)) if p[i][0] > p[i - 1][1]]) if p else []:
            begin, end = p[k[0]][0], p[k[-1]][1]
            tags, depth = np.zeros(end - begin, np.int8), np.full(end - begin, -1, np.int32)
            for lo, hi in (p[i] for i in k.tolist()):
                c = np.arange(hi - lo)
                d = np.minimum(c if lo else c + (1 << 29), c[::-1] if hi < len(t) else c + (1 << 29))
                deeper = d > depth[lo - begin : hi - begin]
                tags[lo - begin : hi - begin][deeper] = paths[known[t[lo:hi]], : hi - lo][deeper]
                depth[lo - begin : hi - begin][deeper] = d[deeper]
            areas.append((begin, tags))
        out.append(areas)
    return out


def tagged(areas: list[tuple[int, np.ndarray]]) -> Iterator[Span]:
    """Spans as the tags have them: one tag of the kind and all of it that follow without a new begin."""
    for begin, tags in areas:
        t = np.concatenate([[0], tags, [0]]).astype(np.int8)
        kind, starts = (t + 1) >> 1, t & 1 == 1
        in_one = (kind[1:] == kind[:-1]) & ~starts[1:]
        first, last = np.flatnonzero((t[1:] > 0) & ~in_one) + 1, np.flatnonzero((t[:-1] > 0) & ~in_one)
        for s, e in zip(first.tolist(), last.tolist(), strict=True):
            yield ALL_KINDS[kind[s] - 1], begin + s - 1, begin + e


def consistent(kind: str, value: str) -> bool:
    """Whether a text can be of its kind by what the kind's labels have in common: digits, or the parts of an address."""
    digits = sum(c in string.digits for c in value)
    if kind == "ip":
        parts = value.split(".", 4)
        return len(parts) == 4 and all(p.isdecimal() and len(p) < 10 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= digits <= 19 and luhn("".join(c for c in value if c in string.digits))
    if kind == "phone":
        return 8 <= digits <= 15 and not any(map(str.isalpha, value))
    if kind == "email":
        return ("@" in value or "at" in value) and ("." in value or "dot" in value)
    return len(value) >= 12 and digits > 0 and not any(map(str.isspace, value))


def added_spans(text: str, tags: list[tuple[int, np.ndarray]], base: list[Span]) -> list[Span]:
    """Spans that the tags make, trimmed of marks at their ends, where no base span lies.

    A span begins and ends with a word, and is ``consistent`` with its kind.
    """
    out: list[Span] = []
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    for kind, s, e in tagged(tags):
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        value = text[s:e]
        if not value or s and text[s - 1].isalnum() and value[0].isalnum() or e < len(text) and text[e].isalnum() or not consistent(kind, value):
            continue
        near = bisect(starts, e - 1)
        if any(a < e and s < b for a, b in taken[max(0, near - 4) : near]):
            continue
        out.append((kind, s, e))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, by that of the first."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def fit_on(docs: DataFrame, sample_rows: int = 400, chars: int = 4000, text_col: str = "text") -> Tagger:
    """The tagger fitted on about ``sample_rows`` distinct texts with digits or @, of each a stretch of at most ``chars`` characters, drawn by a hash of the text.

    The share that is drawn follows from the number of distinct texts, so no more than that comes to the driver however many tasks there are.
    """
    rows = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("text"))
    keep = min(1 << 40, (sample_rows << 40) // max(1, rows.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(1 << 40)) < keep).select(F.xxhash64("text").alias("h"), stretch_of(F.col("text"), chars).alias("text")).distinct()
    return fit(sorted(r["text"] for r in drawn.collect()))


def with_personal_data(docs: DataFrame, model: Tagger, redact: bool, text_col: str = "text", into: str = "pii") -> DataFrame:
    """Adds the column ``into``: base and all spans (kind:start:end, joined by commas), the count of each kind of base span, and the redacted text if asked for.

    Whole texts in one narrow Arrow pass; the model (fixed size) is broadcast. Null text counts as empty (its redacted text is null). An existing column
    ``into`` is replaced; all others stay as they are.
    """
    keep = [c for c in docs.columns if c != into]
    name = uuid.uuid4().hex
    box = docs.sparkSession.sparkContext.broadcast({k: getattr(model, k) for k in (*Tagger.PARTS, "width")})
    fields = [("base", pa.string()), ("all", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("text", pa.string())]

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = worker_cache(("tagger", name), lambda: Tagger(**box.value))
        for a in arrays:
            out: list[dict] = []

            def note(texts: list, tagger=tagger, out=out) -> None:
                for raw, tags in zip(texts, tags_of([t or "" for t in texts], tagger), strict=True):
                    text = raw or ""
                    base = base_spans(text)
                    spans = base + added_spans(text, tags, base)
                    said = joined(base)
                    counts = {f"n_{k}": sum(x[0] == k for x in base) for k in KINDS}
                    out.append({"base": said, "all": joined(spans), **counts, "base_sha256": hashlib.sha256(said.encode()).hexdigest(), "text": (redacted(text, spans) if raw is not None else None) if redact else None})

            held, size = [], 0
            for v in a:
                held.append(v.as_py())
                size += len(held[-1] or "")
                if size > 1 << 20:
                    note(held)
                    held, size = [], 0
            note(held)
            yield pa.array(out, pa.struct(fields))

    kind = "base string, all string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, text string"
    return docs.select(*keep, F.arrow_udf(run, kind)(F.col(text_col)).alias(into))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans (base and added), n_added, n_spans.

    Added spans are of the same kinds or of the kind ``secret``, which stands last in ``spans``.

    Null and empty texts have no spans; repeated rows and null ids give a row each; no rows give none.
    """
    docs = docs.select("doc_id", "text")
    found = with_personal_data(docs, fit_on(docs), redact=False)
    number = lambda c: F.size(F.filter(F.split(c, ","), lambda x: x != "")).cast("long")
    return found.select("doc_id", *[f"pii.n_{k}" for k in KINDS], "pii.base_sha256", F.col("pii.all").alias("spans"), (number("pii.all") - number("pii.base")).alias("n_added"), number("pii.all").alias("n_spans"))
