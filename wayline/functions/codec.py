"""Encodings: polylines, bit sets, fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _encoded(values: np.ndarray) -> str:
    out = []
    for v in values.tolist():
        v = ~(v << 1) if v < 0 else v << 1
        while v >= 32:
            out.append(chr((32 | v & 31) + 63))
            v >>= 5
        out.append(chr(v + 63))
    return "".join(out)


def _decoded(text: str) -> np.ndarray:
    out, v, shift = [], 0, 0
    for c in text:
        b = ord(c) - 63
        v |= (b & 31) << shift
        shift += 5
        if b < 32:
            out.append(~(v >> 1) if v & 1 else v >> 1)
            v = shift = 0
    return np.array(out, np.int64)


def encode_line(points: Column) -> Column:
    """A polyline (array of lat, lon) as text: differences of 1e5ths, zig-zag, five bits a character."""

    def run(a: pa.Array) -> pa.Array:
        out = []
        for row in a.to_pylist():
            if row is None:
                out.append(None)
                continue
            p = np.floor(np.array([(x["lat"], x["lon"]) for x in row], np.float64).reshape(-1, 2) * 1e5 + 0.5).astype(np.int64)
            out.append(_encoded(np.diff(p, axis=0, prepend=np.zeros((1, 2), np.int64)).ravel()))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(points)


def decode_line(text: Column) -> Column:
    def run(a: pa.Array) -> pa.Array:
        out = [None if t is None else [{"lat": float(y), "lon": float(x)} for y, x in _decoded(t).reshape(-1, 2).cumsum(axis=0) / 1e5] for t in a.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))

    return F.arrow_udf(run, "array<struct<lat:double,lon:double>>")(text)


def bits_of(names: Column, order: list[str]) -> Column:
    """A set of feature names as a number, one bit each in the given order; unknown names count for nothing."""
    total = F.lit(0)
    for i, n in enumerate(order):
        total = total + F.when(F.array_contains(names, n), 1 << i).otherwise(0)
    return total


def names_of(bits: Column, order: list[str]) -> Column:
    return F.filter(F.array(*[F.when(F.getbit(bits, F.lit(i)) == 1, n) for i, n in enumerate(order)]), lambda x: x.isNotNull())


def fingerprint(*columns: Column, chars: int = 16) -> Column:
    """The first characters of the SHA-256 of the columns as JSON, nulls left out."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, chars)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-8 bytes, as a long; null stays null."""
    data = F.encode(text, "utf-8")
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    steps = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).otherwise(F.array().cast("array<int>"))
    mixed = F.aggregate(steps, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(4294967295))
    return F.when(text.isNotNull(), mixed)


def shard_of(text: Column, shards: int = 256) -> Column:
    """The shard that a key's rows are published in: the low end of its FNV-1a."""
    return F.pmod(fnv1a(text), F.lit(shards)).cast("int")


def encode_journey(legs: Column) -> Column:
    """Legs (array of trip, board, alight, dep, arr) as a short url-safe text: differences as zig-zag numbers of seven bits a byte."""
    import base64

    def run(a: pa.Array) -> pa.Array:
        out = []
        for row in a.to_pylist():
            if row is None:
                out.append(None)
                continue
            data, last = bytearray(), [0] * 5
            for leg in row:
                now = [leg[k] for k in ("trip", "board", "alight", "dep", "arr")]
                for v in (n - p for n, p in zip(now, last, strict=True)):
                    v = ~(v << 1) if v < 0 else v << 1
                    while v > 127:
                        data.append(128 | v & 127)
                        v >>= 7
                    data.append(v)
                last = now
            out.append(base64.urlsafe_b64encode(bytes(data)).decode().rstrip("="))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(legs)


def decode_journey(text: Column) -> Column:
    import base64

    names = ("trip", "board", "alight", "dep", "arr")
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))

    def run(a: pa.Array) -> pa.Array:
        out = []
        for t in a.to_pylist():
            if t is None:
                out.append(None)
                continue
            values, v, shift = [], 0, 0
            for b in base64.urlsafe_b64decode(t + "=" * (-len(t) % 4)):
                v |= (b & 127) << shift
                shift += 7
                if b < 128:
                    values.append(~(v >> 1) if v & 1 else v >> 1)
                    v = shift = 0
            rows = np.array(values, np.int64).reshape(-1, 5).cumsum(axis=0).tolist()
            out.append([dict(zip(names, r, strict=True)) for r in rows])
        return pa.array(out, kind)

    return F.arrow_udf(run, "array<struct<trip:bigint,board:bigint,alight:bigint,dep:bigint,arr:bigint>>")(text)
