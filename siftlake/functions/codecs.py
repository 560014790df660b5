"""Hashes, keys and wire formats."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, StringType


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def point_id(post_id: Column, offset: Column) -> Column:
    return F.shiftleft(post_id.cast("bigint"), 32).bitwiseOR(offset.cast("bigint"))


def encode_u32(x: Column) -> Column:
    """Big-endian, base64."""
    return F.base64(F.unhex(F.lpad(F.hex(x.cast("bigint")), 8, "0")))


def decode_u32(x: Column) -> Column:
    return F.conv(F.hex(F.unbase64(x)), 16, 10).cast("bigint")


def new_token(prefix: str, length: int) -> Column:
    """A prefix and so many URL-safe characters of a hash of a random UUID."""
    return F.concat(F.lit(prefix), F.left(F.translate(F.base64(F.unhex(F.sha2(F.uuid(), 256))), "+/", "-_"), F.lit(length)))


def murmur3(keys: list[bytes], seed: int = 0) -> np.ndarray:
    """32-bit MurmurHash3 of each key, signed; keys of one length are hashed together."""
    out = np.zeros(len(keys), np.int32)
    c1, c2, u = np.uint32(0xCC9E2D51), np.uint32(0x1B873593), np.uint32
    turn = lambda x, r: x << u(r) | x >> u(32 - r)
    by_length: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_length.setdefault(len(k), []).append(i)
    for n, rows in by_length.items():
        raw = np.frombuffer(b"".join(keys[i] for i in rows), np.uint8).reshape(len(rows), n)
        h = np.full(len(rows), seed, np.uint32)
        whole = n - n % 4
        for word in np.ascontiguousarray(raw[:, :whole]).view("<u4").T if whole else ():
            h = turn(h ^ turn(word * c1, 15) * c2, 13) * u(5) + u(0xE6546B64)
        if n % 4:
            rest = np.zeros(len(rows), np.uint32)
            for k in range(whole, n):
                rest |= raw[:, k].astype(np.uint32) << u(8 * (k - whole))
            h ^= turn(rest * c1, 15) * c2
        h ^= u(n)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> u(shift)) * u(factor)
        out[rows] = (h ^ h >> u(16)).view(np.int32)
    return out


@F.pandas_udf(LongType())
def term_id(terms: pd.Series) -> pd.Series:
    """The absolute 32-bit hash of a term; null stays null."""
    found = iter(np.abs(murmur3([t.encode() for t in terms.dropna()]).astype(np.int64)).tolist())
    return pd.Series([next(found) if ok else None for ok in terms.notna()], dtype="Int64")


@F.pandas_udf(StringType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """Floats, big-endian, base64."""
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, ">f4").tobytes()).decode())


@F.pandas_udf(ArrayType(FloatType()))
def decode_vector(texts: pd.Series) -> pd.Series:
    """The reverse; null where the length is no multiple of four."""

    def one(t):
        raw = base64.b64decode(t) if t is not None else b"?"
        return None if len(raw) % 4 else np.frombuffer(raw, ">f4").astype(np.float32)

    return texts.map(one)


@F.pandas_udf(BinaryType())
def vector_bytes(vectors: pd.Series) -> pd.Series:
    """Floats, little-endian."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(LongType())
def power_id(ids: pd.Series, base: pd.Series, modulus: pd.Series) -> pd.Series:
    """id ** base modulo a prime: hides consecutive ids."""
    return pd.Series([pow(int(i), int(g), int(p)) for i, g, p in zip(ids, base, modulus, strict=True)])
