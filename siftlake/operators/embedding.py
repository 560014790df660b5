"""Embedding of texts by pluggable models, in batches; one model for each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions.codecs import murmur3
from siftlake.functions.text import model_input
from siftlake.operators.sparse import STOPWORDS

TERM = regex.compile(r"[\p{L}\p{M}]+")

#: Texts that a model takes at once, calls for a batch, and the numbers of a hashing embedder's vector.
BATCH, ATTEMPTS, WIDTH = 16, 3, 64
#: Texts that the hashing embedder is given at once, and the characters whose words are hashed together, about.
MANY, TOGETHER = 512, 1 << 20


@dataclass(frozen=True)
class Model:
    """A kind of model: what its vectors are, and how many tokens it reads. load gives a function of texts to vectors."""

    name: str
    load: Callable[[], Callable[[list[str]], np.ndarray]]
    sparse: bool = True
    tokens: int | None = None
    batch: int = BATCH


class RecoverableError(Exception):
    """A call that may succeed when made again."""


def together(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of parts with about TOGETHER characters."""
    part = np.cumsum([len(t or "") for t in texts]) // TOGETHER
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    yield from ((a, texts[a:b]) for a, b in zip([0, *ends], ends, strict=False) if a < b)


def hashing(width: int = WIDTH) -> Callable[[list[str]], np.ndarray]:
    """Counts of hashed lower-case words, signed, of length 1: the same for a text anywhere; stands in for a real model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for at, some in together(texts):
            found = [text.lower().split() for text in some]
            words = pa.array([w for row in found for w in row], pa.string()).dictionary_encode()
            h = murmur3([w.encode() for w in words.dictionary.to_pylist()]).view(np.uint32).astype(np.int64)
            row = np.repeat(np.arange(len(some)), [len(x) for x in found])
            code = words.indices.to_numpy(zero_copy_only=False)
            cells = np.bincount(row * width + (h % width)[code], np.where(h >> 31 & 1, -1.0, 1.0)[code], len(some) * width)
            out[at : at + len(some)] = cells.reshape(-1, width)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)

    return embed


def letters() -> Callable[[list[str]], np.ndarray]:
    """Counts of the letters a to z, of length 1: a model so small that any other system can repeat it."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.array([[low.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for low in map(str.lower, texts)], np.float64).reshape(len(texts), 26)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0).astype(np.float32)

    return embed


MODELS = {m.name: m for m in (Model("arctic", hashing, True, 8192, MANY), Model("e5", hashing, True, 512, MANY), Model("jina", hashing, True, 32768, MANY), Model("mpnet", hashing, False, batch=MANY), Model("letters", letters))}
_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}


def register(model: Model) -> None:
    MODELS[model.name] = model


def call(embed: Callable[[list[str]], np.ndarray], texts: list[str], attempts: int = ATTEMPTS) -> np.ndarray:
    """Calls again after a recoverable error; a task's retry covers what is left."""
    for k in range(attempts):
        try:
            return embed(texts)
        except RecoverableError:
            if k + 1 == attempts:
                raise
    raise AssertionError


def embedder(model: str):
    """A column function of texts to vectors (array<float>); null stays null."""
    chosen = MODELS[model]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if chosen.name not in _LOADED:
            _LOADED[chosen.name] = chosen.load()
        embed = _LOADED[chosen.name]
        for texts in parts:
            known = texts.dropna()
            found = iter([v for at in range(0, len(known), chosen.batch) for v in call(embed, known.iloc[at : at + chosen.batch].tolist())])
            yield pd.Series([next(found) if ok else None for ok in texts.notna()], dtype=object)

    return run


def embedder_or_error(model: str):
    """As embedder, but a column of (vector, error): a batch on which the model fails for good is tried text by text, and the
    texts that it fails on have its message. Of one kind with sparse_vector, so that one Python worker makes both."""
    chosen = MODELS[model]

    @F.arrow_udf(T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]))
    def run(texts: pa.Array) -> pa.Array:
        if chosen.name not in _LOADED:
            _LOADED[chosen.name] = chosen.load()
        embed = _LOADED[chosen.name]

        def tried(texts: list[str]) -> list[tuple]:
            try:
                return [(np.asarray(v, np.float32), None) for v in call(embed, texts)]
            except Exception as e:
                return [(None, f"{type(e).__name__}: {e}")] if len(texts) == 1 else [x for t in texts for x in tried([t])]

        known = texts.drop_null()
        found = iter([x for at in range(0, len(known), chosen.batch) for x in tried(known.slice(at, chosen.batch).to_pylist())])
        made = [next(found) if ok else (None, None) for ok in texts.is_valid().to_pylist()]
        return pa.StructArray.from_arrays([pa.array([v for v, _ in made], pa.list_(pa.float32())), pa.array([e for _, e in made], pa.string())], names=["vector", "error"])

    return run


def embed_or_fail(rows: DataFrame, model: str, mode: str, text: str = "text", language: Column | None = None) -> DataFrame:
    """rows with dense and error."""
    whole = model_input(F.col(text), model, mode, language if language is not None else F.lit("auto"))
    made = rows.withColumn("_made", embedder_or_error(model)(whole))
    return made.withColumns({"dense": F.col("_made.vector"), "error": F.col("_made.error")}).drop("_made")


@F.arrow_udf(T.MapType(T.LongType(), T.FloatType()))
def sparse_vector(texts: pa.Array) -> pa.Array:
    """Term ids and weights of texts by the rule of sparse.term_counts: counts that add up to 1. Of terms that share an id the
    last in order stays."""
    ids, weights, sizes = [], [], []
    for _, some in together(texts.to_pylist()):
        found = [TERM.findall(t.lower()) if t else [] for t in some]
        words = pa.array([w for row in found for w in row], pa.string()).dictionary_encode()
        names, row = words.dictionary, np.repeat(np.arange(len(some)), [len(x) for x in found])
        place = np.empty(len(names), np.int64)
        place[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
        wanted = ~pc.is_in(names, pa.array(STOPWORDS)).to_numpy(zero_copy_only=False)
        code = words.indices.to_numpy(zero_copy_only=False)
        kept = wanted[code]
        cells, counts = np.unique(row[kept] * len(names) + place[code[kept]], return_counts=True)
        term = np.empty(len(names), np.int64)
        term[place] = np.abs(murmur3([w.encode() for w in names.to_pylist()]).astype(np.int64))
        row, own = cells // max(len(names), 1), term[cells % max(len(names), 1)]
        share = counts / np.bincount(row, counts, len(some))[row]
        _, last = np.unique((row << 32 | own)[::-1], return_index=True)
        last = np.sort(len(row) - 1 - last)
        ids.append(own[last])
        weights.append(share[last].astype(np.float32))
        sizes.append(np.bincount(row[last], minlength=len(some)))
    ends = np.concatenate([[0], *sizes]).cumsum()
    offsets = pa.array(ends, pa.int32(), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
    return pa.MapArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int64), *ids]), np.concatenate([np.empty(0, np.float32), *weights]))


def embed(rows: DataFrame, model: str, mode: str, text: str = "text", language: Column | None = None) -> DataFrame:
    """rows with model_input (the text with the model's prefix) and dense; the text itself stays as it is."""
    whole = model_input(F.col(text), model, mode, language if language is not None else F.lit("auto"))
    return rows.withColumn("model_input", whole).withColumn("dense", embedder(model)("model_input"))


def content_tokens(tokens: Column, weights: Column, mark: str = "Ġ", pad: str = "<pad>") -> Column:
    """(token, weight) from the first token with the word mark up to the first padding: the prompt's prefix and the padding go."""
    pairs = F.arrays_zip(tokens.alias("token"), weights.alias("weight"))
    last = F.array_position(tokens, pad)
    cut = F.when(last > 0, F.slice(pairs, F.lit(1), (last - 1).cast("int"))).otherwise(pairs)
    starts = F.transform(cut, lambda x: x["token"].startswith(mark))
    first = F.array_position(starts, True)
    return F.when(first > 0, F.slice(cut, first.cast("int"), F.size(cut))).otherwise(F.slice(cut, F.lit(1), F.lit(0)))


def add_weights(x: Column, y: Column) -> Column:
    """How one model's sub-word weights add up: by the root of the sum of squares."""
    return F.sqrt(x * x + y * y)
