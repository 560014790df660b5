"""Packing of documents into sequences: repeat counts of few-document length patterns by non-negative least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm import encoding
from siftlake.llm.common import documents, text_slices, two_columns, written

LIMIT, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes of text that are encoded together.
SLICE = 1 << 19
#: Rows of one length that are numbered in one task, about.
RANKED_TOGETHER = 4000
ITERATIONS = 400


def token_pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most `limit` ids: doc_id, piece, start, length, ids_crc32, and the ids where asked for.

    A document is its ids and end_id. Only longer ones are cut, and the first piece may be the shorter one. A null or empty text has end_id alone. Repeated rows give repeated pieces.
    """
    path = path or encoding.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoding.encoder(path)
        for b in text_slices(batches, SLICE):
            ids, edges = code.encode(b.column("text"), end_id)
            raw, sizes = memoryview(ids.astype("<u4").tobytes()), np.diff(edges)
            # Pieces of each document, where each begins in it, and where it begins among all ids.
            n = -(-sizes // limit)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = np.where(sizes > limit, (sizes - 1) % limit + 1, sizes)[doc]
            start = np.where(piece == 0, 0, first + (piece - 1) * limit)
            length = np.where(piece == 0, first, limit)
            at = edges[doc] + start
            sums = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [b.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return two_columns(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids array<long>" * with_ids)


def patterns(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Two or three of the lengths that fill a sequence exactly, as rows (0: no third)."""
    there = np.zeros(limit + 1, bool)
    there[lengths[lengths < limit]] = True
    have = np.flatnonzero(there)
    a, b = np.meshgrid(have, have, indexing="ij")
    a, b = a[a <= b], b[a <= b]
    c = limit - a - b
    ok = (c == 0) | (c >= b) & there[np.clip(c, 0, limit)]
    return np.stack([a[ok], b[ok], np.where(c[ok] > 0, c[ok], 0)], 1).astype(np.int64)


def fit(shapes: np.ndarray, counts: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' total lengths closest to the histogram, by accelerated projected gradient."""
    if not len(shapes):
        return np.zeros(0)
    size, used = len(counts), (shapes > 0).astype(float)
    forward = lambda x: np.bincount(shapes.ravel(), (x[:, None] * used).ravel(), minlength=size)
    back = lambda r: (r[shapes] * used).sum(1)
    target = counts.astype(float).copy()
    target[0] = 0
    v = np.ones(len(shapes))
    for _ in range(20):
        w = back(forward(v))
        v = w / (norm := np.linalg.norm(w))
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(iterations):
        x1 = np.maximum(0, y - back(forward(y) - target) / (1.05 * norm))
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = x1 + (t - 1) / t1 * (x1 - x), x1, t1
    return x


def best_fit(counts: np.ndarray, limit: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing on a histogram: (repeats, lengths) of bins; equal bins are one entry, whatever the counts."""
    spaces: list[list[tuple[int, list[int]]]] = [[] for _ in range(limit + 1)]
    for size in range(limit, 0, -1):
        left = int(counts[size])
        for space in range(size, limit):
            if not left:
                break
            each, groups, spaces[space] = space // size, spaces[space], []
            for repeats, held in groups:
                full = min(repeats, left // each)
                rest = min(left - full * each, each) if full < repeats else 0
                left -= full * each + rest
                for n, k in ((full, each), (int(rest > 0), rest), (repeats - full - (rest > 0), 0)):
                    if n:
                        spaces[space - k * size].append((n, held + [size] * k))
        each = limit // size
        for n, k in ((left // each, each), (int(left % each > 0), left % each)):
            if n:
                spaces[limit - k * size].append((n, [size] * k))
    return [g for groups in spaces for g in groups]


def plan(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[int, list[int]]]:
    """(repeats, lengths) of sequences that hold counts[n] pieces of each length n; its size depends on limit alone.

    The fitted repeat counts are rounded, at most what is left of each length, and the residual goes to best-fit bins. If
    best-fit bins alone are fewer, which is so for small histograms, no pattern is used.
    """
    left, made = counts.astype(np.int64).copy(), []
    shapes = patterns(np.flatnonzero(counts), limit)
    repeats = np.rint(fit(shapes, counts)).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        if not repeats[i]:
            break
        shape = shapes[i][shapes[i] > 0]
        kinds, times = np.unique(shape, return_counts=True)
        n = int(min(repeats[i], (left[kinds] // times).min()))
        if n:
            left[kinds] -= n * times
            made.append((n, shape.tolist()))
    made += best_fit(left, limit)
    plain = best_fit(counts, limit)
    return min(made, plain, key=lambda p: sum(n for n, _ in p))


def runs(made: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows length, first rank, sequence of that rank, place: the pieces of a length, by rank, in runs of one pattern's slot."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for repeats, lengths in made:
        place = 0
        for n in lengths:
            rows.append((n, ranks.get(n, 0), sequence, place))
            ranks[n] = ranks.get(n, 0) + repeats
            place += n
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pieces (doc_id, piece, length, ids_crc32 and more columns; a written table) with sequence_id and offset.

    The driver sees the histogram of lengths alone, at most `limit` rows. Pieces of one length are numbered in parts of
    about RANKED_TOGETHER rows, so that a length that a third of all pieces have is numbered by many tasks.
    """
    if [c for c in pieces.columns if c in ("sequence_id", "offset")]:
        raise ValueError("pieces already have a place")
    histogram = np.zeros(limit + 1, np.int64)
    for n, k in pieces.groupBy("length").count().collect():
        histogram[n] = k
    table = runs(plan(histogram, limit))
    keys = (table[:, 0] << 42) + table[:, 1]
    names = pieces.columns
    parts = max(1, -(-int(histogram.sum()) // RANKED_TOGETHER))
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "_part").count()
    before = sizes.select("length", "_part", (F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32"))).join(written(before, "pack-before").hint("merge"), ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before") - 1).select(*pieces.columns, "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = table[np.searchsorted(keys, (n << 42) + rank, "right") - 1] if len(table) else np.zeros((len(n), 4), np.int64)
            columns = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs with their sequence and place there; with_ids adds the ids themselves.

    A null or empty text is its end id alone; rows that repeat have pieces of their own; pieces of one length are
    interchangeable, so which of them shares a sequence with which is free. An empty table gives no rows; other columns of
    docs, whatever their names, are never read.
    """
    return pack(written(token_pieces(docs, path, limit, end_id, with_ids), "pack-pieces"), limit)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """best_fit_packing over all documents; odd rows as told there."""
    return best_fit_packing(documents(spark, sf_dir))
