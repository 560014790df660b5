"""Sentence-preserving chunks with overlap."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.text import SENTENCE

_SENTENCE = re.compile(SENTENCE)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each sentence without the white space around it, in code points."""
    spans = []
    for m in _SENTENCE.finditer(text):
        piece = m[0]
        begin = m.start() + len(piece) - len(piece.lstrip())
        end = m.start() + len(piece.rstrip())
        if begin < end:
            spans.append((begin, end))
    return spans


def pack(spans: list[tuple[int, int]], size: int, overlap: int, lossless: bool = False) -> list[tuple[int, int]]:
    """(first, after the last) sentence of each chunk.

    A chunk takes sentences while its text has at most `size` characters, at least one. The next one begins with the
    sentence before its own first if that has at most `overlap` characters. Where this sentence and the next don't fit
    together, a chunk of the overlap alone comes out and the next sentence may be lost, as the platform's offsets have it;
    lossless leaves the overlap out there instead.
    """
    n, out = len(spans), []
    width = lambda a, b: spans[b][1] - spans[a][0]
    back = lambda i: i - 1 if i > 0 and width(i - 1, i - 1) <= overlap else i
    first = at = 0
    for k in range(n):
        if k < first:
            continue
        if k > first and width(first, k) > size:
            out.append((first, k))
            if lossless:
                first = back(k)
                if first == k - 1 and width(first, k) > size:
                    first = k
                at = k
                continue
            at = k if at == 0 else max(k, at + 1)
            first = back(at)
            if at == k and first == k - 1 and width(first, k) > size:
                out.append((first, k))
                at = k + 1
                first = back(at)
    if first < n and (lossless or at < n):
        out.append((first, n))
    return out


#: A function of a text to the spans of its sentences.
Splitter = Callable[[str], list[tuple[int, int]]]


def chunks(text: str, size: int, overlap: int, lossless: bool = False, split: Splitter = sentence_spans) -> list[tuple[int, str]]:
    """(offset, chunk) of a text; a text that fits, or any where size is below 1, is one chunk at 0."""
    if not text:
        return []
    if size < 1 or len(text) <= size:
        return [(0, text)]
    spans = split(text)
    if not spans:
        return [(0, text)]
    return [(spans[a][0], text[spans[a][0] : spans[b - 1][1]]) for a, b in pack(spans, size, overlap, lossless)]


def chunk_documents(docs: DataFrame, size: int = 512, overlap: int = 128, lossless: bool = False, text_col: str = "text", split: Splitter = sentence_spans) -> DataFrame:
    """docs with a row per chunk: all columns but the text, and offset (int) and text. size and overlap may be columns'
    names, for limits by tenant. Null and empty texts have no chunk. split finds the sentences: end marks alone, or a model
    of boundaries.learned."""
    keep = [c for c in docs.columns if c != text_col]
    limits = [F.col(x).cast("int") if isinstance(x, str) else F.lit(x) for x in (size, overlap)]
    rows = docs.select(*keep, F.col(text_col).alias("_text"), limits[0].alias("_size"), limits[1].alias("_overlap"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text_col) + ", offset int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, offsets, texts = [], [], []
            for i, (t, s, o) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_text", "_size", "_overlap")), strict=True)):
                for offset, chunk in chunks(t or "", s, o, lossless, split):
                    at.append(i)
                    offsets.append(offset)
                    texts.append(chunk)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(taken) for c in keep), pa.array(offsets, pa.int32()), pa.array(texts, pa.string())], names=[*keep, "offset", "text"])

    return rows.mapInArrow(run, schema)


def register(spark: SparkSession) -> None:
    """`SELECT * FROM chunk_text(text, size, overlap)`, lateral, in SQL."""

    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            yield from chunks(text or "", size, overlap)

    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="offset int, chunk string"))
