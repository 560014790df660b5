"""What the operators of this subpackage share: input rows, scratch tables, Arrow slices."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.scratch import Scratch, scratch_folder, written  # noqa: F401

#: The white space of the contracts, as a Java class.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that one task is to hold when an operator sizes its own partitions.
TASK_BYTES = 16 << 20
#: A table of numbers with at most so many rows is broadcast; a larger one meets the rows by a shuffle.
BROADCAST = 200_000


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def two_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only doc_id and text, a null text as the empty one: other columns can't clash with an operator's own."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def plain_words(text: Column | str) -> Column:
    """A text's words, by the white space of the contracts, joined by one space."""
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "), F.lit(" "))


def words_in(plain: str) -> Column:
    """How many words a text of plain_words has."""
    return F.when(F.col(plain) == "", 0).otherwise(F.length(plain) - F.length(F.replace(F.col(plain), F.lit(" "), F.lit(""))) + 1).cast("long")


def remainder(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def about(rows: DataFrame, most: int, total: int, *keys: str) -> DataFrame:
    """About `most` of `total` rows, the same ones each time: those whose keys' hash is small. No rows meet in one task for it."""
    if total <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 32)) < int((1 << 32) * most / total))


def is_small(df: DataFrame) -> bool:
    return df.limit(BROADCAST + 1).count() <= BROADCAST


def small(df: DataFrame) -> DataFrame:
    """df, a written table of a few numbers a row, marked for a broadcast if it has few rows, else for a merge join."""
    return F.broadcast(df) if is_small(df) else df.hint("merge")


def partitions_for(n_bytes: int | None, per_task: int = TASK_BYTES, least: int = 1) -> int:
    """Partitions that follow the input's size."""
    return max(least, -(-int(n_bytes or 0) // per_task))


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of about `limit` bytes of text; a longer text stands alone and whole.

    Afterwards freed memory goes back to the system, since a worker lives on and another task's worker may need it."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield b.slice(at, end - at)
            at = end
        del b, size
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def kept_where(docs: DataFrame, test: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text passes a test of a slice's column of texts. Only texts go to Python and
    only truth values come back."""

    @F.arrow_udf("boolean")
    def passes(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            ok = [test(s.column(0)) for s in text_slices([pa.RecordBatch.from_arrays([c], names=["text"])])]
            yield pa.array(np.concatenate(ok) if ok else np.empty(0, bool), pa.bool_())

    return docs.filter(passes(F.col(f"`{text_col}`").cast("string")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets into them; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
