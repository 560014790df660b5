"""Substring dedup: words covered by a window of words that stands elsewhere too are removed, found by recompression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm import recompression as R
from siftlake.llm.common import Scratch, documents, give_back, partitions_for, plain_words, small, text_slices, two_columns, utf8, words_in

#: Words of a window.
WINDOW = 35
#: Bytes of text whose runs are sent as one slice.
SLICE = 2 << 20
#: Bytes of text for each bucket of names, and the fewest and most buckets.
BUCKET_BYTES, FEWEST, MOST = 8 << 20, 96, 1 << 16
#: A run of windows as it is counted: its name, and the hash of its words, whose last bit says that this slice has it twice.
RECORD = np.dtype([("name", "<u4"), ("words", "<u8")])
#: What counting says of a record: its words stand twice; windows of its name are to be counted one by one.
REPEATED, OPEN = 1, 2
SENT = "bucket int, slice long, first int, records binary, keys binary, counts binary, begins binary, sizes binary, which binary"
MARKS = "key binary, repeated binary, open binary"
ONE = np.uint64(1)


def key_of(text: str = "text") -> Column:
    """16 bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16)


def packed(keys: list[bytes], owner: np.ndarray, begins: np.ndarray, sizes: np.ndarray, names: np.ndarray, words: np.ndarray, buckets: int, number: int) -> Iterator[tuple]:
    """The rows of a slice: its distinct records by bucket, and a row that says which runs of which texts they stand for."""
    bucket = ((names >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    short, words = names.astype(np.uint32), words & ~ONE
    order = np.lexsort((words, short, bucket))
    fresh = np.ones(len(order), bool)
    for x in (bucket, short, words):
        fresh[1:] &= x[order][1:] == x[order][:-1]
    fresh[1:] = ~fresh[1:]
    head = np.flatnonzero(fresh)
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(fresh) - 1
    records = np.empty(len(head), RECORD)
    records["name"] = short[order][head]
    records["words"] = words[order][head] | (np.diff(np.append(head, len(order))) > 1)
    of = bucket[order][head]
    border = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else [0]
    for a, b in zip(border[:-1], border[1:], strict=True):
        yield int(of[a]), number, int(a), records[a:b].tobytes(), None, None, None, None, None
    held = np.bincount(owner, minlength=len(keys)).astype("<i4")
    yield -1, number, -1, None, b"".join(keys), held.tobytes(), begins.astype("<i4").tobytes(), sizes.astype(np.uint8).tobytes(), which.astype("<i4").tobytes()


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("first", pa.int32()), *[(n, pa.binary()) for n in "records keys counts begins sizes which".split()]])
MARK_SCHEMA = pa.schema([("key", pa.binary()), ("repeated", pa.binary()), ("open", pa.binary())])


def runs_of_texts(b: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """All runs of windows of a slice's texts, named by recompression: the text each is of, where it begins there, how many
    windows it has, its name and the hash of its words."""
    _, _, hashes, first = R.words_of(*utf8(b.column("text")))
    text = np.repeat(np.arange(b.num_rows), np.diff(first))
    found = [(text[:0], text[:0], text[:0], hashes[:0], hashes[:0])]
    for lo, hi in R.parts(len(hashes), window):
        at, size, name, words = R.runs_of_windows(hashes[lo:hi], text[lo:hi], window)
        owner = text[at + lo]
        found.append((owner, at + lo - first[owner], size, name, words))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def open_windows(b: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """The windows of a slice's texts that lie in the ranges of its column open, each a run by itself."""
    _, _, hashes, first = R.words_of(*utf8(b.column("text")))
    found = [(first[:0], first[:0], first[:0], hashes[:0], hashes[:0])]
    for i, ranges in enumerate(b.column("open").to_pylist()):
        h = hashes[first[i] : first[i + 1]]
        begins = np.concatenate([np.arange(x, y) for x, y in np.frombuffer(ranges, "<i4").reshape(-1, 2).tolist()])
        prefix = R.sums(h, R.WORD)
        words = R.between(prefix, begins, begins + window, R.WORD)
        found.append((np.full(len(begins), i), begins, np.ones(len(begins), np.int64), R.mixed(words), words))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sent(texts: DataFrame, runs: Callable, window: int, buckets: int) -> DataFrame:
    """The rows of `packed` for texts (key, text and what runs() reads)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in text_slices(batches, SLICE):
            owner, begins, sizes, names, words = runs(b, window)
            if len(owner):
                yield batch_of(list(packed(b.column("key").to_pylist(), owner, begins, sizes, names, words, buckets, number)), SENT_SCHEMA)
                number += 1
        give_back()

    return texts.mapInArrow(run, SENT)


def judged(records: np.ndarray) -> np.ndarray:
    """What counting says of each record of a bucket, whatever slices they come from. Of the records of a name that stands
    several times, but not always in the same words, one for each words is open."""
    order = np.lexsort((records["words"] >> ONE, records["name"]))
    name, words = records["name"][order], records["words"][order]
    count = 1 + (words & ONE).astype(np.int64)
    new_name = np.concatenate([[True], name[1:] != name[:-1]])
    new_words = new_name.copy()
    new_words[1:] |= words[1:] >> ONE != words[:-1] >> ONE
    group, of_name = np.cumsum(new_words) - 1, np.cumsum(new_name) - 1
    often, named = np.bincount(group, count), np.bincount(of_name, count)
    single = np.bincount(of_name, (often == 1)[group]) > 0
    out = np.zeros(len(records), np.uint8)
    out[order] = np.where((often > 1)[group], REPEATED, 0) | np.where(new_words & ((named > 1) & single)[of_name], OPEN, 0)
    return out


def counted(rows: DataFrame, tasks: int) -> DataFrame:
    """slice, first, flags: what counting says of the records of all slices, by bucket; nothing of records that stand alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            flags = judged(np.frombuffer(b"".join(x[2] for x in held), RECORD))
            ends = np.cumsum([len(x[2]) // RECORD.itemsize for x in held])
            rows = [(x[0], x[1], flags[e - len(x[2]) // RECORD.itemsize : e]) for x, e in zip(held, ends.tolist(), strict=True)]
            rows = [(s, f, y.tobytes()) for s, f, y in rows if y.any()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["slice", "first", "flags"])

        for b in batches:
            for bucket, number, first, records in zip(*(b.column(c).to_pylist() for c in ("bucket", "slice", "first", "records")), strict=True):
                if bucket != now and held:
                    yield from done()
                    held = []
                now = bucket
                held.append((number, first, records))
        if held:
            yield from done()
        give_back()

    dealt = rows.filter("bucket >= 0").select("bucket", "slice", "first", "records").repartition(tasks, "bucket").sortWithinPartitions("bucket", "slice")
    return dealt.mapInArrow(run, "slice long, first int, flags binary")


def ranges(begins: np.ndarray, sizes: np.ndarray) -> bytes | None:
    """Sorted ranges joined where they touch, as pairs of begin and end."""
    if not len(begins):
        return None
    ends = np.maximum.accumulate(begins + sizes)
    fresh = np.concatenate([[True], begins[1:] > ends[:-1]])
    return np.stack([begins[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]], 1).astype("<i4").tobytes()


def marks(rows: DataFrame, flags: DataFrame, tasks: int) -> DataFrame:
    """key, repeated, open: for texts with such windows, the ranges where windows begin that stand twice, and those of windows to
    count one by one. Slices meet what was said of their records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, said = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["keys"] is not None:
                    now, which = r, np.frombuffer(r["which"], "<i4")
                    said = np.zeros(int(which.max()) + 1, np.uint8)
                elif r["flags"] is not None:
                    said[r["first"] : r["first"] + len(r["flags"])] = np.frombuffer(r["flags"], np.uint8)
                else:
                    out += told(now, said)
            if out:
                yield batch_of(out, MARK_SCHEMA)
        give_back()

    def told(r: dict, said: np.ndarray) -> Iterator[tuple]:
        begins, sizes = np.frombuffer(r["begins"], "<i4").astype(np.int64), np.frombuffer(r["sizes"], np.uint8).astype(np.int64)
        flags, ends = said[np.frombuffer(r["which"], "<i4")], np.cumsum(np.frombuffer(r["counts"], "<i4"))
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(flags), "right")).tolist():
            a, e = int(ends[i - 1]) if i else 0, int(ends[i])
            parts = [ranges(begins[a:e][on], sizes[a:e][on]) for on in ((flags[a:e] & f) > 0 for f in (REPEATED, OPEN))]
            yield r["keys"][16 * i : 16 * i + 16], *parts

    payload = ["keys", "counts", "begins", "sizes", "which"]
    none = [F.lit(None).cast("binary").alias(c) for c in payload]
    slices = rows.filter("bucket < 0").select("slice", F.lit(-1).alias("first"), F.lit(None).cast("binary").alias("flags"), *payload)
    last = flags.select("slice").distinct().select("slice", F.lit(1 << 30).cast("int").alias("first"), F.lit(None).cast("binary").alias("flags"), *none)
    met = slices.join(flags.select("slice").distinct(), "slice", "left_semi").unionByName(flags.select("slice", "first", "flags", *none)).unionByName(last)
    return met.repartition(tasks, "slice").sortWithinPartitions("slice", "first").mapInArrow(run, MARKS)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, ranges: for each text (key_of) with windows that begin elsewhere too, the ranges of words where such windows begin.

    First all windows are counted by runs: a window's name is a function of its words alone, so a window whose name stands
    once stands once. Where a run's words stand twice as a whole, so do its windows. What is left, the runs at the edges of
    repeats, is counted window by window; for those, words that stand in many texts are sent from one of them.
    """
    texts = docs.select(key_of().alias("key"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    buckets = min(MOST, partitions_for(n_bytes, BUCKET_BYTES, FEWEST))
    tasks = max(8, buckets // 8)
    runs = Scratch(sent(texts, runs_of_texts, window, buckets), "substring-runs")
    flags = Scratch(counted(runs.df, tasks), "substring-flags")
    found = Scratch(marks(runs.df, flags.df, tasks).groupBy("key").agg(F.max("repeated").alias("repeated"), F.max("open").alias("open")), "substring-marks")
    runs.drop()
    flags.drop()
    left = small(found.df.filter("open is not null").select("key", "open"))
    again = texts.join(left, "key").groupBy("key").agg(F.any_value("text").alias("text"), F.any_value("open").alias("open"))
    single = Scratch(sent(again, open_windows, window, buckets), "substring-windows")
    flags = Scratch(counted(single.df, tasks), "substring-window-flags")
    both = found.df.select("key", "repeated").unionByName(marks(single.df, flags.df, tasks).select("key", "repeated"))
    out = Scratch(both.filter("repeated is not null").groupBy("key").agg(F.collect_list("repeated").alias("ranges")), "substring-ranges").df
    for x in (single, flags, found):
        x.drop()
    return out


def kept_words(text: pa.Array, found: pa.Array, window: int) -> pa.Array:
    """Texts without the words that windows from the found ranges cover, what is left joined by one space; null for null."""
    out = []
    for t, many in zip(text, found.to_pylist(), strict=True):
        if many is None:
            out.append(None)
            continue
        words = t.as_py().encode("utf-8", "surrogatepass").split()
        change = np.zeros(len(words) + 1, np.int64)
        for x in many:
            begin, end = np.frombuffer(x, "<i4").reshape(-1, 2).T
            np.add.at(change, begin, 1)
            np.add.at(change, end + window - 1, -1)
        out.append(b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]).decode("utf-8", "surrogatepass"))
    return pa.array(out, pa.string())


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: each row's text without the words covered by a window of `window` words that also
    begins anywhere else, in the same text or another; kept words are joined by one space.

    All windows are judged on the input. Words are runs without the white space of the contracts, compared as they are;
    null and empty texts have none, and texts shorter than a window lose nothing. Rows that repeat a text, whatever their
    ids, are repeats of each other, so such texts lose all words if they have a window. Rows without an id are judged like
    others. An empty table gives no rows; other columns of docs are never read.
    """

    @F.arrow_udf("string")
    def without(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, found in columns:
            yield kept_words(text, found, window)

    rows = two_columns(docs, id_col, text_col)
    found = small(repeated_windows(rows, window))
    joined = rows.withColumn("key", key_of()).join(found, "key", "left")
    hit = F.col("ranges").isNotNull()
    both = joined.select("doc_id", plain_words("text").alias("plain"), without(F.when(hit, F.col("text")), F.col("ranges")).alias("left"))
    both = both.select("doc_id", words_in("plain").alias("n_words"), F.coalesce("left", "plain").alias("kept"))
    return both.select("doc_id", "n_words", (F.col("n_words") - words_in("kept")).alias("n_removed"), "kept")


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents, its texts as digests; odd rows as substring_dedup says."""
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
