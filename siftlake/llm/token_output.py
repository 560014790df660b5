"""Token ids in files: each block of documents is Re-Pair compressed and can be decoded from any document on."""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm import encoding
from siftlake.llm.common import TASK_BYTES, documents, partitions_for, scratch_folder, text_slices, two_columns

END_ID = 2
#: Ids in a block, about; a longer document is a block of its own.
BLOCK_IDS = 4_000_000
#: Bytes of text that are encoded together.
SLICE = 2 << 20
#: Pairs replaced in a round, and how often a pair must stand in the block to be replaced. Rarer pairs would need so many
#: nonterminals that symbols no longer fit 16 bits: 1.10 bytes an id become 1.92 with pairs that stand 8 times.
PAIRS, LEAST = 7000, 32
#: Parts whose ids are summed together first where the start of each part is found.
PARTS_TOGETHER = 1000
#: Fixed value: the first bytes of a block.
MAGIC = b"RPR1"
HEADER = struct.Struct("<4sBxxxIIIq")
FILE_SCHEMA = "part int, block int, first_doc long, n_docs int, n_ids long, data binary"


def repair(ids: np.ndarray, last: np.ndarray, rounds: int | None = None, pairs: int = PAIRS, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: (first nonterminal, rules, symbols, places where a document ends).

    In each round the most frequent pairs become nonterminals at once and their places are replaced from the left, where
    two places overlap the first one. No pair crosses a document's end. Ends when no pair stands `least` times, or after
    `rounds` if given.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    kind, bits = np.uint32, 16
    symbols, ends, rules, n = ids.astype(kind), last.copy(), [], base
    for _ in itertools.count() if rounds is None else range(rounds):
        if len(symbols) < 2:
            break
        if n + pairs > 1 << 16 and bits == 16:
            kind, bits = np.uint64, 32
            symbols = symbols.astype(kind)
        key = symbols[:-1] << kind(bits) | symbols[1:]
        free = ~ends[:-1]
        ordered = np.sort(key[free])
        # Equal keys stand together: one that stands `least` times is found at a distance of least - 1.
        heads = np.flatnonzero(ordered[least - 1 :] == ordered[: len(ordered) - least + 1]) if len(ordered) >= least else np.empty(0, int)
        often = np.unique(ordered[heads])
        if not len(often):
            break
        if len(often) > pairs:
            times = np.searchsorted(ordered, often, "right") - np.searchsorted(ordered, often, "left")
            often = np.sort(often[np.argpartition(-times, pairs)[:pairs]])
        # A table by hash has the number of the pair at each place; where pairs share a cell, the others are searched for.
        factor, shift = (0x9E3779B1, 12) if bits == 16 else (0x9E3779B97F4A7C15, 44)
        cell = lambda k: (k * kind(factor)) >> kind(shift)
        table = np.full(1 << 20, -1, np.int16 if pairs < 1 << 15 else np.int32)
        cells = cell(often)
        table[cells] = np.arange(len(often))
        shared = np.zeros(1 << 20, bool)
        shared[cells[table[cells] != np.arange(len(often))]] = True
        places = cell(key)
        found = table[places]
        at = np.flatnonzero((found >= 0) & free).astype(np.int32)
        found, value = found[at], key[at]
        other = np.flatnonzero((often[found] != value) & shared[places[at]])
        found[other] = np.minimum(np.searchsorted(often, value[other]), len(often) - 1)
        hit = often[found] == value
        at, found = at[hit], found[hit].astype(kind)
        # In a run of neighbouring places every second one is taken.
        order = np.arange(len(at), dtype=np.int32)
        starts = np.ones(len(at), bool)
        starts[1:] = at[1:] - at[:-1] > 1
        take = (order - np.maximum.accumulate(np.where(starts, order, np.int32(0)))) & 1 == 0
        at, found = at[take], found[take]
        rules.append(np.stack([often >> kind(bits), often & kind((1 << bits) - 1)], 1).astype(np.int64))
        symbols[at] = kind(n) + found
        n += len(often)
        ends[at] = ends[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, ends = symbols[keep], ends[keep]
    return base, np.concatenate(rules) if rules else np.empty((0, 2), np.int64), symbols, ends


def expansion_lengths(base: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each symbol, from the first nonterminal on, stands for. A rule names earlier symbols only."""
    size = np.zeros(len(rules), np.int64)
    while len(open_ := np.flatnonzero(size == 0)):
        a, b = rules[open_, 0], rules[open_, 1]
        of = lambda x: np.where(x < base, 1, size[np.maximum(x - base, 0)])
        x, y = of(a), of(b)
        size[open_] = np.where((x > 0) & (y > 0), x + y, 0)
    return size


def write_block(docs: np.ndarray, known: np.ndarray, ids: np.ndarray, edges: np.ndarray, **how) -> bytes:
    """The block of documents whose ids are ids[edges[i]:edges[i + 1]]; none is empty. known: where the doc's id isn't null."""
    last = np.zeros(len(ids), bool)
    last[edges[1:] - 1] = True
    base, rules, symbols, ends = repair(ids, last, **how)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    return HEADER.pack(MAGIC, width, len(docs), base, len(rules), len(symbols)) + b"".join(
        x.tobytes() for x in (docs.astype("<i8"), known.astype("u1"), np.diff(edges).astype("<i8"), (np.flatnonzero(ends) + 1).astype("<i8"), rules.astype(kind), expansion_lengths(base, rules).astype("<u4"), symbols.astype(kind))
    )


class Block:
    """A written block, open for reading."""

    def __init__(self, data: bytes):
        magic, width, n_docs, self.base, n_rules, n_symbols = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        kind, at = f"<u{width}", HEADER.size

        def part(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.docs, self.known, self.sizes, self.ends = part(n_docs, "<i8"), part(n_docs, "u1").astype(bool), part(n_docs, "<i8"), part(n_docs, "<i8")
        self.rules, self.lengths, self.symbols = part(2 * n_rules, kind).astype(np.int64).reshape(-1, 2), part(n_rules, "<u4").astype(np.int64), part(n_symbols, kind)
        self.begins = np.cumsum(self.lengths) - self.lengths
        flat = self._expand()
        # What any symbol stands for: a place in one table, and how many ids from there on.
        kind = np.int32 if max(int(self.sizes.sum()), self.base + len(flat)) < 1 << 31 else np.int64
        self.table = np.concatenate([np.arange(self.base, dtype=np.uint32), flat])
        self.place_of = np.concatenate([np.arange(self.base), self.base + self.begins]).astype(kind)
        self.size_of = np.concatenate([np.ones(self.base, np.int64), self.lengths]).astype(kind)

    def _expand(self) -> np.ndarray:
        """The ids that the nonterminals stand for, one after the other, shorter ones first found."""
        flat = np.zeros(int(self.lengths.sum()), np.uint32)
        for size in np.unique(self.lengths):
            for side in (0, 1):
                which = np.flatnonzero(self.lengths == size)
                x = self.rules[which, side]
                own = np.where(x < self.base, 1, self.lengths[np.maximum(x - self.base, 0)])
                to = self.begins[which] + (0 if side == 0 else size - own)
                for n in np.unique(own):
                    some = own == n
                    source = x[some]
                    if n == 1:
                        flat[to[some]] = source
                    else:
                        k = np.arange(n)
                        flat[to[some][:, None] + k] = flat[self.begins[source - self.base][:, None] + k]
        return flat

    def decode(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The ids of documents first to end - 1, without reading what stands before them."""
        end = len(self.docs) if end is None else end
        if end <= first:
            return np.empty(0, np.uint32)
        x = self.symbols[self.ends[first - 1] if first else 0 : self.ends[end - 1]]
        size = self.size_of[x]
        ends = np.cumsum(size, dtype=self.place_of.dtype)
        index = np.repeat(self.place_of[x] - (ends - size), size)
        index += np.arange(len(index), dtype=index.dtype)
        return self.table[index]


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all docs, each with end_id at its end, as a table of blocks in ascending id order below path.

    The blocks' order is (part, block). A null id comes first; rows that repeat an id stand in the order of their texts'
    checksums. A null or empty text has end_id alone. Documents are dealt out by ranges of ids, as many as the text's
    size asks for.
    """
    tokenizer = tokenizer or encoding.default_path()
    rows = two_columns(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("text").cast("binary")).alias("tie"))
    n = partitions_for(rows.agg(F.sum(F.octet_length("text"))).first()[0], TASK_BYTES, 1)
    dealt = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, block = encoding.encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # ids, sizes and doc ids

        def flush() -> pa.RecordBatch:
            ids, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            docs = pa.chunked_array([h[2] for h in held], pa.int64()).combine_chunks()
            data = write_block(pc.fill_null(docs, 0).to_numpy(zero_copy_only=False), pc.is_valid(docs).to_numpy(zero_copy_only=False), ids, np.concatenate([[0], np.cumsum(sizes)]))
            values = (part, block, docs[0].as_py(), len(docs), len(ids), data)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "block", "first_doc", "n_docs", "n_ids", "data"])

        for b in text_slices(batches, SLICE):
            ids, edges = code.encode(b.column("text"), end_id)
            if held and len(ids) + sum(len(h[0]) for h in held) > block_ids:
                yield flush()
                block, held = block + 1, []
            held.append((ids, np.diff(edges), b.column("doc_id")))
        if held:
            yield flush()

    dealt.select("doc_id", "text").mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def block_starts(table: DataFrame) -> DataFrame:
    """part, block and before, how many ids stand in earlier blocks: sums by groups of parts, then by parts of a group, then
    by blocks of a part, so that no task orders all blocks."""
    sizes = table.select("part", "block", "n_ids", F.floor(F.col("part") / PARTS_TOGETHER).alias("group"))
    earlier = lambda df, *keys: F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - F.col("n")
    parts = sizes.groupBy("group", "part").agg(F.sum("n_ids").alias("n"))
    groups = parts.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select("group", earlier(groups, "group").alias("before_group"))
    parts = parts.select("group", "part", earlier(parts, "group", "part").alias("before_part"))
    blocks = sizes.withColumnRenamed("n_ids", "n")
    blocks = blocks.select("group", "part", "block", earlier(blocks, "part", "block").alias("before_block"))
    return blocks.join(parts, ["group", "part"]).join(groups, "group").select("part", "block", (F.col("before_block") + F.col("before_part") + F.col("before_group")).alias("before"))


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """What write_tokens wrote, by document: doc_id, start, n_tokens, ids_crc32 and, unless switched off, the ids."""
    table = spark.read.schema(FILE_SCHEMA).parquet(path)
    starts = block_starts(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, data in zip(*(b.column(c).to_pylist() for c in ("part", "block", "data")), strict=True):
                block = Block(data)
                ids = block.decode().astype("<u4")
                edges = np.concatenate([[0], np.cumsum(block.sizes)])
                raw = memoryview(ids.tobytes())
                spans = [raw[4 * x : 4 * y] for x, y in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
                n = len(block.docs)
                columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(block.docs.astype(np.int64), mask=~block.known), pa.array(edges[:-1]), pa.array(block.sizes.astype(np.int64)), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_id", "within", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    rows = table.select("part", "block", "data").mapInArrow(run, "part int, block int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    out = rows.join(starts, ["part", "block"]).withColumn("start", F.col("before") + F.col("within"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    """write_tokens and read_tokens over all documents; odd rows as told there."""
    docs = documents(spark, sf_dir)
    path = f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write_tokens(docs, path)
    return read_tokens(spark, path, with_ids=False)
