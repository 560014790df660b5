"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.common import documents, text_slices, two_columns

#: Keys in a bucket of the hash, on average; entries in each of the two generations of the memo; the longest that it keeps.
PER_BUCKET, MEMO, LONGEST = 4, 500_000, 48


def mixed(h: np.ndarray, seed) -> np.ndarray:
    x = (h ^ np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(20)


class PerfectHash:
    """A minimal perfect hash by displacement: n keys have the slots 0 to n - 1.

    Keys fall into buckets; the largest bucket first, each gets the first seed that sends its keys to free slots. Buckets
    of one key get what is left, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.n_buckets = n, max(1, n // PER_BUCKET)
        h = self.hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("keys repeat")
        bucket = h % np.uint64(self.n_buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1, dtype=np.uint64))
        sizes = np.diff(edges)
        free, slot = np.ones(n, bool), np.zeros(n, np.int64)
        self.seeds = np.zeros(self.n_buckets, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[edges[b] : edges[b + 1]]
            if len(own) < 2:
                break
            first = 1
            while True:
                seeds = np.arange(first, first + 64, dtype=np.uint64)
                to = (mixed(h[own][None, :], seeds[:, None]) % np.uint64(n)).astype(np.int64)
                ok = free[to].all(1)
                for i in np.flatnonzero(ok):
                    if len(set(to[i].tolist())) == len(own):
                        break
                else:
                    first += 64
                    continue
                self.seeds[b], slot[own], free[to[i]] = int(seeds[i]), to[i], False
                break
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1):
            own = order[edges[b]]
            slot[own] = next(left)
            self.seeds[b] = -1 - slot[own]
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int64)
        for i, k in zip(slot.tolist(), keys, strict=True):
            self.keys[i] = k

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key, -1 for what isn't a key."""
        if not keys or not self.n:
            return np.full(len(keys), -1)
        h = self.hashes(keys)
        seed = self.seeds[(h % np.uint64(self.n_buckets)).astype(np.int64)]
        to = np.where(seed < 0, -1 - seed, (mixed(h, np.maximum(seed, 0).astype(np.uint64)) % np.uint64(self.n)).astype(np.int64))
        return np.array([i if self.keys[i] == k else -1 for i, k in zip(to.tolist(), keys, strict=True)])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of neighbours with the lowest rank, the first of equal ones, is merged until none is left."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n))  # linked parts by their first byte
    size = [1] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not size[i] or j >= n or j + size[j] != end:  # one of the two has changed since
            continue
        size[i], size[j], k = end - i, 0, after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : k + size[k]])) is not None:
                heapq.heappush(heap, (r, i, k + size[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Coder:
    """Encodes and decodes by a rank file; whole texts, without special tokens."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.hash = PerfectHash(list(self.ranks))
        self.hash.values[:] = [self.ranks[k] for k in self.hash.keys]
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for k, r in self.ranks.items():
            self.bytes_of[r] = k
        self.pattern = pattern
        self.ready()

    def ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "memo", "older")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.ready()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        cut, new = list(map(self.find, texts)), set()
        for pieces in cut:
            new.update(pieces)
        new.difference_update(self.memo)
        older = self.older
        self.memo.update((p, older[p]) for p in new if p in older)
        learn = [p for p in new if p not in older]
        raw = [p.encode("utf-8", "surrogatepass") for p in learn]
        slots = self.hash.slots(raw)
        known = self.hash.values[slots].astype("<u4").tobytes()
        for i, (p, s) in enumerate(zip(learn, slots.tolist(), strict=True)):
            self.memo[p] = known[4 * i : 4 * i + 4] if s >= 0 else np.array(merge(raw[i], self.ranks), "<u4").tobytes()
        of = self.memo.__getitem__
        out = [b"".join(map(of, pieces)) for pieces in cut]
        for p in learn:
            if len(p) > LONGEST:
                del self.memo[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> Coder:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return Coder(f.read(), pattern or public_tokenizers.PATTERN)


def encode_decode(docs: DataFrame, coder: Coder, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids and the decoded text where asked for.

    Null and empty texts have no ids; rows that repeat are encoded alike. The vocabulary, whose size is that of its file,
    is broadcast once. An empty table gives no rows; other columns of docs, whatever their names, are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for b in text_slices(batches):
            ids = own.encode(b.column("text").to_pylist())
            back = list(map(own.decode, ids))
            columns = [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(digest, ids)), pa.string()), pa.array(list(map(digest, back)), pa.string())]
            if with_ids:
                columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([x.decode("utf-8", "replace") for x in back], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return two_columns(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op4_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    """encode_decode over all documents; odd rows as told there."""
    return encode_decode(documents(spark, sf_dir), load(spark), with_ids=False)
