"""SimHash near-dedup: fingerprints are dealt out by a vantage-point tree and linked exactly within its leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Scratch, about, documents, is_small, small, text_slices, two_columns, written

SHINGLE, SEED, BITS = 3, 42, 2
#: Hashes whose bits are summed at once.
TOGETHER = 1 << 17
#: Distinct fingerprints that the tree of shards is built from, about, if there are more; every fingerprint goes through the tree.
SAMPLE = 300_000
#: A shard is split while it is expected to hold more fingerprints and this many of the sample.
SHARD, FEWEST = 8192, 32
#: Within a shard, so many fingerprints are compared with each other directly.
DIRECT = 192
#: A split counts only if neither side has more than this share, copies included.
USEFUL = 0.85
#: Keys that are sorted at once where fingerprints lie too close for a split.
KEYS = 8_000_000
#: Words of a shingle where near copies are confirmed.
WORDS = 5
#: Frequent shingles are looked for in one of so many texts, LEAST_LOOKED at least; FREQUENT of these must have one, and the
#: most frequent ones, MOST at most, are told to all tasks. They only set an order, which no result depends on.
ONE_OF, LEAST_LOOKED, FREQUENT, MOST = 8, 20_000, 2, 1_000_000
#: Texts with one shingle that are all paired at once; more may give so many pairs a text in the first round, then GROWTH times as many.
PAIRED, EACH, GROWTH = 32, 16, 8
#: Pairs that a task finds before equal ones among them become one and leave it.
WAITING = 500_000
FOUND = "a long, b long, shingle long, next int, open boolean"


def fingerprints(texts: list[str], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64 majority bits of the XXH64 of all word shingles, repeats included; fewer words are one shingle, none give zero.

    Bits are summed TOGETHER hashes at a time, so a very long text takes no more memory than that and its words.
    """
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    digest, hashes, marks = xxhash.xxh64_intdigest, [], []

    def flush() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rows, begins = (np.array(x) for x in zip(*marks, strict=True))
            np.add.at(ones, rows, np.add.reduceat(bits, begins, axis=0, dtype=np.int32))
            np.add.at(total, rows, np.diff(np.append(begins, len(hashes))))
            hashes.clear()
            marks.clear()

    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - shingle + 1)]
        ends = ends[min(shingle, len(words)) - 1 :]
        for at in range(0, len(begins), TOGETHER):
            marks.append((i, len(hashes)))
            hashes += [digest(line[a:b], seed) for a, b in zip(begins[at : at + TOGETHER].tolist(), ends[at : at + TOGETHER].tolist(), strict=True)]
            if len(hashes) >= TOGETHER:
                flush()
    flush()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel() if texts else np.empty(0, np.uint64)


def fingerprint_table(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(b.column("text").to_pylist(), shingle, seed).view(np.int64))], names=["doc_id", "fp"])

    return two_columns(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def choose(x: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and the distance up to which fingerprints go left, such that the larger side is smallest.

    Right also gets the left ones within `radius` of the border: by the triangle inequality, two fingerprints within
    radius of each other are then together on one side at least.
    """
    some = x if len(x) <= 2000 else x[rng.integers(0, len(x), 2000)]
    best = None
    for v in some[rng.integers(0, len(some), 6)]:
        counts = np.bincount(distance(some, v), minlength=65)
        left = np.cumsum(counts)
        copied = left - np.concatenate([np.zeros(radius, int), left])[: len(left)]
        larger = np.maximum(left, len(some) - left + copied)
        t = int(np.argmin(larger))
        if best is None or larger[t] < best[0]:
            best = (int(larger[t]), v, t)
    return None if best[0] > USEFUL * len(some) else best[1:]


def sides(x: np.ndarray, v: np.uint64, t: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = distance(x, v)
    return np.flatnonzero(d <= t), np.flatnonzero(d > t - radius)


def build_tree(sample: np.ndarray, total: int, radius: int = BITS, shard: int = SHARD) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, border, left, right), the root first; a leaf is (0, -1, number of the shard, 0)."""
    rng, nodes, n_shards = np.random.default_rng(7), [], 0
    scale = max(1.0, total / max(1, len(sample)))
    todo = [(0, sample)]
    nodes.append(None)
    while todo:
        at, x = todo.pop()
        split = choose(x, radius, rng) if len(x) * scale > shard and len(x) > FEWEST else None
        if split is None:
            nodes[at] = (0, -1, n_shards, 0)
            n_shards += 1
            continue
        left, right = sides(x, *split, radius)
        nodes[at] = (int(split[0]), split[1], len(nodes), len(nodes) + 1)
        todo += [(len(nodes), x[left]), (len(nodes) + 1, x[right])]
        nodes += [None, None]
    return nodes


def route(x: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(index in x, shard) of each fingerprint, one pair for every shard that it goes to."""
    found, todo = [], [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        v, t, left, right = nodes[at]
        if t < 0:
            found.append((rows, np.full(len(rows), left)))
        elif len(rows):
            a, b = sides(x[rows], np.uint64(v), t, radius)
            todo += [(left, rows[a]), (right, rows[b])]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n things is linked to, through any number of links a[i] - b[i]."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def compare(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links, by comparing rows with all others, a few rows at a time."""
    found = []
    step = max(1, 2_000_000 // max(1, len(x)))
    for at in range(0, len(x), step):
        i, j = np.nonzero(distance(x[at : at + step, None], x[None, :]) <= radius)
        i += at
        found.append((i[i < j], j[i < j]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def crowded(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as all links, for an even radius: two fingerprints are within it when they share a
    value that lies within half of it of both. One link for each value and fingerprint, not one for each pair."""
    flips = [0]
    for _ in range(radius // 2):
        flips = sorted({f ^ (1 << k) for f in flips for k in range(64)} | set(flips))
    flips = np.array(flips, np.uint64)
    label = np.arange(len(x))
    passes = -(-len(x) * len(flips) // KEYS)
    for p in range(passes):  # each pass takes the values of one residue, so that memory is bounded
        keys, rows = [], []
        for f in flips:
            k = x ^ f
            own = np.flatnonzero((k * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == p)
            keys.append(k[own])
            rows.append(own)
        keys, rows = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(keys)
        keys, rows = keys[order], rows[order]
        same = np.flatnonzero(keys[1:] == keys[:-1])
        merged = components(len(x), np.concatenate([rows[same], np.arange(len(x))]), np.concatenate([rows[same + 1], label]))
        label = merged
    return np.arange(len(x)), label


def links(x: np.ndarray, radius: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose components are those of all links within radius among the distinct fingerprints x."""
    rng, found, todo = np.random.default_rng(11), [(np.empty(0, int), np.empty(0, int))], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) < 2:
            continue
        split = choose(x[rows], radius, rng) if len(rows) > DIRECT else None
        if split is not None:
            a, b = sides(x[rows], *split, radius)
            if max(len(a), len(b)) < len(rows):
                todo += [rows[a], rows[b]]
                continue
        i, j = compare(x[rows], radius) if len(rows) <= 4 * DIRECT or radius % 2 else crowded(x[rows], radius)
        found.append((rows[i], rows[j]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def is_stars(edges: DataFrame) -> bool:
    """Whether each u of edges (u, v; a written table) has one v, which is no u: then v is the smallest value connected with u."""
    several = edges.groupBy("u").count().filter("count > 1").select("u")
    inner = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return several.unionByName(inner).isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """u and root, the smallest value connected with u, for all ends of edges (a, b); by alternating large and small stars.

    Ends as soon as all edges lead to a root. Each round writes its edges to the shared folder. A round joins edges with
    one row per end, both freshly written, so that Spark can split a large star. Edges so few that they would be broadcast
    are joined by one task instead.
    """
    current = Scratch(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if rows:
            u, v = (np.concatenate(x) for x in zip(*rows, strict=True))
            ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = components(len(ends), at[: len(u)], at[len(u) :])
            some = np.flatnonzero(label != np.arange(len(ends)))
            yield pa.RecordBatch.from_arrays([pa.array(ends[some]), pa.array(ends[label[some]])], names=["u", "root"])

    if is_small(current.df):
        return written(current.df.repartition(1).mapInArrow(together, "u long, root long"), "roots")
    while not is_stars(current.df):
        both = current.df.unionByName(current.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Scratch(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.filter("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = Scratch(large, "large")
        least.drop()
        least = Scratch(large.df.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.df.join(least.df, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(joined.select("u", F.col("m").alias("v")))
        after = Scratch(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        for old in (current, large, least):
            old.drop()
        current = after
    return current.df.select("u", F.col("v").alias("root"))


def tree_links(distinct: DataFrame, radius: int = BITS) -> DataFrame:
    """Links (a, b) between the fingerprints fp of distinct, a written table, whose components are those of all links within
    radius: the tree deals them to shards, and of each connected set of a shard only links to one member leave the task."""
    total = distinct.count()
    sample = np.sort(np.array([r[0] for r in about(distinct.select("fp"), SAMPLE, total, "fp").collect()], np.int64).view(np.uint64))
    nodes = build_tree(sample, total, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("fp").to_numpy().astype(np.int64)
            rows, shard = route(x.view(np.uint64), nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(x[rows])], names=["shard", "fp"])

    def within(table: pa.Table) -> pa.Table:
        x = np.sort(table.column("fp").to_numpy())
        label = components(len(x), *links(x.view(np.uint64), radius))
        some = np.flatnonzero(label != np.arange(len(x)))
        return pa.table({"a": x[some], "b": x[label[some]]})

    return distinct.select("fp").mapInArrow(deal, "shard int, fp long").groupBy("shard").applyInArrow(within, "a long, b long")


def distinct_prints(prints: DataFrame) -> DataFrame:
    return written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")


def near_duplicates(prints: DataFrame, radius: int = BITS) -> DataFrame:
    """doc_id, fp and component_id of all rows of prints (doc_id, fp; a written table).

    Fingerprints are linked when at most `radius` bits differ; component_id is the smallest doc_id that can be reached,
    a null id counting as larger than any. Equal fingerprints are one from the start, so a group of copies costs one row.
    """
    distinct = distinct_prints(prints)
    return labelled(prints, distinct, connected(tree_links(distinct, radius)))


def labelled(prints: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, fp, component_id and first_fp (that of the row with this id) of all rows of prints. distinct: fp, first (the
    smallest doc_id) and n; roots: u and root, as connected has them, for the values of fp that are linked."""
    members = roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
    firsts = written(distinct.join(members, distinct["fp"] == members["u"]).groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("m")).select("root", "m.first", F.col("m.fp").alias("first_fp")), "firsts")
    of = members.join(firsts, "root").select(F.col("u").alias("fp"), F.col("first").alias("least"), "first_fp")
    known = distinct.join(of, "fp", "left").select("fp", "n", F.when(F.col("first_fp").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"), F.coalesce("first_fp", "fp").alias("first_fp"))
    known = written(known, "known")
    hot = max(100, int(prints.count() / 1000))  # at most 1000 fingerprints have so many rows
    often, names = F.broadcast(known.filter(F.col("n") >= hot).drop("n")), ("doc_id", "fp", "component_id", "first_fp")
    rest = prints.join(F.broadcast(known.filter(F.col("n") >= hot).select("fp")), "fp", "left_anti").join(known.filter(F.col("n") < hot).drop("n"), "fp")
    return prints.join(often, "fp").select(*names).unionByName(rest.select(*names))


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = BITS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row; null and empty texts have fingerprint zero.

    A bit that half of the hashes set is 0. Rows that repeat share a component, as do rows without an id by their texts;
    the smallest id that is there names it. An empty table gives no rows; other columns of docs, whatever their names, are
    never read.
    """
    found = near_duplicates(written(fingerprint_table(docs, shingle, seed, id_col, text_col), "prints"), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def hashes(text: str, shingle: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; fewer words are one shingle, none give none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - shingle + 1)].tolist()
    return np.array([digest(line[a:b], seed) for a, b in zip(begins, ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], np.uint64)


def majority(x: np.ndarray) -> int:
    """The fingerprint of a text with these hashes, as `fingerprints` has it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(x), TOGETHER):
        ones += np.unpackbits(x[at : at + TOGETHER].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(x), bitorder="little").view("<i8")[0])


def rarest(x: np.ndarray, frequent: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a text, in one order for all texts (frequent ones last), of which two texts of Jaccard
    similarity 0.8 share one at least: such texts have four fifths of either's shingles in common."""
    rank = np.zeros(len(x), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
        rank = np.where(frequent[at] == x, times[at], 0)
    return x[np.lexsort((x, rank))[: len(x) - (4 * len(x) + 4) // 5 + 1]]


def parity(x: np.ndarray) -> bytes:
    """Bits by the hashes of a set, each flipped once for each hash that falls to it; two to four bits a hash."""
    n = max(64, 1 << (2 * max(1, len(x)) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1 == 1, bitorder="little").tobytes()


def may_be_alike(x: pa.Scalar, y: pa.Scalar, size: int) -> bool:
    """Whether sets with `size` members together may have a Jaccard similarity of 0.8, by their parities: each member of one
    set alone flips one bit, and there are at most a ninth of `size` of them. Never false for sets that have it."""
    x, y = (np.frombuffer(b.as_buffer(), np.uint8) for b in (x, y))
    while len(x) != len(y):  # the longer one's halves together are what it would be at half its length
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= size


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 at least, in whole numbers."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


class Parities:
    """The parities of texts in order of size, for tests of one against many."""

    def __init__(self, parities: np.ndarray, size: np.ndarray):
        self.size, self.width = size, np.fromiter(map(len, parities), np.int64, len(parities))
        self.at, self.own, self.half = np.zeros(len(size), np.int64), {}, {}
        for w in np.unique(self.width).tolist():
            some = np.flatnonzero(self.width == w)
            self.at[some] = np.arange(len(some))
            self.own[w] = np.frombuffer(b"".join(parities[some]), np.uint8).reshape(-1, w)
            self.half[w] = self.own[w][:, : w // 2] ^ self.own[w][:, w // 2 :]  # as it would be at half the width

    def may_be_alike(self, k: int, others: np.ndarray) -> np.ndarray:
        """Which of the others, no smaller than the k-th and at most a quarter larger, may be alike with it."""
        w, ok = int(self.width[k]), np.ones(len(others), bool)
        mine = self.own[w][self.at[k]]
        for table, width in ((self.own, w), (self.half, 2 * w)):
            some = np.flatnonzero(self.width[others] == width)
            if len(some):
                flips = np.bitwise_count(table[width][self.at[others[some]]] ^ mine).sum(1, dtype=np.int64)
                ok[some] = 9 * flips <= self.size[k] + self.size[others[some]]
        return ok


def candidates(batches: Iterator[pa.RecordBatch], each: int, paired: int = PAIRED, parities: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs that share a shingle, from rows (shingle, size, node, place, root, next, before; with parities also parity) in that
    order; as FOUND. before: the text's shingle at the place before.

    Pairs already linked (equal roots), and those that by size and place can't reach 0.8, are left out, and so are those that
    share the shingle before too: they come, or have been left out, there. Where more than
    `paired` texts share a shingle, they are paired with later ones from number `next` on until there are `each` pairs a
    text; the shingle then comes back as open, with the number to go on from, unless the texts from there on are linked
    already. Of these pairs only those come that parities, where given, don't part. A pair that shares many shingles comes once from every WAITING found.
    """
    names = ["shingle", "size", "node", "place", "root", "next", "before"]
    held = [np.empty(0, np.int64)] * 7 + [np.empty(0, object)]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    n_waiting = 0

    def wait(pair: tuple[np.ndarray, np.ndarray]) -> None:
        nonlocal n_waiting
        waiting.append(pair)
        n_waiting += len(pair[0])

    def out(open_: list[tuple[int, int]], least: int = 0) -> pa.RecordBatch:
        nonlocal n_waiting
        ready = list(waiting) if n_waiting >= least else []
        if ready:
            waiting.clear()
            n_waiting = 0
        a, b = (np.concatenate([p[i] for p in ready] or [held[0][:0]]) for i in (0, 1))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        rest = np.array(open_, np.int64).reshape(-1, 2)
        n, m = len(both), len(rest)
        zero, none = np.zeros(n, np.int64), np.zeros(m, np.int64)
        columns = [np.concatenate([both[:, 0], none]), np.concatenate([both[:, 1], none]), np.concatenate([zero, rest[:, 0]]), np.concatenate([zero, rest[:, 1]]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.arange(n + m) >= n)], names=["a", "b", "shingle", "next", "open"])

    def matched(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, size, _, place, root, _, _, _ = rows
        common = np.minimum(size[i] - place[i], size[j] - place[j])  # at most, from this shingle on
        ok = (root[i] != root[j]) & (5 * size[i] >= 4 * size[j]) & (9 * common >= 4 * (size[i] + size[j]))
        return i[ok], j[ok]

    def fresh(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (rows[6][i] != rows[6][j]) | (rows[3][i] == 0) | (rows[3][j] == 0)
        return i[ok], j[ok]

    def done(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[2][1:] != rows[2][:-1])
        rows = [c[new] for c in rows]
        begins = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        sizes = np.diff(np.append(begins, len(rows[0])))
        open_ = []
        few = np.repeat(sizes <= paired, sizes)
        for d in range(1, paired):
            i = np.flatnonzero((rows[0][d:] == rows[0][:-d]) & few[d:])
            if not len(i):
                break
            i, j = fresh(rows, *matched(rows, i, i + d))
            wait((rows[2][i], rows[2][j]))
        for at, n in zip(begins[sizes > paired].tolist(), sizes[sizes > paired].tolist(), strict=True):
            k, made = int(rows[5][at]), 0
            test = Parities(rows[7][at : at + n], rows[1][at : at + n]) if parities else None
            ends = np.searchsorted(rows[1][at : at + n], 5 * rows[1][at : at + n] // 4, "right")
            while k < n - 1 and made < each * n:
                j = np.arange(at + k + 1, at + ends[k])
                i, j = matched(rows, np.full(len(j), at + k), j)
                made += len(j)
                i, j = fresh(rows, i, j)
                if test and len(j):
                    ok = test.may_be_alike(k, j - at)
                    i, j = i[ok], j[ok]
                wait((rows[2][i], rows[2][j]))
                k += 1
                if n_waiting > WAITING or len(waiting) > 10_000:
                    yield out([])
            if k < n - 1 and (rows[4][at + k : at + n] != rows[4][at + k]).any():
                open_.append((int(rows[0][at]), k))
        yield out(open_, WAITING)

    for b in batches:
        if not b.num_rows:
            continue
        rows = [np.concatenate([h, b.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, names, strict=False)]
        own = np.empty(b.num_rows, object)
        own[:] = b.column("parity").to_pylist() if parities else None
        rows.append(np.concatenate([held[7], own]))
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [c[last:] for c in rows]
        if last:
            yield from done([c[:last] for c in rows])
    if len(held[0]):
        yield from done(held)
    yield out([])


def plausible(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The different pairs (a, b) of nodes that may be alike by their parities. prints: node, size, parity."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_be_alike(x, y, n) for x, y, n in zip(b.column("x"), b.column("y"), b.column("n").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = Scratch(pairs.distinct(), "pairs")
    left, right = prints.toDF("a", "m", "x").hint("merge"), prints.toDF("b", "n", "y").hint("merge")
    both = pairs.df.join(left, "a").join(right, "b").select("a", "b", "x", "y", (F.col("m") + F.col("n")).alias("n"))
    found = written(both.mapInArrow(test, "a long, b long"), "plausible")
    pairs.drop()
    return found


def confirmed(texts: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' shingles have a Jaccard similarity of 0.8 at least. texts: node, text; prints: node,
    size and parity, one row a node. The shingles themselves meet for pairs alone that their parities don't tell apart."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            found = [np.unique(hashes(t)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.binary())], names=["node", "hashes"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = plausible(prints, pairs)
    wanted = Scratch(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    found = texts.join(small(wanted.df), "node", "left_semi").mapInArrow(sets, "node long, hashes binary")
    known = Scratch(found.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
    left, right = known.df.toDF("a", "x").hint("merge"), known.df.toDF("b", "y").hint("merge")
    links = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long"), "links")
    wanted.drop()
    known.drop()
    return links


def near_copies(docs: DataFrame, radius: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (a hash of the text), component_id and first_node of every row: texts are linked when the Jaccard similarity of their five-word shingles is 0.8 at least.

    Fingerprints of five words within `radius`, by the tree, are candidates first, so that crowds of very near copies are
    known before pairs are made. The bits of a link can't be bounded, so the others come from shingles: of the texts' rarest
    fifth two linked ones share one (`rarest`), whatever the order is. Every candidate is confirmed by all shingles. Rounds go
    on until no pair is left that could link two components. Equal texts are one node; null and empty texts are equal. Rows
    that share an id each count with their own text.
    """
    texts = two_columns(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("node"), "text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            for t in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(t)).view(np.int64))], names=["shingle"])

    total = texts.count()
    looked = about(texts, max(LEAST_LOOKED, total // ONE_OF), total, "node").select("text").mapInArrow(sample, "shingle long")
    counts = Scratch(looked.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT), "shingles")
    least, held = FREQUENT, 0
    for step, k in sorted(counts.df.groupBy(F.floor(8 * F.log2("n")).alias("step")).count().collect(), reverse=True):
        held += k
        if held > MOST:
            least = 2 ** ((step + 1) / 8)
            break
    often = counts.df.filter(F.col("n") >= least).toArrow()
    counts.drop()
    frequent, times = often.column("shingle").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(frequent)
    shared = texts.sparkSession.sparkContext.broadcast((frequent[order], times[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            own = [hashes(t) for t in b.column("text").to_pylist()]
            sets = [np.unique(x) for x in own]
            first = [rarest(x, *shared.value).view(np.int64) for x in sets]
            columns = [b.column("doc_id"), b.column("node"), pa.array([majority(x) for x in own], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([parity(x) for x in sets], pa.binary()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "size", "parity", "first"])

    prints = written(texts.mapInArrow(run, "doc_id long, node long, fp long, size int, parity binary, first array<long>"), "prints")
    texts = texts.select("node", "text")
    alone = prints.select("node").distinct().count() == total  # else rows with one text are one node
    sketches = prints.select("node", "size", "parity")
    sketches = sketches if alone else written(sketches.dropDuplicates(["node"]), "sketches")
    nodes = prints.select(F.col("node").alias("doc_id"), "fp")
    distinct = distinct_prints(nodes)
    first = distinct.select("fp", F.col("first").alias("node"))
    tree = tree_links(distinct, radius)
    pairs = tree.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = nodes.distinct().join(first, "fp").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = confirmed(texts, sketches, pairs.unionByName(same))
    roots, open_, each = connected(links), None, EACH
    firsts = prints.select("node", "size", "first")
    firsts = firsts if alone else written(firsts.dropDuplicates(["node"]), "firsts")
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("first", 1, F.greatest(F.size("first") - 1, F.lit(0))))

    def spread(rows: DataFrame, *more: str) -> DataFrame:
        each = F.posexplode(F.arrays_zip(F.col("first").alias("shingle"), before.alias("before"))).alias("place", "s")
        return rows.select("node", "size", *more, each).select("node", "size", *more, "place", "s.shingle", "s.before").filter("shingle is not null")

    while True:
        ends = roots.select(F.col("u").alias("node"), "root")
        columns = ["shingle", "size", "node", "place", "root", "next", "before"]
        if open_ is None:
            known = spread(firsts.join(small(ends), "node", "left"), "root").withColumn("next", F.lit(0))
        else:
            known = spread(firsts).join(small(open_), "shingle").join(ends, "node", "left").join(sketches.select("node", "parity"), "node")
            columns = [*columns, "parity"]
        known = known.withColumn("root", F.coalesce("root", "node"))
        dealt = known.repartition("shingle").sortWithinPartitions("shingle", "size", "node").select(*columns)
        found = written(dealt.mapInArrow(lambda batches, each=each, paired=PAIRED, parities=open_ is not None: candidates(batches, each, paired, parities), FOUND), "candidates")
        new = confirmed(texts, sketches, found.filter("not open").select("a", "b"))
        if not new.isEmpty():
            roots = connected(new.unionByName(roots.select(F.col("u").alias("a"), F.col("root").alias("b"))))
        open_ = found.filter("open").select("shingle", "next")
        if open_.isEmpty():
            break
        each *= GROWTH
    by_node = prints.select("doc_id", F.col("node").alias("fp"))
    return labelled(by_node, distinct_prints(by_node), roots).select("doc_id", F.col("fp").alias("node"), "component_id", F.col("first_fp").alias("first_node"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id, of several with this id the one whose
    text's hash is smallest. All columns stay.

    Rows go by id and text, so documents that share an id, or have none, are judged each by its own text; rows that repeat
    both stay together. Null and empty texts are copies of each other alone. What goes is broadcast while it is little, so
    that no text moves.
    """
    found = written(near_copies(docs, **how), "groups")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("first_node"))
    gone = written(found.filter(~stays).select(F.col("doc_id").alias("_gone"), F.col("node").alias("_node")).distinct(), "gone")
    node = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(small(gone), docs["doc_id"].eqNullSafe(gone["_gone"]) & (node == gone["_node"]), "left_anti")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """simhash_dedup over all documents; odd rows as told there."""
    return simhash_dedup(documents(spark, sf_dir))
