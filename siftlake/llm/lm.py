"""LM scoring: a log-bilinear model over word classes, trained by noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Scratch, about, documents, remainder, text_slices, two_columns, written

#: Folds of the split by crc32(doc_id); documents of fold HELD_OUT are never learned from.
FOLDS, HELD_OUT = 10, 0
#: Words with a class of their own; bins of the other words, by their last two bytes; numbers in a class's vector.
OWN, BINS, DIM = 1200, 320, 32
#: Words whose counts every task holds, about; the counts of all others come by a join.
HEAD = 100_000
#: What a seen word of a bin gives up for unseen ones.
DISCOUNT = 0.5
#: Noise classes drawn for each batch, places in a batch, step size, and the step size of the pass over everything.
NOISE, BATCH, STEP, LATER_STEP = 64, 8192, 0.1, 0.03
#: Words, about, that the starting point is fitted to, and how often. The pass after it covers all.
FIRST_WORDS, EPOCHS = 1_000_000, 3
#: Words of a shard in that pass, about; a shard is one task and one model.
SHARD = 3_000_000
#: Words in a task's counter before it is sent, and models that are averaged together.
COUNTER, TOGETHER = 300_000, 32
END = 0  # the class of a text's end, and of what stands before its first word


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def bin_of(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-2:]) % BINS


class Vocabulary:
    """What tasks know of the words: the most frequent ones with their counts, the classes and the bins' totals.

    Its size is bounded by HEAD and BINS, whatever the corpus.
    """

    def __init__(self, head: list[tuple[bytes, int]], bins: dict[int, tuple[int, int]], n_docs: int, n_words: int, n_types: int):
        self.total = n_docs + n_words  # N, with the ends
        self.types = n_types + (n_docs > 0)  # V
        self.n_docs = n_docs
        self.floor = self.total + 0.1 * (self.types + 1)
        self.words = {w: i for i, (w, _) in enumerate(head)}
        counts = np.array([c for _, c in head], np.float64)
        own = min(OWN, len(head))
        self.classes = np.array([1 + i if i < own else bin_of(w) for i, (w, _) in enumerate(head)], np.int64)
        mass, kinds = np.zeros(1 + OWN + BINS), np.zeros(1 + OWN + BINS)
        mass[END] = n_docs
        mass[1 : 1 + own] = counts[:own]
        for b, (c, n) in bins.items():
            mass[b], kinds[b] = c, n
        for w, c in head[:own]:
            mass[bin_of(w)] -= c
            kinds[bin_of(w)] -= 1
        self.mass = mass
        self.noise = (mass + 0.5) / (mass + 0.5).sum()
        held = mass[1 + OWN :]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.unseen = np.where(held > 0, np.log10(DISCOUNT * kinds[1 + OWN :] / held), 0.0)
            inside = np.log10((counts - DISCOUNT) / mass[self.classes]) if len(head) else np.zeros(0)
        self.inside = np.where(np.arange(len(head)) < own, 0.0, inside)  # log10 of the share in its class
        self.base = np.log10((counts + 0.1) / self.floor) if len(head) else np.zeros(0)
        self.base_end = float(np.log10((n_docs + 0.1) / self.floor))
        self.base_unseen = float(np.log10(0.1 / self.floor))

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index among the head or -1, class) of each word."""
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        kind = self.classes[at] if len(self.classes) else np.zeros(len(words), np.int64)
        for i in np.flatnonzero(at < 0):
            kind[i] = bin_of(words[i])
        return at, kind


def contexts(kinds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each place of texts that stand one after the other, each with its end."""
    one = np.concatenate([[END], kinds[:-1]])
    two = np.concatenate([[END, END], kinds[:-2]])[: len(kinds)]
    first = np.cumsum(sizes) - sizes
    one[first], two[first] = END, END
    return one, two


class Bilinear:
    """s(w | u, v) = (r_u A + r_v B) . r_w + b_w for the classes u and v one and two places before w."""

    def __init__(self, noise: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = len(noise)
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.chances = np.cumsum(noise)
        self.parts = {
            "r": (rng.standard_normal((n, DIM)) * 0.1).astype(np.float32),
            "b": np.log(noise).astype(np.float32),
            "a": (np.eye(DIM) * 0.5).astype(np.float32),
            "c": (np.eye(DIM) * 0.3).astype(np.float32),
        }
        self.squares = {k: np.full_like(x, 1.0) for k, x in self.parts.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.parts.items():
            self.parts[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def resume(self, start: dict[int, np.ndarray]) -> None:
        """Goes on from what a fit has left: its parameters (0) and their sums of squares (1); nothing if it saw no text."""
        if start:
            self.load(start[1])
            self.squares = {k: x.copy() for k, x in self.parts.items()}
            self.load(start[0])

    @staticmethod
    def _gathered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Sums of values by row."""
        order = np.argsort(rows)
        ordered = rows[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        out = np.zeros((n, values.shape[1]), np.float32)
        out[ordered[heads]] = np.add.reduceat(values[order], heads, axis=0)
        return out

    def learn(self, w: np.ndarray, u: np.ndarray, v: np.ndarray, rng: np.random.Generator, step: float) -> None:
        """One batch of noise-contrastive estimation, ascending with Adagrad; the noise classes are shared by the batch."""
        r, b, a, c = (self.parts[k] for k in "rbac")
        ra, rc = r @ a, r @ c
        q = ra[u] + rc[v]
        k = np.searchsorted(self.chances, rng.random(NOISE) * self.chances[-1]).clip(0, len(b) - 1)
        true = np.einsum("ij,ij->i", q, r[w]) + b[w] - self.log_noise[w]
        false = q @ r[k].T + (b[k] - self.log_noise[k])
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        dq = up[:, None] * r[w] + down @ r[k]
        dr = self._gathered(w, np.concatenate([up[:, None] * q, up[:, None]], 1), len(b))
        db, dr = dr[:, -1], dr[:, :-1].copy()
        np.add.at(dr, k, down.T @ q)
        np.add.at(db, k, down.sum(0))
        du, dv = self._gathered(u, dq, len(b)), self._gathered(v, dq, len(b))
        dr += du @ a.T + dv @ c.T
        for name, g in (("r", dr), ("b", db), ("a", r.T @ du), ("c", r.T @ dv)):
            self.squares[name] += g * g
            self.parts[name] += step * g / np.sqrt(self.squares[name])

    def train(self, kinds: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, step: float) -> None:
        u, v = contexts(kinds, sizes)
        order = rng.permutation(len(kinds))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            self.learn(kinds[own], u[own], v[own], rng, step)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores of w after u, scores of w after v, log of the sum over w for each u and v).

        The score is a sum over the two places, so the sums over all classes are one matrix product.
        """
        r, b, a, c = (self.parts[k].astype(np.float64) for k in "rbac")
        one, two = r @ a @ r.T + b, r @ c @ r.T
        top1, top2 = one.max(1), two.max(1)
        z = np.exp(one - top1[:, None]).astype(np.float32) @ np.exp(two - top2[:, None]).astype(np.float32).T
        return one.astype(np.float32), two.astype(np.float32), (np.log(np.maximum(z, 1e-30)) + top1[:, None] + top2[None, :]).astype(np.float32)


def text_classes(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all texts with their ends, how many each text has)."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(x) + 1 for x in words], np.int64)
    _, kind = vocabulary.look([w for x in words for w in x])
    out = np.full(int(sizes.sum()), END, np.int64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = kind
    return out, sizes


def count_words(rows: DataFrame) -> DataFrame:
    """token, c over all rows' texts; each task sends what it has counted, so a frequent word costs a row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["token", "c"])

        for b in text_slices(batches, 1 << 20):
            for t in b.column("text").to_pylist():
                counts.update(words_of(t))
            if len(counts) > COUNTER:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    return rows.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def vocabulary_of(counts: DataFrame, n_docs: int) -> Vocabulary:
    n_words, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The most frequent words are those above a count, from a histogram of logarithms, so nothing is sorted; of those in
    # the last bucket that has room for some only, the ones with a small hash.
    step, chosen, held = F.floor(8 * F.log2("c")), F.lit(True), 0
    for b, n in sorted(counts.groupBy(step).count().collect(), reverse=True):
        if held + n > HEAD:
            chosen = (step > b) | (step == b) & (F.pmod(F.xxhash64("token"), F.lit(1 << 32)) < int((1 << 32) * (HEAD - held) / n))
            break
        held += n
    head = sorted(((bytes(r[0]), r[1]) for r in counts.filter(chosen).select("token", "c").collect()), key=lambda x: (-x[1], x[0]))
    bins = counts.groupBy((F.crc32(F.expr("substring(token, -2, 2)")) % BINS + 1 + OWN).alias("b")).agg(F.sum("c"), F.count("*")).collect()
    return Vocabulary(head, {r[0]: (r[1], r[2]) for r in bins}, n_docs, n_words, n_types)


def coded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """h, a hash of the row, and its text's classes with the end."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            kinds, sizes = text_classes(b.column("text").to_pylist(), shared.value)
            ends = np.concatenate([[0], np.cumsum(2 * sizes)])
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(kinds.astype("<u2").tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("h"), raw.cast(pa.binary())], names=["h", "kinds"])

    return rows.select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(run, "h long, kinds binary")


def classes_of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes, sizes) of a batch's texts, some at a time."""
    kinds, sizes, held = [], [], 0
    for x in b.column("kinds"):
        kinds.append(np.frombuffer(x.as_buffer(), "<u2"))
        sizes.append(len(kinds[-1]))
        held += sizes[-1]
        if held > 300_000:
            yield np.concatenate(kinds).astype(np.int64), np.array(sizes)
            kinds, sizes, held = [], [], 0
    if kinds:
        yield np.concatenate(kinds).astype(np.int64), np.array(sizes)


def train(rows: DataFrame, vocabulary: Vocabulary) -> Bilinear:
    """Fits a starting point to a sample bounded by its words, a part of it after the other, then makes one pass over all rows: they are dealt to shards by a hash, each
    shard learns from its own texts from there on, and the shards' models are averaged, weighted by their places, in a tree of
    groups of TOGETHER. Sample, shards, order and seeds follow from the rows alone, so that the files they lie in don't matter."""
    model, context = Bilinear(vocabulary.noise), rows.sparkSession.sparkContext
    if not vocabulary.total:
        return model
    texts = coded(rows, vocabulary)
    kinds_of = "at long, n double, parts binary"

    def result(at: int, n: int, own: Bilinear) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([float(n)]), pa.array([own.flat().astype("<f4").tobytes()], pa.binary())], names=["at", "n", "parts"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rng = Bilinear(noise.value), np.random.default_rng(3)
        n = 0
        for b in batches:
            for kinds, sizes in classes_of(b):
                for _ in range(EPOCHS):
                    own.train(kinds, sizes, rng, STEP)
                n += len(kinds)
        if n:
            squares = np.concatenate([own.squares[k].ravel() for k in own.parts])
            yield result(0, 0, own)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([0.0]), pa.array([squares.astype("<f4").tobytes()], pa.binary())], names=["at", "n", "parts"])

    noise = context.broadcast(vocabulary.noise)
    some = coded(about(rows, FIRST_WORDS, vocabulary.total, "doc_id"), vocabulary)
    start = {r.at: np.frombuffer(r.parts, "<f4") for r in some.repartition(1).sortWithinPartitions("h").mapInArrow(first, kinds_of).collect()}
    shards = max(1, -(-vocabulary.total // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, n = Bilinear(noise.value), TaskContext.get().partitionId(), 0
        own.resume(begun.value)
        rng = np.random.default_rng(shard)
        for b in batches:
            for kinds, sizes in classes_of(b):
                own.train(kinds, sizes, rng, LATER_STEP)
                n += len(kinds)
        if n:
            yield result(shard, n, own)

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n = table.column("n").to_numpy()
        total = sum(w * np.frombuffer(p, "<f4").astype(np.float64) for w, p in zip(n, table.column("parts").to_pylist(), strict=True))
        return pa.table({"at": pa.array([table.column("at")[0].as_py()], pa.int64()), "n": pa.array([float(n.sum())]), "parts": pa.array([(total / n.sum()).astype("<f4").tobytes()], pa.binary())})

    begun = context.broadcast(start)
    found = written(texts.repartition(shards, "h").sortWithinPartitions("h").mapInArrow(run, kinds_of), "lm-parts")
    left = (found.agg(F.max("at")).first()[0] or 0) + 1
    while left > TOGETHER:
        found = found.withColumn("at", F.floor(F.col("at") / TOGETHER)).groupBy("at").applyInArrow(mean, kinds_of)
        left = -(-left // TOGETHER)
    last = found.toArrow()
    if last.num_rows:
        model.load(np.frombuffer(mean(last).column("parts")[0].as_py(), "<f4"))
    return model


_TABLES: dict[int, tuple] = {}


def score_documents(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Bilinear) -> DataFrame:
    """The rows of lm_scores. Tasks score all places with the model; what depends on the count of a word outside the
    head comes by a join of those words with the counts, so that no task holds more than the head."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    token = zlib.crc32(model.flat().tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = shared.value
        if token not in _TABLES:
            _TABLES.clear()
            _TABLES[token] = own.tables()
        one, two, z = _TABLES[token]
        n_classes = len(z)
        row = TaskContext.get().partitionId() << 34
        for b in text_slices(batches, 2 << 20):
            words = [words_of(t) for t in b.column("text").to_pylist()]
            sizes = np.array([len(x) for x in words], np.int64)
            flat = [w for x in words for w in x]
            at, kind = known.look(flat)
            kinds = np.full(len(flat) + len(words), END, np.int64)
            inner = np.ones(len(kinds), bool)
            ends = np.cumsum(sizes + 1) - 1
            inner[ends] = False
            kinds[inner] = kind
            u, v = contexts(kinds, sizes + 1)
            u *= n_classes
            logs = (one.ravel()[u + kinds] + two.ravel()[v * n_classes + kinds] - z.ravel()[u + v]).astype(np.float64) / np.log(10)
            logs[inner] += np.where(at >= 0, known.inside[at], 0.0) if len(known.inside) else 0.0
            base = np.full(len(kinds), known.base_end)
            base[inner] = np.where(at >= 0, known.base[at], 0.0) if len(known.base) else 0.0
            seen = np.full(len(kinds), known.n_docs > 0, np.int64)
            seen[inner] = at >= 0
            first = ends - sizes
            total = lambda x: pa.array(np.add.reduceat(x, first))
            keys = row + np.arange(len(words))
            row += len(words)
            tail = np.flatnonzero(at < 0)
            often = Counter(zip(np.repeat(keys, sizes)[tail].tolist(), (flat[i] for i in tail.tolist()), strict=True))
            names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "token"]
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("doc_id"), b.column("held_out"), pa.array(sizes + 1), total(seen), total(base), total(logs), pa.nulls(len(words), pa.binary())], names=names)
            if often:
                empty = lambda kind: pa.nulls(len(often), kind)
                key, word = zip(*often, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), empty(pa.int64()), empty(pa.bool_()), pa.array(list(often.values()), pa.int64()), empty(pa.int64()), empty(pa.float64()), empty(pa.float64()), pa.array(word, pa.binary())], names=names)

    rows = two_columns(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(FOLDS) == HELD_OUT).alias("held_out"), "text")
    made = written(rows.mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, token binary"), "lm-scores")
    whole = made.filter("token is null").drop("token")
    bins = [(1 + OWN + i, float(m), float(u)) for i, (m, u) in enumerate(zip(vocabulary.mass[1 + OWN :], vocabulary.unseen, strict=True))]
    bins = F.broadcast(docs.sparkSession.createDataFrame(bins, "b int, mass double, unseen double"))
    tail = made.filter("token is not null").select("key", F.col("n_tokens").alias("n"), "token").join(counts, "token", "left")
    tail = tail.withColumn("b", (F.crc32(F.expr("substring(token, -2, 2)")) % BINS + 1 + OWN).cast("int")).join(bins, "b")
    base = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / float(vocabulary.floor))
    inside = F.when(F.col("c").isNull(), F.col("unseen")).otherwise(F.log10((F.col("c") - DISCOUNT) / F.col("mass")))
    parts = tail.groupBy("key").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).cast("long").alias("n_known"), F.sum(F.col("n") * base).alias("base"), F.sum(F.col("n") * inside).alias("score"))
    both = whole.unionByName(parts, allowMissingColumns=True).groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return both.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    base_score is that of smoothed unigram counts, score the model's log10 probability of the whole text with its end. Null
    and empty texts have the end alone. Counts and the model come from the rows outside the held-out fold; repeated rows
    count as often as they stand. Without such rows all words are unknown and the classes' noise weights remain.
    Words of equal counts are ordered by their bytes. An empty table gives no rows; other columns are never read.
    """
    docs = two_columns(docs, id_col, text_col)
    learned = docs.filter(remainder(FOLDS) != HELD_OUT)
    counts = Scratch(count_words(learned), "lm-counts").df
    vocabulary = vocabulary_of(counts, learned.count())
    return score_documents(docs, counts, vocabulary, train(learned, vocabulary))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """lm_scores over all documents; odd rows as told there."""
    return lm_scores(documents(spark, sf_dir))
