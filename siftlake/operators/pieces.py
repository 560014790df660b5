"""Token-level sparse vectors: texts become pieces of a model's vocabulary, pieces words again, words weighted terms.

Pieces come from a unigram segmentation: of all ways to cut a word into known pieces, the one with the largest sum of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.codecs import term_id
from siftlake.operators.sparse import STOPWORDS, last_of_equal
from siftlake.scratch import dealt

#: What a text is cut into before the vocabulary: words, and any other sign by itself.
RUN = regex.compile(r"[\p{L}\p{M}]+|[^\p{L}\p{M}\x09-\x0D\x20]")
#: Words of a batch that are segmented together, and how many are remembered.
TOGETHER, REMEMBERED = 4096, 200_000
#: The marks that a piece which begins a word has, and tokens that stand for no text.
MARKS = {"arctic": "▁", "e5": "▁", "jina": "Ġ"}
SPECIAL = ("<s>", "</s>", "<pad>", "<unk>")
#: Below any sum of scores.
NEVER = -(1 << 60)


class DoubleArray:
    """A trie of strings in two arrays: from a node, a character of code c leads to base[node] + c, if check there names the node."""

    def __init__(self, strings: list[str]):
        self.codes = {c: i + 1 for i, c in enumerate(sorted({c for s in strings for c in s}))}
        width = len(self.codes) + 1
        self.base, self.check, self.value = np.zeros(2, np.int32), np.full(2, -1, np.int32), np.full(2, -1, np.int32)
        self._used = 1
        level: dict[int, list[tuple[str, int]]] = {0: [(s, i) for i, s in enumerate(strings)]}
        depth = 0
        while level:
            below: dict[int, list[tuple[str, int]]] = {}
            for node, held in level.items():
                children: dict[int, list[tuple[str, int]]] = {}
                for s, i in held:
                    if len(s) == depth:
                        self.value[node] = i
                    else:
                        children.setdefault(self.codes[s[depth]], []).append((s, i))
                if children:
                    codes = np.array(sorted(children), np.int32)
                    at = self._place(codes, width)
                    self.base[node] = at
                    self.check[at + codes] = node
                    below |= {int(at + c): children[int(c)] for c in codes}
            level, depth = below, depth + 1
        self.depth = depth - 1
        # A step off the end lands on slots that no node owns.
        self._grow(int(self.base.max()) + width + 1)

    def _grow(self, size: int) -> None:
        more = max(0, size - len(self.base))
        self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
        self.value = np.concatenate([self.value, np.full(more, -1, np.int32)])

    def _place(self, codes: np.ndarray, width: int) -> int:
        """The first place where slots for all codes are free: all free slots are tried for the first code at once."""
        self._grow(self._used + 2 * width + 2)
        free = np.flatnonzero(self.check[1 : self._used + width + 1] < 0) + 1
        places = free[free >= codes[0] + 1] - codes[0]
        for c in codes[1:]:
            places = places[self.check[places + c] < 0]
        at = int(places[0])
        self._used = max(self._used, at + int(codes[-1]) + 1)
        return at

    def steps(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where each node's character leads, -1 for nowhere; -1 stays."""
        to = self.base[np.maximum(nodes, 0)] + codes
        return np.where((nodes >= 0) & (codes > 0) & (self.check[to] == nodes), to, -1)


class Unigram:
    """Segmentation by a vocabulary with whole-number scores. A character that no piece has is a piece with score `unknown`;
    of equal sums the one whose last piece is longer counts, at each place."""

    def __init__(self, pieces: list[str], scores: list[int], unknown: int):
        self.trie, self.scores, self.unknown = DoubleArray(pieces), np.array(scores, np.int64), unknown

    def segment(self, words: list[str]) -> list[list[str]]:
        """The pieces of each word. All words of about one length go through the trie together, place by place."""
        out: list[list[str]] = [[] for _ in words]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(max(3, len(w).bit_length()), []).append(i)
        for rows in by_size.values():
            for at in range(0, len(rows), TOGETHER):
                some = rows[at : at + TOGETHER]
                for i, cuts in zip(some, self._cuts([words[i] for i in some]), strict=True):
                    out[i] = [words[i][a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _cuts(self, words: list[str]) -> Iterator[list[int]]:
        codes, n = self.trie.codes, len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        longest, deep = int(size.max(initial=0)), self.trie.depth
        text = np.zeros((longest + deep + 1, n), np.int32)
        for i, w in enumerate(words):
            text[: len(w), i] = [codes.get(c, 0) for c in w]
        best, taken = np.full((longest + deep + 2, n), NEVER, np.int64), np.zeros((longest + deep + 2, n), np.int32)
        best[0] = 0
        for i in range(longest):
            node = np.zeros(n, np.int64)
            for k in range(1, deep + 1):
                node = self.trie.steps(node, text[i + k - 1])
                piece = np.where(node >= 0, self.trie.value[np.maximum(node, 0)], -1)
                score = np.where(piece >= 0, self.scores[np.maximum(piece, 0)], self.unknown if k == 1 else NEVER)
                total = best[i] + score
                better = (score > NEVER) & (total > best[i + k])  # a longer last piece came from an earlier place, so before
                best[i + k], taken[i + k] = np.where(better, total, best[i + k]), np.where(better, k, taken[i + k])
                if not (node >= 0).any():
                    break
        for i, s in enumerate(size.tolist()):
            cuts = [s]
            while cuts[-1]:
                cuts.append(cuts[-1] - int(taken[cuts[-1], i]))
            yield cuts[::-1]


def piece_lists(model: Unigram, mark: str):
    """A column function of texts to their pieces in order; a piece that begins a run has the mark. Null stays null."""

    @F.arrow_udf("array<string>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[str]] = {}
        for texts in columns:
            runs = [None if t is None else RUN.findall(t) for t in texts.to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            new = list({w for r in runs if r for w in r} - known.keys())
            for w, p in zip(new, model.segment(new), strict=True):
                known[w] = [mark + p[0], *p[1:]]
            yield pa.array([None if r is None else [p for w in r for p in known[w]] for r in runs], pa.list_(pa.string()))

    return run


def words_of_pieces(pieces: DataFrame, keys: list[str], mark: str, root: bool) -> DataFrame:
    """keys, word_no, word, weight from pieces (keys, pos, piece, weight).

    Special tokens go. A piece of one character or with the mark begins a word, and so does a row's first; others go on with
    the word before, whose weight is the sum of its pieces' or, with root, the root of the sum of their squares. Words are
    found by a running count of beginnings, so the work grows with the pieces. Weights are decimals: sums don't depend on
    the order of rows.
    """
    kept = pieces.filter(~F.col("piece").isin(*SPECIAL))
    order = Window.partitionBy(*keys).orderBy("pos")
    begins = F.col("piece").startswith(mark) | (F.length("piece") == 1)
    kept = kept.withColumn("word_no", F.sum(F.when(begins, 1).otherwise(0)).over(order))
    bare = F.when(F.col("piece").startswith(mark) & (F.length("piece") > 1), F.substring("piece", 2, 1 << 20)).otherwise(F.col("piece"))
    kept = kept.select(*keys, "word_no", "pos", bare.alias("bare"), F.col("weight").cast("decimal(18,6)").alias("weight"))
    total = F.sqrt(F.sum(F.col("weight") * F.col("weight")).cast("double")).cast("decimal(18,6)") if root else F.sum("weight").cast("decimal(18,6)")
    parts = F.array_sort(F.collect_list(F.struct("pos", "bare")))
    return kept.groupBy(*keys, "word_no").agg(F.array_join(parts["bare"], "").alias("word"), total.alias("weight"))


def lexical_vectors(words: DataFrame, keys: list[str], stop: list[str] | None = None) -> DataFrame:
    """keys, term, term_id, weight: lower-case words without stop words, punctuation and weights of nothing or less; the weights
    of a term add up, all of a row to 1. Of terms of a row that share an id the last in order stays."""
    lower = words.select(*keys, F.lower("word").alias("term"), "weight").filter("weight > 0")
    some = lower.filter(F.col("term").rlike(r"[\p{L}\p{M}\p{N}]") & ~F.col("term").isin(STOPWORDS if stop is None else stop))
    sums = some.groupBy(*keys, "term").agg(F.sum("weight").alias("s"))
    share = F.col("s").cast("double") / F.sum("s").over(Window.partitionBy(*keys)).cast("double")
    found = sums.select(*keys, "term", share.alias("weight"))
    return last_of_equal(found.withColumn("term_id", term_id("term")), keys, "term", "term_id")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(text: Column) -> list[Column]:
    """How often a to z stand in a text: the token vector of the stand-in models. Plain sums over these stay in generated code."""
    low = F.lower(text)
    return [(F.length(low) - F.length(F.replace(low, F.lit(c)))).cast("double") for c in LETTERS]


def dot(x: list[Column], y: list[Column]) -> Column:
    return sum((a * b for a, b in zip(x[1:], y[1:], strict=True)), x[0] * y[0])


def cosine(product: Column, x: Column, y: Column) -> Column:
    """From a product and both squared lengths; 0 where one has no length."""
    return F.when(x * y > 0, product / F.sqrt(x * y)).otherwise(0.0)


@dataclass(frozen=True)
class Variant:
    """How a kind of model weighs pieces and adds them up. weights: of pieces (keys, pos, piece, whole) a table with weight too;
    whole, a text's letter counts, is there only if asked for."""

    mark: str
    root: bool
    weights: Callable[[DataFrame, dict[str, int], int], DataFrame]
    whole: bool = False


def by_score(pieces: DataFrame, scores: dict[str, int], unknown: int) -> DataFrame:
    """The model gives each token a weight of its own; here its information, the score with its sign turned."""
    known = pieces.sparkSession.createDataFrame([(k, -v) for k, v in scores.items()], "bare string, weight long")
    met = pieces.withColumn("bare", F.regexp_replace("piece", f"^{MARKS['arctic']}", "")).join(F.broadcast(known), "bare", "left")
    return met.withColumn("weight", F.coalesce("weight", F.lit(-unknown))).drop("bare")


def by_delimiter(pieces: DataFrame, scores: dict[str, int], unknown: int) -> DataFrame:
    """A token's weight is its product with the delimiter's vector, here one with all letters alike."""
    own = letter_counts(F.col("piece"))
    met = pieces.select("*", sum(own[1:], own[0]).alias("_p"), dot(own, own).alias("_x"))
    return met.withColumn("weight", cosine(F.col("_p"), F.col("_x"), F.lit(float(len(LETTERS))))).drop("_p", "_x")


def by_text(pieces: DataFrame, scores: dict[str, int], unknown: int) -> DataFrame:
    """A token's weight is its product with the vector of the whole text."""
    own, whole = letter_counts(F.col("piece")), [F.col("whole")[i] for i in range(len(LETTERS))]
    met = pieces.select("*", dot(own, whole).alias("_p"), dot(own, own).alias("_x"), dot(whole, whole).alias("_y"))
    return met.withColumn("weight", cosine(F.col("_p"), F.col("_x"), F.col("_y"))).drop("_p", "_x", "_y", "whole")


#: A model without an entry has no sparse vectors.
VARIANTS = {"arctic": Variant(MARKS["arctic"], False, by_score), "e5": Variant(MARKS["e5"], False, by_delimiter), "jina": Variant(MARKS["jina"], True, by_text, True)}


def sparse_vectors(rows: DataFrame, keys: list[str], model: str, vocabulary: DataFrame, unknown: int, text: str = "text") -> DataFrame:
    """keys, term, term_id, weight of each text's terms by a model's own rule; a model without sparse vectors gives no rows.

    vocabulary: piece, score (whole numbers), a model's fixed table, which every task gets whole; `unknown` is the score of
    a character without a piece. keys tell rows apart. A null or empty text has no terms.
    """
    if model not in VARIANTS:
        none = rows.select(*keys, F.lit("").alias("term"), F.lit(0).cast("long").alias("term_id"), F.lit(0.0).alias("weight"))
        return none.filter(F.lit(False))
    variant = VARIANTS[model]
    held = sorted((r.piece, r.score) for r in vocabulary.collect())
    scores = dict(held)
    found = piece_lists(Unigram([p for p, _ in held], [s for _, s in held], unknown), variant.mark)
    # Dealt by their keys between the model and the rows: behind it Spark forgets how rows are dealt and would shuffle the
    # pieces, joined to few tasks; windows and sums of a text need no shuffle then.
    whole = [F.array(*letter_counts(F.col(text))).alias("whole")] if variant.whole else []
    texts = dealt(rows.select(*keys, text, *whole, found(F.col(text)).alias("found")), *keys, text=text)
    cut = texts.select(*keys, *(["whole"] if whole else []), F.posexplode("found").alias("pos", "piece"))
    return lexical_vectors(words_of_pieces(variant.weights(cut, scores, unknown), keys, variant.mark, variant.root), keys)


def vectors(terms: DataFrame, keys: list[str], name: str = "sparse") -> DataFrame:
    """keys and a map of term ids to weights."""
    return terms.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term_id", F.col("weight").cast("float"))))).alias(name))
