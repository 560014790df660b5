"""Toxicity by weak supervision: voters, a generative label model with correlations, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import about, documents, remainder, text_slices, two_columns, written

#: Folds of the split by crc32(doc_id); labels of fold HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2
#: Labelled rows that voters, label model and classifier are fitted to, about, if there are more: those whose id has
#: a small hash.
LABELLED = 20_000
#: Terms that become voters, at most; labelled toxic texts that a term must stand in; the least logarithm of
#: its odds ratio, and how many standard errors that must be.
TERMS, LEAST_TEXTS, LEAST_ODDS, LEAST_Z = 400, 5, 2.5, 3.6
#: The best terms that the driver sees, at most, before a choice that covers all toxic texts, each by COVER voters.
CANDIDATES, COVER = 3000, 3
#: Lengths of the beginnings and ends of words that can be terms.
AFFIXES = (4, 5, 6)
#: Rounds of the label model, how much the labelled shares weigh in it, and the classifier's penalty.
ROUNDS, PRIOR, PENALTY = 8, 0.5, 0.3
#: Score from which a text is predicted toxic.
THRESHOLD = 0.3
#: Words of insult, a lexicon that needs no labels.
INSULTS = frozenset("idiot idiots moron morons stupid pathetic worthless disgusting trash scum loser losers clown dumb imbecile jerk vermin filthy freak bastard".split())
#: Voters besides the terms, in this order.
PATTERNS = ("insult", "two insults", "shouting", "exclaiming", "addressed")
WORD = re.compile(r"[^\W\d_]+")
ADDRESS = re.compile(r"\byou(?:'re| are)?(?: \w+){0,2} (?:" + "|".join(sorted(INSULTS)) + r")\b")
MEMO = 300_000


def terms_of(word: str) -> list[str]:
    """The word, its beginnings and its ends, marked with a hyphen where the word goes on."""
    return [word, *(f"{word[:n]}-" for n in AFFIXES if len(word) > n), *(f"-{word[-n:]}" for n in AFFIXES if len(word) > n)]


def patterns_of(text: str, low: str, words: set[str]) -> list[int]:
    """Which of PATTERNS vote."""
    insults = len(words & INSULTS)
    found = [0] if insults else []
    if insults > 1:
        found.append(1)
    if len(text) >= 20 and not any(map(str.islower, text[:200])) and text.isupper():
        found.append(2)
    if low.count("!") * 50 > len(low):
        found.append(3)
    if insults and ADDRESS.search(low):
        found.append(4)
    return found


class Voters:
    """Turns texts into the numbers of the voters that vote for toxic; the others abstain."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.number = {t: len(PATTERNS) + i for i, t in enumerate(terms)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def __len__(self) -> int:
        return len(PATTERNS) + len(self.terms)

    def votes(self, text: str) -> list[int]:
        low = text.lower()
        words, memo, out = set(WORD.findall(low)), self.memo, set()
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            own = memo.get(w)
            if own is None:
                number = self.number
                own = tuple(number[t] for t in terms_of(w) if t in number)
                if len(w) <= 40:
                    memo[w] = own
            if own:
                out.update(own)
        out.update(patterns_of(text, low, words))
        return sorted(out)


def label_model(votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Posterior of toxic for each row of votes (rows by voters, 0 or 1).

    Each voter votes with one chance in toxic and another in other texts (its accuracies); they begin at the labelled
    shares, which weigh as a prior, and are estimated by expectation maximisation over the votes: no text's own label is
    looked at. A voter that abstains says nothing; one more voter votes where all others abstain. What voters have in common beyond the class is measured by the
    correlations of their residuals, and a voter's evidence is divided by the squared correlations it shares, so that two
    beginnings of one word don't count twice.
    """
    n = len(labels)
    votes = np.concatenate([votes, votes.sum(1, keepdims=True) == 0], 1).astype(float)
    base = np.clip(labels.mean() if n else 0.05, 0.005, 0.995)
    shares = [(votes[labels == y].sum(0) + 0.05) / ((labels == y).sum() + 1) for y in (0, 1)]
    off, on = shares
    q = 1 / (1 + np.exp(-np.clip(np.log(base / (1 - base)) + votes @ np.log(on / off), -30, 30)))
    for _ in range(ROUNDS):
        residual = votes - (q[:, None] * on + (1 - q[:, None]) * off)
        residual /= np.sqrt((residual**2).sum(0)) + 1e-9
        weight = 1 / np.maximum(1, (np.maximum(0, residual.T @ residual) ** 2).sum(1))
        logit = np.log(base / (1 - base)) + votes @ (weight * np.log(on / off))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        for y, chance in enumerate((1 - q, q)):
            prior = PRIOR * n * (base if y else 1 - base)
            new = np.clip((chance @ votes + prior * shares[y]) / (chance.sum() + prior), 1e-6, 1 - 1e-6)
            off, on = (off, new) if y else (new, on)
    return q


def classifier(votes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on posterior labels, by Newton's method with a quadratic penalty."""
    x = np.concatenate([votes, np.ones((len(votes), 1))], 1)
    beta = np.zeros(x.shape[1])
    penalty = np.append(np.full(votes.shape[1], PENALTY), 1e-3)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (target - p) - penalty * beta)
        beta += step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    return beta[:-1], float(beta[-1])


class Model:
    def __init__(self, voters: Voters, weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias

    def score(self, texts: list[str]) -> np.ndarray:
        logits = np.array([self.weights[v].sum() if (v := self.voters.votes(t)) else 0.0 for t in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """text and toxic of about `most` labelled rows outside the held-out fold, a written table. Where labels of one id
    differ it counts as toxic; the sample's ids are what is broadcast, so no text moves."""
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(remainder(FOLDS) != HELD_OUT)
    each = written(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    some = about(each, most, each.count(), "doc_id")
    return written(two_columns(docs).join(F.broadcast(some), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "toxic-sample")


def find_terms(sample: DataFrame, most: int = CANDIDATES) -> list[str]:
    """The terms whose presence raises the odds of toxic most surely, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                sums[y > 0].update({t for w in set(WORD.findall(text.lower())) for t in terms_of(w)})
        names = list(sums[1])  # a term of no toxic text can't be chosen, whatever other tasks have seen of it in others
        rest = [t for t in sums[0] if t not in sums[1]]
        yield pa.RecordBatch.from_arrays([pa.array(names + rest, pa.string()), pa.array([sums[1][t] for t in names + rest], pa.int64()), pa.array([sums[0][t] for t in names + rest], pa.int64())], names=["term", "pos", "neg"])

    n = {r[0]: r[1] for r in sample.groupBy(F.col("toxic") > 0).count().collect()}
    pos, neg = n.get(True, 0), n.get(False, 0)
    if not pos:
        return []
    counts = sample.mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") >= LEAST_TEXTS)
    odds = F.log((F.col("pos") + 0.5) * (neg + 1) / ((F.col("neg") + 0.5) * (pos + 1)))
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = counts.withColumn("odds", odds).withColumn("z", z).filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
    ranked = best.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), F.length("term"), "term").select("term", "neg").limit(most).collect()
    return [r[0] for r in ranked]


def choose_terms(votes: list[list[int]], labels: np.ndarray, candidates: int, most: int = TERMS) -> list[int]:
    """Candidates, best first, that vote for toxic texts that fewer than COVER chosen voters have voted for so far: at
    least LEAST_TEXTS such texts and a tenth of the candidate's toxic ones. The patterns are always chosen."""
    held: list[list[int]] = [[] for _ in range(len(PATTERNS) + candidates)]
    for i in np.flatnonzero(labels > 0):
        for v in votes[i]:
            held[v].append(i)
    seen, chosen = np.zeros(len(labels), int), []
    for v, rows in enumerate(held):
        if v >= len(PATTERNS):
            new = (seen[rows] < COVER).sum() if rows else 0
            if new < max(LEAST_TEXTS, len(rows) / 10) or len(chosen) == most:
                continue
            chosen.append(v - len(PATTERNS))
        seen[rows] += 1
    return chosen


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels)
    terms = find_terms(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters(terms)
        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([own.votes(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32())), b.column("toxic")], names=["votes", "toxic"])

    rows = sample.mapInArrow(run, "votes array<int>, toxic int").toArrow()
    if not rows.num_rows:  # nothing is labelled: only the lexicon and the patterns vote
        return Model(Voters([]), np.array([2.5, 1.0, 0.2, 0.2, 1.0]), -3.0)
    labels_of = (rows.column("toxic").to_numpy() > 0).astype(float)
    found = rows.column("votes").to_pylist()
    chosen = choose_terms(found, labels_of, len(terms))
    place = {len(PATTERNS) + t: len(PATTERNS) + i for i, t in enumerate(chosen)} | {i: i for i in range(len(PATTERNS))}
    votes = np.zeros((len(found), len(PATTERNS) + len(chosen)))
    for i, v in enumerate(found):
        votes[i, [place[x] for x in v if x in place]] = 1
    return Model(Voters([terms[i] for i in chosen]), *classifier(votes, label_model(votes, labels_of)))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its text alone; null and empty texts get the score of no vote,
    rows that repeat the same score; a score of just THRESHOLD is predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.voters.terms, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, bias = shared.value
        own = Model(Voters(terms), weights, bias)
        for b in text_slices(batches):
            score = own.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = two_columns(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, by what the labels (doc_id, toxic) outside the held-out fold
    teach; a label of 1 counts where labels of an id differ. Rows that repeat are scored alike, null as empty texts; an empty
    table gives no rows, and without labels the lexicon and the patterns alone decide."""
    return score_texts(docs, learn(docs, labels))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """toxicity over all documents; odd rows as told there."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
