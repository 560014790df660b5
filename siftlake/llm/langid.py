"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import documents, kept_where, remainder, text_slices

#: Characters in an n-gram, cells that n-grams are hashed to, and the count added to every cell.
GRAMS, CELLS, SMOOTHING = (1, 2, 3), 1 << 15, 0.5
#: Folds of the split by crc32(doc_id); documents of fold HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2
#: What a text without a letter, or without any learned language, gets.
UNKNOWN = "und"
#: A filter drops texts of unknown language and those whose best language has a lower score.
LEAST_SCORE = 0.4
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)]))
    return _LETTERS[0]


def cells_of(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(cells of the n-grams that begin at each place, for each n; where each text begins; whether it has a letter).

    Texts are lower-cased, other characters than letters count as a space, and every text ends with spaces. What would
    reach into the next text falls into the cell CELLS, which counts for nothing.
    """
    pad = " " * max(GRAMS)
    lowered = [t.lower() + pad for t in texts]
    begins = np.cumsum([0, *map(len, lowered)])
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    code = np.where(letter, code, np.uint32(32))
    cells, mixed = [], np.zeros(len(code), np.uint32)
    for k in range(max(GRAMS)):
        mixed = mixed[: len(code) - k] * np.uint32(0x9E3779B1) + code[k:] * np.uint32(0x85EBCA6B) + np.uint32(k + 1)
        if k + 1 in GRAMS:
            cell = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17)
            for j in range(1, k + 1):
                cell[begins[1:-1] - j] = CELLS
            cells.append(cell)
    has = np.add.reduceat(letter, begins[:-1], dtype=np.int64) > 0 if len(texts) else np.empty(0, bool)
    return cells, begins, has


class Model:
    """Log-probabilities of cells by language; a fixed number of cells times the learned languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.cells = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32) if languages else np.zeros((0, CELLS), np.float32)
        self.cells = np.concatenate([self.cells, np.zeros((len(languages), 1), np.float32)], 1)
        self.prior = np.log((documents + 1) / (documents.sum() + len(languages))) if languages else np.zeros(0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior, with evidence divided by the square root of the number of n-grams
        (they overlap, so they are no independent evidence); ties go to the language that sorts first."""
        if not texts:
            return [], np.empty(0)
        cells, begins, has = cells_of(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums = np.zeros((len(texts), len(self.languages)))
        for c in cells:
            at = np.minimum(begins[:-1], max(0, len(c) - 1))
            for k, row in enumerate(self.cells):
                sums[:, k] += np.add.reduceat(row[c], at, dtype=np.float64)
        logits = sums / np.sqrt(len(cells) * np.diff(begins))[:, None] + self.prior
        best = logits.argmax(1)
        chance = np.exp(logits - logits.max(1, keepdims=True))
        score = chance.max(1) / chance.sum(1)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0)


def train(docs: DataFrame) -> Model:
    """Learns from all rows of docs (text, lang) with a text and a language. Tasks send counts of cells, at most one row
    for each language and cell; the driver gets their sums, as many rows as the model has numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in text_slices(batches):
            cells, begins, has = cells_of(b.column("text").to_pylist())
            names = b.column("lang").to_pylist()
            for name in set(names):
                mine = np.array([x == name for x in names])
                own = sums.setdefault(name, np.zeros(CELLS + 1, np.int64))
                own[CELLS] += int(mine.sum())
                inside = np.repeat(mine & has, np.diff(begins))
                for c in cells:
                    own[:CELLS] += np.bincount(c[inside[: len(c)]], minlength=CELLS + 1)[:CELLS]
        for name, own in sums.items():
            there = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(own[there])], names=["lang", "cell", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    sums = rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(sums["lang"].to_pylist()))
    table = np.zeros((len(languages), CELLS + 1))
    if languages:
        where = {x: k for k, x in enumerate(languages)}
        table[[where[x] for x in sums["lang"].to_pylist()], sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return Model(languages, table[:, :CELLS], table[:, CELLS])


def learned(docs: DataFrame, id_col: str = "doc_id") -> Model:
    """The model from the rows outside the held-out fold."""
    return train(docs.filter(remainder(FOLDS, id_col) != HELD_OUT))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; text alone decides. Null texts and texts without a letter: und, 0.

    Rows that repeat are judged alike; of equally likely languages the first by name counts. An empty table gives no rows;
    other columns, whatever their names, are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            found, score = shared.value.predict([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(FOLDS, id_col) == HELD_OUT).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the texts that have no letter or no likely language; all columns stay. Where no language could be
    learned, only texts without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learned(docs))

    def known(texts: pa.Array) -> np.ndarray:
        own = [t or "" for t in texts.to_pylist()]
        if not shared.value.languages:
            return cells_of(own)[2]
        found, score = shared.value.predict(own)
        return np.array([x != UNKNOWN for x in found], bool) & (score >= least)

    return kept_where(docs, known)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """predict over all documents; odd rows as told there."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return predict(docs, learned(docs))
