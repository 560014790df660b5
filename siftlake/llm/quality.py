"""Quality rules: repetition within a text by suffix arrays over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import documents, kept_where, text_slices, two_columns, utf8

#: Words in the windows of the base rule, and the share of words in repeated windows, of 100, beyond which a text fails.
WINDOW, BASE_SHARE, LEAST_WORDS = 5, 20, 10
#: Repeats of at least so many words count; a text is turned down when they cover more than this fraction of its words,
#: or when the longest one has more than LONGEST words and more than LONGEST_SHARE of them.
REPEAT, COVERED, LONGEST, LONGEST_SHARE = 8, 0.2, 50, 0.1
#: The symbols counted, and white space.
SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order, and for k = 0, 1, ... each suffix's rank by its first 2**k symbols.

    Prefix doubling; a suffix whose rank is its own is not sorted again. symbols are numbers below their count.
    """
    n = len(symbols)
    counts = np.bincount(symbols, minlength=1)
    rank = (np.cumsum(counts) - counts)[symbols].astype(np.int32 if n < 1 << 31 else np.int64)
    levels = [rank]
    active, h = np.flatnonzero(counts[symbols] > 1), 1
    while len(active):
        after = active + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        key = rank[active].astype(np.int64) << 32 | second
        order = np.argsort(key)
        key, active = key[order], active[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32])
        place = np.arange(len(key))
        within = np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        rank = rank.copy()
        rank[active] += within.astype(rank.dtype)
        levels.append(rank)
        several = ~fresh
        several[:-1] |= ~fresh[1:]
        active, h = active[several], 2 * h
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def longest_repeats(symbols: np.ndarray, least: int) -> np.ndarray:
    """For each place, how many symbols from there on stand elsewhere too, if at least `least` (else 0).

    These are the longest-common-prefix values of a suffix with its neighbours in the suffix array, hence the maximal
    repeats of the LCP intervals that the suffix lies in.
    """
    order, levels = suffix_array(symbols)
    found, n = np.zeros(len(symbols), np.int64), len(symbols)
    sure = min(len(levels) - 1, int(np.log2(least))) if least else 0
    if 1 << sure > least or len(levels) - 1 < int(np.log2(least)):
        return found
    near = np.flatnonzero(levels[sure][order[:-1]] == levels[sure][order[1:]])
    a, b = order[near], order[near + 1]
    i, j, common = a.copy(), b.copy(), np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = np.zeros(len(i), bool)
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        step = same.astype(np.int64) << k
        i, j, common = i + step, j + step, common + step
    common[common < least] = 0
    np.maximum.at(found, a, common)
    np.maximum.at(found, b, common)
    return found


def covered(found: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Whether a place lies in the union of the repeats of at least `least` symbols, each cut to `most` symbols."""
    place = np.arange(len(found))
    size = found if most is None else np.minimum(found, most)
    return np.maximum.accumulate(np.where(found >= least, place + size, 0)) > place if len(found) else np.zeros(0, bool)


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(" \t\n\x0b\x0c\r"))
        seen.add(line)
    return n


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of a column of texts; nulls have no words."""
    data, offsets = utf8(column)
    kind = np.zeros(256, np.uint8)
    kind[list(range(0x80)) + list(range(0xC0, 256))] = 1  # first bytes of code points
    kind[list(WHITE)] = 0
    chars = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
    kind[:] = 0
    kind[list(SYMBOLS)] = 1
    signs = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
    raw, symbols, sizes, base = data.tobytes(), [], [], 0
    for x, y in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        seen: dict[bytes, int] = {}
        words = raw[x:y].split()
        symbols.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
        base += len(seen)  # a word has another symbol in each text, so no repeat crosses texts
        sizes.append(len(words))
    sizes = np.array(sizes, np.int64)
    found = longest_repeats(np.concatenate(symbols) if symbols else np.empty(0, np.int64), WINDOW)
    of = np.repeat(np.arange(len(sizes)), sizes)
    total = lambda x: np.bincount(of, x, minlength=len(sizes)).astype(np.int64)
    longest = np.zeros(len(sizes), np.int64)
    np.maximum.at(longest, of, found)
    return {
        "n_words": sizes,
        "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_symbols": signs[offsets[1:]] - signs[offsets[:-1]],
        "n_dup_lines": np.array([duplicate_lines(t or "") for t in column.to_pylist()], np.int64),
        "n_repeat_words": total(covered(found, WINDOW, WINDOW)),
        "n_covered": total(covered(found, REPEAT)),
        "longest_repeat": longest,
    }


def verdicts(m: dict[str, np.ndarray], repeat_share: float = COVERED, longest: int = LONGEST, longest_share: float = LONGEST_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    n = m["n_words"]
    failed = (n < LEAST_WORDS) | (100 * m["n_repeat_words"] > BASE_SHARE * n)
    bad = (m["n_covered"] > repeat_share * n) | (m["longest_repeat"] > np.maximum(longest, longest_share * n))
    return failed, ~failed & ~bad


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, kept, n_covered and longest_repeat.

    Null and empty texts have no words, so they fail. Each text is judged by itself; rows that repeat are judged alike.
    An empty table gives no rows; other columns of docs, whatever their names, are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            m = measure(b.column("text"))
            failed, kept = verdicts(m, **limits)
            columns = [b.column("doc_id"), *(pa.array(m[c]) for c in COUNTS), pa.array(failed), pa.array(kept), pa.array(m["n_covered"]), pa.array(m["longest_repeat"])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "kept", "n_covered", "longest_repeat"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, n_covered long, longest_repeat long"
    return two_columns(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """docs without the rows that the rules turn down; all columns stay."""

    return kept_where(docs, lambda texts: verdicts(measure(texts), **limits)[1])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """quality_rules over all documents; odd rows as told there."""
    return quality_rules(documents(spark, sf_dir))
