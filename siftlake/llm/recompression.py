"""Recompression of word sequences: rounds name runs and pairs, so that equal sequences get equal symbols away from their edges.

A symbol's name is a hash of what it stands for, so every task of a cluster gives the same name without asking another.
"""

from __future__ import annotations

import functools

import numpy as np

#: The white space of the contracts.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text whose words are hashed at once, and words that are recompressed at once: parts share all but one word of a
#: window, and what a window is known by doesn't depend on what stands around it.
BLOCK, PART = 1 << 20, 1 << 18
#: Words that name a window, from the first of its known symbols on.
CONTEXT = 12
#: More rounds than any window can take: each round leaves a known symbol less on either side.
ROUNDS = 40
#: Windows of a run at most, so that a length fits a byte.
LONGEST = 255
BYTE, WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(8)
def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i up to n."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    both = []
    for b in (base, inverse):
        steps = np.full(n + 1, b, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def room(n: int) -> int:
    """A power of two above n, so that few tables of powers are made."""
    return 1 << max(16, int(n).bit_length())


def sums(x: np.ndarray, base: np.uint64) -> np.ndarray:
    """Sums of the first i values, each times its power of base."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(base, room(len(x)))[0][: len(x)], dtype=np.uint64)])


def between(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of the values from begin to end, wherever they stand."""
    value = (prefix[end] - prefix[begin]) * powers(base, room(len(prefix)))[1][begin]
    return mixed(value + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts begin and end, their hashes, and the first word of each text (one more for the end)."""
    solid = ~WHITE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    begins = np.flatnonzero(solid & (border[:-1] | ~np.concatenate([[False], solid[:-1]])[: len(solid)]))
    ends = np.flatnonzero(solid & (border[1:] | ~np.concatenate([solid[1:], [False]])[: len(solid)])) + 1
    hashes, at = np.empty(len(begins), np.uint64), 0
    while at < len(begins):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + BLOCK, "right")))
        base = begins[at]
        prefix = sums(data[base : ends[to - 1]].astype(np.uint64) + np.uint64(1), BYTE)
        hashes[at:to] = between(prefix, begins[at:to] - base, ends[at:to] - base, BYTE)
        at = to
    return begins, ends, hashes, np.searchsorted(begins, offsets)


def named_windows(h: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of words (hashes h, each of a text): where they begin, and the place of the symbol that each is known by
    (-1 if none).

    Each round joins a maximal run of a symbol with the run after it, if the first is of the left and the second of the
    right half of that round's alphabet; a border goes by the two symbols beside it alone. What a window's words decide
    is, after each round, the part between the first border inside the known part and the last one: its symbols are the
    same wherever the window stands. A window is known by the first word of its first known symbol, in the last round
    that leaves one with CONTEXT words of the window from there on. Equal windows are therefore known by equal words.
    """
    n = len(h)
    last = np.concatenate([np.flatnonzero(np.diff(text)) + 1, [n]]) if n else np.zeros(0, np.int64)
    stop = last[np.searchsorted(last, np.arange(n), "right")] if n else last
    begins = np.flatnonzero(np.arange(n) + window <= stop)
    place = np.full(len(begins), -1, np.int64)
    starts, names, fresh = np.arange(n), h, np.concatenate([[True], np.diff(text) != 0])[:n]
    which, low, high = np.arange(len(begins)), begins.copy(), begins + window
    for r in range(1, ROUNDS):
        if not len(which):
            break
        right = (mixed(names + np.uint64(r * 0x517CC1B727220A95 % (1 << 64))) >> np.uint64(63)).astype(bool)
        goes = ~fresh[1:] & ((names[:-1] == names[1:]) | (~right[:-1] & right[1:]))
        head = np.flatnonzero(np.concatenate([[True], ~goes]))
        size = np.diff(np.append(head, len(names)))
        first, end = names[head], names[head + size - 1]
        alike = np.add.reduceat(names == np.repeat(first, size), head, dtype=np.int64)
        joined = mixed(mixed(first + alike.astype(np.uint64) * BYTE) + mixed(end ^ (size.astype(np.uint64) * WORD)) * np.uint64(3) + np.uint64(r))
        starts, names, fresh = starts[head], np.where(size == 1, first, joined), fresh[head]
        mark = np.zeros(n + 1, np.int64)
        mark[starts] = 1
        upto = np.cumsum(mark)
        after = upto[low]
        low = np.append(starts, 2 * n + window)[after]
        high = starts[upto[high - 1] - 1]
        known = low < high
        which, low, high = which[known], low[known], high[known]
        reached = low + CONTEXT <= begins[which] + window
        place[which[reached]] = low[reached]
    return begins, place


def parts(n: int, window: int):
    """From where to where n words are recompressed at once; each window lies in one part."""
    for at in range(0, max(n - window + 1, 0), PART):
        yield at, min(n, at + PART + window - 1)


def runs_of_windows(h: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows known by one symbol: the first one's begin, their number, their name, which is a hash of CONTEXT words
    from the symbol on, and a hash of all words from the first one's begin to the last one's end. A window without a known
    symbol, such as one inside a run of one word, is a run by itself, named by its own words."""
    begins, place = named_windows(h, text, window)
    if not len(begins):
        return begins, begins, h[:0], h[:0]
    prefix = sums(h, WORD)
    alone = place < 0
    head = np.flatnonzero(np.concatenate([[True], (np.diff(begins) != 1) | (np.diff(place) != 0) | alone[1:]]))
    size = np.diff(np.append(head, len(begins)))
    if size.max() > LONGEST:
        head = np.concatenate([np.arange(a, a + k, LONGEST) for a, k in zip(head.tolist(), size.tolist(), strict=True)])
        size = np.diff(np.append(head, len(begins)))
    at, alone = begins[head], alone[head]
    symbol = np.where(alone, at, place[head])
    name = between(prefix, symbol, symbol + np.where(alone, window, CONTEXT), WORD)
    return at, size, name, between(prefix, at, at + size + window - 1, WORD)
