"""Token ids by the tokenizers library, with a memo of pieces seen before."""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces in each of the two generations that an encoder keeps (about 80 bytes each), and the longest that it keeps, in bytes.
MEMO, LONGEST = 250_000, 48
#: New pieces that go to the library in one call's list.
TOGETHER = 1000
#: Classes of characters in the pattern that byte-level tokenizers cut texts by; UNSURE: those whose class depends on the
#: version of Unicode, whose texts go to the library whole.
LETTER, NUMBER, WHITE, OTHER, UNSURE = range(5)
#: White space beyond ASCII, and what may follow an apostrophe in one piece with it.
MORE_WHITE = frozenset("\x85\xa0     　") | frozenset(map(chr, range(0x2000, 0x200B)))
SUFFIXES = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def class_of(code: int) -> int:
    """The class of a character. It is sure if it is the same in Unicode 3.2 and now, or no letter or number at all."""
    c = chr(code)
    if c in "\t\n\x0b\x0c\r " or c in MORE_WHITE:
        return WHITE
    now, then = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
    kind, old = ({"L": LETTER, "N": NUMBER}.get(x[0], OTHER) for x in (now, then))
    sure = now != "Cn" and (kind == old or kind == OTHER and then == "Cn")
    return kind if sure else UNSURE


class Classes:
    """The class of each byte of UTF-8 texts; all bytes of a character have its class."""

    def __init__(self):
        self.ascii = np.full(256, OTHER, np.uint8)
        self.ascii[:128] = [class_of(i) for i in range(128)]
        self.known = np.full(0x110000, 255, np.uint8)  # filled as characters are met

    def of(self, data: np.ndarray) -> np.ndarray:
        out = self.ascii[data]
        leads = np.flatnonzero(data >= 0xC0)
        if len(leads):
            # Bytes beyond the end are never read as part of a character: a text's last character is whole.
            byte = lambda k: data[np.minimum(leads + k, len(data) - 1)].astype(np.int32) & 0x3F
            lead = data[leads].astype(np.int32)
            size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
            code = np.where(size == 2, (lead & 0x1F) << 6 | byte(1), np.where(size == 3, (lead & 0x0F) << 12 | byte(1) << 6 | byte(2), (lead & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)))
            kind = self.known[code]
            if (kind == 255).any():
                for c in np.unique(code[kind == 255]).tolist():
                    self.known[c] = class_of(c)
                kind = self.known[code]
            for k in range(4):
                some = size > k
                out[leads[some] + k] = kind[some]
        return out


def cut(data: np.ndarray, edges: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pieces begin in the bytes of texts that stand one after the other at `edges`, by the tokenizer's pattern.

    A piece is a run of letters, of numbers or of other characters, with one space before it if there is one; a
    contraction's apostrophe and letters; or white space: a run before something else leaves its last character, which
    belongs to the next piece if it is a space. Pieces never cross texts.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    firsts = edges[:-1][edges[:-1] < edges[1:]]
    begins[firsts] = True
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    white = begins & (kind == WHITE)
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], n)
    of_white = white[runs] & ~first[ends]  # white space with something behind it in its text
    starts, after = runs[of_white], ends[of_white]
    last = after - 1
    for _ in range(2):  # back to the first byte of the last character
        inner = (data[last] & 0xC0) == 0x80
        if not inner.any():
            break
        last = last - inner
    begins[last] = True
    spaced = after[data[last] == 0x20]
    begins[spaced] = False
    # Contractions: an apostrophe that stands alone among other characters, with no space before it.
    quote = runs[(data[runs] == 0x27) & (ends - runs == 1) & (kind[runs] == OTHER)]
    quote = quote[begins[quote] & ~first[quote + 1]]
    for suffix in SUFFIXES if len(quote) else ():
        to = quote + 1 + len(suffix)
        fits = to <= n
        at = quote[fits]
        same = np.ones(len(at), bool)
        for k, b in enumerate(suffix):
            same &= (data[at + 1 + k] == b) & ((k == 0) | ~first[at + 1 + k])
        at = at[same]
        begins[at + 1] = False
        to = at + 1 + len(suffix)
        begins[to[to < n]] = True
    return np.flatnonzero(begins)


class Memo:
    """Ids of pieces by 128-bit keys: an open-addressing table in numpy, of about 60 bytes an entry."""

    def __init__(self, most: int):
        self.mask = (1 << int(2 * most).bit_length()) - 1
        self.one, self.two = np.zeros((2, self.mask + 1), np.uint64)
        self.place = np.full(self.mask + 1, -1, np.int64)  # first id's index << 20 | how many
        self.ids, self.used, self.held = np.empty(1 << 18, np.uint32), 0, 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that isn't there."""
        slot = (one & np.uint64(self.mask)).astype(np.int64)
        found = self.place[slot]
        rows = np.flatnonzero((self.one[slot] != one) | (self.two[slot] != two))
        rows = rows[found[rows] >= 0]  # a slot of another key
        found[rows] = -1
        slot = slot[rows]
        while len(rows):
            slot = slot + 1 & self.mask
            place = self.place[slot]
            same = (self.one[slot] == one[rows]) & (self.two[slot] == two[rows]) & (place >= 0)
            found[rows[same]] = place[same]
            on = (place >= 0) & ~same
            rows, slot = rows[on], slot[on]
        return found

    def add(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, counts: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """The places of new keys; only those of `kept` can be found later."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        places = (self.used + np.cumsum(counts) - counts) << 20 | counts
        self.used += len(ids)
        rows = np.flatnonzero(kept)
        if self.held + len(rows) > self.mask // 2 + 1:
            self._grow(self.held + len(rows))
        self.held += len(rows)
        self._put(one[rows], two[rows], places[rows])
        return places

    def _put(self, one: np.ndarray, two: np.ndarray, places: np.ndarray) -> None:
        rows = np.arange(len(one))
        slot = (one & np.uint64(self.mask)).astype(np.int64)
        while len(rows):
            free = self.place[slot] < 0
            self.place[slot[free]] = places[rows[free]]
            won = self.place[slot] == places[rows]  # of several that want a free slot, the last has it
            self.one[slot[won]], self.two[slot[won]] = one[rows[won]], two[rows[won]]
            rows, slot = rows[~won], (slot[~won] + 1) & self.mask

    def _grow(self, most: int) -> None:
        there = np.flatnonzero(self.place >= 0)
        old = self.one[there], self.two[there], self.place[there]
        self.mask = (1 << int(2 * most).bit_length()) - 1
        self.one, self.two = np.zeros((2, self.mask + 1), np.uint64)
        self.place = np.full(self.mask + 1, -1, np.int64)
        self._put(*old)


def gather(source: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids at the places, one after the other, and how many each has."""
    counts = places & 0xFFFFF
    ends = np.cumsum(counts)
    index = np.repeat((places >> 20) - (ends - counts), counts)
    index += np.arange(len(index))
    return source[index], counts


class Encoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False) of the library.

    Strings of special tokens in a text are ordinary text. Texts are cut where the tokenizer's pattern cuts them; equal
    pieces are encoded once and remembered, and new ones go to the library many at a time, already cut.
    """

    def __init__(self, path: str, memo: int | None = None):
        from tokenizers import Tokenizer

        self.path, self.most = path, memo or MEMO
        self.pieces = Tokenizer.from_file(path)
        if "ByteLevel" not in str(self.pieces.pre_tokenizer):
            raise ValueError("the tokenizer isn't a byte-level one")
        self.pieces.encode_special_tokens = True
        self.pieces.pre_tokenizer = None
        self.tokenizer = None
        vocabulary = self.pieces.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        # The tokenizer's files write bytes as characters: printable ones of Latin-1 as themselves, others from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        char = {b: b for b in shown} | {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in shown)}
        utf8 = [chr(char[b]).encode() for b in range(256)]
        self.size = np.array([len(x) for x in utf8], np.int64)
        self.head = np.array([x[0] for x in utf8], np.uint8)
        self.tail = np.array([x[-1] for x in utf8], np.uint8)
        self.classes = Classes()
        self.tables = np.random.default_rng(20).integers(0, 1 << 64, (2, (LONGEST + 1) << 8), np.uint64)
        self.memo, self.older = Memo(self.most), Memo(1)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = True
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts

    def learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of the bytes, and how many each has: the ids' bytes add up to the pieces' bytes."""
        ends = np.cumsum(sizes)
        own = data[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        size = self.size[own]
        upto = np.cumsum(size)
        shown = np.empty(int(upto[-1]), np.uint8)
        shown[upto - size] = self.head[own]
        shown[upto - 1] = self.tail[own]
        edges = np.concatenate([[0], upto[ends - 1]])
        words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(edges), pa.py_buffer(shown)).to_pylist()
        groups = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        found = self.pieces.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        return ids, np.diff(np.searchsorted(np.cumsum(self.width[ids]), ends, "left") + 1, prepend=0)

    def keys(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """128-bit keys of the pieces, as two halves, by tabulation: sums of random numbers, one for each byte at each place,
        so that two pieces have one key with a chance of 2**-128. Only pieces of up to LONGEST bytes are looked up by it."""
        place = np.arange(len(data), dtype=np.int32)
        place -= np.repeat(starts.astype(np.int32), sizes)
        np.minimum(place, LONGEST, out=place)
        place <<= 8
        place |= data
        return [np.add.reduceat(t[place], starts) for t in self.tables]

    def places(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The place of each piece's ids in the memo, where new ones are put."""
        sizes = np.diff(starts, append=len(data))
        one, two = self.keys(data, starts, sizes)
        short = sizes <= LONGEST
        found = self.memo.find(one, two)
        found[~short] = -1
        lost = np.flatnonzero(found < 0)
        if not len(lost):
            return found
        one, two, short = one[lost], two[lost], short[lost]
        one[~short], two[~short] = lost[~short], 0  # a long piece is encoded for itself
        order = np.argsort(one)
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        first = order[fresh]
        one, two, kept = one[first], two[first], short[first]
        at = self.older.find(one, two)
        at[~kept] = -1
        known, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        if len(known):
            at[known] = self.memo.add(one[known], two[known], *gather(self.older.ids, at[known]), kept[known])
        if len(new):
            rows = lost[first[new]]
            at[new] = self.memo.add(one[new], two[new], *self.learn(data, starts[rows], sizes[rows]), kept[new])
        found[lost[order]] = at[np.cumsum(fresh) - 1]
        return found

    def cut_up(self, data: np.ndarray, edges: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts, where each text's begin and end)."""
        starts = cut(data, edges, kind)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(edges), np.int64)
        if self.memo.held > self.most:
            self.older, self.memo = self.memo, Memo(self.most)
        places = self.places(data, starts)
        ids, counts = gather(self.memo.ids, places)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, edges)]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end); end_id, where given, follows each text's own."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        data, edges = text_bytes(texts)
        kind = self.classes.of(data)
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(edges, np.flatnonzero(kind == UNSURE), "right") - 1] = True
        if odd.any():
            own, own_edges = text_bytes(texts.filter(pa.array(~odd)))
            ids, sizes = self.cut_up(own, own_edges, self.classes.of(own))
            more, counts = self.whole(texts.filter(pa.array(odd)).to_pylist())
            size = np.empty(len(odd), np.int64)
            size[~odd], size[odd] = np.diff(sizes), counts
            from_odd = np.repeat(odd, size)
            both = np.empty(len(from_odd), np.uint32)
            both[~from_odd], both[from_odd] = ids, more
            ids, edges = both, np.concatenate([[0], np.cumsum(size)])
        else:
            ids, edges = self.cut_up(data, edges, kind)
        if end_id is None:
            return ids, edges
        spread = edges + np.arange(len(edges))
        out = np.empty(len(ids) + len(edges) - 1, np.uint32)
        is_end = np.zeros(len(out), bool)
        is_end[spread[1:] - 1] = True
        out[is_end], out[~is_end] = end_id, ids
        return out, spread


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large string column without nulls, and each row's offsets into them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, memo: int | None = None) -> Encoder:
    """One encoder for each Python worker; memo: entries of a generation."""
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = Encoder(path, memo)
    return _ENCODERS[path, memo]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
