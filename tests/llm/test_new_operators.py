"""Substring dedup, the prefix trie and the repair of conversations against brute force; odd inputs."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.llm import prefix_trie as trie
from siftlake.llm import queries, substrings
from siftlake.llm import recompression as R
from siftlake.llm import structure_repair as repair
from siftlake.llm.common import written

SPACE, EMPTY = r"[^\x20\x09-\x0D]+", hashlib.sha256(b"").hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(found, want):
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


# Substrings


def brute_substrings(rows, window=35):
    docs = [(i, re.findall(SPACE, t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[p : p + window]) for _, w in docs for p in range(len(w) - window + 1))
    out = []
    for i, words in docs:
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if seen[tuple(words[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out.append((i, len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone, strict=True) if not g))))
    return out


@pytest.mark.parametrize("shrunk", [False, True])
def test_substring_query_equals_brute_force(spark, sf, monkeypatch, shrunk):
    """Also with slices, parts and hashing blocks so small that each text is cut."""
    if shrunk:
        monkeypatch.setattr(substrings, "SLICE", 4000)
        monkeypatch.setattr(R, "PART", 64)
        monkeypatch.setattr(R, "BLOCK", 50)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = queries.queries()["op11_substring_dedup"](spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same(found, brute_substrings(rows))


def passages(seed):
    """Texts that share passages of about a window's length, at all places, with runs and periods."""
    rng = random.Random(seed)
    words = "a b c d e f g h".split()
    shared = [" ".join(rng.choice(words) for _ in range(rng.choice([5, 6, 7, 9, 20]))) for _ in range(4)] + ["a " * 9, "a b " * 8]
    texts = []
    for i in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(f"{rng.choice(words)}{rng.randrange(9)}" for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 7))]
        texts.append((i, "\n ".join(parts)))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_small_windows(spark, monkeypatch, seed):
    monkeypatch.setattr(R, "CONTEXT", 2)
    monkeypatch.setattr(substrings, "SLICE", 300)
    rows = passages(seed)
    found = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 6)
    same([(r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in found.collect()], brute_substrings(rows, 6))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=40, max_size=120), st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(0, 20))
def test_equal_windows_have_equal_names(middle, before, after, at):
    """Whatever stands around it, a window is known by the same words at the same distance."""
    codes = {c: np.uint64(zlib.crc32(c.encode()) * 0x9E3779B1) for c in "abcd"}

    def known(letters):
        h = R.mixed(np.array([codes[c] for c in letters], np.uint64))
        begins, place = R.named_windows(h, np.zeros(len(h), np.int64), 20)
        return place - begins, place < 0

    alone, none = known(middle)
    around, nor = known([*before, *middle, *after])
    n = len(alone)
    assert (nor[len(before) : len(before) + n] == none).all()
    assert (around[len(before) : len(before) + n] == alone)[~none].all()


def test_substrings_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, text), (4, text), (None, "x " + text), (5, "a " * 36), (6, "a " * 35), (7, "short text"), (8, "漢字 é " * 30)]
    docs = spark.createDataFrame([(i, t, "k", "r", 1) for i, t in rows], "doc_id long, text string, key string, ranges string, `a.b` int").repartition(4)
    out = substrings.substring_dedup(docs)
    found = collections.defaultdict(list)
    for r in out.collect():
        found[r.doc_id].append((r.n_words, r.n_removed, r.kept))
    assert found[1] == found[2] == found[3] == [(0, 0, "")]
    assert found[4] == [(50, 50, "")] * 2 and found[None] == [(51, 50, "x")]
    assert found[5] == [(36, 36, "")] and found[6] == [(35, 35, "")]
    assert found[7] == [(2, 0, "short text")] and found[8] == [(60, 60, "")]
    assert substrings.substring_dedup(docs.filter("doc_id = -1")).count() == 0


def test_substring_hot_text(spark):
    """A third of all rows is one text, another third shares a passage."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage) for i in range(100)] + [(100 + i, f"u{i} {passage} v{i}") for i in range(100)] + [(200 + i, " ".join(f"x{i}y{k}" for k in range(60))) for i in range(100)]
    out = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r.n_removed for r in out if r.doc_id < 200} == {60} and {r.n_removed for r in out if r.doc_id >= 200} == {0}
    assert {r.kept for r in out if 100 <= r.doc_id < 200} == {f"u{i} v{i}" for i in range(100)}


# The trie


def brute_trie(sequences):
    """Nodes of {conv_id: turns as (key, words)}."""
    nodes, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in sequences.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    children, leaves, saved = (collections.Counter() for _ in range(3))
    for node in nodes:
        if node:
            children[node[:-1]] += 1
    for node, members in nodes.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members) - 1) * (node[-1][1] if node else 0)
    return [(min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(",".join(map(str, sorted(ends[n]))))) for n, m in nodes.items()]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuild(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [((r, x), len(re.findall(SPACE, x))) for _, r, x in sorted(v, key=lambda z: z[0])] for c, v in by.items()}
    share = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    return {c: tuple(turns.get(c - c % 20, [])[: share[c]] + turns[c][share[c] :]) for c in turns}


def test_trie_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.queries()["op12_conversation_trie"](spark, sf).select(*COLUMNS).collect()
    same(found, brute_trie(rebuild(rows)))


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, depth int, pos long, words string"


def test_trie_of_odd_conversations(spark):
    """Null columns, a conversation without turns of its own, one that ends where another goes on, copies, no rows."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3}") for c in range(20, 32) for t in range(c % 5)]
    rows += [(40, None, None, None), (40, 0, "user", None), (41, 1, "user", "a\tb"), (61, 0, "user", "alone"), (None, 0, "user", "nobody's"), (22, 9, "", "user")]
    df = spark.createDataFrame([(*r, "k", 7, 8, "w") for r in rows], CONVERSATIONS).repartition(3)
    found = trie.prefix_trie(*trie.rebuilt(df))
    same(found.select(*COLUMNS).collect(), brute_trie(rebuild(rows)))
    assert trie.prefix_trie(*trie.rebuilt(df.filter("conv_id = -1"))).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_trie_of_random_sequences(spark, seed):
    """Deep and bushy ones, a third of them copies of one, over more ranges than a conversation fits in."""
    rng = random.Random(seed)
    long = [("k%d" % rng.randrange(3), rng.randrange(4)) for _ in range(60)]
    sequences = {c: tuple(long[: rng.randrange(61)] + [("k%d" % rng.randrange(2), 1) for _ in range(rng.randrange(4))]) if c % 3 else tuple(long) for c in range(90)}
    digest = lambda k: hashlib.md5(str(k).encode()).digest()
    rows = [(c, d + 1, digest((k, w)), w) for c, s in sequences.items() for d, (k, w) in enumerate(s)]
    turns = spark.createDataFrame(rows, "conv_id long, depth long, key binary, words long").repartition(5)
    members = spark.createDataFrame([(c,) for c in sequences], "conv_id long")
    out = trie.prefix_trie(turns, members)
    same(out.select(*COLUMNS).collect(), brute_trie(sequences))
    spans = {r["pos"]: r for r in out.collect()}
    assert sorted(spans) == list(range(len(spans))) and all(r["last"] - p + 1 == sum(p <= q <= r["last"] for q in spans) for p, r in spans.items())


def test_joined_digests_over_pieces(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.col("id") - 5000).alias("v"))
    found = {r.k: r.sha256 for r in trie.joined_digests(rows.repartition(7), "k", "v").collect()}
    assert found == {k: sha(",".join(str(i - 5000) for i in range(k, 20_000, 3))) for k in range(3)}


# The repair

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLE = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """All edit sequences in order of (cost, labels): rows are (initial, fault)."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, labels, i, g = heapq.heappop(heap)
        if i == len(rows) and g in (0, 3):
            return cost, labels
        if (labels, i, g) in done:
            continue
        done.add((labels, i, g))
        for w in "ua":
            if w in NEXT[g]:
                heapq.heappush(heap, (cost + 5, labels + "I", i, NEXT[g][w]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 2, labels + "D", i + 1, g))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if initial in NEXT[g]:
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, NEXT[g][initial]))
                for w in "ua":
                    if w in NEXT[g]:
                        heapq.heappush(heap, (cost + more + 1, labels + "R", i + 1, NEXT[g][w]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua?"), st.sampled_from(["", "", "", "blank", "duplicate", "truncated"])), max_size=7))
def test_cheapest_edits(rows):
    symbols = bytes("sua?".index(i) + 4 * repair.FAULTS.index(f) for i, f in rows)
    assert repair.cheapest(symbols) == cheapest(rows)


def test_long_conversation_is_linear():
    symbols = bytes([1, 2] * 100_000 + [5, 3, 14])
    cost, labels = repair.cheapest(symbols)
    assert labels.startswith("KKKK") and len(labels) - labels.count("I") == len(symbols) and cost > 0


def brute_repair(rows):
    text = lambda x: " " if x is None else str(x)
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        kind, r, x, held = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20, text(r), text(x), by[c]
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            held += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    out = []
    for c, held in by.items():
        held.sort(key=lambda z: (z[0] is not None, z[0] or 0))
        faults, seen = [], set()
        for _, r, x in held:
            bare = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((r, x))
        cost, labels = cheapest([(r[:1], f) for (_, r, _), f in zip(held, faults, strict=True)])
        rest, g, kept = iter(held), 0, []
        for label in labels:
            r, x = next(rest)[1:] if label != "I" else ("", "")
            if label == "D":
                continue
            w = r[:1] if label == "K" else next(w for w in NEXT[g] if w in ROLE)
            g = NEXT[g][w]
            kept.append(f"{r if label == 'K' else ROLE[w]}:{x}")
        turns = [t for t, _, _ in held if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, labels, sha("\n".join(kept))))
    return out


NAMES = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def test_repair_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.queries()["op13_structure_repair"](spark, sf).select(*NAMES).collect(), brute_repair(rows))


def test_repair_of_odd_conversations(spark):
    rows = [(c, t, ["system", "user", "assistant", "tool", "", None][(c + t) % 6], ["Yes.", "no", "What?\n", None, " ", "é!"][(c * t) % 6]) for c in range(60) for t in range(c % 7)]
    rows += [(70, None, "user", "First."), (70, 3, "assistant", "Second."), (70, 9, "user", "Third"), (None, 1, "user", "Nobody's."), (None, None, None, None)]
    dropped = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    df = spark.createDataFrame([(*r, "k", 7, 8, "w") for r in rows], CONVERSATIONS.replace("pos long", "symbol long")).repartition(3)
    found = repair.digested(repair.repair(repair.damaged(df)))
    same(found.select(*NAMES).collect(), brute_repair(rows))
    lost = found.filter(F.col("conv_id") == dropped).first()
    assert lost.audit == "" and lost.repaired_sha256 == EMPTY and lost.cost == 0
    assert repair.digested(repair.repair(repair.damaged(df.filter("conv_id = -1")))).count() == 0


def test_repaired_rows_are_legal(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again"), (1, 2, "system", "You are one."), (1, 3, "assistant", "Fine."), (2, 0, "user", "Alone.")]
    out = written(repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "repaired")
    heads = {r.conv_id: r for r in out.filter("position = 0").collect()}
    for c, head in heads.items():
        body = out.filter(f"conv_id = {c} and position > 0").orderBy("position").collect()
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in body))
        assert "".join(r.edit for r in body) == head.audit.replace("D", "")
    # A lone question: a deletion (2) is cheaper than an invented answer (5).
    assert heads[2].audit == "D" and heads[2].cost == 2
