"""Conversation structure repair: the cheapest edits that give a legal order of roles, by weighted finite-state composition.

A conversation is an input acceptor, one symbol a row. The edit transducer keeps, reroles, deletes or inserts rows at a cost;
the role grammar accepts `(s?(ua)+)?`. Their composition is never built: its arcs are made as a path needs them and kept by
symbol and grammar state. Weights are pairs of cost and label string, compared in that order. Going from the end of the
input to its begin, a longer string comes from a label put before two strings, which keeps their order; put behind them it
would not, where one begins the other. All arcs of one state have different labels, so the first label decides a tie.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The role grammar: what each state goes to by which initial; the states a conversation may end in.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
#: Costs of the edits, and of a truncated row that stays. Written rows are the user's or the assistant's.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
WRITTEN = {"u": "user", "a": "assistant"}
INITIALS, FAULTS = "sua?", ("", "blank", "duplicate", "truncated")
ABSENT = len(INITIALS) * len(FAULTS)
LEGAL = {"su", "ua", "au"}
FAR = 1 << 40
NONSPACE = r"[^\x20\x09-\x0D]"
MOST = (1 << 63) - 1


def edits(initial: str, fault: str) -> Iterator[tuple[int, str, str]]:
    """The edit transducer's arcs that read a row: cost, label, the initial that is written."""
    yield DELETE, "D", ""
    if fault not in ("blank", "duplicate"):
        more = CUT if fault == "truncated" else 0
        yield KEEP + more, "K", initial
        for w in WRITTEN:
            yield REROLE + more, "R", w


@functools.cache
def composed(symbol: int, state: int) -> tuple[tuple[int, str, int], ...]:
    """The arcs that read a symbol in a grammar state: cost, label, next grammar state."""
    initial, fault = INITIALS[symbol % len(INITIALS)], FAULTS[symbol // len(INITIALS)]
    arcs = ((cost, label, state if label == "D" else GRAMMAR[state].get(w)) for cost, label, w in edits(initial, fault))
    return tuple(a for a in arcs if a[2] is not None)


Choice = tuple[int, str, int]


def inserted(best: list[Choice]) -> tuple[Choice, ...]:
    """The best of each grammar state, arcs included that read nothing and write a row. Each costs, so none is taken twice."""
    for _ in best:
        best = [min([b, *((INSERT + best[to][0], "I", to) for w, to in GRAMMAR[g].items() if w in WRITTEN)]) for g, b in enumerate(best)]
    return tuple(best)


@functools.cache
def at_end() -> tuple[Choice, ...]:
    return inserted([(0 if g in FINAL else FAR, "", g) for g in GRAMMAR])


@functools.lru_cache(1 << 16)
def step(symbol: int, later: tuple[int, ...]) -> tuple[Choice, ...]:
    """For each grammar state before a symbol: the cost to the end, the first label and the next state, given the costs of the
    states after it."""
    return inserted([min((cost + later[to], label, to) for cost, label, to in composed(symbol, g)) for g in GRAMMAR])


def cheapest(symbols: bytes) -> tuple[int, str]:
    """The least cost of a conversation, and the ASCII-least string of labels at that cost."""
    kinds: dict[tuple, int] = {}
    steps, taken = [], array("i")
    costs, base = tuple(c[0] for c in at_end()), 0
    for s in reversed(symbols):
        low = min(costs)
        base += low
        key = (s, tuple(c - low for c in costs))
        if key not in kinds:
            kinds[key] = len(steps)
            steps.append(step(*key))
        taken.append(kinds[key])
        costs = tuple(c[0] for c in steps[taken[-1]])
    state, out = START, []
    for choices in (*(steps[k] for k in reversed(taken)), at_end()):
        while True:
            _, label, state = choices[state]
            out.append(label)
            if label != "I":
                break
    return base + costs[START], "".join(out)


def faulty(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, copy, role, text, present) with key (a digest of role and text) and symbol: the role's initial and
    the first fault, blank, duplicate or truncated, as one number; ABSENT for rows that are not present."""
    key = F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    rows = rows.withColumn("key", key)
    seen = F.row_number().over(Window.partitionBy("conv_id", "key", "present").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    blank, whole = ~F.col("text").rlike(NONSPACE), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, 1).when(seen, 2).when(~whole, 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.withColumn("symbol", F.when(F.col("present"), initial + fault * len(INITIALS)).otherwise(ABSENT).cast("int"))


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation, from rows with symbol. Only numbers
    go to Python, sorted by Spark; a conversation takes a few bytes a row there, as its audit does in the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, symbols, turns, open_ = None, bytearray(), [], False
        out: list[tuple] = []

        def told() -> tuple:
            initials = [INITIALS[s % 4] for s in symbols]
            faults = [sum(s // 4 == k for s in symbols) for k in (1, 2, 3)]
            illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
            gaps = min(MOST, turns[1] - turns[0] + 1 - turns[2]) if turns else 0
            return now, gaps, *faults, illegal, *cheapest(bytes(symbols))

        for b in batches:
            for conv, turn, symbol in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not open_ or conv != now:
                    if open_:
                        out.append(told())
                    now, symbols, turns, open_ = conv, bytearray(), [], True
                if symbol == ABSENT:
                    continue
                symbols.append(symbol)
                if turn is not None:
                    if not turns:
                        turns = [turn, turn, 1]
                    elif turn != turns[1]:
                        turns = [turns[0], turn, turns[2] + 1]
            if out:
                yield listed(out)
                out = []
        if open_:
            yield listed([told()])

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", *(c.split()[0] for c in COUNTS.split(", "))])

    dealt = rows.select("conv_id", "turn", "symbol", "key", "copy").repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "key", "copy")
    return dealt.select("conv_id", "turn", "symbol").mapInArrow(run, f"conv_id long, {COUNTS}")


REPAIRED = f"conv_id long, position long, edit string, role string, text string, {COUNTS}"


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations, one after another within a partition: for each, a head (position 0) with what `audits` says,
    then its rows in order with edit (K, R, I), role and text. Texts are streamed, none is held."""
    counts = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, at, state, place, conv = "", 0, START, 0, None
        out: list[tuple] = []

        def written(label: str, role: str, text: str) -> None:
            nonlocal state, place
            if label == "K":
                state = GRAMMAR[state][role[0]]
            else:
                w = next(w for w in GRAMMAR[state] if w in WRITTEN)
                role, state = WRITTEN[w], GRAMMAR[state][w]
            place += 1
            out.append((conv, place, label, role, text, *[None] * len(counts)))

        def inserts() -> None:
            nonlocal at
            while at < len(labels) and labels[at] == "I":
                written("I", "", "")
                at += 1

        for b in batches:
            for r in b.to_pylist():
                if r["audit"] is not None:
                    inserts()
                    conv, labels, at, state, place = r["conv_id"], r["audit"], 0, START, 0
                    out.append((conv, 0, None, None, None, *(r[c] for c in counts)))
                    continue
                inserts()
                if labels[at] != "D":
                    written(labels[at], r["role"], r["text"])
                at += 1
            if out:
                yield listed(out)
                out.clear()
        inserts()
        if out:
            yield listed(out)

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "position", "edit", "role", "text", *counts])

    none = lambda c: F.lit(None).cast(dict(x.split() for x in COUNTS.split(", "))[c]).alias(c)
    bodies = rows.filter("present").select("conv_id", "turn", "key", "copy", "role", "text", *(none(c) for c in counts))
    heads = found.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("binary").alias("key"), F.lit(-1).cast("int").alias("copy"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), *counts)
    met = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", F.col("copy") >= 0, F.asc_nulls_first("turn"), "key", "copy")
    return met.drop("turn", "key", "copy").mapInArrow(run, REPAIRED)


def repair(conversations: DataFrame) -> DataFrame:
    """repaired_rows of conversations (conv_id, turn, role, text; copy and present are optional).

    Rows go by turn, nulls first, ties by a digest of role and text, then by copy (a number). A null role or text is one
    space; rows without a conv_id are a conversation of their own. A conversation whose rows are all marked not present has
    a head alone. An empty table gives no rows; other columns are never read.
    """
    has = conversations.columns
    extra = [F.col("copy").cast("int").alias("copy") if "copy" in has else F.lit(0).alias("copy"), F.col("present") if "present" in has else F.lit(True).alias("present")]
    rows = faulty(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(or_space(c).alias(c) for c in ("role", "text")), *extra))
    return repaired_rows(rows, audits(rows))


def or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations damaged by crc32(`conv_id:turn`) % 20, nulls as one space: 0 drops a row, 1 empties its text, 2 removes its
    end marks, 3 repeats it, 4 makes it the user's. Dropped rows stay, marked not present, for the sake of their conv_id."""
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", or_space("role").alias("r"), or_space("text").alias("t"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("t", "[.!?]", "")).otherwise(F.col("t"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("r"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") != 0).alias("present"))


def digested(repaired: DataFrame) -> DataFrame:
    """A row for each head of repaired_rows, with the digest of the rows behind it."""
    counts = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, h = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["position"] == 0:
                    if head:
                        out.append((*head, h.hexdigest()))
                    head, h = (r["conv_id"], *(r[c] for c in counts)), hashlib.sha256()
                else:
                    h.update(f"{chr(10) if r['position'] > 1 else ''}{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
            if out:
                yield listed(out)
        if head:
            yield listed([(*head, h.hexdigest())])

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        types = [*[pa.int64()] * 7, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", *counts, "repaired_sha256"])

    return repaired.mapInArrow(run, f"conv_id long, {COUNTS}, repaired_sha256 string")


def op13_structure_repair(spark, sf_dir: str) -> DataFrame:
    """The repair of the damaged conversations, its rows as digests; odd rows as damaged and repair say."""
    return digested(repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
