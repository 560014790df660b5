"""The prefix trie of conversations in preorder: intervals of positions stand for subtrees, prefix sums for their totals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import plain_words, words_in, written
from siftlake.operators.running import running

#: The parts of a prefix's name, 32 bits each.
PIECES = ("s0", "s1", "s2", "s3")
NODE = ["depth", "a", "b"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1, by turn, nulls first, ties by the digest of role and text), key (that digest) and words (of
    the text) of each row with a conv_id; a null role or text is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text)))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), plain_words(text).alias("plain"))
    rows = rows.select("conv_id", "turn", "key", words_in("plain").alias("words"), F.lit(1).cast("long").alias("one"))
    return running(rows, ["turn", "key"], {"position": "one"}, group=("conv_id",), drop=("turn", "one"))


def named(turns: DataFrame) -> DataFrame:
    """turns (conv_id, depth, key, words) with names of the prefix up to each turn (a, b) and of the one before (pa, pb): sums of
    a digest of each turn and its depth, so a prefix is named by running sums however long its conversation is."""
    digest = F.md5(F.concat(F.hex("key"), F.lit("@"), F.col("depth").cast("string")).cast("binary"))
    own = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"p{i}") for i in range(4)]
    rows = running(turns.select("conv_id", "depth", "words", *own), ["depth"], {s: f"p{i}" for i, s in enumerate(PIECES)}, group=("conv_id",))
    low = 1 << 32
    joined = lambda x, y: F.shiftleft(x % low, 32).bitwiseOR(y % low)
    c = F.col
    names = [joined(c("s0"), c("s1")).alias("a"), joined(c("s2"), c("s3")).alias("b"), joined(c("s0") - c("p0"), c("s1") - c("p1")).alias("pa"), joined(c("s2") - c("p2"), c("s3") - c("p3")).alias("pb")]
    return written(rows.select("conv_id", "depth", "words", *names), "trie-turns")


def branches(rows: DataFrame) -> DataFrame:
    """The nodes below which not all members of the node above go on, and all of depth one: where paths part."""
    nodes = written(rows.groupBy(*NODE).agg(F.count("*").alias("n"), F.any_value("pa").alias("pa"), F.any_value("pb").alias("pb")), "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("n").alias("of"))
    parted = nodes.join(above, ["depth", "pa", "pb"], "left").filter((F.col("depth") == 1) | (F.col("n") < F.col("of")))
    return written(parted.select(*NODE), "trie-branches")


def ranked(rows: DataFrame, parting: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, rank from 1, size) in lexicographic order, and (conv_id, depth, a, b) where their paths part
    from others.

    Two paths compare as their nodes at partings do, since both have the same ones up to where they part. A conversation
    with k partings has k others that end or part there, so a key has at most about the root of twice the rows' number.
    """
    at = written(rows.select("conv_id", *NODE).join(parting, NODE, "left_semi"), "trie-partings")
    paths = at.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*NODE))).alias("path"))
    sizes = rows.groupBy("conv_id").agg(F.max("depth").alias("size"))
    keyed = members.join(sizes, "conv_id", "left").join(paths, "conv_id", "left").withColumn("one", F.lit(1).cast("long"))
    return running(keyed.withColumn("size", F.coalesce("size", F.lit(0).cast("long"))), ["path", "conv_id"], {"rank": "one"}, drop=("path", "one")), at


def intervals(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows with pos, their node's position in preorder (the root's is 0), last, the last position of its subtree, and up, the
    position of the node above.

    In lexicographic order, a conversation brings the nodes from its first new parting down. Their running number ends
    where its own last node stands, and a node's subtree ends where that of its last member does.
    """
    order, at = ranked(rows, branches(rows), members)
    order = written(order, "trie-ranks")
    parted = written(at.join(order.select("conv_id", "rank"), "conv_id").groupBy(*NODE).agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")), "trie-spans")
    firsts = parted.groupBy(F.col("lo").alias("rank")).agg(F.min("depth").alias("from"))
    new = F.coalesce(F.col("size") - F.col("from") + 1, F.lit(0).cast("long"))
    ends = written(running(order.join(firsts, "rank", "left").withColumn("new", new), ["rank"], {"end": "new"}), "trie-ends")
    begun = ends.select(F.col("rank").alias("lo"), "from", (F.col("end") - F.col("new")).alias("before"))
    placed = parted.join(begun, "lo").join(ends.select(F.col("rank").alias("hi"), F.col("end").alias("last")), "hi")
    placed = written(placed.select(*NODE, (F.col("before") + 1 - F.col("from")).alias("shift"), (-F.col("last")).alias("back")), "trie-places")
    # Below a parting, positions grow with depth until the next one, whose shift is larger and whose end is no later.
    met = rows.select("conv_id", "words", *NODE).join(placed, NODE, "left")
    found = running(met, ["depth"], maxima={"by": "shift", "ahead": "back"}, group=("conv_id",), drop=("a", "b", "shift", "back"))
    up = F.when(F.col("depth") > 1, F.col("by_before") + F.col("depth") - 1).otherwise(F.lit(0).cast("long"))
    return written(found.select("conv_id", "depth", "words", (F.col("by") + F.col("depth")).alias("pos"), (-F.col("ahead")).alias("last"), up.alias("up")), "trie-rows")


def joined_digests(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and sha256 of its values in ascending order, comma-joined. Values are joined within ranges first; a key's digest is
    then computed over those pieces one after another, none of which is held longer than that."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = pa.table({"k": b.column(0), "first": b.column(1), "v": b.column(1).cast(pa.string())}).group_by("k", use_threads=False).aggregate([("first", "min"), ("v", "list")])
                k, first, many = (t[c].combine_chunks() for c in ("k", "first_min", "v_list"))
                yield pa.RecordBatch.from_arrays([k, first, pc.binary_join(many, ",")], names=[key, "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            keys, found = [], []
            for k, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if h is None or k != now:
                    if h is not None:
                        keys.append(now)
                        found.append(h.hexdigest())
                    now, h = k, hashlib.sha256(piece.encode())
                else:
                    h.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string())], names=[key, "sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=[key, "sha256"])

    dealt = rows.select(key, value).repartitionByRange(key, value).sortWithinPartitions(key, value)
    joined = dealt.mapInArrow(pieces, f"`{key}` long, first long, piece string")
    return joined.repartition(key).sortWithinPartitions(key, "first").mapInArrow(digests, f"`{key}` long, sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations: pos (preorder), last (of its subtree), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (1, 2, ... in each), key (16 bytes that stand for role and text), words. members: conv_id of all
    conversations, those without turns too, each once. A conversation that repeats another adds to n_convs alone. Totals
    over a subtree are the difference of running sums at its two ends. Without members there are no rows.
    """
    members = written(members.select("conv_id"), "trie-members")
    rows = intervals(named(turns), members)
    some = rows.groupBy("pos").agg(*(F.any_value(c).alias(c) for c in ("last", "depth", "up", "words")), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    zero = F.lit(0).cast("long")
    top = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    whole = rows.agg(F.coalesce(F.max("last"), zero).alias("last"))
    root = top.join(F.broadcast(whole), how="cross").select(zero.alias("pos"), "last", zero.alias("depth"), F.lit(None).cast("long").alias("up"), zero.alias("words"), "n_convs", "conv_id")
    nodes = some.unionByName(root).withColumn("leaf", (F.col("last") == F.col("pos")).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = written(running(nodes, ["pos"], {"leaves": "leaf", "saves": "saved"}), "trie-preorder")
    end = nodes.select(F.col("pos").alias("last"), F.col("leaves").alias("leaves_end"), F.col("saves").alias("saves_end"))
    below = nodes.filter("up is not null").groupBy(F.col("up").alias("pos")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("pos").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    stops = rows.groupBy("conv_id").agg(F.max_by("pos", "depth").alias("pos"))
    stops = members.join(stops, "conv_id", "left").select("conv_id", F.coalesce("pos", zero).alias("pos"))
    digests = joined_digests(stops, "pos", "conv_id")
    out = nodes.join(end, "last").join(below, "pos", "left").join(above, "up", "left").join(digests, "pos", "left")
    total = lambda e, x, own: (F.col(e) - F.col(x) + F.col(own))
    return out.select("pos", "last", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), total("leaves_end", "leaves", "leaf").alias("n_leaves"), total("saves_end", "saves", "saved").alias("saved_tokens"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt(conversations: DataFrame, apart: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and members of conversations whose first h turns are those of the conversation at the next lower multiple of
    `apart`, h being the crc32 of the conv_id modulo `most`. Rows without a conv_id belong to none and are left out."""
    turns = written(turns_of(conversations), "trie-numbered")
    h: Column = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    lengths = written(turns.groupBy("conv_id").agg(F.max("position").alias("n")), "trie-lengths")
    base = F.col("conv_id") - F.col("conv_id") % apart
    members = lengths.select("conv_id", base.alias("base"), h.alias("h")).join(lengths.select(F.col("conv_id").alias("base"), "n"), "base", "left")
    members = written(members.withColumn("shared", F.least("h", F.coalesce("n", F.lit(0).cast("long")))).drop("n"), "trie-shared")
    heads = turns.filter(F.col("position") < most).select(F.col("conv_id").alias("base"), F.col("position").alias("depth"), "key", "words")
    first = members.join(heads, "base").filter(F.col("depth") <= F.col("h")).select("conv_id", "depth", "key", "words")
    own = turns.join(members, "conv_id").filter(F.col("position") > F.col("h"))
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("shared")).alias("depth"), "key", "words")
    return first.unionByName(own), members.select("conv_id")


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations; odd rows as rebuilt and prefix_trie say."""
    turns, members = rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(turns, members).drop("pos", "last")
