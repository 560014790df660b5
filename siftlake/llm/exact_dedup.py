"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import SPACE, Scratch, documents, is_small, small, two_columns, written

#: Characters of the normalised text that the second refinement hashes.
PREFIX = 128
#: A group with at least this share of all rows is joined by broadcast (at most 1 / HOT_SHARE such groups exist).
HOT_SHARE = 1 / 1000


def normalised(text: str = "text"):
    return F.regexp_replace(F.col(text), f"{SPACE}+", " ")


def repeated_keys(keyed: DataFrame) -> DataFrame:
    """The pairs of length and prefix hash that two rows or more have; a length that one row has never gets so far."""
    lengths = written(keyed.groupBy("n").count().filter("count > 1").select("n"), "dedup-lengths")
    pairs = keyed.select("n", "prefix").join(small(lengths), "n", "left_semi").groupBy("n", "prefix").count().filter("count > 1")
    return written(pairs.select("n", "prefix"), "dedup-prefixes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, sha256 of the normalised text.

    Texts are equal when identical after each run of white space becomes one space; null counts as empty. The smallest
    id of equal texts stays (a null id only when all are null); rows that repeat both id and text are all marked kept.
    Lengths with one text are done after the first refinement, and exact pairs of length and prefix hash with one text
    after the second; only the rest is read again and hashed in full, and sha256 is null elsewhere. With digest_all, which
    asks for every digest, one reading of the texts gives digests too, and the refinements choose what is grouped by them.
    The refinements work on written numbers, and hot groups meet their rows by broadcast. An empty table gives no rows;
    other columns of docs are never read.
    """
    rows = two_columns(docs, id_col, text_col).select("doc_id", normalised().alias("text"))
    length, prefix, full = F.octet_length("text"), F.xxhash64(F.substring("text", 1, PREFIX)), F.sha2(F.col("text"), 256)
    digest = [full.alias("sha256")] if digest_all else []
    keyed = Scratch(rows.select("doc_id", length.alias("n"), prefix.alias("prefix"), *digest), "dedup-keys")
    pairs = small(repeated_keys(keyed.df))
    if digest_all:
        again = keyed.df.join(pairs, ["n", "prefix"], "left_semi").select("doc_id", "sha256")
    else:
        survivors = rows.select("doc_id", "text", length.alias("n"), prefix.alias("prefix")).join(pairs, ["n", "prefix"], "left_semi")
        again = survivors.select("doc_id", full.alias("sha256"))
    again = written(again, "dedup-hashes")
    alone = keyed.df.join(pairs, ["n", "prefix"], "left_anti")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col("sha256") if digest_all else F.lit(None).cast("string").alias("sha256"))
    groups = written(again.groupBy("sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "dedup-groups")
    least = max(100, int(keyed.df.count() * HOT_SHARE))
    hot, cold = groups.filter(F.col("group_size") >= least), groups.filter(F.col("group_size") < least)
    of_hot = again.join(F.broadcast(hot), "sha256")
    of_cold = again.join(F.broadcast(hot.select("sha256")), "sha256", "left_anti").join(cold, "sha256", "left").withColumn("keep_id", F.coalesce("keep_id", "doc_id")).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    names = ("doc_id", "keep_id", "group_size", "sha256")
    out = alone.unionByName(of_hot.select(*names)).unionByName(of_cold.select(*names))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text an earlier id has; all columns stay. Of rows repeated with id and text, one stays.

    A null text counts as empty; a row without an id goes if a row with one has its text. An empty table stays empty. What
    goes is known by id and digest; while those are few they are broadcast, no text moves, and only texts whose id is
    among them are hashed again.
    """
    marks = written(exact_dedup(docs, digest_all=True), "dedup-marks")
    drop = written(marks.filter(~F.col("kept")).select("doc_id", "sha256").distinct(), "dedup-drop")
    repeated = written(marks.filter("kept").groupBy("doc_id", "sha256").count().filter("count > 1").select("doc_id", "sha256"), "dedup-repeated")
    odd = drop if repeated.isEmpty() else written(drop.unionByName(repeated), "dedup-odd")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), F.col("text").alias("t"))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("t"), F.lit("")), f"{SPACE}+", " "), 256)
    if is_small(odd):
        digests = odd.groupBy("doc_id").agg(F.collect_set("sha256").alias("digests"))
        left = rows.join(F.broadcast(digests), F.col("i").eqNullSafe(digests["doc_id"]), "left").filter(F.coalesce(~(F.col("digests").isNotNull() & F.array_contains("digests", sha)), F.lit(True)))
    else:
        left = rows.withColumn("h", sha).join(odd.hint("merge"), F.col("i").eqNullSafe(odd["doc_id"]) & (F.col("h") == odd["sha256"]), "left_anti")
    if repeated.isEmpty():
        return left.select("row.*")
    held = rows.withColumn("h", sha).join(repeated, F.col("i").eqNullSafe(repeated["doc_id"]) & (F.col("h") == repeated["sha256"]), "left_semi").groupBy("i", "h").agg(F.first("row").alias("row"))
    return left.select("row.*").unionByName(held.select("row.*"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """exact_dedup over all documents; odd rows as told there."""
    out = exact_dedup(documents(spark, sf_dir), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


SQL_OP6 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
