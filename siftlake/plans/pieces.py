"""Token-level sparse vectors of all turns of conversations, one query for each kind of model."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.operators import pieces
from siftlake.plans.inputs import table
from siftlake.plans.registry import query
from siftlake.plans.scalars import murmur3_sql
from siftlake.plans.search import STOP
from siftlake.scratch import dealt, written

#: The stand-in for a model's vocabulary, which SQL has to know too: the most frequent sequences of up to four letters of the
#: table's words, each with its log share. A real model brings its own table.
PIECES, LONGEST, UNKNOWN = 2000, 4, -20_000
KEYS = ["conv_id", "turn"]
LETTERS = r"[\p{L}\p{M}]+"
RUNS = r"[\p{L}\p{M}]+|[^\p{L}\p{M}\x09-\x0D\x20]"


def vocabulary(turns):
    """piece, score: log shares in thousandths."""
    words = turns.select(F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"))).alias("word")).groupBy("word").count()
    # Few bytes of words become many grams: they are dealt by a given number before they are cut.
    at = dealt(written(words, "words"), "word", text="word").select("word", "count", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"), F.length("word").alias("size"))
    found = at.select("count", F.explode(F.array(*[F.when(F.col("i") + k - 1 <= F.col("size"), F.expr(f"substr(word, i, {k})")) for k in range(1, LONGEST + 1)])).alias("piece"))
    counts = written(found.filter("piece is not null").groupBy("piece").agg(F.sum("count").alias("n")), "grams")
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "piece").limit(PIECES)
    return top.crossJoin(F.broadcast(total)).select("piece", F.round(1000 * F.log(F.col("n") / F.col("total"))).cast("long").alias("score"))


def turn_vectors(spark, sf_dir, model):
    turns = table(spark, sf_dir, "conversations", *KEYS, "text")
    found = pieces.sparse_vectors(turns, KEYS, model, vocabulary(turns), UNKNOWN)
    return found.select(*KEYS, "term_id", F.round("weight", 6).alias("weight"))


SEGMENT_SQL = f"""words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{LETTERS}')) AS word FROM conversations) GROUP BY 1),
grams AS (SELECT substr(word, i, k) AS piece, sum(n) AS n FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words), range(1, {LONGEST + 1}) r(k) WHERE i + k - 1 <= length(word) GROUP BY 1),
vocabulary AS (SELECT piece, round(1000 * ln(n / (SELECT sum(n) FROM grams)))::BIGINT AS score FROM grams ORDER BY n DESC, piece LIMIT {PIECES}),
ends AS (SELECT word, e, coalesce(a.score, {UNKNOWN}) AS s1, b.score AS s2, c.score AS s3, d.score AS s4
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS e FROM words) LEFT JOIN vocabulary a ON a.piece = substr(word, e, 1) LEFT JOIN vocabulary b ON e >= 2 AND b.piece = substr(word, e - 1, 2)
  LEFT JOIN vocabulary c ON e >= 3 AND c.piece = substr(word, e - 2, 3) LEFT JOIN vocabulary d ON e >= 4 AND d.piece = substr(word, e - 3, 4)),
walk AS (
  SELECT word, 0::BIGINT AS e, 0::BIGINT AS b1, NULL::BIGINT AS b2, NULL::BIGINT AS b3, NULL::BIGINT AS b4, []::VARCHAR[] AS p1, []::VARCHAR[] AS p2, []::VARCHAR[] AS p3, []::VARCHAR[] AS p4 FROM words
  UNION ALL
  SELECT word, e, best, b1, b2, b3, CASE k WHEN 4 THEN list_append(p4, substr(word, e - 3, 4)) WHEN 3 THEN list_append(p3, substr(word, e - 2, 3)) WHEN 2 THEN list_append(p2, substr(word, e - 1, 2)) ELSE list_append(p1, substr(word, e, 1)) END, p1, p2, p3
  FROM (SELECT *, CASE best WHEN b4 + s4 THEN 4 WHEN b3 + s3 THEN 3 WHEN b2 + s2 THEN 2 ELSE 1 END AS k
    FROM (SELECT w.* EXCLUDE (e), n.e, s1, s2, s3, s4, greatest(b1 + s1, b2 + s2, b3 + s3, b4 + s4) AS best FROM walk w JOIN ends n ON n.word = w.word AND n.e = w.e + 1))),
segmented AS (SELECT word, p1 AS cut FROM walk WHERE e = length(word))"""
COUNTS_SQL = "list_transform(range(97, 123), lambda c: (length(lower({x})) - length(replace(lower({x}), chr(c::INT), '')))::DOUBLE)"
COSINE_SQL = "(CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) > 0 THEN list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})) ELSE 0 END)"
WEIGHTS_SQL = {
    "arctic": f"(SELECT p.*, -coalesce(score, {UNKNOWN}) AS weight FROM cut p LEFT JOIN vocabulary v ON v.piece = regexp_replace(p.piece, '^▁', ''))",
    "e5": f"(SELECT *, {COSINE_SQL.format(a=COUNTS_SQL.format(x='piece'), b='list_resize([1.0::DOUBLE], 26, 1.0::DOUBLE)')} AS weight FROM cut)",
    "jina": f"(SELECT c.*, {COSINE_SQL.format(a='letters', b='whole')} AS weight FROM (SELECT *, {COUNTS_SQL.format(x='piece')} AS letters FROM cut) c JOIN (SELECT conv_id, turn, {COUNTS_SQL.format(x='text')} AS whole FROM conversations) USING (conv_id, turn))",
}


def vectors_sql(model: str) -> str:
    mark = pieces.MARKS[model]
    total = "sqrt(sum(weight * weight)::DOUBLE)::DECIMAL(18, 6)" if pieces.VARIANTS[model].root else "sum(weight)::DECIMAL(18, 6)"
    return f"""WITH RECURSIVE {SEGMENT_SQL},
runs AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{RUNS}')) AS run, generate_subscripts(regexp_extract_all(text, '{RUNS}'), 1) AS i FROM conversations),
cut AS (SELECT conv_id, turn, i, j, CASE j WHEN 1 THEN '{mark}' || p ELSE p END AS piece FROM (SELECT conv_id, turn, i, unnest(coalesce(cut, [run])) AS p, generate_subscripts(coalesce(cut, [run]), 1) AS j FROM runs LEFT JOIN segmented ON word = run)),
numbered AS (SELECT conv_id, turn, i, j, piece, weight::DECIMAL(18, 6) AS weight, sum(CASE WHEN starts_with(piece, '{mark}') OR length(piece) = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i, j) AS word_no FROM {WEIGHTS_SQL[model]}),
folded AS (SELECT conv_id, turn, word_no, string_agg(CASE WHEN starts_with(piece, '{mark}') AND length(piece) > 1 THEN substr(piece, 2) ELSE piece END, '' ORDER BY i, j) AS word, {total} AS weight FROM numbered GROUP BY ALL),
sums AS (SELECT conv_id, turn, lower(word) AS term, sum(weight) AS s FROM folded WHERE weight > 0 AND regexp_matches(lower(word), '[\\p{{L}}\\p{{M}}\\p{{N}}]') AND lower(word) NOT IN {STOP} GROUP BY 1, 2, 3),
shares AS (SELECT conv_id, turn, term, s::DOUBLE / (sum(s) OVER (PARTITION BY conv_id, turn))::DOUBLE AS weight FROM sums), {murmur3_sql("sums")},
ids AS (SELECT conv_id, turn, term, weight, abs(CASE WHEN h >= 2147483648 THEN h::BIGINT - 4294967296 ELSE h::BIGINT END)::BIGINT AS term_id FROM shares JOIN murmur USING (term))
SELECT conv_id, turn, term_id, round(weight, 6) AS weight FROM ids QUALIFY row_number() OVER (PARTITION BY conv_id, turn, term_id ORDER BY term DESC) = 1"""


@query(vectors_sql("arctic"))
def sparse_arctic(spark, sf_dir):
    """A model that gives each token a weight of its own; a word's is their sum."""
    return turn_vectors(spark, sf_dir, "arctic")


@query(vectors_sql("e5"))
def sparse_e5(spark, sf_dir):
    """A model whose tokens weigh by their product with the delimiter's vector; a word's weight is their sum."""
    return turn_vectors(spark, sf_dir, "e5")


@query(vectors_sql("jina"))
def sparse_jina(spark, sf_dir):
    """A model whose tokens weigh by their product with the text's vector; a word's weight is the root of their squares' sum."""
    return turn_vectors(spark, sf_dir, "jina")
