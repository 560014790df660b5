"""Search by blocks with bounds gives the rows of the search that reads all, and reads less; pieces and their words."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from siftlake.operators import lists, pieces, sparse
from siftlake.scratch import written


@pytest.fixture(scope="module")
def corpus(spark):
    """Two tenants; a tenth of the documents are short, so that their weights are large; copies give equal scores."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        words = [f"t{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.choice([3, 6]) if i % 10 == 0 else rng.randrange(60, 120))]
        rows += [(f"s{i % 2}", i, t, c / len(words)) for t, c in collections.Counter(words).items()]
        if i % 50 == 0:
            rows += [(f"s{i % 2}", 5000 + i, t, c / len(words)) for t, c in collections.Counter(words).items()]
    postings = written(spark.createDataFrame(rows, "site_id string, doc_id long, term string, dw double").repartition(4), "corpus")
    sizes = postings.groupBy("site_id").agg(F.countDistinct("doc_id").alias("n"))
    asked = [(q, f"s{q % 2}", f"t{rng.randrange(60)}", rng.random()) for q in range(12) for _ in range(1 + q)] + [(90, "s0", "nowhere", 1.0), (91, "s7", "t1", 1.0), (92, "s0", "t399", 1.0)]
    queries = written(spark.createDataFrame(asked, "query_id long, site_id string, term string, qw double").groupBy("query_id", "site_id", "term").agg(F.sum("qw").alias("qw")), "asked")
    return postings, sizes, queries


def rows_of(df):
    return sorted((r.query_id, r.site_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize(("k", "group"), [(1, 300), (10, 300), (10, 5000), (2000, 300)])
def test_index_gives_all_rows(corpus, k, group):
    postings, sizes, queries = corpus
    found = sparse.indexed_search(queries, sparse.sparse_index(postings, sizes, group=group), k).found
    assert rows_of(found) == rows_of(sparse.sparse_topk(queries, postings, sizes, k))


def test_groups_without_a_chance_are_not_read(corpus):
    postings, sizes, queries = corpus
    index = sparse.sparse_index(postings, sizes, group=300)
    some = sparse.indexed_search(queries, index, 1)
    read, whole = some.first.count() + some.rest.count(), some.bounds.count()
    assert read < whole / 2
    assert len(some.shelves) < index.postings.select("shelf").distinct().count()
    plan = some.found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "shelf" in plan


def test_questions_of_all_tenants(spark, corpus):
    postings, sizes, queries = corpus
    index = sparse.sparse_index(postings, sizes, group=1000)
    asked = spark.createDataFrame([(1, "t3", 0.5), (1, "t8", 0.5)], "query_id long, term string, qw double")
    each = asked.crossJoin(sizes.select("site_id"))
    assert rows_of(sparse.indexed_search(asked, index, 5).found) == rows_of(sparse.sparse_topk(each, postings, sizes, 5))


def test_blocks_give_all_rows_to_questions_of_all_tenants(spark):
    """Also where a question or a document has no number."""
    docs = [("a", 1, {"red": 0.5, "fox": 0.5}), ("a", None, {"red": 0.5, "fox": 0.5}), ("a", 3, {"blue": 1.0}), ("b", 2, {"fox": 1.0}), ("b", 4, {"green": 1.0})]
    packed = spark.createDataFrame([(s, d, list(t), list(t.values())) for s, d, t in docs], "site_id string, doc_id long, terms array<string>, weights array<double>")
    asked = spark.createDataFrame([(1, ["fox", "nowhere"], [0.5, 0.5]), (None, ["blue", "fox"], [0.9, 0.1])], "query_id long, terms array<string>, weights array<double>")
    found = sparse.blocked_topk(asked, packed, packed.groupBy("site_id").agg(F.count("*").alias("n")), 2, block=2)
    got = {(r.query_id, r.site_id, r["rank"], r.doc_id) for r in found.collect()}
    assert got == {(1, "a", 1, 1), (1, "a", 2, None), (1, "b", 1, 2), (None, "a", 1, 3), (None, "a", 2, 1), (None, "b", 1, 2)}


def test_bm25_does_not_depend_on_partitions(spark):
    rows = [("s", d, f"w{i}", 1 + (d * i) % 3) for d in range(4) for i in range(128 if d else 64)]
    one = spark.createDataFrame(rows, "site_id string, doc_id long, term string, tf long")
    results = [sorted(map(tuple, sparse.bm25_weights(one.repartition(n), "site_id", "doc_id").collect())) for n in (1, 7)]
    assert results[0] == results[1] and abs(sum(r[3] for r in results[0] if r[1] == 1) - 1) < 1e-12


# Pieces


def best_cuts(word, scores, unknown, longest):
    best = [(0, [0])] + [None] * len(word)
    for e in range(1, len(word) + 1):
        ways = []
        for k in range(1, min(longest, e) + 1):
            s = scores.get(word[e - k : e], unknown if k == 1 else None)
            if s is not None and best[e - k]:
                ways.append((best[e - k][0] + s, k, [*best[e - k][1], e]))
        if ways:
            total, _, cuts = max(ways)
            best[e] = (total, cuts)
    return [word[a:b] for a, b in zip(best[-1][1], best[-1][1][1:], strict=False)]


@pytest.mark.parametrize("seed", range(3))
def test_segmentation_equals_brute_force(seed):
    rng = random.Random(seed)
    some = sorted({"".join(rng.choice("abé漢") for _ in range(rng.randrange(1, 6))) for _ in range(60)})
    scores = {p: -rng.randrange(1, 9) for p in some}
    model = pieces.Unigram(list(scores), list(scores.values()), -20)
    words = ["".join(rng.choice("abé漢z") for _ in range(rng.randrange(1, 30))) for _ in range(500)] + ["b" * 700]
    assert model.segment(words) == [best_cuts(w, scores, -20, 5) for w in words]


def test_double_array_finds_exactly_its_strings():
    rng = random.Random(1)
    strings = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(3000)})
    trie, held = pieces.DoubleArray(strings), set(strings)
    assert trie.depth == max(map(len, strings)) and len(trie.base) < 3 * sum(len({s[:k] for s in strings if len(s) >= k}) for k in range(1, 7))
    import numpy as np

    for s in [*strings[::7], *("".join(rng.choice("abcdefghi") for _ in range(rng.randrange(1, 9))) for _ in range(2000))]:
        node = np.zeros(1, np.int64)
        for c in s:
            node = trie.steps(node, np.array([trie.codes.get(c, 0)]))
        assert (node[0] >= 0 and trie.value[node[0]] >= 0) == (s in held)


TOKENS = ["<s>", "▁un", "able", "▁to", "s", "▁", "ing", "▁a", "</s>"]


@pytest.mark.parametrize("root", [False, True])
def test_words_of_pieces(spark, root):
    """The same words as the fold over an array; one-character pieces begin words; special tokens go."""
    rows = [(1, i, t, 0.25 * (i + 1)) for i, t in enumerate(TOKENS)] + [(2, 0, "able", 1.0), (2, 1, "▁x", -1.0)]
    table = spark.createDataFrame(rows, "k long, pos int, piece string, weight double").repartition(4)
    got = {(r.k, r.word_no): (r.word, float(r.weight)) for r in pieces.words_of_pieces(table, ["k"], "▁", root).collect()}
    words = [v for (k, _), v in sorted(got.items()) if k == 1]
    assert [w for w, _ in words] == ["unable", "to", "s", "▁ing", "a"]
    assert words[0][1] == pytest.approx((0.5**2 + 0.75**2) ** 0.5 if root else 1.25, abs=1e-6)
    assert [v[0] for (k, _), v in sorted(got.items()) if k == 2] == ["able", "x"]
    if not root:
        folded = spark.range(1).select(lists.subword_merge(F.array(*map(F.lit, TOKENS)), F.array(*[F.lit(0.25 * (i + 1)) for i in range(len(TOKENS))])).alias("m")).first().m
        assert [(r.word, r.weight) for r in folded] == words


def test_vectors_by_model(spark):
    """Three kinds of model give three vectors, the fourth none; a null text has none; weights of a text add up to 1."""
    vocabulary = spark.createDataFrame([("un", -3), ("able", -5), ("to", -2), ("run", -4), ("a", -1), ("b", -9), ("n", -9), ("r", -9), ("u", -9)], "piece string, score long")
    rows = spark.createDataFrame([(1, "Unable to run, unable!"), (2, None), (3, ""), (4, "a, a !"), (5, "zzz")], "k long, text string")
    found = {}
    for model in ("arctic", "e5", "jina", "mpnet"):
        out = pieces.sparse_vectors(rows, ["k"], model, vocabulary, -20).collect()
        found[model] = {(r.k, r.term): r.weight for r in out}
        sums = collections.Counter()
        for r in out:
            sums[r.k] += r.weight
        assert all(abs(s - 1) < 1e-9 for s in sums.values()) and not {2, 3, 4} & set(sums)
    assert not found["mpnet"] and len({tuple(sorted(v.items())) for v in found.values()}) == 4
    maps = {r.k: r.sparse for r in pieces.vectors(pieces.sparse_vectors(rows, ["k"], "arctic", vocabulary, -20), ["k"]).collect()}
    assert set(maps) == {1, 5} and abs(sum(maps[1].values()) - 1) < 1e-6
