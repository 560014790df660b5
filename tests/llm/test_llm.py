"""The training-data operators against brute force, round trips and held-out accuracy; odd inputs."""

import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlake.llm import bpe, common, encoding, exact_dedup, langid, licenses, lm, packing, quality, queries, simhash, token_output, toxicity
from siftlake.llm.common import text_slices, written

WORDS = "the of and to in is that for it as with was on be by at this from or an are".split()
LONG = " ".join(WORDS[i % 21] + str(i) for i in range(6000))
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "The cat sat on the mat and looked at the dog that ran by it."),
    (4, "The cat sat  on the mat\nand looked at the dog that ran by it."), (5, "é à 漢字 🙂 ñ"), (5, "é à 漢字 🙂 ñ"), (6, "123 !!! ###"),
    (7, LONG), (8, LONG + " x"), (9, "a " * 500), (None, "no id at all, but ten words are in here for sure"), (10, "\x00\x1f control"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, sha256 string, row string, fp long, key long, `b.c` int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns with the names that operators use."""
    rows = [(i, t, "en" if i and i % 2 else None, "s", -1, "x", "y", 3, 4, 5) for i, t in ODD]
    return written(spark.createDataFrame(rows, SCHEMA).repartition(3), "odd")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id = -1")


def texts_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()


OPERATORS = {
    "op1": lambda d: lm.lm_scores(d),
    "op2": lambda d: licenses.license_scan(d),
    "op3": lambda d: langid.predict(d, langid.learned(d)),
    "op4": lambda d: bpe.encode_decode(d, bpe.load(d.sparkSession), with_ids=False),
    "op5": lambda d: toxicity.toxicity(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")),
    "op6": lambda d: exact_dedup.exact_dedup(d),
    "op9": lambda d: quality.quality_rules(d),
    "op10": lambda d: simhash.simhash_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(odd, none, name):
    found = OPERATORS[name](odd).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _ in ODD)
    assert OPERATORS[name](none).count() == 0


EMPTY = hashlib.sha256(b"").hexdigest()


def odd_values(name, odd):
    """Rows by (id, place among equal ids in the order of texts' appearance is lost, so equal ids come as a list)."""
    out = collections.defaultdict(list)
    for r in OPERATORS[name](odd).collect():
        out[r.doc_id].append(r)
    return out


def test_odd_values_of_scores(odd):
    got = odd_values("op1", odd)
    assert [got[i][0].n_tokens for i in (0, 1, 2, 3, 7, 9)] == [1, 1, 1, 16, 6001, 501]
    assert got[0][0].score == got[1][0].score == got[2][0].score and got[5][0].score == got[5][1].score
    assert got[None][0].held_out and got[None][0].n_tokens == 13  # a null id counts as the empty text, whose checksum is 0
    assert got[5][0].n_known == (6 if zlib.crc32(b"5") % 10 else 1)
    got = odd_values("op5", odd)
    assert got[0][0].score == got[1][0].score == got[2][0].score and got[5][0] == got[5][1]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for own in got.values() for r in own)


def test_odd_values_of_scans(odd):
    got = odd_values("op2", odd)
    for i, t in ODD:
        r = got[i][0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_phrases(t or "") and r.labels == "" and r.score == 0
    got = odd_values("op3", odd)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for i in (0, 1, 2, 6) for r in got[i])
    assert all(r.lang_pred == "en" for i in (3, 4, 5, 7, 8, 9, 10, None) for r in got[i])  # the one language that is learned
    got = odd_values("op9", odd)
    for i, t in ODD:
        r = got[i][0]
        if t not in (LONG, LONG + " x"):
            assert (*(r[c] for c in quality.COUNTS), r.base_failed, r.n_covered, r.longest_repeat, r.kept) == brute_quality(t or "")
    assert got[7][0].n_words == 6000 and got[7][0].kept and got[9][0].longest_repeat == 499 and not got[9][0].kept


def test_odd_values_of_ids(odd):
    got = odd_values("op4", odd)
    for i, t in ODD:
        ids = np.array(REFERENCE.encode_ordinary(t or ""), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want for r in got[i])
    assert got[0][0].n_tokens == 0 and got[0][0].decoded_sha256 == EMPTY


def test_odd_values_of_groups(odd):
    got = odd_values("op6", odd)
    assert [(r.keep_id, r.group_size, r.kept) for i in (0, 1, 2, 3, 4) for r in got[i]] == [(0, 2, True), (0, 2, False), (2, 1, True), (3, 2, True), (3, 2, False)]
    assert [(r.keep_id, r.group_size, r.kept) for r in got[5]] == [(5, 2, True)] * 2
    assert [(r.keep_id, r.group_size, r.kept) for i in (7, 8, None) for r in got[i]] == [(7, 1, True), (8, 1, True), (None, 1, True)]
    got = odd_values("op10", odd)
    assert all(r.fingerprint == f"{brute_print(t):016x}" for i, t in ODD for r in got[i])
    assert [got[i][0].component_id for i in (0, 1, 2, 3, 4, 7, 8)] == [0, 0, 0, 3, 3, 7, 7] and got[None][0].component_id is None


def test_packing_and_output_of_odd_rows(spark, odd, none, tmp_path):
    packed = packing.best_fit_packing(odd).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in ODD}
    check_packing([r for r in packed if r.doc_id != 5], {i: t for i, t in ODD if i != 5}, gaps=True)
    assert len({(r.length, r.ids_crc32) for r in packed if r.doc_id == 5}) == 1 and sum(r.doc_id == 5 for r in packed) == 2
    assert packing.best_fit_packing(none).count() == 0
    token_output.write_tokens(odd, str(tmp_path / "t"))
    back = token_output.read_tokens(spark, str(tmp_path / "t")).collect()
    start, want = 0, []
    for i, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)):  # a null id comes first
        want.append((i, start, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())))
        start += want[-1][2]
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in back), key=lambda r: r[1]) == want
    token_output.write_tokens(none, str(tmp_path / "n"))
    assert token_output.read_tokens(spark, str(tmp_path / "n")).count() == 0


def test_pipeline(spark, sf, odd, none, tmp_path):
    import corpus_pipeline

    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns
            docs = written(out, "test-stage")
    kept = {r.doc_id for r in docs.collect()}
    assert 3 in kept and 7 in kept and None in kept and not kept & {0, 1, 2, 4, 6}
    assert {r.doc_id for r in out.collect()} == kept
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_pipeline_equals_brute_force(spark, sf):
    import corpus_pipeline

    docs = texts_of(spark, sf)
    model = langid.learned(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs]
    found, score = model.predict([t for _, t in rows])
    rows = [r for r, x, y in zip(rows, found, score, strict=True) if x != "und" and y >= langid.LEAST_SCORE]
    rows = [r for r in rows if brute_quality(r[1])[-1]]
    first = {}
    rows = [r for r in rows if first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r[0]) == r[0]]
    label = brute_near_copies([t for _, t in rows])
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    check_packing(got, dict(rows))


# op1


def brute_base(docs):
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    counts = collections.Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(token(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (zlib.crc32(str(i).encode()) % 10 == 0, len(token(t)), sum(x in counts for x in token(t)), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in token(t))) for i, t in docs}


@pytest.mark.parametrize("head", [100_000, 500])
def test_lm_scores(spark, sf, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    want = brute_base([(r.doc_id, r.text) for r in texts_of(spark, sf)])
    got = queries.op1_lm_scoring(spark, sf).toPandas()
    assert len(got) == len(want)
    for r in got.itertuples():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score < 0).all()


def test_lm_scores_do_not_depend_on_files(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = ({r.doc_id: r.score for r in lm.lm_scores(docs.orderBy(order).repartition(n)).collect()} for n, order in ((2, "doc_id"), (7, F.desc("text"))))
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i], rel=1e-9) for i in one)


@pytest.mark.parametrize("head", [100_000, 1500])
def test_lm_scores_equal_brute_force(spark, sf, monkeypatch, head):
    """Each word's probability by itself: the softmax over all classes of the two classes before it, times its share there."""
    monkeypatch.setattr(lm, "HEAD", head)
    docs = written(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "lm-docs")
    learned = docs.filter(lm.remainder(lm.FOLDS) != lm.HELD_OUT)
    counts = written(lm.count_words(learned), "lm-counts")
    vocabulary = lm.vocabulary_of(counts, learned.count())
    model = lm.train(learned, vocabulary)
    got = {r.doc_id: r.score for r in lm.score_documents(docs, counts, vocabulary, model).collect()}
    seen = {bytes(r.token): r.c for r in counts.collect()}
    own = set(list(vocabulary.words)[: lm.OWN])
    kind = {w: 1 + i for i, w in enumerate(list(vocabulary.words)[: lm.OWN])}
    of = lambda w: kind.get(w) or lm.bin_of(w)
    held, kinds = collections.Counter(), collections.Counter()
    for w, c in seen.items():
        if w not in own:
            held[of(w)] += c
            kinds[of(w)] += 1

    def share(w):
        if w in own or not held[of(w)]:
            return 1.0
        return (seen[w] - lm.DISCOUNT) / held[of(w)] if w in seen else lm.DISCOUNT * kinds[of(w)] / held[of(w)]

    for b in list(held)[:20]:  # the shares of a bin's words and of all unseen words in it sum to 1
        assert sum(share(w) for w in seen if w not in own and of(w) == b) + lm.DISCOUNT * kinds[b] / held[b] == pytest.approx(1)
    r, bias, a, c = (model.parts[k].astype(np.float64) for k in "rbac")

    def log_share(u, v, w):
        s = r @ (r[u] @ a + r[v] @ c) + bias
        return s[w] - s.max() - math.log(np.exp(s - s.max()).sum())

    for row in docs.limit(25).collect():
        total, before = 0.0, (lm.END, lm.END)
        for w in [*row.text.encode().lower().split(), None]:
            k = lm.END if w is None else of(w)
            total += log_share(*before, k) / math.log(10) + (0 if w is None else math.log10(share(w)))
            before = (k, before[0])
        assert got[row.doc_id] == pytest.approx(total, rel=1e-4)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    noise = rng.random(40) + 0.1
    model = lm.Bilinear(noise / noise.sum())
    for _ in range(5):
        model.learn(*rng.integers(0, 40, (3, 500)), rng, 0.1)
    one, two, z = model.tables()
    p = np.exp(one[:, None, :] + two[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)


def test_lm_learns_a_sequence():
    rng = np.random.default_rng(0)
    kinds = np.tile([1, 2, 3, 4], 4000)
    model = lm.Bilinear(np.array([0.01, 0.25, 0.25, 0.25, 0.24]))
    for _ in range(20):
        model.train(kinds, np.array([len(kinds)]), rng, 0.3)
    one, two, z = model.tables()
    assert np.exp(one[2, 3] + two[1, 3] - z[2, 1]) > 0.9


def test_words_of_a_class_sum_to_one():
    head = [(b"w%d" % i, 1500 - i) for i in range(lm.OWN)]
    rest = [(b"r%dxy" % i, 3 + i) for i in range(20)]
    bins = collections.defaultdict(lambda: (0, 0))
    for w, c in head + rest:
        b = lm.bin_of(w)
        bins[b] = (bins[b][0] + c, bins[b][1] + 1)
    v = lm.Vocabulary(head + rest, dict(bins), 10, sum(c for _, c in head + rest), len(head + rest))
    b = lm.bin_of(b"zxy")
    inside = [10 ** v.inside[v.words[w]] for w, _ in rest if lm.bin_of(w) == b]
    assert inside and sum(inside) + 10 ** v.unseen[b - 1 - lm.OWN] == pytest.approx(1)


# op2


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        q = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(q)] == q]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["GNU", "general", "Public", "license", "apache", "mit", "CC", "by", "-nc", "\n", "é", "K", "_", "."]), max_size=30), st.sampled_from([" ", "-", "\t"]))
def test_license_places(parts, glue):
    text = glue.join(parts)
    assert licenses.scan(text, licenses.automaton())[:5] == brute_phrases(text)


def test_licenses_of_the_corpus(spark, sf):
    found = licenses.automaton()
    for r in texts_of(spark, sf):
        got = licenses.scan(r.text, found)
        assert got[:5] == brute_phrases(r.text)
        assert set(filter(None, got[4].split(","))) <= set(got[5].split(",")) and 0 <= got[6] <= 1


def test_license_query(spark, sf):
    got = {r.doc_id: r for r in queries.op2_license_scan(spark, sf).collect()}
    for r in texts_of(spark, sf):
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute_phrases(r.text)


@pytest.mark.parametrize("line,permissive,labels", [
    ("MIT", True, "mit,spdx"), ("MIT OR GPL-2.0-only", True, "gpl,mit,spdx"), ("MIT AND GPL-2.0-only", False, "gpl,mit,spdx"),
    ("GPL-2.0-only WITH Classpath-exception-2.0 OR (Apache-2.0 AND BSD-3-Clause)", True, "apache,bsd,gpl,spdx"),
    ("MIT OR GPL-2.0-only AND MPL-2.0 */", True, "gpl,mit,mpl,spdx"), ("(MIT OR GPL-3.0) AND MPL-2.0", False, "gpl,mit,mpl,spdx"),
    ("MITRE-X", False, "other,spdx"), ("GPL-2.0+", False, "gpl,spdx"), ("OFL-1.1 OR EPL-2.0", False, "epl,ofl,spdx"),
    ("(MIT\n//  OR GPL-2.0-only\n// ) AND ISC", True, "gpl,isc,mit,spdx"), ("(MIT OR\n * Zlib)\n * MPL-2.0", True, "mit,spdx,zlib"),
])
def test_license_expressions(line, permissive, labels):
    got = licenses.scan(f"// SPDX-License-Identifier: {line}\nint x;", licenses.automaton())
    assert got[5] == labels and got[8] is permissive and got[6] == pytest.approx(0.9)


@pytest.mark.parametrize("line", ["", "(MIT", "AND MIT", "MIT OR", ")", "GPL-2.0-only WITH (MIT OR ISC)", "(MIT OR ISC) WITH LLVM-exception", "MIT WITH x WITH y"])
def test_unreadable_expressions(line):
    assert licenses.postfix(line) is None


def test_families_are_whole_identifiers():
    names = ["mit", "mitre-x", "cc-by-nc-sa-4.0", "cc-by-4.0", "gpl-3.0-or-later", "gpl-9.0", "bsd-3-clause-clear", "apache-2.0", "apache"]
    assert [licenses.family(x) for x in names] == ["mit", "other", "cc-by-nc", "cc-by", "gpl", "other", "bsd", "apache", "other"]


# op3


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def brute_languages(rows):
    """Naive Bayes over the n-grams of one text at a time: doc_id to (language, score)."""
    m32 = 0xFFFFFFFF

    def grams(text):
        codes = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32] * 3
        for n in (1, 2, 3):
            for i in range(len(codes) - n + 1):
                h = 0
                for k, c in enumerate(codes[i : i + n]):
                    h = (h * 0x9E3779B1 + c * 0x85EBCA6B + k + 1) & m32
                yield ((h ^ h >> 15) * 0x2C1B3C6D & m32) >> 17

    sums, n_docs = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t, lang in rows:
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            n_docs[lang] += 1
            if any(map(str.isalpha, t)):
                sums[lang].update(grams(t))
    names, out = sorted(n_docs), {}
    total = {x: sum(sums[x].values()) + langid.SMOOTHING * langid.CELLS for x in names}
    for i, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            out[i] = ("und", 0.0)
            continue
        counts = collections.Counter(grams(t))
        size = math.sqrt(3 * (len(t.lower()) + 3))
        logit = [sum(c * math.log((sums[x][g] + langid.SMOOTHING) / total[x]) for g, c in counts.items()) / size + math.log((n_docs[x] + 1) / (n_docs.total() + len(names))) for x in names]
        top = max(logit)
        out[i] = (names[logit.index(top)], 1 / sum(math.exp(x - top) for x in logit))
    return out


def test_language_query_equals_brute_force(spark, sf):
    want = brute_languages([(r.doc_id, r.text, r.lang) for r in texts_of(spark, sf)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op3_language_id(spark, sf).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-4) for i in want)


def test_languages_do_not_depend_on_neighbours(spark, sf):
    model = langid.learned(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = [r.text for r in texts_of(spark, sf)][:40] + ["\U00020000\U00020001", "12", ""]
    together, scores = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert together == [a[0][0] for a in alone] and np.allclose(scores, [a[1][0] for a in alone], atol=1e-6)
    assert together[-3] != "und" and together[-2:] == ["und", "und"]


def test_languages_are_learned_from_the_rest_alone(spark):
    rows = [(i, "bonjour le monde" if i % 2 else "guten tag die welt", "fr" if i % 2 else "de") for i in range(40)]
    model = langid.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "fr"] and model.predict(["le monde", "die welt", "12 !", ""])[0] == ["fr", "de", "und", "und"]
    assert langid.Model([], np.zeros((0, langid.CELLS)), np.zeros(0)).predict(["x"])[0] == ["und"]


def test_nothing_learned_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.keep_known(docs).collect()] == [1]


# op4, op7, op8


@pytest.fixture(scope="module")
def coder():
    return bpe.load(None)


def reference():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(coder):
    keys = list(coder.ranks)
    assert sorted(coder.hash.slots(keys).tolist()) == list(range(len(keys)))
    assert all(coder.hash.values[s] == coder.ranks[k] for s, k in zip(coder.hash.slots(keys[:2000]).tolist(), keys[:2000], strict=True))
    assert (coder.hash.slots([b"no such word at all", b""]) == -1).all()
    assert bpe.PerfectHash([]).slots([b"x"]).tolist() == [-1]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_bpe_equals_the_library(coder, text):
    ids = coder.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text) and coder.decode(ids) == text.encode()


REFERENCE = reference()


def test_bpe_query(spark, sf):
    got = {r.doc_id: r for r in queries.op4_bpe_encode_decode(spark, sf).collect()}
    for r in texts_of(spark, sf):
        ids = np.array(REFERENCE.encode_ordinary(r.text), "<u4")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


TOKENIZER = Tokenizer.from_file(encoding.default_path())
TOKENIZER.encode_special_tokens = True


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é'\n\t .1s\xa0 漢"), max_size=60), max_size=6))
def test_encoder_equals_the_library(texts):
    ids, edges = ENCODER.encode(pa.array(texts, pa.string()), 2)
    want = [TOKENIZER.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(edges)] == want


ENCODER = encoding.Encoder(encoding.default_path())


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(encoding, "MEMO", 5)
    own = encoding.Encoder(encoding.default_path())
    for _ in range(3):
        for text in ("one two three four five six", "six seven eight nine ten <|endoftext|> one"):
            assert own.encode(pa.array([text]))[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def ids_of(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def check_packing(rows, docs, gaps=False):
    places = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at or gaps and offset > at
            at = offset + length
        assert at <= 1024
    assert set(pieces) == set(docs)
    for i, own in pieces.items():
        ids = ids_of(docs[i])
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        assert sorted(own) == [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(edges))]


def test_packing_query(spark, sf):
    rows = queries.op7_best_fit_packing(spark, sf).collect()
    check_packing(rows, {r.doc_id: r.text for r in texts_of(spark, sf)})
    assert len({r.sequence_id for r in rows}) <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_packed_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, LONG)], "doc_id long, text string")
    for r in packing.best_fit_packing(docs, with_ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=20))
def test_plans_place_every_piece(histogram):
    counts = np.zeros(65, np.int64)
    for n, k in histogram.items():
        counts[n] = k
    made = packing.plan(counts, 64)
    placed = np.zeros(65, np.int64)
    for repeats, lengths in made:
        assert sum(lengths) <= 64
        for n in lengths:
            placed[n] += repeats
    assert (placed == counts).all()
    assert sum(n for n, _ in made) <= sum(n for n, _ in packing.best_fit(counts, 64))


def test_best_fit_is_item_by_item():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 50, 300)
    free = []
    for s in sorted(sizes.tolist(), reverse=True):
        fits = [f for f in free if f >= s]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - s)
        else:
            free.append(64 - s)
    assert sum(n for n, _ in packing.best_fit(np.bincount(sizes, minlength=65), 64)) == len(free)


def test_token_output_query(spark, sf, tmp_path):
    start, want = 0, {}
    for r in texts_of(spark, sf):
        ids = ids_of(r.text)
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_output(spark, sf).collect()} == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    token_output.write_tokens(docs, str(tmp_path / "t"), block_ids=5000)
    got = token_output.read_tokens(spark, str(tmp_path / "t")).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=60), min_size=1, max_size=6), st.sampled_from([0, 70_000]), st.integers(1, 5))
def test_repair_round_trip(docs, base, rounds):
    ids = np.array([x + base for d in docs for x in d], np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    data = token_output.write_block(np.arange(len(docs)), np.ones(len(docs), bool), ids, edges, rounds=rounds, pairs=8, least=2)
    block = token_output.Block(data)
    assert (block.decode() == ids).all()
    for i in range(len(docs)):
        assert (block.decode(i, i + 1) == ids[edges[i] : edges[i + 1]]).all()


def test_repair_compresses():
    ids = np.tile(np.arange(10, dtype=np.uint32), 5000)
    base, rules, symbols, _ = token_output.repair(ids, np.zeros(len(ids), bool), rounds=3)
    assert len(rules) and len(symbols) < len(ids) / 4


@pytest.mark.parametrize("base", [0, 60_000, 70_000])
def test_repair_goes_on_until_no_pair_is_frequent(base):
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.tile(np.arange(16), 20_000), rng.integers(0, 2000, 100_000)]).astype(np.uint32) + np.uint32(base)
    first, rules, symbols, _ = token_output.repair(ids, np.zeros(len(ids), bool))
    _, times = np.unique(symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:], return_counts=True)
    assert times.max() < token_output.LEAST and token_output.expansion_lengths(first, rules).max() > 1000
    data = token_output.write_block(np.arange(1), np.ones(1, bool), ids, np.array([0, len(ids)]))
    assert (token_output.Block(data).decode() == ids).all()


# op5


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(3000):
        toxic = int(rng.random() < 0.1)
        words = [f"w{x}" for x in map(chr, rng.integers(97, 123, 60))] + [f"{a}{b}" for a, b in zip(rng.choice(WORDS, 40), rng.choice(WORDS, 40), strict=True)]
        if toxic:
            words.insert(5, "krall" + rng.choice(WORDS))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    truth = dict(labels)
    held = got[got.held_out]
    hit = [(p, truth[i]) for i, p in zip(held.doc_id, held.predicted, strict=True)]
    assert sum(p for p, y in hit if y) >= 0.9 * sum(y for _, y in hit) and sum(p for p, y in hit if not y) <= 0.01 * len(hit)
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you are a stupid idiot"), (2, "a calm day")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert got == {1: 1, 2: 0}


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.2).astype(float)
    vote = lambda on, off: (rng.random(4000) < np.where(y > 0, on, off)).astype(float)
    good, weak = vote(0.7, 0.02), vote(0.3, 0.15)
    q = toxicity.label_model(np.stack([good, *[weak] * 6], 1), y)
    assert q[(good == 1) & (weak == 0)].mean() > q[(good == 0) & (weak == 1)].mean()


# op6


def test_exact_dedup_levels(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "a  b", "a\nb", "c d", "x" * 300 + "1", "x" * 300 + "2", "x" * 300 + "1", None, ""])] + [(1, "a  b")]
    got = sorted(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest_all=True).collect())
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [(0, 0, 4, True), (1, 0, 4, False), (1, 0, 4, False), (2, 0, 4, False), (3, 3, 1, True), (4, 4, 2, True), (5, 5, 1, True), (6, 4, 2, False), (7, 7, 2, True), (8, 7, 2, False)]
    assert all(len(r.sha256) == 64 for r in got)


def test_keep_first_with_repeated_ids(spark):
    rows = [(1, "a", 7), (1, "a", 7), (1, "b", 8), (2, "b", 9), (3, "c", 1), (None, "d", 2), (None, "d", 2)]
    got = exact_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, sha256 int"))
    assert sorted(got.collect(), key=str) == sorted([(1, "a", 7), (1, "b", 8), (3, "c", 1), (None, "d", 2)], key=str)


def test_hot_group(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'copy  of one' else concat('text ', id) end as text")
    got = exact_dedup.exact_dedup(rows).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in got} == {True: 2001, False: 999}


# op9


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    five = {k for i in range(n - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    at = collections.defaultdict(list)
    for i in range(n - 4):
        at[tuple(w[i : i + 5])].append(i)
    best, cover = 0, set()
    for own in at.values():
        for i in own:
            r = 0
            for j in own:
                if i != j:
                    k = 5
                    while max(i, j) + k < n and w[i + k] == w[j + k]:
                        k += 1
                    r = max(r, k)
            best = max(best, r)
            if r >= quality.REPEAT:
                cover.update(range(i, i + r))
    failed = n < 10 or 100 * len(five) > 20 * n
    kept = not failed and len(cover) <= quality.COVERED * n and best <= max(quality.LONGEST, quality.LONGEST_SHARE * n)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(five), failed, len(cover), best, kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "é", "#", "\n", "d e f g h i j k", "d e f g h i j k l"]), max_size=40), max_size=4))
def test_quality_measures(parts):
    texts = [" ".join(p) for p in parts]
    m = quality.measure(pa.array(texts, pa.string()))
    failed, kept = quality.verdicts(m)
    for i, t in enumerate(texts):
        got = (*(int(m[c][i]) for c in quality.COUNTS), bool(failed[i]), int(m["n_covered"][i]), int(m["longest_repeat"][i]), bool(kept[i]))
        assert got == brute_quality(t)


def test_quality_query(spark, sf):
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, sf).collect()}
    for r in texts_of(spark, sf):
        g = got[r.doc_id]
        assert (*(g[c] for c in quality.COUNTS), g.base_failed, g.n_covered, g.longest_repeat, g.kept) == brute_quality(r.text)


# op10


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_query(spark, sf):
    rows = texts_of(spark, sf)
    prints = np.array([brute_print(r.text) for r in rows], np.uint64)
    label = simhash.components(len(rows), *simhash.compare(prints, 2))
    want = {r.doc_id: (f"{int(p):016x}", rows[k].doc_id) for r, p, k in zip(rows, prints, label, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_near_dedup(spark, sf).collect()} == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_tree_loses_no_link(radius):
    rng = np.random.default_rng(radius)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for _ in range(3):
        x = np.concatenate([x, x[rng.integers(0, len(x), 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))])
    x = np.unique(x)
    want = simhash.components(len(x), *simhash.compare(x, radius))
    assert (simhash.components(len(x), *simhash.links(x, radius)) == want).all()
    rows, shard = simhash.route(x, simhash.build_tree(x, len(x), radius, 200), radius)
    found = [(rows[shard == k][a], rows[shard == k][b]) for k in range(shard.max() + 1) for a, b in [simhash.links(x[rows[shard == k]], radius)]]
    a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    assert shard.max() > 5 and (simhash.components(len(x), a, b) == want).all()


def test_crowded_group(monkeypatch):
    base = np.uint64(0x123456789ABCDEF0)
    x = np.unique(np.array([base ^ np.uint64(sum(1 << k for k in c)) for n in range(4) for c in itertools.combinations(range(16), n)], np.uint64))
    want = simhash.components(len(x), *simhash.compare(x, 2))
    for keys in (8_000_000, 5000):
        monkeypatch.setattr(simhash, "KEYS", keys)
        assert (simhash.components(len(x), *simhash.crowded(x, 2)) == want).all()


def brute_shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near_copies(texts):
    """The smallest place that each text is linked to by a Jaccard similarity of 0.8 of five-word shingles."""
    sets = [brute_shingles(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    return simhash.components(len(sets), *(np.array([p[k] for p in pairs], np.int64) for k in (0, 1)))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.integers(0, 60), st.integers(0, 60), st.integers(0, 5))
def test_parities_never_part_alike_sets(x, drop, add, seed):
    rng = np.random.default_rng(seed)
    x = np.array(sorted(x), np.uint64)
    y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
    if len(x) and len(y) and simhash.alike(x, y):
        assert simhash.may_be_alike(pa.scalar(simhash.parity(x)), pa.scalar(simhash.parity(y)), len(x) + len(y))


def test_parities_part_unlike_sets():
    rng = np.random.default_rng(1)
    x, y = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (300, 250))
    half = np.concatenate([x[:150], y[:100]])
    for z in (y, half):
        assert not simhash.may_be_alike(pa.scalar(simhash.parity(x)), pa.scalar(simhash.parity(z)), len(x) + len(z))


@pytest.mark.parametrize("paired", [32, 2])
def test_near_copies_equal_brute_force(spark, sf, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(5)
    rows = {r.doc_id: r.text or "" for r in texts_of(spark, sf)}
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    for i in range(60):  # a crowd whose members are like some others only
        words = list(base)
        for k in rng.integers(0, 120, 1 + i % 7):
            words[k] = f"x{rng.integers(0, 5000)}"
        rows[10_000 + i] = " ".join(words[i % 20 :])
    ids = sorted(rows)
    label = brute_near_copies([rows[i] for i in ids])
    docs = spark.createDataFrame([(i, t) for i, t in rows.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: ids[label[k]] for k, i in enumerate(ids)}
    assert got[177] == 1 and got[145] == 6  # 7 and 11 bits apart


def test_near_copies_go_by_id_and_text(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base, "x"])
    other = " ".join(f"v{k}" for k in range(30))
    rows = [(1, " ".join(base)), (2, near), (2, other), (None, near + " y"), (None, other + " alone in the end of a text"), (3, None), (4, ""), (5, other), (5, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, " ".join(base)), (2, other), (None, other + " alone in the end of a text"), (3, None)], key=str)
    assert simhash.keep_one(docs.filter("doc_id > 9")).count() == 0


@pytest.mark.parametrize("few", [200_000, 5])
def test_connected_chain(spark, monkeypatch, few):
    monkeypatch.setattr(common, "BROADCAST", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.u: r.root for r in simhash.connected(edges).collect()}
    assert {got.get(i, i) for i in range(41)} == {0} and got[101] == 100
    assert simhash.connected(edges.filter("a < 0")).count() == 0


def test_scratch_is_below_the_shared_folder(spark):
    from siftlake.llm import common

    kept = common.Scratch(spark.range(3), "x")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert kept.path.startswith(f"{shared}/siftlake-" if shared else "file:///") and kept.df.count() == 3
    kept.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(kept.path)


def test_about_is_bounded_and_repeatable(spark):
    from siftlake.llm.common import about

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    one = {r.doc_id for r in about(rows, 1000, 20_000, "doc_id").collect()}
    assert 800 < len(one) < 1200 and one == {r.doc_id for r in about(rows.repartition(7), 1000, 20_000, "doc_id").collect()}
    assert about(rows, 30_000, 20_000, "doc_id").count() == 20_000


def test_slices_lose_nothing():
    texts = ["x" * n for n in (0, 5, 3000, 1, 0, 70)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [t for s in text_slices([batch, batch], 100) for t in s.column(0).to_pylist()]
    assert got == texts * 2


def test_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names

