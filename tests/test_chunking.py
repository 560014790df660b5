"""Chunk rules: the platform's own cases, and invariants on random texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlake.operators.chunking import chunk_documents, chunks, pack, register, sentence_spans

FIVE = "Rain fell at dawn. The mill stood idle. Geese crossed the weir. Nobody rang. Night came back."


def test_size_zero_is_one_chunk():
    assert chunks(FIVE, 0, 50) == [(0, FIVE)]


def test_short_text_is_one_chunk():
    assert chunks("Rain fell at dawn. Nobody rang.", 1000, 200) == [(0, "Rain fell at dawn. Nobody rang.")]


def test_empty_and_white_space():
    assert chunks("", 10, 2) == []
    assert chunks("   \n\t   ", 100, 20) == [(0, "   \n\t   ")]
    assert chunks(" " * 30, 10, 2) == [(0, " " * 30)]


def test_one_long_sentence():
    text = "word " * 50 + "end."
    assert [c for _, c in chunks(text, 100, 20)] == [text]


def test_separators_stay_inside():
    text = "One is here.  Two is here.\n\nThree is here.\tFour is here."
    got = chunks(text, 30, 10)
    assert all(text[o : o + len(c)] == c for o, c in got)
    assert any("  " in c or "\n\n" in c or "\t" in c for _, c in got)


def test_a_sentence_is_lost_unless_lossless():
    # lengths 100, 20, 190, 60, 30 with one character between: size 200, overlap 50
    at, spans = 0, []
    for n in (100, 20, 190, 60, 30):
        spans.append((at, at + n))
        at += n + 1
    assert pack(spans, 200, 50) == [(0, 2), (1, 2), (3, 5)]
    assert {i for a, b in pack(spans, 200, 50, lossless=True) for i in range(a, b)} == set(range(5))


def loop(spans, size, overlap):
    """The rule step by step: a chunk from s, then back by one sentence if that fits the overlap."""
    out, i, s, n = [], 0, 0, len(spans)
    while i < n:
        end = s + 1
        while end < n and spans[end][1] - spans[s][0] <= size:
            end += 1
        out.append((s, end))
        i = end if i == 0 else max(end, i + 1)
        if i >= n:
            break
        s = i - 1 if i > 0 and spans[i - 1][1] - spans[i - 1][0] <= overlap else i
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=25), st.integers(1, 400), st.integers(0, 200))
def test_pack_equals_the_loop(lengths, size, overlap):
    at, spans = 0, []
    for n in lengths:
        spans.append((at, at + n))
        at += n + 1
    assert pack(spans, size, overlap) == loop(spans, size, overlap)
    covered = {i for a, b in pack(spans, size, overlap, lossless=True) for i in range(a, b)}
    assert covered == set(range(len(spans)))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. !?\né", max_size=200), st.integers(1, 60), st.integers(0, 30))
def test_chunks_are_parts_of_the_text(text, size, overlap):
    got = chunks(text, size, overlap)
    assert all(text[o : o + len(c)] == c for o, c in got)
    assert got == chunks(text, size, overlap)
    assert sentence_spans(text) == sorted(sentence_spans(text))


def test_dataframe_and_sql_forms(spark):
    rows = spark.createDataFrame([(1, FIVE, 40, 15), (2, "", 40, 15), (3, None, 40, 15), (4, "short", 40, 15)], "id int, text string, s int, o int")
    got = {(r.id, r.offset, r.text) for r in chunk_documents(rows, "s", "o").collect()}
    assert got == {(1, *c) for c in chunks(FIVE, 40, 15)} | {(4, 0, "short")}
    register(spark)
    rows.filter("id = 1").createOrReplaceTempView("t")
    assert {(r.offset, r.chunk) for r in spark.sql("SELECT c.* FROM t, LATERAL chunk_text(text, s, o) c").collect()} == set(chunks(FIVE, 40, 15))


@pytest.mark.parametrize("size,overlap", [(100, 20), (200, 50), (50, 10), (1000, 100)])
def test_sizes(size, overlap):
    got = chunks("A first one here. A second one is here too. A third. And the fourth one, a bit longer than others.", size, overlap)
    assert got and all(c for _, c in got) and [o for o, _ in got] == sorted(o for o, _ in got)
