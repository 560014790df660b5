"""Sentence boundaries learned from texts: nothing is lost, abbreviations and numbers hold, held-out agreement."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from siftlake.operators import boundaries, chunking
from siftlake.operators.boundaries import Boundaries

MODEL = Boundaries(frozenset({"dr", "etc", "approx", "e.g"}), frozenset({"the", "then"}))


def split(text, model=MODEL):
    return [text[a:b] for a, b in model(text)]


def test_marks_that_end_nothing():
    assert split("Dr. Ito paid 3.14 at example.com. The rest came later!") == ["Dr. Ito paid 3.14 at example.com.", "The rest came later!"]
    assert split("J. R. Smith came (approx. noon). He left.") == ["J. R. Smith came (approx. noon).", "He left."]
    assert split("Pens, paper etc. The shop closed.") == ["Pens, paper etc.", "The shop closed."]
    assert split("On the 3. of May it rained... and then? \"No.\" Fine") == ["On the 3. of May it rained... and then?", '"No."', "Fine"]
    assert split("  ") == [] and split("no mark") == ["no mark"] and split("a.b") == ["a.b"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1.!? \n\"')Dr", max_size=60))
def test_spans_hold_the_text(text):
    spans = MODEL(text)
    assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    inside = {i for a, b in spans for i in range(a, b)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in inside)


def sentences_of(seed, n):
    rng = random.Random(seed)
    short, names = ["dr", "prof", "gov", "e.g", "approx", "st"], ["Ito", "Bell", "Okoro", "Lind", "Marsh"]
    words = [f"{a}{b}" for a in "river stone light paper wind".split() for b in ("s", "ed", "y", "ing", "ly")]
    opens = "the then some every under while".split()
    out = []
    for _ in range(n):
        body = [rng.choice(opens).capitalize()]
        for _ in range(rng.randrange(3, 12)):
            body.append(rng.choice([rng.choice(words), rng.choice(words), rng.choice(opens), rng.choice(names), f"{rng.choice(short).capitalize()}. {rng.choice(names)}", f"{rng.choice(short)}. {rng.choice(words)}", f"{rng.randrange(99)}.{rng.randrange(99)}", f"{rng.choice('ABC')}. {rng.choice(names)}"]))
        out.append(" ".join([*body, rng.choice(words)]) + rng.choice(".....!?"))
    return out


def test_learned_boundaries_held_out(spark):
    train = sentences_of(1, 3000)
    texts = spark.createDataFrame([(i, " ".join(train[i : i + 10])) for i in range(0, 3000, 10)] + [(-1, None), (-2, "")], "id long, text string").repartition(4)
    model = boundaries.learned(texts)
    assert {"dr", "prof", "gov", "e.g", "approx", "st"} <= model.abbreviations and not model.abbreviations & {"rivers", "winded", "the"}
    assert {"the", "then", "some"} <= model.openers
    right = total = plain = 0
    held = sentences_of(2, 500)
    for i in range(0, 500, 10):
        want = held[i : i + 10]
        found = split(" ".join(want), model)
        right += len(set(want) & set(found))
        plain += len(set(want) & {" ".join(want)[a:b] for a, b in chunking.sentence_spans(" ".join(want))})
        total += len(want)
    assert right / total > 0.97 > 0.5 > plain / total
    assert boundaries.learned(texts.filter("id = 7777")) == Boundaries()


def test_chunks_take_a_splitter(spark):
    text = "Dr. Ito came in. Then Dr. Bell left the room. The end."
    docs = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    found = [(r.offset, r.text) for r in chunking.chunk_documents(docs, 30, 0, split=MODEL).orderBy("offset").collect()]
    assert [t for _, t in found] == ["Dr. Ito came in.", "Then Dr. Bell left the room.", "The end."] and all(text[o:].startswith(t) for o, t in found)
