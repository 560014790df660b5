"""Languages by profiles: held-out accuracy, ranks by brute force, nulls."""

import collections
import re

from siftlake.operators import profiles


def brute(text, top):
    counts = collections.Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f"_{w}_"
        for i in range(len(w)):
            for k in range(1, profiles.LONGEST + 1):
                if i + k <= len(w) and w[i : i + k] != "_":
                    counts[w[i : i + k]] += 1
    return {g: r + 1 for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:top])}


def test_ranks_and_distances_equal_brute_force(spark):
    texts = {"x": "the cat and the hat, the bat", "y": "der hund und das haus und der baum", "z": "le chat et le chien à l'été"}
    rows = spark.createDataFrame([(k, t) for k, t in texts.items()] + [("x", None), (None, "nobody's")], "lang string, text string").repartition(3)
    known = profiles.learned(rows, top=30)
    want = {k: brute(t, 30) for k, t in texts.items()}
    assert {(r.language, r.gram, r.place) for r in known.collect()} == {(k, g, p) for k, d in want.items() for g, p in d.items()}
    asked = {1: "that cat", 2: "und dann das", 3: "123 !", 4: None, 5: "", 6: "ωψ", 7: "chien"}
    docs = spark.createDataFrame(list(asked.items()), "doc_id long, text string").repartition(3)
    for r in profiles.languages(docs, ["doc_id"], known, top=30, whole=True).collect():
        own = brute(asked[r.doc_id] or "", profiles.SEEN)
        ways = [(sum(abs(p - d[g]) if g in d else 30 for g, p in own.items()), k) for k, d in want.items() if set(own) & set(d)]
        assert (r.distance, r.language) == (min(ways) if ways else (None, None))
    assert profiles.languages(docs.filter("doc_id < 0"), ["doc_id"], known).count() == 0
    assert {r.language for r in profiles.languages(docs, ["doc_id"], profiles.learned(rows.filter("lang = 'none'"))).collect()} == {None}


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    known = profiles.learned(docs.filter("doc_id % 4 <> 2"))
    assert known.groupBy("language").count().agg({"count": "max"}).first()[0] <= profiles.TOP
    found = profiles.languages(docs.filter("doc_id % 4 = 2"), ["doc_id"], known).join(docs, "doc_id").filter("lang is not null and length(text) >= 20").collect()
    right = sum(r.language == r.lang for r in found)
    assert len(found) > 200 and right / len(found) >= 0.97, (right, len(found))
