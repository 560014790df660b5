"""Values and operators beyond what the queries cover."""

import base64
import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.functions import codecs, text, values, vectors
from siftlake.operators import capacity, catalog, dlq, embedding, fusion, lists, search, sparse, store
from siftlake.sources import jsonl, keyspace, messages
from siftlake.streaming import failures, ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("size,want", [("10K", 10 << 10), ("5M", 5 << 20), ("2G", 2 << 30), ("1T", 1 << 40), ("1024", 1024), ("1.5M", 3 << 19), ("  10M  ", 10 << 20), ("", 7), ("ABC", 7), ("5m", 5 << 20), (".5K", 512), ("1e3", 1000), ("-2K", -2048), ("+1.k", 1024), ("1.9", 1), (".", 7), ("K", 7)])
def test_byte_size(spark, size, want):
    assert one(spark, values.byte_size(F.lit(size), 7)) == want


@pytest.mark.parametrize("text_,want", [("500ms", 500), ("1h30m", 5_400_000), ("1m1m", 120_000), ("-1.5s", -1500), (".5s", 500), ("1500us", 1), ("2000000ns", 2), ("1s500ms", 1500), ("0", 0), ("5", 9), ("5x", 9), ("", 9), ("s", 9)])
def test_duration(spark, text_, want):
    assert one(spark, values.duration_ms(F.lit(text_), 9)) == want


def test_dlq_append_keeps_and_forgets(spark):
    at = lambda *minutes: [(1, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for m in minutes]
    frame = lambda rows: spark.createDataFrame(rows, "site_id long, ts timestamp")
    none = spark.createDataFrame([], "site_id long, n long, last timestamp, total long")
    now = F.lit(dt.datetime(2024, 1, 2, 2))
    kept, counters = dlq.append(frame([]), none, frame(at(0, 10, 50)), now)
    assert kept.count() == 0 and [(r.n, r.total) for r in counters.collect()] == [(3, 3)]  # the list has gone, the counter stays
    kept, counters = dlq.append(frame(at(0, 10, 50)), counters, frame([*at(100), (2, dt.datetime(2024, 1, 2))]), F.lit(dt.datetime(2024, 1, 2)))
    assert kept.count() == 5 and {(r.site_id, r.n, r.total) for r in counters.collect()} == {(1, 4, 4), (2, 1, 1)}
    assert [r.site_id for r in dlq.ranked(counters, 1).collect()] == [1]
    _, counters = dlq.append(kept, counters, frame(at(3000)), now)
    assert {(r.site_id, r.n, r.total) for r in counters.collect()} == {(1, 1, 5), (2, 1, 1)}


def test_other_values(spark):
    assert [one(spark, values.boolean(F.lit(x), False)) for x in ("true", "1", "YES", "on", "off", "x")] == [True] * 4 + [False] * 2
    assert [one(spark, values.percentage(F.lit(x), 0.5)) for x in ("50", "0.3", "101", "-1", "x")] == [0.5, 0.3, 0.5, 0.5, 0.5]
    assert [one(spark, values.duration_ms(F.lit(x), 1)) for x in ("500ms", "5m", "1h30m", "2s", "x", "")] == [500, 300_000, 5_400_000, 2000, 1, 1]
    a = one(spark, values.address(F.lit("host:6379/m1")))
    assert (a.host, a.port, a.master) == ("host", 6379, "m1")
    assert one(spark, values.address(F.lit("a:b:c"))) is None


def test_memory_estimate(spark):
    def want(n, mu, sd):
        pdf = [math.exp(-x * x / 2) / math.sqrt(2 * math.pi) for x in range(-3, 4)]
        frac = [(a + b) / 2 for a, b in zip(pdf, pdf[1:], strict=False)]
        return int(3 * 0.9973 / sum(frac) * sum(f * n * max(0, mu + (x + 0.5) * sd) for x, f in zip(range(-3, 3), frac, strict=True)))

    for case in ((100, 2048, 256), (120, 1024, 128), (10, 100, 400)):
        assert abs(one(spark, values.memory_estimate(*map(F.lit, case))) - want(*case)) <= 1
    assert one(spark, values.memory_estimate(F.lit(0), F.lit(5), F.lit(5))) == 0
    assert one(spark, values.memory_estimate(F.lit(5), F.lit(-1), F.lit(5))) == 0


def test_murmur3_known_values():
    # published vectors of the 32-bit hash, seed 0
    keys = [b"", b"test", b"Hello, world!", b"The quick brown fox jumps over the lazy dog"]
    assert codecs.murmur3(keys).view(np.uint32).tolist() == [0, 0xBA6BD213, 0xC0363E43, 0x2E4FF723]


def test_term_ids(spark):
    rows = spark.createDataFrame([("test",), (None,), ("",)], "t string")
    assert [r.i for r in rows.select(codecs.term_id("t").alias("i")).collect()] == [abs(np.array([0xBA6BD213], np.uint32).view(np.int32)[0].item()), None, 0]


def test_wire_formats(spark):
    rows = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    got = rows.select(codecs.encode_vector("v").alias("e"), codecs.vector_bytes("v").alias("b")).collect()
    assert base64.b64decode(got[0].e) == np.array([1.5, -2], ">f4").tobytes() and bytes(got[0].b) == np.array([1.5, -2], "<f4").tobytes()
    assert got[1].e is None
    bad = spark.createDataFrame([(base64.b64encode(b"abc").decode(),)], "e string")
    assert bad.select(codecs.decode_vector("e")).first()[0] is None
    assert one(spark, codecs.decode_u32(codecs.encode_u32(F.lit(4_000_000_000)))) == 4_000_000_000
    assert len(one(spark, codecs.new_token("ab_", 16))) == 19


def test_text_functions(spark):
    assert one(spark, text.locale(F.lit("EN_us"))) == "en_US"
    assert one(spark, text.slug(F.lit("  Ab 12 c! "))) == "ab_c" and one(spark, text.slug(F.lit("Ab 12"), digits=True)) == "ab_12"
    assert one(spark, text.lemma(F.lit("«Été»,"))) == "été" and one(spark, text.lemma(F.lit("—"))) == "<unk>"
    assert one(spark, text.truncated(F.lit("x" * 300))) == "x" * 250 + "..." + "xxx"
    assert one(spark, text.detection_text(F.lit("  A\n b  "))) == "a"
    assert one(spark, text.model_input(F.lit("q"), "e5", "search", F.lit("xx"))).startswith("Instruct: Given a web")
    assert one(spark, text.headers(F.lit("/*\n * Name: My Theme\n * Version: 1.0\n */"))) == {"name": "My Theme", "version": "1.0"}
    assert one(spark, text.decoded(F.unhex(F.lit("ff")))) == "/w=="
    assert one(spark, text.html_text(F.lit("<p>a &amp; b</p><script>x</script>"))) == "a & b"


def test_pooling_and_norms(spark):
    got = one(spark, vectors.mean_pool(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1), F.lit(1), F.lit(0))))
    assert got == [2.0, 4.0]
    assert one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)))) == 0


def test_subwords(spark):
    def words(tokens, weights):
        return [(r.word, r.weight) for r in one(spark, lists.subword_merge(F.array(*map(F.lit, tokens)), F.array(*map(F.lit, weights))))]

    assert words(["<s>", "▁the", "▁qui", "ck", ".", "</s>"], [1.0, 1.0, 2.0, 3.0, 4.0, 1.0]) == [("the", 1.0), ("quick", 5.0), (".", 4.0)]
    assert words(["ck", "x"], [1.0, 2.0]) == [("ck", 1.0), ("x", 2.0)]
    assert words(["<s>"], [1.0]) == []


def test_l1_weights_sum_to_one(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 1.0), (1, "c", -5.0)], "k int, term string, w double")
    got = {r.term: r.weight for r in sparse.l1_weights(rows, ["k"]).collect()}
    assert got == {"a": 0.75, "b": 0.25}


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id int, d int, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id int, d int, rank int")
    x = {(r.d, round(r.score, 9), r["rank"]) for r in fusion.rrf([a, b], "d").collect()}
    assert x == {(r.d, round(r.score, 9), r["rank"]) for r in fusion.rrf([b, a], "d").collect()}
    assert (20, round(1 / 3 + 1 / 2, 9), 1) in x


def test_upsert_is_idempotent(spark):
    table = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 9, "b"), (1, 2, 0, "c")], "site_id int, post_id int, offset int, text string")
    change = spark.createDataFrame([(1, 1, 0, "new")], table.schema)
    once = store.upsert(table, change)
    assert sorted(once.collect()) == sorted(store.upsert(once, change).collect())
    assert sorted(r.text for r in once.collect()) == ["b", "c", "new"]
    assert sorted(r.text for r in store.upsert(table, change, replace_document=True).collect()) == ["c", "new"]


def test_write_keeps_other_tenants(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, "a"), (2, 1, 0, "b")], "site_id int, post_id int, offset int, text string")
    store.write(rows, str(tmp_path / "t"))
    store.write(spark.createDataFrame([(1, 1, 0, "z")], rows.schema), str(tmp_path / "t"))
    assert sorted((r.site_id, r.text) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "z"), (2, "b")]


def test_assignment_takes_space(spark):
    nodes = spark.createDataFrame([("redis", 1, "active", 100, 0, 0), ("redis", 2, "active", 150, 0, 0), ("redis", 3, "inactive", 50, 0, 0)], "node_type string, node_id long, status string, max_bytes long, used_bytes long, assigned_bytes long")
    asked = spark.createDataFrame([(1, "redis", 90), (2, "redis", 90), (3, "redis", 90), (4, "redis", 0)], "request_id long, node_type string, bytes long")
    assert [(r.request_id, r.node_id) for r in catalog.best_fit(asked, nodes).orderBy("request_id").collect()] == [(1, 1), (2, 1), (3, 1), (4, None)]
    assert [(r.request_id, r.node_id) for r in capacity.assign_in_order(asked, nodes).orderBy("request_id").collect()] == [(1, 1), (2, 2), (3, None), (4, None)]


def test_empty_dead_letters(spark):
    none = spark.createDataFrame([], "status string")
    assert tuple(dlq.status_counts(none).first()) == (0, 0, 0, 0)


def test_jsonl(spark, tmp_path):
    lines = [json.dumps({"timestamp": 5, "site_id": 1, "doc_id": 2, "payload_json": "{}"}), "", "{broken", json.dumps({"timestamp": 6, "site_id": 2})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    assert jsonl.read_letters(spark, str(tmp_path)).count() == 2
    jsonl.export_letters(jsonl.read_letters(spark, str(tmp_path / "a.jsonl")), str(tmp_path / "out"))
    assert [r.doc_id for r in jsonl.read_letters(spark, str(tmp_path / "out"), site_id=1).collect()] == [2]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "l.json").write_text(json.dumps({"method": "GET", "headers": {"Authorization": ["x"], "Accept": ["y"]}}))
    assert jsonl.request_log(spark.read, str(tmp_path / "log")).first().headers == {"Accept": ["y"]}


def test_keyspace(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text("\n".join(json.dumps(x) for x in ({"key": "a", "kind": "string", "value": "v"}, {"key": "b", "kind": "hash", "value": {"f": 1}}, {"key": "c", "kind": "zset", "value": {"m": 2}}, {"key": "d", "kind": "set", "value": ["y", "x"]})))
    spark.dataSource.register(keyspace.Keyspace)
    got = {r.key: r for r in spark.read.format("keyspace").option("paths", str(tmp_path / "k.jsonl")).load().collect()}
    assert got["a"].text == "v" and got["b"].fields == {"f": "1"} and got["c"].scores == {"m": 2.0} and got["d"]["items"] == ["x", "y"]


def test_messages(spark, tmp_path):
    (tmp_path / "a.php").write_text("<?php\necho _('hello');\n echo _('bye') . _('hello');\n")
    got = {r.msgid: r.refs for r in lists.message_references(messages.source_lines(spark, str(tmp_path))).collect()}
    assert got == {"hello": ["a.php:2", "a.php:3"], "bye": ["a.php:3"]}
    (tmp_path / "x.po").write_text('msgid ""\nmsgstr "head"\n\nmsgid "a"\nmsgstr "b"\n"c"\n')
    assert [(r.msgid, r.msgstr) for r in messages.po_entries(messages.source_lines(spark, str(tmp_path), "*.po")).collect()] == [("a", "bc")]


def test_ingest_stream(spark, tmp_path):
    sites = spark.createDataFrame([(1, "active", 40, 15), (2, "revoked", 40, 15)], "site_id int, status string, chunk_size int, chunk_overlap int")
    (tmp_path / "in").mkdir()
    rows = [{"site_id": 1, "id": 7, "text": "One one one one. Two two two two. Three three three."}, {"site_id": 2, "id": 8, "text": "x", "retry_count": 2}, {"site_id": 9, "id": 9, "text": "x"}]
    (tmp_path / "in" / "m.txt").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    out = {}

    def sink(name):
        return lambda df, n: out.setdefault(name, []).extend(df.collect())

    names = ("chunks", "retry", "dead", "poison")
    raw = spark.readStream.text(str(tmp_path / "in"))
    ingest.start(raw, lambda: sites, {n: sink(n) for n in names}, str(tmp_path / "cp")).awaitTermination()
    assert {r.post_id for r in out["chunks"]} == {7} and len(out["chunks"]) > 1
    assert all(r.point_id == (7 << 32 | r.offset) for r in out["chunks"])
    assert all(r.language == "unk" and len(r.dense) == embedding.WIDTH and abs(sum(r.sparse.values()) - 1) < 1e-6 for r in out["chunks"])
    assert [(r.id, r.status) for r in out["dead"]] == [(8, "DEAD_LETTER")] and [(r.id, r.status) for r in out["retry"]] == [(9, "FAILED")]
    assert len(out["poison"]) == 1


def test_failed_model_calls_are_retried(spark):
    def load():
        def embed(texts):
            if any("boom" in t for t in texts):
                raise embedding.RecoverableError("status 500")
            return np.ones((len(texts), 2), np.float32)

        return embed

    embedding.register(embedding.Model("fragile", load))
    sites = spark.createDataFrame([(1, "active", 20, 0)], "site_id int, status string, chunk_size int, chunk_overlap int")
    rows = [{"site_id": 1, "id": 1, "text": "Well said here. It goes boom now. All well again."}, {"site_id": 1, "id": 2, "text": "All is well."}, {"site_id": 1, "id": 3, "text": "boom", "retry_count": 2}, {"site_id": 1, "id": 4}]
    out = ingest.step(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"), sites, F.lit(5).cast("long"), "fragile")
    assert [(r.post_id, r.dense) for r in out["chunks"].collect()] == [(2, [1.0, 1.0])]
    failed = {r.id: r for name in ("retry", "dead") for r in out[name].collect()}
    assert {i: (r.status, r.retry_count) for i, r in failed.items()} == {1: ("FAILED", 1), 3: ("DEAD_LETTER", 3)}
    assert failed[1].error_message == "RecoverableError: status 500"


def test_search_over_chunks_of_a_query(spark):
    texts = ["the red fox ran", "a blue whale sang", "red whale", "quite another thing"]
    chunks = search.stored(search.with_vectors(spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "site_id string, point_id long, text string"), "letters"))
    queries = spark.createDataFrame([(5, "s", "Red fox ran off. Blue whale sang too.", "auto"), (6, "s", "", "auto"), (7, "none", "fox", "auto"), (8, "s", None, "auto")], "query_id long, site_id string, text string, language string")
    got = search.search(queries, chunks, "letters", limit=3, size=20, overlap=0).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {5} and [r.rank for r in got] == [1, 2, 3]
    assert {r.point_id for r in got[:2]} == {0, 1}  # each part of the query finds its own
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_streams_equal_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=m)) for m in (0, 10, 30, 200, 210)] + [(2, t0 + dt.timedelta(minutes=m)) for m in (5, 100)]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp")
    closing = spark.createDataFrame([(99, t0 + dt.timedelta(days=3))], df.schema)  # closes the others' sessions
    df.coalesce(1).write.parquet(str(tmp_path / "in/a"))
    closing.coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = lambda: spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = failures.session_stream(stream()).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.site_id, r.n) for r in dlq.sessions(df).collect()}
    assert {(r.site_id, r.n) for r in spark.sql("select * from closed").collect()} == want == {(1, 3), (1, 2), (2, 1)}
    q = failures.alert_stream(stream(), threshold=3).writeStream.format("memory").queryName("alerted").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.site_id, r.n) for r in spark.sql("select * from alerted").collect()] == [(1, 3)]
