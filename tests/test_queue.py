"""The queue's messages, replay, embedders and catalogue helpers."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake import schemas
from siftlake.operators import catalog, embedding
from siftlake.sources import queue
from siftlake.streaming.replay import replay

CASES = [
    {"site_id": 1, "id": 2, "text": "hello", "extra": {"url": "x", "a": ""}, "timestamp_millis": 1_700_000_000_000, "retry_count": 1, "max_retries": 3, "status": "FAILED", "error_message": "é", "last_retry_timestamp": -7, "language": "auto"},
    {"site_id": 1, "id": 0, "text": "", "extra": {}, "max_retries": 5, "language": ""},
    {"site_id": -3, "id": 1, "text": "x" * 1_000_000},
]


@pytest.mark.parametrize("message", CASES)
def test_round_trip(message):
    back = queue.unpack(queue.pack(message))
    want = {name: "" if name in ("text", "error_message", "language") else 0 for name in queue.FIELDS} | {"extra": {}, "status": "PENDING"}
    assert back == want | message


def test_known_bytes():
    # field 1 = 150 and field 3 = "testing", as in the format's public description
    assert queue.pack({"site_id": 150, "text": "testing"}) == bytes.fromhex("0896011a0774657374696e67")


def test_unknown_and_broken_fields():
    assert queue.unpack(bytes.fromhex("9a060161") + queue.pack({"id": 5}))["id"] == 5
    for data in (b"\x1a\x50abc", b"\x0f"):
        with pytest.raises((ValueError, IndexError)):
            queue.unpack(data)


def test_store_requests(spark):
    bodies = [(1, '[{"url":"u","title":"t","text":"a","meta":1},{"id":4,"text":"b","extra":{"k":"v"}}]'), (2, "[]"), (3, "{"), (4, None), (5, "[null]")]
    good, bad = queue.store_requests(spark.createDataFrame(bodies, "r int, body string"))
    assert [(r.r, r.id, r.text, r.extra) for r in good.orderBy("id").collect()] == [(1, 0, "a", None), (1, 4, "b", {"k": "v"})]
    assert sorted(r.r for r in bad.collect()) == [2, 3, 4, 5]


def letters(spark):
    rows = [(t, 1, t, base64.b64encode(queue.pack({"site_id": 1, "id": t, "text": f"d{t}", "retry_count": 3, "status": "DEAD_LETTER"})).decode()) for t in (5, 6, 7)]
    return spark.createDataFrame([*rows, (8, 1, 8, None), (9, 1, 9, "AA==")], "timestamp long, site_id int, doc_id int, payload_proto string")


def test_replay(spark, tmp_path):
    sent, stay = replay(letters(spark), str(tmp_path / "q"), limit=2)
    assert [(r.id, r.status, r.retry_count) for r in sent.orderBy("id").collect()] == [(5, "PENDING", 0), (6, "PENDING", 0)]
    assert sorted(r.doc_id for r in stay.collect()) == [7, 8, 9]
    assert sorted(json.loads(r.value)["text"] for r in spark.read.text(str(tmp_path / "q")).collect()) == ["d5", "d6"]
    sent, stay = replay(letters(spark), str(tmp_path / "none"), dry_run=True)
    assert sent.count() == 3 and stay.count() == 5 and not (tmp_path / "none").exists()


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, "")], "id int, text string")
    got = {r.id: r for r in embedding.embed(rows, "arctic", "search").collect()}
    assert got[1].dense == got[3].dense and got[2].dense is None and got[1].text == "a b" and got[1].model_input == "query: a b"
    assert np.linalg.norm(got[1].dense) == pytest.approx(1, abs=1e-5)


def test_calls_again():
    tries = []

    def flaky(texts):
        tries.append(1)
        if len(tries) < 3:
            raise embedding.RecoverableError
        return np.ones((len(texts), 2))

    assert embedding.call(flaky, ["x"]).tolist() == [[1, 1]] and len(tries) == 3
    tries.clear()
    with pytest.raises(embedding.RecoverableError):
        embedding.call(flaky, ["x"], attempts=2)


def test_content_tokens(spark):
    def cut(tokens):
        return [x.token for x in spark.range(1).select(embedding.content_tokens(F.array(*map(F.lit, tokens)), F.array(*[F.lit(1.0)] * len(tokens))).alias("x")).first().x]

    assert cut(["Query", ":", "Ġhow", "ever", "<pad>", "<pad>"]) == ["Ġhow", "ever"]
    assert cut(["Query", "<pad>", "Ġx"]) == [] and cut(["Ġa", "b"]) == ["Ġa", "b"]


def test_rotated_keys(spark):
    sites = spark.createDataFrame([(1, "old"), (2, "old")], "site_id int, api_key string")
    got = {r.site_id: r.api_key for r in catalog.rotated(sites, spark.createDataFrame([(1, "new")], "site_id int, key string")).collect()}
    assert got[2] == "old" and len(got[1]) == 64


def test_parents(spark):
    rows = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "r int, k int")
    parents = spark.createDataFrame([(1,)], "k int")
    assert [r.r for r in catalog.with_parents(rows, parents, "k", "cascade").collect()] == [1]
    assert sorted((r.r, r.k) for r in catalog.with_parents(rows, parents, "k", "set null").collect()) == [(1, 1), (2, None), (3, None)]


def test_schemas():
    assert len(schemas.SITES.names) == 26 and schemas.PAYLOAD["extra"].dataType.simpleString() == "map<string,string>"
    assert catalog.schema_changes(["a", "b"], ["b", "c"]) == (["c"], ["a"])
