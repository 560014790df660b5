"""Rates at steps against a plain computation; the queue as a stream over restarts."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftlake.operators import metrics
from siftlake.sources import queue

STEP, SPAN, BASE = 60, 300, 1_700_000_000 // 60 * 60


def plain(samples, moment):
    """(n, rate, irate) of sorted (seconds, value) in the span up to moment."""
    inside = [(t, v) for t, v in samples if moment - SPAN < t <= moment]
    if len(inside) < 2 or inside[0][0] == inside[-1][0]:
        return None
    ups = [(b if b < a else b - a, t - s) for (s, a), (t, b) in zip(inside, inside[1:], strict=False)]
    up, length = sum(u for u, _ in ups), inside[-1][0] - inside[0][0]
    mean, head, tail = length / (len(inside) - 1), inside[0][0] - moment + SPAN, moment - inside[-1][0]
    if up > 0:
        head = min(head, length * inside[0][1] / up)
    near = lambda x: x if x < 1.1 * mean else mean / 2
    slopes = [u / s for u, s in ups if s > 0]
    return len(inside), up * (length + near(head) + near(tail)) / length / SPAN, slopes[-1] if slopes else None


def test_rates_equal_a_plain_computation(spark):
    rng = random.Random(8)
    rows, samples = [], collections.defaultdict(list)
    for series in range(6):
        t, v = BASE + rng.randrange(100), rng.randrange(5)
        for i in range(40):
            t += rng.choice([0, 7, 15, 30, 60, 200] if series else [15])
            v = rng.randrange(3) if rng.random() < 0.1 else v + rng.randrange(9)
            rows.append((f"s{series}", i, dt.datetime.fromtimestamp(t, dt.UTC).replace(tzinfo=None), float(v)))
            samples[f"s{series}"].append((t, v))
    rows += [("s0", 99, None, 1.0), ("s1", 99, dt.datetime(2023, 1, 1), None), ("alone", 0, dt.datetime(2023, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "series string, seq long, ts timestamp, value double").repartition(5)
    out = metrics.rates_at(df, ["series"], "value", "ts", "seq", STEP, SPAN)
    found = {(r.series, r.moment // 1_000_000): (r.n, r.rate, r.irate) for r in out.collect()}
    want = {(s, m): plain(x, m) for s, x in samples.items() for m in range(BASE, x[-1][0] + SPAN + STEP, STEP)}
    want = {k: v for k, v in want.items() if v}
    assert found.keys() == want.keys()
    for k, (n, rate, irate) in want.items():
        assert found[k][0] == n and found[k][1] == pytest.approx(rate) and found[k][2] == pytest.approx(irate)
    total = {r.moment: r.rate for r in metrics.by_label(out.withColumn("job", F.lit("j")), ["job"], "rate").collect()}
    assert total[(BASE + 300) * 1_000_000] == pytest.approx(sum(v[1] for (s, m), v in want.items() if m == BASE + 300))
    assert metrics.rates_at(df.filter("seq < 0"), ["series"], "value", "ts", "seq", STEP, SPAN).count() == 0


def test_queue_stream_goes_on_after_a_stop(spark, tmp_path):
    """Nothing is lost or read twice over a stop in the middle, a restart and messages that come in between."""
    folder, out, mark = str(tmp_path / "queue"), str(tmp_path / "out"), str(tmp_path / "mark")

    def put(low, high):
        spark.range(low, high, 1, 4).select(F.concat(F.lit("m"), "id").alias("value")).write.mode("append").text(folder)

    def run(fail_at=None):
        def batch(rows, number):
            if fail_at is not None and number >= fail_at:
                raise RuntimeError("stopped")
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

        q = queue.subscribe(spark, folder, 2).writeStream.foreachBatch(batch).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()

    put(0, 40)
    with pytest.raises(Exception, match="stopped"):
        run(fail_at=1)
    put(40, 60)
    run()
    run()
    found = collections.Counter(r.value for r in spark.read.parquet(*(f"{out}/{p.name}" for p in (tmp_path / "out").iterdir())).collect())
    assert found == {f"m{i}": 1 for i in range(60)}
