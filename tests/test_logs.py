"""Log files: bytes, order, nothing lost by a failed task, retention; metrics as services expose them."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from siftlake.sources import exposition, logs

LINES = "pod_name string, ts timestamp, seq long, line string"


def lines(spark, n=600):
    rng = random.Random(4)
    rows = [(None if i % 97 == 0 else "hot" if i % 3 else f"pod{i % 5}", f"2024-03-0{1 + i % 2} 0{i % 4}:00:00", i, "é" * rng.randrange(40)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "pod_name string, t string, seq long, line string").selectExpr("pod_name", "cast(t as timestamp) as ts", "seq", "line").repartition(6)


def test_files_by_pod_and_hour(spark, tmp_path):
    rows, df = lines(spark)
    path = str(tmp_path / "logs")
    logs.write_logs(df, path, "pod_name", F.col("ts"), ["seq"], 500)
    found = logs.files(spark, path).collect()
    assert max(f.bytes for f in found) <= 500 and len(found) > 30
    back = collections.defaultdict(list)
    for f in found:
        part = dict(x.split("=") for x in f.name.split("/")[:-1])
        back[f.directory, part["date"], part["hour"]].append((int(part["file"]), spark.read.text(f.path).collect()))
    want = collections.defaultdict(list)
    for pod, t, _, line in rows:
        want[pod or "none", t[:10], t[11:13]].append(line)
    assert {k: [r.value for _, part in sorted(v, key=lambda x: x[0]) for r in part] for k, v in back.items()} == want


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    _, df = lines(spark)
    path = str(tmp_path / "logs")
    logs.write_logs(df.filter("seq < 100"), path, "pod_name", F.col("ts"), ["seq"], 500)
    before = {f.path for f in logs.files(spark, path).collect()}
    broken = df.withColumn("line", F.when(F.col("seq") == 555, F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        logs.write_logs(broken, path, "pod_name", F.col("ts"), ["seq"], 500)
    assert {f.path for f in logs.files(spark, path).collect()} == before


def test_newest_files_stay(spark, tmp_path):
    _, df = lines(spark)
    path = str(tmp_path / "logs")
    logs.write_logs(df, path, "pod_name", F.col("ts"), ["seq"], 500)
    all_, gone = logs.files(spark, path).collect(), logs.retired(spark, path, 3).collect()
    left = collections.Counter(f.directory for f in all_) - collections.Counter(f.directory for f in gone)
    assert all(left[p] == min(3, n) for p, n in collections.Counter(f.directory for f in all_).items())


def test_rotation_of_odd_lines(spark):
    df = spark.createDataFrame([("a", 1, "x" * 50), ("a", 2, "y"), ("a", 3, ""), ("b", 1, "z")], "pod string, seq long, line string")
    found = {(r.pod, r.seq): (r.file, r.size) for r in logs.rotated(df, ["pod"], ["seq"], 10).collect()}
    assert found["a", 1][0] == 0 and found["a", 2][0] > 0 and found["b", 1] == (0, 2) and found["a", 3][1] == 1
    assert logs.rotated(df.filter("seq > 9"), ["pod"], ["seq"], 10).count() == 0


SCRAPE = r"""# HELP http_requests_total The total.
# TYPE http_requests_total counter
http_requests_total{method="post",code="200"} 1027 1395066363000
http_requests_total{method="post",code="400",} 3 -1395066363000

msdos_file_access_time_seconds{path="C:\\DIR\\FILE.TXT",error="Cannot find file:\n\"FILE.TXT\"",tmp="a}b,c=d"} 1.458255915e9
metric_without_timestamp_and_labels 12.47
something_weird{problem="division by zero"} +Inf -3982045
# TYPE rpc_seconds summary
rpc_seconds{quantile="0.01"} 3102
rpc_seconds_sum 1.7560473e+07
rpc_seconds_count NaN
# TYPE lone_count gauge
lone_count 7
0bad 3
no_value
bad_value x1
twice{a="1",a="2"} 1
"""


def test_exposition(spark):
    df = spark.createDataFrame([(1, SCRAPE), (2, None), (3, ""), (4, "# TYPE x counter\nx 1\n"), (5, "x 1")], "k long, text string")
    found = exposition.samples(df, ["k"]).collect()
    one = {(r.metric, len(r.labels), r.line_no): r for r in found if r.k == 1}
    by = collections.defaultdict(list)
    for r in sorted(one.values(), key=lambda r: r.line_no):
        by[r.metric].append(r)
    assert [(r.labels, r.value, r.at_ms, r.type) for r in by["http_requests_total"]] == [({"method": "post", "code": "200"}, 1027, 1395066363000, "counter"), ({"method": "post", "code": "400"}, 3, -1395066363000, "counter")]
    (m,) = by["msdos_file_access_time_seconds"]
    assert m.labels == {"path": r"C:\DIR\FILE.TXT", "error": 'Cannot find file:\n"FILE.TXT"', "tmp": "a}b,c=d"} and m.value == 1.458255915e9 and m.type == "untyped"
    assert by["something_weird"][0].value == math.inf and math.isnan(by["rpc_seconds_count"][0].value)
    assert {by[n][0].type for n in ("rpc_seconds", "rpc_seconds_sum", "rpc_seconds_count")} == {"summary"} and by["lone_count"][0].type == "gauge"
    assert by["twice"][0].labels == {"a": "2"} and not {"0bad", "no_value", "bad_value"} & set(by)
    assert [(r.k, r.type) for r in found if r.k > 1] == [(4, "counter"), (5, "untyped")] or {(r.k, r.type) for r in found if r.k > 1} == {(4, "counter"), (5, "untyped")}
