"""Counters, histograms, gauges, smoothed latency and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of histogram buckets, for requests and for model calls.
REQUEST_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
MODEL_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("total"))


def histogram(events: DataFrame, value: str, labels: list[str], buckets: tuple[float, ...] = MODEL_BUCKETS) -> DataFrame:
    """labels, le, n: how many values are at most each bound; the last bound is infinity. One pass, a count for each bound."""
    bounds = (*buckets, float("inf"))
    wide = events.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)])
    return wide.select(*labels, F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select(*labels, "x.le", "x.n")


def ewma(events: DataFrame, key: str, value: str, order: list[str], d: float = 0.1) -> DataFrame:
    """key, ewma after its last value: l (1 - d) + x d from 0, as the sum of d (1 - d)^(values after it) x.

    Each row's weight needs only its place from the end; weights below 1e-18 add nothing, so a window over a hot key is
    sorted, not gathered.
    """
    after = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])) - 1
    return events.withColumn("_after", after).groupBy(key).agg(F.sum(d * F.pow(F.lit(1 - d), F.col("_after")) * F.col(value)).alias("ewma"))


def gauges(samples: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each key."""
    return samples.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def increases(samples: DataFrame, key: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """Samples with the increase and the seconds since the one before; a counter that fell has begun anew at 0."""
    w = Window.partitionBy(*key).orderBy(ts, tie)
    before = F.lag(value).over(w)
    return samples.withColumns({"increase": F.when(F.col(value) >= before, F.col(value) - before).when(before.isNotNull(), F.col(value)), "seconds": (_micros(F.col(ts)) - _micros(F.lag(ts).over(w))) / 1e6})


def rate(samples: DataFrame, key: list[str], value: str, ts: str, tie: str, window: str) -> DataFrame:
    """key, begin, increase: the increase in each window of time, by the later sample of each pair."""
    rows = increases(samples, key, value, ts, tie).filter("increase is not null")
    return rows.groupBy(*key, F.window(ts, window).alias("_w")).agg(F.sum("increase").alias("increase")).select(*key, F.col("_w.start").alias("begin"), "increase")


def irate(samples: DataFrame, key: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """key, irate: the increase per second between the last two samples."""
    rows = increases(samples, key, value, ts, tie).filter("seconds > 0")
    return rows.groupBy(*key).agg(F.max_by(F.col("increase") / F.col("seconds"), F.struct(ts, tie)).alias("irate"))


def relabelled(metrics: DataFrame, keep: str, drop_labels: str, rename: tuple[str, str]) -> DataFrame:
    """Metrics whose name matches, without labels that match, others renamed by a pattern."""
    labels = F.map_filter("labels", lambda k, v: ~k.rlike(drop_labels))
    return metrics.filter(F.col("metric").rlike(keep)).withColumn("labels", F.transform_keys(labels, lambda k, v: F.regexp_replace(k, *rename)))


def rates_at(samples: DataFrame, key: list[str], value: str, ts: str, tie: str, step: int, span: int) -> DataFrame:
    """key, moment (microseconds), n, rate, irate: of a counter's samples, at each multiple of `step` seconds that has two or more in
    the `span` seconds up to it.

    A fall is a reset: the counter began anew at 0. The increase between the first and the last sample is stretched to the
    span's edges where samples come close to them, else by half the mean distance of samples, and not beyond the time at
    which the counter would have been 0. irate is the slope between the last two samples. Each sample goes to span / step
    steps at most; null times and values are left out, samples at one time are ordered by `tie`. Increases are decimals.
    """
    micros, width = 1_000_000, span * 1_000_000
    rows = samples.select(*key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(value).cast("decimal(18,6)").alias("_v"), F.col(tie).alias("_tie")).dropna(subset=["_t", "_v"])
    order = Window.partitionBy(*key).orderBy("_t", "_tie")
    rows = rows.withColumns({"_before": F.lag("_t").over(order), "_was": F.lag("_v").over(order)})
    rows = rows.withColumn("_up", F.when(F.col("_v") >= F.col("_was"), F.col("_v") - F.col("_was")).otherwise(F.col("_v")))
    first = F.ceil(F.col("_t") / (step * micros)) * step * micros
    last = F.floor((F.col("_t") + width - 1) / (step * micros)) * step * micros
    rows = rows.filter(first <= last).withColumn("moment", F.explode(F.sequence(first, last, F.lit(step * micros))))
    both = F.col("_before") > F.col("moment") - width
    slope = both & (F.col("_t") > F.col("_before"))
    at = rows.groupBy(*key, "moment").agg(
        F.count("*").alias("n"), F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.min_by("_v", F.struct("_t", "_tie")).alias("_first"), F.sum(F.when(both, F.col("_up"))).alias("_up"),
        F.max_by(F.when(slope, F.col("_up").cast("double") * micros / (F.col("_t") - F.col("_before"))), F.when(slope, F.struct("_t", "_tie"))).alias("irate"),
    )
    at = at.filter("n > 1 and _b > _a")
    long, up = (F.col("_b") - F.col("_a")).cast("double"), F.col("_up").cast("double")
    mean = long / (F.col("n") - 1)
    head, tail = (F.col("_a") - F.col("moment") + width).cast("double"), (F.col("moment") - F.col("_b")).cast("double")
    zero = F.when(up > 0, long * F.col("_first").cast("double") / up)
    head = F.least(head, F.coalesce(zero, head))
    near = lambda x: F.when(x < mean * 1.1, x).otherwise(mean / 2)
    return at.select(*key, "moment", "n", (up * (long + near(head) + near(tail)) / long / span).alias("rate"), "irate")


def by_label(rates: DataFrame, labels: list[str], value: str, how: str = "sum", digits: int = 9) -> DataFrame:
    """labels, moment, value: sums or means of rates over all series with equal labels, as decimals."""
    exact = F.col(value).cast(f"decimal(28,{digits})")
    total = F.sum(exact).cast("double")
    return rates.filter(F.col(value).isNotNull()).groupBy(*labels, "moment").agg((total if how == "sum" else total / F.count("*")).alias(value))
