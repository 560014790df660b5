"""Configuration values, capacity arithmetic and delays as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor on the estimate for index, overlap and metadata; the normal distribution's share within three deviations.
OVERHEAD, WITHIN_THREE = 3.0, 0.9973


def byte_size(text: Column, default: int) -> Column:
    """`10K`, `1.5m`, `-.5e1G`: a number with an optional unit of 1024; anything else gives the default. Fractions of a byte are cut off."""
    clean = F.trim(text)
    n = F.regexp_extract(clean, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[KMGTkmgt]?$", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(clean, r"([KMGTkmgt])$", 1))
    factor = F.when(unit == "K", 2.0**10).when(unit == "M", 2.0**20).when(unit == "G", 2.0**30).when(unit == "T", 2.0**40).otherwise(1.0)
    return F.coalesce((n * factor).cast("bigint"), F.lit(default).cast("bigint"))


def boolean(text: Column, default: bool) -> Column:
    x = F.lower(F.trim(text))
    return F.when(x.isin("true", "1", "yes", "on"), True).when(x.isin("false", "0", "no", "off"), False).otherwise(default)


def percentage(value: Column, default: float) -> Column:
    """Outside 0 to 100 the default; above 1 of a hundred; else as it is."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x < 0) | (x > 100), F.lit(default)).when(x > 1, x / 100).otherwise(x)


def integer(text: Column, default: int, kind: str = "bigint") -> Column:
    return F.coalesce(F.trim(text).try_cast(kind), F.lit(default).cast(kind))


def real(text: Column, default: float) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default))


def duration_ms(text: Column, default: int) -> Column:
    """`500ms`, `5m`, `-1h30m.5s`, `1500us`: signed sums of numbers with units, in whole milliseconds; `0` needs none. Anything else gives the default."""
    number = r"(\d+\.?\d*|\.\d+)"
    found = lambda unit: F.regexp_extract_all(text, F.lit(rf"{number}{unit}(?![a-zµ])"), F.lit(1))
    part = lambda unit: F.aggregate(found(unit), F.lit(0.0), lambda s, x: s + x.cast("double"))
    total = sum((part(unit) * ms for unit, ms in (("h", 3_600_000.0), ("m", 60_000.0), ("s", 1000.0), ("ms", 1.0), ("(?:us|µs)", 1e-3), ("ns", 1e-6))), F.lit(0.0))
    ok = text.rlike(rf"^[+-]?(({number}(h|ms|m|us|µs|ns|s))+|0)$")
    return F.when(ok, (F.when(text.startswith("-"), -total).otherwise(total)).cast("bigint")).otherwise(F.lit(default).cast("bigint"))


def address(text: Column) -> Column:
    """host, port and master of `host:port` or `host:port/master`; null if it is neither."""
    ok = text.rlike(r"^[^:/]+:\d+(/[^:/]+)?$")
    get = lambda k: F.nullif(F.regexp_extract(text, r"^([^:/]+):(\d+)(?:/([^:/]+))?$", k), F.lit(""))
    return F.when(ok, F.struct(get(1).alias("host"), get(2).try_cast("int").alias("port"), get(3).alias("master")))


def memory_estimate(pages: Column, mean: Column, deviation: Column) -> Column:
    """Bytes for so many pages of normally distributed size: six trapezoids within three deviations; 0 for what can't be."""
    density = [math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi) for x in range(-3, 4)]
    share = [(a + b) / 2 for a, b in zip(density, density[1:], strict=False)]
    n, mu, sigma = (c.cast("double") for c in (pages, mean, deviation))
    total = F.lit(0.0)
    for x, f in zip(range(-3, 3), share, strict=True):
        total = total + F.lit(f) * n * F.greatest(F.lit(0.0), mu + F.lit(x + 0.5) * sigma)
    return F.when((pages <= 0) | (mean < 0) | (deviation < 0), F.lit(0).cast("bigint")).otherwise(F.floor(F.lit(OVERHEAD) * total * F.lit(WITHIN_THREE / sum(share))))


def free_bytes(most: Column, used: Column, assigned: Column) -> Column:
    return most - F.greatest(used, assigned)


def retry_delay_ms(attempt: Column, base_ms: int = 500) -> Column:
    """Before a model is called again."""
    return (F.lit(base_ms) * F.pow(F.lit(2.0), attempt)).cast("bigint")


def validation_delay_ms(attempt: Column, timeout_ms: int) -> Column:
    """Before a domain is looked at again, attempts from 1."""
    return (F.pow(F.lit(2.0), attempt - 1) * timeout_ms + 1000).cast("bigint")


def recoverable(message: Column) -> Column:
    """Errors after which a model is called again."""
    return message.startswith("model API returned status")
