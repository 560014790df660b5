"""Failure counts over streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftlake.operators.dlq import ALERT, QUIET_S, sessions


def session_stream(failures: DataFrame, late: str = "10 minutes", quiet_s: int = QUIET_S) -> DataFrame:
    """Closed sessions of failures (site_id, ts), each once the watermark has passed its quiet time."""
    return sessions(failures.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), quiet_s=quiet_s)


def alert_stream(failures: DataFrame, threshold: int = ALERT, quiet_s: int = QUIET_S, late: str = "10 minutes") -> DataFrame:
    """site_id, ts, n: one row when a tenant's count reaches the threshold; the count begins anew after quiet_s without a
    failure. Failures of a batch are taken in the order of their time. A tenant's state goes once the watermark, `late`
    behind the latest failure, has passed its quiet time."""

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0.0)
        at = np.sort(np.concatenate([p["at"].to_numpy() for p in parts]))
        before = np.concatenate([[last], np.maximum.accumulate(np.maximum(at, last))[:-1]])
        fresh = at - before >= quiet_s
        fresh[:1] |= not n
        place = np.arange(len(at))
        since = np.maximum.accumulate(np.where(fresh, place, -1))  # where the count began, -1: before this batch
        counts = np.where(since < 0, n + place + 1, place - since + 1)
        reached = at[counts == threshold]
        last = max(last, float(at[-1]))
        state.update((int(counts[-1]), last))
        state.setTimeoutTimestamp(max(int((last + quiet_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"site_id": [key[0]] * len(reached), "ts": pd.to_datetime(reached, unit="s"), "n": [threshold] * len(reached)})

    rows = failures.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("site_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("site_id").applyInPandasWithState(count, "site_id long, ts timestamp, n long", "n long, last double", "append", GroupStateTimeout.EventTimeTimeout)
