"""Running sums and maxima along a global order, and along the order within groups, with no task that holds a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.scratch import Scratch

#: Below any value whose maximum is asked.
NOTHING = -(1 << 62)


def _segments(group: np.ndarray, before: int | None) -> tuple[np.ndarray, bool]:
    """The number of each row's group in a batch, and whether the first one goes on from the batch before."""
    return np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])), before is not None and before == group[0]


def _add(values: np.ndarray, segment: np.ndarray, start: int) -> np.ndarray:
    total = np.cumsum(values)
    first = np.concatenate([[True], segment[1:] != segment[:-1]])
    base = (total - values)[np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))]
    return total - base + np.where(segment == 0, start, 0)


def _most(values: np.ndarray, segment: np.ndarray, start: int) -> np.ndarray:
    values = values.copy()
    values[0] = max(values[0], start)
    return pd.Series(values).groupby(segment).cummax().to_numpy()


def running(rows: DataFrame, order: list[str], sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, group: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """rows without `drop`, with the sums and maxima (new name: column of longs) of each row and those before it in ascending
    order within its group, nulls first; for a maximum also <name>_before, without the row itself, null where nothing is
    before. A null value counts as nothing.

    Rows are dealt to ranges of group and order, so that a group of any size is many tasks. Each range runs by itself; then
    what a range's first group carries from the ranges before, two rows a range, is added. Rows that agree in group and
    order stay in one range, in no particular order. An empty table stays empty.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    by, values = [*group, *order], {*sums.values(), *maxima.values()}
    dealt = rows.withColumn("_g", F.xxhash64(*group) if group else F.lit(0).cast("long")).repartitionByRange(*by).sortWithinPartitions(*by).drop(*(c for c in drop if c not in values))
    outs = [*sums, *maxima, *(f"{m}_before" for m in maxima)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields] + [f"`{o}` long" for o in outs] + ["_part int", "_head boolean", "_edge int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, state, waiting = TaskContext.get().partitionId(), None, None, dict.fromkeys(outs, 0), None

        def told(b: pa.RecordBatch, new: dict, head: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            columns = [*b.columns, *(pa.array(new[o]) for o in outs), pa.array(np.full(len(head), part, np.int32)), pa.array(head), pa.array(edge)]
            return pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *outs, "_part", "_head", "_edge"])

        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("_g").to_numpy()
            segment, goes_on = _segments(g, last)
            edge = np.zeros(len(g), np.int32)
            if first is None:
                first, edge[0] = g[0], 1
            value = lambda c, nothing: b.column(c).fill_null(nothing).to_numpy()  # noqa: B023, E731
            new = {o: _add(value(c, 0), segment, state[o] if goes_on else 0) for o, c in sums.items()}
            for o, c in maxima.items():
                start = state[o] if goes_on else NOTHING
                new[o] = _most(value(c, NOTHING), segment, start)
                shifted = np.concatenate([[start], new[o][:-1]])
                new[f"{o}_before"] = np.where(np.concatenate([[True], segment[1:] == segment[:-1]]), shifted, NOTHING)
            if waiting:
                yield told(*waiting)
            waiting, last, state = (b, new, g == first, edge), g[-1], {o: int(x[-1]) for o, x in new.items()}
        if waiting:
            waiting[3][-1] |= 2
            yield told(*waiting)

    held = Scratch(dealt.mapInArrow(run, schema), "running").df
    carried, group_before, before = [], None, {}
    edges = held.filter("_edge > 0").select("_part", "_edge", "_g", "_head", *sums, *maxima).orderBy("_part", "_edge").collect()
    for e in edges:  # one row or two for each range
        if e["_edge"] & 1:
            carry = before if group_before is not None and group_before == e["_g"] else {}
            carried.append((e["_part"], *(carry.get(o, 0) for o in sums), *(carry.get(o, NOTHING) for o in maxima)))
        if e["_edge"] & 2:
            carry = carry if e["_head"] else {}
            before = {o: e[o] + carry.get(o, 0) for o in sums} | {o: max(e[o], carry.get(o, NOTHING)) for o in maxima}
            group_before = e["_g"]
    session = rows.sparkSession
    carries = session.createDataFrame(carried, ", ".join(["_part int", *(f"`_c_{o}` long" for o in [*sums, *maxima])]))
    met = held.join(F.broadcast(carries), "_part")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in drop]
    added = [(F.col(f"`{o}`") + F.when(F.col("_head"), F.col(f"`_c_{o}`")).otherwise(0)).alias(o) for o in sums]
    highest = lambda o, c: F.greatest(F.col(f"`{o}`"), F.when(F.col("_head"), F.col(f"`_c_{c}`")).otherwise(NOTHING))
    some = lambda x: F.when(x > NOTHING, x)
    return met.select(*kept, *added, *(some(highest(o, o)).alias(o) for o in maxima), *(some(highest(f"{o}_before", o)).alias(f"{o}_before") for o in maxima))
