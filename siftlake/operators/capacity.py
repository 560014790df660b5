"""Index space given out in order: each request takes from the node with the least free space that suffices."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.operators.catalog import LEAST_BYTES, MOST_BYTES

#: Nodes of a leaf of the tree of free space; a fuller one is split in two.
LEAF = 256
ASSIGNED = "request_id long, node_type string, bytes long, node_id long, status string"


class FreeSpace:
    """Nodes ordered by free space, then id, in a tree of two levels: sorted leaves of bounded size under their largest entries.
    Finding, taking and putting back take the logarithm of the nodes' number and one leaf."""

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []
        self.space: dict[int, tuple[int, int, int]] = {}

    def put(self, node: int, most: int, used: int, assigned: int) -> None:
        self.space[node] = (most, used, assigned)
        entry = (most - max(used, assigned), node)
        if not self.leaves:
            self.leaves, self.tops = [[entry]], [entry]
            return
        at = min(bisect_left(self.tops, entry), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, entry)
        if len(leaf) > LEAF:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.tops[at : at + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.tops[at] = leaf[-1]

    def take(self, need: int) -> int | None:
        """The node with the least free space of at least `need`, the smaller id of equal ones; its space shrinks."""
        at = bisect_left(self.tops, (need, -(1 << 63)))
        if at == len(self.tops):
            return None
        leaf = self.leaves[at]
        _, node = leaf.pop(bisect_left(leaf, (need, -(1 << 63))))
        if leaf:
            self.tops[at] = leaf[-1]
        else:
            del self.leaves[at], self.tops[at]
        most, used, assigned = self.space[node]
        self.put(node, most, used, assigned + need)
        return node


def assign_in_order(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """request_id, node_type, bytes, node_id, status: requests (request_id, node_type, bytes) of a type one after the other by
    request_id, each taking space from the active node it gets; rejected where none suffices or the size is out of range.

    Each choice depends on those before, so a type's requests go through one task, sorted by Spark and streamed: it holds
    the type's nodes alone. `reserved` gives the nodes as they are afterwards; the next batch of requests goes on from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free = None, FreeSpace()
        for b in batches:
            out = []
            for kind, i, size, most, used, assigned in zip(*(b.column(c).to_pylist() for c in ("node_type", "id", "bytes", "max_bytes", "used_bytes", "assigned_bytes")), strict=True):
                if kind != now:
                    now, free = kind, FreeSpace()
                if most is not None:
                    free.put(i, most, used, assigned)
                    continue
                node = free.take(size) if size is not None and LEAST_BYTES <= size <= MOST_BYTES else None
                out.append((i, kind, size, node, "rejected" if node is None else "assigned"))
            if out:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["request_id", "node_type", "bytes", "node_id", "status"])

    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    space = ["max_bytes", "used_bytes", "assigned_bytes"]
    have = nodes.filter("status = 'active' and max_bytes is not null").select("node_type", F.col("node_id").cast("long").alias("id"), *none("bytes"), F.col("max_bytes").cast("long").alias("max_bytes"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in space[1:]))
    want = requests.select("node_type", F.col("request_id").cast("long").alias("id"), F.col("bytes").cast("long").alias("bytes"), *none(*space))
    order = ["node_type", F.col("max_bytes").isNull(), "id", F.col("bytes")]
    return have.unionByName(want).repartition("node_type").sortWithinPartitions(*order).mapInArrow(run, ASSIGNED)


def reserved(nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    """nodes with what was assigned added to their assigned_bytes; other columns stay."""
    taken = assigned.filter("node_id is not null").groupBy("node_id").agg(F.sum("bytes").alias("_taken"))
    met = nodes.join(taken, "node_id", "left").withColumn("assigned_bytes", F.coalesce("assigned_bytes", F.lit(0)) + F.coalesce("_taken", F.lit(0)))
    return met.select(*nodes.columns)


def activated(sites: DataFrame, nodes: DataFrame, activates: Column, need: Column) -> DataFrame:
    """sites (site_id, node_type, indexing_node and more) with indexing_node and request after activation.

    A site that activates keeps the node it has (request `kept`); one without asks for `need` bytes, in the order of ids, and
    gets a node (`assigned`) or none (`rejected`), which does not undo its activation. Other sites stay as they are, request
    null.
    """
    marked = sites.withColumns({"_on": F.coalesce(activates, F.lit(False)), "_need": need})
    asks = marked.filter(F.col("_on") & F.col("indexing_node").isNull()).select(F.col("site_id").alias("request_id"), "node_type", F.col("_need").alias("bytes"))
    given = assign_in_order(asks, nodes).select(F.col("request_id").alias("site_id"), F.col("node_id").alias("_node"), F.col("status").alias("_status"))
    met = marked.join(given, "site_id", "left")
    request = F.when(F.col("_on"), F.coalesce("_status", F.lit("kept")))
    return met.withColumns({"indexing_node": F.coalesce("indexing_node", "_node"), "request": request}).select(*sites.columns, "request")
