"""Index space in order: equal to the fold item by item, resumable, no node twice."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.operators import capacity
from siftlake.scratch import written

NODES = "node_id long, node_type string, status string, max_bytes long, used_bytes long, assigned_bytes long, label string"


def fold(space, needs):
    """space: id to (most, used, assigned)."""
    space, out = dict(space), []
    for need in needs:
        free = sorted((m - max(u, a), i) for i, (m, u, a) in space.items() if m - max(u, a) >= need)
        node = free[0][1] if free else None
        if node is not None:
            m, u, a = space[node]
            space[node] = (m, u, a + need)
        out.append(node)
    return out


SPACE = st.dictionaries(st.integers(0, 60), st.tuples(st.integers(0, 300), st.integers(0, 100), st.integers(0, 100)), max_size=40)


@settings(max_examples=100, deadline=None)
@given(SPACE, st.lists(st.integers(1, 120), max_size=80), st.sampled_from([1, 2, 7, 256]))
def test_tree_equals_the_fold(space, needs, leaf):
    kept, capacity.LEAF = capacity.LEAF, leaf
    try:
        free = capacity.FreeSpace()
        for i, x in space.items():
            free.put(i, *x)
        assert [free.take(n) for n in needs] == fold(space, needs)
        entries = [e for x in free.leaves for e in x]
        assert entries == sorted(entries) and len(entries) == len(space) and all(0 < len(x) <= leaf + 1 for x in free.leaves)
    finally:
        capacity.LEAF = kept


def tables(spark, seed=5):
    rng = random.Random(seed)
    nodes = [(i, "ab"[i % 2], "active" if i % 7 else "inactive", rng.randrange(500, 3000), rng.randrange(600), rng.randrange(600), "x") for i in range(60)]
    wanted = [(i, "abc"[rng.randrange(3)], rng.choice([rng.randrange(1, 400), 0, None, 2_000_000_000]) if i % 9 == 0 else rng.randrange(1, 400)) for i in range(400)]
    return nodes, wanted, spark.createDataFrame(nodes, NODES).repartition(3), spark.createDataFrame(wanted, "request_id long, node_type string, bytes long").repartition(5)


def test_assignment_equals_the_fold(spark):
    nodes, wanted, have, want = tables(spark)
    found = {r.request_id: (r.node_id, r.status) for r in capacity.assign_in_order(want, have).collect()}
    for kind in "abc":
        space = {i: (m, u, a) for i, k, s, m, u, a, _ in nodes if k == kind and s == "active"}
        mine = [(i, b) for i, k, b in wanted if k == kind]
        sized = [(i, b) for i, b in mine if b and b <= capacity.MOST_BYTES]
        want_nodes = dict(zip([i for i, _ in sized], fold(space, [b for _, b in sized]), strict=True))
        for i, _ in mine:
            node = want_nodes.get(i)
            assert found[i] == (node, "rejected" if node is None else "assigned")
    assert capacity.assign_in_order(want.filter("request_id < 0"), have).count() == 0
    assert {r.status for r in capacity.assign_in_order(want, have.filter("node_id < 0")).collect()} == {"rejected"}


def test_batches_go_on_where_the_last_ended(spark):
    _, _, have, want = tables(spark)
    whole = {tuple(r) for r in capacity.assign_in_order(want, have).collect()}
    parts = set()
    for low in range(0, 400, 130):
        batch = written(capacity.assign_in_order(want.filter(F.col("request_id").between(low, low + 129)), have), "batch")
        parts |= {tuple(r) for r in batch.collect()}
        have = written(capacity.reserved(have, batch), "nodes")
    assert parts == whole and have.columns == [c.split()[0] for c in NODES.split(", ")]


def test_activation_keeps_nodes(spark):
    nodes = spark.createDataFrame([(1, "a", "active", 100, 0, 0, "x"), (2, "a", "active", 50, 0, 0, "x")], NODES)
    sites = spark.createDataFrame([(1, "a", 9, True, 40), (2, "a", None, True, 40), (3, "a", None, False, 40), (4, "a", None, True, 70), (5, "a", None, True, 70), (6, "a", None, None, 1)], "site_id long, node_type string, indexing_node long, goes boolean, size long")
    found = {r.site_id: (r.indexing_node, r.request) for r in capacity.activated(sites, nodes, F.col("goes"), F.col("size")).collect()}
    assert found == {1: (9, "kept"), 2: (2, "assigned"), 3: (None, None), 4: (1, "assigned"), 5: (None, "rejected"), 6: (None, None)}
