"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from siftlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return float(f"{float(v):.9g}")
        return str(v)

    return sorted(repr(tuple(value(v) for v in r)) for r in rows.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, sf, name):
    found = registry.queries()[name](spark, sf).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    names = sorted(found.columns)
    assert canonical(found[names]) == canonical(want[names])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "doc_id", "score", "rank"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["search_end_to_end", "sparse_idf_topk"])
def test_every_benchmark_item_is_asked(spark, tmp_path, name):
    """Items of any number, not of some: each finds the document with its number, which has its text."""
    texts = [(1, "red fox"), (7, "blue bird"), (50, "green frog"), (99, "old gray wolf")]
    spark.createDataFrame([(i, f"s{i % 2}", t) for i, t in texts], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = registry.queries()[name](spark, str(tmp_path)).filter("rank = 1").toPandas()
    doc = found["doc_id"] if "doc_id" in found else found["point_id"] // 2**32
    assert sorted(zip(found["query_id"], doc, strict=True)) == [(i, i) for i, _ in texts]
