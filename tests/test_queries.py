"""Every registered query of the engine that has an oracle, against DuckDB on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

from storyatlas.plans import catalog, rule_queries  # noqa: F401


def norm(v):
    if v is None or pd.isna(v) is True:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(catalog.ORACLE[name]).df()
    got = catalog.QUERIES[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    table = lambda df: sorted((tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)
    assert table(got) == table(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_repeatable(spark, sf):
    one = sorted(map(tuple, catalog.sampled_in_region(spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert one == sorted(map(tuple, catalog.sampled_in_region(spark, sf).collect()))
        assert all(r[-1] for r in one)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_pairs_of_every_remainder(spark, sf):
    pairs = catalog.token_coverage_pairs(spark, sf).collect()
    counted = {r.doc_id: r.n_items for r in catalog.token_coverage(spark, sf).collect()}
    assert sum(counted.values()) == len(pairs) and len(counted) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert any(r.doc_id % 40 != r.item_id % 40 for r in pairs)


def test_ordinals_of_every_kind(spark, sf):
    got = {r.o_orderkey: r.digits for r in catalog.ordinals(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert {k % 7 for k in got} == set(range(7)) and set(got.values()) >= {"Bleecker and Perry Streets", "Fairway, 23rd Broadway"}


def test_ordinals_all_keep_every_kind(spark, sf):
    rows = catalog.ordinals_all(spark, sf).collect()
    of_orders = {r.l_orderkey: (r.ordinal, r.digits) for r in rows if r.l_linenumber is None}
    assert of_orders == {r.o_orderkey: (r.ordinal, r.digits) for r in catalog.ordinals(spark, sf).collect()}
    assert {k % 7 for k in of_orders} == set(range(7))
    lines = [r for r in rows if r.l_linenumber is not None]
    assert len(lines) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert len(rows) == len(of_orders) + len(lines)
