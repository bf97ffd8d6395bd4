"""Filter trees against plain Python on random trees, and their errors."""

import random

import pytest
from pyspark.sql import functions as F

from storyatlas.functions.filters import filter_condition, filter_counts

SCHEMA = "i int, x double, s string, b boolean, `odd``.name` string, l array<int>"
NUMBERS, TEXTS = [None, 0, 1, 2.5, -1], [None, "", "a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(rng.choice([None, 0, 1, 2]), rng.choice([None, 0.0, 2.5, -1.0]), rng.choice(TEXTS), rng.choice([None, True, False]), rng.choice(TEXTS), [1]) for _ in range(60)]
    return data, spark.createDataFrame(data, SCHEMA)


def number(rng, depth):
    if depth and rng.random() < 0.4:
        return ["coalesce", number(rng, depth - 1), number(rng, depth - 1)] if rng.random() < 0.5 else ["case", condition(rng, depth - 1), number(rng, depth - 1), number(rng, depth - 1)]
    return rng.choice([["get", "i"], ["get", "x"], ["literal", rng.choice(NUMBERS[1:])], rng.choice(NUMBERS)])


def condition(rng, depth):
    kind = rng.randrange(8) if depth else rng.randrange(3)
    if kind == 0:
        return ["has", rng.choice(["i", "x", "s", "b", "l"])]
    if kind == 1:
        return [rng.choice(["==", "!="]), rng.choice([["get", "s"], ["get", "odd`.name"]]), rng.choice(TEXTS)]
    if kind == 2:
        return rng.choice([["get", "b"], True, None, ["in", ["get", "s"], ["literal", rng.sample(TEXTS, rng.randint(0, 3))]]])
    if kind in (3, 4):
        return [rng.choice(["<", "<=", ">", ">=", "==", "!="]), number(rng, depth - 1), number(rng, depth - 1)]
    if kind == 5:
        return ["!", condition(rng, depth - 1)]
    return [rng.choice(["all", "any"]), *(condition(rng, depth - 1) for _ in range(rng.randint(0, 3)))]


def told(tree, row):
    """What a tree gives for a row."""
    if not isinstance(tree, list):
        return tree
    op, *rest = tree
    if op == "get":
        return row[rest[0]]
    if op == "has":
        return row[rest[0]] is not None
    if op == "literal":
        return rest[0]
    if op == "in":
        return told(rest[0], row) in rest[1][1]
    v = [told(t, row) for t in rest]
    if op == "all":
        return all(v)
    if op == "any":
        return any(v)
    if op == "!":
        return not v[0]
    if op == "coalesce":
        return next((x for x in v if x is not None), None)
    if op == "case":
        return v[1] if v[0] else v[2]
    if op in ("==", "!="):
        return (v[0] == v[1]) == (op == "==")
    return None not in v and {"<": v[0] < v[1], "<=": v[0] <= v[1], ">": v[0] > v[1], ">=": v[0] >= v[1]}[op]


def test_random_trees(spark, rows):
    data, df = rows
    rng = random.Random(12)
    trees = [condition(rng, 4) for _ in range(60)]
    flags = df.select(F.array(*(filter_condition(t, df.schema) for t in trees)).alias("f")).collect()
    names = ["i", "x", "s", "b", "odd`.name", "l"]
    for row, got in zip(data, flags):
        named = dict(zip(names, row))
        assert got.f == [bool(told(t, named)) for t in trees]


def test_rows_without_a_year_are_not_counted(spark, rows):
    data, df = rows
    got = {r.name: r.n for r in filter_counts(df, {"every": True, "none": ["any"], "old": ["<=", ["coalesce", ["get", "i"], 0], 1]}, "i").collect()}
    assert got == {"every": sum(r[0] is not None for r in data), "none": 0, "old": sum(r[0] in (0, 1) for r in data)}
    assert filter_counts(df.limit(0), {"every": True}, "i").collect()[0].n == 0 and filter_counts(df, {}, "i").count() == 0


def test_filters_reach_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = orders.where(filter_condition(["all", [">=", ["get", "o_custkey"], 5], ["==", ["get", "o_orderstatus"], "F"]], orders.schema))._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(o_orderstatus,F)" in plan or "EqualTo(o_orderstatus,F)" in plan


@pytest.mark.parametrize("tree", [["get", "nothing"], ["get", 3], ["like", ["get", "s"], "a"], [], ["=="], ["==", 1, 2, 3], ["in", ["get", "s"], ["a"]], ["case", True, 1], ["literal", [1]], object()])
def test_wrong_trees(rows, tree):
    with pytest.raises(ValueError):
        filter_condition(["any", tree], rows[1].schema)


@pytest.mark.parametrize("tree", [["<", ["get", "i"], "a"], ["get", "s"], 1, ["all", "x"], ["==", ["get", "b"], 1], ["get", "l"], ["coalesce", 1, "a"], ["in", ["get", "i"], ["literal", ["a"]]], ["case", True, 1, "a"]])
def test_mixed_types(rows, tree):
    with pytest.raises(TypeError):
        filter_condition(tree, rows[1].schema)
