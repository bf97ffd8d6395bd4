"""Joins by signatures and cells, routing as one plan and the fold as a scan, against plain Python."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from storyatlas.functions import places as P
from storyatlas.functions.text import name_key
from storyatlas.operators import enrich, geometry, segment, similarity, spatial


def edited(rng, name, letters):
    out = list(name)
    for _ in range(rng.randint(0, 3)):
        at, kind = rng.randrange(len(out) + 1), rng.random()
        if kind < 0.4 and out:
            out.pop(min(at, len(out) - 1))
        elif kind < 0.7:
            out.insert(at, rng.choice(letters))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(3)
    known = sorted({"".join(rng.choice("abcde é") for _ in range(rng.randint(1, 24))) for _ in range(250)} | {"east harlem", "a", "aa", "ab" * 120})
    keys = sorted({edited(rng, n, "abcde é") for n in known for _ in range(2)} | {"west harlem", "a", "", "ab" * 119})
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in [*xs, None, xs[0]]], f"{c} string").repartition(3)
    return keys, known, frame(keys, "k"), frame(known, "n")


@pytest.mark.parametrize("cutoff,share", [(0.86, 0.02), (0.6, 0.7)])
def test_no_near_name_is_filtered_out(names, cutoff, share):
    """Every pair that reaches the ratio is a candidate, and few others are."""
    keys, known, k, n = names
    found = {tuple(r) for r in similarity.fuzzy_candidates(k, "k", n, "n", cutoff).collect()}
    near = {(a, b) for a in keys for b in known if a and b and SequenceMatcher(None, b, a).ratio() >= cutoff}
    assert near <= found and len(found) <= share * len(keys) * len(known)


def test_fuzzy_match_is_difflib(names):
    keys, known, k, n = names
    got = {r.k: r.match for r in similarity.fuzzy_match(k, "k", n, "n").collect()}
    assert got == {key: similarity.closest(key, [x for x in known if x]) if key else None for key in keys}
    assert got["west harlem"] is None


def shape(rng, x, y, size):
    """A region with a notch, a hole, edges along lines of cells, and rings that cross now and then."""
    at = lambda *ps: [(x + a * size, y + b * size) for a, b in [*ps, ps[0]]]
    outer = at((0, 0), (4, rng.choice([0, 0.5])), (4, 4), (2, rng.uniform(0.5, 3.5)), (0, 4))
    return [outer, at((1, 0.25), (1.5, 0.25), (1.25, 0.75))] + ([at((3, 3), (6, 3), (6, 6))] if rng.random() < 0.5 else [])


def test_points_meet_regions_by_cells(spark):
    rng = random.Random(11)
    shapes = [(i, shape(rng, rng.choice([0.0, rng.uniform(-20, 20)]), rng.uniform(-20, 20), rng.choice([0.01, 0.25, 1.0, 8.0]))) for i in range(60)]
    shapes += [(60, [[(1.0, 1.0), (1.0, 1.0)]]), (61, []), (62, [[(0.0, 0.0), (9.0, 0.0), (0.0, 0.0)]])]
    regions = spark.createDataFrame([*shapes, (63, None), (None, shapes[0][1])], f"name int, rings {geometry.RINGS}")
    points = [(i, rng.choice([float(rng.randint(-20, 20)), rng.uniform(-25, 40)]), rng.choice([float(rng.randint(-20, 20)), rng.uniform(-25, 40)])) for i in range(1500)]
    points += [(2000 + i, x + 0.3 * s, y + 0.3 * s) for i, (_, r) in enumerate(shapes[:60]) for (x, y), s in [(r[0][0], (r[0][1][0] - r[0][0][0]) / 4)]] + [(3000, None, 1.0)]

    def holds(rings, x, y):
        edges = [(*a, *b) for r in rings for a, b in zip(r[:-1], r[1:])]
        return sum(1 for x0, y0, x1, y1 in edges if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) % 2 == 1

    want = sorted((i, n) for i, x, y in points if x is not None for n, rings in shapes if holds(rings, x, y))
    frame = spark.createDataFrame(points, "id int, x double, y double").repartition(3)
    joined = spatial.regions_at(frame, "x", "y", regions, "name", "rings")
    assert sorted((r.id, r.name) for r in joined.collect()) == want and len(want) > 300
    assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()
    assert spatial.regions_at(frame, "x", "y", regions.limit(0), "name", "rings").count() == 0


def routed(spark, texts, places):
    queries = spark.createDataFrame([(t,) for t in texts], "query_raw string").withColumn("query", P.clean_query("query_raw")).withColumn("query_norm", name_key("query"))
    gazetteer = spark.createDataFrame([(n, float(i), 0.0, n, s, 1.0, True) for i, (n, s) in enumerate(places)], "name string, lat double, lon double, label string, source string, confidence double, bounded boolean")
    return enrich.resolve(queries, gazetteer)


def test_tails_do_not_grow_the_plan(spark):
    places = [("9th Street & Second Avenue", "geoservice"), ("Kennedy Airport", "nominatim"), ("Hall", "nominatim")]
    deep = "Booth in " * 10 + "the shop at 9th Street and Second Avenue"
    texts = [deep, "Hall", "Stage in Studio 54", "Booth in Hall on nothing", "JFK", "Gate at JFK Airport 7"]
    got = {r.query_raw: r for r in routed(spark, texts, places).collect()}
    assert (got[deep].lat, got[deep].low_confidence, got[deep].status) == (0.0, True, "ok")
    assert (got["Hall"].lat, got["Hall"].low_confidence) == (2.0, False) and got["JFK"].lat == 1.0
    assert got["Stage in Studio 54"].source == "manual" and got["Stage in Studio 54"].low_confidence
    assert got["Booth in Hall on nothing"].status == "unresolved"
    size = lambda t: len(routed(spark, [t], places)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(deep) - size("Hall")) < 200


LINES = [
    "Dear Diary:", "Dear Diary: On the bus today I saw it.", "A TITLE HERE", "SHORT", "John Smith", "-- JANE DOE", "Walking home, we met a man who said no.",
    "OUTDOOR CONCERT For me it was a thrill and more.", "It rained. -- WALTER GRAY", "and then the story went on for a while", "Mary Jones . . .", "ANOTHER TITLE OF THREE", "•", "",
]


def test_scan_is_the_fold(spark):
    rng = random.Random(5)
    pages = [(i if i else None, [rng.choice(LINES) for _ in range(rng.randint(0, 14))]) for i in range(250)]
    block = lambda x: F.struct(F.lit(0).alias("pos"), F.lit("p").alias("tag"), F.trim(x).alias("text"), F.lit("").alias("italic"), F.lit("").alias("marked"))
    rows = spark.createDataFrame(pages, "k int, l array<string>").select("k", F.transform("l", block).alias("blocks"))
    folded = rows.select("k", F.posexplode(segment.line_entries("blocks")).alias("pos", "e")).select("k", "pos", "e.title", "e.author", "e.body")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(segment.entries_of_lines(rows, "k", "blocks")) == order(folded)


def joined_rows(df):
    """The most rows that a join of the query made, once it has been collected."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        children = node.children()
        own = node.metrics().get("numOutputRows").get().value() if kind.endswith("JoinExec") and node.metrics().contains("numOutputRows") else 0
        return max([own, *map(walk, [*inner, *(children.apply(i) for i in range(children.size()))])])

    return walk(df._jdf.queryExecution().executedPlan())


def test_names_alike_in_their_beginnings_meet_few(spark):
    """Names of a few beginnings and many endings: none near is lost, and rows grow with the names, not with their pairs."""
    rng = random.Random(7)
    ending = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    known = sorted({rng.choice(["east ", "west ", "west "]) + ending(rng.choice([15, 16, 16, 16])) for _ in range(3000)})
    keys = sorted({edited(rng, k, "0123456789abcdef") for k in known} | {ending(16) + " upper" for _ in range(1000)})
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.PushDownPredicates")  # joins count what meets, before conditions
    try:
        found = similarity.fuzzy_candidates(frame(keys, "k"), "k", frame(known, "n"), "n")
        got = {tuple(r) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.optimizer.excludedRules")
    some = rng.sample(keys, 60)
    assert {(a, b) for a in some for b in known if SequenceMatcher(None, b, a).ratio() >= similarity.CUTOFF} <= got
    assert joined_rows(found) < 60 * len(keys)


def test_some_chosen_segments_are_whole():
    """Whatever the edits: of the places where segments are looked for, one has them all."""
    rng = random.Random(9)
    for _ in range(3000):
        edits, together = rng.randint(0, 6), rng.randint(1, 3)
        segments = [list(f"{i}{c}" for c in "abcd"[: rng.randint(1, 4)]) for i in range(edits + together)]
        letters = [x for s in segments for x in s]
        starts = [sum(map(len, segments[:i])) for i in range(len(segments) + 1)]
        key = list(letters)
        for i in range(rng.randint(0, edits)):
            if key and rng.random() < 0.5:
                key.pop(rng.randrange(len(key)))
            else:
                key.insert(rng.randrange(len(key) + 1), f"x{i}")
        if (len(key) - len(letters) - edits) % 2:
            continue  # lengths and the most edits are even or odd together
        ways = similarity._whole_segments(edits, together, len(key) - len(letters))
        at = lambda k, to: starts[k] + to >= 0 and key[starts[k] + to : starts[k + 1] + to] == segments[k]  # noqa: B023, E731
        assert any(all(at(k, to) for k, to in way) for way in ways)


@pytest.mark.parametrize("listed", [8192, 7])
def test_places_and_shapes_are_looked_up_once(spark, monkeypatch, listed):
    """Many points at few places and many regions of few shapes: joins make rows by points and lists, not by points and regions."""
    monkeypatch.setattr(spatial, "LISTED", listed, raising=False)
    rng = random.Random(13)
    shapes = [shape(rng, x, y, s) for x, y, s in ((0.0, 0.0, 1.0), (0.5, -1.0, 2.0), (-3.0, 0.0, 2.0))]
    regions = [(i, shapes[i % 3]) for i in range(60)]
    places = [(0.3, 0.3), (1.9, 0.4), (2.0, 3.0), (-0.0, 0.0), (0.0, 0.0), (30.0, 0.3), (None, 1.0)]
    points = [(i, *places[i % 7]) for i in range(700)]
    joined = spatial.regions_at(spark.createDataFrame(points, "id int, x double, y double"), "x", "y", spark.createDataFrame(regions, f"name int, rings {geometry.RINGS}"), "name", "rings")
    rows = sorted(map(tuple, joined.collect()), key=str)
    inside = lambda rings, x, y: sum((y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 for r in rings for (x0, y0), (x1, y1) in zip(r, r[1:])) % 2 == 1
    want = [(i, x, y, n) for i, x, y in points if x is not None for n, rings in regions if inside(rings, x, y)]
    assert rows == sorted(want, key=str) and len(want) > 5000
    assert joined_rows(joined) <= len(points) * (60 // listed + 1)
