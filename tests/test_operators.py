import json
import math

import pytest
from pyspark.sql import functions as F

from storyatlas.functions import places as P
from storyatlas.functions import text as X
from storyatlas.functions.text import name_key
from storyatlas.operators import enrich as E
from storyatlas.operators import geometry as G
from storyatlas.operators import neighborhoods as N
from storyatlas.operators import relational as R
from storyatlas.operators import similarity
from storyatlas.plans import views as V
from storyatlas.sources import files as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_keep_first_and_upsert(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "", "a"), (4, "x", "b")], "i int, t string, b string")
    assert [r[0] for r in rows(R.keep_first(df, ["t", "b"], ["i"]))] == [1, 3, 4]
    new = spark.createDataFrame([(1, "n", "n")], df.schema)
    assert rows(R.upsert(df.where("i < 3"), new, "i")) == [(1, "n", "n"), (2, None, "a")]
    assert rows(R.resume(df.select("i"), (new, "i"))) == [(2,), (3,), (4,)]
    assert rows(R.resume(R.resume(df.select("i"), (df, "i")))) == []


def test_modal_and_first_match(spark):
    df = spark.createDataFrame([("n", "Queens"), ("n", "Bronx"), ("m", "A"), ("m", "B"), ("m", "B")], "k string, v string")
    assert rows(R.modal_value(df, "k", "v")) == [("m", "B"), ("n", "Bronx")]
    items = spark.createDataFrame([(1, ["z", "y", "x"]), (2, []), (3, None)], "id int, a array<string>")
    look = spark.createDataFrame([("x", 1), ("y", 2)], "key string, v int")
    assert rows(R.first_match(items, "a", look, "key", "id").select("id", "match.v")) == [(1, 2)]


def test_sample_is_stable(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("s"))
    a = rows(R.stratified_sample(df, "s", 5, "id", 1))
    assert a == rows(R.stratified_sample(df.repartition(7), "s", 5, "id", 1)) and len(a) == 15


SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]]


def test_point_in_ring_with_hole(spark):
    df = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (5.0, 1.0)], "x double, y double").withColumn("r", F.lit(json.dumps([[{"x": x, "y": y} for x, y in ring] for ring in SQUARE])))
    df = df.withColumn("r", F.from_json("r", G.RINGS))
    assert [r[0] for r in df.select(G.inside(F.col("x"), F.col("y"), F.col("r"))).collect()] == [True, False, False]


# a square with a hole, a thin V, a comb, two parts, a ring that crosses itself, and one without area
SHAPES = {
    "hole": SQUARE,
    "v": [[(0.0, 10.0), (0.1, 10.0), (5.0, 0.1), (9.9, 10.0), (10.0, 10.0), (5.0, 0.0), (0.0, 10.0)]],
    "comb": [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (8.9, 9.0), (8.9, 0.1), (5.0, 0.1), (5.0, 9.0), (4.9, 9.0), (4.9, 0.1), (0.1, 0.1), (0.1, 9.0), (0.0, 9.0), (0.0, 0.0)]],
    "parts": [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(50.0, 50.0), (60.0, 50.0), (60.0, 60.0), (50.0, 60.0), (50.0, 50.0)]],
    "bow": [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]],
    "flat": [[(1.0, 2.0), (3.0, 2.0), (1.0, 2.0)]],
}


def area_of(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring[:-1], ring[1:], strict=True)) / 2


def test_points_lie_inside_whatever_the_region(spark):
    regions = spark.createDataFrame(list(SHAPES.items()), f"name string, rings {G.RINGS}")
    rows = spark.range(2000).select("id", F.explode(F.array(*map(F.lit, [*SHAPES, "unknown"]))).alias("name"))
    got = G.points_in_regions(rows, "name", G.region_pieces(regions, "name", "rings"), "p", 1, F.col("id")).join(regions, "name", "left")
    got = got.select("id", "name", "p", F.when(F.col("rings").isNotNull(), G.inside(F.col("p.x"), F.col("p.y"), F.col("rings"))).alias("inside")).toPandas()
    assert len(got) == 2000 * 7
    for name, own in got.groupby("name"):
        if name == "unknown":
            assert own["p"].isna().all()
        elif name == "flat":
            assert {tuple(p) for p in own["p"]} == {(1.0, 2.0)}
        else:
            assert own["inside"].all() and len({tuple(p) for p in own["p"]}) == 2000
    # draws go by area
    left = sum(p[0] < 5 for p in got[got.name == "v"]["p"])
    assert 850 < left < 1150
    assert sum(p[0] < 2 for p in got[got.name == "parts"]["p"]) < 40
    low = sum(p[1] < 1 for p in got[got.name == "hole"]["p"])
    assert abs(low / 2000 - 1 / 3) < 0.05


@pytest.mark.parametrize("name", ["hole", "v", "comb", "parts"])
def test_trapezoids_have_the_area_of_the_region(name):
    rings = [[{"x": x, "y": y} for x, y in ring] for ring in SHAPES[name]]
    t = G.trapezoids(rings)
    area = ((t[:, 1] - t[:, 0]) * (t[:, 4] - t[:, 2] + t[:, 5] - t[:, 3]) / 2).sum()
    want = [abs(area_of(r)) for r in SHAPES[name]]
    assert abs(area - (want[0] - want[1] if name == "hole" else sum(want))) < 1e-9


def test_alias_table_keeps_the_weights():
    import numpy as np

    w = np.array([5.0, 1.0, 0.0, 2.5, 0.1])
    share, other = G.alias_table(w.copy())
    got = share / len(w)
    for i, j in enumerate(other):
        got[j] += (1 - share[i]) / len(w)
    assert np.allclose(got, w / w.sum())


def test_clip_and_line(spark):
    lines = spark.createDataFrame([("in", [[(-1.0, 0.5), (9.0, 0.5)]]), ("out", [[(8.0, 8.0), (9.0, 9.0)]])], f"line string, paths {G.RINGS}")
    cut = G.clipped_lines(lines, "line", "paths", spark.createDataFrame([("S", SQUARE)], f"name string, rings {G.RINGS}"), "name", "rings").collect()
    assert [(r.line, r.name, [[(p.x, p.y) for p in path] for path in r.paths]) for r in cut] == [("in", "S", [[(0.0, 0.5), (4.0, 0.5)]])]


def test_spread(spark):
    df = spark.createDataFrame([(1, 0.0, 40.0), (2, 0.0, 40.0), (3, 5.0, 40.0)], "entry_id int, x double, y double")
    got = {r[0]: (r[1], r[2]) for r in G.spread_coincident(df, "x", "y", "entry_id").collect()}
    assert got[3] == (5.0, 40.0) and got[1] != got[2]
    for i in (1, 2):
        metres = math.hypot(got[i][0] * 111_000 * math.cos(math.radians(40)), (got[i][1] - 40) * 111_000)
        assert 0 < metres <= 120.2


def test_extract_errors_are_rows(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "bad")], "entry_id string, text string")
    good = {"subway_mentioned": True, "subway_lines": ["R"], "specific_location_mentioned": True, "specific_locations": ["Chelsea", "Cafe X"], "neighborhood_mentioned": False, "neighborhoods": [], "borough_mentioned": False, "boroughs": []}

    def call(text):
        return good if text == "ok" else {"oops": 1}

    got = {r["entry_id"]: r for r in E.extract(df, call, ["chelsea"]).collect()}
    assert got["a"]["specific_locations"] == ["Cafe X"] and got["a"]["error"] is None
    assert got["b"]["subway_lines"] is None and "oops" in got["b"]["error"]
    assert [r["entry_id"] for r in E.is_done(E.extract(df, call)).collect()] == ["a"]


def test_geocode_resumes(spark):
    ent = spark.createDataFrame([("1", ["JFK"], None), ("2", ["Cafe X at 96th and Park"], None), ("3", ["42d Street"], None), ("4", ["  "], None), ("5", ["La Guardia"], None)], "entry_id string, specific_locations array<string>, error string").withColumn("specific_location_mentioned", F.lit(True))
    places = spark.createDataFrame([("Kennedy Airport", 1.0, "Kennedy Airport, NY"), ("96 Street & Park Avenue", 2.0, "96 St"), ("42nd Street", 3.0, "42nd Street")], "name string, lat double, label string")
    places = places.withColumns({"lon": F.lit(0.0), "source": F.lit("nominatim"), "confidence": F.lit(1.0), "bounded": F.lit(True)})
    found, cache = E.geocode(ent, places)
    got = {r["entry_id"]: (r["lat"], r["low_confidence"], r["status"]) for r in found.collect()}
    assert got == {"1": (1.0, False, "ok"), "2": (2.0, True, "ok"), "3": (3.0, True, "ok"), "5": (40.77571, False, "ok")}
    again, full = E.geocode(ent, places, spark.createDataFrame(cache.collect(), cache.schema))
    assert full.count() == cache.count() and again.count() == found.count()


def test_sources(spark, tmp_path):
    gj = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "A"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}}, {"type": "Feature", "properties": {"name": "L"}, "geometry": {"type": "LineString", "coordinates": [[0, 0, 7], [1, 2, 7]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(gj))
    got = S.geojson(spark, str(tmp_path / "a.geojson"), "name:string").collect()
    assert [r["name"] for r in got] == ["A", "L"] and [tuple(p) for p in got[1]["rings"][0]] == [(0.0, 0.0), (1.0, 2.0)]
    kml = "<kml><Document><Placemark><name>P (Q)</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,0 1,0,0 1,1,0 0,0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark><Placemark><name>note</name></Placemark></Document></kml>"
    (tmp_path / "a.kml").write_text(kml)
    areas = S.kml_areas(spark, str(tmp_path / "a.kml")).collect()
    assert [r["name"] for r in areas] == ["P (Q)"] and tuple(areas[0]["rings"][0][2]) == (1.0, 1.0)
    assert S.optional_table(spark, str(tmp_path / "none"), "a int").count() == 0
    table = str(tmp_path / "t")
    S.replace_table(spark.range(3), table)
    S.replace_table(spark.read.parquet(table).where("id > 0"), table, ["id"])
    assert rows(spark.read.parquet(table)) == [(1,), (2,)]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "g1.html").write_text("<p>x</p>")
    pages = S.page_folder(spark, str(tmp_path / "pages"))
    assert rows(pages) == [("g1", "<p>x</p>")]
    have, missing = S.missing_pages(spark.createDataFrame([("g1",), ("g2",)], "guid string"), pages)
    assert have.count() == 1 and missing.first()[0] == 1


def test_articles(spark):
    doc = {"headline": {"main": "Town Notes", "kicker": " town notes ", "print_headline": None}, "byline": {"original": "By X"}, "keywords": [{"name": "Location", "value": "A"}, {"name": "Location", "value": "B"}], "multimedia": {"default": {"url": "u"}, "thumbnail": None, "caption": "c", "credit": None}, "type_of_material": "News", "pub_date": "1999-02-03T00:00", "web_url": "w", "uri": "a/b"}
    df = spark.read.schema("headline struct<main:string,kicker:string,print_headline:string>, byline struct<original:string>, keywords array<struct<name:string,value:string>>, multimedia struct<default:struct<url:string>,thumbnail:struct<url:string>,caption:string,credit:string>, type_of_material string, pub_date string, web_url string, uri string").json(
        spark.sparkContext.parallelize([json.dumps(doc), json.dumps(doc | {"type_of_material": "Correction"}), json.dumps(doc | {"headline": {"main": "Best of Town Notes", "kicker": "Other"}})])
    )
    got = S.articles(df, "Town Notes").select("is_entry", "locations", "pub_year", "image_url", "foreign_kicker").collect()
    assert [tuple(r) for r in got] == [(True, "A; B", 1999, "u", False), (False, "A; B", 1999, "u", False), (False, "A; B", 1999, "u", True)]


def test_learned_boroughs(spark):
    df = spark.createDataFrame([("1", ["queens", "the bronx"], ["Astoria"]), ("2", None, ["Astoria"]), ("3", ["Queens"], ["Astoria", "Astoria"])], "entry_id string, boroughs array<string>, neighborhoods array<string>")
    assert rows(V.learned_boroughs(df)) == [("astoria", "Queens")]
    areas = spark.createDataFrame([("Korea Town", False, [[(0.0, 0.0)]]), ("Midtown", True, [[(0.0, 0.0)]])], f"name string, broad boolean, rings {G.RINGS}").withColumn("key", name_key("name"))
    got = V.with_neighborhood(spark.createDataFrame([("1", ["Nowhere", "Koreatown"]), ("2", ["midtown"]), ("3", None)], "entry_id string, neighborhoods array<string>"), areas)
    assert rows(got.select("entry_id", "nbhd_name")) == [("1", "Korea Town"), ("2", "Midtown"), ("3", None)]


def test_stream(spark, tmp_path, sf):
    from storyatlas.streaming.incremental import enrich_arrivals, windowed_counts

    src, done = str(tmp_path / "in"), str(tmp_path / "done")
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "entry_id string, v int").write.parquet(src)
    for _ in range(2):
        enrich_arrivals(spark, src, "entry_id string, v int", done, str(tmp_path / "cp"), lambda d: d.withColumn("w", F.col("v") * 2)).awaitTermination()
    assert rows(spark.read.parquet(done)) == [("a", 1, 2), ("b", 2, 4)]
    assert windowed_counts(spark.read.parquet(f"{sf}/events.parquet")).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_rank_columns_of_the_user_stay(spark):
    df = spark.createDataFrame([(1, "a", 7), (2, "a", 8), (3, "b", 9)], "i int, k string, _rank int")
    assert rows(R.keep_first(df, ["k"], ["i"])) == [(1, "a", 7), (3, "b", 9)]
    assert R.stratified_sample(df, "k", 1, "i", 1).columns == df.columns


def test_replaced_table_survives_a_crash(spark, tmp_path):
    table = tmp_path / "t"
    S.replace_table(spark.range(3), str(table))
    table.rename(tmp_path / "t.old")  # as after a crash between setting aside and swapping
    S.replace_table(spark.range(5), str(table))
    assert rows(spark.read.parquet(str(table))) == [(i,) for i in range(5)] and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()


def test_coordinates_in_json(spark):
    docs = ['{"a": [{"Latitude": "1.5", "b": {"latitude": 3, "longitude": 4}}, {"xLongitude": 9, "latitude": 8}]}', '{"latitude": 0, "longitude": 2, "in": {"latitude": 5, "longitude": "6"}}', '{"latitude": "x", "longitude": 1}', "no json", None, "[]", "3"]
    got = spark.createDataFrame([(d,) for d in docs], "d string").select(E.coordinates_in("d").alias("c")).select("c.*").collect()
    assert [(r.lat, r.lon) for r in got] == [(3.0, 4.0), (5.0, 6.0), *[(None, None)] * 5]


def test_display_titles(spark):
    cases = {"THE MTA'S 5TH rule": "The MTA's 5th Rule", "moma in soho": "MoMA in SoHo".replace("in", "In"), "nyx ny": "Nyx NY", "o'neill  was (here)": "O'neill  Was (Here)", "éa b": "éA B", "": ""}
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(X.display_title("t")).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_first_borough(spark):
    df = spark.createDataFrame([(["x", "Astoria", "Harlem"],), ([None],), (None,)], "n array<string>")
    assert [r[0] for r in df.select(P.first_borough("n", {"astoria": "Queens", "harlem": "Manhattan"})).collect()] == ["Queens", None, None]
    assert df.select(P.first_borough("n", {})).first()[0] is None


def test_names_of_any_number(spark, monkeypatch):
    """Keys that meet names by short runs of letters alone find what one list of names gives."""
    names = [f"{d} {w}town" for d in ("east", "west", "north") for w in ("korea", "china", "hills", "old")] + ["koreatown", "k", "plain hills"]
    keys = ["korea town", "west koreatown", "east chinatwn", "nort oldtown", "zzz", "", None, "plain hill", "k"]
    frame = lambda values, c: spark.createDataFrame([(v,) for v in values], f"{c} string")
    want = {k: similarity.closest(k, sorted(names)) if k else None for k in keys if k is not None}
    monkeypatch.setattr(similarity, "LONGEST", 2)
    got = {r.key: r.match for r in similarity.fuzzy_match(frame(keys * 2, "key"), "key", frame(names, "name"), "name").collect()}
    assert got == want and want["korea town"] == "koreatown" and want["west koreatown"] == "west koreatown"


def test_publish(spark, tmp_path):
    square = lambda x: [[(x, 0.0), (x + 4.0, 0.0), (x + 4.0, 4.0), (x, 4.0), (x, 0.0)]]
    areas = N.with_unions(N.named_areas(spark.createDataFrame([("Hill (WEST)", square(0.0)), ("Dale (WEST)", square(4.0))], f"name string, rings {G.RINGS}")))
    found = N.lookup_areas(areas)
    assert rows(found.select("key", "name", "broad", F.size("rings"))) == [("dale", "Dale", False, 1), ("hill", "Hill", False, 1), ("west", "West", True, 1)]
    boroughs = spark.createDataFrame([("Queens", square(0.0))], f"name string, rings {G.RINGS}")
    lines = spark.createDataFrame([("R", "r line", [[(1.0, 1.0), (9.0, 1.0)]]), ("R", "r line", [[(9.0, 1.0), (9.0, 3.0)]])], f"service string, service_name string, rings {G.RINGS}")
    entries = spark.createDataFrame(
        [("1", ["west"], None, None, False, 1.0, 1.0, None), ("2", ["Hill"], None, None, False, None, None, None), ("3", None, ["Queens"], ["r"], True, None, None, None), ("4", None, None, ["Z"], True, None, None, None), ("5", None, None, None, False, None, None, None), ("6", None, None, None, False, 1.0, 1.0, " hill "), ("7", ["Nowhere"], None, None, False, None, None, None)],
        "entry_id string, neighborhoods array<string>, boroughs array<string>, subway_lines array<string>, subway_mentioned boolean, lat double, lon double, query_raw string",
    ).withColumns({c: F.lit(None).cast(t) for c, t in (("title", "string"), ("author", "string"), ("pub_year", "int"), ("web_url", "string"), ("specific_locations", "array<string>"), ("confidence", "double"), ("low_confidence", "boolean"), ("source", "string"), ("category", "string"))})
    placed = V.with_neighborhood(V.with_borough(entries, boroughs, V.learned_boroughs(entries)), found)
    told = V.publish(placed, areas.where("NOT is_admin_0_union"), boroughs, lines, str(tmp_path))
    assert told == {"locations": 2, "subway": 2, "areas": 4, "basemap_boroughs": 1, "basemap_lines": 1, "skipped": 1}
    load = lambda n: json.loads((tmp_path / f"{n}.geojson").read_text())["features"]
    assert [(f["properties"]["entry_id"], f["properties"]["placement"]) for f in load("areas")] == [("1", "specific"), ("2", "neighborhood"), ("3", "borough"), ("6", "area:Hill")]
    assert [f["properties"]["placement"] for f in load("subway")] == ["subway:R", "subway:network"]
    assert all(0 <= f["geometry"]["coordinates"][0] <= 4 for f in load("areas")[1:])
    (line,) = load("basemap_lines")
    assert line["geometry"]["type"] == "MultiLineString" and len(line["geometry"]["coordinates"]) == 2 and line["properties"] == {"service": "R", "service_name": "r line"}
    assert load("basemap_boroughs")[0]["geometry"]["coordinates"][0][0][1] == [4.0, 0.0]


def test_every_covered_pair(spark):
    """No pair is left out, whatever the remainders of its ids."""
    texts = ["Carnegie Hall, New York", "carnegie deli and hall", "Lundy's", "", None, "Plaza", "one two three", "Hall one"]
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, text string")
    asked = ["Carnegie Hall", "Lundy's restaurant", "the park", "one two three four", "nothing of it", "hall one two", None]
    queries = spark.createDataFrame([(100 + i, t) for i, t in enumerate(asked)], "item int, text string")
    brute = labels.crossJoin(queries.withColumnRenamed("text", "q")).where(P.label_covers("q", "text")).select("doc", "item")
    got = similarity.covered_pairs(labels, "doc", "text", queries, "item", "text")
    assert rows(got.select("doc", "item")) == rows(brute)
    assert {r[2:] for r in rows(got) if r[1] == 102} == {(0, 0)} and (6, 103, 4, 3) in rows(got)


def test_sinks(spark, tmp_path):
    """Compact JSON with all fields, and the review table without shapes."""
    df = spark.createDataFrame([("a", None, [[(1.0, 2.0)]]), ("é", 2, [[(3.0, 4.0)]])], f"name string, n int, rings {G.RINGS}").coalesce(1)
    S.json_lines(df.select(F.to_json(F.struct("name", "n"), {"ignoreNullFields": "false"}).alias("j")), "j", str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ['{"name":"a","n":null}', '{"name":"é","n":2}']
    S.review_csv(df, str(tmp_path / "review"))
    got = spark.read.option("header", True).csv(str(tmp_path / "review"))
    assert got.columns == ["name", "n"] and got.count() == 2


def test_windows_are_halved(spark):
    """Against recursion over the same numbers; a single number may hold too many."""
    numbers = [3] * 9 + [4, 5, 11] + list(range(20, 30)) * 2 + [99, None]

    def halves(a, b):
        n = sum(1 for x in numbers if x is not None and a <= x <= b)
        if n > 4 and a < b:
            m = (a + b) // 2
            return [*halves(a, m), *halves(m + 1, b)]
        return [(a, b, n, min(2, -(-n // 2)), n <= 4)]

    got = R.bisected_windows(spark.createDataFrame([(x,) for x in numbers], "x int"), "x", 0, 29, 13, 4, 2, 2)
    assert sorted(map(tuple, got.collect())) == [w for a in (0, 13, 26) for w in halves(a, min(a + 12, 29))]
