"""Worked examples of the text and place rules."""

from pyspark.sql import functions as F

from storyatlas.functions import places as P
from storyatlas.functions import text as X
from storyatlas.operators.levels import name_levels
from storyatlas.operators.similarity import closest


def apply(spark, rule, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, q string")
    return [r[0] for r in rows.select("i", rule(F.col("q")).alias("v")).orderBy("i").select("v").collect()]


def test_classify(spark):
    cases = {
        "68th Street and York Avenue": "intersection",
        "40th Street between Park and Lexington": "relational",
        "Spring Street off West Broadway": "relational",
        "Spring Street station": "station",
        "Amsterdam Avenue": "bare_street",
        "Carnegie Hall": "place",
        "495 East 55th Street": "place",
        "Rose Center for Earth and Space": "place",
        "Gotham Bar and Grill": "place",
        "Bleecker and Perry Streets": "intersection",
        "53rd and Fifth": "intersection",
    }
    assert apply(spark, P.classify, list(cases)) == list(cases.values())


def test_streets(spark):
    assert apply(spark, P.clean_query, ["Fairway, Broadway", "M4 crosstown bus", "40th Street, between Park and Lexington"]) == ["Fairway", "M4", "40th Street, between Park and Lexington"]
    assert apply(spark, P.street_pair, ["40th Street between Park and Lexington", "nowhere"]) == [("40th Street", "Park"), None]
    assert apply(spark, P.canonical_street, ["96th", "Fifth", "West 74th", "the Riverside", "Vesey"]) == ["96 Street", "Fifth Avenue", "West 74 Street", "Riverside Drive", "Vesey"]
    assert apply(spark, P.crossing_streets, ["Bleecker and Perry Streets", "96th and Park", "17th and 18th Avenues"]) == [("Bleecker Street", "Perry Street"), ("96 Street", "Park Avenue"), ("17 Avenue", "18 Avenue")]


def test_stations_and_tails(spark):
    assert apply(spark, P.strip_station, ["34th Street R train station", "station"]) == ["34th Street", "station"]
    assert apply(spark, P.station_core, ["96th Street West Side IRT station"]) == ["96th Street"]
    assert apply(spark, P.location_tail, ["Petco at 86th Street and Lexington Avenue", "in Peru"]) == ["86th Street and Lexington Avenue", None]


def test_ordinals(spark):
    assert apply(spark, P.digit_ordinals, ["Ninth Avenue", "East 52d Street", "Park Avenue", "11 and 21 and 112 and 123", "007th"]) == ["9th Avenue", "East 52nd Street", "Park Avenue", "11th and 21st and 112th and 123rd", "7th"]
    assert apply(spark, P.is_pinned_street, ["42d Street", "Second Avenue", "Park Avenue", "Bleecker Street"]) == [True, True, True, False]


def test_coverage(spark):
    rows = spark.createDataFrame([("Lundy's restaurant", "MARINA RESTAURANT, East Elmhurst, NY, USA"), ("Carnegie Hall", "Carnegie Hall, New York"), ("the park", "Anything"), ("x", None)], "q string, l string")
    assert [r[0] for r in rows.select(P.label_covers("q", "l")).collect()] == [False, True, True, False]


def test_boroughs(spark):
    assert apply(spark, P.canonical_borough, ["the bronx", "kings", "Hoboken", None]) == ["Bronx", "Brooklyn", None, None]


def test_text(spark):
    assert apply(spark, X.name_key, ["Déjà\u00a0Vu, St. Mark's  Pl"]) == ["déjà vu st mark s pl"]
    assert apply(spark, X.name_key, ["a_b  c!"]) == ["a_b c"]
    assert apply(spark, X.salutation_body, ["dear diary,  I ran", "I ran"]) == ["Dear Diary:\n\nI ran"] * 2
    assert apply(spark, X.smart_case, ["O'NEIL JEAN-PAUL 5TH", "McCoy"]) == ["O'Neil Jean-Paul 5Th", "McCoy"]
    assert apply(spark, X.byline, ["By Jane Doe", "By ", None]) == ["Jane Doe", None, None]
    assert apply(spark, X.year_of, ["1999-01-02", "199", None]) == [1999, None, None]
    assert apply(spark, X.image_year, ["a/images/2020/01/x.jpg", "a", None]) == [2020, 0, 0]
    assert apply(spark, lambda c: X.guid(c, F.lit("http://a.b/c_d/")), ["x://article/12-ab", None, "x/"]) == ["12-ab", "http-a-b-c-d", "http-a-b-c-d"]
    assert apply(spark, lambda c: X.json_object(c, F.lit('r {"b":1}')), ['x {"a":{}} y', "none"]) == ['{"a":{}}', '{"b":1}']


def test_content_id(spark):
    import hashlib

    rows = spark.createDataFrame([("u", None, "t", "b"), ("u", "", "t", "b")], "a string, b string, c string, d string")
    want = "e" + hashlib.sha1("\x1f".join(["u", "", "t", "b"]).encode()).hexdigest()[:16]
    assert [r[0] for r in rows.select(X.content_id("a", "b", "c", "d")).collect()] == [want, want]


def test_levels(spark):
    cases = {
        "Chelsea": ("Chelsea", "Chelsea", "Chelsea"),
        "Columbia University (MORNINGSIDE HEIGHTS)": ("Morningside Heights", "Morningside Heights", "Columbia University"),
        "Murray Hill (MIDTOWN EAST (MIDTOWN))": ("Midtown", "Midtown East", "Murray Hill"),
        "Oaks (GATED COMMMUNITY) (BAY)": ("Bay", "Bay", "Oaks"),
        "PRIVATE COMMUNITY": ("Private Community", "Private Community", "Private Community"),
        ")A  (b)) c (": ("b", "c", "A"),
        "": ("", "", ""),
    }
    rows = spark.createDataFrame([(n,) for n in cases], "n string").select(name_levels("n").alias("l")).select("l.*")
    assert [tuple(r) for r in rows.collect()] == list(cases.values())


def test_closest():
    assert closest("koreatown", ["korea town", "chinatown"]) == "korea town"
    assert closest("west harlem", ["east harlem"]) is None
