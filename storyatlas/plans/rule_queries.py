"""More registered queries: the library's rules, sources and views applied to whole tables, with SQL oracles.

Importing this module adds them to the catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import text as X
from ..functions.filters import filter_condition, filter_counts
from ..operators import enrich as E
from ..operators import geometry as G
from ..operators import neighborhoods as N
from ..operators import relational as R
from ..operators.spatial import regions_at
from ..operators.union import united_areas, united_lines
from ..sources import files as S
from . import views as V
from .catalog import _areas, _boroughs, _entries, _points, _query, _regions, _table


def _pick(key: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


# ---- text rules --------------------------------------------------------------


@_query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE year(o_orderdate) END AS pub_year, year(o_orderdate) AS image_year
    FROM orders"""
)
def entry_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of dates, some of which are no dates, and of image paths."""
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")
    raw = F.when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("ca. "), date)).otherwise(date)
    url = F.concat(F.lit("https://host/images/"), F.year("o_orderdate").cast("string"), F.lit("/01/a.jpg"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", X.year_of(raw).alias("pub_year"), X.image_year(url).alias("image_year"))


@_query(
    """
    SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'By ' || c_name WHEN 1 THEN c_name ELSE NULL END AS byline, c_name AS dashed,
      CASE c_custkey % 2 WHEN 0 THEN '' ELSE 'Title: ' || c_mktsegment || chr(10) || chr(10) END || c_name AS entry_text,
      upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' NYC''s 5th MoMA Nyx' AS heading FROM customer"""
)
def bylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bylines, dashes before names, texts under their titles, and headings for display."""
    key, name = F.col("c_custkey"), F.col("c_name")
    raw = F.when(key % 3 == 0, F.concat(F.lit("By By "), name)).when(key % 3 == 1, F.concat(F.lit("By "), name)).otherwise("By ")
    title = F.when(key % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))
    heading = F.concat("c_mktsegment", F.lit(" NYC'S 5TH MOMA NYX"))
    return _table(spark, sf_dir, "customer").select("c_custkey", X.byline(raw).alias("byline"), X.strip_dashes(F.concat(F.lit(" — -"), name)).alias("dashed"), X.entry_text(title, name).alias("entry_text"), X.display_title(heading).alias("heading"))


@_query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE props END AS message FROM events")
def message_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object in a message, or else in its reasoning."""
    key, wrapped = F.col("event_id"), F.concat(F.lit("so: "), "props", F.lit("\nend"))
    return _table(spark, sf_dir, "events").select("event_id", X.json_object(F.when(key % 3 == 0, wrapped).otherwise("none"), F.when(key % 3 == 1, wrapped)).alias("message"))


@_query("SELECT event_id, CASE WHEN value <> 0 THEN value END AS lat, CASE WHEN value <> 0 THEN value + 1 END AS lon FROM events")
def coordinates_in_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates that stand somewhere in nested JSON."""
    inner = F.struct(F.lit("x").alias("name"), F.col("value").alias("theLatitude"), (F.col("value") + 1).cast("string").alias("LONGITUDE"))
    doc = F.to_json(F.struct(F.lit(1.5).alias("latitude"), F.array(F.struct(inner.alias("b"))).alias("areas")))
    rows = _table(spark, sf_dir, "events").select("event_id", E.coordinates_in(doc).alias("c"))
    return rows.select("event_id", "c.lat", "c.lon")


@_query(
    """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE p_brand END AS first,
      CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN p_brand ELSE p_brand || '; ' || p_type END AS joined,
      CASE p_partkey % 4 WHEN 3 THEN p_brand || '; ' || p_type WHEN 2 THEN p_brand ELSE '' END AS keywords FROM part"""
)
def list_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and joined items of lists that may be NULL or empty, and keyword values by name."""
    kind = F.col("p_partkey") % 4
    items = F.when(kind == 1, F.array().cast("array<string>")).when(kind == 2, F.array("p_brand")).when(kind == 3, F.array("p_brand", "p_type"))
    words = F.transform(F.concat(F.coalesce(items, F.array().cast("array<string>")), F.array(F.lit("other"))), lambda v: F.struct(F.when(v == "other", "Person").otherwise("Location").alias("name"), v.alias("value")))
    return _table(spark, sf_dir, "part").select("p_partkey", X.first_item(items).alias("first"), X.join_items(items).alias("joined"), X.keyword_values(words, "Location").alias("keywords"))


@_query(
    """
    SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS shouted, p_name AS plain FROM part"""
)
def shouted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in capitals get title case, others stay."""
    return _table(spark, sf_dir, "part").select("p_partkey", X.smart_case(F.upper("p_name")).alias("shouted"), X.smart_case("p_name").alias("plain"))


_ORD = "CASE WHEN n % 100 BETWEEN 10 AND 20 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END"


@_query(
    """
    WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderkey % 90 + 1 AS n FROM orders)
    SELECT o_orderkey,
      CASE k WHEN 0 THEN n || 'th Street BMT' WHEN 1 THEN 'Grand Central' WHEN 2 THEN 'Shop at ' || n || 'th Street' WHEN 3 THEN 'jfk' WHEN 4 THEN 'Second Avenue' ELSE 'Cafe in Rome' END AS place,
      CASE k WHEN 0 THEN n || 'th Street' WHEN 1 THEN 'Grand Central' WHEN 2 THEN 'Shop at ' || n || 'th Street' WHEN 3 THEN 'jfk' WHEN 4 THEN 'Second Avenue' ELSE 'Cafe in Rome' END AS core,
      CASE k WHEN 2 THEN n || 'th Street' END AS tail, k = 4 AS pinned, k IN (3, 4) AS is_fixed,
      CASE k WHEN 0 THEN 'station' WHEN 1 THEN 'station' WHEN 4 THEN 'bare_street' ELSE 'place' END AS category
    FROM o"""
)
def station_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations and other places: names without station words, tails, streets that are looked for in one borough, fixed names."""
    key = F.col("o_orderkey")
    n = (key % 90 + 1).cast("string")
    kinds = [F.concat(n, F.lit("th Street BMT station")), F.lit("Grand Central subway station"), F.concat(F.lit("Shop at "), n, F.lit("th Street")), F.lit("jfk"), F.lit("Second Avenue"), F.lit("Cafe in Rome")]
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*kinds), (key % 6 + 1).cast("int")).alias("q"))
    return rows.select("o_orderkey", P.strip_station("q").alias("place"), P.station_core("q").alias("core"), P.location_tail("q").alias("tail"), P.is_pinned_street("q").alias("pinned"), P.is_override("q").alias("is_fixed"), P.classify("q").alias("category"))


# ---- articles and entries ----------------------------------------------------


@_query(
    """
    WITH k AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders)
    SELECT k AS o_orderkey, k % 5 IN (0, 1, 4) AS has_kicker_tag, k % 3 = 0 AS title_has_phrase, k % 5 = 2 AS foreign_kicker, k % 12 = 0 AS is_meta_article, k % 7 = 0 AS is_correction,
      (k % 5 IN (0, 1, 4) OR k % 3 = 0) AND NOT k % 12 = 0 AND NOT k % 7 = 0 AND NOT k % 5 = 2 AS is_entry,
      year(d) AS pub_year, CASE k % 2 WHEN 0 THEN 'https://host/' || k || '.jpg' END AS image_url, 'Harlem; ' || k AS locations
    FROM k"""
)
def article_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article documents made of orders: derived columns, and which are entries."""
    k = F.col("o_orderkey")
    main = F.when(k % 12 == 0, "Best of Town Notes, 1999").when(k % 3 == 0, "The town notes of a day").otherwise("Other news")
    words = F.array(F.struct(F.lit("Location").alias("name"), F.lit("Harlem").alias("value")), F.struct(F.lit("Person").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("Location").alias("name"), k.cast("string").alias("value")))
    docs = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.struct(main.alias("main"), _pick(k, " Town Notes ", "TOWN NOTES", "Sports", "", "town notes").alias("kicker"), F.lit(None).cast("string").alias("print_headline")).alias("headline"),
        F.struct(F.lit("By A").alias("original")).alias("byline"), words.alias("keywords"),
        F.struct(F.when(k % 2 == 0, F.struct(F.concat(F.lit("https://host/"), k.cast("string"), F.lit(".jpg")).alias("url"))).alias("default"), F.lit(None).cast("struct<url:string>").alias("thumbnail"), F.lit("c").alias("caption"), F.lit(None).cast("string").alias("credit")).alias("multimedia"),
        F.when(k % 7 == 0, " Correction ").otherwise("News").alias("type_of_material"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("pub_date"),
    )
    return S.articles(docs, "Town Notes").select("o_orderkey", "has_kicker_tag", "title_has_phrase", "foreign_kicker", "is_meta_article", "is_correction", "is_entry", "pub_year", "image_url", "locations")


@_query(
    """
    SELECT o.o_orderkey::VARCHAR AS entry_id, o.o_custkey::VARCHAR AS uri, CASE WHEN c.c_custkey IS NOT NULL THEN least(c.c_name, 'Z' || c.c_custkey) END AS image_thumbnail_url,
      CASE WHEN o.o_orderkey % 3 = 0 THEN true END AS subway_mentioned, CASE WHEN o.o_orderkey % 4 = 0 THEN o.o_totalprice END AS lat
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_custkey % 2 = 0"""
)
def joined_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with articles (which repeat), entities, and points of which failed ones don't count."""
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    entries = orders.select(F.col("o_orderkey").cast("string").alias("entry_id"), F.col("o_custkey").cast("string").alias("uri"))
    uri = F.col("c_custkey").cast("string").alias("uri")
    articles = customer.select(uri, F.col("c_name").alias("image_thumbnail_url")).union(customer.select(uri, F.concat(F.lit("Z"), "c_custkey"))).union(customer.select(uri, F.lit(None).cast("string")))
    entities = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("entry_id"), F.lit(True).alias("subway_mentioned"), F.lit(None).cast("string").alias("error"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("query_raw", "string"), ("category", "string"))]
    more = [F.lit(None).cast(t).alias(c) for c, t in (("lon", "double"), ("source", "string"), ("confidence", "double"), ("low_confidence", "boolean"))]
    found = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("entry_id"), *blank, F.col("o_totalprice").alias("lat"), *more, F.when(F.col("o_orderkey") % 4 == 0, "ok").otherwise("unresolved").alias("status"))
    return V.joined_entries(entries, articles, entities, found).select("entry_id", "uri", "image_thumbnail_url", "subway_mentioned", "lat")


@_query(
    """
    SELECT c_custkey::VARCHAR AS entry_id, CASE WHEN c_custkey % 3 = 0 THEN 'unresolved' ELSE 'ok' END AS status,
      CASE WHEN c_custkey % 3 = 1 THEN -1.0 WHEN c_custkey % 3 = 2 THEN c_nationkey::DOUBLE END AS lat FROM customer"""
)
def cache_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries' locations, of which a cache knows some; only the rest is resolved."""
    customer, nation = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    kind = F.col("c_custkey") % 3
    name = F.when(kind == 0, F.concat(F.lit("Nowhere "), "c_custkey")).when(kind == 1, F.concat(F.lit("Known "), "c_nationkey")).otherwise(F.concat(F.lit("nation_"), "c_nationkey"))
    entities = customer.select(F.col("c_custkey").cast("string").alias("entry_id"), F.array(name).alias("specific_locations"), F.lit(True).alias("specific_location_mentioned"), F.lit(None).cast("string").alias("error"))
    places = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.col("n_name").alias("label"), F.lit("nominatim").alias("source"), F.lit(1.0).alias("confidence"), F.lit(True).alias("bounded"))
    known = nation.select(F.concat(F.lit("Known "), "n_nationkey").alias("query_raw"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("category", "string"), ("source", "string"), ("label", "string"), ("confidence", "double"))]
    cache = known.select(X.name_key("query_raw").alias("query_norm"), "query_raw", F.col("query_raw").alias("query"), F.lit(-1.0).alias("lat"), F.lit(0.0).alias("lon"), *none, F.lit(False).alias("low_confidence"), F.lit("ok").alias("status"))
    found, _ = E.geocode(entities, places, cache)
    return found.select("entry_id", "status", "lat")


@_query(
    """
    WITH n AS (SELECT n_name, n_nationkey AS k FROM nation)
    SELECT n_name, k % 4 AS kind, CASE k % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 WHEN 2 THEN NULL ELSE 9.0 END AS lat,
      k % 4 = 3 AS low_confidence FROM n"""
)
def routed_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings that several boroughs have, places that are unlike their query, and tails of tails."""
    k = F.col("n_nationkey")
    raw = F.when(k % 4 == 0, F.concat((k + 10).cast("string"), F.lit("th Street and Park"))).when(k % 4 == 1, F.concat((k + 50).cast("string"), F.lit("th Street and Madison")))
    raw = raw.when(k % 4 == 2, F.concat(F.lit("Zebra"), "n_name")).otherwise(F.concat(F.lit("Stall "), "n_name", F.lit(" at the shop in 9th Street and Second Avenue")))
    queries = _table(spark, sf_dir, "nation").select("n_name", (k % 4).alias("kind"), raw.alias("query_raw"), F.when(k % 4 == 0, F.array(F.lit("unknown"), F.lit("Astoria"))).alias("neighborhoods"))
    queries = queries.withColumn("query", P.clean_query("query_raw")).withColumn("query_norm", X.name_key("query"))
    crossing = lambda b, lat, text: F.struct(text.alias("name"), F.lit(lat).alias("lat"), F.lit("geoservice").alias("source"), text.alias("label"), F.lit(b).alias("borough"))
    one, two = F.concat((k + 10).cast("string"), F.lit("th Street & Park Avenue")), F.concat((k + 50).cast("string"), F.lit("th Street & Madison Avenue"))
    unlike = F.struct(F.concat(F.lit("Zebra"), "n_name").alias("name"), F.lit(5.0).alias("lat"), F.lit("geosearch").alias("source"), F.lit("Quite another thing, NY").alias("label"), F.lit(None).cast("string").alias("borough"))
    tail = crossing("Bronx", 9.0, F.lit("9th Street & Second Avenue"))
    found = [crossing("Manhattan", 2.0, one), crossing("Queens", 3.0, one), crossing("Bronx", 4.0, two), crossing("Brooklyn", 1.0, two), unlike, tail]
    places = _table(spark, sf_dir, "nation").select(F.inline(F.array(*found))).distinct().withColumns({"lon": F.lit(0.0), "confidence": F.lit(1.0), "bounded": F.lit(True)})
    got = E.resolve(queries, places, {"astoria": "Queens"})
    return queries.select("n_name", "kind", "query_norm").join(got, "query_norm").select("n_name", "kind", "lat", "low_confidence")


@_query(
    """
    WITH o AS (SELECT o_orderkey AS k, o_orderkey % 190 + 1 AS n FROM orders)
    SELECT k AS o_orderkey, CASE k % 6 WHEN 0 THEN 'intersection' ELSE 'place' END AS category,
      CASE k % 6 WHEN 0 THEN n WHEN 1 THEN k WHEN 2 THEN n WHEN 4 THEN -1 WHEN 5 THEN 40.76439744535597 END::DOUBLE AS lat,
      CASE k % 6 WHEN 3 THEN 'unresolved' ELSE 'ok' END AS status, k % 6 = 2 OR (k % 6 = 5 AND k % 4 = 1) AS low_confidence FROM o"""
)
def routed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location query for each order: crossings, places, tails within up to eleven tails, unknown places, aliases and fixed points."""
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 190 + 1).cast("string")
    own, street = F.concat(F.lit("Hall "), k.cast("string")), F.concat(n, F.lit("th Street"))
    nested = F.concat(F.repeat(F.lit("Booth in "), (k % 10 + 1).cast("int")), F.lit("the shop at "), street, F.lit(" and Park"))
    raw = F.when(k % 6 == 0, F.concat(street, F.lit(" and Park"))).when(k % 6 == 1, own).when(k % 6 == 2, nested).when(k % 6 == 3, F.concat(F.lit("Zebra "), k.cast("string")))
    raw = raw.when(k % 6 == 4, F.lit("JFK Airport")).otherwise(F.when(k % 4 == 1, F.lit("Stage in Studio 54")).otherwise(F.lit("Studio 54")))
    orders = _table(spark, sf_dir, "orders")
    queries = orders.select("o_orderkey", raw.alias("query_raw")).withColumn("query", P.clean_query("query_raw")).withColumn("query_norm", X.name_key("query"))
    place = lambda name, lat, source: F.struct(name.alias("name"), lat.cast("double").alias("lat"), F.lit(source).alias("source"), name.alias("label"))
    known = F.when(k % 6 == 1, place(own, k, "nominatim")).when(k % 6 == 4, place(F.lit("Kennedy Airport"), F.lit(-1), "nominatim")).otherwise(place(F.concat(street, F.lit(" & Park Avenue")), n, "geoservice"))
    places = orders.select(known.alias("p")).select("p.*").distinct().withColumns({"lon": F.lit(0.0), "confidence": F.lit(1.0), "bounded": F.lit(True)})
    got = E.resolve(queries, places)
    return queries.select("o_orderkey", "query_norm").join(got, "query_norm").select("o_orderkey", "category", "lat", "status", "low_confidence")


@_query(
    """
    SELECT doc_id::VARCHAR AS entry_id,
      contains(k, ' a train ') OR contains(k, ' r train ') AS subway_mentioned, contains(k, ' that was ') OR contains(k, ' of the ') AS specific_location_mentioned,
      contains(k, ' the ') OR contains(k, ' and ') AS neighborhood_mentioned, contains(k, ' queens ') AS borough_mentioned
    FROM (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) || ' ' AS k FROM documents)"""
)
def extracted_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by dictionary: what is mentioned; all records are done."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entry_id"), F.coalesce("text", F.lit("")).alias("text"))
    got = E.is_done(E.dictionary_extract(docs, ["A", "R"], ["the", "and"], ["Queens"], ["that was", "of the"]))
    return got.select("entry_id", "subway_mentioned", "specific_location_mentioned", "neighborhood_mentioned", "borough_mentioned")


# ---- samples, levels, geometry -----------------------------------------------


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('7:' || o_orderkey::VARCHAR), o_orderkey LIMIT 50")
def shuffled_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shuffled(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 7, 50)


@_query("SELECT s_suppkey, r_name AS admin_0, 'Nation_' || n_nationkey AS admin_1, s_name AS admin_2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def levels_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested names with a qualifier that is no level."""
    from ..operators.levels import name_levels

    name = F.concat("s_name", F.lit("  ("), F.upper("n_name"), F.lit(" ("), F.lower("r_name"), F.lit(")) (GATED COMMUNITY)"))
    rows = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("s_suppkey", name_levels(name).alias("l"), "r_name").select("s_suppkey", F.upper("l.admin_0").alias("admin_0"), "l.admin_1", "l.admin_2")


@_query(
    """
    SELECT n_name AS name, r_name AS admin_0, false AS is_admin_0_union, 1 AS n_rings FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT r_name, r_name, true, count(*)::INT FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def area_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of a map file and, for each top level, the union of its areas."""
    k = F.col("n_nationkey").cast("double")
    corner = lambda x, y: F.struct((k + x).alias("x"), (k + y).alias("y"))
    square = F.array(F.array(corner(0.0, 0.0), corner(0.5, 0.0), corner(0.5, 0.5), corner(0.0, 0.5), corner(0.0, 0.0)))
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    areas = N.named_areas(rows.select(F.concat(F.col("n_name"), F.lit(" x ("), F.lower("r_name"), F.lit(")")).alias("name"), square.alias("rings")))
    got = N.with_unions(areas)
    return got.select(F.regexp_replace("name", " x$", "").alias("_n"), F.upper("admin_0").alias("admin_0"), "is_admin_0_union", F.size("rings").alias("n_rings")).select(F.when(F.col("is_admin_0_union"), F.upper("_n")).otherwise(F.col("_n")).alias("name"), "admin_0", "is_admin_0_union", "n_rings")


_BOX = "c_custkey * 37 % 60 AS x, c_custkey * 91 % 53 AS y, 1 + c_custkey % 5 AS w, 1 + c_custkey % 7 AS h"


def _boxed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column, Column, Column]:
    """Customers, and the sides of a box on a grid for each: left, lower, right, upper."""
    k = F.col("c_custkey")
    x, y = (k * 37 % 60).cast("double"), (k * 91 % 53).cast("double")
    return _table(spark, sf_dir, "customer"), x, y, x + 1 + k % 5, y + 1 + k % 7


def _way(*corners: tuple[Column, Column]) -> Column:
    return F.array(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners)))


def _length(paths: str) -> Column:
    size = lambda e: F.sqrt((e["x1"] - e["x0"]) * (e["x1"] - e["x0"]) + (e["y1"] - e["y0"]) * (e["y1"] - e["y0"]))
    return F.round(F.aggregate(G.ring_edges(F.col(paths)), F.lit(0.0), lambda a, e: a + size(e)), 6)


@_query(
    f"""
    WITH r AS (SELECT c_nationkey, {_BOX} FROM customer),
    c AS (SELECT DISTINCT c_nationkey, x + i AS x, y + j AS y FROM r, range(5) AS t(i), range(7) AS u(j) WHERE i < w AND j < h),
    n AS (SELECT c_nationkey, count(*) AS n FROM c GROUP BY 1),
    j AS (SELECT a.c_nationkey, count(*) AS n FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1) GROUP BY 1)
    SELECT n.c_nationkey, n.n::DOUBLE AS area, (4 * n.n - 2 * coalesce(j.n, 0))::DOUBLE AS outline FROM n LEFT JOIN j ON n.c_nationkey = j.c_nationkey"""
)
def united_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of each nation's customers, which touch, overlap and hold one another, as one area: its size, holes taken off, and outline."""
    customers, x, y, right, top = _boxed(spark, sf_dir)
    box = _way((x, y), (right, y), (right, top), (x, top), (x, y))
    got = united_areas(customers.select("c_nationkey", box.alias("rings")), "c_nationkey", "rings")
    area = F.aggregate(G.ring_edges(F.col("rings")), F.lit(0.0), lambda a, e: a + (e["x0"] * e["y1"] - e["y0"] * e["x1"]) / 2)
    return got.select("c_nationkey", F.round(area, 6).alias("area"), _length("rings").alias("outline"))


@_query(
    f"""
    WITH r AS (SELECT c_nationkey, {_BOX} FROM customer),
    s AS (SELECT c_nationkey, x + i AS x, y, 'level' AS way FROM r, range(5) AS t(i) WHERE i < w UNION SELECT c_nationkey, x + w, y + j, 'upright' FROM r, range(7) AS u(j) WHERE j < h)
    SELECT c_nationkey, count(*)::DOUBLE AS length FROM s GROUP BY 1"""
)
def united_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bent ways of each nation's customers as one network: its length, with common stretches once."""
    customers, x, y, right, top = _boxed(spark, sf_dir)
    got = united_lines(customers.select("c_nationkey", _way((x, y), (right, y), (right, top)).alias("paths")), "c_nationkey", "paths")
    return got.select("c_nationkey", _length("paths").alias("length"))


@_query(
    f"""
    WITH r AS (SELECT c_custkey, {_BOX} FROM customer),
    s AS (SELECT c_custkey, x AS x0, y AS y0, x + w AS x1, y AS y1 FROM r UNION ALL SELECT c_custkey, x + w, y, x + w, y + h FROM r),
    b AS (SELECT n_nationkey, n_nationkey * 13 % 50 AS l, n_nationkey * 29 % 50 AS d, n_nationkey * 13 % 50 + 6 + n_nationkey % 9 AS r, n_nationkey * 29 % 50 + 5 + n_nationkey % 7 AS u FROM nation),
    c AS (SELECT c_custkey, n_nationkey, CASE WHEN y0 = y1 AND y0 >= d AND y0 < u THEN least(x1, r) - greatest(x0, l) WHEN x0 = x1 AND x0 >= l AND x0 < r THEN least(y1, u) - greatest(y0, d) END AS n FROM s, b)
    SELECT c_custkey, n_nationkey, sum(n)::DOUBLE AS length FROM c WHERE n > 0 GROUP BY 1, 2"""
)
def clipped_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each customer's way lies in the box of each nation, also along its edges."""
    customers, x, y, right, top = _boxed(spark, sf_dir)
    k = F.col("n_nationkey")
    l, d = (k * 13 % 50).cast("double"), (k * 29 % 50).cast("double")  # noqa: E741
    r, u = l + 6 + k % 9, d + 5 + k % 7
    boxes = _table(spark, sf_dir, "nation").select("n_nationkey", _way((l, d), (r, d), (r, u), (l, u), (l, d)).alias("rings"))
    cut = G.clipped_lines(customers.select("c_custkey", _way((x, y), (right, y), (right, top)).alias("paths")), "c_custkey", "paths", boxes, "n_nationkey", "rings")
    return cut.select("c_custkey", "n_nationkey", _length("paths").alias("length"))


@_query("SELECT c_custkey, (['A', 'B', 'C', 'D', 'unknown'])[c_nationkey % 5 + 1] AS name, c_nationkey % 5 < 4 AS inside FROM customer")
def sampled_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points drawn from regions lie inside them; an unknown region has none."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", _pick(F.col("c_nationkey"), "A", "B", "C", "D", "unknown").alias("name"))
    placed = G.points_in_regions(rows, "name", G.region_pieces(_regions(spark), "name", "rings"), "p", 7, F.col("c_custkey")).join(F.broadcast(_regions(spark)), "name", "left")  # four rows
    return placed.select("c_custkey", "name", F.coalesce(G.inside(F.col("p.x"), F.col("p.y"), F.col("rings")), F.lit(False)).alias("inside"))


@_query("SELECT c_custkey AS entry_id, count(*) OVER (PARTITION BY c_nationkey) > 1 AS moved, true AS near FROM customer")
def fanned_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that share a place are moved, by at most the radius; single ones stay."""
    x, y = F.lit(-74.0) + F.col("c_nationkey") / 100, F.lit(40.7) + F.col("c_nationkey") / 200
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_id"), x.alias("x"), y.alias("y"), x.alias("x0"), y.alias("y0"))
    dx, dy = (F.col("x") - F.col("x0")) * G.METRES_A_DEGREE * F.cos(F.radians("y0")), (F.col("y") - F.col("y0")) * G.METRES_A_DEGREE
    moved = (F.col("x") != F.col("x0")) | (F.col("y") != F.col("y0"))
    return G.spread_coincident(rows, "x", "y", "entry_id").select("entry_id", moved.alias("moved"), (F.sqrt(dx * dx + dy * dy) <= 120.5).alias("near"))


@_query(
    """
    SELECT event_id, (x < 15 AND y < 15 AND NOT (x > 10 AND y > 10) AND NOT (x > 2 AND x < 5 AND y > 2 AND y < 5))::INT AS n_inside
    FROM (SELECT event_id, (event_id * 37 % 2000) / 100.0 + 0.003 AS x, (event_id * 91 % 2000) / 100.0 + 0.003 AS y FROM events)"""
)
def points_in_concave_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in an angular region with a corner cut out and a hole."""
    corner = [(0.0, 0.0), (15.0, 0.0), (15.0, 10.0), (10.0, 10.0), (10.0, 15.0), (0.0, 15.0), (0.0, 0.0)]
    hole = [(2.0, 2.0), (5.0, 2.0), (5.0, 5.0), (2.0, 5.0), (2.0, 2.0)]
    area = spark.createDataFrame([("L", [corner, hole])], f"name string, rings {G.RINGS}")
    points = _points(spark, sf_dir)
    held = regions_at(points, "x", "y", area, "name", "rings").select("event_id", F.lit(1).alias("_in"))
    return points.select("event_id").join(held, "event_id", "left").select("event_id", F.coalesce("_in", F.lit(0)).alias("n_inside"))


# ---- views -------------------------------------------------------------------

_TIERS = """k AS (SELECT o_orderkey AS k FROM orders),
    t AS (SELECT k, CASE WHEN k % 22 = 0 THEN 'area:A' WHEN k % 2 = 0 THEN 'specific' WHEN k % 5 = 0 THEN 'neighborhood' WHEN k % 3 = 0 THEN 'borough' END AS placement FROM k)"""


def _finest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.areas_view(V.area_positions(_entries(spark, sf_dir), _regions(spark), 3), _areas(spark), _boroughs(spark), 3)


_DATED = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 1 THEN year(o_orderdate) END AS pub_year, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 500000 END AS confidence,
      CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS kind FROM orders"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries, of which some lack a year, a confidence or a kind."""
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 != 1, F.year("o_orderdate")).alias("pub_year"), F.when(k % 3 != 0, F.col("o_totalprice") / 500000).alias("confidence"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("kind"))


@_query(
    f"""
    SELECT o_orderkey FROM ({_DATED}) WHERE (coalesce(confidence, 1) >= 0.3 AND coalesce(pub_year, 0) >= 1994 AND coalesce(pub_year, 9999) <= 1997)
      OR (coalesce(kind IN ('1-URGENT', '5-LOW'), false) AND NOT coalesce(pub_year < 1996, false)) OR (kind IS NULL AND pub_year IS NULL)
      OR (CASE WHEN confidence IS NULL THEN 'none' WHEN coalesce(confidence < 0.05, false) THEN 'low' ELSE kind END) IS NOT DISTINCT FROM 'low'"""
)
def tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a filter of nested arrays shows, where what is missing is told apart."""
    rows = _dated(spark, sf_dir)
    get = lambda n: ["get", n]
    tree = ["any", V.shown_tree(1994, 1997, 0.3), ["all", ["in", get("kind"), ["literal", ["1-URGENT", "5-LOW"]]], ["!", ["<", get("pub_year"), 1996]]]]
    tree += [["all", ["==", get("kind"), None], ["!", ["has", "pub_year"]]], ["==", ["case", ["!", ["has", "confidence"]], "none", ["<", get("confidence"), 0.05], "low", get("kind")], "low"]]
    return rows.where(filter_condition(tree, rows.schema)).select("o_orderkey")


@_query(
    f"""
    SELECT y::VARCHAR || ' ' || c::VARCHAR AS name, (SELECT count(*) FROM ({_DATED}) WHERE pub_year BETWEEN y AND y + 1 AND coalesce(confidence, 1) >= c / 10.0) AS n
    FROM range(1992, 2000) AS t(y), range(0, 10, 3) AS u(c)"""
)
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries each setting of the filters shows; those without a year are hidden."""
    return filter_counts(_dated(spark, sf_dir), {f"{y} {c}": V.shown_tree(y, y + 1, c / 10) for y in range(1992, 2000) for c in range(0, 10, 3)})


@_query(
    f"""
    WITH {_TIERS}
    SELECT 'all' AS view, count(*) AS n FROM t WHERE placement IS NOT NULL
    UNION ALL SELECT 'place', count(*) FROM t WHERE placement IN ('specific', 'area:A')
    UNION ALL SELECT 'subway', 0
    UNION ALL SELECT 'neighborhood', count(*) FROM t WHERE placement IN ('neighborhood', 'borough')
    UNION ALL SELECT 'skipped', count(*) FROM t WHERE placement IS NULL AND k % 11 = 7"""
)
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries each view of the map shows, and how many name a neighborhood and have no place."""
    placed = _finest(spark, sf_dir).select("placement", "neighborhoods")
    one = placed.agg(*(F.count_if(F.col("placement").isNotNull() & F.expr(V.view_tier("placement", v))).alias(v) for v in ("all", "place", "subway", "neighborhood")), F.count_if(F.col("placement").isNull() & (F.size("neighborhoods") > 0)).alias("skipped"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("view"), F.col(c).alias("n")) for c in one.columns))).alias("_v")).select("_v.*")


@_query(
    f"""
    WITH {_TIERS}
    SELECT k::VARCHAR AS entry_id, placement, CASE placement WHEN 'specific' THEN 'Place ' || k WHEN 'area:A' THEN 'A' WHEN 'borough' THEN 'Somewhere in Queens'
      ELSE 'Somewhere in ' || (['A', 'B', 'C', 'D'])[k % 4 + 1] END AS place_label,
      CASE WHEN k % 3 = 0 THEN 'Queens' END AS borough, CASE WHEN k % 2 = 0 THEN round(40.7 + k % 97 / 100.0, 6) END AS spec_lat
    FROM t WHERE placement IS NOT NULL"""
)
def feature_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of the features of the finest view."""
    placed = _finest(spark, sf_dir).where("placement IS NOT NULL")
    f = placed.select(V.feature(F.col("x"), F.col("y"), F.col("placement")).alias("f"))
    return f.select("f.properties.entry_id", "f.properties.placement", "f.properties.place_label", "f.properties.borough", "f.properties.spec_lat")


@_query(
    f"""
    WITH {_TIERS}
    SELECT k::VARCHAR AS entry_id, placement, round(40.7 + k % 97 / 100.0, 4) AS lat FROM t WHERE k % 2 = 0"""
)
def located_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of entries that have a point of their own."""
    view = V.locations_view(V.area_positions(_entries(spark, sf_dir), _regions(spark), 3))
    return view.select("entry_id", "placement", F.round("lat", 4).alias("lat"))


@_query(
    """
    SELECT o_orderkey::VARCHAR AS entry_id, 'subway:R' AS placement, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'Queens' END AS borough_name,
      CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'On the R train in Queens' ELSE 'On the R train' END AS label, true AS on_line FROM orders WHERE o_orderkey % 7 = 0"""
)
def subway_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries on a line: the stated or learned borough, and a point on the line's part in it."""
    line = spark.createDataFrame([("r", [[(0.0, 12.0), (15.0, 12.0)], [(15.0, 12.0), (15.0, 5.0)]]), ("q", [[(3.0, 3.0), (3.0, 9.0)]])], f"service string, paths {G.RINGS}")
    placed = V.subway_view(_entries(spark, sf_dir), line, _boroughs(spark), 3)
    x, y = F.round("x", 9), F.round("y", 9)
    anywhere = ((y == 12) & x.between(0, 15)) | ((x == 15) & y.between(5, 12))
    return placed.select("entry_id", "placement", "borough_name", V.place_label(F.col("placement")).alias("label"), F.when(F.col("borough_name").isNull(), anywhere).otherwise(anywhere & x.between(10, 20) & y.between(10, 20)).alias("on_line"))


@_query("SELECT 'Queens' AS borough, lower(n) AS nbhd FROM (SELECT unnest(['A', 'B', 'C', 'D']) AS n)")
def boroughs_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The borough that stands beside each neighborhood most often."""
    return V.learned_boroughs(_entries(spark, sf_dir))


@_query("SELECT 'line ' || lower(r_name) AS service, r_name AS service_name, count(*)::INT AS n_paths FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def network_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One basemap feature for each service, of all its paths."""
    k = F.col("n_nationkey").cast("double")
    path = F.array(F.array(F.struct(k.alias("x"), F.lit(0.123456789).alias("y")), F.struct((k + 1).alias("x"), F.lit(1.0).alias("y"))))
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = rows.select(F.concat(F.lit("line "), F.lower("r_name")).alias("service"), F.col("r_name").alias("service_name"), path.alias("rings"))
    shapes = V.shapes(V.network_lines(lines), ["service", "service_name"], kind="MultiLineString")
    return shapes.select("service", "service_name", F.size("feature.geometry.coordinates").alias("n_paths"))
