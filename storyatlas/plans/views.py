"""Map views: where each entry is placed, and how views are filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import borough_phrase, canonical_borough
from ..functions.text import first_item, join_items, name_key
from ..operators.geometry import clipped_lines, point_on_line, points_in_regions, region_pieces, rounded, spread_coincident, uniform
from ..operators.relational import keep_first, modal_value
from ..operators.similarity import fuzzy_match
from ..operators.union import united_lines
from ..sources.files import feature_collection, settled

DIGITS = 6


def joined_entries(entries: DataFrame, articles: DataFrame, entities: DataFrame, geocoded: DataFrame) -> DataFrame:
    """Entries with their article, entities and resolved point.

    Articles are made unique first, so that no entry is repeated; the filter on
    the right side stays below the join.
    """
    meta = keep_first(articles.select("uri", "image_thumbnail_url"), ["uri"], [F.col("image_thumbnail_url").asc_nulls_last()])
    found = geocoded.where("status = 'ok'").select("entry_id", "query_raw", "category", "lat", "lon", "source", "confidence", "low_confidence")
    extra = [c for c in entities.columns if c not in ("entry_id", "uri", "author", "title", "error")]
    return entries.join(meta, "uri", "left").join(entities.select("entry_id", *extra), "entry_id", "left").join(found, "entry_id", "left")


def learned_boroughs(rows: DataFrame) -> DataFrame:
    """nbhd, borough: the borough that most often stands beside a neighborhood, of equals the first by name."""
    pairs = rows.select("neighborhoods", F.explode("boroughs").alias("_b")).withColumn("borough", canonical_borough("_b")).where("borough IS NOT NULL")
    return modal_value(pairs.select(F.explode("neighborhoods").alias("_n"), "borough").select(name_key("_n").alias("nbhd"), "borough"), "nbhd", "borough")


def with_borough(rows: DataFrame, regions: DataFrame, learned: DataFrame) -> DataFrame:
    """``borough_name``: of the stated boroughs the first known, else the first learned from a neighborhood."""
    known = regions.select(F.col("name").alias("borough_name")).distinct()
    stated = rows.select("entry_id", F.posexplode("boroughs").alias("_p", "_b")).select("entry_id", F.lit(0).alias("_t"), "_p", canonical_borough("_b").alias("borough_name"))
    guessed = rows.select("entry_id", F.posexplode("neighborhoods").alias("_p", "_n")).withColumn("nbhd", name_key("_n")).join(learned, "nbhd").select("entry_id", F.lit(1).alias("_t"), "_p", F.col("borough").alias("borough_name"))
    best = stated.unionByName(guessed).join(known, "borough_name").groupBy("entry_id").agg(F.min_by("borough_name", F.struct("_t", "_p")).alias("borough_name"))
    return rows.join(best, "entry_id", "left")


def with_neighborhood(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """``nbhd_name``: of the entry's neighborhoods the first that matches.

    ``areas`` (key, name, broad, rings): a name is looked for exactly among
    specific areas, then among broad ones, then by likeness in the same order.
    """
    # looked at once for each tier, so written once; only names without an exact match are compared
    names = settled(rows.select("entry_id", F.posexplode("neighborhoods").alias("_p", "_n")).withColumn("key", name_key("_n")).where("key <> ''").drop("_n"))
    distinct = names.select("key").distinct()
    exact = distinct.join(areas.groupBy("key").agg(F.min("broad").alias("broad")), "key")  # a specific area comes first
    tiers = exact.select("key", F.col("key").alias("match"), "broad")
    rest = settled(distinct.join(exact, "key", "left_anti"))
    if not rest.isEmpty():
        for broad in (False, True):
            hit = settled(fuzzy_match(rest, "key", areas.where(F.col("broad") == broad).select("key"), "key").where("match IS NOT NULL"))
            tiers = tiers.unionByName(hit.withColumn("broad", F.lit(broad)))
            rest = rest.join(hit, "key", "left_anti")
    best = names.join(tiers, "key").groupBy("entry_id").agg(F.min_by(F.struct("match", "broad"), "_p").alias("_m"))
    titles = areas.select(F.col("key").alias("_k"), F.col("broad").alias("_b"), F.col("name").alias("nbhd_name"))
    best = best.join(titles, (F.col("_m.match") == F.col("_k")) & (F.col("_m.broad") == F.col("_b"))).select("entry_id", "nbhd_name")
    return rows.join(best, "entry_id", "left")


def place_label(placement: Column) -> Column:
    """What a popup says about where a point was put."""
    where = F.substring_index(placement, ":", -1)
    train = F.when(where == "network", "On the subway").otherwise(F.concat(F.lit("On the "), where, F.lit(" train")))
    return (
        F.when(placement == "specific", F.coalesce(first_item("specific_locations"), F.col("query_raw")))
        .when(placement.startswith("area:"), where)
        .when(placement.startswith("subway:"), F.concat(train, F.coalesce(F.concat(F.lit(" in "), borough_phrase("borough_name")), F.lit(""))))
        .when(placement == "neighborhood", F.concat(F.lit("Somewhere in "), F.col("nbhd_name")))
        .when(placement == "borough", F.concat(F.lit("Somewhere in "), borough_phrase("borough_name")))
    )


def feature(x: Column, y: Column, placement: Column) -> Column:
    """A GeoJSON point feature; NULL properties stay, as readers expect them."""
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.round(x, DIGITS), F.round(y, DIGITS)).alias("coordinates")).alias("geometry"),
        F.struct(
            "entry_id", "title", "author", "pub_year", "web_url",
            join_items("boroughs").alias("borough"), join_items("neighborhoods").alias("neighborhood"),
            join_items("subway_lines").alias("subway_line"), join_items("specific_locations").alias("specific_location"),
            F.round("lat", DIGITS).alias("spec_lat"), F.round("lon", DIGITS).alias("spec_lon"),
            F.round("confidence", DIGITS).alias("confidence"), "low_confidence",
            F.col("source").alias("geocode_source"), F.col("category").alias("geocode_category"),
            placement.alias("placement"), place_label(placement).alias("place_label"),
        ).alias("properties"),
    )


def area_positions(rows: DataFrame, areas: DataFrame, seed: int) -> DataFrame:
    """Entries whose location names an area: a place inside it, the same in every view."""
    keys = areas.select(F.lower(F.trim("name")).alias("_a"), F.col("name").alias("area_name"))
    named = rows.join(keys, F.lower(F.trim("query_raw")) == F.col("_a"), "left").drop("_a")
    return points_in_regions(named, "area_name", region_pieces(areas.withColumnRenamed("name", "area_name"), "area_name", "rings"), "_area", seed, F.col("entry_id"))


def _exact(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"x": F.coalesce("_area.x", "lon"), "y": F.coalesce("_area.y", "lat"), "placement": F.when(F.col("_area").isNotNull(), F.concat(F.lit("area:"), "area_name")).otherwise("specific")})


def locations_view(rows: DataFrame) -> DataFrame:
    """Entries with a point of their own (``rows`` from ``area_positions``), coincident ones fanned out."""
    return spread_coincident(_exact(rows.where("lat IS NOT NULL AND lon IS NOT NULL")), "x", "y", "entry_id")


def subway_view(rows: DataFrame, lines: DataFrame, boroughs: DataFrame, seed: int) -> DataFrame:
    """Entries that mention the subway, on their first known line or else anywhere on the network.

    ``lines``: service, paths; ``boroughs``: name, rings.  A line is clipped to the entry's borough if it enters it.
    """
    lines = lines.select(F.upper("service").alias("service"), "paths").where("service IS NOT NULL")
    # a stretch that several paths or lines share is as likely as any other
    lines = settled(united_lines(lines.unionByName(lines.select(F.lit("network").alias("service"), "paths")), "service", "paths"))
    wanted = rows.where("subway_mentioned")
    first = wanted.select("entry_id", F.posexplode("subway_lines").alias("_p", "_l")).withColumn("service", F.upper("_l")).join(lines.where("service <> 'network'").select("service"), "service")
    first = first.groupBy("entry_id").agg(F.min_by("service", "_p").alias("service"))
    named = wanted.join(first, "entry_id", "left").withColumn("service", F.coalesce("service", F.lit("network")))
    # a line is clipped once for each borough, not once for each entry; it stays whole where it does not enter
    inside = clipped_lines(lines, "service", "paths", boroughs.withColumnRenamed("name", "borough_name"), "borough_name", "rings").withColumnRenamed("paths", "_inside")
    used = named.select("service", "borough_name").distinct().join(lines, "service").join(inside, ["service", "borough_name"], "left")
    cut = used.select("service", F.col("borough_name").alias("_b"), F.coalesce("_inside", "paths").alias("paths"))
    placed = named.join(cut, (named["service"] == cut["service"]) & named["borough_name"].eqNullSafe(cut["_b"])).drop(cut["service"])
    point = point_on_line(F.col("paths"), uniform(seed, F.col("entry_id"), F.lit("line")))
    return placed.withColumn("_p", point).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y"), "placement": F.concat(F.lit("subway:"), "service")})


def areas_view(rows: DataFrame, areas: DataFrame, boroughs: DataFrame, seed: int) -> DataFrame:
    """Each entry at the finest place it has: its own, else its neighborhood, else its borough; NULL placement without.

    ``areas`` and ``boroughs`` (name, rings) hold the shapes of ``nbhd_name`` and ``borough_name``.
    """
    placed = _exact(rows)
    for shapes, name, point in ((areas, "nbhd_name", "_hood"), (boroughs, "borough_name", "_boro")):
        pieces = region_pieces(shapes.withColumnRenamed("name", name), name, "rings")
        placed = points_in_regions(placed, name, pieces, point, seed, F.col("entry_id"), F.lit(name))
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    hood, boro = F.col("_hood").isNotNull(), F.col("_boro").isNotNull()
    pick = lambda c: F.when(own, F.col(c)).when(hood, F.col(f"_hood.{c}")).when(boro, F.col(f"_boro.{c}"))
    where = F.when(own, F.col("placement")).when(hood, "neighborhood").when(boro, "borough")
    return spread_coincident(placed.withColumns({"x": pick("x"), "y": pick("y"), "placement": where}).drop("_hood", "_boro"), "x", "y", "entry_id")


def shapes(df: DataFrame, properties: list[str], digits: int = 5, kind: str = "MultiPolygon") -> DataFrame:
    """Basemap features: the given properties, and the shapes with rounded corners; ``kind`` MultiPolygon or MultiLineString."""
    corners = rounded(F.col("rings"), digits)
    coordinates = F.transform(corners, lambda ring: F.array(ring)) if kind == "MultiPolygon" else corners
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return df.select(*properties, F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")).alias("feature"))


def network_lines(lines: DataFrame) -> DataFrame:
    """One row per service of ``lines`` (service, service_name, rings): its paths united, and its first name."""
    names = lines.groupBy("service").agg(F.min("service_name").alias("service_name"))
    return united_lines(lines, "service", "rings").join(names, "service")


def publish(rows: DataFrame, areas: DataFrame, boroughs: DataFrame, lines: DataFrame, folder: str, seed: int = 0) -> dict[str, int]:
    """Write the three views and the two basemaps as GeoJSON files to ``folder``; how many features each has, and what was skipped.

    ``rows``: entries with borough_name and nbhd_name; ``areas`` and ``boroughs``: name, rings; ``lines``: service, service_name, rings.
    """
    placed = area_positions(rows, areas, seed)
    paths = lines.select("service", F.col("rings").alias("paths"))
    finest = areas_view(placed, areas, boroughs, seed)
    views = {"locations": locations_view(placed), "subway": spread_coincident(subway_view(placed, paths, boroughs, seed), "x", "y", "entry_id"), "areas": finest.where("placement IS NOT NULL")}
    written = {}
    for name, view in views.items():
        features = view.select("entry_id", feature(F.col("x"), F.col("y"), F.col("placement")).alias("feature"))
        written[name] = feature_collection(features, f"{folder}/{name}.geojson", order=["entry_id"])
    for name, df, properties, kind in (("boroughs", boroughs, ["name"], "MultiPolygon"), ("lines", network_lines(lines), ["service", "service_name"], "MultiLineString")):
        written[f"basemap_{name}"] = feature_collection(shapes(df, properties, kind=kind), f"{folder}/basemap_{name}.geojson", order=properties[:1])
    return written | {"skipped": skipped(finest).first()[0]}


def skipped(placed: DataFrame) -> DataFrame:
    """How many entries name a neighborhood and land nowhere."""
    return placed.agg(F.count_if(F.col("placement").isNull() & (F.size("neighborhoods") > 0)).alias("skipped"))


# ---- interactive filters -----------------------------------------------------
def view_tier(placement: str, view: str) -> str:
    """The condition on ``placement`` of a view: all, place, subway or neighborhood."""
    return {
        "all": "true",
        "place": f"{placement} = 'specific' OR {placement} LIKE 'area:%'",
        "subway": f"{placement} LIKE 'subway:%'",
        "neighborhood": f"{placement} IN ('neighborhood', 'borough')",
    }[view]


def year_and_confidence(low: int, high: int, least: float) -> str:
    """What the map shows: a missing confidence counts as full, a missing year as out of range."""
    return f"coalesce(confidence, 1) >= {least} AND coalesce(pub_year, 0) >= {low} AND coalesce(pub_year, 9999) <= {high}"


def shown_tree(low: int, high: int, least: float) -> list:
    """The same as a tree for ``filters.filter_condition``."""
    year = lambda missing: ["coalesce", ["get", "pub_year"], missing]
    return ["all", [">=", ["coalesce", ["get", "confidence"], 1], least], [">=", year(0), low], ["<=", year(9999), high]]


def year_bounds(df: DataFrame, year: str = "pub_year") -> DataFrame:
    """How many rows there are, and the first and last year; missing years don't count for these."""
    return df.agg(F.count("*").alias("n"), F.min(year).alias("first"), F.max(year).alias("last"))


def shown(ids: list[DataFrame], table: DataFrame, column: str) -> DataFrame:
    """Rows of ``table`` (entry_id, column) whose entry is in any view and whose column is not empty."""
    all_ids = ids[0].select("entry_id")
    for more in ids[1:]:
        all_ids = all_ids.union(more.select("entry_id"))
    return table.where(F.coalesce(F.col(column), F.lit("")) != "").join(all_ids.distinct(), "entry_id", "left_semi").select("entry_id", column)
