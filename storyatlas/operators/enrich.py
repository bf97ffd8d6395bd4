"""Enrichment through pluggable functions, resumable and with errors as data.

Extractors give a record for each entry, resolvers a point for each distinct
query.  The ones shipped work offline: a dictionary extractor and a gazetteer.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions.text import name_key
from .similarity import guarded

ENTITY_FIELDS = {
    "subway_mentioned": "boolean", "subway_lines": "array<string>",
    "specific_location_mentioned": "boolean", "specific_locations": "array<string>",
    "neighborhood_mentioned": "boolean", "neighborhoods": "array<string>",
    "borough_mentioned": "boolean", "boroughs": "array<string>",
}
#: Each opens a tail of a query.
TAIL_WORD = r"(?i)\b(?:at|on|in)\s"
ENTITY_SCHEMA = "entry_id string, " + ", ".join(f"{k} {v}" for k, v in ENTITY_FIELDS.items()) + ", error string"


def is_done(df: DataFrame) -> DataFrame:
    """Rows that need no further pass: no error, and all fields of the present schema."""
    return df.where("error IS NULL AND borough_mentioned IS NOT NULL")


def drop_known(items: Column, known: list[str]) -> Column:
    """At most one item, of those that are no known names."""
    return F.slice(F.filter(items, lambda x: ~F.lower(x).isin([k.lower() for k in known])), 1, 1)


def extract(entries: DataFrame, call: Callable[[str], dict], known: list[str] = ()) -> DataFrame:
    """Run ``call`` on the text of each entry (entry_id, text); a failure is a row with ``error``."""
    fields = list(ENTITY_FIELDS)

    def one(entry_id: str, text: str) -> dict:
        try:
            got = call(text)
            if set(got) != set(fields):
                raise ValueError(f"fields {sorted(got)}")
            return {"entry_id": entry_id, **got, "error": None}
        except Exception as e:  # what a caller's function raises is a result here
            return {"entry_id": entry_id, **dict.fromkeys(fields), "error": f"{type(e).__name__}: {e}"}

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(i, t) for i, t in zip(frame["entry_id"], frame["text"], strict=True)], columns=["entry_id", *fields, "error"])

    got = entries.select("entry_id", "text").mapInPandas(batch, ENTITY_SCHEMA)
    places = drop_known(F.col("specific_locations"), list(known))
    return got.withColumns({"specific_locations": F.when(F.col("error").isNull(), places), "specific_location_mentioned": F.when(F.col("error").isNull(), F.size(places) > 0)})


def dictionary_extract(entries: DataFrame, lines: list[str], neighborhoods: list[str], boroughs: list[str], places: list[str]) -> DataFrame:
    """The offline extractor: names of the dictionaries that stand in the text as words.  JVM-side."""
    text = F.concat(F.lit(" "), name_key("text"), F.lit(" "))
    find = lambda names: F.filter(F.array(*map(F.lit, names)).cast("array<string>"), lambda n: text.contains(F.concat(F.lit(" "), name_key(n), F.lit(" "))))
    train = F.filter(F.array(*map(F.lit, lines)).cast("array<string>"), lambda n: text.contains(F.concat(F.lit(" "), F.lower(n), F.lit(" train "))))
    spot = F.slice(find(places), 1, 1)
    return entries.select(
        "entry_id",
        (F.size(train) > 0).alias("subway_mentioned"), train.alias("subway_lines"),
        (F.size(spot) > 0).alias("specific_location_mentioned"), spot.alias("specific_locations"),
        (F.size(find(neighborhoods)) > 0).alias("neighborhood_mentioned"), find(neighborhoods).alias("neighborhoods"),
        (F.size(find(boroughs)) > 0).alias("borough_mentioned"), find(boroughs).alias("boroughs"),
        F.lit(None).cast("string").alias("error"),
    )


def queries_of(entities: DataFrame) -> DataFrame:
    """entry_id, neighborhoods, query_raw, query, query_norm for entries with a location."""
    rows = entities.where("specific_location_mentioned AND error IS NULL").withColumn("query_raw", P.pick_query("specific_locations"))
    rows = rows.where("query_raw IS NOT NULL").withColumn("query", P.clean_query("query_raw"))
    return rows.withColumn("query_norm", name_key("query"))


def _fenced(df: DataFrame) -> DataFrame:
    """``df`` behind a one-row generator, so that long rules are computed once and not inlined into one another."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def with_attempts(rows: DataFrame) -> DataFrame:
    """``rows`` (query) with ``category``, ``attempts`` and ``tail``.

    Attempts are ordered structs (kind, text, low, covers): kind is crossing (two streets joined by " & "),
    name, or bounded (one borough only); ``covers`` is what a found label should name.  ``tail`` is a
    location at the query's end, to be routed as a query of its own when all attempts fail.
    """
    def attempt(kind: str, text: Column, low: bool, covers: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(low).alias("low"), covers.alias("covers"))

    def facts(q: Column) -> Column:
        return F.struct(
            q.alias("q"), P.classify(q).alias("category"), P.station_core(q).alias("core"), P.location_tail(q).alias("tail"), P.street_pair(q)["one"].alias("first"),
            P.is_pinned_street(q).alias("pinned"), P.crossing_streets(q).alias("pair"), P.digit_ordinals(q).alias("digits"),
        )

    def of_core(f: Column) -> Column:
        return F.struct(f.alias("f"), P.classify(f["core"]).alias("kind"), P.crossing_streets(f["core"]).alias("pair"))

    def ways(x: Column) -> Column:
        f, q, core = x["f"], x["f"]["q"], x["f"]["core"]
        crossing = lambda pair: attempt("crossing", F.concat_ws(" & ", pair["one"], pair["other"]), False, q)
        street = F.coalesce(f["pair"]["one"], f["first"])
        station = [attempt("name", core, False, core), attempt("name", q, False, core), attempt("name", F.concat(core, F.lit(" station")), False, core)]
        attempts = (
            F.when(f["category"] == "intersection", F.array(crossing(f["pair"])))
            .when(f["category"] == "relational", F.array(crossing(f["pair"]), attempt("name", street, True, street)))
            .when((f["category"] == "station") & (x["kind"] == "intersection"), F.array(crossing(x["pair"]), *station))
            .when(f["category"] == "station", F.array(*station))
            .when(f["pinned"], F.array(attempt("bounded", f["digits"], True, f["digits"])))
            .otherwise(F.array(attempt("name", q, False, q)))
        )
        ends = f["category"].isin("place", "bare_street") & ~f["pinned"]
        return F.struct(f["category"].alias("category"), attempts.alias("attempts"), F.when(ends, f["tail"]).alias("tail"))

    # rules inside lambdas are long trees that are walked, not long methods that a compiler gives up on
    return rows.select("*", F.inline_outer(F.transform(F.transform(F.transform(F.array("query"), facts), of_core), ways)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def tail_chain(query: Column) -> Column:
    """The query, its tail, the tail's tail and so on, as one array: every text is routed as a query of its own.

    A chain ends at a fixed point, at a street, crossing, relation or station, and where no tail can be geocoded.
    There are as many links at most as the query has words that open a tail.
    """

    def further(last: Column) -> Column:
        ends = lambda q: F.when(P.classify(q).isin("place", "bare_street") & ~P.is_pinned_street(q), P.location_tail(q))
        tail = _once(F.coalesce(P._lookup(name_key(last), P.ALIASES), last), ends)
        return F.when(~name_key(last).isin(list(P.PINNED_POINTS)), tail)

    def step(chain: Column, _: Column) -> Column:
        return _once(_once(F.element_at(chain, -1), further), lambda t: F.when(t.isNull(), chain).otherwise(F.array_append(chain, t)))

    links = F.array_repeat(F.lit(0), F.coalesce(F.regexp_count(query, F.lit(TAIL_WORD)), F.lit(0)))
    return F.aggregate(links, F.array(query), step)


def resolve(queries: DataFrame, gazetteer: DataFrame, boroughs: dict[str, str] | None = None) -> DataFrame:
    """A cache row for each distinct ``query_norm`` of ``queries`` (query_norm, query, query_raw, and neighborhoods if known).

    ``gazetteer``: name, lat, lon, label, source, confidence, bounded (whether it lies where pinned streets are
    looked for), and for crossings borough, if known.  Fixed points come first, aliases are followed, then the first
    attempt that finds a place counts; a crossing in several boroughs is taken in that of the entry's first known
    neighborhood (``boroughs``: name in lower case -> borough), then in a fixed order.  Places of the source
    geosearch must be like the query.  Tails are routed in turn, and what they find is of low confidence.  The plan
    is the same however many tails a query has: the chain of tails is one array, exploded once with its depth.
    """
    hoods = "neighborhoods" if "neighborhoods" in queries.columns else None
    chosen = F.struct("query_raw", "query", *([hoods] if hoods else []))
    one = queries.groupBy("query_norm").agg(F.min(chosen).alias("_q")).select("query_norm", "_q.*")
    inferred = P.first_borough(hoods, boroughs or {}) if hoods else F.lit(None).cast("string")
    fixed = F.create_map(*[x for k, (lat, lon) in P.PINNED_POINTS.items() for x in (F.lit(k), F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon")))])
    links = one.select("query_norm", "query_raw", inferred.alias("_borough"), F.posexplode_outer(tail_chain(F.col("query"))).alias("_depth", "query"))
    key = name_key("query")
    links = _fenced(links.withColumns({"_fixed": F.try_element_at(fixed, key), "query": F.coalesce(P._lookup(key, P.ALIASES), F.col("query"))}))
    rows = with_attempts(links)
    tops = rows.where("_depth = 0").select("query_norm", "query_raw", "query", "category", "_fixed")
    pin = F.array(F.struct(F.lit("fixed").alias("kind"), F.col("query").alias("text"), F.lit(False).alias("low"), F.col("query").alias("covers")))
    tries = rows.select("query_norm", "_borough", "_fixed", "category", "_depth", F.posexplode(F.when(F.col("_fixed").isNotNull(), pin).otherwise(F.col("attempts"))).alias("_n", "_a"))
    low = F.col("_a.low") | (F.col("category") == "bare_street") | (F.col("_depth") > 0)
    tries = tries.select("query_norm", "_borough", F.struct(F.col("_depth").alias("depth"), "_n").alias("_n"), "_a.kind", "_a.text", "_a.covers", low.alias("low"), "_fixed")
    tries = tries.where("text <> ''").withColumn("_key", name_key("text"))
    pinned = tries.where("kind = 'fixed'").select("query_norm", "_n", F.lit(0).alias("_order"), F.struct(F.col("text").alias("label"), "_fixed.lat", "_fixed.lon", F.lit("manual").alias("source"), F.lit(None).cast("double").alias("confidence")).alias("_h"), F.col("_n.depth").cast("boolean").alias("low"), F.lit(None).cast("string").alias("covers"))
    borough = F.col("borough") if "borough" in gazetteer.columns else F.lit(None).cast("string")
    places = gazetteer.select(name_key("name").alias("_key"), "lat", "lon", "label", "source", F.col("confidence").cast("double").alias("confidence"), "bounded", borough.alias("borough"))
    hits = tries.where("kind <> 'fixed'").join(places, "_key").where("kind <> 'bounded' OR bounded")
    hits = hits.where((F.col("source") != "geosearch") | guarded(F.col("_key"), name_key(F.split_part("label", F.lit(","), F.lit(1))), F.col("text").rlike(P.HOUSE_NUMBER)))
    place = F.array_position(F.array(*map(F.lit, P.BOROUGH_ORDER)), F.coalesce("borough", F.lit("")))
    order = F.when(F.col("borough") == F.col("_borough"), 0).when(place > 0, place.cast("int")).otherwise(len(P.BOROUGH_ORDER) + 1)
    found = hits.select("query_norm", "_n", order.alias("_order"), F.struct("label", "lat", "lon", "source", "confidence").alias("_h"), "low", "covers").unionByName(pinned)
    best = found.groupBy("query_norm").agg(F.min(F.struct("_n", "_order", "_h", "low", "covers")).alias("_b"))
    joined = tops.join(best, "query_norm", "left")
    uncovered = ~F.col("_b._h.source").isin("geoservice", "manual") & ~P.label_covers(F.col("_b.covers"), F.col("_b._h.label"))
    return joined.select(
        "query_norm", "query_raw", "query", "category", F.col("_b._h.lat").alias("lat"), F.col("_b._h.lon").alias("lon"), F.col("_b._h.source").alias("source"),
        F.when(F.col("_fixed").isNotNull(), F.col("query_raw")).otherwise(F.col("_b._h.label")).alias("label"), F.col("_b._h.confidence").alias("confidence"),
        F.coalesce(F.col("_b.low") | uncovered, F.col("category") == "bare_street").alias("low_confidence"),
        F.when(F.col("_b").isNotNull(), "ok").otherwise("unresolved").alias("status"),
    )


def coordinates_in(document: Column | str) -> Column:
    """struct(lat, lon): the first latitude and longitude that stand side by side anywhere in a JSON text, NULL without.

    Objects are looked through before what they hold, in the order of the text; 0 is no coordinate.
    """

    def number(value: object) -> float | None:
        try:
            return float(value) or None
        except (TypeError, ValueError):
            return None

    def search(text: str | None) -> dict | None:
        try:
            open_ = [json.loads(text)] if text else []
        except ValueError:
            return None
        while open_:
            node = open_.pop()
            if isinstance(node, dict):
                plain = [(k.lower(), v) for k, v in node.items() if isinstance(v, (str, int, float))]
                pair = [number(next((v for k, v in plain if word in k), None)) for word in ("latitude", "longitude")]
                if None not in pair:
                    return {"lat": pair[0], "lon": pair[1]}
            held = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
            open_ += reversed(held)
        return None

    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([search(t) or {"lat": None, "lon": None} for t in texts], columns=["lat", "lon"], dtype="float64")

    return F.pandas_udf(found, "lat double, lon double")(document)


def geocode(entities: DataFrame, gazetteer: DataFrame, cache: DataFrame | None = None, refresh_overrides: bool = False, boroughs: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Results by entry, and the cache with the queries that were new.

    Only queries that the cache lacks are resolved; ``refresh_overrides`` forgets those that fixed rules decide.
    """
    rows = queries_of(entities)
    if cache is not None and refresh_overrides:
        cache = cache.where(~P.is_override("query_norm"))
    todo = rows if cache is None else rows.join(cache.select("query_norm"), "query_norm", "left_anti")
    found = resolve(todo, gazetteer, boroughs)
    full = found if cache is None else cache.unionByName(found)
    return rows.select("entry_id", "query_norm").join(full, "query_norm", "left").drop("query_norm"), full
