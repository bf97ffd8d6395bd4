"""Registered queries: one for each operator, over whole tables, with its SQL oracle.

The oracles are in DuckDB's SQL.  Queries whose semantics SQL lacks (folds,
likeness of names, nested names, geometry clipping) have none; tests hold them
against examples and brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import text as X
from ..operators import geometry as G
from ..operators import relational as R
from ..operators.enrich import _fenced, dictionary_extract, resolve
from ..operators.levels import name_levels
from ..operators.segment import entries_of_lines, fold_lines, heading_entries, html_blocks, lines_with_lookahead
from ..operators.similarity import covered_pairs, fuzzy_match
from ..operators.spatial import regions_at
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The match key in DuckDB, as ``name_key``; trimming first, as in Spark, leaves the same.
_KEY = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the flagship: entries in miniature --------------------------------------


@_query(
    f"""
    WITH keyed AS (SELECT *, {_KEY.format('text')} AS k FROM documents),
    first AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1),
    ids AS (SELECT *, 'e' || left(sha1(coalesce(source, '') || chr(31) || coalesce(lang, '') || chr(31) || k), 16) AS entry_id FROM first)
    SELECT i.lang, count(*) AS n_entries, count(DISTINCT i.entry_id) AS n_ids, count(l.doc_id) AS n_labelled,
           count(*) FILTER (WHERE l.toxic = 1) AS n_toxic
    FROM ids i LEFT JOIN labels l ON i.doc_id = l.doc_id GROUP BY i.lang"""
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise texts, keep the first of equal ones, give content ids, join labels, count by language."""
    docs = _table(spark, sf_dir, "documents").withColumn("k", X.name_key("text"))
    # digests cross the network, texts don't
    narrow = docs.select("doc_id", "lang", F.sha2("k", 256).alias("k"), X.content_id("source", "lang", "k").alias("entry_id"))
    first = R.keep_first(narrow, ["k"], ["doc_id"])
    labels = _table(spark, sf_dir, "labels").withColumn("labelled", F.lit(1))
    return first.join(labels, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("n_entries"), F.countDistinct("entry_id").alias("n_ids"), F.count("labelled").alias("n_labelled"), F.count_if(F.col("toxic") == 1).alias("n_toxic")
    )


# ---- scans, filters, projections ---------------------------------------------


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@_query(
    """
    WITH f AS (SELECT p_partkey, lower(p_name) LIKE '%a%' AS tag, contains(lower(p_type), 'steel') AS phrase, p_size > 40 AS meta,
               lower(trim(p_brand)) IN ('brand#11', 'brand#12') AS correction FROM part)
    SELECT p_partkey, tag, phrase, meta, correction, (tag OR phrase) AND NOT meta AND NOT correction AS keep FROM f"""
)
def flag_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag, phrase, meta = F.lower("p_name").contains("a"), F.lower("p_type").contains("steel"), F.col("p_size") > 40
    correction = F.lower(F.trim("p_brand")).isin("brand#11", "brand#12")
    return _table(spark, sf_dir, "part").select("p_partkey", tag.alias("tag"), phrase.alias("phrase"), meta.alias("meta"), correction.alias("correction"), ((tag | phrase) & ~meta & ~correction).alias("keep"))


@_query("SELECT event_id, props, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.url'), props) AS picked FROM events")
def json_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON text, and the field or else the value itself."""
    return _table(spark, sf_dir, "events").select("event_id", "props", F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("k"), F.coalesce(F.get_json_object("props", "$.url"), "props").alias("picked"))


@_query("SELECT doc_id, lang FROM documents WHERE (lang IS NULL OR lower(trim(lang)) <> 'de') AND length(text) >= 20")
def null_tolerant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where((F.col("lang").isNull() | (F.lower(F.trim("lang")) != "de")) & (F.length("text") >= 20)).select("doc_id", "lang")


@_query(
    """
    SELECT page_id, CASE WHEN contains(url, '/') AND regexp_extract(url, '[^/]*$') <> '' THEN regexp_extract(url, '[^/]*$')
      ELSE trim(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), '-') END AS guid,
      trim(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), '-') AS slug FROM pages"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = X.guid(F.lit(None).cast("string"), "url")
    last = F.when(F.col("url").contains("/"), F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", X.guid(last, "url").alias("guid"), slug.alias("slug"))


# ---- joins -------------------------------------------------------------------


@_query(
    """
    SELECT o.o_orderkey, c.c_name, n.n_name, s.best FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS best FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON o.o_orderkey = s.l_orderkey"""
)
def left_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins whose right side is filtered below the join."""
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    best = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"))
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
        .join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(best, orders.o_orderkey == best.l_orderkey, "left")
        .select("o_orderkey", "c_name", "n_name", "best")
    )


@_query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = d.doc_id)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return R.resume(_table(spark, sf_dir, "documents").select("doc_id", "lang"), (_table(spark, sf_dir, "labels"), "doc_id"), (pages, "doc_id"))


@_query("SELECT doc_id AS entry_id, text FROM documents d WHERE text <> '' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def shown_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), "text")
    return V.shown([_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_id"))], docs, "text")


@_query(
    """
    WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word, generate_subscripts(string_split(lower(p_name), ' '), 1) AS pos FROM part),
    list AS (SELECT DISTINCT lower(p_type) AS t, string_split(lower(p_type), ' ')[1] AS word FROM part),
    one AS (SELECT word, min(t) AS t FROM list GROUP BY word)
    SELECT p_partkey, arg_min(t, pos) AS t FROM w JOIN one USING (word) GROUP BY p_partkey
    UNION ALL SELECT -1, min(t) FROM one"""
)
def first_match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a name that a list knows, with its entry; a last row tells the list's first entry."""
    part = _table(spark, sf_dir, "part")
    one = part.select(F.lower("p_type").alias("t")).groupBy(F.split("t", " ")[0].alias("word")).agg(F.min("t").alias("t"))
    found = R.first_match(part.select("p_partkey", F.split(F.lower("p_name"), " ").alias("words")), "words", one, "word", "p_partkey")
    return found.select("p_partkey", F.col("match.t").alias("t")).unionByName(one.agg(F.min("t").alias("t")).select(F.lit(-1).cast("long").alias("p_partkey"), "t"))


@_query(
    """
    SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'specific' WHEN l.doc_id IS NOT NULL THEN 'neighborhood' WHEN b.item_id IS NOT NULL THEN 'borough' END AS placement
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id"""
)
def tier_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest tier that an entry has."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("_l"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("_b"))
    rows = _table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").join(items, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("toxic") == 1, "specific").when(F.col("_l"), "neighborhood").when(F.col("_b"), "borough").alias("placement"))


# ---- aggregation, distinct, upsert -------------------------------------------


@_query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("text"))
    return R.keep_first(narrow, ["text", "lang"], ["doc_id"]).select("doc_id", "lang", "source")


@_query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_key(_table(spark, sf_dir, "events"), ["user_id"], F.col("event_id"), F.struct("ts", "event_id")).withColumnRenamed("first", "event_id")


@_query(
    """
    WITH half AS (SELECT (max(event_id) + 1) // 2 AS h FROM events),
    old AS (SELECT user_id, max(event_id) AS event_id FROM events, half WHERE event_id < h GROUP BY 1),
    new AS (SELECT user_id, max(event_id) AS event_id FROM events, half WHERE event_id >= h AND event_type <> 'view' GROUP BY 1)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)"""
)
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a first batch with that of a second in its place."""
    events = _table(spark, sf_dir, "events")
    half = events.agg(F.expr("(max(event_id) + 1) DIV 2").alias("h"))
    rows = events.join(F.broadcast(half))  # one row
    last = lambda df: df.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return R.upsert(last(rows.where("event_id < h")), last(rows.where("event_id >= h AND event_type <> 'view'")), "user_id")


@_query(
    """
    SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1"""
)
def modal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.modal_value(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@_query("SELECT event_type AS placement, count(*) AS n FROM events GROUP BY 1")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("placement")).agg(F.count("*").alias("n"))


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.most_common(_table(spark, sf_dir, "events"), "event_type")


@_query(
    """
    SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, count(*) FILTER (WHERE l_discount >= 0.05 AND l_tax < 0.04) AS n_cheap,
           count(*) - count(DISTINCT l_orderkey) AS n_repeats, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem"""
)
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.count_if((F.col("l_discount") >= 0.05) & (F.col("l_tax") < 0.04)).alias("n_cheap"),
        (F.count("*") - F.countDistinct("l_orderkey")).alias("n_repeats"),
        F.min("l_quantity").alias("least"),
        F.max("l_quantity").alias("most"),
    )


@_query("SELECT p_partkey, len(list_distinct([p_brand, p_type, p_name])) AS n_levels FROM part")
def distinct_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_distinct(F.array("p_brand", "p_type", "p_name"))).cast("long").alias("n_levels"))


# ---- windows, order, limits --------------------------------------------------


@_query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id) <= 25")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stratified_sample(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 25, "doc_id", 42)


@_query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100")
def topk_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.limited(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), [F.desc_nulls_first("o_orderdate"), "o_orderkey"], 100)


@_query("SELECT nation.* FROM nation ORDER BY n_nationkey")
def limit_zero_is_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.limited(_table(spark, sf_dir, "nation"), ["n_nationkey"], 0)


@_query("SELECT event_id, user_id, count(*) OVER (PARTITION BY date_trunc('hour', ts), value) AS n_here, count(*) OVER (PARTITION BY date_trunc('hour', ts), value) > 1 AS together FROM events")
def coincident_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").alias("_t"), F.col("value").alias("_v"))
    counts = rows.groupBy(F.col("_t").alias("_t2"), F.col("_v").alias("_v2")).agg(F.count("*").alias("n_here"))
    met = rows.join(counts, F.col("_t").eqNullSafe(F.col("_t2")) & F.col("_v").eqNullSafe(F.col("_v2")))
    return met.select("event_id", "user_id", "n_here", (F.col("n_here") > 1).alias("together"))


@_query(
    """
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
    e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM l)
    SELECT doc_id, pos::INT AS pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM e"""
)
def line_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_with_lookahead(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query("SELECT count(*) AS n, min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last FROM orders")
def year_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = _table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("pub_year"))
    return V.year_bounds(years)


@_query(
    """
    SELECT o_orderkey, year(o_orderdate) AS pub_year FROM orders
    WHERE coalesce(o_totalprice / 500000, 1) >= 0.2 AND coalesce(year(o_orderdate), 0) >= 1996 AND coalesce(year(o_orderdate), 9999) <= 1999"""
)
def year_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("pub_year"), (F.col("o_totalprice") / 500000).alias("confidence"))
    return rows.where(V.year_and_confidence(1996, 1999, 0.2)).select("o_orderkey", "pub_year")


# ---- set operations ----------------------------------------------------------


@_query("SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer UNION SELECT l_suppkey FROM lineitem")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [_table(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("lineitem", "l_suppkey"))]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


@_query("SELECT c_custkey AS id, c_name AS name, c_mktsegment, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def schema_widening_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment")
    return R.union_widened(customer, _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal"))


@_query(
    """
    WITH b AS (SELECT min(year(o_orderdate)) AS low, max(year(o_orderdate)) AS high FROM orders)
    SELECT y || '0101' AS begin_date, least(y + 2, high) || '1231' AS end_date FROM (SELECT unnest(generate_series(low, high, 3)) AS y, high FROM b)"""
)
def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three years over all years of orders."""
    bounds = _table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")).alias("low"), F.max(F.year("o_orderdate")).alias("high"))
    return R.date_windows(bounds, "low", "high", 3)


@_query(
    """
    WITH RECURSIVE h AS (SELECT datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS x, count(*) AS n FROM orders GROUP BY 1),
    w AS (SELECT b AS first, least(b + 999, 12000) AS last FROM (SELECT unnest(generate_series(9000, 12000, 1000)) AS b)
      UNION ALL SELECT CASE half WHEN 0 THEN first ELSE (first + last) // 2 + 1 END, CASE half WHEN 0 THEN (first + last) // 2 ELSE last END
      FROM (SELECT first, last FROM w WHERE first < last AND (SELECT coalesce(sum(n), 0) FROM h WHERE x BETWEEN first AND last) > 150), (SELECT unnest([0, 1]) AS half)),
    c AS (SELECT first, last, (SELECT coalesce(sum(n), 0) FROM h WHERE x BETWEEN first AND last)::BIGINT AS hits FROM w)
    SELECT first, last, hits, least(12, ceil(hits / 10.0))::INT AS pages, hits <= 120 AS complete FROM c WHERE hits <= 150 OR first = last"""
)
def bisected_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the days of orders, halved until each holds at most 150 orders, with their pages of ten."""
    days = _table(spark, sf_dir, "orders").select(F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    return R.bisected_windows(days, "day", 9000, 12000, 1000, 150, 10, 12)


# ---- text rules --------------------------------------------------------------


@_query("SELECT doc_id, 'e' || left(sha1(coalesce(source, '') || chr(31) || coalesce(lang, '') || chr(31) || chr(31) || coalesce(text, '')), 16) AS entry_id FROM documents")
def content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", X.content_id("source", "lang", F.lit(None).cast("string"), "text").alias("entry_id"))


@_query(f"SELECT doc_id, {_KEY.format('text')} AS name_key FROM documents")
def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", X.name_key("text").alias("name_key"))


@_query("SELECT conv_id, turn, 'Dear Diary:' || chr(10) || chr(10) || ltrim(regexp_replace(text, '^\\s*dear\\s+diary\\s*[:,]?\\s*', '', 'i'), ' \t\r' || chr(10)) AS body FROM conversations")
def salutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.salutation_body("text").alias("body"))


_GENERIC = "[" + ", ".join(f"'{w}'" for w in P.GENERIC_TOKENS) + "]"


_COVERED = f"""q AS (SELECT item_id, list_filter(list_distinct(string_split({_KEY.format('text')}, ' ')), lambda w: length(w) > 1 AND NOT list_contains({_GENERIC}, w)) AS words FROM benchmark),
    w AS (SELECT item_id, len(words) AS n_words, unnest(words) AS word FROM q),
    d AS (SELECT doc_id, unnest(list_distinct(string_split({_KEY.format('text')}, ' '))) AS word FROM documents),
    pairs AS (SELECT doc_id, item_id, any_value(n_words) AS n_words, count(*) AS n_hits FROM d JOIN w USING (word) GROUP BY doc_id, item_id HAVING count(*) * 2 >= any_value(n_words)
      UNION ALL SELECT doc_id, item_id, 0, 0 FROM documents JOIN q ON len(words) = 0 AND text <> '')"""


@_query(f"WITH {_COVERED} SELECT doc_id, count(item_id) AS n_items, min(item_id) AS first_item FROM documents LEFT JOIN pairs USING (doc_id) GROUP BY doc_id")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items each document covers, in that it has half of their identifying words, and the first of them."""
    docs = _table(spark, sf_dir, "documents")
    found = token_coverage_pairs(spark, sf_dir).groupBy("doc_id").agg(F.count("item_id").alias("n"), F.min("item_id").alias("first_item"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_items"), "first_item")


@_query(f"WITH {_COVERED} SELECT * FROM pairs")
def token_coverage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every item of which it has half of the identifying words."""
    return covered_pairs(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")


def _street_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location queries made of the tables' numbers and names, of every kind that the rules know."""
    n, m = F.col("o_orderkey") % 190 + 1, F.col("o_custkey") % 11 + 1
    word = F.element_at(F.array(*map(F.lit, P.WORD_ORDINALS)), m.cast("int"))
    kinds = [
        F.concat(n.cast("string"), F.lit("th Street and "), F.initcap(word), F.lit(" Avenue")),
        F.concat(n.cast("string"), F.lit("d Street between Park and Lexington")),
        F.concat(F.initcap(word), F.lit(" Avenue")),
        F.concat(n.cast("string"), F.lit("th Street R train station")),
        F.concat(F.lit("Fairway, "), n.cast("string"), F.lit(" Broadway")),
        F.concat(F.lit("Shop at "), P.ordinal(n), F.lit(" and Park")),
        F.lit("Bleecker and Perry Streets"),
    ]
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*kinds), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("raw"))


_ORD = "CASE WHEN n % 100 BETWEEN 10 AND 20 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END"
_WORDS = "[" + ", ".join(f"'{w.title()}'" for w in P.WORD_ORDINALS) + "]"
_RAW = f"""o AS (SELECT o_orderkey, o_orderkey % 190 + 1 AS n, {_WORDS}[o_custkey % 11 + 1] AS w FROM orders),
    raw AS (SELECT o_orderkey, n, w, CASE o_orderkey % 7 WHEN 0 THEN n || 'th Street and ' || w || ' Avenue' WHEN 1 THEN n || 'd Street between Park and Lexington'
      WHEN 2 THEN w || ' Avenue' WHEN 3 THEN n || 'th Street R train station' WHEN 4 THEN 'Fairway, ' || n || ' Broadway'
      WHEN 5 THEN 'Shop at ' || n || {_ORD} || ' and Park' ELSE 'Bleecker and Perry Streets' END AS raw FROM o)"""


@_query(
    f"""
    WITH {_RAW}
    SELECT o_orderkey, raw, CASE o_orderkey % 7 WHEN 4 THEN 'Fairway' ELSE raw END AS query,
      CASE o_orderkey % 7 WHEN 0 THEN 'intersection' WHEN 1 THEN 'relational' WHEN 2 THEN 'bare_street' WHEN 3 THEN 'station' WHEN 6 THEN 'intersection' ELSE 'place' END AS category,
      CASE o_orderkey % 7 WHEN 0 THEN n || 'th Street & ' || w || ' Avenue' WHEN 1 THEN n || 'd Street & Park Avenue' WHEN 5 THEN 'Shop & ' || n || {_ORD} || ' and Park'
        WHEN 6 THEN 'Bleecker Street & Perry Street' ELSE '' END AS streets
    FROM raw"""
)
def location_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, classify and canonicalise location queries; the oracle tells what the rules say of each kind."""
    rules = lambda q: F.struct(P.classify(q).alias("category"), P.crossing_streets(q).alias("pair"))
    rows = _fenced(_street_names(spark, sf_dir).withColumn("query", P.clean_query("raw")))
    rows = rows.select("o_orderkey", "raw", "query", F.inline_outer(F.transform(F.array("query"), rules)))
    return rows.select("o_orderkey", "raw", "query", "category", F.concat_ws(" & ", "pair.one", "pair.other").alias("streets"))


_WORD_ORD = f"list_position({_WORDS}, w) || (CASE list_position({_WORDS}, w) WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END)"


@_query(
    f"""
    WITH {_RAW}
    SELECT o_orderkey, n || {_ORD} AS ordinal,
      CASE o_orderkey % 7 WHEN 0 THEN n || {_ORD} || ' Street and ' || {_WORD_ORD} || ' Avenue' WHEN 1 THEN n || {_ORD} || ' Street between Park and Lexington'
        WHEN 2 THEN {_WORD_ORD} || ' Avenue' WHEN 3 THEN n || {_ORD} || ' Street R train station' WHEN 4 THEN 'Fairway, ' || n || {_ORD} || ' Broadway'
        WHEN 5 THEN 'Shop at ' || n || {_ORD} || ' and Park' ELSE 'Bleecker and Perry Streets' END AS digits
    FROM raw"""
)
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals in digits for every kind of location query."""
    rows = _street_names(spark, sf_dir)
    return rows.select("o_orderkey", P.ordinal(F.col("o_orderkey") % 190 + 1).alias("ordinal"), P.digit_ordinals("raw").alias("digits"))


@_query(
    f"""
    WITH own AS ({ORACLE["ordinals"]}),
    n AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber) % 999 + 1 AS n FROM lineitem)
    SELECT o_orderkey AS l_orderkey, NULL::INTEGER AS l_linenumber, ordinal, digits FROM own
    UNION ALL SELECT l_orderkey, l_linenumber, n || {_ORD} AS ordinal, 'West ' || n || {_ORD} || ' Street' AS digits FROM n"""
)
def ordinals_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of location query of all orders (no line number), and on all lines every number of up to three digits, with a wrong ending or none mended."""
    n = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 999 + 1
    ending = F.element_at(F.array(*map(F.lit, ["d", "th", "st", ""])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    text = F.concat(F.lit("West "), n.cast("string"), ending, F.lit(" Street"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.ordinal(n).alias("ordinal"), P.digit_ordinals(text).alias("digits"))
    own = ordinals(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), F.lit(None).cast("int").alias("l_linenumber"), "ordinal", "digits")
    return own.unionByName(lines)


@_query(
    r"""
    WITH s AS (SELECT c_custkey, (['The Bronx', ' kings ', 'Queens', 'Staten Island', 'Hoboken'])[c_custkey % 5 + 1] AS raw FROM customer)
    SELECT c_custkey, (['Bronx', 'Brooklyn', 'Queens', 'Staten Island', NULL])[c_custkey % 5 + 1] AS borough,
           (['the Bronx', 'Brooklyn', 'Queens', 'Staten Island', NULL])[c_custkey % 5 + 1] AS phrase FROM s"""
)
def boroughs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["The Bronx", " kings ", "Queens", "Staten Island", "Hoboken"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", P.canonical_borough(raw).alias("borough"))
    return rows.withColumn("phrase", P.borough_phrase("borough"))


# ---- segmentation ------------------------------------------------------------


@_query()
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(html_blocks("html")).alias("pos", "b"))
    return pages.select("page_id", "pos", "b.tag", "b.text", "b.marked")


@_query()
def heading_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their h1 taken for h2, so that every page has segments."""
    pages = _table(spark, sf_dir, "pages").withColumn("html", F.regexp_replace("html", "(?i)<(/?)h1", "<$1h2")).withColumn("blocks", html_blocks("html"))
    return pages.select("page_id", F.posexplode(heading_entries(F.col("blocks"))).alias("pos", "e")).select("page_id", "pos", "e.title", "e.author", "e.body")


@_query()
def legacy_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document folded to entries."""
    block = lambda x: F.struct(F.lit(0).alias("pos"), F.lit("p").alias("tag"), F.trim(x).alias("text"), F.lit("").alias("italic"), F.lit("").alias("marked"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), block).alias("blocks"))
    return entries_of_lines(docs, "doc_id", "blocks")


_FRESH = "(['opening', 'title', 'body'])[(l_orderkey + l_suppkey) % 3 + 1]"
_OPEN = "(['opening', 'title', 'author', 'body', 'body'])[(l_partkey + l_linenumber) % 5 + 1]"


@_query(
    f"""
    WITH RECURSIVE f AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n, l_orderkey, l_linenumber, l_partkey,
      {_FRESH} AS fresh, {_OPEN} AS opened FROM lineitem),
    s AS (SELECT l_suppkey, n, l_orderkey, l_linenumber, l_partkey, fresh AS kind, false AS ends, 0::BIGINT AS segment FROM f WHERE n = 1
      UNION ALL SELECT f.l_suppkey, f.n, f.l_orderkey, f.l_linenumber, f.l_partkey, CASE WHEN s.kind IN ('body', 'opening') THEN opened ELSE fresh END,
        s.kind IN ('body', 'opening') AND opened <> 'body', s.segment + (s.kind IN ('body', 'opening') AND opened <> 'body')::BIGINT
      FROM s JOIN f ON f.l_suppkey = s.l_suppkey AND f.n = s.n + 1)
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, kind, ends, segment FROM s"""
)
def folded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each line item, in a page for each supplier, folded to stories."""
    rows = _table(spark, sf_dir, "lineitem")
    pick = lambda n, *kinds: F.element_at(F.array(*map(F.lit, kinds)), (n % len(kinds) + 1).cast("int"))
    lines = rows.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"),
        pick(F.col("l_orderkey") + F.col("l_suppkey"), "opening", "title", "body").alias("fresh"),
        pick(F.col("l_partkey") + F.col("l_linenumber"), "opening", "title", "author", "body", "body").alias("opened"),
    )
    return fold_lines(lines, ["l_suppkey"], "at", "fresh", "opened").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "kind", "ends", "segment")


@_query()
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", X.smart_case(F.upper("p_name")).alias("shouted"), X.smart_case("p_name").alias("plain"))


@_query()
def nested_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("s_name", F.lit(" ("), F.upper("n_name"), F.lit(" ("), "r_name", F.lit("))"))
    rows = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("s_suppkey", name_levels(name).alias("l")).select("s_suppkey", "l.*")


@_query("SELECT DISTINCT lower(p_name) || 'x' AS key, lower(p_name) AS match FROM part UNION SELECT DISTINCT 'zz ' || lower(p_type), NULL FROM part")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with a letter changed, and the nearest true name; and words that no name is near to."""
    part = _table(spark, sf_dir, "part")
    name = X.name_key("p_name")
    keys = part.select(F.concat(name, F.lit("x")).alias("key")).union(part.select(F.concat(F.lit("zz "), X.name_key("p_type"))))
    return fuzzy_match(keys, "key", part.select(name.alias("name")), "name")


@_query(
    """
    WITH n AS (SELECT c_custkey AS k, left(md5(c_custkey::VARCHAR), 16) AS h FROM customer)
    SELECT key, match FROM (SELECT CASE k % 4 WHEN 0 THEN 'east ' || h WHEN 1 THEN 'east ' || h WHEN 2 THEN 'west ' || left(h, 7) || right(h, 8) ELSE reverse(h) || ' upper' END AS key,
      CASE k % 4 WHEN 0 THEN 'east ' || h WHEN 1 THEN NULL WHEN 2 THEN 'west ' || h END AS match FROM n)"""
)
def fuzzy_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of places that differ in their direction, lack a letter, or are like no other; a name for each customer."""
    h = F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 16)
    rows = _table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("k"), h.alias("h"))
    names = rows.select(F.concat(F.when(F.col("k") == 0, "east ").otherwise("west "), "h").alias("name"))
    east, west = F.concat(F.lit("east "), "h"), F.concat(F.lit("west "), F.left("h", F.lit(7)), F.right("h", F.lit(8)))
    keys = rows.select(F.when(F.col("k") < 2, east).when(F.col("k") == 2, west).otherwise(F.concat(F.reverse("h"), F.lit(" upper"))).alias("key"))
    return fuzzy_match(keys, "key", names, "name")


# ---- geometry and views ------------------------------------------------------

_SQUARES = "[{'name': 'A', 'x': 0.0, 'y': 0.0}, {'name': 'B', 'x': 10.0, 'y': 0.0}, {'name': 'C', 'x': 0.0, 'y': 10.0}, {'name': 'D', 'x': 10.0, 'y': 10.0}]"


def _regions(spark: SparkSession) -> DataFrame:
    """Four squares of side 10."""
    square = lambda x, y: [[(x, y), (x + 10.0, y), (x + 10.0, y + 10.0), (x, y + 10.0), (x, y)]]
    return spark.createDataFrame([(n, square(x, y)) for n, x, y in (("A", 0.0, 0.0), ("B", 10.0, 0.0), ("C", 0.0, 10.0), ("D", 10.0, 10.0))], f"name string, rings {G.RINGS}")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 37 % 2000) / 100.0 + 0.003).alias("x"), ((F.col("event_id") * 91 % 2000) / 100.0 + 0.003).alias("y"))


@_query(
    f"""
    WITH p AS (SELECT event_id, (event_id * 37 % 2000) / 100.0 + 0.003 AS x, (event_id * 91 % 2000) / 100.0 + 0.003 AS y FROM events), r AS (SELECT unnest({_SQUARES}, recursive := true))
    SELECT event_id, name FROM p JOIN r ON p.x > r.x AND p.x < r.x + 10 AND p.y > r.y AND p.y < r.y + 10"""
)
def point_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points joined with the regions that hold them, by cells."""
    return regions_at(_points(spark, sf_dir), "x", "y", _regions(spark), "name", "rings").select("event_id", "name")


_CORNERS = [[(0.0, 0.0), (9.0, 0.5), (8.0, 9.0), (4.5, 3.3), (0.7, 9.0), (0.0, 0.0)], [(2.0, 1.0), (4.0, 1.2), (3.1, 2.0), (2.0, 1.0)]]
_EDGES = [(*a, *b) for ring in _CORNERS for a, b in zip(ring[:-1], ring[1:], strict=True)]
_AT = "({0} * (1 + k % 4) / 6.0 + {1})"


@_query(
    f"""
    WITH p AS (SELECT event_id, (event_id * 37 % 2000) / 100.0::DOUBLE + 0.003::DOUBLE AS x, (event_id * 91 % 2000) / 100.0::DOUBLE + 0.003::DOUBLE AS y FROM events),
    s AS (SELECT s_suppkey AS k, (s_suppkey * 13 % 37) / 2.0::DOUBLE AS dx, (s_suppkey * 29 % 41) / 2.0::DOUBLE AS dy FROM supplier),
    c AS (SELECT unnest([{", ".join(f"{{'a': {a}::DOUBLE, 'b': {b}::DOUBLE, 'c': {c}::DOUBLE, 'd': {d}::DOUBLE}}" for a, b, c, d in _EDGES)}], recursive := true)),
    e AS (SELECT k, {_AT.format('a', 'dx')} AS x0, {_AT.format('b', 'dy')} AS y0, {_AT.format('c', 'dx')} AS x1, {_AT.format('d', 'dy')} AS y1 FROM s, c)
    SELECT event_id, k AS s_suppkey FROM p JOIN e ON (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
    GROUP BY event_id, k HAVING count(*) % 2 = 1"""
)
def points_in_many_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points joined with a region for each supplier: concave, with a hole, of several sizes, over one another."""
    k, dx, dy = F.col("s_suppkey"), (F.col("s_suppkey") * 13 % 37) / 2.0, (F.col("s_suppkey") * 29 % 41) / 2.0
    at = lambda v, d: F.lit(v) * (1 + k % 4) / 6.0 + d
    ring = lambda corners: F.array(*[F.struct(at(x, dx).alias("x"), at(y, dy).alias("y")) for x, y in corners])
    areas = _table(spark, sf_dir, "supplier").select("s_suppkey", F.array(*map(ring, _CORNERS)).alias("rings"))
    return regions_at(_points(spark, sf_dir), "x", "y", areas, "s_suppkey", "rings").select("event_id", "s_suppkey")


@_query("SELECT event_id, round((event_id % 101) / 101.0 * 30, 6) AS along, CASE WHEN (event_id % 101) / 101.0 * 30 <= 20 THEN 0.0 ELSE round((event_id % 101) / 101.0 * 30 - 20, 6) END AS y FROM events")
def point_on_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at shares of a bent line's length."""
    line = F.from_json(F.lit("[[{\"x\":0,\"y\":0},{\"x\":20,\"y\":0},{\"x\":20,\"y\":10}]]"), G.RINGS)
    p = _table(spark, sf_dir, "events").select("event_id", G.point_on_line(line, (F.col("event_id") % 101) / 101.0).alias("p"))
    return p.select("event_id", F.round(F.col("p.x") + F.col("p.y"), 6).alias("along"), F.round("p.y", 6).alias("y"))


@_query()
def sampled_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point inside its region for each customer; repeatable whatever the partitioning."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("c_nationkey") % 4 + 1).cast("int")).alias("name"))
    placed = G.points_in_regions(rows, "name", G.region_pieces(_regions(spark), "name", "rings"), "p", 7, F.col("c_custkey")).join(F.broadcast(_regions(spark)), "name")  # four rows
    return placed.select("c_custkey", "name", "p.x", "p.y", G.inside(F.col("p.x"), F.col("p.y"), F.col("rings")).alias("inside"))


@_query()
def jitter_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation share a point and are fanned out."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_id"), (F.lit(-74.0) + F.col("c_nationkey") / 100).alias("x"), (F.lit(40.7) + F.col("c_nationkey") / 200).alias("y"))
    return G.spread_coincident(rows, "x", "y", "entry_id")


@_query()
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries made of orders, placed at the finest tier they have, as features."""
    rows = _entries(spark, sf_dir)
    placed = V.areas_view(V.area_positions(rows, _regions(spark), 3), _areas(spark), _boroughs(spark), 3)
    return placed.where("placement IS NOT NULL").select("entry_id", "placement", F.to_json(V.feature(F.col("x"), F.col("y"), F.col("placement")), {"ignoreNullFields": "false"}).alias("feature"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as entries: some located, some in a region of a name, some in one of the learned boroughs."""
    orders = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    hood = F.element_at(F.array(*map(F.lit, "ABCD")), (key % 4 + 1).cast("int"))
    rows = orders.select(
        key.cast("string").alias("entry_id"),
        F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("author"), F.year("o_orderdate").alias("pub_year"), F.lit(None).cast("string").alias("web_url"),
        F.when(key % 3 == 0, F.array(F.lit("Queens"))).alias("boroughs"),
        F.when(key % 5 == 0, F.array(hood)).when((key % 11 == 7) & (key % 3 != 0), F.array(F.lit("Nowhere"))).alias("neighborhoods"),
        F.when(key % 7 == 0, F.array(F.lit("R"))).alias("subway_lines"),
        F.when(key % 2 == 0, F.array(F.concat(F.lit("Place "), key.cast("string")))).alias("specific_locations"),
        F.when(key % 2 == 0, F.when(key % 22 == 0, F.lit("A")).otherwise(F.concat(F.lit("Place "), key.cast("string")))).alias("query_raw"),
        F.when(key % 2 == 0, F.lit(40.7) + key % 97 / 100).alias("lat"), F.when(key % 2 == 0, F.lit(-74.0) + key % 89 / 100).alias("lon"),
        F.when(key % 2 == 0, (key % 11) / 10.0).alias("confidence"), F.when(key % 2 == 0, key % 11 < 5).alias("low_confidence"),
        F.when(key % 2 == 0, F.lit("nominatim")).alias("source"), F.when(key % 2 == 0, F.lit("place")).alias("category"),
        (key % 7 == 0).alias("subway_mentioned"),
    )
    return V.with_neighborhood(V.with_borough(rows, _boroughs(spark), V.learned_boroughs(rows)), _areas(spark))


def _areas(spark: SparkSession) -> DataFrame:
    return _regions(spark).select(X.name_key("name").alias("key"), "name", F.lit(False).alias("broad"), "rings")


def _boroughs(spark: SparkSession) -> DataFrame:
    return _regions(spark).where("name = 'D'").select(F.lit("Queens").alias("name"), "rings")


@_query(
    """
    WITH k AS (SELECT o_orderkey AS k FROM orders)
    SELECT CASE WHEN k % 22 = 0 THEN 'area:A' WHEN k % 2 = 0 THEN 'specific' WHEN k % 5 = 0 THEN 'neighborhood' WHEN k % 3 = 0 THEN 'borough' END AS placement, count(*) AS n
    FROM k GROUP BY 1"""
)
def placement_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = V.areas_view(V.area_positions(_entries(spark, sf_dir), _regions(spark), 3), _areas(spark), _boroughs(spark), 3)
    return placed.groupBy("placement").agg(F.count("*").alias("n"))


@_query()
def subway_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.createDataFrame([("r", [[(0.0, 5.0), (20.0, 5.0)], [(20.0, 5.0), (20.0, 15.0)]]), ("q", [[(3.0, 3.0), (3.0, 9.0)]])], f"service string, paths {G.RINGS}")
    placed = V.subway_view(_entries(spark, sf_dir), line, _boroughs(spark), 3)
    return placed.select("entry_id", "placement", "borough_name", "x", "y", V.place_label(F.col("placement")).alias("label"))


# ---- enrichment --------------------------------------------------------------


@_query()
def dictionary_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entry_id"), F.coalesce("text", F.lit("")).alias("text"))
    return dictionary_extract(docs, ["A", "R"], ["the", "and"], ["Queens"], ["that was", "of the"])


@_query(
    """
    SELECT n_name AS query_raw, 'ok' AS status, CAST(n_nationkey AS DOUBLE) AS lat FROM nation
    UNION ALL SELECT 'Port Authority', 'ok', 40.75717952921247 UNION ALL SELECT 'Nowhere at all', 'unresolved', NULL"""
)
def resolved_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    raw = nation.select(F.col("n_name").alias("query_raw")).union(spark.createDataFrame([("Port Authority",), ("Nowhere at all",)], "query_raw string"))
    queries = raw.withColumn("query", P.clean_query("query_raw")).withColumn("query_norm", X.name_key("query"))
    places = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.col("n_name").alias("label"), F.lit("nominatim").alias("source"), F.lit(1.0).alias("confidence"), F.lit(True).alias("bounded"))
    return resolve(queries, places).select("query_raw", "status", "lat")
