"""Relational operators with the exact tie rules that Spark's built-ins leave open."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    while stem.lower() in {c.lower() for c in df.columns}:
        stem += "_"
    return stem


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row by ``order`` of each key; NULL keys are equal to one another."""
    name, rank = _unused(df, "_rank"), F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) == 1).drop(name)  # planned with a partial group limit


def first_per_key(df: DataFrame, keys: Sequence[str], value: Column, order: Column) -> DataFrame:
    """One representative of each key by aggregation, which combines before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias("first"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def resume(todo: DataFrame, *done: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose key is in none of the ``done`` tables."""
    return reduce(lambda df, d: df.join(d[0].select(d[1]).distinct(), d[1], "left_anti"), done, todo)


def union_widened(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under all columns in the order first seen; what a frame lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stratified_sample(df: DataFrame, stratum: str, per: int, id_col: str, seed: int) -> DataFrame:
    """``per`` rows of each stratum in an order that depends on seed and id alone."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    name, rank = _unused(df, "_rank"), F.row_number().over(Window.partitionBy(stratum).orderBy(key, id_col))
    return df.where(F.col(stratum).isNotNull()).withColumn(name, rank).where(F.col(name) <= per).drop(name)


def shuffled(df: DataFrame, id_col: str, seed: int, n: int) -> DataFrame:
    """``n`` rows in an order that depends on seed and id alone."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), id_col).limit(n)


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; of equals the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_m")).select(key, F.col("_m.v").alias(value))


def first_match(df: DataFrame, items: str, lookup: DataFrame, key: str, id_col: str) -> DataFrame:
    """For each row the lookup entry of the first item that has one."""
    hits = df.select(id_col, F.posexplode(items).alias("_pos", key)).join(lookup, key)
    return hits.groupBy(id_col).agg(F.min_by(F.struct(*lookup.columns), "_pos").alias("match"))


def limited(df: DataFrame, order: Sequence[Column | str], n: int | None) -> DataFrame:
    """The first ``n`` rows by a total order; None and 0 mean all."""
    ordered = df.orderBy(*order)
    return ordered.limit(n) if n else ordered


def most_common(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value)


def date_windows(years: DataFrame, start: str, end: str, step: int) -> DataFrame:
    """Windows of ``step`` years from ``start`` to ``end`` of each row of ``years``, as first and last days."""
    each = years.select(F.explode(F.sequence(start, end, F.lit(step))).alias("y"), F.col(end).alias("_end"))
    last = F.least(F.col("y") + step - 1, F.col("_end"))
    return each.select(F.format_string("%d0101", "y").alias("begin_date"), F.format_string("%d1231", last).alias("end_date"))


def bisected_windows(rows: DataFrame, at: str, start: int, end: int, step: int, limit: int, page: int, most_pages: int) -> DataFrame:
    """first, last, hits, pages, complete: windows over ``at`` (whole numbers) that hold at most ``limit`` rows.

    Windows of ``step`` numbers from ``start`` to ``end`` are halved, the lower half being the larger,
    until they hold no more than ``limit`` rows or one number.  Windows without rows are kept, with no pages; ``complete`` says
    whether ``most_pages`` pages show all rows.  Each number knows its way down the halves, so one
    histogram is summed once; a window is halved exactly if it holds too many, and then so were all above it.
    """
    window = lambda a, b: F.struct(a.cast("long").alias("first"), b.cast("long").alias("last"))
    middle = lambda w: F.floor((w["first"] + w["last"]) / 2)
    lower, upper = lambda w: window(w["first"], middle(w)), lambda w: window(middle(w) + 1, w["last"])
    root = lambda first: window(first, F.least(first + step - 1, F.lit(end)))
    x = F.col("_x")
    counts = rows.where(F.col(at).between(start, end)).groupBy(F.col(at).cast("long").alias("_x")).agg(F.count("*").alias("_n"))

    def down(way: Column, _: Column) -> Column:
        w = F.element_at(way, -1)
        return F.when(w["first"] == w["last"], way).otherwise(F.array_append(way, F.when(x <= middle(w), lower(w)).otherwise(upper(w))))

    halvings = F.array_repeat(F.lit(0), max(step - 1, 0).bit_length())
    way = F.aggregate(halvings, F.array(root(x - (x - start) % step)), down)
    held = counts.select(F.explode_outer(way).alias("_w"), "_n").groupBy("_w.first", "_w.last").agg(F.sum("_n").alias("hits"))
    full = (F.col("hits") > limit) & (F.col("first") < F.col("last"))
    halved = held.where(full).select(window(F.col("first"), F.col("last")).alias("_w")).select(F.explode(F.array(lower(F.col("_w")), upper(F.col("_w")))).alias("_w"))
    roots = rows.sparkSession.range(start, end + 1, step).select(root(F.col("id")).alias("_w"))
    every = roots.unionByName(halved).select("_w.*").join(held, ["first", "last"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    pages = F.least(F.lit(most_pages), F.ceil(F.col("hits") / page)).cast("int")
    return every.where(~full).select("first", "last", "hits", pages.alias("pages"), (F.col("hits") <= page * most_pages).alias("complete"))
