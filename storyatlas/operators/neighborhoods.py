"""Neighborhood areas from map files: named levels, and for each top level one area of all its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, name_key
from .levels import name_levels
from .union import united_areas

COLUMNS = ["name", "admin_0", "admin_1", "admin_2", "name_raw", "is_admin_0_union", "rings"]


def named_areas(placemarks: DataFrame) -> DataFrame:
    """``placemarks`` (name, rings) with levels; the name is the most specific one."""
    rows = placemarks.select(collapse("name").alias("name_raw"), name_levels("name").alias("_l"), "rings")
    return rows.select(F.col("_l.admin_2").alias("name"), "_l.admin_0", "_l.admin_1", "_l.admin_2", "name_raw", F.lit(False).alias("is_admin_0_union"), "rings")


def with_unions(areas: DataFrame) -> DataFrame:
    """``areas`` and behind them a row for each ``admin_0``: the union of its areas, flagged."""
    rings = united_areas(areas, "admin_0", "rings").where("size(rings) > 0")
    top = F.col("admin_0")
    unions = rings.select(top.alias("name"), top, top.alias("admin_1"), top.alias("admin_2"), top.alias("name_raw"), F.lit(True).alias("is_admin_0_union"), "rings")
    return areas.select(*COLUMNS).unionByName(unions)


def lookup_areas(areas: DataFrame) -> DataFrame:
    """key, name, broad, rings for the lookup of entries' neighborhoods; of areas with one key and kind the first by name counts."""
    rows = areas.select(name_key("name").alias("key"), F.col("is_admin_0_union").alias("broad"), F.struct("name", "rings").alias("_a")).where("key <> ''")
    return rows.groupBy("key", "broad").agg(F.min_by("_a", "_a.name").alias("_a")).select("key", F.col("_a.name").alias("name"), "broad", F.col("_a.rings").alias("rings"))
