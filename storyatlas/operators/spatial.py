"""Points joined with the regions that hold them, by cells instead of pairs.

Each region is covered by cells of a size that fits it (a power of two, so that it
has ``SIDE`` to 2 ``SIDE`` cells a side).  Cells that no edge touches are wholly inside
or left out; a point there needs no test.  A point in a cell with edges casts a ray
against the edges of its row of cells alone.  Points find cells by an equi-join, once
for each size in use; sizes are few, as each is twice the next.

Places and shapes are looked up, each once however many points and regions share it.  Points
then get the regions of their place as lists of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import SHIPPED, bounds, ring_edges

#: Cells that a region has on its longer side at least; at most twice as many.
SIDE = 8
#: Share of a cell by which edges are taken to reach further, so that rounding hides none.
_REACH = 1e-6
#: Regions that a list has about, if all hold its place.
LISTED = 8_192


def _height(e: Column, y: Column) -> Column:
    """Where an edge that is not level passes the height ``y``."""
    return (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]


def _odd(edges: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the right meets an odd number of ``edges``."""
    return F.size(F.filter(edges, lambda e: F.when((e["y0"] > y) != (e["y1"] > y), x < _height(e, y)).otherwise(False))) % 2 == 1


def cell_rows(regions: DataFrame, key: str, rings: str) -> DataFrame:
    """key, level, row, edges, touched, within: the rows of cells of each region.

    ``edges`` are those that reach the row, ``touched`` the columns where one of them is, ``within``
    the columns that are wholly inside.  Regions without extent hold nothing and are left out.
    """
    shaped = regions.select(F.col(key), F.col(rings).alias("_r")).where(F.col(key).isNotNull() & F.col("_r").isNotNull())
    boxed = shaped.select(key, ring_edges(F.col("_r")).alias("_edges"), bounds(F.col("_r")).alias("_b"))
    longer = F.greatest(F.col("_b.maxx") - F.col("_b.minx"), F.col("_b.maxy") - F.col("_b.miny"))
    leveled = boxed.where(longer > 0).withColumn("level", F.floor(F.log2(longer / SIDE)).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level"))
    edges = leveled.select(key, "level", size.alias("_size"), F.explode("_edges").alias("_e"))
    low, high = F.least("_e.y0", "_e.y1"), F.greatest("_e.y0", "_e.y1")
    edges = edges.withColumn("row", F.explode(F.sequence(F.floor(low / F.col("_size")), F.floor(high / F.col("_size")))))
    # the part of the edge in the row, and the columns that it is in
    bottom, top = F.col("row") * F.col("_size"), (F.col("row") + 1) * F.col("_size")
    at = lambda y: F.when(F.col("_e.y0") == F.col("_e.y1"), None).otherwise(_height(F.col("_e"), y))
    ends = [F.when(low >= bottom, F.when(F.col("_e.y0") <= F.col("_e.y1"), F.col("_e.x0")).otherwise(F.col("_e.x1"))).otherwise(at(bottom))]
    ends += [F.when(high <= top, F.when(F.col("_e.y0") <= F.col("_e.y1"), F.col("_e.x1")).otherwise(F.col("_e.x0"))).otherwise(at(top))]
    first, last = F.floor(F.least(*ends) / F.col("_size") - _REACH), F.floor(F.greatest(*ends) / F.col("_size") + _REACH)
    grouped = edges.select(key, "level", "_size", "row", "_e", F.sequence(first, last).alias("_c")).groupBy(key, "level", "_size", "row")
    rows = grouped.agg(F.collect_list("_e").alias("edges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_c")))).alias("touched"))
    between = F.array_except(F.sequence(F.array_min("touched"), F.array_max("touched")), F.col("touched"))
    within = F.filter(between, lambda c: _odd(F.col("edges"), (c + 0.5) * F.col("_size"), (F.col("row") + 0.5) * F.col("_size")))
    return rows.select(key, "level", "row", "edges", "touched", within.alias("within"))


def regions_at(points: DataFrame, x: str, y: str, regions: DataFrame, key: str, rings: str) -> DataFrame:
    """``points`` with ``key``: a row for each region that holds the point, by the even-odd rule.

    A point on an edge is inside or not as for ``geometry.inside``.  Points without a
    coordinate are in no region.  ``key`` names a region, and is no column of ``points``.
    """
    kept = regions.select(F.col(key).alias("_key"), F.col(rings).alias("_rings")).where("_key IS NOT NULL AND _rings IS NOT NULL")
    shapes = kept.groupBy("_rings").agg(F.min("_key").alias("_shape"))
    places = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y")).distinct()
    named = kept.join(shapes.withColumnRenamed("_rings", "_drawn"), F.col("_rings") == F.col("_drawn")).select("_shape", "_key")
    part = F.pmod(F.xxhash64("_key"), F.lit(kept.count() // LISTED + 1))
    lists = _shapes_at(places, shapes).join(named, "_shape").groupBy("_x", "_y", part.alias("_part")).agg(F.collect_list("_key").alias("_keys"))
    met = points.join(lists, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")))
    return met.select(*points.columns, F.explode("_keys").alias(key))


def _shapes_at(places: DataFrame, shapes: DataFrame) -> DataFrame:
    """_x, _y, _shape: the ``shapes`` (_shape, _rings) that hold each of the ``places`` (_x, _y)."""
    rows = cell_rows(shapes, "_shape", "_rings").persist()
    try:
        levels = [r.level for r in rows.select("level").distinct().collect()]  # powers of two, so few
        n_cells, n_rows = rows.agg(F.coalesce(F.sum(F.size("touched") + F.size("within")), F.lit(0)), F.count("*")).first()
    finally:
        rows.unpersist()
    ship = lambda df, n: F.broadcast(df) if n <= SHIPPED else df
    size = F.pow(F.lit(2.0), F.col("_level"))
    placed = places.select("_x", "_y", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_level"))
    placed = placed.withColumns({"_row": F.floor(F.col("_y") / size), "_column": F.floor(F.col("_x") / size)})
    part = lambda c, sure: rows.select("_shape", F.col("level").alias("_l"), F.col("row").alias("_rw"), F.explode(c).alias("_c"), F.lit(sure).alias("_sure"))
    cells = part("within", True).unionByName(part("touched", False))
    met = placed.join(ship(cells, n_cells), (F.col("_level") == F.col("_l")) & (F.col("_row") == F.col("_rw")) & (F.col("_column") == F.col("_c")))
    met = met.drop("_l", "_rw", "_c")
    near = rows.select(F.col("_shape").alias("_k"), F.col("row").alias("_rw"), "edges")
    tested = met.where("NOT _sure").join(ship(near, n_rows), (F.col("_shape") == F.col("_k")) & (F.col("_row") == F.col("_rw")))
    inside = tested.where(_odd(F.col("edges"), F.col("_x"), F.col("_y")))
    return met.where("_sure").select("_x", "_y", "_shape").unionByName(inside.select("_x", "_y", "_shape"))
