"""Areas and lines united: what is common counts once, and no inner edge stays.

Edges of one key meet by cells (of about their mean extent, so that their number grows with the edges) and are cut
where they cross, touch or overlap.  A piece of an edge bounds the union if one of its sides is
covered by a part and the other by none: a ray from its middle meets each part's pieces in its row of cells.  The
pieces that stay are led around the inside on their left, each knows the next, and jumps of doubled
length find the rings.  Nothing is gathered but the corners of one ring and the cuts of one edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import settled
from .geometry import RINGS

#: Corners are put on a grid of so many digits (a tenth of a millimetre in degrees), so that cuts of two edges agree.
DIGITS = 9
#: Share of a cell by which edges are taken to reach further, so that rounding parts none that touch.
_REACH = 1e-6
_ENDS = ["x0", "y0", "x1", "y1"]


def _edges(parts: DataFrame, rings: str, closed: bool, digits: int) -> DataFrame:
    """_k, part, x0, y0, x1, y1 of all rings (closed where they are not) or paths of ``parts``."""
    on_grid = lambda c: F.round(c, digits) + 0.0
    ring = F.filter(F.col("_ring"), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    ring = F.transform(ring, lambda p: F.struct(on_grid(p["x"]).alias("x"), on_grid(p["y"]).alias("y")))
    rows = parts.select("_k", "part", F.explode(rings).alias("_ring")).select("_k", "part", ring.alias("_ring")).where("size(_ring) > 1")
    after = F.concat(F.slice("_ring", 2, F.size("_ring")), F.slice("_ring", 1, 1)) if closed else F.slice("_ring", 2, F.size("_ring"))
    pairs = rows.select("_k", "part", F.explode(F.arrays_zip(F.col("_ring").alias("a"), after.alias("b"))).alias("_e")).where("_e.b IS NOT NULL AND _e.a <> _e.b")
    return pairs.select("_k", "part", F.col("_e.a.x").alias("x0"), F.col("_e.a.y").alias("y0"), F.col("_e.b.x").alias("x1"), F.col("_e.b.y").alias("y1"))


def _sized(edges: DataFrame) -> DataFrame:
    """_k, _size: the side of a key's cells, the power of two below the mean extent of its edges."""
    extent = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    return edges.groupBy("_k").agg(F.pow(F.lit(2.0), F.floor(F.log2(F.avg(extent)))).alias("_size"))


def _rows_of(low: Column, high: Column) -> Column:
    size = F.col("_size")
    return F.sequence(F.floor(F.least(low, high) / size - _REACH), F.floor(F.greatest(low, high) / size + _REACH))


def _columns_of(row: Column) -> Column:
    """The columns that an edge passes in a row of cells."""
    x0, y0, x1, y1, size = (F.col(c) for c in [*_ENDS, "_size"])
    low, high = F.least(y0, y1), F.greatest(y0, y1)
    at = lambda y: x0 + (x1 - x0) * ((F.least(F.greatest(y, low), high) - y0) / (y1 - y0))
    ends = F.when(y0 == y1, F.array(x0, x1)).otherwise(F.array(at(row * size), at((row + 1) * size)))
    return F.sequence(F.floor(F.array_min(ends) / size - _REACH), F.floor(F.array_max(ends) / size + _REACH))


def _cuts(edges: DataFrame, digits: int) -> DataFrame:
    """id, cuts: the places (share of the edge, x, y) where edges of a key meet."""
    cells = edges.join(_sized(edges), "_k").withColumn("_row", F.explode(_rows_of(F.col("y0"), F.col("y1"))))
    cells = cells.withColumn("_column", F.explode(_columns_of(F.col("_row")))).select("_k", "_row", "_column", "id", *_ENDS)
    a, b = cells.alias("a"), cells.alias("b")
    c = lambda name: F.col(name)
    over = lambda d: (F.least(c(f"a.{d}0"), c(f"a.{d}1")) <= F.greatest(c(f"b.{d}0"), c(f"b.{d}1")) + 10.0**-digits) & (F.least(c(f"b.{d}0"), c(f"b.{d}1")) <= F.greatest(c(f"a.{d}0"), c(f"a.{d}1")) + 10.0**-digits)
    same = (c("a._k") == c("b._k")) & (c("a._row") == c("b._row")) & (c("a._column") == c("b._column"))
    met = a.join(b, same & (c("a.id") < c("b.id")) & over("x") & over("y"))
    along = lambda e, d: c(f"{e}.{d}1") - c(f"{e}.{d}0")
    length = lambda e: F.sqrt(along(e, "x") * along(e, "x") + along(e, "y") * along(e, "y"))
    cross = along("a", "x") * along("b", "y") - along("a", "y") * along("b", "x")
    turn = F.when(F.abs(cross) > 1e-12 * length("a") * length("b"), cross)
    dx, dy = c("b.x0") - c("a.x0"), c("b.y0") - c("a.y0")
    ta, tb = (dx * along("b", "y") - dy * along("b", "x")) / turn, (dx * along("a", "y") - dy * along("a", "x")) / turn
    met = met.select(*(c(f"{e}.{n}").alias(f"{e}_{n}") for e in "ab" for n in ["id", *_ENDS]), ta.alias("ta"), tb.alias("tb"))
    # one place for both edges, so that it is the same to the last bit
    x = F.round(c("a_x0") + c("ta") * (c("a_x1") - c("a_x0")), digits) + 0.0
    y = F.round(c("a_y0") + c("ta") * (c("a_y1") - c("a_y0")), digits) + 0.0
    crossing = c("ta").between(0, 1) & c("tb").between(0, 1)
    cut = lambda e, t, x, y: F.struct(c(f"{e}_id").alias("id"), t.alias("t"), x.alias("x"), y.alias("y"))
    found = [F.when(crossing, cut("a", c("ta"), x, y)), F.when(crossing, cut("b", c("tb"), x, y))]
    for e, other in ("ab", "ba"):
        ex, ey = c(f"{e}_x1") - c(f"{e}_x0"), c(f"{e}_y1") - c(f"{e}_y0")
        for end in "01":  # a corner that lies on the other edge
            px, py = c(f"{other}_x{end}"), c(f"{other}_y{end}")
            qx, qy = px - c(f"{e}_x0"), py - c(f"{e}_y0")
            t = (qx * ex + qy * ey) / (ex * ex + ey * ey)
            near = F.abs(ex * qy - ey * qx) <= 10.0**-digits * F.sqrt(ex * ex + ey * ey)
            found.append(F.when(near & (t > 0) & (t < 1), cut(e, t, px, py)))
    rows = met.select(F.inline(F.filter(F.array(*found), lambda s: s.isNotNull())))
    return rows.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("t", "x", "y"))).alias("cuts"))


def split_edges(edges: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``edges`` (_k, part and ends) cut where edges of their key meet: _k, part and ends, the lower end first.

    A part's piece counts where the part has it an odd number of times, as two edges of one part take each other away.
    """
    up = (F.col("y0") < F.col("y1")) | ((F.col("y0") == F.col("y1")) & (F.col("x0") < F.col("x1")))
    ends = [F.when(up, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in zip(_ENDS, ["x1", "y1", "x0", "y0"], strict=True)]
    edges = settled(edges.select("_k", "part", *ends))
    # an edge that many parts have is cut once
    lone = settled(edges.select("_k", *_ENDS).distinct().withColumn("id", F.monotonically_increasing_id()))
    cut = edges.join(lone.join(_cuts(lone, digits), "id", "left"), ["_k", *_ENDS])
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    inner = F.transform(F.coalesce("cuts", F.array().cast("array<struct<t:double,x:double,y:double>>")), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    chain = cut.select("_k", "part", F.concat(F.array(point("x0", "y0")), inner, F.array(point("x1", "y1"))).alias("_c"))
    pieces = chain.select("_k", "part", F.explode(F.arrays_zip(F.col("_c").alias("a"), F.slice("_c", 2, F.size("_c")).alias("b"))).alias("_e")).where("_e.b IS NOT NULL AND _e.a <> _e.b")
    up = (F.col("_e.a.y") < F.col("_e.b.y")) | ((F.col("_e.a.y") == F.col("_e.b.y")) & (F.col("_e.a.x") < F.col("_e.b.x")))
    ends = [F.when(up, F.col(f"_e.{p}.{d}")).otherwise(F.col(f"_e.{q}.{d}")).alias(f"{d}{i}") for i, p, q in ((0, "a", "b"), (1, "b", "a")) for d in "xy"]
    return pieces.select("_k", "part", *ends).groupBy("_k", "part", *_ENDS).agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")


def _bounding(pieces: DataFrame) -> DataFrame:
    """id, _k and ends of the pieces with the union on one side only, led so that it is on their left."""
    sides = settled(pieces.select("_k", *_ENDS).distinct().withColumn("id", F.monotonically_increasing_id()))
    size = _sized(sides)
    # a level piece looks upwards, that is to the right with x and y exchanged
    level = F.col("y0") == F.col("y1")
    middle = lambda d: (F.col(f"{d}0") + F.col(f"{d}1")) / 2
    rays = sides.join(size, "_k").select("_k", "id", level.alias("_level"), F.when(level, middle("y")).otherwise(middle("x")).alias("_u"), F.when(level, middle("x")).otherwise(middle("y")).alias("_v"), F.struct(*_ENDS).alias("_own"), "_size")
    rays = rays.withColumn("_row", F.floor(F.col("_v") / F.col("_size"))).drop("_size")
    turned = lambda flag, ends: F.struct(F.lit(flag).alias("_flag"), *(F.col(c).alias(n) for c, n in zip(ends, ("u0", "v0", "u1", "v1"), strict=True)))
    both = pieces.select("_k", "part", F.struct(*_ENDS).alias("_piece"), F.explode(F.array(turned(False, _ENDS), turned(True, ["y0", "x0", "y1", "x1"]))).alias("_t")).where("_t.v0 <> _t.v1")
    walls = both.join(size, "_k").withColumn("_wall", F.explode(_rows_of(F.col("_t.v0"), F.col("_t.v1")))).drop("_size").withColumnRenamed("_k", "_key")
    v, t = F.col("_v"), F.col("_t")
    at = (t["u1"] - t["u0"]) * ((v - t["v0"]) / (t["v1"] - t["v0"])) + t["u0"]
    hit = rays.join(walls, (F.col("_k") == F.col("_key")) & (F.col("_row") == F.col("_wall")) & (F.col("_level") == t["_flag"]) & ((t["v0"] > v) != (t["v1"] > v)) & (F.col("_u") < at) & (F.col("_own") != F.col("_piece")))
    seen = hit.select("id", "part", F.lit(1).alias("_ray"), F.lit(0).alias("_mine"))
    mine = sides.join(pieces, ["_k", *_ENDS]).select("id", "part", F.lit(0).alias("_ray"), F.lit(1).alias("_mine"))
    by_part = seen.unionByName(mine).groupBy("id", "part").agg((F.sum("_ray") % 2 == 1).alias("_far"), (F.sum("_mine") % 2 == 1).alias("_edge"))
    covered = by_part.groupBy("id").agg(F.max("_far").alias("_far"), F.max(F.col("_far") != F.col("_edge")).alias("_near")).where("_far <> _near")
    kept = sides.join(covered, "id")
    forward = F.when(level, F.col("_far")).otherwise(F.col("_near"))
    return kept.select("id", "_k", *(F.when(forward, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in zip(_ENDS, ["x1", "y1", "x0", "y0"], strict=True)))


def _linked(darts: DataFrame) -> DataFrame:
    """id, ring, off: the least id of each dart's ring, and how many darts ahead it is."""
    angle = lambda x, y, px, py: F.atan2(F.col(y) - F.col(py), F.col(x) - F.col(px))
    ends = darts.select("_k", F.col("x1").alias("_x"), F.col("y1").alias("_y"), angle("x0", "y0", "x1", "y1").alias("_angle"), "id", F.lit(None).cast("long").alias("_out"))
    ends = ends.unionByName(darts.select("_k", F.col("x0").alias("_x"), F.col("y0").alias("_y"), angle("x1", "y1", "x0", "y0").alias("_angle"), F.lit(None).cast("long").alias("id"), F.col("id").alias("_out")))
    # clockwise from where a dart comes from lies the inside, up to the dart that leads on
    around = Window.partitionBy("_k", "_x", "_y").orderBy(F.col("_angle").desc())
    further = F.first("_out", ignorenulls=True).over(around.rowsBetween(1, Window.unboundedFollowing))
    first = F.first("_out", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    state = settled(ends.select("id", F.coalesce(further, first).alias("jump")).where("id IS NOT NULL AND jump IS NOT NULL").select("id", "jump", F.col("id").alias("ring"), F.lit(0).cast("long").alias("off")))
    for step in range(62):  # a ring of 2^n darts takes n + 1 rounds
        ahead = state.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("ring").alias("_ring"), F.col("off").alias("_off"))
        lower = F.col("_ring") < F.col("ring")
        joined = state.join(ahead, F.col("jump") == F.col("_id"))
        state = settled(joined.select("id", F.col("_jump").alias("jump"), F.least("ring", "_ring").alias("ring"), F.when(lower, F.col("_off") + (1 << step)).otherwise(F.col("off")).alias("off"), lower.alias("_moved")))
        if state.where("_moved").isEmpty():
            break
        state = state.drop("_moved")
    return state.select("id", "ring", "off")


def _corners(points: Column, digits: int) -> Column:
    """A closed ring of ``points`` without those on a straight way."""
    n = F.size(points)

    def turns(p: Column, i: Column) -> Column:
        a, b = F.get(points, (i + n - 1) % n), F.get(points, (i + 1) % n)
        ax, ay, bx, by = p["x"] - a["x"], p["y"] - a["y"], b["x"] - p["x"], b["y"] - p["y"]
        return F.abs(ax * by - ay * bx) > 10.0**-digits * F.sqrt((ax + bx) * (ax + bx) + (ay + by) * (ay + by))

    return F.filter(points, turns)


def _keyed(df: DataFrame, key: str, shapes: str) -> tuple[DataFrame, DataFrame]:
    """The keys with a number each, and the distinct shapes of each number."""
    named = settled(df.select(F.col(key).alias("_name"), F.col(shapes).cast(RINGS).alias("_shape")).distinct())
    keys = settled(named.select("_name").distinct().withColumn("_k", F.monotonically_increasing_id()))
    numbered = named.withColumn("part", F.monotonically_increasing_id()).withColumnRenamed("_name", "_n")
    return keys, settled(numbered.join(keys, F.col("_n").eqNullSafe(F.col("_name"))).select("_k", "part", "_shape"))


def united_areas(df: DataFrame, key: str, rings: str, digits: int = DIGITS) -> DataFrame:
    """``key`` and ``rings``: one area for each key (NULL is one), all of its rows' areas together.

    A row's area is what lies inside its rings by the even-odd rule; rings are closed where they are not.  The
    union's rings run counter-clockwise around it and clockwise around its holes, and keep only corners that turn.  A key
    without area has no rings.  Corners are put on a grid of ``digits``; slivers below it may vanish.
    """
    keys, parts = _keyed(df, key, rings)
    darts = settled(_bounding(settled(split_edges(_edges(parts, "_shape", True, digits), digits))))
    along = darts.join(_linked(darts), "id")
    order = F.struct(F.when(F.col("off") == 0, F.lit(None)).otherwise(-F.col("off")).alias("at"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    ringed = along.groupBy("_k", "ring").agg(F.transform(F.sort_array(F.collect_list(order)), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("_p"))
    ringed = ringed.select("_k", _corners(F.col("_p"), digits).alias("_p")).where("size(_p) > 2").select("_k", F.concat("_p", F.slice("_p", 1, 1)).alias("_p"))
    shapes = ringed.groupBy("_k").agg(F.array_sort(F.collect_list("_p")).alias("_rings"))
    return keys.join(shapes, "_k", "left").select(F.col("_name").alias(key), F.coalesce("_rings", F.array().cast(RINGS)).alias(rings))


def united_lines(df: DataFrame, key: str, paths: str, digits: int = DIGITS) -> DataFrame:
    """``key`` and ``paths``: the lines of each key (NULL is one) together, cut where they meet; stretches in common are there once."""
    keys, parts = _keyed(df, key, paths)
    edges = _edges(parts, "_shape", False, digits).withColumn("part", F.monotonically_increasing_id())
    pieces = split_edges(edges, digits).select("_k", *_ENDS).distinct()
    point = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))
    shapes = pieces.groupBy("_k").agg(F.array_sort(F.collect_list(F.array(point(0), point(1)))).alias("_paths"))
    return keys.join(shapes, "_k", "left").select(F.col("_name").alias(key), F.coalesce("_paths", F.array().cast(RINGS)).alias(paths))
