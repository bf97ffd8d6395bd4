"""Planar geometry on nested arrays, and samplers that depend on seed and id alone.

A region is an array of rings, a ring an array of struct(x, y); a point is
inside if a ray crosses the rings an odd number of times, which also holds for
parts and holes.  A line is an array of paths.  Work on rows is JVM-side; only
regions are prepared in Python, where each is cut into trapezoids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"
#: Pieces of regions that are shipped to every task at most; more are joined by shuffle.
SHIPPED = 500_000
#: Share of a piece's sides that points keep away from its edges.
_MARGIN = 1e-9
METRES_A_DEGREE = 111_000.0


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on ``seed`` and ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def ring_edges(rings: Column) -> Column:
    """All edges (x0, y0, x1, y1) of the rings."""
    edge = lambda ring: F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0))), lambda i: i + 1 < F.size(ring)),
        lambda i: F.struct(F.get(ring, i)["x"].alias("x0"), F.get(ring, i)["y"].alias("y0"), F.get(ring, i + 1)["x"].alias("x1"), F.get(ring, i + 1)["y"].alias("y1")),
    )
    return F.flatten(F.transform(rings, edge))


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Whether (x, y) is inside, by the even-odd rule."""
    crosses = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])
    return F.size(F.filter(ring_edges(rings), lambda e: F.when((e["y0"] > y) != (e["y1"] > y), crosses(e)).otherwise(False))) % 2 == 1


def bounds(rings: Column) -> Column:
    xs = F.transform(F.flatten(rings), lambda p: p["x"])
    ys = F.transform(F.flatten(rings), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


_PIECE = "struct<y0:double,y1:double,l0:double,l1:double,r0:double,r1:double>"
PIECES = f"piece long, pieces long, share double, own {_PIECE}, other {_PIECE}"


def trapezoids(rings: list) -> np.ndarray:
    """Rows (y0, y1, left and right x at y0 and y1): what is inside the rings, cut at the heights of their corners."""
    pairs = [(a["x"], a["y"], b["x"], b["y"]) for ring in rings for a, b in zip(ring[:-1], ring[1:], strict=True)]
    edges = np.array([e for e in pairs if e[1] != e[3]], float).reshape(-1, 4)
    edges = np.where((edges[:, 1] > edges[:, 3])[:, None], edges[:, [2, 3, 0, 1]], edges)  # upwards
    heights, out = np.unique(edges[:, [1, 3]]), []
    slabs = list(zip(heights[:-1], heights[1:], strict=True))
    while slabs:
        low, high = slabs.pop()
        e = edges[(edges[:, 1] <= low) & (edges[:, 3] >= high)]
        slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
        x0, x1 = e[:, 0] + slope * (low - e[:, 1]), e[:, 0] + slope * (high - e[:, 1])
        order = np.lexsort((x0 + x1, x0))
        x0, x1, slope = x0[order], x1[order], slope[order]
        crossed = np.flatnonzero(x1[:-1] > x1[1:])
        at = low + (x0[crossed + 1] - x0[crossed]) / (slope[crossed] - slope[crossed + 1])
        at = at[(at > low) & (at < high)]
        if len(at):  # rings that cross themselves or one another: cut there as well
            cuts = np.unique(np.concatenate([[low, high], at]))
            slabs += zip(cuts[:-1], cuts[1:], strict=True)
            continue
        order = np.argsort(x0 + x1, kind="stable")  # at a crossing both ends of a slab may be off by a bit, its middle tells
        x0, x1 = x0[order], x1[order]
        out += [(low, high, x0[i], x1[i], x0[i + 1], x1[i + 1]) for i in range(0, len(x0) - 1, 2)]
    return np.array(sorted(out), float).reshape(-1, 6)


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a uniform choice of a place: how often its own item counts, and the item that counts else."""
    scaled = weights / weights.sum() * len(weights)
    share, other = np.ones(len(weights)), np.arange(len(weights))
    small, large = [i for i, s in enumerate(scaled) if s < 1], [i for i, s in enumerate(scaled) if s >= 1]
    while small and large:
        i, j = small.pop(), large.pop()
        share[i], other[i] = scaled[i], j
        scaled[j] -= 1 - scaled[i]
        (small if scaled[j] < 1 else large).append(j)
    return share, other


def region_pieces(regions: DataFrame, key: str, rings: str) -> DataFrame:
    """``key`` and the region's pieces, each with the share of draws that it keeps and the piece that takes the others.

    A uniform draw of a piece and then of what counts is a draw by area.  A region without
    area is one piece: its first corner.  ``key`` names a region.
    """
    fields = [f.split(":")[0] for f in _PIECE[len("struct<") : -1].split(",")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shape in enumerate(batch.column("rings").to_pylist()):
                shape = [r for r in shape if r]
                rows = trapezoids(shape)
                area = (rows[:, 1] - rows[:, 0]) * (rows[:, 4] - rows[:, 2] + rows[:, 5] - rows[:, 3])
                rows, area = rows[area > 0], area[area > 0]
                if not len(rows) and shape:
                    x, y = shape[0][0]["x"], shape[0][0]["y"]
                    rows, area = np.array([(y, y, x, x, x, x)], float), np.ones(1)
                if len(rows):
                    share, other = alias_table(area)
                    n = len(rows)
                    structs = [pa.StructArray.from_arrays([pa.array(c) for c in r.T.copy()], fields) for r in (rows, rows[other])]
                    cols = [batch.column("key").take(pa.array([i] * n)), pa.array(np.arange(n)), pa.array(np.full(n, n)), pa.array(share), *structs]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "piece", "pieces", "share", "own", "other"])

    kind = dict(regions.dtypes)[key]
    rows = regions.select(F.col(key).alias("key"), F.col(rings).alias("rings")).where("key IS NOT NULL AND rings IS NOT NULL")
    return rows.mapInArrow(cut, f"key {kind}, {PIECES}").withColumnRenamed("key", key)


def points_in_regions(rows: DataFrame, key: str, pieces: DataFrame, point: str, seed: int, *parts: Column) -> DataFrame:
    """``rows`` with a uniform point inside the region ``key`` as struct(x, y), NULL without such a region.

    ``pieces`` come from ``region_pieces``, and their key has the same name.  The point depends on
    ``seed``, ``parts`` and the region alone.  Rows carry no shape: they meet one piece of it.
    """
    pieces = pieces.select(F.col(key).alias("_key"), "piece", "pieces", "share", "own", "other")
    counts = pieces.groupBy("_key").agg(F.max("pieces").alias("_pieces"))
    total = pieces.count()
    ship = F.broadcast if total <= SHIPPED else (lambda df: df)
    drawn = rows.join(ship(counts), F.col(key) == F.col("_key"), "left").drop("_key")
    drawn = drawn.withColumn("_piece", F.floor(uniform(seed, *parts, F.lit(0)) * F.col("_pieces")))
    met = drawn.join(ship(pieces), (F.col(key) == F.col("_key")) & (F.col("_piece") == F.col("piece")), "left")
    met = met.withColumn("_at", F.when(uniform(seed, *parts, F.lit(1)) < F.col("share"), F.col("own")).otherwise(F.col("other")))
    within = lambda i: _MARGIN + uniform(seed, *parts, F.lit(i)) * (1 - 2 * _MARGIN)
    at = lambda c: F.col(f"_at.{c}")
    w0, w1 = at("r0") - at("l0"), at("r1") - at("l1")
    # the height at which the share ``u`` of the trapezoid is passed
    u = within(2)
    root = w0 + F.sqrt(w0 * w0 + u * (w1 * w1 - w0 * w0))
    met = met.withColumn("_t", F.when(root > 0, u * (w0 + w1) / root).otherwise(u))
    left = at("l0") + F.col("_t") * (at("l1") - at("l0"))
    wide = w0 + F.col("_t") * (w1 - w0)
    xy = F.struct((left + within(3) * wide).alias("x"), (at("y0") + F.col("_t") * (at("y1") - at("y0"))).alias("y"))
    return met.withColumn(point, F.when(F.col("_at").isNotNull(), xy)).drop("_key", "_pieces", "_piece", "piece", "pieces", "share", "own", "other", "_at", "_t")


def point_on_line(paths: Column, u: Column) -> Column:
    """The point at the share ``u`` of the length of all paths, as struct(x, y)."""
    size = lambda e: F.sqrt((e["x1"] - e["x0"]) ** 2 + (e["y1"] - e["y0"]) ** 2)
    edges = F.filter(F.transform(ring_edges(paths), lambda e: F.struct(e["x0"].alias("x0"), e["y0"].alias("y0"), e["x1"].alias("x1"), e["y1"].alias("y1"), size(e).alias("len"))), lambda e: e["len"] > 0)
    goal = u * F.aggregate(edges, F.lit(0.0), lambda a, e: a + e["len"])
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def step(s: Column, e: Column) -> Column:
        share = (goal - s["run"]) / e["len"]
        here = s["x"].isNull() & (share <= 1)
        return F.struct((s["run"] + e["len"]).alias("run"), F.when(here, e["x0"] + share * (e["x1"] - e["x0"])).otherwise(s["x"]).alias("x"), F.when(here, e["y0"] + share * (e["y1"] - e["y0"])).otherwise(s["y"]).alias("y"))

    end = F.aggregate(edges, start, step)
    last = F.try_element_at(edges, F.lit(-1))
    return F.when(F.size(edges) > 0, F.struct(F.coalesce(end["x"], last["x1"]).alias("x"), F.coalesce(end["y"], last["y1"]).alias("y")))


def clipped_lines(lines: DataFrame, line: str, paths: str, regions: DataFrame, region: str, rings: str) -> DataFrame:
    """``line``, ``region`` and ``paths``: the parts of each line within each region that it enters.

    Segments meet the regions' trapezoids in rows of their mean height, so that the rows grow with both and no pair
    is looked at elsewhere; a segment is cut by an expression.  What runs along the left or lower edge of
    a region is in it, along the right or upper edge is not.  Both keys name one row each.
    """
    shapes = region_pieces(regions, region, rings).where("own.y1 > own.y0").select(region, F.col("own").alias("_t"))
    segments = lines.where(F.col(line).isNotNull()).select(line, F.posexplode(ring_edges(F.col(paths))).alias("_at", "_s")).where("_s.x0 <> _s.x1 OR _s.y0 <> _s.y1")
    heights = segments.select(F.abs(F.col("_s.y1") - F.col("_s.y0")).alias("h")).unionByName(shapes.select((F.col("_t.y1") - F.col("_t.y0")).alias("h")))
    size = F.lit(heights.agg(F.avg("h")).first()[0] or 1.0)
    s, t = F.col("_s"), F.col("_t")
    span = lambda low, high: F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))
    low, high = F.least("_s.y0", "_s.y1"), F.greatest("_s.y0", "_s.y1")
    met = segments.withColumn("_row", span(low, high)).join(shapes.withColumn("_band", span(F.col("_t.y0"), F.col("_t.y1"))), F.col("_row") == F.col("_band"))
    # a pair counts in the first row that both reach
    met = met.where((low <= t["y1"]) & (high >= t["y0"]) & (F.col("_row") == F.floor(F.greatest(low, t["y0"]) / size)))
    dx, dy, tall = s["x1"] - s["x0"], s["y1"] - s["y0"], t["y1"] - t["y0"]
    lean = lambda side: (t[f"{side}1"] - t[f"{side}0"]) / tall
    beyond = lambda side: (s["x0"] - t[f"{side}0"] - lean(side) * (s["y0"] - t["y0"]), dx - lean(side) * dy)
    left, right = beyond("l"), beyond("r")
    # start + share * rise >= 0 on the inner side of each; the last two do not hold their own edge
    walls = [(s["y0"] - t["y0"], dy, True), (*left, True), (t["y1"] - s["y0"], -dy, False), (-right[0], -right[1], False)]
    met = met.withColumn("_w", F.array(*(F.struct(a.alias("start"), b.alias("rise"), F.lit(own).alias("own")) for a, b, own in walls)))
    level = F.forall("_w", lambda w: (w["rise"] != 0) | (w["start"] > 0) | (w["own"] & (w["start"] == 0)))
    share = lambda up: F.transform(F.filter("_w", lambda w: (w["rise"] > 0) if up else (w["rise"] < 0)), lambda w: -w["start"] / w["rise"])
    start, end = F.array_max(F.concat(F.array(F.lit(0.0)), share(True))), F.array_min(F.concat(F.array(F.lit(1.0)), share(False)))
    cut = met.where(level).select(line, region, "_at", "_s", start.alias("_from"), end.alias("_to")).where("_from < _to")
    at = lambda c: F.when(F.col(c) == 1, F.struct(s["x1"].alias("x"), s["y1"].alias("y"))).otherwise(F.struct((s["x0"] + F.col(c) * dx).alias("x"), (s["y0"] + F.col(c) * dy).alias("y")))
    parts = F.array_sort(F.collect_list(F.struct("_at", "_from", "_to", F.array(at("_from"), at("_to")).alias("_p"))))
    return cut.groupBy(line, region).agg(F.transform(parts, lambda q: q["_p"]).alias(paths))


def spread_coincident(df: DataFrame, x: str, y: str, id_col: str, radius_m: float = 120.0, seed: int = 7, digits: int = 6) -> DataFrame:
    """Points that share a coordinate moved to random places of a disk; single ones stay."""
    # counted by aggregation and joined, as very many points may share one place
    crowds = df.groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n")).where("_n > 1")
    r = F.sqrt(uniform(seed, F.col(x), F.col(y), F.col(id_col), F.lit(0)))
    angle = uniform(seed, F.col(x), F.col(y), F.col(id_col), F.lit(1)) * (2 * math.pi)
    dy = F.lit(radius_m / METRES_A_DEGREE)
    dx = F.lit(radius_m) / (F.lit(METRES_A_DEGREE) * F.cos(F.radians(F.col(y))))
    moved = df.join(crowds, F.col(x).eqNullSafe(F.col("_x")) & F.col(y).eqNullSafe(F.col("_y")), "left").withColumn("_together", F.col("_n").isNotNull()).drop("_x", "_y", "_n")
    return moved.withColumns({x: F.when(F.col("_together"), F.round(F.col(x) + r * dx * F.cos(angle), digits)).otherwise(F.col(x)), y: F.when(F.col("_together"), F.round(F.col(y) + r * dy * F.sin(angle), digits)).otherwise(F.col(y))}).drop("_together")


def rounded(rings: Column, digits: int) -> Column:
    """Coordinates [x, y] rounded, as in a coordinate array."""
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))))
