"""United areas and lines against plain Python: membership of points, area, length, and no inner edge."""

import random

import pytest

from storyatlas.operators import geometry, union


def holds(rings, x, y):
    edges = [(*a, *b) for r in rings for a, b in zip(r[:-1], r[1:])]
    return sum(1 for x0, y0, x1, y1 in edges if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) % 2 == 1


def frame(spark, rows, key="string"):
    return spark.createDataFrame(rows, f"k {key}, rings {geometry.RINGS}").repartition(3)


def united(spark, rows, key="string"):
    got = union.united_areas(frame(spark, rows, key), "k", "rings").collect()
    assert len(got) == len({r.k for r in got})
    return {r.k: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in got}


def area(rings):
    return sum(a[0] * b[1] - a[1] * b[0] for r in rings for a, b in zip(r[:-1], r[1:])) / 2


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def test_boxes_of_a_grid(spark):
    """Edges that lie upon one another, corners on edges, holes, and boxes within boxes."""
    rng = random.Random(2)
    rows, cells = [], {}
    for k in "abcd":
        for _ in range(40):
            x, y, w, h = (float(rng.randint(*r)) for r in ((0, 14), (0, 14), (1, 4), (1, 4)))
            rows.append((k, [box(x, y, w, h)]))
            cells.setdefault(k, set()).update((x + i, y + j) for i in range(int(w)) for j in range(int(h)))
    got = united(spark, rows)
    for k, rings in got.items():
        assert area(rings) == len(cells[k])
        sides = sum((x + dx, y + dy) not in cells[k] for x, y in cells[k] for dx, dy in ((0, 1), (0, -1), (1, 0), (-1, 0)))
        assert sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for r in rings for a, b in zip(r[:-1], r[1:])) == sides
        for r in rings:  # every corner turns
            assert all((a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(r[:-1], r[1:], [*r[2:], r[1]]))


def test_any_shapes(spark):
    """Points are inside the union if any part holds them; both sides of what is left are not."""
    rng = random.Random(9)
    rows = []
    for k in ("p", "q", None):
        for _ in range(14):
            x, y, s = rng.uniform(-6, 6), rng.uniform(-6, 6), rng.uniform(0.5, 4)
            ring = [(x + rng.uniform(-s, s), y + rng.uniform(-s, s)) for _ in range(rng.randint(3, 6))]  # crosses itself at times
            hole = [(x + rng.uniform(-s, s) / 3, y + rng.uniform(-s, s) / 3) for _ in range(3)]
            rows.append((k, [[*ring, ring[0]], [*hole, hole[0]]]))
    got = united(spark, rows)
    assert set(got) == {"p", "q", None}
    for k, rings in got.items():
        parts = [r for n, r in rows if n == k]
        inside = lambda x, y: any(holds(p, x, y) for p in parts)
        points = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(1500)]
        assert [holds(rings, *p) for p in points] == [inside(*p) for p in points]
        for a, b in ((a, b) for r in rings for a, b in zip(r[:-1], r[1:])):
            dx, dy = b[0] - a[0], b[1] - a[1]
            if abs(dx) + abs(dy) > 1e-3:
                x, y, e = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, 1e-6 / (dx * dx + dy * dy) ** 0.5
                assert inside(x - dy * e, y + dx * e) and not inside(x + dy * e, y - dx * e)


def test_awkward_areas(spark):
    unclosed = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rows = [("same", [box(0.0, 0.0, 1.0, 1.0)])] * 3 + [("open", [unclosed]), ("flat", [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]), ("none", None), ("none", []), ("point", [[(1.0, 1.0)]])]
    rows += [("ring", [box(0.0, 0.0, 3.0, 1.0)]), ("ring", [box(0.0, 2.0, 3.0, 1.0)]), ("ring", [box(0.0, 0.0, 1.0, 3.0)]), ("ring", [box(2.0, 0.0, 1.0, 3.0)]), ("corner", [box(0.0, 0.0, 1.0, 1.0)]), ("corner", [box(1.0, 1.0, 1.0, 1.0)]), ("gone", [box(0.0, 0.0, 1.0, 1.0), box(0.0, 0.0, 1.0, 1.0)])]
    got = united(spark, rows)
    assert {k: area(r) for k, r in got.items()} == {"same": 1, "open": 4, "flat": 0, "none": 0, "point": 0, "ring": 8, "corner": 2, "gone": 0}
    assert [len(got[k]) for k in ("same", "open", "flat", "none", "ring", "corner", "gone")] == [1, 1, 0, 0, 2, 2, 0]
    assert sorted(area([r]) for r in got["ring"]) == [-1, 9]  # a hole runs clockwise
    assert united(spark, []) == {}


@pytest.mark.parametrize("paths,length", [([[(0, 0), (4, 0)], [(1, 0), (6, 0)], [(2, -1), (2, 1)]], 8), ([[(0, 0), (3, 3)], [(3, 3), (0, 0)], [(1, 1), (2, 2), (2, 5)]], 3 + 3 * 2**0.5), ([[(1, 1)], []], 0)])
def test_lines_count_once(spark, paths, length):
    shape = [[(float(x), float(y)) for x, y in p] for p in paths]
    (row,) = union.united_lines(frame(spark, [("l", shape[:1]), ("l", shape[1:])]), "k", "rings").collect()
    edges = [(a, b) for p in row.rings for a, b in zip(p[:-1], p[1:])]
    assert sum(((a.x - b.x) ** 2 + (a.y - b.y) ** 2) ** 0.5 for a, b in edges) == pytest.approx(length)
    assert len({frozenset([(a.x, a.y), (b.x, b.y)]) for a, b in edges}) == len(edges)


def test_lines_clipped_by_any_shape(spark):
    """Every short stretch of a line is in a region's part of it if its middle is in the region."""
    rng = random.Random(4)
    shapes = []
    for i in range(12):
        x, y, s = rng.uniform(-6, 6), rng.uniform(-6, 6), rng.uniform(0.5, 5)
        ring = [(x + rng.uniform(-s, s), y + rng.uniform(-s, s)) for _ in range(rng.randint(3, 7))]
        shapes.append((f"r{i}", [[*ring, ring[0]]]))
    lines = [(f"l{i}", [[(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(rng.randint(2, 5))], [(1.0, 1.0)]]) for i in range(15)]
    ways = spark.createDataFrame([*lines, ("none", []), ("null", None)], f"line string, paths {geometry.RINGS}").repartition(3)
    regions = spark.createDataFrame([*shapes, ("null", None), ("flat", [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]])], f"k string, rings {geometry.RINGS}")
    got = {(r.line, r.k): r.paths for r in geometry.clipped_lines(ways, "line", "paths", regions, "k", "rings").collect()}
    n, met = 400, 0
    for name, paths in lines:
        for k, rings in shapes:
            length = 0.0
            for a, b in zip(paths[0][:-1], paths[0][1:]):
                size = ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
                length += size / n * sum(holds(rings, a[0] + (i + 0.5) / n * (b[0] - a[0]), a[1] + (i + 0.5) / n * (b[1] - a[1])) for i in range(0, n))
            mine = sum(((p.x - q.x) ** 2 + (p.y - q.y) ** 2) ** 0.5 for p, q in got.get((name, k), []))
            assert mine == pytest.approx(length, abs=0.1)
            met += mine > 0
    assert met > 20 and geometry.clipped_lines(ways, "line", "paths", regions.limit(0), "k", "rings").count() == 0


def test_trapezoids_of_rings_that_cross_themselves():
    rng = random.Random(1)
    steps = [-4 + 8 * (i + 0.5) / 60 for i in range(60)]
    for _ in range(60):
        ring = [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(rng.randint(3, 8))]
        ring.append(ring[0])
        t = geometry.trapezoids([[{"x": x, "y": y} for x, y in ring]])
        areas = (t[:, 1] - t[:, 0]) * (t[:, 4] - t[:, 2] + t[:, 5] - t[:, 3]) / 2
        assert (areas > -1e-9).all() and areas.sum() == pytest.approx(sum(holds([ring], x, y) for x in steps for y in steps) * (8 / 60) ** 2, abs=0.8)
