"""Polygons with holes cut to a box, against point tests."""

import math
import random

import pytest

from tidewake.operators.polygons import clip_with_holes, polygon_areas

RINGS = "feature_id long, polygon_no int, ring_no int, ring array<struct<x:double,y:double>>"


def _inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip([ring[-1], *ring[:-1]], ring):
        if (y1 <= y) != (y2 <= y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) < x:
            odd = not odd
    return odd


def _comb(teeth, rng):
    """A comb whose teeth point north, with holes in its teeth and back."""
    shell = [(0.0, 0.0), (2.0 * teeth, 0.0)]
    for i in reversed(range(teeth)):
        top = 8.0 + rng.uniform(0, 1)
        shell += [(2.0 * i + 1.7, 2.0), (2.0 * i + 1.4, top), (2.0 * i + 0.4, top), (2.0 * i + 0.2, 2.0)]
    holes = []
    for i in range(teeth):
        for y in range(3, 8):
            if rng.random() < 0.7:
                x, d = 2.0 * i + 0.9 + rng.uniform(-0.1, 0.1), rng.uniform(0.1, 0.3)
                holes.append([(x - d, y + 0.1), (x, y - d), (x + d, y + 0.2), (x, y + d + 0.1)])
        holes.append([(2.0 * i + 0.5, 0.5), (2.0 * i + 1.2, 0.7), (2.0 * i + 0.8, 1.4)])
    return [shell, *holes]


def _table(spark, polygons):
    return spark.createDataFrame([(f, p, n, ring) for (f, p), rings in polygons.items() for n, ring in enumerate(rings)], RINGS).repartition(3)


@pytest.mark.parametrize("box", [(-1.0, 4.05, 30.0, 6.3), (3.3, -1.0, 11.1, 20.0), (2.9, 2.5, 9.05, 7.15), (-5.0, -5.0, 50.0, 50.0), (4.8, 3.2, 5.1, 3.4)])
def test_points_of_cut_combs(spark, box):
    rng = random.Random(11)
    polygons = {(f, p): _comb(3 + 4 * f, rng) for f in range(3) for p in range(2)}
    parts = {}
    for r in clip_with_holes(_table(spark, polygons), box).collect():
        points = [(q.x, q.y) for q in r.ring]
        assert all(box[0] - 1e-9 <= x <= box[2] + 1e-9 and box[1] - 1e-9 <= y <= box[3] + 1e-9 for x, y in points)
        parts.setdefault((r.feature_id, r.polygon_no), {}).setdefault(r.part, {})[r.ring_no] = points
    for key, rings in polygons.items():
        for part in parts.get(key, {}).values():
            assert 0 in part  # no hole without its shell
        for _ in range(600):
            x, y = rng.uniform(box[0] + 1e-6, box[2] - 1e-6), rng.uniform(box[1] + 1e-6, box[3] - 1e-6)
            want = _inside(rings[0], x, y) and not any(_inside(h, x, y) for h in rings[1:])
            hits = [p for p in parts.get(key, {}).values() if _inside(p[0], x, y) and not any(_inside(h, x, y) for n, h in p.items() if n)]
            assert len(hits) == want, (key, x, y)
        for part in parts.get(key, {}).values():  # each hole lies in the shell of its own part
            for n, hole in part.items():
                assert n == 0 or _inside(part[0], (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)


def test_a_shell_with_holes_cut_in_two_parts(spark):
    u = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 2.0), (4.0, 2.0), (4.0, 3.0), (0.0, 3.0)]

    def square(x, y, d=0.25):
        return [(x, y), (x + d, y), (x + d, y + d), (x, y + d)]

    rings = [u, square(2.5, 0.25), square(3.0, 2.25), square(1.9, 0.25, 0.5), square(0.25, 0.25), square(2.5, 2.5)]
    table = _table(spark, {(1, 0): rings, (2, 0): [square(8.0, 8.0), square(8.1, 8.1, 0.05)], (3, 0): [None]})
    got = {(r.feature_id, r.holes, round(r.area, 9)) for r in polygon_areas(clip_with_holes(table, (2.0, -5.0, 5.0, 5.0))).collect()}
    # lower arm: one hole within, one that the side cuts to 0.4 by 0.5; upper arm: two holes
    assert got == {(1, 1, round(2.0 - 0.0625 - 0.2, 9)), (1, 2, 2.0 - 2 * 0.0625)}


def test_holes_at_the_seam_and_empty_tables(spark):
    ring = [(-170.0, -10.0), (170.0, -10.0), (170.0, 10.0), (-170.0, 10.0)]
    hole = [(-165.0, -5.0), (-155.0, -5.0), (-155.0, 5.0), (-165.0, 5.0)]
    table = _table(spark, {(1, 0): [ring, hole]})
    rows = polygon_areas(clip_with_holes(table, (150.0, -20.0, 210.0, 20.0), "360")).collect()
    assert {(r.box, r.holes, r.area) for r in rows} == {(0, 0, 400.0), (1, 1, 300.0)}
    assert clip_with_holes(table.where("false"), (0, 0, 1, 1)).count() == 0
    # a box within a hole has nothing of the polygon
    assert clip_with_holes(_table(spark, {(1, 0): [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [(1.0, 1.0), (8.0, 1.0), (8.0, 8.0), (1.0, 8.0)]]}), (3, 3, 4, 4)).count() == 0


def test_many_holes_in_a_ragged_shell(spark):
    """A shell of many edges that a box cuts in two, with holes on both sides."""
    n = 4000
    shell = [(50 + (40 + (i % 2)) * math.cos(2 * math.pi * i / n), 50 + (20 + (i % 2)) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    gap = [(49.0, 31.0), (51.0, 31.0), (51.0, 69.0), (49.0, 69.0)]  # nearly cuts it in two
    holes = [[(x, y), (x + 0.5, y), (x + 0.5, y + 0.5), (x, y + 0.5)] for x in (20.0, 30.0, 40.0, 60.0, 70.0, 75.0) for y in map(float, range(42, 58))]
    out = clip_with_holes(_table(spark, {(1, 0): [shell, gap, *holes]}), (0.0, 35.0, 100.0, 65.0))
    rows = sorted((r.holes, r.area) for r in polygon_areas(out).collect())
    assert [h for h, _ in rows] == [48, 48] and rows[0][1] == pytest.approx(rows[1][1], rel=0.02)
