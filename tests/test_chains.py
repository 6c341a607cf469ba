"""Lines from pieces, contour lines, row-bounded slices, the fold over pieces, hash trees."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.functions.geo import haversine_scalar
from tidewake.operators import grid, qc, segments
from tidewake.plans.chains import ordered_pieces, tile_chains
from tidewake.plans.ordered import bounded_slices
from tidewake.schema import QualityConfig

OBSERVED = "observation_id string, entity_id string, t long, latitude double, longitude double, observed_or_inferred string, source_order long"


def _observed(spark, rows):
    return spark.createDataFrame(rows, OBSERVED).withColumn("event_time", F.timestamp_seconds("t"))


# --- lines ------------------------------------------------------------------------------------


def _random_lines(seed):
    """Open lines and rings over shuffled point numbers; pieces with a tile each."""
    rng = random.Random(seed)
    numbers = list(range(1000, 4000))
    rng.shuffle(numbers)
    lines, pieces = [], []
    for length in (1, 1, 2, 3, 17, 400, 64):
        for closed in (False, True):
            points = [numbers.pop() for _ in range(length + (not closed))]
            lines.append((points, closed))
            stops = points[1:] + (points[:1] if closed else [])
            pieces += [(s, e, f"p{s}", i // rng.choice([1, 2, 5, 9])) for i, (s, e) in enumerate(zip(points, stops))]
    rng.shuffle(pieces)
    want = set()
    for points, closed in lines:
        n = len(points) - (not closed)
        shift = points.index(min(points)) if closed else 0
        name = min(points) if closed else points[0]
        want |= {(p, name, (i - shift) % n, n, closed) for i, p in enumerate(points[:n])}
    return pieces, want


@pytest.mark.parametrize("seed,tiles", [(1, 1), (2, 7), (3, 1000)])
def test_pieces_of_lines_and_rings_in_order(spark, seed, tiles):
    pieces, want = _random_lines(seed)
    df = spark.createDataFrame(pieces, "start long, stop long, label string, tile long").repartition(3)
    got = ordered_pieces(df, [F.pmod(F.xxhash64("start"), F.lit(tiles))])
    assert got.columns == ["start", "stop", "label", "tile", "line_id", "position", "total", "closed"]
    assert {(r.start, r.line_id, r.position, r.total, r.closed) for r in got.collect()} == want
    assert all(r.label == f"p{r.start}" for r in got.collect())


def test_no_pieces(spark):
    none = spark.createDataFrame([], "start long, stop long")
    assert ordered_pieces(none, [F.col("start")]).collect() == []


def test_tile_chains_of_a_ring_and_a_line():
    start, stop = np.array([5, 2, 9, 1]), np.array([2, 9, 5, 7])
    first, place, ring = tile_chains(start, stop)
    assert first.tolist() == [1, 1, 1, 3] and place.tolist() == [2, 0, 1, 0] and ring.tolist() == [True, True, True, False]


def _lines(spark, surface, levels, **options):
    cells = [(r, c, float(surface(r, c))) for r in range(40) for c in range(30)]
    df = spark.createDataFrame(cells, "grid_row long, grid_col long, value double").repartition(5)
    out = {}
    for v in grid.contour_lines(df, levels, **options).collect():
        out.setdefault((v.level, v.line_id, v.closed), []).append((v.position, v.x, v.y))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("tile", [3, 256])
def test_contours_of_a_hill_are_rings_and_of_a_slope_lines(spark, tile):
    hill = _lines(spark, lambda r, c: -((r - 18.3) ** 2 + (c - 14.7) ** 2), (-100.0, -25.0), tile=tile)
    assert sorted((level, closed) for level, _, closed in hill) == [(-100.0, True), (-25.0, True)]
    for (level, _, _), points in hill.items():
        assert [p for p, _, _ in points] == list(range(len(points))) and points[0][1:] == points[-1][1:]
        assert all(abs((y - 18.3) ** 2 + (x - 14.7) ** 2 + level) < 1.0 for _, x, y in points)
        steps = [max(abs(a[1] - b[1]), abs(a[2] - b[2])) for a, b in zip(points, points[1:])]
        assert max(steps) <= 1.0
        # the higher side on the left: with rows downwards, round a hill against the sun on the screen
        area = sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(points, points[1:]))
        assert area < 0
    slope = _lines(spark, lambda r, c: c + 0.01 * r, (10.7,), tile=tile)
    (key, points), = slope.items()
    assert key[2] is False and len(points) == 40  # a vertex a row, over all tiles
    assert [y for _, _, y in points] in (list(map(float, range(40))), list(map(float, range(39, -1, -1))))


def test_contour_lines_do_not_depend_on_tiles_and_stop_at_holes(spark):
    rng = random.Random(4)
    noise = {(r, c): rng.uniform(0, 10) for r in range(40) for c in range(30)}
    holes = {(r, c) for r in range(40) for c in range(30) if rng.random() < 0.04}

    def surface(r, c):
        return (float("nan") if (r + c) % 2 else -9999.0) if (r, c) in holes else noise[r, c]

    whole = _lines(spark, surface, (3.0, 5.0, 7.5), nodata=-9999.0)
    assert _lines(spark, surface, (3.0, 5.0, 7.5), nodata=-9999.0, tile=4) == whole
    assert any(k[2] for k in whole) and any(not k[2] for k in whole)
    assert all(x == x and y == y for points in whole.values() for _, x, y in points)
    # every piece of the squares is in exactly one line
    cells = spark.createDataFrame([(r, c, surface(r, c)) for r in range(40) for c in range(30)], "grid_row long, grid_col long, value double")
    pieces = {(p.level, p.x1, p.y1, p.x2, p.y2) for p in grid.contours(cells, (3.0, 5.0, 7.5), -9999.0).collect()}
    drawn = [(k[0], *a[1:], *b[1:]) for k, points in whole.items() for a, b in zip(points, points[1:])]
    assert len(drawn) == len(set(drawn)) and set(drawn) == pieces


def test_cells_without_a_number(spark):
    nan, inf = float("nan"), float("inf")
    cells = spark.createDataFrame([(0, 0, 10.0), (0, 1, -9999.0), (1, 0, nan), (1, 1, 10.0), (2, 0, 30.0), (2, 1, inf), (3, 0, None), (3, 1, 20.0)],
                                  "grid_row long, grid_col long, value double")
    got = grid.downsample_bilinear(cells, 2.0, 2, 4, nodata=-9999.0).collect()
    assert {(r.grid_row, r.grid_col): r.value for r in got} == {(0, 0): 10.0, (1, 0): 25.0}
    assert grid.density_quantiles(cells).first()["q50"] == 15.0
    assert {r.ramp for r in grid.density_ramp(cells).collect()} == {"Lower", "Highest"}
    assert grid.contours(cells, (15.0,), -9999.0).count() == 0


# --- slices -----------------------------------------------------------------------------------


@pytest.mark.parametrize("times", ["spread", "one instant", "bunched"])
def test_a_full_slice_is_cut_into_parts_in_order(spark, times):
    rng = random.Random(8)
    moment = {"spread": lambda i: rng.uniform(0, 86000), "one instant": lambda i: 500.0, "bunched": lambda i: 500.0 + (i % 7) * 1e-6}[times]
    rows = [("v", i, moment(i)) for i in range(4000)] + [("w", 5000 + i, i * 40_000.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o long, t double").withColumn("at", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    got = bounded_slices(df, "k", "at", "o", 86_400, 300).collect()
    assert len(got) == len(rows)
    ordered = sorted((r for r in got if r.k == "v"), key=lambda r: (r["at"], r.o))
    numbers = [r.slice for r in ordered]
    sizes = [numbers.count(n) for n in sorted(set(numbers))]
    assert numbers == sorted(numbers) and len(sizes) >= 10 and max(sizes) < 900
    assert {r.slice >> 20 for r in got if r.k == "w"} == {i * 40_000 // 86_400 for i in range(50)}
    # below the limit, slices are those of time
    assert {r.slice & 0xFFFFF for r in bounded_slices(df, "k", "at", "o", 86_400, 10_000).collect()} == {0}


# --- fold -------------------------------------------------------------------------------------


def _tested(rows, limit):
    """The sequential definition: pairs of (row, reference) and the rows that fail."""
    pairs, last = [], None
    for r in sorted(rows, key=lambda r: (r[2], r[6])):
        if r[5] == "GUESS":
            last = None
            continue
        if last is None or r[2] <= last[2]:
            last = r
            continue
        d = haversine_scalar(last[4], last[3], r[4], r[3])
        pairs.append((r[6], last[2], round(d, 3)))
        if not d / (r[2] - last[2]) * qc.KNOTS_PER_MPS > limit:
            last = r
    return pairs


def _ships(kind, n=1500):
    rng = random.Random(kind)
    rows, lat = [], 10.0
    for i in range(n):
        lat += rng.uniform(-0.001, 0.001)
        if kind == "one place, jumps":
            y = lat if rng.random() > 0.3 else rng.uniform(-80, 80)
        elif kind == "two ships":
            y = lat + (40.0 if i % 2 else 0.0)
        elif kind == "three ships by chance":
            y = lat + rng.choice([0.0, 25.0, 50.0])
        else:  # ever farther away: each reference lasts for one row
            y = -80.0 + (i * 37 % 1600) * 0.1
        rows.append((f"o{i}", "v", i * 60, y, 120.0, "GUESS" if kind == "one place, jumps" and rng.random() < 0.01 else "OBSERVED", i))
    return rows


@pytest.mark.parametrize("kind", ["one place, jumps", "two ships", "three ships by chance", "everywhere"])
def test_fold_of_one_ship_that_has_all_rows(spark, kind):
    """All rows in one vessel and mostly in one day: no piece holds more than its share of them."""
    rows = _ships(kind)
    config = QualityConfig(distance="haversine", slice_rows=100)
    got = qc.tested_pairs(_observed(spark, rows), config).collect()
    assert sorted((r.source_order, int(r.prev_time.timestamp()), round(r.distance_m, 3)) for r in got) == sorted(_tested(rows, config.max_speed_knots))


def test_pieces_of_the_fold_are_bounded_and_rounds_few(spark, monkeypatch):
    seen = []
    fold = qc._fold

    def counted(config):
        seen.append(1)
        return fold(config)

    monkeypatch.setattr(qc, "_fold", counted)
    config = QualityConfig(distance="haversine", slice_rows=100)
    rows = _observed(spark, _ships("two ships", 3000))
    sizes = bounded_slices(rows, "entity_id", "event_time", "source_order", 86_400, 100).groupBy("slice").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 300
    qc.tested_pairs(rows, config).count()
    assert len(seen) <= 5  # not one round a piece


# --- hash tree --------------------------------------------------------------------------------


def _tree(ids, width):
    level = [hashlib.sha256("|".join(ids[i : i + width]).encode()).hexdigest() for i in range(0, len(ids), width)]
    if len(level) > 1:
        level = [hashlib.sha256("|".join(level[i : i + width]).encode()).hexdigest() for i in range(0, len(level), width)]
    return level[0] if len(level) == 1 else hashlib.sha256("|".join(level).encode()).hexdigest()


@pytest.mark.parametrize("points", [2, 4, 5, 16, 17, 150])
def test_segment_id_is_a_hash_tree_over_places(spark, monkeypatch, points):
    monkeypatch.setattr(segments, "TREE_WIDTH", 4)
    rows = [(f"o{i:04d}", "v", i * 1800, 10.0 + i * 0.001, 120.0, "OBSERVED", i) for i in range(points)]
    rows += [(f"q{i}", "v", 3_000_000 + i * 60, 10.0, 120.0, "OBSERVED", 9000 + i) for i in range(9)]
    df = _observed(spark, rows).withColumns({"source_type": F.lit("AIS"), "source_name": F.lit("s"), "actor_type": F.lit("PLAN")})
    want = {(f"seg-{_tree([f'o{i:04d}' for i in range(points)], 4)[:16]}", points), (f"seg-{_tree([f'q{i}' for i in range(9)], 4)[:16]}", 9)}
    for config in (QualityConfig(), QualityConfig(slice_seconds=7200), QualityConfig(slice_rows=10)):
        for parts in (1, 5):
            out = segments.track_segments(df.repartition(parts), config).collect()
            assert {(s.segment_id, s.point_count) for s in out} == want
