"""Boxes, lines, polygons, grids and audits."""

import math

import pytest
from pyspark.sql import functions as F

from tidewake.operators import audit, filters, grid, vectors


def test_longitude_edges(spark):
    from tidewake.functions.geo import lon_to_180, lon_to_360

    df = spark.createDataFrame([(v,) for v in (180.0, -180.0, 190.0, 540.0, -190.0, 360.0)], "x double")
    got = [tuple(r) for r in df.select(lon_to_180(F.col("x")), lon_to_360(F.col("x"))).collect()]
    assert got == [(180.0, 180.0), (-180.0, 180.0), (-170.0, 190.0), (180.0, 180.0), (170.0, 170.0), (0.0, 0.0)]


def test_buffers_and_custom_extents(spark):
    rows = [("polar", 184.0, 64.0, 200.0, 83.0, "360", "regional"), ("pacific", 100.0, -60.0, 300.0, 70.0, "360", "theatre"),
            ("local", 120.7, 20.5, 125.3, 26.4, "180", "local")]
    df = spark.createDataFrame(rows, "region string, xmin double, ymin double, xmax double, ymax double, convention string, profile string")
    got = {r.region: (r.bxmin, r.bymin, r.bxmax, r.bymax) for r in filters.buffered_bbox(df).collect()}
    assert got["polar"] == pytest.approx((140.0, 58.3, 244.0, 88.7))
    assert got["pacific"] == (0.0, -89.0, 360.0, 89.0)
    assert got["local"] == pytest.approx((119.2, 19.0, 126.8, 27.9))


def test_regions_of_one_box_meet_a_point_once(spark, monkeypatch):
    """Equal boxes are joined as lists, and the points of one file are joined by many tasks."""
    monkeypatch.setattr(filters, "LIST_ROWS", 7)
    points = spark.createDataFrame([(i, 1.0 if i % 2 else 50.0, 2.0, "p") for i in range(40)], "o long, longitude double, latitude double, kind string").coalesce(1)
    regions = spark.createDataFrame(
        [(f"r{i}", 0.0, 0.0, 3.0 + i % 2, 9.0, "180") for i in range(100)] + [("far", 49.0, 0.0, 51.0, 9.0, "360")],
        "region string, xmin double, ymin double, xmax double, ymax double, convention string")
    out = filters.assign_regions(points, regions)
    assert out.columns == ["o", "longitude", "latitude", "kind", *regions.columns]
    got = [(r.o, r.region) for r in out.collect()]
    assert sorted(got) == sorted(
        [(o, f"r{i}") for o in range(1, 40, 2) for i in range(100)] + [(o, "far") for o in range(0, 40, 2)])
    assert "RoundRobinPartitioning(4)" in out._jdf.queryExecution().toString()


def test_region_assignment_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(800)]
    regions = []
    for i in range(60):
        conv = rng.choice(["180", "360"])
        low = -180 if conv == "180" else 0
        x, y = rng.uniform(low, low + 330), rng.uniform(-90, 70)
        regions.append((f"r{i}", x, y, min(low + 360.0, x + rng.uniform(0, 200)), y + rng.uniform(0, 20), conv))
    p = spark.createDataFrame(points, "source_order long, longitude double, latitude double")
    r = spark.createDataFrame(regions, "region string, xmin double, ymin double, xmax double, ymax double, convention string")
    got = {(x.source_order, x.region) for x in filters.assign_regions(p, r).collect()}
    want = {
        (o, name) for o, lon, lat in points for name, x0, y0, x1, y1, conv in regions
        if y0 <= lat <= y1 and x0 <= (lon % 360 if conv == "360" else lon) <= x1
    }
    assert got == want


def _shuffled_rows(node):
    """Rows that the exchanges of an executed plan have written."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _shuffled_rows(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled_rows(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled_rows(node.children().apply(i)) for i in range(node.children().size()))


def test_points_and_regions_move_but_not_their_pairs(spark):
    """Without broadcasts, exchanges carry rows in proportion to points and regions."""
    points = spark.range(500).select("id", (F.col("id") % 7 * 0.01).alias("longitude"), (F.col("id") % 5 * 0.01).alias("latitude"))
    regions = spark.range(200).select(
        F.concat(F.lit("r"), F.col("id")).alias("region"), (-1 - F.col("id") * 0.001).alias("xmin"), F.lit(-1.0).alias("ymin"),
        F.lit(1.0).alias("xmax"), F.lit(1.0).alias("ymax"), F.lit("180").alias("convention"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = filters.assign_regions(points, regions)
        assert len(out.select("id", "region").distinct().collect()) == 500 * 200
        assert len(out.collect()) == 500 * 200
        assert _shuffled_rows(out._jdf.queryExecution().executedPlan()) < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("joined", ["-1", "10m"])
def test_crowded_cells_and_odd_boxes_equal_brute_force(spark, monkeypatch, joined):
    """Cells are dealt into many tiles; boxes without end, of one point, turned round, or with a missing bound."""
    from collections import Counter

    for name, value in (("LIST_ROWS", 2), ("BLOCK_POINTS", 3), ("TILE_POINTS", 5), ("TILE_REGIONS", 4)):
        monkeypatch.setattr(filters, name, value)
    inf, nan = math.inf, math.nan
    points = [(i, 120 + i % 9 * 0.125, 20 + i % 4 * 0.25) for i in range(120)] + [(7, 120.0, 20.0)] * 12 + [
        (200, None, 1.0), (201, 1.0, None), (202, nan, 20.0), (203, 120.0, nan), (204, -0.0, 0.0), (205, -60.0, 95.0), (206, 900.0, 20.0), (207, inf, -inf)]
    boxes = [(120.0, 20.0, 120.5, 20.5, "180")] * 9 + [
        (120.0, 20.0, 120.0, 20.0, "360"), (-180.0, -90.0, 180.0, 90.0, "180"), (0.0, -90.0, 360.0, 90.0, "360"),
        (-inf, -inf, inf, inf, "180"), (119.0, 19.0, nan, 21.0, "180"), (119.0, nan, 121.0, nan, "360"), (121.0, 19.0, 119.0, 21.0, "180"),
        (None, 19.0, 121.0, 21.0, "180"), (119.0, 19.0, 121.0, 21.0, "270"), (119.0, 19.0, 121.0, 21.0, None), (0.0, 0.0, 0.0, 0.0, "180"),
        (-1.0, 0.0, -0.0, 1e-9, "180"), (800.0, 0.0, 1000.0, 30.0, "180"), (-180.0, 19.99, 180.0, 20.01, "180"), (299.0, 94.0, 301.0, 96.0, "360")]
    regions = [(f"r{i}", *b) for i, b in enumerate(boxes)]

    def inside(v, low, high):
        low, v, high = ((math.isnan(a), a) if not math.isnan(a) else (True, 0.0) for a in (low, v, high))
        return low <= v <= high

    want = Counter(
        (o, r) for o, x, y in points for r, x0, y0, x1, y1, conv in regions
        if None not in (x, y, x0, y0, x1, y1) and conv in ("180", "360")
        and inside(x % 360 if conv == "360" and math.isfinite(x) else nan if conv == "360" else x, x0, x1) and inside(y, y0, y1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)
    try:
        p = spark.createDataFrame(points, "source_order long, longitude double, latitude double").repartition(3)
        r = spark.createDataFrame(regions, "region string, xmin double, ymin double, xmax double, ymax double, convention string")
        assert Counter((x.source_order, x.region) for x in filters.assign_regions(p, r).collect()) == want
        assert filters.assign_regions(p, r.limit(0)).collect() == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_wide_polygon_in_two_parts(spark):
    ring = [(-170.0, -10.0), (170.0, -10.0), (170.0, 10.0), (-170.0, 10.0)]
    df = spark.createDataFrame([(1, 0, ring)], "feature_id int, ring_no int, ring array<struct<x:double,y:double>>")
    rows = vectors.clip_polygons(df, (150.0, -20.0, 210.0, 20.0), "360").select("box", "ring", vectors.ring_area(F.col("ring")).alias("a")).collect()
    assert {r.box: r.a for r in rows} == {0: 400.0, 1: 400.0}
    assert all(150.0 <= p.x <= 210.0 for r in rows for p in r.ring)
    with pytest.raises(ValueError):
        vectors.clip_polygons(df, (0, 0, 1, 1), "270")


def test_line_leaves_and_reenters(spark):
    line = [(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10)])]
    v = spark.createDataFrame(line, "feature_id long, seq long, x double, y double")
    rows = vectors.clip_lines(v, (-1, -1, 5, 11)).orderBy("part", "seq", "sub").collect()
    assert [(r.part, r.x, r.y) for r in rows] == [(1, 0, 0), (1, 5, 0), (2, 5, 10), (2, 0, 10)]


def test_sliced_scans_equal_plain_windows(spark, monkeypatch):
    """Tiny slices: predecessors, counts and sums carry over every slice border."""
    import random

    from tidewake.plans import ordered

    rng = random.Random(3)
    rows = [(k, i, rng.randint(0, 5)) for k in ("a", "b") for i in rng.sample(range(400), 150)]
    df = spark.createDataFrame(rows, "k string, o long, v long").withColumn("slice", ordered.order_slice(F.col("o"), 7))
    out = ordered.previous_and_count(
        df, ["k"], "slice", "o", F.struct("o", "v"), lambda p, c: p.isNull() | (p["v"] > c["v"]), "p", "n")
    out = ordered.running_sum(out, ["k"], "slice", "o", "v", "s", total="t")
    got = {(r.k, r.o): (r.p and r.p.o, r.n, r.s, r.t) for r in out.collect()}
    for k in ("a", "b"):
        mine, prev, n, s = sorted(r for r in rows if r[0] == k), None, 0, 0
        total = sum(r[2] for r in mine)
        for r in mine:
            n += prev is None or prev[2] > r[2]
            s += r[2]
            assert got[(k, r[1])] == (prev and prev[1], n, s, total)
            prev = r


def test_antimeridian_crossing_latitude(spark):
    v = spark.createDataFrame([(1, 0, 170.0, 0.0), (1, 1, -170.0, 0.0), (2, 0, 179.0, 10.0), (2, 1, -179.0, 10.0)],
                              "feature_id long, seq long, x double, y double")
    rows = vectors.antimeridian_split(v).orderBy("feature_id", "part", "seq", "sub").collect()
    seam = [(r.feature_id, r.part, r.x, round(r.y, 6)) for r in rows if abs(r.x) == 180.0]
    # by symmetry the second crossing is the great circle's top: tan(lat) = tan(10)/cos(1)
    top = round(math.degrees(math.atan(math.tan(math.radians(10)) / math.cos(math.radians(1)))), 6)
    assert seam == [(1, 0, 180.0, 0.0), (1, 1, -180.0, 0.0), (2, 0, 180.0, top), (2, 1, -180.0, top)]


def test_equidistance_between_parallel_baselines(spark):
    cols = "feature_id long, seq long, x double, y double"
    a = spark.createDataFrame([(1, 0, 120.0, 22.0), (1, 1, 120.0, 24.0)], cols)
    b = spark.createDataFrame([(2, 0, 122.0, 22.0), (2, 1, 122.0, 24.0)], cols)
    params = vectors.MedianReference(25_000, 2_500)
    rows = vectors.equidistance_points(a, b, 121.0, 23.0, params).orderBy("along").collect()
    assert all(120.9 < r.x < 121.1 and r.legal_status == "COMPUTED_REFERENCE" for r in rows)
    ys = [r.y for r in rows]
    assert ys == sorted(ys) or ys == sorted(ys, reverse=True)


def test_nearest_equals_brute_force(spark):
    import random

    rng = random.Random(11)
    edges = [(i, rng.uniform(0, 1e6), rng.uniform(0, 1e6)) for i in range(200)]
    edges = [(x, y, x + rng.uniform(-4e4, 4e4), y + rng.uniform(-4e4, 4e4)) for _, x, y in edges]
    points = [(i, rng.uniform(-2e5, 2e6), rng.uniform(-2e5, 1.2e6)) for i in range(60)]

    def gap(px, py, e):
        x1, y1, x2, y2 = e
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - x1 - t * dx, py - y1 - t * dy)

    p = spark.createDataFrame(points, "sid long, x double, y double")
    e = spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")
    got = {r.sid: r.nd for r in vectors.nearest_on_edges(p, e, "sid").collect()}
    assert got == pytest.approx({i: min(gap(x, y, k) for k in edges) for i, x, y in points})


def test_grid_window_quantiles_and_fill(spark):
    frame = grid.Affine(-180.0, 90.0, 1.0, 1.0, 360, 180)
    cells = spark.range(360 * 180).select((F.col("id") / 360).cast("long").alias("grid_row"), (F.col("id") % 360).alias("grid_col"),
                                         F.col("id").cast("double").alias("value"))
    cut, sub = grid.clip(cells, frame, (118.0, 18.0, 126.0, 24.0))
    assert (sub.width, sub.height, cut.count()) == (8, 6, 48)
    wide, wsub = grid.clip_360(cells, frame, (100.0, -20.0, 300.0, 20.0))
    assert (wsub.width, wsub.height) == (200, 40) and wide.count() == 8000
    assert wide.select("grid_row", "grid_col").distinct().count() == 8000
    with pytest.raises(ValueError):
        grid.clip(cells, frame, (400.0, 0.0, 401.0, 1.0))
    import numpy as np

    # a third of all cells share one value
    skew = cells.withColumn("value", F.when(F.col("grid_col") % 3 == 0, 0.0).otherwise(F.sqrt("value")))
    values = np.array([r.value for r in skew.select("value").collect()])
    got = grid.density_quantiles(skew).collect()[0]
    assert tuple(got) == pytest.approx(tuple(np.quantile(values, grid.DENSITY_QUANTILES)))


def test_bilinear_keeps_a_plane(spark):
    cells = spark.range(40 * 60).select((F.col("id") / 60).cast("long").alias("grid_row"), (F.col("id") % 60).alias("grid_col")).withColumn(
        "value", F.col("grid_col") * 2.0 + F.col("grid_row"))
    out = grid.downsample_bilinear(cells, 2.0, 60, 40).collect()
    assert len(out) == 30 * 20
    for r in out:
        assert r.value == pytest.approx((2 * r.grid_col + 0.5) * 2.0 + 2 * r.grid_row + 0.5)


def test_bilinear_query_covers_tables_beyond_its_frame(spark, tmp_path):
    import __spark_entry__

    def made(rows):
        path = str(tmp_path / str(rows))
        # two columns of cells in the last 50 of so many rows
        spark.range(100).select(((F.lit(rows - 50) + F.col("id") / 2).cast("long") * 120 + F.col("id") % 2).alias("o_orderkey")).write.parquet(f"{path}/orders.parquet")
        return {(r[0], r[1]): r[2] for r in __spark_entry__.queries()["grd2_downsample_bilinear"](spark, path).collect()}

    inside, beyond = made(1_000), made(40_000)
    assert {(r, c) for r, c in beyond} == {(r + (40_000 - 1_000) // 5 * 2, c) for r, c in inside} and len(inside) >= 20
    assert max(r for r, _ in beyond) == 40_000 * 2 // 5 - 1


def test_bilinear_ignores_cells_outside(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (10**9, 0, 5.0), (0, 10**9, 5.0)], "grid_row long, grid_col long, value double")
    assert [tuple(r) for r in grid.downsample_bilinear(cells, 2.0, 2, 2).collect()] == [(0, 0, 1.0)]


def test_density_cache_hits_on_the_same_request(spark, tmp_path):
    frame = grid.Affine(0.0, 4.0, 1.0, 1.0, 4, 4)
    cells = spark.range(16).select((F.col("id") / 4).cast("long").alias("grid_row"), (F.col("id") % 4).alias("grid_col"), F.col("id").cast("double").alias("value"))
    a, hit_a = grid.cached_density_subset(cells, frame, (1.0, 1.0, 3.0, 3.0), str(tmp_path), "h", 0.0)
    b, hit_b = grid.cached_density_subset(cells, frame, (1.0, 1.0, 3.0, 3.0), str(tmp_path), "h", 0.0)
    assert (hit_a, hit_b) == (False, True) and a.count() == b.count() == 4
    assert {round(math.expm1(r.value)) for r in a.collect()} == {5, 6, 9, 10}


def test_audit_lines_and_border_rules(spark):
    secret = "a1" * 12
    df = spark.createDataFrame([(1, f"ok\r\npassword: {secret}\x0cEND"), (2, "clean"), (3, "x\nEND")], "id long, text string")
    rows = audit.audit_texts(df, "id", "text").collect()
    assert [(r.id, r.line, r.check, r.excerpt) for r in rows] == [(1, 2, "assigned_secret", audit.REDACTED)]
    anchored = audit.audit_texts(df, "id", "text", [("end", "^END$", "REVIEW")]).collect()
    assert sorted((r.id, r.line) for r in anchored) == [(1, 3), (3, 2)]
