"""Cases beyond the rows of the checked queries: colliding sources, large texts, far points, hot keys."""

import json

import pytest
from pyspark.sql import functions as F

from tidewake.operators import audit, grid, provenance, qc, vectors
from tidewake.plans.build import BuildRequest, research_build
from tidewake.schema import QualityConfig
from tidewake.sources import observations as readers

ROW = "observation_id string, entity_id string, t long, latitude double, longitude double, source_order long"


def observations(spark, rows):
    return spark.createDataFrame(rows, ROW).withColumns({
        "event_time": F.timestamp_seconds("t"), "source_type": F.lit("AIS"), "source_name": F.lit("s"),
        "observed_or_inferred": F.lit("OBSERVED"), "actor_type": F.lit("PLAN"), "timestamp_start": F.timestamp_seconds("t").cast("string")})


def feed(name, bad=()):
    return [(f"{name}{i}", name, i * 600, 10.0 + (80.5 if i in bad else i * 0.001), 120.0, i) for i in range(5)]


def test_sources_with_equal_orders_do_not_exclude_each_other(spark):
    a, b = observations(spark, feed("a", bad=(2,))), observations(spark, feed("b"))
    request = BuildRequest("b1", (100.0, -80.0, 140.0, 95.0))
    result = research_build(request, [a, b]).quality
    assert sorted(r[0] for r in result.cleaned_points.select("observation_id").collect()) == ["a0", "a1", "a3", "a4", "b0", "b1", "b2", "b3", "b4"]
    with pytest.raises(ValueError, match="source_order"):
        qc.quality_control(a.unionByName(b))


def test_slashed_times_are_read_without_normalisation(spark):
    rows = observations(spark, feed("a")).drop("event_time").withColumn("timestamp_start", F.lit("2025/01/01 00:00:00"))
    assert qc.row_flags(rows).filter("flag = 'MISSING_TIME'").count() == 0


def test_islands_are_cut_at_barred_rows(spark):
    # one identity at two far places; every tenth row is barred
    rows = [(f"o{i}", "v", i * 60, 10.0 if i % 2 else 40.0, 999.0 if i % 10 == 0 else 120.0, i) for i in range(2000)]
    config = QualityConfig(distance="haversine")
    df = observations(spark, rows)
    pairs = qc.tested_pairs(df, config).collect()
    last, want = None, {}
    from tidewake.functions.geo import haversine_scalar

    for i, (_, _, t, lat, lon, order) in enumerate(rows):
        if lon > 180:
            last = None
        elif last is None:
            last = (t, lat, lon)
        else:
            metres = haversine_scalar(last[2], last[1], lon, lat)
            want[order] = last[0]
            if metres / (t - last[0]) * qc.KNOTS_PER_MPS <= config.max_speed_knots:
                last = (t, lat, lon)
    assert {p.source_order: int(p.prev_time.timestamp()) for p in pairs} == want


def test_large_texts_are_audited_whole(spark):
    secret = "password: " + "a1" * 12
    rows = [(1, "x" * (9 << 20) + "\n" + secret + " " + "y" * 500), (2, "z")]
    found = audit.audit_texts(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert [(r.id, r.line, r.check) for r in found] == [(1, 2, "assigned_secret")]
    assert found[0].excerpt == audit.REDACTED + " " + "y" * 500


@pytest.mark.parametrize("cell_m", [10.0, 100.0, 5000.0])
def test_far_points_keep_their_nearest_edge(spark, cell_m):
    points = spark.createDataFrame([("far", 9e6, 0.0), ("near", 3.0, 4.0)], "sid string, x double, y double")
    edges = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, -50.0, -70.0)], "x1 double, y1 double, x2 double, y2 double")
    got = {r.sid: r.nd for r in vectors.nearest_on_edges(points, edges, "sid", cell_m).collect()}
    assert got["far"] == pytest.approx(9e6) and got["near"] == pytest.approx((9 + 9) ** 0.5)


def test_concave_and_touching_polygons(spark):
    u = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 2.0), (4.0, 2.0), (4.0, 3.0), (0.0, 3.0)]
    square = [(5.0, 0.0), (6.0, 0.0), (6.0, 1.0), (5.0, 1.0)]
    slanted = [(1.0, -1.0), (3.0, 1.0), (1.0, 3.0)]
    df = spark.createDataFrame([(1, 0, u), (2, 0, square), (3, 0, slanted)], "feature_id int, ring_no int, ring array<struct<x:double,y:double>>")
    cut = vectors.clip_polygons(df, (2.0, -5.0, 5.0, 10.0)).withColumn("area", vectors.ring_area(F.col("ring")))
    got = sorted((r.feature_id, r.part, round(r.area, 9)) for r in cut.collect())
    assert got == [(1, 0, 2.0), (1, 1, 2.0), (3, 0, 1.0)]


def test_fractional_average_weighs_areas_and_skips_nan(spark):
    cells = spark.createDataFrame([(0, c, 10.0 * c) for c in range(5)] + [(1, c, float("nan")) for c in range(5)], "grid_row long, grid_col long, value double")
    got = {r.grid_col: r.value for r in grid.downsample_average(cells, 2.5).collect()}
    assert got == pytest.approx({0: 8.0, 1: 32.0})


def test_quantiles_with_an_outlier(spark):
    values = spark.range(5000).select(F.when(F.col("id") == 0, 1e12).otherwise(F.col("id").cast("double")).alias("v"))
    row = grid.exact_quantiles(values, "v", (0.0, 0.5, 1.0)).collect()[0]
    assert tuple(row) == (1.0, 2500.5, 1e12)
    assert grid.exact_quantiles(values.limit(0), "v", (0.5,)).collect()[0][0] is None


def test_density_cache_tells_frames_apart(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "grid_row long, grid_col long, value double")
    a, b = grid.Affine(0.0, 1.0, 1.0, 1.0, 2, 1), grid.Affine(0.0, 1.0, 0.5, 1.0, 2, 1)
    for frame, hit in ((a, False), (b, False), (a, True)):
        assert grid.cached_density_subset(cells, frame, (0.0, 0.0, 1.0, 1.0), str(tmp_path), "same", 0.0)[1] == hit


def test_every_file_of_a_folder_must_be_wgs84(spark, tmp_path):
    for name, crs in (("a", "urn:ogc:def:crs:OGC:1.3:CRS84"), ("b", "urn:ogc:def:crs:EPSG::3857")):
        (tmp_path / f"{name}.geojson").write_text(json.dumps({
            "type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": crs}},
            "features": [{"type": "Feature", "properties": {"k": "1"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}]}))
    with pytest.raises(ValueError, match="WGS84"):
        readers.read_geojson(spark, str(tmp_path))


def test_blank_and_null_manifest_keys_are_added(spark):
    counts = spark.createDataFrame([("actors", None, 2), ("actors", " ", 3), ("actors", "PLAN", 4)], "metric string, key string, value long")
    row = provenance.build_manifest(counts, "b", {}, "0").collect()[0]
    assert row.evidence == {"actors": 5, "actors/PLAN": 4}


def test_staging_needs_a_shared_folder_off_one_machine(monkeypatch):
    from tidewake import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.stage_folder(Session())
