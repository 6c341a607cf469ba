"""Quality control and segments: golden cases, brute force, invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewake.functions.geo import (
    KNOTS_PER_MPS,
    geodesic_m,
    geodesic_scalar,
    haversine_scalar,
)
from tidewake.operators import metrics, qc, segments
from tidewake.operators.identity import resolve
from tidewake.operators.normalize import normalize
from tidewake.schema import QualityConfig
from tidewake.session import stage

REGISTRY = [
    ("ccg-2304", "China Coast Guard 2304", ["CCG 2304"], "CCG", "2304", None),
    ("plan-533", "Jiangkai II 533", ["PLAN 533", "山东舰"], "PLAN", "533", None),
]
AIS = [
    ("2025-01-01T00:00:00Z", 23.00, 122.00, None, "r1"),
    ("2025-01-01T00:10:00Z", 23.01, 122.01, None, "r2"),
    ("2025-01-01T00:20:00Z", 40.00, 150.00, None, "jump"),
    ("2025-01-01T10:00:00Z", 23.02, 122.02, None, "gap"),
    ("2025-01-01T10:00:00Z", 23.02, 122.02, None, "gap"),
    (None, 23.03, 122.03, None, "no-time"),
    ("2025-01-01T10:10:00Z", 95.00, 122.04, None, "bad-lat"),
    ("2025-01-01T10:20:00Z", 23.04, 122.04, "123", "bad-mmsi"),
]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(
        REGISTRY, "entity_id string, canonical_name string, aliases array<string>, actor_type string, hull_number string, MMSI string")


@pytest.fixture(scope="module")
def ais(spark, registry):
    rows = [(*r, "CCG 2304", i) for i, r in enumerate(AIS)]
    raw = spark.createDataFrame(
        rows, "timestamp string, latitude double, longitude double, MMSI string, source_record_id string, vessel_name string, source_order long")
    return normalize(
        raw, build_id="t", source_type="AIS", source_name="synthetic", license_text="CC0", attribution="none",
        registry=registry)


@pytest.mark.parametrize("distance", ["geodesic", "haversine"])
def test_golden_ais(ais, distance):
    result = qc.quality_control(ais, QualityConfig(distance=distance))
    flags = {r.flag for r in result.quality_flags.collect()}
    assert {
        "DUPLICATE_OBSERVATION", "INVALID_COORDINATE", "MISSING_TIME", "MALFORMED_MMSI", "IMPOSSIBLE_SPEED",
        "LARGE_OBSERVATION_GAP"} <= flags
    assert result.excluded_points.count() == 5
    gaps = result.gaps.collect()
    assert [g.gap_seconds for g in gaps] == [35400.0]
    tracks = result.track_segments.collect()
    assert [(s.segment_type, s.point_count) for s in tracks] == [("OBSERVED_TRACK", 2)]
    assert result.vessel_summary.collect()[0].actor_type == "CCG"


def test_lazy_flags_equal_the_staged_ones(ais):
    config = QualityConfig(distance="haversine")
    staged = qc.quality_control(ais, config).quality_flags
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, qc.all_flags(ais, config).collect()))


def test_geodesic_thresholds_decide_like_the_exact_distance(spark):
    """Pairs within a percent of the speed limit and of one metre."""
    config = QualityConfig()
    rows = []
    for i in range(400):
        target = 80 / KNOTS_PER_MPS * 600 * (0.99 + i * 0.00005) if i % 2 else 0.98 + i * 0.0001
        rows.append((f"a{i}", f"v{i}", 0, 30.0, 10.0, "OBSERVED", 2 * i))
        lat = 30.0 + (target / 111_000 if i % 4 < 2 else 0)
        lon = 10.0 + (0 if i % 4 < 2 else target / (111_195 * math.cos(math.radians(30))))
        rows.append((f"b{i}", f"v{i}", 600, lat, lon, "OBSERVED", 2 * i + 1))
    df = spark.createDataFrame(
        rows, "observation_id string, entity_id string, t long, latitude double, longitude double, observed_or_inferred string, source_order long"
    ).withColumn("event_time", F.timestamp_seconds("t"))
    got = {(r.source_order, r.flag) for r in qc.sequence_flags(qc.tested_pairs(df, config), config).collect()}
    want = _brute(rows, config, geodesic_scalar)
    assert got == want and 50 < len(want) < 350


def test_import_summary(ais):
    r = qc.quality_control(ais)
    row = metrics.import_summary(
        r.quality_flags, r.cleaned_points, r.excluded_points, r.gaps, r.track_segments).collect()[0]
    assert (row.cleaned_positions, row.excluded_positions, row.duplicate_positions, row.large_gaps) == (3, 5, 1, 1)


def test_unresolved_vessel_gives_no_route(spark, registry):
    raw = spark.createDataFrame(
        [("2025-01-01T00:00:00Z", 22.0, 122.0, "nobody", 0), ("2025-01-01T01:00:00Z", 22.1, 122.1, "nobody", 1)],
        "timestamp_start string, latitude double, longitude double, vessel_name string, source_order long")
    obs = normalize(raw, build_id="b", source_type="OFFICIAL_OBSERVATION", source_name="s", license_text="l",
                    attribution="a", registry=registry)
    r = qc.quality_control(obs)
    assert r.cleaned_points.count() == 0 and r.track_segments.count() == 0
    assert "MISSING_VESSEL_IDENTITY" in {x.flag for x in r.quality_flags.collect()}


def test_official_rows_only_give_inferred_connections(spark):
    raw = spark.createDataFrame(
        [(f"2025-01-0{d}T00:00:00Z", 22.0 + d, 122.0, "v", d) for d in range(1, 5)],
        "timestamp_start string, latitude double, longitude double, entity_id string, source_order long")
    obs = normalize(raw, build_id="b", source_type="OFFICIAL_OBSERVATION", source_name="s", license_text="l", attribution="a")
    kinds = {s.segment_type for s in qc.quality_control(obs).track_segments.collect()}
    assert kinds == {"INFERRED_CONNECTION"}


def test_cross_entity_segment_is_rejected(spark):
    cols = "segment_id string, entity_id string, start_entity_id string, end_entity_id string, segment_type string"
    segments.validate_segments(spark.createDataFrame([("s", "a", "a", "a", "INFERRED_CONNECTION")], cols))
    with pytest.raises(ValueError):
        segments.validate_segments(spark.createDataFrame([("s", "a", "a", "b", "INFERRED_CONNECTION")], cols))


def _walk(seed, vessels=6, rows=400):
    """Dirty tracks: jumps, bursts of jumps, ties, excluded rows, long silences."""
    rng = random.Random(seed)
    out = []
    for v in range(vessels):
        t, lat, lon = 0, rng.uniform(-60, 60), rng.uniform(-170, 170)
        for _ in range(rows):
            t += rng.choice([0, 60, 600, 3600, 7200, 40_000] + ([900_000] if rng.random() < 0.1 else []))
            lat = max(-80, min(80, lat + rng.uniform(-0.02, 0.02)))
            lon += rng.uniform(-0.02, 0.02)
            kind = rng.random()
            y, x = (lat, lon) if kind > 0.15 else (rng.uniform(-80, 80), rng.uniform(-179, 179))
            if kind > 0.97:
                y = 95.0
            out.append((f"v{v}", t, y, x, rng.choice(["OBSERVED"] * 20 + ["GUESS"])))
    rng.shuffle(out)
    return [(f"o{i}", *r, i) for i, r in enumerate(out)]


def _brute(rows, config, metres):
    """The sequential definition over each vessel's whole history."""
    found, barred = set(), set()
    for oid, _, _, y, _, state, order in rows:
        if not -90 <= y <= 90 or state == "GUESS":
            barred.add(order)
    by_vessel = {}
    for r in rows:
        by_vessel.setdefault(r[1], []).append(r)
    for vessel in by_vessel.values():
        vessel.sort(key=lambda r: (r[2], r[6]))
        last = None
        for r in vessel:
            if r[6] in barred:
                last = None
                continue
            if last is None or r[2] <= last[2]:
                last = r
                continue
            gap = r[2] - last[2]
            d = metres(last[4], last[3], r[4], r[3])
            if d < 1.0:
                found.add((r[6], "REPEATED_IDENTICAL_POINT"))
            if d / gap * KNOTS_PER_MPS > config.max_speed_knots:
                found.add((r[6], "IMPOSSIBLE_SPEED"))
                continue
            if gap > config.large_gap_seconds:
                found.add((r[6], "LARGE_OBSERVATION_GAP"))
            last = r
    return found


@pytest.mark.parametrize("seed,slice_seconds,speed", [(1, 86400, 80.0), (2, 3600, 80.0), (3, 600_000, 20.0), (4, 50_000, 2000.0)])
def test_fold_equals_brute_force(spark, seed, slice_seconds, speed):
    rows = _walk(seed)
    config = QualityConfig(max_speed_knots=speed, distance="haversine", slice_seconds=slice_seconds)
    df = spark.createDataFrame(
        rows, "observation_id string, entity_id string, t long, latitude double, longitude double, observed_or_inferred string, source_order long"
    ).withColumn("event_time", F.timestamp_seconds("t")).withColumn("source_record_id", F.col("observation_id"))
    got = {
        (r.source_order, r.flag)
        for r in qc.sequence_flags(qc.tested_pairs(df, config), config).collect()
    }
    want = _brute(rows, config, haversine_scalar)
    assert {w for w in want if w[1] == "IMPOSSIBLE_SPEED"}
    assert got == want


@pytest.mark.parametrize("slice_rows,rounds", [(1 << 16, False), (64, True)])
def test_islands_of_one_piece_need_no_rounds(spark, monkeypatch, slice_rows, rounds):
    """Sparse vessels with failures on most days: one run settles them. Cut into pieces, the fold is the same."""
    rows = _walk(5, vessels=8, rows=150)
    config = QualityConfig(distance="haversine", slice_rows=slice_rows)
    df = spark.createDataFrame(
        rows, "observation_id string, entity_id string, t long, latitude double, longitude double, observed_or_inferred string, source_order long"
    ).withColumn("event_time", F.timestamp_seconds("t")).withColumn("source_record_id", F.col("observation_id"))
    written = []
    monkeypatch.setattr(qc, "stage", lambda frame: written.append(frame) or stage(frame))
    pairs = qc.tested_pairs(df, config)
    assert (len(written) > 1) == rounds  # the rows themselves, then reports and plans of rounds
    assert {(r.source_order, r.flag) for r in qc.sequence_flags(pairs, config).collect()} == _brute(rows, config, haversine_scalar)


def test_two_places_under_one_identity(spark):
    """Alternating positions: the chain of the first place survives, whatever the slicing."""
    rows = [(f"o{i}", "v", i * 600, 10.0 if i % 2 == 0 else 40.0, 120.0, "OBSERVED", i) for i in range(3000)]
    df = spark.createDataFrame(
        rows, "observation_id string, entity_id string, t long, latitude double, longitude double, observed_or_inferred string, source_order long"
    ).withColumn("event_time", F.timestamp_seconds("t"))
    config = QualityConfig(distance="haversine")
    fast = qc.sequence_flags(qc.tested_pairs(df, config), config).filter("flag = 'IMPOSSIBLE_SPEED'")
    assert {r.source_order for r in fast.collect()} == set(range(1, 3000, 2))


def test_runs_over_slices_keep_one_id(spark):
    """A run over many slices is one segment with the id of the whole id list."""
    import hashlib

    rows = [(f"o{i:04d}", "v", i * 1800, 10.0 + i * 0.001, 120.0, i) for i in range(300)]
    df = spark.createDataFrame(
        rows, "observation_id string, entity_id string, t long, latitude double, longitude double, source_order long"
    ).withColumns({"event_time": F.timestamp_seconds("t"), "source_type": F.lit("AIS"), "source_name": F.lit("s"),
                   "actor_type": F.lit("PLAN")})
    out = segments.track_segments(df, QualityConfig(slice_seconds=7200)).collect()
    ids = "|".join(r[0] for r in rows)
    assert [(s.segment_id, s.point_count) for s in out] == [
        ("seg-" + hashlib.sha256(ids.encode()).hexdigest()[:16], 300)]
    points = segments.track_points(df, QualityConfig(slice_seconds=7200))
    assert points.count() == 300 and points.select("segment_id").distinct().count() == 1


def test_all_points_of_a_day_in_several_pieces(spark, monkeypatch):
    rows = [(f"o{i:04d}", "v", i * 60, 10.0 + i * 0.001, 120.0, i) for i in range(300)]
    df = spark.createDataFrame(
        rows, "observation_id string, entity_id string, t long, latitude double, longitude double, source_order long"
    ).withColumns({"event_time": F.timestamp_seconds("t"), "source_type": F.lit("AIS"), "source_name": F.lit("s"), "actor_type": F.lit("PLAN")})
    whole = segments.track_segments(df).collect()
    monkeypatch.setattr(segments, "PIECE_ROWS", 7)
    linked = segments.linked_points(df)
    assert linked.select("slice", "piece").distinct().count() == 43
    assert segments.segments_of(linked).collect() == whole and whole[0].point_count == 300


def test_each_point_in_at_most_one_run_and_counts_conserve(spark):
    rows = _walk(9)
    df = spark.createDataFrame(
        rows, "observation_id string, entity_id string, t long, latitude double, longitude double, observed_or_inferred string, source_order long"
    ).withColumns({"event_time": F.timestamp_seconds("t"), "source_type": F.lit("AIS")})
    r = qc.quality_control(df, QualityConfig(distance="haversine", slice_seconds=20_000))
    assert r.cleaned_points.count() + r.excluded_points.count() == len(rows)
    points = segments.track_points(r.cleaned_points, QualityConfig(slice_seconds=20_000))
    assert points.count() == points.select("source_order").distinct().count()


def test_provider_segments_stay_apart(spark):
    rows = [("123456789", f"2025-01-01T00:{m:02d}:00Z", 22.0 + m / 1000, 122.0, s, m) for m, s in ((0, "a"), (30, "a"), (45, "b"), (59, "b"))]
    from tidewake.operators.normalize import detect_fields, normalize_user_input

    raw = spark.createDataFrame(rows, "MMSI string, timestamp string, lat double, lon double, seg_id string, source_order long")
    mapping, reasons = detect_fields(raw.columns)
    assert mapping["source_segment_id"] == "seg_id" and mapping["MMSI"] == "MMSI" and not reasons
    obs = normalize_user_input(raw, build_id="b", source_name="u.csv")
    assert obs.select("entity_id").distinct().count() == 1
    assert qc.quality_control(obs).track_segments.count() == 2


def test_interpolation_is_opt_in_and_also_bridges_provider_changes(spark):
    rows = [(f"o{i}", "v", t, 10.0, 120.0 + i * 0.001, s, i) for i, (t, s) in enumerate([(0, "a"), (60, "a"), (120, "b"), (9000, "b"), (30000, "b")])]
    df = spark.createDataFrame(
        rows, "observation_id string, entity_id string, t long, latitude double, longitude double, source_segment_id string, source_order long"
    ).withColumns({"event_time": F.timestamp_seconds("t"), "source_type": F.lit("AIS"), "source_name": F.lit("s")})
    kinds = [s.segment_type for s in segments.track_segments(df).collect()]
    assert "SHORT_INTERPOLATION" not in kinds
    on = segments.track_segments(df, QualityConfig(allow_short_gap_interpolation=True)).filter("segment_type = 'SHORT_INTERPOLATION'")
    assert {(s.start_observation_id, s.end_observation_id) for s in on.collect()} == {("o1", "o2"), ("o2", "o3")}


def test_geodesic_matches_known_distances(spark):
    # values published for WGS84: one degree on the equator, one degree of meridian at 0
    assert abs(geodesic_scalar(0, 0, 1, 0) - 111319.4908) < 1e-3
    assert abs(geodesic_scalar(0, 0, 0, 1) - 110574.3886) < 1e-3
    pairs = [(0.0, 0.0, 1.0, 0.0), (10.0, 50.0, -70.0, 40.0), (179.9, 10.0, -179.9, 10.5), (0.0, 0.0, 179.9, 0.1), (5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    for p, g in zip(pairs, got):
        assert math.isclose(g, geodesic_scalar(*p), rel_tol=1e-9, abs_tol=1e-6)


def test_resolution_aliases_hull_and_unicode(spark, registry):
    s = spark.createDataFrame(
        [(None, "jiangkai-ii 533", None, 0), (None, None, "533", 1), (None, "山东舰", None, 2), ("plan-533", None, None, 3),
         ("gone", "PLAN 533", None, 4), (None, "ＰＬＡＮ ５３３", None, 5)],
        "entity_id string, vessel_name string, hull_number string, source_order long")
    got = {r.source_order: (r.resolved_id, r.confidence, r.matched_on) for r in resolve(s, registry).collect()}
    assert got[0] == ("plan-533", "REPORTED", "vessel_name")
    assert got[1] == ("plan-533", "DOCUMENTED", "hull_number")
    assert got[2][0] == "plan-533" and got[5][0] == "plan-533"
    assert got[3] == ("plan-533", "DOCUMENTED", "entity_id")
    assert got[4] == (None, "UNKNOWN", "entity_id")


def test_ambiguous_token_stops_the_search(spark):
    reg = spark.createDataFrame(
        [("a", "A", "1", "x"), ("b", "B", "1", "y")], "entity_id string, canonical_name string, hull_number string, callsign string")
    s = spark.createDataFrame([("1", "A", 0), ("9", "A", 1)], "hull_number string, vessel_name string, source_order long").withColumn(
        "entity_id", F.lit(None).cast("string"))
    got = {r.source_order: r for r in resolve(s, reg.withColumn("actor_type", F.lit("PLAN"))).collect()}
    assert got[0].ambiguous and got[0].resolved_id is None and got[0].matched_on == "hull_number"
    assert got[1].resolved_id == "a"
