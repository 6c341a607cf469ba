"""Vessels of few rows need no slices: same results as with slices, fewer rows folded and aggregated."""

import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import qc, segments
from tidewake.plans.ordered import by_size
from tidewake.schema import QualityConfig

SLICED = QualityConfig(distance="haversine", slice_rows=40, source_slice=64)
WHOLE = QualityConfig(distance="haversine")


@pytest.fixture(scope="module")
def feed(spark):
    """Vessels of 10 to 300 rows over some weeks with jumps, equal times, copies, bad rows and rows without identity."""
    rng, rows = random.Random(5), []
    for vessel, n in enumerate((10, 41, 150, 300, 30)):
        t = 0
        for _ in range(n):
            t += rng.choice((0, 600, 1800, 3600, 20_000, 90_000))
            far = 40.0 if rng.random() < 0.04 else 0.0
            rows.append((f"v{vessel}" if vessel < 4 else None, None if rng.random() < 0.02 else t, 20 + far + rng.random() / 100,
                         120 + rng.random() / 100, rng.choice(("s1", "s2", None)), rng.choice(("AIS", "x")) if vessel == 1 else "AIS"))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    rng.shuffle(rows)
    rows = [(f"o{i}", f"r{r[1]}", i, *r, "OBSERVED", "PLAN", "n") for i, r in enumerate(rows)]
    return spark.createDataFrame(
        rows, "observation_id string, source_record_id string, source_order long, entity_id string, t long, latitude double, longitude double,"
        "source_segment_id string, source_type string, observed_or_inferred string, actor_type string, source_name string",
    ).withColumn("event_time", F.timestamp_seconds("t")).drop("t")


def test_keys_by_size(spark):
    df = spark.range(30).select((F.col("id") % 4).cast("string").alias("k"), "id")
    small, large = by_size(df, "k", 7)
    assert {r.k for r in small.collect()} == {"2", "3"} and {r.k for r in large.collect()} == {"0", "1"}
    assert small.count() + large.count() == 30 and by_size(df, "k", 8)[1] is None


def test_flags_with_and_without_slices(feed):
    got, want = (sorted(map(tuple, qc.all_flags(feed, c).drop("entity_id").collect())) for c in (WHOLE, SLICED))
    assert got == want and {"IMPOSSIBLE_SPEED", "TIMESTAMP_DISORDER", "DUPLICATE_OBSERVATION"} <= {r[2] for r in got}


def test_only_rows_near_a_failure_are_folded(spark, monkeypatch):
    """Hourly rows of a month: the fold gets the jump, the 136 hours of its horizon and one row more, no whole days."""
    rows = [(f"o{i}", f"r{i}", i, "v", 20.0 + (30.0 if i == 100 else 0.0), 120.0, "OBSERVED") for i in range(720)]
    df = spark.createDataFrame(
        rows, "observation_id string, source_record_id string, source_order long, entity_id string, latitude double, longitude double, "
        "observed_or_inferred string").withColumn("event_time", F.timestamp_seconds(F.col("source_order") * 3600 + 10 * 3600))
    seen, fold = [], qc.folded_pairs
    monkeypatch.setattr(qc, "folded_pairs", lambda rows, config: seen.append(rows.count()) or fold(rows, config))
    fast = qc.screened_pairs(qc.screen(df), WHOLE).filter("knots > 80").collect()
    assert [r.source_order for r in fast] == [100]
    # the horizon begins anew at the row after the jump, which fails against the jump itself
    assert seen == [1 + 1 + 135 + 1]


def test_runs_with_and_without_slices(feed):
    cleaned = qc.clean(feed, WHOLE)
    found = []
    for config in (WHOLE, SLICED):
        linked = segments.linked_points(cleaned, config).cache()
        sizes = {(r.entity_id, r.run_slice, r.run_no): r["count"] for r in linked.groupBy("entity_id", "run_slice", "run_no").count().collect()}
        for r in linked.collect():
            assert r.alone == (sizes[r.entity_id, r.run_slice, r.run_no] == 1)
        found.append(sorted(map(tuple, segments.segments_of(linked, config).collect())))
        if config is WHOLE:
            assert linked.select("entity_id", "slice").distinct().count() == 4
    assert found[0] == found[1] and len(found[0]) > 50


def test_cleaned_points_without_flags(feed, monkeypatch):
    want = {r.source_order for r in qc.quality_control(feed, WHOLE).cleaned_points.collect()}
    monkeypatch.setattr(qc, "screened_flags", None)
    got = [r.source_order for r in qc.clean(feed, WHOLE).collect()]
    assert set(got) == want and len(got) == len(want)
