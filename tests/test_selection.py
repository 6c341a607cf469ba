"""Quantiles by digit selection, file listing by rounds, reference layers of a package."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import grid, provenance
from tidewake.plans.build import BOUNDARY_LAYERS, ZONE_LAYERS, ReferenceData, write_reference


def test_order_bits_ascend_and_return():
    values = np.array([-np.inf, -1e300, -2.5, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 0.1, 1.0, 1e300, np.inf])
    bits = grid.order_bits(values)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[5] == bits[6]
    assert [grid.from_order_bits(int(b)) for b in bits] == (values + 0.0).tolist()


@pytest.mark.parametrize("kind", ["spread", "one value", "two values", "tiny to huge", "negative"])
def test_order_statistics_against_sorting(spark, kind):
    rng = random.Random(3)
    make = {"spread": lambda: rng.gauss(0, 100), "one value": lambda: 7.25, "two values": lambda: rng.choice([1.0, 2.0]),
            "tiny to huge": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), "negative": lambda: -rng.uniform(5, 5.0000001)}[kind]
    values = [make() for _ in range(3001)]
    odd = [None, float("nan"), float("inf"), float("-inf")] * 5
    df = spark.createDataFrame([(v,) for v in values + odd], "x double").repartition(5)
    total, found = grid.order_statistics(df, "x", lambda n: [0, n // 3, n // 2, n - 1])
    want = sorted(values)
    assert total == 3001 and found == {k: want[k] for k in (0, 1000, 1500, 3000)}
    got = tuple(grid.exact_quantiles(df, "x", (0.0, 0.5, 0.987, 1.0)).first())
    assert got == pytest.approx(tuple(np.quantile(values, (0.0, 0.5, 0.987, 1.0))), rel=1e-12)


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert tuple(grid.exact_quantiles(df, "x", (0.5, 0.9)).first()) == (None, None)
    assert tuple(grid.exact_quantiles(df.where("false"), "x", (0.5,)).first()) == (None,)


def test_files_of_nested_folders(spark, tmp_path):
    want = {}
    for name, text in (("a.txt", "a"), ("empty", ""), ("d/b é.txt", "b"), ("d/e/f/g/deep.bin", "x" * 10), ("d/e/empty2", ""), ("h%20i/j", "j")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        want[name] = (len(text.encode()), hashlib.sha256(text.encode()).hexdigest())
    for name in ("_hidden", ".dot", "_folder/x", "d/.git/y"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("no")
    (tmp_path / "none").mkdir()
    for root in (str(tmp_path), f"file:{tmp_path}", f"{tmp_path}/"):
        assert {r.path: (r.bytes, r.sha256) for r in provenance.file_manifest(spark, root).collect()} == want


def test_listing_goes_through_the_given_function(spark):
    import io

    tree = {"x://r": [("x://r/a", True), ("x://r/f1", False)], "x://r/a": [("x://r/a/f2", False), ("x://r/a/b", True)], "x://r/a/b": []}
    rows = provenance.file_manifest(spark, "x://r", lambda a: io.BytesIO(a.encode()), lambda folder: tree[folder]).collect()
    assert {(r.path, r.bytes) for r in rows} == {("f1", 8), ("a/f2", 10)}


def test_files_are_hashed_by_many_tasks(spark, tmp_path, monkeypatch):
    """Few bytes of addresses don't gather the files in one task; a large folder comes in parts."""
    import io

    from pyspark import TaskContext

    monkeypatch.setattr(provenance, "LISTED_ROWS", 3)
    for i in range(40):
        (tmp_path / f"f{i}").write_text("x")
    rows = provenance.file_manifest(spark, str(tmp_path), lambda path: io.BytesIO(str(TaskContext.get().partitionId()).encode())).collect()
    assert len(rows) == 40 and len({r.sha256 for r in rows}) == 4


def test_documents_become_one_file_each(spark):
    from checks.files import written_each
    from checks.registry import Inputs

    lines = spark.createDataFrame([("a/x", "2", 2), ("a/x", "1", 1), ("b.txt", "", 1)], "file string, value string, at long")
    root = written_each(Inputs(spark, "/tmp"), "each", lines, "at", "h:", ",", "!")
    got = {r.path: (r.bytes, r.sha256) for r in provenance.file_manifest(spark, root).collect()}
    assert got == {p: (len(v), hashlib.sha256(v.encode()).hexdigest()) for p, v in (("a/x", "h:1,2!"), ("b.txt", "h:!"))}


def test_a_package_without_reference_data(spark, tmp_path):
    expected = spark.createDataFrame([("eez_reference", "remote"), ("mine", "local"), ("big", "large")], "source_id string, kind string")
    layers = write_reference(spark, str(tmp_path), ReferenceData(expected=expected, enabled=("custom_boundary",), live=False))
    assert {(r.layer, r.features, r.shown) for r in layers.collect()} == {(n, 0, False) for n in (*ZONE_LAYERS, *BOUNDARY_LAYERS, "traffic_density")}
    for name in (*ZONE_LAYERS, *BOUNDARY_LAYERS):
        assert "source_id" in spark.read.parquet(f"{tmp_path}/data/maritime/{name}").columns
    warnings = {r.warning for r in spark.read.json(f"{tmp_path}/metadata/warnings").collect()}
    assert warnings == {
        "traffic_density: no grid supplied, an empty group is kept", "custom_boundary: selected without a source",
        "eez_reference: no data, UNAVAILABLE_OFFLINE_MODE", "big: no data, NOT_CACHED_LARGE_SOURCE", "mine: no data, LOCAL_ONLY"}
    with pytest.raises(ValueError):
        write_reference(spark, str(tmp_path), ReferenceData(zones={"unknown": expected}))


@pytest.mark.parametrize("far", [False, True])
def test_nearest_edges_of_far_coasts_against_all_pairs(spark, monkeypatch, far):
    """A ragged coast of many edges and points up to a thousand cells away."""
    from tidewake.operators import vectors

    rng = random.Random(12)
    coast = [(x * 40.0, rng.uniform(-300, 300)) for x in range(800)]
    edges = [(*a, *b) for a, b in zip(coast, coast[1:])] + [(-9e4, -9e4, -9e4, -9e4)]
    points = [(f"p{i}", rng.uniform(-2e4, 5e4), rng.uniform(2e4, 9e4) if far else rng.uniform(-2e3, 2e3)) for i in range(60)]
    df = spark.createDataFrame(points, "sid string, x double, y double")
    table = spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")
    met = []
    foot = vectors._foot
    monkeypatch.setattr(vectors, "_foot", lambda px, py: met.append(1) or foot(px, py))
    got = {r.sid: (r.nd, r.nx, r.ny) for r in vectors.nearest_on_edges(df, table, "sid", 50.0).collect()}

    def brute(px, py):
        best = None
        for x1, y1, x2, y2 in edges:
            dx, dy = x2 - x1, y2 - y1
            sq = dx * dx + dy * dy
            t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / sq)) if sq else 0.0
            d = ((px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2) ** 0.5
            best = d if best is None else min(best, d)
        return best

    assert len(got) == len(points) and met
    for sid, x, y in points:
        assert got[sid][0] == pytest.approx(brute(x, y), rel=1e-9)
