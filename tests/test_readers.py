"""Readers whose input is cut at any byte: GeoJSON features and row numbers."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewake.sources.observations import read_delimited, read_geojson, read_preamble_tsv


@pytest.fixture
def splits(spark):
    """Sets the bytes of a scan split."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def set_bytes(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield set_bytes
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def _feature(i, rng):
    """Names and values that look like the format's own signs."""
    text = rng.choice(["plain", 'a "quoted" word', "braces }{ ][", 'back\\slash \\" }', '"features": [{', "é 山 }", "", 'tail \\\\"}'])
    properties = {"name": f"n{i}", "note": text, "n": i, "nothing": None, "more": {"deep": [{"x": 1}, {"y": [2, {"z": "}"}]}]}}
    if i % 5 == 0:
        properties["features"] = [{"not": "a feature"}]
    return {"type": "Feature", "properties": properties, "geometry": {"type": "Point", "coordinates": [i * 0.5, -i * 0.25]}}


HEADS = {
    "plain": {"type": "FeatureCollection"},
    "members before": {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}},
                       "links": [{"features": [{"no": 1}]}, {"a": "\"features\": ["}], "about": {"features": [{"inner": 2}]}},
}


@pytest.mark.parametrize("head", list(HEADS))
@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [150, 1000, 1 << 27])
def test_features_are_found_at_any_split(spark, splits, tmp_path, head, indent, size):
    rng = random.Random(6)
    wanted = []
    for name, count in (("a.geojson", 60), ("b.geojson", 0), ("c.geojson", 23)):
        features = [_feature(i, rng) for i in range(count)]
        after = {"stats": [{"features": 1}, {"b": [3]}], "end": {"x": {}}}
        with open(tmp_path / name, "w", encoding="utf-8") as out:
            json.dump({**HEADS[head], "features": features, **after}, out, indent=indent, ensure_ascii=rng.random() < 0.5)
        wanted += features
    splits(size)
    got = sorted(read_geojson(spark, str(tmp_path)).collect(), key=lambda r: r.source_order)
    assert [r.source_order for r in got] == list(range(len(wanted)))
    for r, f in zip(got, wanted):
        p = f["properties"]
        assert (r["name"], r["note"], r["n"], r["nothing"]) == (p["name"], p["note"], str(p["n"]), None)
        assert [r.geometry_lon, r.geometry_lat] == f["geometry"]["coordinates"]
        assert (r["features"] is not None) == ("features" in p)
    scans = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    assert scans > 20 if size == 150 else scans >= 1


def test_large_geojson_equals_the_whole_file_reader(spark, splits, tmp_path):
    rng = random.Random(7)
    path = str(tmp_path / "one.json")
    with open(path, "w", encoding="utf-8") as out:
        json.dump({"type": "FeatureCollection", "features": [_feature(i, rng) for i in range(1500)]}, out)
    whole = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    want = whole.select(F.posexplode("features").alias("source_order", "f")).select(
        "f.properties.*", F.col("f.geometry.coordinates")[0].cast("double").alias("geometry_lon"), F.col("source_order").cast("long").alias("source_order"))
    splits(20_000)
    got = read_geojson(spark, path)
    assert os.path.getsize(path) > 300_000
    assert set(got.columns) == {*want.columns, "geometry_lat"}
    assert [tuple(r) for r in got.select(*want.columns).orderBy("source_order").collect()] == [tuple(r) for r in want.orderBy("source_order").collect()]


def test_what_is_no_collection_is_refused(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": [1, 2], "b": "features"}')
    with pytest.raises(ValueError, match="feature collection"):
        read_geojson(spark, str(tmp_path / "x.json"))
    (tmp_path / "y.json").write_text('{"features": [], "crs": {"properties": {"name": "EPSG:3857"}}}')
    with pytest.raises(ValueError, match="WGS84"):
        read_geojson(spark, str(tmp_path / "y.json"))
    (tmp_path / "z.json").write_text('{"features": []}')
    assert read_geojson(spark, str(tmp_path / "z.json")).count() == 0


def test_row_numbers_do_not_depend_on_later_splits(spark, splits, tmp_path):
    """The table is defined with one split size and read with others."""
    for name, rows in (("a.csv", 300), ("b.csv", 1), ("c.csv", 500)):
        (tmp_path / name).write_text("id,v\n" + "".join(f"{name}-{i:04d},{'x' * (i % 40)}\n" for i in range(rows)))
    splits(500)
    df = read_delimited(spark, str(tmp_path))
    want = [f"{n}-{i:04d}" for n, rows in (("a.csv", 300), ("b.csv", 1), ("c.csv", 500)) for i in range(rows)]
    for size in (500, 3000, 1 << 27, 700):
        splits(size)
        got = sorted((r.source_order, r.id) for r in df.collect())
        assert got == list(enumerate(want))


def test_preamble_rows_keep_their_numbers_when_splits_change(spark, splits, tmp_path):
    head = "# about\nDate/Time\tLongitude\tLatitude\tDepth\n"
    (tmp_path / "t.tab").write_text("some\ntext\n" + head + "".join(f"2020-01-01T{i % 24:02d}:00\t{i}\t{i / 2}\t{i}\n" for i in range(400)))
    splits(300)
    df = read_preamble_tsv(spark, str(tmp_path / "t.tab"), {"source": "s"}, "row-")
    splits(5000)
    assert {(r.source_record_id, r.Depth) for r in df.collect()} == {(f"row-{i + 1}", str(i)) for i in range(400)}


def test_steps_on_geojson_records_are_formed_once(spark, tmp_path):
    from tidewake.sources.geojson import feature_lines

    (tmp_path / "a.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":"}"}},{"type":"Feature"}]}')
    lines = feature_lines(spark, str(tmp_path))
    assert sorted(r.feature for r in lines.where("number IS NOT NULL").collect()) == ['{"type":"Feature","properties":{"a":"}"}}', '{"type":"Feature"}']
    assert "Window" not in lines._jdf.queryExecution().toString()
