"""Readers, writers, normalisation and builds on files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewake.operators import crosswalk, provenance
from tidewake.operators.normalize import detect_fields, missing_fields, normalize_user_input, resolve_columns
from tidewake.plans.build import BuildRequest, number_sources, research_build, write_package
from tidewake.schema import EMPTY_LAYERS
from tidewake.sources import observations as readers
from tidewake.sources import sinks
from tidewake.sources.events import geocoded_events, read_event_csv


def test_csv_order_over_files_and_splits(spark, tmp_path):
    n = 0
    for part in ("a", "b", "c"):
        with open(tmp_path / f"{part}.csv", "w") as f:
            f.write("k,mmsi\n")
            for _ in range(500):
                f.write(f"{n},412000123.0\n")
                n += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = readers.read_delimited(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.source_order for r in rows) == list(range(1500))
    assert all(int(r.k) == r.source_order for r in rows)


def test_geojson_points(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"timestamp": "2025-01-01T00:00:00Z", "ship_name": "PLAN 533"},
         "geometry": {"type": "Point", "coordinates": [122.0, 24.0]}}]}
    path = tmp_path / "local.geojson"
    path.write_text(json.dumps(doc))
    raw = readers.read_raw(spark, str(path))
    assert "geometry_lon" in raw.columns
    obs = normalize_user_input(raw, build_id="b", source_name="local.geojson").collect()[0]
    assert (obs.longitude, obs.latitude, obs.source_type) == (122.0, 24.0, "USER_SUPPLIED")
    doc["crs"] = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}
    path.write_text(json.dumps(doc))
    with pytest.raises(ValueError):
        readers.read_raw(spark, str(path))


def test_unsupported_suffix():
    with pytest.raises(ValueError):
        readers.file_format("x.xlsx")


def test_ambiguous_and_missing_fields():
    mapping, findings = detect_fields(["lat", "latitude", "lon", "timestamp", "id"])
    assert [f for f in findings if f.code == "several" and f.field == "latitude"][0].columns and "latitude" not in mapping
    assert "latitude" in {f.field for f in missing_fields(mapping)}
    assert "latitude" not in {f.field for f in missing_fields(mapping, has_point=True)}
    assert [f.field for f in missing_fields({"latitude": "a", "longitude": "b", "timestamp_start": "c"})] == ["identity"]
    assert resolve_columns(["LAT", "x", "Time", "mmsi"]) == {"latitude": "LAT", "longitude": "x", "timestamp_start": "Time", "MMSI": "mmsi"}
    with pytest.raises(ValueError):
        resolve_columns(["a"], {"latitude": "b"})


def test_user_input_needs_confirmation(spark):
    raw = spark.createDataFrame([("1", 0)], "lat string, source_order long")
    with pytest.raises(ValueError, match="name the columns"):
        normalize_user_input(raw, build_id="b", source_name="s")


def test_preamble_tsv(spark, tmp_path):
    (tmp_path / "cruise.tab").write_text(
        "/* about */\nfree text\nDate/Time\tLongitude\tLatitude\tDepth water [m]\n"
        "2012-07-17T00:00:00\t122.0\t30.0\t50\n2012-07-17T00:10:00\t122.1\t30.1\t51\n")
    rows = readers.read_preamble_tsv(spark, str(tmp_path), {"entity_id": "cruise-1", "source_type": "PUBLIC_TRACK"}, "P:").collect()
    assert sorted((r.source_record_id, r.longitude, r.entity_id) for r in rows) == [("P:1", "122.0", "cruise-1"), ("P:2", "122.1", "cruise-1")]
    (tmp_path / "cruise.tab").write_text("nothing\n")
    with pytest.raises(ValueError):
        readers.read_preamble_tsv(spark, str(tmp_path), {}, "P:")


def test_event_release_in_code_page(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_bytes(
        "event_id,event_date,latitude,longitude,level,radius,source,location\n"
        "1,07/04/12,10.5,114.2,2,0.4,press,Caf\xe9 Reef\n2,bad,,114.0,1,0.1,press,x\n3,01/02/98,1,2,0,0,s,y\n4,01/02/98,1,2,5,0,s,y\n".encode("cp1252"))
    rows = {r.event_id: r for r in geocoded_events(read_event_csv(spark, str(path))).collect()}
    assert set(rows) == {"1", "3", "4"}
    assert (rows["1"].confidence, rows["1"].uncertainty_radius_degrees, rows["1"].location_label) == ("MEDIUM", 0.4, "Café Reef")
    assert rows["1"].start_time == "2012-07-04T00:00:00Z" and rows["3"].start_time == "1998-01-02T00:00:00Z"
    assert rows["3"].confidence == "MEDIUM" and rows["4"].confidence == "LOW"
    with pytest.raises(ValueError):
        geocoded_events(spark.createDataFrame([("1",)], "event_id string"))


def test_bulk_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("mmsi,year\n412000001,2020\n".encode("utf-8-sig"))
    assert readers.read_bulk(spark, str(tmp_path / "b.csv")).columns[0] == "mmsi"


def test_empty_layers_are_typed(spark):
    for layer in EMPTY_LAYERS:
        assert sinks.empty_layer(spark, layer).count() == 0
    assert dict(sinks.empty_layer(spark, "gaps").dtypes)["gap_seconds"] == "double"


def test_manifest_and_tamper(spark, tmp_path):
    import hashlib

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub" / "b.txt").write_text("b")
    before = provenance.file_manifest(spark, str(tmp_path))
    rows = {r.path: (r.bytes, r.sha256) for r in before.collect()}
    assert rows == {p: (os.path.getsize(tmp_path / p), hashlib.sha256((tmp_path / p).read_bytes()).hexdigest()) for p in ("a.txt", "sub/b.txt")}
    kept = spark.createDataFrame([(p, b, s) for p, (b, s) in rows.items()], "path string, bytes long, sha256 string")
    (tmp_path / "a.txt").write_text("changed")
    os.remove(tmp_path / "sub" / "b.txt")
    errors = provenance.verify_manifest(kept, provenance.file_manifest(spark, str(tmp_path)))
    assert {r.error for r in errors.collect()} == {"sha256:a.txt", "missing:sub/b.txt"}


def test_files_are_hashed_block_by_block(spark, tmp_path):
    import hashlib

    (tmp_path / "big file.bin").write_bytes(b"x" * 5_000_000)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "100%41 a+b").write_bytes(b"z")
    rows = {r.path: r for r in provenance.file_manifest(spark, str(tmp_path)).collect()}
    assert rows["big file.bin"].sha256 == hashlib.sha256(b"x" * 5_000_000).hexdigest() and rows["big file.bin"].bytes == 5_000_000
    assert rows["empty"].sha256 == hashlib.sha256(b"").hexdigest() and rows["100%41 a+b"].bytes == 1
    opened = provenance.file_manifest(spark, str(tmp_path), lambda path: __import__("io").BytesIO(b"y"))
    assert {r.sha256 for r in opened.collect()} == {hashlib.sha256(b"y").hexdigest()}


def test_lineage_errors_and_warnings(spark):
    arts = spark.createDataFrame([("map.png", "h1", "b", "s", "t")], "path string, sha256 string, build_path string, source_path string, style_path string")
    manifests = spark.createDataFrame([("b", "hb"), ("s", "hs"), ("t", "ht")], "path string, sha256 string")
    records = provenance.sidecars(arts, manifests)
    cols = "path string, manifest_id string, source_manifest_id string, source_manifest_sha256 string, palette_sha256 string, canonical_repository string, release_sha256 string"
    contents = spark.createDataFrame(
        [("b", None, "m1", "hs", "p1", None, None), ("s", "m1", None, None, None, None, None), ("t", None, None, None, "p1", None, None)], cols)
    files = manifests.unionByName(spark.createDataFrame([("map.png", "h1")], "path string, sha256 string"))
    ok = provenance.verify_lineage(records, files, contents).collect()[0]
    assert ok.ok and len(ok.warnings) == 2
    bad = files.withColumn("sha256", F.when(F.col("path").isin("map.png", "s"), "zz").otherwise(F.col("sha256")))
    row = provenance.verify_lineage(records, bad, contents).collect()[0]
    assert not row.ok and set(row.errors) == {"artifact-sha256-mismatch", "source-manifest-sha256-mismatch"}


def test_table_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.range(1000).withColumn("v", F.col("id") * 2)
    same = provenance.table_fingerprint(a.repartition(7)).collect()
    assert provenance.table_fingerprint(a).collect() == same
    assert provenance.table_fingerprint(a.withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("v")))).collect() != same


def test_executed_interface_is_none_when_not_searched(spark):
    cw = spark.createDataFrame(
        [("V1", "", "", "77", "Name A", "CCG"), ("V2", "412000001", "412000002", "", "Name B", "MILITIA;FISHING"), ("V3", "412000009", "", "", "C", "PLAN")],
        "vessel_key string, mmsi_primary string, mmsi_secondary string, hull_number string, name_en string, actor_family string")
    bulk = spark.createDataFrame(
        [("412000002", 2020, "CHN", "trawler"), ("412000002", 2018, "", "seiner")], "mmsi string, yr int, flag string, vessel_class string")
    rows = {r.entity_key: r for r in crosswalk.resolve_crosswalk(cw, bulk).collect()}
    assert rows["V1"].executed_interface == "NONE" and rows["V1"].resolution_status == "NOT_TESTED"
    assert rows["V2"].reported_mmsi == "412000002" and rows["V2"].bulk_summary_years == "2018;2020"
    assert rows["V2"].actor_type == "MARITIME_MILITIA" and rows["V2"].flag == "CHN"
    assert rows["V3"].resolution_status == "NO_IDENTITY_MATCH"
    assert {r.entity_key: r.executed_interface for r in crosswalk.resolve_crosswalk(cw, bulk, bulk_loaded=False).collect()}["V2"] == "NONE"


def test_note_is_appended_once(spark):
    df = spark.createDataFrame([("First.",), ("First. Second.",)], "n string")
    assert [r[0] for r in df.select(crosswalk.append_note(F.col("n"), "Second.")).collect()] == ["First. Second.", "First. Second."]


def test_offline_package(spark, tmp_path):
    rows = [("v1", f"2025-01-01T0{h}:00:00Z", 22.0 + h / 100, 122.0, h) for h in range(5)]
    a = spark.createDataFrame(rows, "entity_id string, timestamp_start string, latitude double, longitude double, source_order long")
    from tidewake.operators.normalize import normalize

    obs = normalize(a, build_id="b", source_type="AIS", source_name="feed", license_text="l", attribution="x")
    far = obs.withColumns({"longitude": F.lit(10.0), "observation_id": F.concat("observation_id", F.lit("-far"))})
    request = BuildRequest("b", (120.0, 20.0, 125.0, 26.0), start_date="2025-01-01", end_date="2025-01-01")
    result = research_build(request, number_sources(obs, far))
    sources = spark.createDataFrame([("s1", "p", "d", "CC0", True)], "source_id string, provider string, dataset string, licence string, commercial_use_known boolean")
    write_package(result, str(tmp_path), sources=sources)
    assert spark.read.parquet(f"{tmp_path}/data/observations").count() == 5
    assert spark.read.parquet(f"{tmp_path}/data/track_segments").collect()[0].point_count == 5
    assert spark.read.parquet(f"{tmp_path}/data/events").count() == 0
    assert sinks.pair_difference(spark, f"{tmp_path}/metadata", "source_licences").count() == 0
    summary = {r.dataset: r.rows for r in sinks.case_summary(spark, f"{tmp_path}/derived", ["cleaned_points", "track_summary"]).collect()}
    assert summary == {"cleaned_points": 5, "track_summary": 1}
    manifest = json.loads("".join(open(os.path.join(f"{tmp_path}/metadata/build", f)).read() for f in os.listdir(f"{tmp_path}/metadata/build") if f.endswith(".json")))
    assert manifest["evidence"]["cleaned_observations"] == 5
