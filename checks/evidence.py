"""Checked queries: readers, normalisation, identity, catalogue, layers, provenance, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.files import folder, written, written_each
from checks.quality import _SEGMENTS as SEGMENTS_SQL
from checks.quality import ALL_FLAGS, BAD_POSITION, CLEANED, CONFIG, LINKED_SQL, cleaned_of
from checks.registry import Inputs, query
from tidewake.functions.identity import actor_names, mixed_token
from tidewake.operators import audit, catalog, identity, layers, normalize, provenance, qc, segments
from tidewake.plans.ordered import micros

from tidewake.session import stage
from tidewake.sources import events as event_source
from tidewake.sources import observations as readers
from tidewake.sources import sinks

# --- readers ----------------------------------------------------------------------------------

def _columns(t):
    """Rows in source order, so that the order of the written lines is known."""
    return t.view("observations").orderBy("source_order").select(
        "observation_id", "entity_id", "latitude", "longitude", "mmsi")


_ORDERED = """SELECT row_number() OVER (ORDER BY source_order) - 1 AS source_order, observation_id, mmsi, entity_id, latitude, longitude FROM observations"""


def _read_back(t: Inputs, fmt: str):
    path = written(t, fmt, _columns(t), fmt)
    raw = readers.read_raw(t.spark, path, fmt)
    return raw.select(
        "source_order", "observation_id", F.col("mmsi"), F.col("entity_id"), normalize.to_number(F.col("latitude")).alias("latitude"),
        normalize.to_number(F.col("longitude")).alias("longitude"))


@query("src2_csv_scan", _ORDERED, views=("observations",))
def src2(t):
    return _read_back(t, "csv")


@query("src2_tsv_scan", _ORDERED, views=("observations",))
def src2b(t):
    return _read_back(t, "tsv")


@query("src1_read_observations", f"""SELECT source_order, observation_id, entity_id, latitude, longitude, mmsi AS "MMSI",
  'AIS' AS source_type, 'feed' AS source_name, 'OBSERVED' AS observed_or_inferred, 'b1' AS build_id FROM ({_ORDERED})""", views=("observations",))
def src1(t):
    df = _columns(t).select(
        "observation_id", "entity_id", F.col("latitude").alias("Lat"), F.col("longitude").alias("LNG"), F.col("mmsi").alias("MMSI"))
    path = written(t, "feed", df, "csv")
    out = readers.read_observations(t.spark, path, build_id="b1", source_type="AIS", source_name="feed", fmt="csv")
    return out.select("source_order", "observation_id", "entity_id", "latitude", "longitude", "MMSI", "source_type", "source_name",
                      "observed_or_inferred", "build_id")


@query("src3_geojson_scan", """SELECT row_number() OVER (ORDER BY concat('part=', coalesce(entity_id, 'none'), '/'), source_order) - 1 AS source_order,
  entity_id, longitude AS geometry_lon, latitude AS geometry_lat FROM observations""", views=("observations",))
def src3(t):
    # one file per vessel, and one for rows without any, each a feature collection
    rows = t.view("observations")
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct("entity_id").alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"))
    # a dot, like a slash, comes before the digits: the files' order is that of the SQL
    name = F.concat(F.lit("part="), F.coalesce("entity_id", F.lit("none")), F.lit(".json"))
    path = written_each(t, "geojson", rows.select(name.alias("file"), F.to_json(feature).alias("value"), "source_order"), "source_order",
                        '{"type":"FeatureCollection","features":[', ",", "]}\n")
    return readers.read_geojson(t.spark, path).select("source_order", "entity_id", "geometry_lon", "geometry_lat")


@query("src4_preamble_tsv", """SELECT concat('CRUISE:', CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS varchar)) AS source_record_id,
  CAST(ts AS varchar) AS timestamp_start, CAST(user_id AS varchar) AS longitude, CAST(value AS varchar) AS latitude, 'PUBLIC_TRACK' AS source_type FROM events""")
def src4(t):
    e = t.table("events")
    line = F.concat_ws("\t", F.col("ts").cast("string"), F.col("user_id").cast("string"), F.col("value").cast("string"), F.lit("12.5"))
    head = "/* comment */\nmore text\n" + readers.PREAMBLE_MARKER + "Depth water [m]\n"
    # one file per cruise
    name = F.concat(F.lit("part="), F.coalesce(F.col("user_id").cast("string"), F.lit("none")), F.lit(".tab"))
    path = written_each(t, "cruises", e.select(name.alias("file"), line.alias("value"), "event_id"), "event_id", head)
    out = readers.read_preamble_tsv(t.spark, path, {"source_type": "PUBLIC_TRACK"}, "CRUISE:")
    return out.select("source_record_id", "timestamp_start", "longitude", "latitude", "source_type")


_EVENTS = """SELECT event_id, CASE WHEN TRY_CAST(level AS bigint) = 1 THEN 'HIGH' WHEN TRY_CAST(level AS bigint) <= 4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  strftime(try_strptime(event_date, '%m/%d/%y'), '%Y-%m-%dT%H:%M:%SZ') AS start_time, TRY_CAST(level AS bigint) AS location_precision_level,
  TRY_CAST(radius AS double) AS uncertainty_radius_degrees, coalesce(location, '') AS location_label, TRY_CAST(number_of_report AS double) AS report_count,
  TRY_CAST(longitude AS double) AS longitude, TRY_CAST(latitude AS double) AS latitude
  FROM event_release WHERE TRY_CAST(longitude AS double) IS NOT NULL AND TRY_CAST(latitude AS double) IS NOT NULL"""
_EVENT_COLUMNS = ("event_id", "confidence", "start_time", "location_precision_level", "uncertainty_radius_degrees",
                  "location_label", "report_count", "longitude", "latitude")


@query("src5_geocoded_events", _EVENTS, views=("event_release",))
def src5(t):
    path = written(t, "release", t.view("event_release"), "csv", encoding="windows-1252") if _legacy(t) else ""
    return event_source.geocoded_events(event_source.read_event_csv(t.spark, path)).select(*_EVENT_COLUMNS)


def _legacy(t) -> bool:
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return True


@query("src6_seed_scan", "SELECT vessel_key, mmsi_primary, mmsi_secondary, hull_number FROM crosswalk", views=("crosswalk",))
def src6(t):
    path = written(t, "seed", t.view("crosswalk"), "csv", emptyValue="")
    return readers.read_seed(t.spark, path).select("vessel_key", "mmsi_primary", "mmsi_secondary", "hull_number")


@query("src8_region_boxes", "SELECT region, xmin, ymin, xmax, ymax, convention FROM boxes", views=("boxes",))
def src8(t):
    from tidewake.sources.dimensions import read_regions

    box = F.array("xmin", "ymin", "xmax", "ymax")
    df = t.view("boxes").select(
        "region", F.when(F.col("convention") == "180", box).alias("bbox_180"),
        F.when(F.col("convention") == "360", box).alias("bbox_360"), "profile")
    return read_regions(t.spark, written(t, "regions", df, "json")).select("region", "xmin", "ymin", "xmax", "ymax", "convention")


@query("src8_registry_load", "SELECT entity_id, canonical_name, actor_type FROM registry", views=("registry",))
def src8b(t):
    from tidewake.sources.dimensions import read_registry

    df = t.view("registry").withColumn("aliases", F.array("alias_name")).drop("alias_name")
    return read_registry(t.spark, written(t, "registry", df, "json")).select("entity_id", "canonical_name", "actor_type")


@query("src8_profile_load", """SELECT CAST(p_partkey AS varchar) AS profile, CAST(p_size % 5 - 1 AS int) AS label_rank_max, p_brand AS coastline_detail, CAST(p_size * -100 AS int) AS deepest FROM part""")
def src8c(t):
    from tidewake.sources.dimensions import read_profiles

    df = t.table("part").select(
        F.col("p_partkey").cast("string").alias("profile"), (F.col("p_size") % 5 - 1).cast("int").alias("label_rank_max"),
        F.col("p_brand").alias("coastline_detail"), F.array(F.lit(-200), (F.col("p_size") * -100).cast("int")).alias("contour_levels_m"))
    return read_profiles(t.spark, written(t, "profiles", df, "json")).select(
        "profile", "label_rank_max", "coastline_detail", F.element_at("contour_levels_m", -1).alias("deepest"))


@query("src8_source_load", "SELECT source_id, title, provider, licence FROM sources", views=("sources",))
def src8d(t):
    from tidewake.sources.dimensions import read_sources

    df = t.view("sources").select("source_id", "title", "provider", "licence")
    return read_sources(t.spark, written(t, "sources", df, "json")).select("source_id", "title", "provider", "licence")


@query("src9_adapter_coverage", """SELECT a.adapter_id, a.mode, a.source_type, count(o.source_order) AS observations FROM (VALUES
  ('global_fishing_watch','IMPORT_OR_AUTHENTICATED_API','AIS'),('global_fishing_watch','IMPORT_OR_AUTHENTICATED_API','SAR_DETECTION'),('global_fishing_watch','IMPORT_OR_AUTHENTICATED_API','PORT_RECORD'),
  ('japan_official','PUBLIC_NORMALIZED_IMPORT','OFFICIAL_OBSERVATION'),('taiwan_official','PUBLIC_NORMALIZED_IMPORT','OFFICIAL_OBSERVATION'),('taiwan_official','PUBLIC_NORMALIZED_IMPORT','PORT_RECORD'),
  ('viirs_boat_detection','IMPORT','VIIRS_BOAT_DETECTION'),('byo','LOCAL_IMPORT','AIS'),('byo','LOCAL_IMPORT','SAR_DETECTION'),('byo','LOCAL_IMPORT','OPTICAL_DETECTION'),
  ('byo','LOCAL_IMPORT','PORT_RECORD'),('byo','LOCAL_IMPORT','USER_SUPPLIED'),('byo','LOCAL_IMPORT','LICENSED_EXTERNAL')) a(adapter_id, mode, source_type)
  LEFT JOIN observations o USING (source_type) GROUP BY 1, 2, 3""", views=("observations",))
def src9(t):
    return catalog.adapter_coverage(t.view("observations")).select("adapter_id", "mode", "source_type", "observations")


@query("src12_required_columns", "SELECT count(*) AS complete_rows FROM event_release", views=("event_release",))
def src12(t):
    from tidewake.schema import require_columns

    return require_columns(t.view("event_release"), event_source.REQUIRED, "event source").agg(F.count("*").alias("complete_rows"))


@query("src13_record_validation", """SELECT entity_id AS row_key, 'actor_type' AS rule FROM r WHERE actor_type = 'CARGO'
  UNION ALL SELECT entity_id, 'canonical_name' FROM r WHERE canonical_name = ''""".replace("SELECT entity_id AS", """WITH r AS (SELECT concat('e-', CAST(c_custkey AS varchar)) AS entity_id,
   CASE WHEN c_custkey % 17 = 0 THEN '' ELSE c_name END AS canonical_name, CASE WHEN c_nationkey = 3 THEN 'CARGO' ELSE 'PLAN' END AS actor_type FROM customer)
  SELECT entity_id AS""", 1))
def src13(t):
    c = t.table("customer")
    r = c.select(
        F.concat(F.lit("e-"), F.col("c_custkey").cast("string")).alias("entity_id"),
        F.when(F.col("c_custkey") % 17 == 0, "").otherwise(F.col("c_name")).alias("canonical_name"),
        F.when(F.col("c_nationkey") == 3, "CARGO").otherwise("PLAN").alias("actor_type"))
    return catalog.validate_registry(r).select("row_key", "rule")


@query("src15_availability_ledger", """WITH x AS (SELECT source_id, CASE WHEN access_class = 'COMMERCIAL' THEN 'local' WHEN access_class = 'OPEN_API' THEN 'live' ELSE 'large' END AS kind FROM sources),
  a AS (SELECT concat('src-', CAST(o_custkey AS varchar)) AS source_id, count(*) AS n FROM orders GROUP BY 1)
  SELECT source_id, kind, coalesce(n, 0) AS records, CASE WHEN kind = 'local' THEN 'LOCAL_ONLY' WHEN n > 0 THEN 'AVAILABLE' WHEN kind = 'large' THEN 'NOT_CACHED_LARGE_SOURCE'
    ELSE 'UNAVAILABLE_OFFLINE_MODE' END AS availability FROM x LEFT JOIN a USING (source_id)""", views=("sources",))
def src15(t):
    kind = F.when(F.col("access_class") == "COMMERCIAL", "local").when(F.col("access_class") == "OPEN_API", "live").otherwise("large")
    expected = t.view("sources").select("source_id", kind.alias("kind"))
    actual = t.table("orders").select(F.concat(F.lit("src-"), F.col("o_custkey").cast("string")).alias("source_id"))
    return catalog.availability_ledger(expected, actual, live=False).drop("warning")


# --- normalisation ----------------------------------------------------------------------------


def _user(t):
    return normalize.normalize_user_input(t.view("user_file"), build_id="b7", source_name="user.csv")


_MMSI = "regexp_replace(mmsi, '\\.0$', '')"


def _normal(name, sql, columns):
    @query(name, sql + " FROM user_file", views=("user_file",))
    def run(t: Inputs):
        return _user(t).select("source_order", *columns)


_normal("nrm1_alias_mapping", f"""SELECT source_order, observed_at AS timestamp_start, {_MMSI} AS "MMSI", ship_name AS vessel_name""", ["timestamp_start", "MMSI", "vessel_name"])
_normal("nrm2_field_detection", "SELECT source_order, TRY_CAST(lat AS double) AS latitude, TRY_CAST(lng AS double) AS longitude", ["latitude", "longitude"])
_normal("nrm3_canonical_projection", 'SELECT source_order, CAST(NULL AS varchar) AS hull_number, CAST(NULL AS varchar) AS "IMO", CAST(NULL AS double) AS position_uncertainty_m, \'UNKNOWN\' AS actor_type',
        ["hull_number", "IMO", "position_uncertainty_m", "actor_type"])
_normal("nrm5_default_fills", """SELECT source_order, coalesce(source_type, 'USER_SUPPLIED') AS source_type, 'user.csv' AS source_name, 'USER_SUPPLIED' AS observation_method,
  'UNKNOWN' AS identity_confidence, 'UNKNOWN' AS position_confidence, 'OBSERVED' AS observed_or_inferred, 'USER_SUPPLIED_REVIEW_REQUIRED' AS license, 'b7' AS build_id""",
        ["source_type", "source_name", "observation_method", "identity_confidence", "position_confidence", "observed_or_inferred", "license", "build_id"])
_normal("nrm6_record_id", "SELECT source_order, concat('user.csv:', CAST(source_order AS varchar)) AS source_record_id", ["source_record_id"])
_normal("nrm7_dates", "SELECT source_order, strftime(CAST(observed_at AS timestamp), '%Y-%m-%d') AS source_date, observed_at AS timestamp_end", ["source_date", "timestamp_end"])
_normal("nrm8_numeric_coercion", "SELECT source_order, TRY_CAST(lat AS double) AS latitude", ["latitude"])
_normal("nrm10_observation_id", f"""SELECT source_order, concat('obs-', substr(sha256(concat_ws(chr(31), 'user.csv', CAST(source_order AS varchar), observed_at,
  CASE WHEN lat = 'bad' THEN '' WHEN abs(CAST(lat AS double)) < 1 THEN lat ELSE lat END, lng,
  CASE WHEN mmsi IS NULL THEN coalesce(ship_name, '') ELSE concat('user-', substr(sha256({_MMSI}), 1, 16)) END)), 1, 20)) AS observation_id""", ["observation_id"])
_normal("nrm11_local_entity", f"SELECT source_order, CASE WHEN mmsi IS NULL THEN '' ELSE concat('user-', substr(sha256({_MMSI}), 1, 16)) END AS entity_id", ["entity_id"])


@query("nrm9_time_coercion", f"SELECT source_order, epoch_us(TRY_CAST(observed_at AS timestamp)) AS t FROM user_file", views=("user_file",))
def nrm9(t):
    return _user(t).select("source_order", micros(F.col("event_time")).alias("t"))


@query("nrm4_geometry_fill", f"SELECT source_order, coalesce(TRY_CAST(lat AS double), 1.5) AS latitude, coalesce(TRY_CAST(lng AS double), 2.5) AS longitude FROM user_file".replace("1.5)", "1.5::double)").replace("2.5)", "2.5::double)"), views=("user_file",))
def nrm4(t):
    raw = t.view("user_file").withColumns({"geometry_lon": F.lit(2.5), "geometry_lat": F.lit(1.5)})
    return normalize.normalize(
        raw, build_id="b", source_type="AIS", source_name="n", license_text="l", attribution="a"
    ).select("source_order", "latitude", "longitude")


_USER_OBSERVATIONS = f"""observations AS (SELECT source_order, CAST(source_order AS varchar) AS observation_id,
  CASE WHEN mmsi IS NOT NULL THEN concat('user-', substr(sha256({_MMSI}), 1, 16)) END AS entity_id, TRY_CAST(observed_at AS timestamp) AS event_time,
  TRY_CAST(lat AS double) AS latitude, TRY_CAST(lng AS double) AS longitude, concat('user.csv:', CAST(source_order AS varchar)) AS source_record_id,
  {_MMSI} AS mmsi, 'OBSERVED' AS observed_or_inferred, 'UNKNOWN' AS actor_type, coalesce(source_type, 'USER_SUPPLIED') AS source_type,
  'user.csv' AS source_name, CAST(NULL AS varchar) AS source_segment_id FROM user_file)"""


@query("nrm12_user_import", f"""WITH {_USER_OBSERVATIONS}, {ALL_FLAGS.strip()}, {SEGMENTS_SQL[len(CLEANED):].strip().lstrip(',').strip()}
 SELECT 'HIGH' AS confidence, false AS requires_confirmation, (SELECT count(*) FROM observations) AS record_count,
  (SELECT count(*) FROM observations WHERE NOT ({BAD_POSITION})) AS valid_points, (SELECT min(longitude) FROM observations WHERE NOT ({BAD_POSITION})) AS xmin,
  (SELECT epoch_us(max(event_time)) FROM observations) AS last_us,
  (SELECT count(*) FROM cleaned) AS cleaned_positions, (SELECT count(*) FROM observations) - (SELECT count(*) FROM cleaned) AS excluded_positions,
  (SELECT count(*) FROM flags WHERE flag = 'DUPLICATE_OBSERVATION') AS duplicate_positions,
  (SELECT count(*) FROM flags WHERE flag = 'INVALID_COORDINATE') AS invalid_coordinates, (SELECT count(*) FROM flags WHERE flag = 'MISSING_TIME') AS invalid_timestamps,
  (SELECT count(*) FROM flags WHERE flag = 'LARGE_OBSERVATION_GAP') AS large_gaps, (SELECT count(*) FROM segs) AS track_segments""", views=("user_file",), recursive=True)
def nrm12(t):
    from tidewake.plans.build import import_user_rows

    _, summary = import_user_rows(t.view("user_file"), build_id="b7", source_name="user.csv", quality=CONFIG)
    return summary.select(
        "confidence", "requires_confirmation", "record_count", "valid_points", "xmin", micros(F.col("last_time")).alias("last_us"), "cleaned_positions",
        "excluded_positions", "duplicate_positions", "invalid_coordinates", "invalid_timestamps", "large_gaps", "track_segments")


@query("nrm13_identity_token", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS token FROM customer")
def nrm13(t):
    return t.table("customer").select("c_custkey", mixed_token(F.col("c_name")).alias("token"))


@query("nrm13_identity_token_unicode", r"""SELECT word, regexp_replace(replace(lower(word), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS token
  FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents)""")
def nrm13u(t):
    words = t.table("documents").select("doc_id", F.explode(F.split("text", "\\s+")).alias("word"))
    return words.select("word").distinct().select("word", mixed_token(F.col("word")).alias("token"))


@query("nrm14_actor_names", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'PLAN' WHEN 1 THEN 'CCG,RESEARCH_SURVEY' WHEN 2 THEN 'RESEARCH_SURVEY,TANKER' ELSE 'PLAN,MARITIME_MILITIA' END AS actors FROM customer""")
def nrm14(t):
    k = F.col("c_custkey") % 4
    given = (F.when(k == 0, F.array(F.lit("plan"), F.lit("PLA Navy"))).when(k == 1, F.array(F.lit("Coast-Guard"), F.lit("survey"), F.lit("ccg")))
             .when(k == 2, F.array(F.lit("research"), F.lit(" tanker "))).otherwise(F.array(F.lit("Plan"), F.lit("maritime militia"))))
    return t.table("customer").select("c_custkey", F.array_join(actor_names(given), ",").alias("actors"))


_RECORDS = """SELECT source_id, provider, title AS dataset, coalesce(nullif(version, ''), released) AS version_or_date,
  coalesce(nullif(homepage, ''), nullif(repository, '')) AS url, licence, 'NOT_SPECIFIED' AS allowed_use, true AS attribution_required, 'UNKNOWN' AS redistribution_allowed,
  coalesce(commercial_use_known, false) AS commercial_use_known, 'AVAILABLE' AS availability FROM sources"""


@query("nrm16_manifest_records", _RECORDS, views=("sources",))
def nrm16(t):
    return catalog.manifest_records(t.view("sources")).drop("layers", "transformations", "spatial_resolution")


@query("nrm17_license_rows", f"SELECT source_id, licence AS license, allowed_use, commercial_use_known, CASE WHEN commercial_use_known THEN '' ELSE 'COMMERCIAL_USE_REQUIRES_REVIEW' END AS warning FROM ({_RECORDS})", views=("sources",))
def nrm17(t):
    return catalog.license_rows(catalog.manifest_records(t.view("sources"))).select(
        "source_id", "license", "allowed_use", "commercial_use_known", "warning")


# --- identity ---------------------------------------------------------------------------------

_INDEX = """idx AS (
  SELECT field, token, count(DISTINCT entity_id) AS matches, min(entity_id) AS match_id FROM (
    SELECT entity_id, 'MMSI' AS field, mmsi AS token FROM registry UNION ALL SELECT entity_id, 'hull_number', hull_number FROM registry
    UNION ALL SELECT entity_id, 'name', regexp_replace(lower(canonical_name), '[^a-z0-9]', '', 'g') FROM registry
    UNION ALL SELECT entity_id, 'name', regexp_replace(lower(alias_name), '[^a-z0-9]', '', 'g') FROM registry) GROUP BY 1, 2)"""
_WATERFALL = f"""WITH {_INDEX}, resolved AS (SELECT s.*, r.entity_id AS known, r.actor_type AS r_actor, r.canonical_name AS r_name,
    CASE WHEN s.entity_id IS NOT NULL THEN r.entity_id WHEN m.matches = 1 THEN m.match_id WHEN m.matches > 1 THEN NULL WHEN h.matches = 1 THEN h.match_id
         WHEN h.matches > 1 THEN NULL WHEN n.matches = 1 THEN n.match_id END AS resolved_id,
    CASE WHEN s.entity_id IS NOT NULL THEN CASE WHEN r.entity_id IS NULL THEN 'UNKNOWN' ELSE 'DOCUMENTED' END
         WHEN m.matches IS NOT NULL THEN CASE WHEN m.matches = 1 THEN 'DOCUMENTED' ELSE 'UNKNOWN' END
         WHEN h.matches IS NOT NULL THEN CASE WHEN h.matches = 1 THEN 'DOCUMENTED' ELSE 'UNKNOWN' END WHEN n.matches = 1 THEN 'REPORTED' ELSE 'UNKNOWN' END AS confidence,
    CASE WHEN s.entity_id IS NOT NULL THEN 'entity_id' WHEN m.matches IS NOT NULL THEN 'MMSI' WHEN h.matches IS NOT NULL THEN 'hull_number'
         WHEN n.matches IS NOT NULL THEN 'vessel_name' END AS matched_on,
    s.entity_id IS NULL AND coalesce(coalesce(m.matches, h.matches, n.matches) > 1, false) AS ambiguous
  FROM sightings s LEFT JOIN registry r ON s.entity_id = r.entity_id LEFT JOIN idx m ON m.field = 'MMSI' AND m.token = s.mmsi
  LEFT JOIN idx h ON h.field = 'hull_number' AND h.token = s.hull_number
  LEFT JOIN idx n ON n.field = 'name' AND n.token = regexp_replace(lower(s.vessel_name), '[^a-z0-9]', '', 'g'))"""


def _registry(t):
    return t.view("registry").withColumn("aliases", F.array("alias_name")).drop("alias_name")


@query("jn1_token_index", f"WITH {_INDEX} SELECT * FROM idx", views=("registry",))
def jn1(t):
    return identity.token_index(_registry(t))


@query("jn2_identity_waterfall", _WATERFALL + " SELECT source_order, resolved_id, confidence, matched_on, ambiguous FROM resolved", views=("registry", "sightings"))
def jn2(t):
    return identity.resolve(t.view("sightings"), _registry(t)).select(
        "source_order", "resolved_id", "confidence", "matched_on", "ambiguous")


@query("jn3_registry_enrichment", _WATERFALL + """ SELECT x.source_order, coalesce(x.entity_id, x.resolved_id) AS entity_id, coalesce(g.actor_type, 'UNKNOWN') AS actor_type,
  coalesce(x.vessel_name, g.canonical_name) AS vessel_name, CASE WHEN x.entity_id IS NULL AND x.resolved_id IS NOT NULL THEN x.confidence ELSE 'GIVEN' END AS identity_confidence
  FROM resolved x LEFT JOIN registry g ON g.entity_id = coalesce(x.entity_id, x.resolved_id)""", views=("registry", "sightings"))
def jn3(t):
    s = t.view("sightings").withColumns({"actor_type": F.lit("UNKNOWN"), "identity_confidence": F.lit("GIVEN")})
    return identity.enrich(s, _registry(t)).select("source_order", "entity_id", "actor_type", "vessel_name", "identity_confidence")


@query("jn4_registry_subset", "SELECT entity_id, canonical_name FROM registry WHERE entity_id IN (SELECT entity_id FROM observations)", views=("registry", "observations"))
def jn4(t):
    return identity.registry_subset(t.view("registry"), t.view("observations")).select("entity_id", "canonical_name")


# --- catalogue and layers ---------------------------------------------------------------------


@query("jn10_source_selection", """WITH p AS (SELECT c_custkey, concat('region-', CAST(c_custkey AS varchar)) AS region, CASE c_custkey % 2 WHEN 0 THEN 'land' ELSE 'coastline' END AS layer,
    concat('src-', CAST(c_custkey * 3 AS varchar)) AS first_id, CASE WHEN c_custkey % 7 = 0 THEN concat('src-', CAST(c_custkey AS varchar)) END AS override FROM customer)
  SELECT region, layer, coalesce(override, first_id) AS source_id, coalesce(override, first_id) IN (SELECT source_id FROM sources) AS registered,
    CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'intermediate' ELSE 'global_110m' END AS detail FROM p""", views=("sources",))
def jn10(t):
    key = F.col("c_custkey")
    p = t.table("customer").select(
        F.concat(F.lit("region-"), key.cast("string")).alias("region"), F.when(key % 2 == 0, "land").otherwise("coastline").alias("layer"),
        F.array(F.concat(F.lit("src-"), (key * 3).cast("string")), F.lit("src-1")).alias("source_ids"),
        F.when(key % 7 == 0, F.concat(F.lit("src-"), key.cast("string"))).alias("override"),
        F.when(key % 3 == 0, "local").when(key % 3 == 1, "regional").otherwise("theatre").alias("profile"))
    overrides = p.filter("override IS NOT NULL").select("region", "layer", F.col("override").alias("source_id"))
    chosen = catalog.select_sources(p, t.view("sources"), overrides)
    return chosen.join(p.select("region", catalog.detail_level(F.col("profile")).alias("detail")), "region")


def _confident(t):
    low = F.when(F.col("source_order") % 3 == 0, "LOW").when(F.col("source_order") % 3 == 1, "HIGH")
    return t.view("observations").withColumn("position_confidence", low)


_CONF = "CASE source_order % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' END"


@query("flt7_layer_routing", f"""WITH o AS (SELECT *, {_CONF} AS conf, actor_type IN ('PLAN','CCG','RESEARCH_SURVEY','FISHING') AS own FROM observations)
  SELECT source_order, concat(actor_type, ':official_observations') AS layer FROM o WHERE own AND source_type = 'OFFICIAL_OBSERVATION' AND coalesce(conf, 'UNKNOWN') <> 'LOW'
  UNION ALL SELECT source_order, concat(actor_type, ':uncertain_detections') FROM o WHERE own AND conf = 'LOW'
  UNION ALL SELECT source_order, 'documented_militia' FROM o WHERE actor_type = 'MARITIME_MILITIA'
  UNION ALL SELECT source_order, 'position_points' FROM o WHERE source_type IN ('USER_SUPPLIED','AIS','PUBLIC_TRACK')
  UNION ALL SELECT source_order, 'official_observations' FROM o WHERE source_type = 'OFFICIAL_OBSERVATION'""", views=("observations",))
def flt7(t):
    return layers.route_observations(_confident(t)).select("source_order", "layer")


@query("flt7_event_routing", """SELECT event_id, 'public_events' AS layer FROM events WHERE event_type IN (SELECT min(event_type) FROM events)""")
def flt7c(t):
    e = t.table("events")
    kind = F.when(F.col("event_type") == e.agg(F.min("event_type")).scalar(), "PUBLIC_EVENT").otherwise("AIS")
    return layers.route_events(e.select("event_id", kind.alias("source_type"))).select("event_id", "layer")


@query("flt7_label_routing", """SELECT region, 'orientation_paper' AS layer FROM boxes WHERE convention = '180' UNION ALL SELECT region, 'orientation_media' FROM boxes WHERE profile <> 'local'""", views=("boxes",))
def flt7d(t):
    labels = t.view("boxes").select(
        "region", (F.col("convention") == "180").cast("int").alias("paper_visible"), (F.col("profile") != "local").cast("int").alias("media_visible"))
    return layers.route_labels(labels).select("region", "layer")


_SEGS = LINKED_SQL + """,
segs AS (SELECT segment_id, 'OBSERVED_TRACK' AS segment_type, actor_type FROM observed
  UNION ALL SELECT concat('seg-', substr(sha256(concat(p_id, '|', observation_id)), 1, 16)), 'INFERRED_CONNECTION', p_actor FROM broken WHERE NOT dense AND gap > 0 AND gap <= 604800)"""


@query("flt7_segment_routing", f"""WITH {_SEGS.strip()}, l AS (SELECT *, CASE segment_type WHEN 'OBSERVED_TRACK' THEN 'observed_tracks' ELSE 'inferred_segments' END AS name FROM segs)
  SELECT segment_id, name AS layer FROM l UNION ALL SELECT segment_id, concat(actor_type, ':', name) FROM l WHERE actor_type IN ('PLAN','CCG','RESEARCH_SURVEY','FISHING')""", views=("observations",), recursive=True)
def flt7b(t):
    segs = segments.segments_of(stage(segments.linked_points(cleaned_of(t), CONFIG)), CONFIG)
    return layers.route_segments(segs).select("segment_id", "layer")


@query("agg7_legend", f"""WITH {_SEGS.strip()}, f AS (SELECT actor_type, segment_type AS layer FROM segs UNION ALL SELECT actor_type, 'OFFICIAL_OBSERVATION' FROM cleaned)
  SELECT a.actor_type, k.layer, count(f.layer) AS features, count(f.layer) > 0 AS shown FROM (VALUES ('PLAN'),('CCG'),('RESEARCH_SURVEY'),('FISHING')) a(actor_type),
    (VALUES ('OBSERVED_TRACK'),('INFERRED_CONNECTION'),('OFFICIAL_OBSERVATION')) k(layer) LEFT JOIN f ON f.actor_type = a.actor_type AND f.layer = k.layer GROUP BY 1, 2""".replace(
    "FROM (VALUES ('PLAN')", "FROM (VALUES ('PLAN')").replace("a(actor_type),\n    (VALUES", "a(actor_type) CROSS JOIN (VALUES"), views=("observations",), recursive=True)
def agg7(t):
    cleaned = cleaned_of(t)
    return layers.legend(stage(segments.track_segments(cleaned, CONFIG)), cleaned)


@query("agg7_legend_without_actor", f"""WITH {_SEGS.strip()}, marked AS (SELECT CASE WHEN source_order % 3 = 0 THEN 'OFFICIAL_OBSERVATION' ELSE 'AIS' END AS method FROM cleaned),
  f AS (SELECT segment_type AS layer FROM segs UNION ALL SELECT method FROM marked WHERE method = 'OFFICIAL_OBSERVATION')
  SELECT e.entry, e.layer, count(f.layer) AS features, count(f.layer) > 0 AS shown FROM (VALUES ('Observed Tracks', 'OBSERVED_TRACK'), ('Inferred Segments', 'INFERRED_CONNECTION'),
    ('Official Observations', 'OFFICIAL_OBSERVATION')) e(entry, layer) LEFT JOIN f ON f.layer = e.layer GROUP BY 1, 2""", views=("observations",), recursive=True)
def agg7c(t):
    cleaned = cleaned_of(t)
    method = F.when(F.col("source_order") % 3 == 0, "OFFICIAL_OBSERVATION").otherwise("AIS")
    return layers.legend_without_actor(stage(segments.track_segments(cleaned, CONFIG)), cleaned.withColumn("observation_method", method))


@query("agg7_visible_layers", """SELECT l.layer, count(d.doc_id) AS features, count(d.doc_id) > 0 AS shown FROM (SELECT DISTINCT c_mktsegment AS layer FROM customer UNION SELECT DISTINCT lang FROM documents) l
  LEFT JOIN documents d ON d.lang = l.layer GROUP BY 1""")
def agg7b(t):
    d = t.table("documents").select(F.col("lang").alias("layer"))
    enabled = t.table("customer").select(F.col("c_mktsegment").alias("layer")).union(d).distinct()
    return layers.visible_layers(d, enabled)


@query("snk5_orientation_labels", """SELECT concat(region, '-orientation-1') AS label_id, region AS name, 'place' AS label_role, 1 AS paper_visible, CASE WHEN convention = '360' THEN 0 ELSE 1 END AS media_visible,
    xmin AS longitude, ymin AS latitude FROM boxes
  UNION ALL SELECT concat(region, '-orientation-2'), profile, 'sea', 0, 1, xmax, ymax FROM boxes""", views=("boxes",))
def snk5(t):
    def label(name, x, y, role, paper, media):
        return F.struct(name.alias("name"), x.alias("longitude"), y.alias("latitude"), role.alias("role"), paper.alias("paper"), media.alias("media"))

    none = F.lit(None)
    b = t.view("boxes").select("region", F.array(
        label(F.col("region"), F.col("xmin"), F.col("ymin"), none.cast("string"), none.cast("boolean"), F.when(F.col("convention") == "360", False)),
        label(F.col("profile"), F.col("xmax"), F.col("ymax"), F.lit("sea"), F.lit(False), F.lit(True))).alias("labels"))
    return catalog.orientation_labels(b)


# --- sinks ------------------------------------------------------------------------------------


@query("snk1_named_layers", "SELECT actor_type, count(*) AS rows FROM observations GROUP BY 1", views=("observations",))
def snk1(t):
    root = folder(t, "layers")
    path = sinks.write_layer(t.view("observations"), root, "observations", ("actor_type",))
    return t.spark.read.parquet(path).groupBy("actor_type").agg(F.count("*").alias("rows"))


@query("snk1_reference_layers", """WITH zones AS (SELECT CASE c_custkey % 2 WHEN 0 THEN 'eez_reference' ELSE 'territorial_sea' END AS layer, count(*) AS features FROM customer GROUP BY 1),
  boundaries AS (SELECT 'computed_median' AS layer, count(*) AS features FROM supplier), cells AS (SELECT 'traffic_density' AS layer, count(*) AS features FROM grid),
  have AS (SELECT * FROM zones UNION ALL SELECT * FROM boundaries UNION ALL SELECT * FROM cells)
  SELECT 'layer' AS part, n AS name, coalesce(features, 0) AS rows FROM (VALUES ('eez_reference'), ('territorial_sea'), ('contiguous_zone'), ('maritime_boundary'), ('continental_shelf'),
    ('computed_median'), ('custom_boundary'), ('traffic_density')) l(n) LEFT JOIN have ON layer = n
  UNION ALL SELECT 'AVAILABLE', layer, features FROM have
  UNION ALL SELECT 'UNAVAILABLE', 'contiguous_zone', 0 UNION ALL SELECT 'NOT_CACHED_LARGE_SOURCE', 'satellite', 0
  UNION ALL SELECT 'warning', w, 1 FROM (VALUES ('contiguous_zone: no data, UNAVAILABLE'), ('satellite: no data, NOT_CACHED_LARGE_SOURCE'), ('custom_boundary: selected without a source')) v(w)""", views=("grid",))
def snk1b(t):
    """Reference layers of a package, its availability ledger and its warnings, read back."""
    from tidewake.plans.build import ReferenceData, write_reference
    from tidewake.schema import BOUNDARY_SCHEMA, ZONE_SCHEMA

    def of(df, schema):
        wanted = t.spark.createDataFrame([], schema).schema
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])

    c = t.table("customer").withColumn("layer", F.when(F.col("c_custkey") % 2 == 0, "eez_reference").otherwise("territorial_sea"))
    zones = {name: of(c.filter(F.col("layer") == name).withColumn("source_id", F.col("layer")), ZONE_SCHEMA) for name in ("eez_reference", "territorial_sea")}
    median = of(t.table("supplier").withColumn("source_id", F.lit("computed_median")), BOUNDARY_SCHEMA)
    expected = t.spark.createDataFrame(
        [(n, "remote") for n in ("eez_reference", "territorial_sea", "contiguous_zone", "computed_median", "traffic_density")] + [("satellite", "large")], "source_id string, kind string")
    root = folder(t, "reference")
    layers = write_reference(t.spark, root, ReferenceData(
        zones=zones, boundaries={"computed_median": median}, density=t.view("grid"), expected=expected, enabled=("computed_median", "custom_boundary")))
    ledger = t.spark.read.json(f"{root}/metadata/availability")
    warnings = t.spark.read.json(f"{root}/metadata/warnings")
    return layers.select(F.lit("layer").alias("part"), F.col("layer").alias("name"), F.col("features").alias("rows")).unionAll(
        ledger.select("availability", "source_id", "records")).unionAll(warnings.select(F.lit("warning"), "warning", F.lit(1).cast("long")))


@query("snk2_source_evidence", """SELECT observation_id, entity_id, source_type, source_name, source_record_id, CAST(NULL AS varchar) AS license FROM observations""", views=("observations",))
def snk2(t):
    rows = qc.prepare(t.view("observations"))
    path = written(t, "evidence", sinks.flat(sinks.source_evidence(rows)), "csv")
    return t.spark.read.option("header", True).csv(path).select(
        "observation_id", "entity_id", "source_type", "source_name", "source_record_id", "license")


@query("snk4_typed_empty_layers", "SELECT source_order FROM observations", views=("observations",))
def snk4(t):
    empty = sinks.empty_layer(t.spark, "quality_flags").select("source_order")
    return t.view("observations").select("source_order").unionByName(empty)


@query("cen3_case_summary", """SELECT 'observations' AS dataset, count(*) AS rows FROM observations UNION ALL SELECT 'registry', count(*) FROM registry""", views=("observations", "registry"))
def cen3(t):
    root = folder(t, "package")
    t.view("observations").write.option("header", True).csv(f"{root}/observations")
    t.view("registry").write.option("header", True).csv(f"{root}/registry")
    return sinks.case_summary(t.spark, root, ["observations", "registry"])


# --- provenance -------------------------------------------------------------------------------


# one entry per document
_MANIFEST = """SELECT concat('docs/', CAST(doc_id AS varchar), '.txt') AS path, strlen(text) AS bytes, sha256(text) AS sha256 FROM documents"""


def _manifest(t):
    return t.table("documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


def _files(t):
    """Manifest of real files: every document is written to one."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    name = F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(256)).cast("string"), F.lit("/doc_id="), number, F.lit(".txt"))
    d = t.table("documents").select(name.alias("file"), F.coalesce("text", F.lit("")).alias("value"), "doc_id")
    path = written_each(t, "files", d, "doc_id")
    number = F.regexp_extract("path", r"doc_id=(-?[0-9]*)\.txt$", 1)
    return provenance.file_manifest(t.spark, path).withColumn("path", F.concat(F.lit("docs/"), number, F.lit(".txt")))


_FILES = """SELECT concat('docs/', CAST(doc_id AS varchar), '.txt') AS path, strlen(text) + 1 AS bytes, sha256(concat(text, chr(10))) AS sha256 FROM documents"""


@query("prv1_file_manifest", _FILES)
def prv1(t):
    return _files(t)


@query("prv2_checksum_lines", f"SELECT concat(sha256, '  ', path) AS value FROM ({_FILES})")
def prv2(t):
    return provenance.checksum_lines(_files(t))


@query("src14_pinned_digests", f"""SELECT path AS name, CASE WHEN path LIKE '%7.txt' THEN NULL ELSE path END AS path,
  CASE WHEN path LIKE '%7.txt' THEN 'MISSING' WHEN path LIKE 'docs/1%' THEN 'DIGEST_MISMATCH' ELSE 'OK' END AS status FROM ({_MANIFEST})""")
def src14(t):
    m = _manifest(t)
    expected = m.select(
        F.col("path").alias("name"), F.array(F.concat(F.lit("absent/"), "path"), "path").alias("locations"),
        F.when(F.col("path").like("docs/1%"), "0").otherwise(F.col("sha256")).alias("sha256"))
    return provenance.pinned_digests(expected, m.filter("path NOT LIKE '%7.txt'"))


@query("jn12_manifest_verification", f"""SELECT concat('sha256:', path) AS error FROM ({_MANIFEST}) WHERE path LIKE 'docs/2%'
  UNION ALL SELECT concat('missing:', path, '.gone') FROM ({_MANIFEST})""")
def jn12(t):
    m = _manifest(t)
    expected = m.withColumn("sha256", F.when(F.col("path").like("docs/2%"), "0").otherwise(F.col("sha256"))).unionByName(
        m.withColumn("path", F.concat("path", F.lit(".gone"))))
    return provenance.verify_manifest(expected, m)


@query("prv3_row_fingerprint", """SELECT s_suppkey, sha256(concat('{"s_name":"', s_name, '","s_nationkey":', CAST(s_nationkey AS varchar), ',"s_suppkey":', CAST(s_suppkey AS varchar), '}')) AS fingerprint FROM supplier""")
def prv3(t):
    s = t.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
    return provenance.row_fingerprint(s).select("s_suppkey", "fingerprint")


_WORDS_SUM = ", ".join(f"sum(('0x' || substr(f, {16 * i + 1}, 16))::UBIGINT::HUGEINT) AS w{i}" for i in range(4))


@query("prv3_table_fingerprint", f"""SELECT n AS rows, sha256(concat_ws(':', n, w0, w1, w2, w3)) AS fingerprint FROM (SELECT count(*) AS n, {_WORDS_SUM} FROM (
  SELECT sha256(concat('{{"o_custkey":', o_custkey, ',"o_orderkey":', o_orderkey, ',"o_orderpriority":"', o_orderpriority, '","o_orderstatus":"', o_orderstatus, '"}}')) AS f FROM orders))""")
def prv3b(t):
    return provenance.table_fingerprint(t.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


# every document is an artifact; its manifests are those of its source and of one of seven styles
_KINDS = {"build": "concat('build/', source)", "source": "concat('source/', source)", "style": "concat('style/', CAST(doc_id % 7 AS varchar))"}
_MANIFESTS = " UNION ALL ".join(f"SELECT DISTINCT {e} AS path, sha256({e}) AS sha256 FROM documents" for e in _KINDS.values())
_SIDECARS = f"""SELECT concat('docs/', CAST(doc_id AS varchar), '.txt') AS artifact, sha256(text) AS artifact_sha256,
  {", ".join(f"{e} AS {k}_path" for k, e in _KINDS.items())}, {", ".join(f"CASE WHEN {e} <> 'style/3' THEN sha256({e}) END AS {k}_sha256" for k, e in _KINDS.items())} FROM documents"""


def _artifacts(t):
    t.table("documents").createOrReplaceTempView("documents")
    manifests = t.spark.sql(_MANIFESTS.replace("varchar", "string").replace("sha256(", "sha2(").replace(") AS sha256", ", 256) AS sha256"))
    arts = t.spark.sql(f"SELECT concat('docs/', CAST(doc_id AS string), '.txt') AS path, sha2(text, 256) AS sha256, "
                       + ", ".join(f"{e.replace('varchar', 'string')} AS {k}_path" for k, e in _KINDS.items()) + " FROM documents")
    return manifests, provenance.sidecars(arts, manifests.filter("path <> 'style/3'"))


@query("prv4_artifact_sidecars", _SIDECARS)
def prv4(t):
    return _artifacts(t)[1]


@query("jn13_lineage_verification", f"""WITH r AS (SELECT *, artifact LIKE 'docs/1%' AS changed, artifact LIKE 'docs/9%' AS gone,
    source_path = 'source/src4' AS lost, build_path = 'build/src2' AS edited, style_sha256 IS NULL AS bare FROM ({_SIDECARS})),
  e AS (SELECT artifact, build_path, array_to_string(list_filter([
    CASE WHEN gone THEN 'missing-artifact' WHEN changed THEN 'artifact-sha256-mismatch' END,
    CASE WHEN edited THEN 'build-manifest-sha256-mismatch' END,
    CASE WHEN lost THEN 'missing-source-manifest' END,
    CASE WHEN bare THEN 'missing-style-manifest-reference' END,
    CASE WHEN source_path = 'source/src6' THEN 'build-source-manifest-link-mismatch' END,
    CASE WHEN source_path = 'source/src5' THEN 'build-source-manifest-id-mismatch' END,
    CASE WHEN NOT edited AND style_path = 'style/5' THEN 'build-style-theme-hash-mismatch' END], lambda x: x IS NOT NULL), ',') AS errors,
    array_to_string(list_filter([CASE WHEN build_path <> 'build/src1' THEN 'canonical-repository-not-configured-before-publication' END,
      'canonical-release-manifest-anchor-not-configured'], lambda x: x IS NOT NULL), ',') AS warnings FROM r)
  SELECT artifact, errors, warnings, errors = '' AS ok FROM e""")
def jn13(t):
    manifests, records = _artifacts(t)
    path = F.col("path")
    kept = manifests.filter("path <> 'source/src4'").withColumn("sha256", F.when(path == "build/src2", "0").otherwise(F.col("sha256")))
    docs = _manifest(t).filter("path NOT LIKE 'docs/9%'").select(
        "path", F.when(path.like("docs/1%"), "0").otherwise(F.col("sha256")).alias("sha256"))
    named = F.sha2(F.concat(F.lit("source/"), F.substring_index("path", "/", -1)), 256)
    contents = manifests.select(
        "path", F.when(path == "source/src5", "other").otherwise("id").alias("manifest_id"), F.lit("id").alias("source_manifest_id"),
        F.when(path != "build/src6", named).alias("source_manifest_sha256"), F.when(path == "style/5", "q").otherwise("p").alias("palette_sha256"),
        F.when(path == "build/src1", "somewhere").alias("canonical_repository"), F.lit("").alias("release_sha256"))
    return provenance.verify_lineage(records, docs.unionByName(kept), contents).select(
        "artifact", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "ok")


@query("prv5_build_manifest", "SELECT 'b1' AS build_id, count(*) AS observations, count(*) FILTER (WHERE actor_type = 'PLAN') AS plan FROM observations", views=("observations",))
def prv5(t):
    obs = t.view("observations")
    counts = obs.agg(F.count("*").alias("value")).select(F.lit("observations").alias("metric"), F.lit("").alias("key"), "value").unionByName(
        obs.groupBy(F.col("actor_type").alias("key")).agg(F.count("*").alias("value")).withColumn("metric", F.lit("actors")))
    m = provenance.build_manifest(counts, "b1", {"area": "box-a"}, "0" * 64)
    return m.select("build_id", F.col("evidence")["observations"].alias("observations"), F.col("evidence")["actors/PLAN"].alias("plan"))


# --- audits -----------------------------------------------------------------------------------

_LINES = r"""lines AS (SELECT doc_id AS id, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS txt FROM (
  SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS p FROM audit_texts))"""


RULES = (*audit.AUDIT_RULES, audit.private_path_rule("owner-archive", "vault data"))


def _sq(pattern: str) -> str:
    return pattern.replace("'", "''")


AUDIT_SQL = f"WITH {_LINES} " + " UNION ALL ".join(
    f"SELECT id, line, '{name}' AS \"check\", '{severity}' AS severity, "
    f"regexp_replace(txt, '{_sq(p)}', '[REDACTED-MATCH]', 'g') AS excerpt FROM lines WHERE regexp_matches(txt, '{_sq(p)}')"
    for name, p, severity in RULES
)


@query("aud1_text_audit", AUDIT_SQL, views=("audit_texts",))
def aud1(t):
    return audit.audit_texts(t.view("audit_texts"), "doc_id", "text", RULES)


_WORDS = ("password", "secret", "license", "copyright", "api_key")


@query("aud2_forbidden_words", " UNION ALL ".join(f"SELECT '{w}' AS word, count(*) FILTER (WHERE contains(lower(text), '{w}')) AS texts FROM documents" for w in _WORDS))
def aud2(t):
    return audit.forbidden_words(t.table("documents"), "text", _WORDS)


@query("agg10_audit_summary", f"""WITH f AS ({AUDIT_SQL}) SELECT d.source AS scope, count(*) AS findings, count(*) FILTER (WHERE severity = 'BLOCKER') AS blockers,
  count(*) FILTER (WHERE severity = 'REVIEW') AS review_items, count(*) FILTER (WHERE severity = 'BLOCKER') = 0 AS passed FROM f JOIN documents d ON d.doc_id = f.id GROUP BY 1""", views=("audit_texts",))
def agg10(t):
    docs = t.view("audit_texts")
    findings = audit.audit_texts(docs, "doc_id", "text", RULES)
    return audit.audit_summary(findings.join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("scope")), "id"))
