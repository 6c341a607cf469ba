"""Checked queries: quality control, segments, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from tidewake.operators import metrics, qc, segments
from tidewake.plans.ordered import micros
from tidewake.schema import QualityConfig
from tidewake.session import stage

# Both engines use the sphere here; the ellipsoid is covered by unit tests.
CONFIG = QualityConfig(distance="haversine")
LINKED = QualityConfig(distance="haversine", allow_short_gap_interpolation=True)

STATES = "('OBSERVED','INTERPOLATED_SHORT_GAP','INFERRED_ROUTE','UNKNOWN')"
ACTORS = "('PLAN','CCG','RESEARCH_SURVEY','FISHING','MARITIME_MILITIA','MSA','OTHER_GOVERNMENT','UNKNOWN')"
BAD_POSITION = "NOT coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false)"
BAD_MMSI = "(mmsi IS NOT NULL AND NOT regexp_full_match(mmsi, '[0-9]{9}'))"
BAD_STATE = f"observed_or_inferred NOT IN {STATES}"

# CTEs that follow the view ``observations``.
SCREENED = f"""
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id, event_time, latitude, longitude, source_record_id
                               ORDER BY source_order) > 1 AS dup
  FROM observations),
screened AS (
  SELECT *, epoch_us(event_time) AS t,
         {BAD_POSITION} OR event_time IS NULL OR entity_id IS NULL OR {BAD_MMSI} OR {BAD_STATE} OR dup AS barred
  FROM numbered)"""

HAVERSINE = """2 * 6371008.8 * asin(sqrt(least(1.0,
  pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)
  + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"""

_METRES = HAVERSINE.format(lon1="f.a_lon", lat1="f.a_lat", lon2="o.longitude", lat2="o.latitude")
FOLD = SCREENED + f""",
sequenced AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_time, source_order) AS rn
  FROM screened WHERE entity_id IS NOT NULL AND event_time IS NOT NULL),
fold AS (
  SELECT entity_id, rn, observation_id, source_order, t,
         CASE WHEN NOT barred THEN t END AS a_t, CASE WHEN NOT barred THEN latitude END AS a_lat,
         CASE WHEN NOT barred THEN longitude END AS a_lon,
         CAST(NULL AS bigint) AS p_t, CAST(NULL AS double) AS gap, CAST(NULL AS double) AS metres, false AS fast
  FROM sequenced WHERE rn = 1
  UNION ALL
  SELECT entity_id, rn, observation_id, source_order, t,
         CASE WHEN barred THEN NULL WHEN fast THEN a_t ELSE t END,
         CASE WHEN barred THEN NULL WHEN fast THEN a_lat ELSE latitude END,
         CASE WHEN barred THEN NULL WHEN fast THEN a_lon ELSE longitude END,
         CASE WHEN gap IS NOT NULL THEN a_t END, gap, metres, fast
  FROM (
    SELECT *, coalesce(metres / gap * 1.9438444924406 > 80.0, false) AS fast
    FROM (
      SELECT o.entity_id, o.rn, o.observation_id, o.source_order, o.t, o.barred, o.latitude, o.longitude,
             f.a_t, f.a_lat, f.a_lon,
             CASE WHEN NOT o.barred AND f.a_t IS NOT NULL AND o.t > f.a_t THEN (o.t - f.a_t) / 1e6 END AS gap,
             CASE WHEN NOT o.barred AND f.a_t IS NOT NULL AND o.t > f.a_t THEN {_METRES} END AS metres
      FROM fold f JOIN sequenced o ON o.entity_id = f.entity_id AND o.rn = f.rn + 1)))"""
CLEANED = FOLD + """,
cleaned AS (
  SELECT s.* FROM screened s LEFT JOIN (SELECT source_order FROM fold WHERE fast) x USING (source_order)
  WHERE NOT s.barred AND x.source_order IS NULL)"""
DISORDER = """
seen AS (
  SELECT *, last_value(event_time IGNORE NULLS) OVER (
    PARTITION BY entity_id ORDER BY source_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM observations)"""
ALL_FLAGS = CLEANED + "," + DISORDER + f""",
flags AS (
  SELECT entity_id, source_order, 'INVALID_COORDINATE' AS flag, true AS excluded FROM observations WHERE {BAD_POSITION}
  UNION ALL SELECT entity_id, source_order, 'MISSING_TIME', true FROM observations WHERE event_time IS NULL
  UNION ALL SELECT entity_id, source_order, 'MISSING_VESSEL_IDENTITY', true FROM observations WHERE entity_id IS NULL
  UNION ALL SELECT entity_id, source_order, 'MALFORMED_MMSI', true FROM observations WHERE {BAD_MMSI}
  UNION ALL SELECT entity_id, source_order, 'UNKNOWN_ACTOR_TYPE', false FROM observations WHERE actor_type NOT IN {ACTORS}
  UNION ALL SELECT entity_id, source_order, 'UNKNOWN_OBSERVATION_STATE', true FROM observations WHERE {BAD_STATE}
  UNION ALL SELECT entity_id, source_order, 'DUPLICATE_OBSERVATION', true FROM numbered WHERE dup
  UNION ALL SELECT entity_id, source_order, 'TIMESTAMP_DISORDER', false FROM seen WHERE event_time < before
  UNION ALL SELECT entity_id, source_order, 'REPEATED_IDENTICAL_POINT', false FROM fold WHERE metres < 1.0
  UNION ALL SELECT entity_id, source_order, 'IMPOSSIBLE_SPEED', true FROM fold WHERE fast
  UNION ALL SELECT entity_id, source_order, 'LARGE_OBSERVATION_GAP', false FROM fold WHERE NOT fast AND gap > 21600)"""
# Segments over ``cleaned``.
LINKED_SQL = CLEANED + """,
tagged AS (
  SELECT *, min(CASE WHEN source_type IN ('AIS','PUBLIC_TRACK','USER_SUPPLIED') THEN 1 ELSE 0 END)
              OVER (PARTITION BY entity_id) = 1 AS dense,
         lag(t) OVER w AS p_t, lag(observation_id) OVER w AS p_id, lag(source_segment_id) OVER w AS p_seg,
         lag(source_name) OVER w AS p_name, lag(actor_type) OVER w AS p_actor
  FROM cleaned WINDOW w AS (PARTITION BY entity_id ORDER BY event_time, source_order)),
broken AS (
  SELECT *, (t - p_t) / 1e6 AS gap,
         coalesce((t - p_t) / 1e6 > 3600 OR (p_seg IS NOT NULL AND source_segment_id IS NOT NULL
                  AND p_seg <> source_segment_id), true) AS brk
  FROM tagged),
runs AS (
  SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (
    PARTITION BY entity_id ORDER BY event_time, source_order) AS run
  FROM broken WHERE dense),
observed AS (
  SELECT concat('seg-', substr(sha256(string_agg(observation_id, '|' ORDER BY event_time, source_order)), 1, 16)) AS segment_id,
         entity_id, run, arg_min(observation_id, (event_time, source_order)) AS start_observation_id,
         arg_max(observation_id, (event_time, source_order)) AS end_observation_id,
         arg_min(actor_type, (event_time, source_order)) AS actor_type,
         min(t) AS start_us, max(t) AS end_us, count(*) AS point_count,
         coalesce(max(CASE WHEN NOT brk THEN gap END), 0.0) AS max_gap_seconds,
         array_to_string(list_sort(list_distinct(list(source_name))), ',') AS source_set,
         coalesce(array_to_string(list_sort(list_distinct(list(source_segment_id))), ','), '') AS source_segment_ids
  FROM runs GROUP BY entity_id, run HAVING count(*) >= 2)"""


def pairs_of(t: Inputs, config=CONFIG):
    return qc.screened_pairs(stage(qc.screen(t.view("observations"))), config)


def flagged(df, flag):
    return df.filter(F.col("flag") == flag).select("observation_id", "source_order", "severity", "excluded")


def flag_oracle(flag: str, where: str, severity: str = "ERROR", source: str = "observations") -> str:
    return (
        f"SELECT observation_id, source_order, '{severity}' AS severity, "
        f"{'true' if severity == 'ERROR' else 'false'} AS excluded FROM {source} WHERE {where}"
    )


def _row_query(name, flag, where, severity="ERROR"):
    @query(name, flag_oracle(flag, where, severity), views=("observations",))
    def run(t: Inputs):
        return flagged(qc.row_flags(t.view("observations")), flag)


_row_query("qc1_invalid_coordinate", "INVALID_COORDINATE", BAD_POSITION)
_row_query("qc2_missing_time", "MISSING_TIME", "event_time IS NULL")
_row_query("qc3_missing_vessel_identity", "MISSING_VESSEL_IDENTITY", "entity_id IS NULL")
_row_query("qc4_malformed_mmsi", "MALFORMED_MMSI", BAD_MMSI)
_row_query("qc5_unknown_actor_type", "UNKNOWN_ACTOR_TYPE", f"actor_type NOT IN {ACTORS}", "WARNING")
_row_query("qc6_unknown_observation_state", "UNKNOWN_OBSERVATION_STATE", BAD_STATE)


@query("qc7_duplicate_observation", f"WITH {SCREENED.strip()} " + flag_oracle("", "dup", source="numbered"), views=("observations",))
def qc7(t):
    return flagged(qc.duplicate_flags(t.view("observations")), "DUPLICATE_OBSERVATION")


@query("qc8_timestamp_disorder", f"WITH {DISORDER.strip()} " + flag_oracle("", "event_time < before", "WARNING", "seen"), views=("observations",))
def qc8(t):
    return flagged(qc.disorder_flags(t.view("observations"), CONFIG), "TIMESTAMP_DISORDER")


@query("qc9_repeated_identical_point", f"WITH {FOLD.strip()} " + flag_oracle("", "metres < 1.0", "WARNING", "fold"), views=("observations",), recursive=True)
def qc9(t):
    return flagged(qc.sequence_flags(pairs_of(t), CONFIG), "REPEATED_IDENTICAL_POINT")


@query("qc10_impossible_speed", f"WITH {FOLD.strip()} SELECT observation_id, source_order, round(metres / gap * 1.9438444924406, 4) AS knots, p_t FROM fold WHERE fast", views=("observations",), recursive=True)
def qc10(t):
    pairs = pairs_of(t)
    return pairs.filter(F.col("knots") > CONFIG.max_speed_knots).select(
        "observation_id", "source_order", F.round("knots", 4).alias("knots"), micros(F.col("prev_time")).alias("p_t"))


@query("qc11_large_observation_gap", f"WITH {FOLD.strip()} SELECT entity_id, p_t AS start_us, t AS end_us, gap AS gap_seconds FROM fold WHERE NOT fast AND gap > 21600", views=("observations",), recursive=True)
def qc11(t):
    g = qc.gaps(pairs_of(t), CONFIG)
    return g.select("entity_id", micros(F.col("start_time")).alias("start_us"), micros(F.col("end_time")).alias("end_us"), "gap_seconds")


@query("qc12_cleaned_points", f"WITH {CLEANED.strip()} SELECT observation_id, source_order, entity_id, epoch_us(event_time) AS t FROM cleaned", views=("observations",), recursive=True)
def qc12(t):
    return cleaned_of(t).select("observation_id", "source_order", "entity_id", micros(F.col("event_time")).alias("t"))


@query("qc12_excluded_points", f"WITH {CLEANED.strip()} SELECT observation_id, source_order FROM screened WHERE source_order NOT IN (SELECT source_order FROM cleaned)", views=("observations",), recursive=True)
def qc12b(t):
    return qc.split(t.view("observations"), flags_of(t))[1].select("observation_id", "source_order")


@query("qc13_quality_flags", f"WITH {ALL_FLAGS.strip()} SELECT source_order, flag, excluded FROM flags", views=("observations",), recursive=True)
def qc13(t):
    return qc.all_flags(t.view("observations"), CONFIG).select("source_order", "flag", "excluded")


def cleaned_of(t: Inputs, config=CONFIG):
    return qc.clean(t.view("observations"), config)


def flags_of(t: Inputs, config=CONFIG):
    screened = stage(qc.screen(t.view("observations")))
    return stage(qc.screened_flags(screened, qc.screened_pairs(screened, config), config))


@query("seg1_dense_entities", """SELECT entity_id, min(CASE WHEN source_type IN ('AIS','PUBLIC_TRACK','USER_SUPPLIED') THEN 1 ELSE 0 END) = 1 AS dense
 FROM observations WHERE entity_id IS NOT NULL GROUP BY entity_id""", views=("observations",))
def seg1(t):
    return segments.dense_entities(t.view("observations"))


@query("seg2_dense_runs", f"WITH {LINKED_SQL.strip()} SELECT entity_id, start_observation_id, end_observation_id, point_count FROM observed", views=("observations",), recursive=True)
def seg2(t):
    return segments.observed_runs(stage(segments.linked_points(cleaned_of(t), CONFIG))).select(
        "entity_id", "start_observation_id", "end_observation_id", "point_count")


@query("seg3_short_interpolation", f"""WITH {LINKED_SQL.strip()} SELECT entity_id, p_id AS start_observation_id, observation_id AS end_observation_id, gap AS max_gap_seconds,
 concat('seg-', substr(sha256(concat(p_id, '|', observation_id)), 1, 16)) AS segment_id
 FROM broken WHERE dense AND brk AND p_t IS NOT NULL AND gap <= 10800""", views=("observations",), recursive=True)
def seg3(t):
    return segments.links(stage(segments.linked_points(cleaned_of(t), LINKED)), LINKED).filter(
        "segment_type = 'SHORT_INTERPOLATION'").select(
        "entity_id", "start_observation_id", "end_observation_id", "max_gap_seconds", "segment_id")


@query("seg4_inferred_connection", f"""WITH {LINKED_SQL.strip()} SELECT entity_id, p_id AS start_observation_id, observation_id AS end_observation_id, gap AS max_gap_seconds,
 p_t AS start_us, t AS end_us, p_actor AS actor_type,
 array_to_string(list_sort(list_distinct([p_name, source_name])), ',') AS source_set
 FROM broken WHERE NOT dense AND gap > 0 AND gap <= 604800""", views=("observations",), recursive=True)
def seg4(t):
    return segments.links(stage(segments.linked_points(cleaned_of(t), CONFIG)), CONFIG).select(
        "entity_id", "start_observation_id", "end_observation_id", "max_gap_seconds",
        micros(F.col("start_time")).alias("start_us"), micros(F.col("end_time")).alias("end_us"), "actor_type",
        F.array_join("source_set", ",").alias("source_set"))


@query("seg5_segment_records", f"WITH {LINKED_SQL.strip()} SELECT * EXCLUDE (run) FROM observed", views=("observations",), recursive=True)
def seg5(t):
    runs = segments.observed_runs(stage(segments.linked_points(cleaned_of(t), CONFIG)))
    return runs.select(
        "segment_id", "entity_id", "start_observation_id", "end_observation_id", "actor_type",
        micros(F.col("start_time")).alias("start_us"), micros(F.col("end_time")).alias("end_us"), "point_count",
        "max_gap_seconds", F.array_join("source_set", ",").alias("source_set"),
        F.array_join("source_segment_ids", ",").alias("source_segment_ids"))


@query("seg5_track_points", f"""WITH {LINKED_SQL.strip()} SELECT o.segment_id, r.source_order, r.longitude, r.latitude
 FROM runs r JOIN observed o USING (entity_id, run)""", views=("observations",), recursive=True)
def seg5b(t):
    return segments.track_points(cleaned_of(t), CONFIG).select("segment_id", "source_order", "longitude", "latitude")


@query("seg6_entity_integrity", """SELECT source_record_id AS segment_id FROM observations
 WHERE entity_id IS NULL OR latitude > 60""", views=("observations",))
def seg6(t):
    pairs = t.view("observations").select(
        F.col("source_record_id").alias("segment_id"), "entity_id", F.col("entity_id").alias("start_entity_id"),
        F.when(F.col("latitude") > 60, "other").otherwise(F.col("entity_id")).alias("end_entity_id"))
    return segments.segment_violations(pairs).select("segment_id")


@query("agg8_source_sets", f"WITH {LINKED_SQL.strip()} SELECT segment_id, source_set, source_segment_ids FROM observed", views=("observations",), recursive=True)
def agg8(t):
    runs = segments.observed_runs(stage(segments.linked_points(cleaned_of(t), CONFIG)))
    return runs.select("segment_id", F.array_join("source_set", ",").alias("source_set"),
                       F.array_join("source_segment_ids", ",").alias("source_segment_ids"))


@query("agg1_vessel_summary", f"""WITH {ALL_FLAGS.strip()} SELECT c.entity_id, arg_min(c.actor_type, c.source_order) AS actor_type, count(*) AS observation_count,
 min(c.t) AS first_us, max(c.t) AS last_us, coalesce(any_value(f.n), 0) AS flag_count
 FROM cleaned c LEFT JOIN (SELECT entity_id, count(*) AS n FROM flags GROUP BY entity_id) f USING (entity_id) GROUP BY c.entity_id""", views=("observations",), recursive=True)
def agg1(t):
    obs = t.view("observations")
    flags = flags_of(t)
    s = qc.vessel_summary(qc.split(obs, flags)[0], flags)
    return s.select("entity_id", "actor_type", "observation_count", micros(F.col("first_seen")).alias("first_us"),
                    micros(F.col("last_seen")).alias("last_us"), "flag_count")


_SEGMENTS = LINKED_SQL + """,
segs AS (SELECT 'OBSERVED_TRACK' AS segment_type, actor_type FROM observed
  UNION ALL SELECT 'INFERRED_CONNECTION', p_actor FROM broken WHERE NOT dense AND gap > 0 AND gap <= 604800)"""


@query("agg2_build_metrics", f"""WITH {ALL_FLAGS.strip()}, {_SEGMENTS[len(CLEANED):].strip().lstrip(',').strip()}
 SELECT 'cleaned_observations' AS metric, '' AS key, count(*) AS value FROM cleaned
 UNION ALL SELECT 'excluded_observations', '', (SELECT count(*) FROM observations) - (SELECT count(*) FROM cleaned)
 UNION ALL SELECT 'quality_flags', '', count(*) FROM flags
 UNION ALL SELECT 'track_segments', '', count(*) FROM segs
 UNION ALL SELECT 'segment_types', segment_type, count(*) FROM segs GROUP BY 2
 UNION ALL SELECT 'actor_observation_counts', actor_type, count(*) FROM cleaned GROUP BY 2
 UNION ALL SELECT 'actor_segment_counts', concat(actor_type, ':', segment_type), count(*) FROM segs GROUP BY 2""", views=("observations",), recursive=True)
def agg2(t):
    r = qc.quality_control(t.view("observations"), CONFIG)
    return metrics.build_metrics(
        r.cleaned_points.drop("observation_method"), r.excluded_points, r.quality_flags, r.track_segments)


@query("agg3_import_summary", f"""WITH {ALL_FLAGS.strip()}, {_SEGMENTS[len(CLEANED):].strip().lstrip(',').strip()}
 SELECT (SELECT count(*) FROM cleaned) AS cleaned_positions,
  (SELECT count(*) FROM observations) - (SELECT count(*) FROM cleaned) AS excluded_positions,
  (SELECT count(*) FROM flags WHERE flag = 'DUPLICATE_OBSERVATION') AS duplicate_positions,
  (SELECT count(*) FROM flags WHERE flag = 'INVALID_COORDINATE') AS invalid_coordinates,
  (SELECT count(*) FROM flags WHERE flag = 'MISSING_TIME') AS invalid_timestamps,
  (SELECT count(*) FROM flags WHERE flag = 'LARGE_OBSERVATION_GAP') AS large_gaps,
  (SELECT count(*) FROM segs) AS track_segments""", views=("observations",), recursive=True)
def agg3(t):
    r = qc.quality_control(t.view("observations"), CONFIG)
    return metrics.import_summary(r.quality_flags, r.cleaned_points, r.excluded_points, r.gaps, r.track_segments)


@query("agg4_inspect_input", """SELECT count(*) AS record_count, count(*) FILTER (WHERE NOT bad) AS valid_points,
 min(longitude) FILTER (WHERE NOT bad) AS xmin, min(latitude) FILTER (WHERE NOT bad) AS ymin,
 max(longitude) FILTER (WHERE NOT bad) AS xmax, max(latitude) FILTER (WHERE NOT bad) AS ymax,
 epoch_us(min(event_time)) AS first_us, epoch_us(max(event_time)) AS last_us
 FROM (SELECT *, """ + BAD_POSITION + """ AS bad FROM observations)""", views=("observations",))
def agg4(t):
    return metrics.inspect(t.view("observations")).withColumns({
        "first_us": micros(F.col("first_time")), "last_us": micros(F.col("last_time"))}).drop("first_time", "last_time")


@query("smp1_stride_sample", f"""WITH v AS (SELECT source_order, longitude, latitude,
   row_number() OVER (ORDER BY source_order) - 1 AS pos, count(*) OVER () AS n FROM observations WHERE NOT ({BAD_POSITION}))
 SELECT pos, source_order, longitude, latitude FROM v
 WHERE pos % greatest(1, CAST(floor(n / 400) AS bigint)) = 0 AND pos / greatest(1, CAST(floor(n / 400) AS bigint)) < 400""", views=("observations",))
def smp1(t):
    return metrics.sample_positions(t.view("observations"), slice_rows=4096)


@query("ord1_source_and_time_order", """SELECT source_order, row_number() OVER (PARTITION BY coalesce(entity_id, '') ORDER BY event_time NULLS LAST, source_order) AS position
 FROM observations""", views=("observations",))
def ord1(t):
    from tidewake.plans.ordered import running_sum, time_slice

    # rows without a time come last: in a slice of their own after all others
    late = F.col("event_time").isNull()
    rows = t.view("observations").select(
        F.coalesce("entity_id", F.lit("")).alias("entity_id"), "source_order", F.struct(late.alias("late"), "event_time", "source_order").alias("ord"),
        F.when(late, F.lit((1 << 62))).otherwise(time_slice(F.col("event_time"), 86400)).alias("slice"), F.lit(1).alias("one"))
    return running_sum(rows, ["entity_id"], "slice", "ord", "one", "position").select("source_order", "position")


_TWO = CLEANED.replace("FROM observations)", "FROM two_feeds)", 1)


@query("build_two_sources", f"""WITH two_feeds AS (SELECT * REPLACE (row_number() OVER (ORDER BY feed, source_order) AS source_order) FROM (
    SELECT *, CASE WHEN source_order >= 1000000000 THEN 1 ELSE 0 END AS feed FROM observations)), {_TWO.strip()}
  SELECT observation_id, true AS cleaned FROM cleaned UNION ALL SELECT observation_id, false FROM two_feeds WHERE observation_id NOT IN (SELECT observation_id FROM cleaned)""",
       views=("observations",), recursive=True)
def build_two(t):
    """Two feeds whose orders both start at 0 and overlap."""
    from tidewake.operators.qc import quality_control
    from tidewake.plans.build import number_sources

    rows = t.view("observations")
    first = rows.filter("source_order < 1000000000")
    second = rows.filter("source_order >= 1000000000").withColumn("source_order", F.col("source_order") - 1000000000)
    r = quality_control(metrics.union_sources(*number_sources(first, second)), CONFIG)
    return r.cleaned_points.select("observation_id", F.lit(True).alias("cleaned")).unionByName(
        r.excluded_points.select("observation_id", F.lit(False).alias("cleaned")))


@query("ord4_first_rows", "SELECT source_order, observation_id FROM observations ORDER BY source_order LIMIT 400", views=("observations",))
def ord4(t):
    return metrics.first_rows(t.view("observations").select("source_order", "observation_id"))


@query("set1_union_sources", """SELECT source_order, observation_id, vessel_name FROM (
   SELECT source_order, observation_id, CAST(NULL AS varchar) AS vessel_name FROM observations
   UNION ALL SELECT source_order, CAST(NULL AS varchar), vessel_name FROM sightings)""", views=("observations", "sightings"))
def set1(t):
    return metrics.union_sources(
        t.view("observations").select("source_order", "observation_id"),
        t.view("sightings").select("source_order", "vessel_name"))
