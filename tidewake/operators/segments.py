"""Gap-safe track segments: observed runs, short interpolations, inferred connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.plans.ordered import attach, bounded_slices, by_size, micros, seconds_between, slice_window
from tidewake.schema import DENSE_SOURCE_TYPES, SEGMENT_COLUMNS, QualityConfig, blank, conform
from tidewake.session import stage

_ORDER = ["event_time", "source_order"]


def dense_entities(cleaned: DataFrame) -> DataFrame:
    """One row per vessel: dense iff all its source types are positional feeds."""
    return cleaned.filter(~blank(F.col("entity_id"))).groupBy("entity_id").agg(
        F.bool_and(F.coalesce(F.col("source_type").isin(*DENSE_SOURCE_TYPES), F.lit(False))).alias("dense")
    )


def _provider_changed(prev: Column, cur: Column) -> Column:
    return (
        ~blank(prev["source_segment_id"]) & ~blank(cur["source_segment_id"])
        & (F.trim(prev["source_segment_id"]) != F.trim(cur["source_segment_id"]))
    )


#: Rows of a slice in one piece of a run.
PIECE_ROWS = 4096
#: Fixed value: identifiers or digests under one node of a run's hash tree.
TREE_WIDTH = 4096


def linked_points(cleaned: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Cleaned points in time order with their predecessor and run key.

    Added: ``prev`` (struct), ``gap_seconds``, ``run_break``, ``dense`` and the run key
    (``run_slice``, ``run_no``): the slice a run starts in and its number there; ``run_place`` is the
    point's place in its run, from 0, and ``alone`` tells runs of one point. A vessel of up to ``slice_rows``
    points is one slice. A run that continues over slices keeps the key of its first slice, and its places
    go on, both found on the per-slice summary.
    """
    rows = conform(cleaned).filter(~blank(F.col("entity_id"))).select(
        F.trim("entity_id").alias("entity_id"), "observation_id", "source_order",
        F.col("event_time").cast("timestamp").alias("event_time"), "longitude", "latitude",
        "actor_type", "source_type", "source_name", "source_segment_id",
    )
    point = F.struct(
        "event_time", "source_order", "observation_id", "actor_type", "source_name",
        "source_segment_id", "longitude", "latitude",
    )

    def breaks(prev: Column, cur: Column) -> Column:
        gap = seconds_between(cur["event_time"], prev["event_time"])
        return (gap > config.observed_track_max_gap_seconds) | _provider_changed(prev, cur)

    def within(rows: DataFrame) -> DataFrame:
        spec = slice_window(["entity_id"], _ORDER)
        upto = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (
            rows.withColumn("prev", F.lag(point).over(spec))
            .withColumn("gap_seconds", seconds_between(F.col("event_time"), F.col("prev.event_time")))
            .withColumn("run_break", F.coalesce(breaks(F.col("prev"), point), F.lit(False)))
            .withColumn("nth_row", F.row_number().over(spec).cast("long") - 1)
            .withColumn("opens", (F.col("prev").isNull() | F.col("run_break")).cast("long"))
            .withColumns({
                "run_no": F.sum("opens").over(upto),
                "opened": F.max(F.when(F.col("opens") == 1, F.col("nth_row"))).over(upto),
                "opens_after": F.lead("opens").over(spec),
                "dense": F.min(F.coalesce(F.col("source_type").isin(*DENSE_SOURCE_TYPES), F.lit(False))).over(Window.partitionBy("entity_id")),
            })
            .withColumns({
                "slice": F.lit(0).cast("long"), "run_slice": F.lit(0).cast("long"), "piece": F.floor(F.col("nth_row") / PIECE_ROWS),
                "run_place": F.col("nth_row") - F.col("opened"),
                "alone": (F.col("opens") == 1) & (F.coalesce("opens_after", F.lit(1)) == 1),
            })
            .drop("nth_row", "opens", "opened", "opens_after")
        )

    def over_slices(rows: DataFrame) -> DataFrame:
        rows = bounded_slices(rows, "entity_id", "event_time", "source_order", config.slice_seconds, config.slice_rows)
        spec = slice_window(["entity_id", "slice"], _ORDER)
        local = rows.withColumn("prev_local", F.lag(point).over(spec)).withColumn(
            "break_local", F.coalesce(breaks(F.col("prev_local"), point), F.lit(False)).cast("long")
        ).withColumn("nth_row", F.row_number().over(spec).cast("long") - 1).withColumn("piece", F.floor(F.col("nth_row") / PIECE_ROWS))
        ordinal = F.struct(*_ORDER)
        summary = local.groupBy("entity_id", "slice").agg(
            F.min_by(point, ordinal).alias("head"),
            F.max_by(point, ordinal).alias("tail"),
            F.sum("break_local").alias("breaks"), F.count("*").alias("rows"),
            F.max(F.when(F.col("break_local") == 1, F.col("nth_row"))).alias("last_break"),
            F.bool_and(F.coalesce(F.col("source_type").isin(*DENSE_SOURCE_TYPES), F.lit(False))).alias("dense"),
        )
        by_entity = Window.partitionBy("entity_id").orderBy("slice")
        earlier = by_entity.rowsBetween(Window.unboundedPreceding, -1)
        summary = (
            summary.withColumn("carry", F.lag("tail").over(by_entity))
            .withColumn("fresh", F.coalesce(breaks(F.col("carry"), F.col("head")), F.lit(True)).cast("long"))
            .withColumn("starts", F.col("breaks") + F.col("fresh"))
            .withColumn("rows_before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
            .withColumn("open_run", F.last(
                F.when(F.col("starts") > 0, F.struct("slice", "starts", (
                    F.col("rows_before") + F.coalesce("last_break", F.lit(0))).alias("start"))), ignorenulls=True).over(earlier))
            .withColumn("dense", F.min("dense").over(Window.partitionBy("entity_id")))
            .withColumn("fresh_after", F.lead("fresh").over(by_entity))
            .select("entity_id", "slice", "carry", "fresh", "fresh_after", "open_run", "dense", "rows_before")
        )
        joined = attach(local.withColumns({
            "nth": F.sum("break_local").over(spec),
            "opened": F.last(F.when(F.col("break_local") == 1, F.col("nth_row")), ignorenulls=True).over(spec),
            "break_after": F.lead("break_local").over(spec),
        }), summary, ["entity_id", "slice"])
        number = F.col("nth") + F.col("fresh")
        return (
            joined.withColumn("prev", F.coalesce("prev_local", "carry"))
            .withColumn("gap_seconds", seconds_between(F.col("event_time"), F.col("prev.event_time")))
            .withColumn("run_break", F.coalesce(breaks(F.col("prev"), point), F.lit(False)))
            .withColumn("run_slice", F.when(number > 0, F.col("slice")).otherwise(F.col("open_run.slice")))
            .withColumn("run_no", F.when(number > 0, number).otherwise(F.col("open_run.starts")))
            .withColumn("run_place", F.when(number > 0, F.col("nth_row") - F.coalesce("opened", F.lit(0))).otherwise(
                F.col("rows_before") + F.col("nth_row") - F.col("open_run.start")))
            .withColumn("alone", (F.col("run_place") == 0) & (F.coalesce("break_after", "fresh_after", F.lit(1)) == 1))
            .drop("prev_local", "break_local", "break_after", "nth", "nth_row", "opened", "carry", "fresh", "fresh_after", "open_run", "rows_before")
        )

    small, large = by_size(rows, "entity_id", config.slice_rows)
    return within(small) if large is None else within(small).unionByName(over_slices(large))


def observed_runs(linked: DataFrame) -> DataFrame:
    """OBSERVED_TRACK segments of dense vessels; runs of a single point are dropped.

    A segment is named by the hash of its observation ids, joined by ``|``. The ids of longer runs
    are hashed as a tree: every ``TREE_WIDTH`` ids in order give a digest, every ``TREE_WIDTH``
    digests another, and these the last one; a level with one member passes it on, so a run of up
    to ``TREE_WIDTH`` points keeps the plain hash. Nodes are aggregates by place: they come
    together in any order and on any task, and no row or task holds the ids of a long run.
    """
    same_run = F.col("prev").isNotNull() & ~F.col("run_break")
    provider = F.trim(F.coalesce("source_segment_id", F.lit("")))
    run = ["entity_id", "run_slice", "run_no"]

    def joined(place: str, value: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda s: s[value]), "|")

    def first(column: str) -> Column:
        return F.min_by(column, "place").alias(column)

    facts = [first("first_id"), F.max_by("last_id", "place").alias("last_id"), first("actor_type"), F.min("start_us").alias("start_us"),
             F.max("end_us").alias("end_us"), F.sum("points").alias("points"), F.max("max_gap").alias("max_gap"),
             F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"),
             F.array_distinct(F.flatten(F.collect_list("providers"))).alias("providers"), F.min("place").alias("place")]
    # within a slice, where the rows of a piece are together already; runs of one point would be dropped in the end
    parts = linked.filter("dense AND NOT alone").withColumn("leaf", F.floor(F.col("run_place") / TREE_WIDTH)).groupBy(
        "entity_id", "slice", "piece", "run_slice", "run_no", "leaf").agg(
        joined("run_place", "observation_id").alias("ids"),
        F.min_by("observation_id", "run_place").alias("first_id"), F.max_by("observation_id", "run_place").alias("last_id"),
        F.min_by("actor_type", "run_place").alias("actor_type"), F.min(micros(F.col("event_time"))).alias("start_us"),
        F.max(micros(F.col("event_time"))).alias("end_us"), F.count("*").alias("points"),
        F.max(F.when(same_run, F.col("gap_seconds"))).alias("max_gap"), F.collect_set("source_name").alias("names"),
        F.collect_set(F.when(provider != "", provider)).alias("providers"), F.min("run_place").alias("place"))
    node = parts.groupBy(*run, "leaf").agg(F.sha2(joined("place", "ids"), 256).alias("digest"), *facts)
    node = node.repartition(*run)
    for level, upper in (("leaf", "branch"), ("branch", "root")):
        only = (F.count("*") == 1) & (F.min(level) == 0)
        digest = F.when(only, F.min("digest")).otherwise(F.sha2(joined(level, "digest"), 256)).alias("digest")
        group = F.floor(F.col(level) / TREE_WIDTH) if upper == "branch" else F.lit(0).cast("long")
        node = node.withColumn(upper, group).groupBy(*run, upper).agg(digest, *facts)
    return node.filter("points >= 2").select(
        F.concat(F.lit("seg-"), F.substring("digest", 1, 16)).alias("segment_id"),
        "entity_id", F.col("first_id").alias("start_observation_id"), F.col("last_id").alias("end_observation_id"),
        F.col("entity_id").alias("start_entity_id"), F.col("entity_id").alias("end_entity_id"),
        "actor_type", F.timestamp_micros("start_us").alias("start_time"),
        F.timestamp_micros("end_us").alias("end_time"),
        F.lit("OBSERVED_TRACK").alias("segment_type"), F.col("points").alias("point_count"),
        F.coalesce("max_gap", F.lit(0.0)).alias("max_gap_seconds"),
        F.lit("HIGH").alias("confidence"), F.array_sort("names").alias("source_set"),
        F.array_sort("providers").alias("source_segment_ids"), "run_slice", "run_no",
    )


def links(linked: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Two-point segments: opt-in interpolations at run breaks of dense vessels, and
    inferred connections between consecutive points of all other vessels."""
    gap = F.col("gap_seconds")
    interpolated = (
        F.col("dense") & F.col("run_break") & (gap <= config.short_gap_interpolation_seconds)
        & F.lit(config.allow_short_gap_interpolation)
    )
    inferred = ~F.col("dense") & (gap > 0) & (gap <= config.inferred_connection_max_gap_seconds)
    ids = F.concat_ws("|", F.col("prev.observation_id"), F.col("observation_id"))
    providers = F.array(
        F.trim(F.coalesce("prev.source_segment_id", F.lit(""))),
        F.trim(F.coalesce("source_segment_id", F.lit(""))),
    )
    return linked.filter(F.col("prev").isNotNull() & (interpolated | inferred)).select(
        F.concat(F.lit("seg-"), F.substring(F.sha2(ids, 256), 1, 16)).alias("segment_id"),
        "entity_id", F.col("prev.observation_id").alias("start_observation_id"),
        F.col("observation_id").alias("end_observation_id"),
        F.col("entity_id").alias("start_entity_id"), F.col("entity_id").alias("end_entity_id"),
        F.col("prev.actor_type").alias("actor_type"), F.col("prev.event_time").alias("start_time"),
        F.col("event_time").alias("end_time"),
        F.when(F.col("dense"), "SHORT_INTERPOLATION").otherwise("INFERRED_CONNECTION").alias("segment_type"),
        F.lit(2).cast("long").alias("point_count"), gap.alias("max_gap_seconds"),
        F.when(F.col("dense"), "MEDIUM").otherwise("LOW").alias("confidence"),
        F.array_sort(F.array_distinct(F.array_compact(F.array("prev.source_name", "source_name")))).alias("source_set"),
        F.array_sort(F.array_distinct(F.filter(providers, lambda s: s != ""))).alias("source_segment_ids"),
    )


def segments_of(linked: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    return observed_runs(linked).select(*SEGMENT_COLUMNS).unionByName(
        links(linked, config).select(*SEGMENT_COLUMNS))


def track_segments(cleaned: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """All segments of cleaned points (observed runs, interpolations, inferred links)."""
    return segments_of(linked_points(cleaned, config), config)


def track_points(cleaned: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Vertices of the observed tracks, one row per point, keyed by ``segment_id``.

    The path is a table, not an array: a track's length is not bounded by a row's size. Sort
    by (segment_id, event_time, source_order) to draw it.
    """
    linked = stage(linked_points(cleaned, config))
    runs = observed_runs(linked).select("segment_id", "entity_id", "run_slice", "run_no")
    return (
        linked.join(runs, ["entity_id", "run_slice", "run_no"])
        .select("segment_id", "entity_id", "event_time", "source_order", "longitude", "latitude")
    )


def segment_violations(segments: DataFrame) -> DataFrame:
    """Segments without exactly one non-blank identity over entity and both ends."""
    parts = [F.trim(F.coalesce(c, F.lit(""))) for c in ("entity_id", "start_entity_id", "end_entity_id")]
    return segments.filter((parts[0] == "") | (parts[0] != parts[1]) | (parts[0] != parts[2]))


def validate_segments(segments: DataFrame) -> None:
    bad = segment_violations(segments).select("segment_id").take(1)
    if bad:
        raise ValueError(f"segment joins different or unidentified vessels: {bad[0][0]}")
