"""Counts and summaries of a build or an import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.plans.ordered import order_slice, row_index

# Fixed value: usual size of the map preview sample.
SAMPLE_SIZE = 400


def build_metrics(
    cleaned: DataFrame, excluded: DataFrame, flags: DataFrame, segments: DataFrame,
    events: DataFrame | None = None,
) -> DataFrame:
    """Long table (metric, key, value): totals and value counts of a build."""

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "value")

    def by(df: DataFrame, key, name: str) -> DataFrame:
        return df.groupBy(key.alias("key")).agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "key", "value")

    parts = [
        total(cleaned, "cleaned_observations"), total(excluded, "excluded_observations"),
        total(flags, "quality_flags"), total(segments, "track_segments"),
        by(segments, F.col("segment_type"), "segment_types"),
        by(cleaned, F.col("actor_type"), "actor_observation_counts"),
        by(segments, F.concat_ws(":", "actor_type", "segment_type"), "actor_segment_counts"),
    ]
    if "observation_method" in cleaned.columns:
        parts.append(by(cleaned, F.col("observation_method"), "evidence_methods"))
    if events is not None:
        parts += [total(events, "public_events"), by(events, F.col("event_type"), "public_event_types")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def import_summary(flags: DataFrame, cleaned: DataFrame, excluded: DataFrame, gaps: DataFrame, segments: DataFrame) -> DataFrame:
    """One row of import counts."""

    def n(df: DataFrame):
        return df.agg(F.count("*")).scalar()

    counts = flags.agg(
        F.count_if(F.col("flag") == "DUPLICATE_OBSERVATION").alias("duplicate_positions"),
        F.count_if(F.col("flag") == "INVALID_COORDINATE").alias("invalid_coordinates"),
        F.count_if(F.col("flag") == "MISSING_TIME").alias("invalid_timestamps"),
    )
    return counts.select(
        n(cleaned).alias("cleaned_positions"), n(excluded).alias("excluded_positions"), "*",
        n(gaps).alias("large_gaps"), n(segments).alias("track_segments"),
    )


def inspect(df: DataFrame, longitude: str = "longitude", latitude: str = "latitude", time: str = "event_time") -> DataFrame:
    """Row count, box of the valid points and time range in one aggregate."""
    lon, lat = F.col(longitude), F.col(latitude)
    valid = lon.between(-180, 180) & lat.between(-90, 90)
    return df.agg(
        F.count("*").alias("record_count"), F.count_if(valid).alias("valid_points"),
        F.min(F.when(valid, lon)).alias("xmin"), F.min(F.when(valid, lat)).alias("ymin"),
        F.max(F.when(valid, lon)).alias("xmax"), F.max(F.when(valid, lat)).alias("ymax"),
        F.min(time).alias("first_time"), F.max(time).alias("last_time"),
    )


def sample_positions(df: DataFrame, slice_rows: int = 1 << 20, size: int = SAMPLE_SIZE) -> DataFrame:
    """Every ⌊n/size⌋-th valid position in source order, at most ``size`` (a sampling operator)."""
    valid = df.filter(F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90))
    indexed = row_index(
        valid.select("source_order", "longitude", "latitude",
                     order_slice(F.col("source_order"), slice_rows).alias("slice")),
        "slice", "source_order", "pos", total="n",
    )
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / size))
    return indexed.filter(
        (F.col("pos") % stride == 0) & (F.col("pos") / stride < size)
    ).select("pos", "source_order", "longitude", "latitude")


def first_rows(df: DataFrame, order: str = "source_order", n: int = SAMPLE_SIZE) -> DataFrame:
    """The first n rows in source order (a top-k, not a sort of the table)."""
    return df.orderBy(order).limit(n)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union of observation or event tables by column name, absent columns NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
