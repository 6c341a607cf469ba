"""Map-layer routing: which records belong to which named layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.schema import DENSE_SOURCE_TYPES

# Actor groups with layers of their own.
ACTOR_LAYERS = ("PLAN", "CCG", "RESEARCH_SURVEY", "FISHING")
# Highest label rank shown per profile.
LABEL_RANK_MAX = {"local": 4, "regional": 1, "theatre": -1}


def _route(df: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    layers = F.array_compact(F.array(*[F.when(cond, name) for cond, name in rules]))
    return df.withColumn("layer", F.explode(layers))


def _own(name: str) -> Column:
    return F.concat("actor_type", F.lit(":" + name))


def route_observations(df: DataFrame) -> DataFrame:
    """One row per (observation, layer)."""
    actor = F.col("actor_type").isin(*ACTOR_LAYERS)
    confidence = F.coalesce("position_confidence", F.lit("UNKNOWN"))
    official = F.col("source_type") == "OFFICIAL_OBSERVATION"
    return _route(df, [
        (actor & official & (confidence != "LOW"), _own("official_observations")),
        (actor & (F.col("position_confidence") == "LOW"), _own("uncertain_detections")),
        (F.col("actor_type") == "MARITIME_MILITIA", F.lit("documented_militia")),
        (F.col("source_type").isin(*DENSE_SOURCE_TYPES), F.lit("position_points")),
        (official, F.lit("official_observations")),
    ])


def route_segments(df: DataFrame) -> DataFrame:
    """One row per (segment, layer)."""
    actor = F.col("actor_type").isin(*ACTOR_LAYERS)
    observed = F.col("segment_type") == "OBSERVED_TRACK"
    inferred = F.col("segment_type") == "INFERRED_CONNECTION"
    return _route(df, [
        (actor & observed, _own("observed_tracks")),
        (actor & inferred, _own("inferred_segments")),
        (observed, F.lit("observed_tracks")),
        (inferred, F.lit("inferred_segments")),
    ])


def route_events(df: DataFrame) -> DataFrame:
    return _route(df, [(F.col("source_type") == "PUBLIC_EVENT", F.lit("public_events"))])


def route_labels(df: DataFrame) -> DataFrame:
    return _route(df, [
        (F.col("paper_visible") == 1, F.lit("orientation_paper")),
        (F.col("media_visible") == 1, F.lit("orientation_media")),
    ])


def ranked_labels(labels: DataFrame, profile: Column) -> DataFrame:
    """Labels whose rank the profile still shows."""
    limit = F.create_map(*[F.lit(x) for pair in LABEL_RANK_MAX.items() for x in pair])
    return labels.filter(F.col("scalerank") <= F.try_element_at(limit, profile))


def legend(segments: DataFrame, observations: DataFrame) -> DataFrame:
    """Which actor layers have evidence: counts per (actor, layer) and a flag."""
    tracks = segments.groupBy("actor_type", F.col("segment_type").alias("layer")).agg(F.count("*").alias("features"))
    points = observations.groupBy("actor_type").agg(F.count("*").alias("features")).withColumn(
        "layer", F.lit("OFFICIAL_OBSERVATION"))
    spark = segments.sparkSession
    wanted = spark.createDataFrame(
        [(a, k) for a in ACTOR_LAYERS for k in ("OBSERVED_TRACK", "INFERRED_CONNECTION", "OFFICIAL_OBSERVATION")],
        "actor_type string, layer string",
    )
    return wanted.join(tracks.unionByName(points), ["actor_type", "layer"], "left").select(
        "actor_type", "layer", F.coalesce("features", F.lit(0)).alias("features"),
        F.col("features").isNotNull().alias("shown"),
    )


def legend_without_actor(segments: DataFrame, observations: DataFrame) -> DataFrame:
    """The entries of layers that belong to no actor: counts over all actors, those outside
    ``ACTOR_LAYERS`` and missing ones included. Observations count where their method is the layer's."""
    # Entry, its table's column and the value that counts.
    entries = (("Observed Tracks", "OBSERVED_TRACK"), ("Inferred Segments", "INFERRED_CONNECTION"), ("Official Observations", "OFFICIAL_OBSERVATION"))
    kinds = segments.groupBy(F.col("segment_type").alias("layer")).agg(F.count("*").alias("features"))
    methods = observations.groupBy(F.col("observation_method").alias("layer")).agg(F.count("*").alias("features")).where("layer = 'OFFICIAL_OBSERVATION'")
    wanted = segments.sparkSession.createDataFrame(list(entries), "entry string, layer string")
    return wanted.join(kinds.unionByName(methods), "layer", "left").select(
        "entry", "layer", F.coalesce("features", F.lit(0)).alias("features"), F.col("features").isNotNull().alias("shown"))


def visible_layers(layers: DataFrame, enabled: DataFrame) -> DataFrame:
    """Layer is shown iff it was requested and is not empty. ``layers`` has one row per
    feature with ``layer``; ``enabled`` lists requested layers."""
    counts = layers.groupBy("layer").agg(F.count("*").alias("features"))
    return enabled.join(counts, "layer", "left").select(
        "layer", F.coalesce("features", F.lit(0)).alias("features"),
        (F.coalesce("features", F.lit(0)) > 0).alias("shown"),
    )
