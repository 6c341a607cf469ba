"""Dimension tables: registries, regions, profiles, sources, adapters, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.schema import ACTOR_TYPES, blank, require_columns

# Evidence adapters (id, evidence types, mode, redistribution).
ADAPTERS = (
    ("global_fishing_watch", ("AIS", "SAR_DETECTION", "PORT_RECORD"), "IMPORT_OR_AUTHENTICATED_API", "PRODUCT_SPECIFIC"),
    ("japan_official", ("OFFICIAL_OBSERVATION",), "PUBLIC_NORMALIZED_IMPORT", "DERIVED_FACTS_ONLY"),
    ("taiwan_official", ("OFFICIAL_OBSERVATION", "PORT_RECORD"), "PUBLIC_NORMALIZED_IMPORT", "DERIVED_FACTS_ONLY"),
    ("viirs_boat_detection", ("VIIRS_BOAT_DETECTION",), "IMPORT", "PRODUCT_SPECIFIC"),
    ("byo", ("AIS", "SAR_DETECTION", "OPTICAL_DETECTION", "PORT_RECORD", "USER_SUPPLIED", "LICENSED_EXTERNAL"),
     "LOCAL_IMPORT", "EXCLUDED_BY_DEFAULT"),
)
# Base-layer detail by profile.
DETAIL = {"local": "high", "regional": "intermediate"}
DETAIL_OTHER = "global_110m"


def adapter_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(a, list(t), m, r) for a, t, m, r in ADAPTERS],
        "adapter_id string, evidence_types array<string>, mode string, redistribution string",
    )


def adapter_coverage(observations: DataFrame) -> DataFrame:
    """Rows each adapter can carry, by evidence type; counted before the small join."""
    counts = observations.groupBy("source_type").agg(F.count("*").alias("observations"))
    catalog = adapter_catalog(observations.sparkSession).select(
        "adapter_id", "mode", "redistribution", F.explode("evidence_types").alias("source_type"))
    return catalog.join(counts, "source_type", "left").withColumn(
        "observations", F.coalesce("observations", F.lit(0)))


def region_boxes(regions: DataFrame) -> DataFrame:
    """Region rows with ``bbox_180`` or ``bbox_360`` arrays → box columns and convention."""
    is_360 = F.col("bbox_360").isNotNull()
    box = F.coalesce("bbox_360", "bbox_180")
    names = ("xmin", "ymin", "xmax", "ymax")
    return regions.filter(F.size(box) == 4).select(
        *[c for c in regions.columns if c not in ("bbox_180", "bbox_360")],
        *[box[i].cast("double").alias(n) for i, n in enumerate(names)],
        F.when(is_360, "360").otherwise("180").alias("convention"),
    )


def validate_registry(registry: DataFrame) -> DataFrame:
    """Violations (row_key, rule, message) of the vessel registry's record rules."""
    require_columns(registry, ["entity_id", "canonical_name", "actor_type"], "vessel registry")
    rules: list[tuple[str, Column, str]] = [
        ("entity_id", blank(F.col("entity_id")), "entity_id must not be empty"),
        ("canonical_name", blank(F.col("canonical_name")), "canonical_name must not be empty"),
        ("actor_type", ~F.coalesce(F.col("actor_type").isin(*ACTOR_TYPES), F.lit(False)), "actor_type not in the vocabulary"),
    ]
    if "source_refs" in registry.columns:
        rules.append(("source_refs", F.coalesce(F.size("source_refs") < 1, F.lit(True)), "at least one source"))
    for name in ("length_m", "displacement_t"):
        if name in registry.columns:
            rules.append((name, F.col(name) < 0, f"{name} must not be negative"))
    return violations(registry, "entity_id", rules)


def violations(df: DataFrame, key: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """Generic record checks: one output row per broken rule."""
    found = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message")))
        for rule, cond, message in rules
    ]))
    return df.select(F.col(key).alias("row_key"), F.explode(found).alias("v")).select("row_key", "v.*")


def select_sources(preferences: DataFrame, sources: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(region, layer) → source: explicit override, else the first listed preference.

    ``preferences`` has (region, layer, source_ids array); a chosen source that is not
    registered comes out with ``registered`` false.
    """
    first = preferences.select("region", "layer", F.get("source_ids", F.lit(0)).alias("source_id"))
    if overrides is not None:
        o = overrides.select("region", "layer", F.col("source_id").alias("__o"))
        first = first.join(o, ["region", "layer"], "left").withColumn(
            "source_id", F.coalesce("__o", "source_id")).drop("__o")
    known = sources.select("source_id").distinct().withColumn("registered", F.lit(True))
    return first.filter(F.col("source_id").isNotNull()).join(known, "source_id", "left").withColumn(
        "registered", F.coalesce("registered", F.lit(False)))


def detail_level(profile: Column) -> Column:
    out = F.lit(DETAIL_OTHER)
    for name, detail in DETAIL.items():
        out = F.when(profile == name, detail).otherwise(out)
    return out


def _first(df: DataFrame, *names: str, default: str | None = None) -> Column:
    """First non-blank of the columns that exist."""
    options = [F.when(~blank(F.col(n)), F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*options, F.lit(default).cast("string"))


def manifest_records(sources: DataFrame) -> DataFrame:
    """Source manifest rows from registry metadata with its fallback chains."""
    require_columns(sources, ["source_id", "title", "provider", "licence"], "source registry")

    def flag(name: str, default: bool) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in sources.columns else F.lit(default)

    def listed(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast("array<string>")) if name in sources.columns else F.array().cast("array<string>")

    return sources.select(
        "source_id", "provider", F.col("title").alias("dataset"),
        _first(sources, "version", "released").alias("version_or_date"),
        _first(sources, "homepage", "repository", "download").alias("url"), "licence",
        _first(sources, "allowed_use", default="NOT_SPECIFIED").alias("allowed_use"),
        flag("attribution_required", True).alias("attribution_required"),
        _first(sources, "redistribution_allowed", "redistribution", default="UNKNOWN").alias("redistribution_allowed"),
        flag("commercial_use_known", False).alias("commercial_use_known"),
        _first(sources, "spatial_resolution", "resolution").alias("spatial_resolution"),
        _first(sources, "availability", default="AVAILABLE").alias("availability"),
        F.sort_array(listed("layers")).alias("layers"), listed("transformations").alias("transformations"),
    )


def license_rows(records: DataFrame) -> DataFrame:
    def flag(name: str, default: bool) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in records.columns else F.lit(default)

    known = flag("commercial_use_known", False)
    return records.select(
        "source_id", "provider", "dataset",
        _first(records, "license", "licence").alias("license"),
        _first(records, "allowed_use", default="NOT_SPECIFIED").alias("allowed_use"),
        flag("attribution_required", True).alias("attribution_required"),
        _first(records, "redistribution_allowed", default="UNKNOWN").alias("redistribution_allowed"),
        known.alias("commercial_use_known"),
        _first(records, "availability", default="AVAILABLE").alias("availability"),
        F.when(known, "").otherwise("COMMERCIAL_USE_REQUIRES_REVIEW").alias("warning"),
    )


def availability_ledger(expected: DataFrame, actual: DataFrame, live: bool = True) -> DataFrame:
    """Every expected source with a status; absent ones are reported, never replaced.

    ``expected``: (source_id, kind); ``actual``: rows carrying source_id, any number each.
    """
    counts = actual.groupBy("source_id").agg(F.count("*").alias("records"))
    absent = (
        F.when(F.col("kind") == "large", "NOT_CACHED_LARGE_SOURCE")
        .when(F.col("kind") == "local", "LOCAL_ONLY")
        .when(~F.lit(live), "UNAVAILABLE_OFFLINE_MODE")
        .otherwise("UNAVAILABLE")
    )
    return expected.join(counts, "source_id", "left").select(
        "source_id", "kind", F.coalesce("records", F.lit(0)).alias("records"),
        F.when(F.col("kind") == "local", "LOCAL_ONLY")
        .when(F.col("records") > 0, "AVAILABLE").otherwise(absent).alias("availability"),
    ).withColumn("warning", F.when(
        F.col("records") == 0, F.concat("source_id", F.lit(": no data, "), "availability")).otherwise(""))


def orientation_labels(regions: DataFrame) -> DataFrame:
    """Label points of each region; ``labels`` is an array of structs
    (name, longitude, latitude, role, paper, media), flags default to shown."""
    return regions.select("region", F.posexplode("labels").alias("pos", "l")).select(
        F.concat("region", F.lit("-orientation-"), (F.col("pos") + 1).cast("string")).alias("label_id"),
        F.col("l.name").alias("name"), F.coalesce("l.role", F.lit("place")).alias("label_role"),
        F.coalesce("l.paper", F.lit(True)).cast("int").alias("paper_visible"),
        F.coalesce("l.media", F.lit(True)).cast("int").alias("media_visible"),
        F.col("l.longitude").cast("double").alias("longitude"),
        F.col("l.latitude").cast("double").alias("latitude"),
    )
