"""Small JSON dimension files: registry, regions, profiles, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewake.operators.catalog import region_boxes, validate_registry
from tidewake.operators.identity import duplicate_ids
from tidewake.schema import require_columns

REGISTRY_SCHEMA = (
    "entity_id string, canonical_name string, name_cn string, name_en string, "
    "aliases array<string>, former_names array<string>, actor_type string, vessel_class string, "
    "hull_number string, IMO string, MMSI string, callsign string, source_refs array<string>"
)
REGION_SCHEMA = (
    "region string, bbox_180 array<double>, bbox_360 array<double>, profile string, title string, "
    "default_actors array<string>, "
    "labels array<struct<name:string,longitude:double,latitude:double,role:string,paper:boolean,media:boolean>>"
)
SOURCE_SCHEMA = (
    "source_id string, title string, provider string, licence string, version string, released string, "
    "homepage string, repository string, download string, allowed_use string, redistribution string, "
    "redistribution_allowed string, attribution_required boolean, commercial_use_known boolean, "
    "spatial_resolution string, resolution string"
)
PROFILE_SCHEMA = "profile string, label_rank_max int, coastline_detail string, contour_levels_m array<int>"


def read_registry(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """Vessel registry (JSON lines); refuses repeated ids and broken records."""
    df = spark.read.schema(REGISTRY_SCHEMA).json(path)
    if validate:
        repeated = duplicate_ids(df).take(1)
        if repeated:
            raise ValueError(f"duplicate entity_id in vessel registry: {repeated[0][0]}")
        broken = validate_registry(df.drop("source_refs")).take(1)
        if broken:
            raise ValueError(f"invalid vessel registry: {broken[0]['row_key']}: {broken[0]['message']}")
    return df


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return region_boxes(spark.read.schema(REGION_SCHEMA).json(path))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(SOURCE_SCHEMA).json(path)
    return require_columns(df, ["source_id", "title", "provider", "licence"], "source registry")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).json(path)
