"""End-to-end builds: sources → filter → quality control → segments → layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import metrics
from tidewake.operators.catalog import availability_ledger, license_rows, orientation_labels
from tidewake.operators.filters import filter_events, filter_observations
from tidewake.operators.identity import registry_subset
from tidewake.operators.normalize import inspect_user_input, normalize_user_input
from tidewake.operators.provenance import build_manifest, table_fingerprint
from tidewake.operators.qc import QualityResult, quality_control
from tidewake.schema import QualityConfig
from tidewake.sources import sinks


@dataclass(frozen=True)
class BuildRequest:
    build_id: str
    bbox: tuple[float, float, float, float]
    convention: str = "180"
    start_date: str | None = None
    end_date: str | None = None
    actors: Sequence[str] = ()
    default_actors: Sequence[str] = ()
    product_mode: bool = False
    quality: QualityConfig = field(default_factory=QualityConfig)


@dataclass
class BuildResult:
    quality: QualityResult
    events: DataFrame | None
    vessels: DataFrame | None
    metrics: DataFrame
    manifest: DataFrame


def research_build(
    request: BuildRequest, observations: Sequence[DataFrame], events: Sequence[DataFrame] = (),
    registry: DataFrame | None = None, source_manifest_sha256: str = "",
) -> BuildResult:
    """Area and period filter first, then quality control over the union of all sources.

    Sources follow one another in the order given: their ``source_order`` is shifted here, so
    that tables which all start at 0 do not collide.
    """
    rows = filter_observations(
        metrics.union_sources(*number_sources(*observations)), request.bbox, request.convention, request.start_date,
        request.end_date, request.actors, request.default_actors, request.product_mode)
    result = quality_control(rows, request.quality)
    kept = filter_events(metrics.union_sources(*events), request.bbox, request.convention) if events else None
    counts = metrics.build_metrics(
        result.cleaned_points, result.excluded_points, result.quality_flags, result.track_segments, kept)
    manifest = build_manifest(
        counts, request.build_id,
        {"bbox": ",".join(str(v) for v in request.bbox), "convention": request.convention,
         "start": str(request.start_date), "end": str(request.end_date), "actors": ",".join(request.actors)},
        source_manifest_sha256)
    vessels = registry_subset(registry, result.cleaned_points) if registry is not None else None
    return BuildResult(result, kept, vessels, counts, manifest)


def import_user_rows(
    loaded: DataFrame, *, build_id: str, source_name: str, field_map=None, quality: QualityConfig = QualityConfig(),
) -> tuple[DataFrame, DataFrame]:
    """Canonical observations of a user's table and one summary row: what was detected
    (:func:`inspect_user_input`), a fingerprint of the table, and what quality control would keep,
    exclude and flag."""
    rows = normalize_user_input(loaded, build_id=build_id, source_name=source_name, field_map=field_map)
    result = quality_control(rows, quality)
    counts = metrics.import_summary(
        result.quality_flags, result.cleaned_points, result.excluded_points, result.gaps, result.track_segments)
    digest = table_fingerprint(loaded.drop("source_order")).select(F.col("fingerprint").alias("source_fingerprint"))
    # three tables of one row each
    one = inspect_user_input(loaded, field_map).withColumn("__one", F.lit(1))
    for part in (counts, digest):
        one = one.join(part.withColumn("__one", F.lit(1)), "__one")
    return rows, one.drop("__one")


def number_sources(*frames: DataFrame, stride: int = 1 << 44) -> list[DataFrame]:
    """Shift each source's order so that sources follow one another."""
    return [
        df.withColumn("source_order", F.col("source_order") + F.lit(i * stride)) for i, df in enumerate(frames)
    ]


# Reference layers a package always has, filled or empty, and the kind of each.
ZONE_LAYERS = ("eez_reference", "territorial_sea", "contiguous_zone")
BOUNDARY_LAYERS = ("maritime_boundary", "continental_shelf", "computed_median", "custom_boundary")


@dataclass(frozen=True)
class ReferenceData:
    """What a package shows beside the evidence; all of it may be absent.

    ``zones`` and ``boundaries``: tables by layer name; ``density``: cells of the traffic grid
    (``grid_row``, ``grid_col``, ``value``); ``expected``: the sources a package should have
    (``source_id``, ``kind``); ``enabled``: layers that were asked for; ``live``: whether sources could be reached.
    """

    zones: Mapping[str, DataFrame] = field(default_factory=dict)
    boundaries: Mapping[str, DataFrame] = field(default_factory=dict)
    density: DataFrame | None = None
    expected: DataFrame | None = None
    enabled: Sequence[str] = ()
    live: bool = True


def write_reference(spark: SparkSession, root: str, reference: ReferenceData) -> DataFrame:
    """Writes zones, boundaries and density under ``data/`` and the availability ledger and the warnings under
    ``metadata/``; returns (layer, features, shown), one row per layer.

    A layer without a source is a typed empty table. A layer that was asked for and is empty, a
    density grid that is absent and every source without data give a warning; none is replaced.
    """
    unknown = set(reference.zones) - set(ZONE_LAYERS) | set(reference.boundaries) - set(BOUNDARY_LAYERS)
    if unknown:
        raise ValueError(f"unknown reference layers: {sorted(unknown)}")
    counted, sources = [], []
    for names, tables, empty in ((ZONE_LAYERS, reference.zones, "maritime_zones"), (BOUNDARY_LAYERS, reference.boundaries, "maritime_boundaries")):
        for name in names:
            table = tables[name] if name in tables else sinks.empty_layer(spark, empty)
            layer = spark.read.schema(table.schema).parquet(sinks.write_layer(table, f"{root}/data/maritime", name))
            counted.append(layer.agg(F.lit(name).alias("layer"), F.count("*").alias("features")))
            sources.append(layer.select("source_id"))
    if reference.density is not None:
        cells = spark.read.parquet(sinks.write_layer(reference.density, f"{root}/data", "traffic_density"))
        counted.append(cells.agg(F.lit("traffic_density").alias("layer"), F.count("*").alias("features")))
        sources.append(cells.select(F.lit("traffic_density").alias("source_id")))
    else:
        counted.append(spark.createDataFrame([("traffic_density", 0)], "layer string, features long"))
    layers = reduce(DataFrame.unionByName, counted).withColumn("shown", F.col("features") > 0)

    asked = F.col("layer").isin(*reference.enabled) if reference.enabled else F.lit(False)
    warnings = layers.where(~F.col("shown") & (asked | (F.col("layer") == "traffic_density"))).select(
        F.when(F.col("layer") == "traffic_density", "traffic_density: no grid supplied, an empty group is kept").otherwise(
            F.concat("layer", F.lit(": selected without a source"))).alias("warning"))
    if reference.expected is not None:
        ledger = availability_ledger(reference.expected, reduce(DataFrame.unionAll, sources), reference.live)
        ledger.write.mode("overwrite").json(f"{root}/metadata/availability")
        warnings = warnings.unionAll(ledger.where("warning <> ''").select("warning"))
    warnings.write.mode("overwrite").json(f"{root}/metadata/warnings")
    return layers


def write_package(
    result: BuildResult, root: str, regions: DataFrame | None = None, sources: DataFrame | None = None,
    reference: ReferenceData | None = None,
) -> None:
    """Layers as Parquet, derived tables as CSV, licences, availability, warnings and manifest as JSON."""
    spark = result.metrics.sparkSession
    data, derived, meta = f"{root}/data", f"{root}/derived", f"{root}/metadata"
    write_reference(spark, root, reference or ReferenceData())
    sinks.write_layer(result.quality.cleaned_points, data, "observations")
    sinks.write_layer(result.quality.track_segments, data, "track_segments", ("segment_type",))
    sinks.write_layer(result.events if result.events is not None else sinks.empty_layer(spark, "events"), data, "events")
    labels = orientation_labels(regions) if regions is not None else sinks.empty_layer(spark, "orientation_labels")
    sinks.write_layer(labels, data, "orientation_labels")
    if result.vessels is not None:
        sinks.write_layer(result.vessels, data, "vessel_registry")
    sinks.write_derived(result.quality, derived)
    if sources is not None:
        sinks.write_pair(license_rows(sources), meta, "source_licences")
    result.manifest.write.mode("overwrite").json(f"{meta}/build")
