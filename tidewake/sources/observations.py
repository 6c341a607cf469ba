"""Readers for position files. Every reader yields text columns plus ``source_order``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.operators.normalize import normalize, to_number
from tidewake.plans.ordered import attach
from tidewake.session import stage
from tidewake.sources.geojson import file_offsets, read_features

# Container formats by file suffix.
FORMATS = {"csv": "csv", "tsv": "tsv", "geojson": "geojson", "json": "geojson", "parquet": "parquet"}
# Fixed value: marker of the column line after a free-text preamble, and its renames.
PREAMBLE_MARKER = "Date/Time\tLongitude\tLatitude\t"
PREAMBLE_RENAMES = {"Date/Time": "timestamp_start", "Longitude": "longitude", "Latitude": "latitude"}


def file_format(path: str) -> str:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported evidence format: .{suffix}")
    return FORMATS[suffix]


def read_raw(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or file_format(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "geojson":
        return read_geojson(spark, path)
    return read_delimited(spark, path, "\t" if fmt == "tsv" else ",")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", **options: str) -> DataFrame:
    """CSV/TSV with a header, all columns text (identifiers must not become floats)."""
    df = (
        spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
        .option("quote", '"').option("escape", '"').options(**options).csv(path)
    )
    return with_file_order(df)


def with_file_order(df: DataFrame, keep_file: bool = False) -> DataFrame:
    """Stable ``source_order``: files by name, then rows by their place in the file.

    Spark numbers the rows of each task in the order they are read, and a scan split is known by
    the first byte it reads. So the place in a split is the number less the split's first one, and
    (file, block start, place) orders the input. The rows are numbered in the pass that writes them
    to the shared folder; first numbers and row counts come from what was written, as a summary
    with a row per split, which alone is windowed. The input is scanned once, so nothing depends
    on a second scan being split alike, and later readers take the columns they need.
    """
    numbered = stage(df.select(
        "*", F.input_file_name().alias("__file"), F.input_file_block_start().alias("__start"),
        F.monotonically_increasing_id().alias("__row"),
    ))
    spec = ["__file", "__start"]
    splits = numbered.groupBy(*spec).agg(F.count("*").alias("__rows"), F.min("__row").alias("__first"))
    before = Window.partitionBy(F.lit(0)).orderBy(*spec).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(*spec, (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__offset"))
    ordered = attach(numbered, offsets, spec).withColumn("source_order", F.col("__offset") + F.col("__row")).drop("__start", "__row", "__offset")
    return ordered if keep_file else ordered.drop("__file")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Point features: properties as columns, position as ``geometry_lon``/``geometry_lat``.

    GeoJSON is WGS84 by definition; a file that declares another CRS is refused. A file is read by
    as many tasks as it has scan splits (:mod:`tidewake.sources.geojson`).
    """
    lines = read_features(spark, path)
    if "frame" not in lines.columns:
        raise ValueError("not a GeoJSON feature collection")
    named = F.get_json_object("frame", "$.crs")
    if lines.where(named.isNotNull() & ~F.contains(named, F.lit("CRS84")) & ~F.contains(named, F.lit("4326"))).take(1):
        raise ValueError("geospatial input is not WGS84; reproject it before import")
    if "f" not in lines.columns:
        return spark.createDataFrame([], "geometry_lon double, geometry_lat double, source_order long")
    features = lines.where("number IS NOT NULL")
    offsets = file_offsets(features.groupBy("file").agg(F.count("*").alias("rows")))
    point = F.col("f.geometry.coordinates")
    return features.join(offsets, F.col("file") == F.col("__file")).select(
        "f.properties.*", to_number(point[0]).alias("geometry_lon"), to_number(point[1]).alias("geometry_lat"),
        (F.col("__offset") + F.col("number").cast("long")).alias("source_order"),
    )


def read_preamble_tsv(spark: SparkSession, path: str, constants: Mapping[str, str], id_prefix: str) -> DataFrame:
    """Cruise tables: free text, then a tab-separated table that starts at a marker line.

    Files are read as lines, so a long file is split over tasks like any text. All files
    must share one column line. ``constants`` are provenance columns; the record id is the
    prefix plus the 1-based row of the file.
    """
    lines = with_file_order(spark.read.text(path).select("value"), keep_file=True)
    marked = F.contains("value", F.lit(PREAMBLE_MARKER))
    heads = lines.filter(marked).groupBy("__file").agg(
        F.min(F.struct("source_order", F.regexp_replace("value", "\\r$", "").alias("line"))).alias("h"))
    layouts = [r[0] for r in heads.select("h.line").distinct().limit(2).collect()]
    if not layouts:
        raise ValueError("the table header was not found after the preamble")
    if len(layouts) > 1:
        raise ValueError("files with different column lines must be read separately")
    header = layouts[0][layouts[0].index(PREAMBLE_MARKER):]
    columns = [PREAMBLE_RENAMES.get(c, c) for c in header.split("\t")]
    start = heads.select(F.col("__file").alias("__f"), F.col("h.source_order").alias("__head"))
    body = lines.join(start, F.col("__file") == F.col("__f")).filter(
        (F.col("source_order") > F.col("__head")) & (F.trim("value") != ""))
    cells = F.split(F.regexp_replace("value", "\\r$", ""), "\t")
    return body.select(
        *[F.nullif(F.get(cells, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)],
        *[F.lit(v).alias(k) for k, v in constants.items()],
        F.concat(F.lit(id_prefix), (F.col("source_order") - F.col("__head")).cast("string")).alias("source_record_id"),
        "source_order",
    )


def read_observations(
    spark: SparkSession, path: str, *, build_id: str, source_type: str = "USER_SUPPLIED",
    source_name: str | None = None, fmt: str | None = None, field_map: Mapping[str, str] | None = None,
    registry: DataFrame | None = None, license_text: str = "USER_SUPPLIED_REVIEW_REQUIRED",
    attribution: str = "User-supplied local evidence",
) -> DataFrame:
    """Read a file or folder and normalise it to canonical observations."""
    return normalize(
        read_raw(spark, path, fmt), build_id=build_id, source_type=source_type,
        source_name=source_name or path.rstrip("/").rsplit("/", 1)[-1], field_map=field_map,
        license_text=license_text, attribution=attribution, raw_reference=path, registry=registry,
    )


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """Curated seed: all text, blanks stay blank."""
    return read_delimited(spark, path, ",", nullValue="\u0000", emptyValue="").na.fill("")


def read_bulk(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Bulk identity archive: header CSV, all text, a UTF-8 BOM is tolerated."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)
