"""Geocoded event releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators.normalize import to_number
from tidewake.schema import require_columns

# Columns an event release must have; its date format.
REQUIRED = ("event_id", "event_date", "latitude", "longitude", "level", "radius", "source")
DATE_FORMAT = "MM/dd/yy"


def read_event_csv(spark: SparkSession, path: str, encoding: str = "windows-1252") -> DataFrame:
    """Header CSV in a legacy code page (needs spark.sql.legacy.javaCharsets=true)."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)


def precision_confidence(level: Column) -> Column:
    return F.when(level == 1, "HIGH").when(level <= 4, "MEDIUM").otherwise("LOW")


def geocoded_events(
    raw: DataFrame, source_name: str = "", source_url: str = "", license_text: str = "", attribution: str = "",
) -> DataFrame:
    """Event rows with coerced numbers and dates; rows without a position are dropped."""
    require_columns(raw, REQUIRED, "event source")
    present = {c.lower() for c in raw.columns}

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in present else F.lit("")

    lon, lat = to_number(F.col("longitude")), to_number(F.col("latitude"))
    level = to_number(F.col("level")).cast("long")
    parsed = F.to_date(F.try_to_timestamp(F.col("event_date"), F.lit(DATE_FORMAT)))
    # two-digit years from 69 on belong to the last century
    dated = F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)
    day = F.date_format(dated, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    reports = to_number(F.col("number_of_report")) if "number_of_report" in present else F.lit(None).cast("double")
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"), F.lit("").alias("entity_id"),
        F.lit("UNKNOWN").alias("actor_type"), F.lit("GEOCODED_DISPUTE_EVENT").alias("event_type"),
        day.alias("start_time"), day.alias("end_time"), precision_confidence(level).alias("confidence"),
        F.lit("PUBLIC_EVENT").alias("source_type"), F.lit(source_name).alias("source_name"),
        F.col("event_id").cast("string").alias("source_record_id"), F.lit(source_url).alias("source_url"),
        F.lit(license_text).alias("license"), F.lit(attribution).alias("attribution"),
        text("event_id_cnty").alias("participant_code"), level.alias("location_precision_level"),
        to_number(F.col("radius")).alias("uncertainty_radius_degrees"), text("location").alias("location_label"),
        text("note_on_location").alias("location_note"), text("source").alias("source_report"),
        text("notes").alias("event_notes"), reports.alias("report_count"),
        lon.alias("longitude"), lat.alias("latitude"),
    ).filter(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
