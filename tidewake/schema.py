"""Record layouts and enumerations shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations of the evidence model.
EVIDENCE_TYPES = (
    "AIS", "PUBLIC_TRACK", "OFFICIAL_OBSERVATION", "SAR_DETECTION", "OPTICAL_DETECTION",
    "VIIRS_BOAT_DETECTION", "PORT_RECORD", "USER_SUPPLIED", "LICENSED_EXTERNAL",
)
ACTOR_TYPES = (
    "PLAN", "CCG", "RESEARCH_SURVEY", "FISHING", "MARITIME_MILITIA", "MSA",
    "OTHER_GOVERNMENT", "UNKNOWN",
)
OBSERVATION_STATES = ("OBSERVED", "INTERPOLATED_SHORT_GAP", "INFERRED_ROUTE", "UNKNOWN")
SEGMENT_TYPES = ("OBSERVED_TRACK", "SHORT_INTERPOLATION", "INFERRED_CONNECTION")
DENSE_SOURCE_TYPES = ("AIS", "PUBLIC_TRACK", "USER_SUPPLIED")
BOUNDARY_STATUSES = (
    "treaty_delimited", "officially_declared", "provider_reference",
    "computed_reference", "disputed", "uncertain",
)
# Fixed values: (class, lower bound exclusive of the next class, upper bound), metres.
DEPTH_CLASSES = (
    ("trench", None, -6000.0),
    ("abyssal", -6000.0, -4000.0),
    ("deep", -4000.0, -2000.0),
    ("slope", -2000.0, -1000.0),
    ("upper_slope", -1000.0, -200.0),
    ("shelf", -200.0, 0.0),
)

# Canonical observation layout.
_NUMERIC = ("latitude", "longitude", "position_uncertainty_m", "temporal_uncertainty_s")
CANONICAL_COLUMNS = (
    "observation_id", "entity_id", "timestamp_start", "timestamp_end", "latitude", "longitude",
    "actor_type", "vessel_name", "hull_number", "IMO", "MMSI", "source_type", "source_name",
    "source_record_id", "source_url", "source_date", "observation_method", "identity_confidence",
    "position_confidence", "observed_or_inferred", "position_uncertainty_m",
    "temporal_uncertainty_s", "license", "attribution", "raw_record_reference",
    "processing_notes", "source_segment_id", "build_id",
)


def canonical_type(column: str) -> T.DataType:
    return T.DoubleType() if column in _NUMERIC else T.StringType()


OBSERVATION_SCHEMA = ", ".join(
    [f"{name} {canonical_type(name).simpleString()}" for name in CANONICAL_COLUMNS]
    + ["event_time timestamp", "source_order bigint"]
)
SEGMENT_SCHEMA = (
    "segment_id string, entity_id string, start_observation_id string, end_observation_id string, "
    "start_entity_id string, end_entity_id string, actor_type string, start_time timestamp, "
    "end_time timestamp, segment_type string, point_count long, max_gap_seconds double, "
    "confidence string, source_set array<string>, source_segment_ids array<string>"
)
FLAG_SCHEMA = (
    "observation_id string, entity_id string, source_order long, flag string, severity string, "
    "detail string, excluded boolean"
)
SEGMENT_COLUMNS = tuple(field.split()[0] for field in SEGMENT_SCHEMA.split(", "))
GAP_SCHEMA = (
    "entity_id string, start_time timestamp, end_time timestamp, gap_seconds double"
)
SUMMARY_SCHEMA = (
    "entity_id string, actor_type string, observation_count long, first_seen timestamp, "
    "last_seen timestamp, flag_count long"
)
EVENT_SCHEMA = (
    "event_id string, entity_id string, actor_type string, event_type string, start_time string, "
    "end_time string, confidence string, source_type string, source_name string, "
    "longitude double, latitude double"
)
ZONE_SCHEMA = (
    "source_id string, boundary_type string, legal_status string, "
    "rings array<array<struct<x:double,y:double>>>"
)
BOUNDARY_SCHEMA = (
    "source_id string, source_date string, boundary_type string, legal_status string, "
    "claimant string, counterparty string, citation string, notes string, "
    "rings array<array<struct<x:double,y:double>>>"
)
LABEL_SCHEMA = (
    "label_id string, name string, label_role string, paper_visible int, media_visible int, "
    "longitude double, latitude double"
)
EMPTY_LAYERS = {
    "observations": OBSERVATION_SCHEMA,
    "track_segments": SEGMENT_SCHEMA,
    "quality_flags": FLAG_SCHEMA,
    "gaps": GAP_SCHEMA,
    "vessel_summary": SUMMARY_SCHEMA,
    "events": EVENT_SCHEMA,
    "maritime_zones": ZONE_SCHEMA,
    "maritime_boundaries": BOUNDARY_SCHEMA,
    "orientation_labels": LABEL_SCHEMA,
}


@dataclass(frozen=True)
class QualityConfig:
    """Thresholds of quality control and segment building."""

    max_speed_knots: float = 80.0
    observed_track_max_gap_seconds: int = 3600
    large_gap_seconds: int = 21600
    allow_short_gap_interpolation: bool = False
    short_gap_interpolation_seconds: int = 10800
    inferred_connection_max_gap_seconds: int = 7 * 86400
    # 'geodesic' is the WGS84 ellipsoid, 'haversine' the sphere.
    distance: str = "geodesic"
    # A vessel's history is cut into time slices of this width, and a slice of more than about
    # ``slice_rows`` rows again, so that neither a vessel nor its busiest day becomes one task;
    # source order is cut into slices of ``source_slice`` rows.
    slice_seconds: int = 86400
    slice_rows: int = 1 << 16
    source_slice: int = 1 << 20


def blank(column) -> F.Column:
    """True for NULL and whitespace-only text: both mean "missing"."""
    return F.coalesce(F.trim(column.cast("string")), F.lit("")) == ""


def conform(df: DataFrame, columns=CANONICAL_COLUMNS) -> DataFrame:
    """Add the canonical columns that ``df`` lacks as typed NULLs."""
    present = {name.lower() for name in df.columns}
    missing = [c for c in columns if c.lower() not in present]
    return df.withColumns({c: F.lit(None).cast(canonical_type(c)) for c in missing})


def require_columns(df: DataFrame, required, what: str = "input") -> DataFrame:
    """Plan-time gate: fail before any job runs when a required column is absent."""
    present = {name.lower() for name in df.columns}
    missing = sorted(c for c in required if c.lower() not in present)
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df
