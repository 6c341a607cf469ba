"""Writers of layers, derived tables and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators.crosswalk import table_difference
from tidewake.operators.qc import QualityResult
from tidewake.schema import EMPTY_LAYERS

# Columns of the source evidence table.
EVIDENCE_COLUMNS = (
    "observation_id", "entity_id", "source_type", "source_name", "source_record_id", "source_url",
    "source_date", "observation_method", "position_uncertainty_m", "temporal_uncertainty_s",
    "license", "attribution",
)


def write_layer(df: DataFrame, root: str, layer: str, partition_by: tuple[str, ...] = ()) -> str:
    """One Parquet dataset per named layer."""
    path = f"{root.rstrip('/')}/{layer}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def empty_layer(spark: SparkSession, layer: str) -> DataFrame:
    """Typed empty table of a layer whose source is absent."""
    return spark.createDataFrame([], EMPTY_LAYERS[layer])


def flat(df: DataFrame) -> DataFrame:
    """Arrays as JSON text, so that the table fits CSV."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({name: F.to_json(name) for name in nested})


def source_evidence(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(*EVIDENCE_COLUMNS)


def derived_tables(result: QualityResult) -> dict[str, DataFrame]:
    return {
        "cleaned_points": result.cleaned_points, "excluded_points": result.excluded_points,
        "quality_flags": result.quality_flags, "gaps": result.gaps,
        "track_summary": result.track_segments, "vessel_summary": result.vessel_summary,
        "source_evidence": source_evidence(result.cleaned_points),
    }


def write_derived(result: QualityResult, root: str) -> list[str]:
    paths = []
    for name, df in derived_tables(result).items():
        path = f"{root.rstrip('/')}/{name}"
        flat(df).write.mode("overwrite").option("header", True).csv(path)
        paths.append(path)
    return paths


def write_pair(df: DataFrame, root: str, name: str) -> None:
    """The same rows as CSV and JSON, in the given column order."""
    text = flat(df).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    text.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{root}/{name}.csv")
    text.write.mode("overwrite").json(f"{root}/{name}.json")


def pair_difference(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows that the CSV and the JSON form do not share (empty when they agree)."""
    left = spark.read.option("header", True).csv(f"{root}/{name}.csv").na.fill("")
    right = spark.read.schema(left.schema).json(f"{root}/{name}.json").na.fill("")
    return table_difference(left, right)


def case_summary(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Row counts of the derived tables of a package."""
    out = None
    for name in names:
        n = spark.read.option("header", True).csv(f"{root}/{name}").agg(F.count("*").alias("rows"))
        n = n.select(F.lit(name).alias("dataset"), "rows")
        out = n if out is None else out.unionByName(n)
    return out
