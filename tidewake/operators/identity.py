"""Vessel registry indexes and the identity waterfall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions.identity import mixed_token
from tidewake.schema import blank

# Resolution order.
IDENTIFIER_FIELDS = ("MMSI", "IMO", "callsign", "hull_number")
QUERY_NAMES = ("vessel_name", "canonical_name", "name_cn", "name_en", "alias")
REGISTRY_NAMES = ("canonical_name", "name_cn", "name_en")
REGISTRY_NAME_LISTS = ("aliases", "former_names")


def _has(df: DataFrame, name: str) -> bool:
    return name.lower() in {c.lower() for c in df.columns}


def with_tokens(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``tok_<column>`` for each identity column ('' where missing).

    ASCII text is folded by built-ins. Other text needs compatibility normalisation, which
    Spark lacks; only those values are handed to the Arrow UDF, all others reach it as NULL.
    """
    return df.withColumns({f"tok_{c}": mixed_token(F.col(c)) for c in columns})


def duplicate_ids(registry: DataFrame) -> DataFrame:
    return registry.groupBy("entity_id").count().filter("count > 1")


def token_index(registry: DataFrame) -> DataFrame:
    """(field, token) → matching entities: count and, where unique, the entity.

    ``field`` is an identifier name or ``name``; names include aliases and former names.
    """
    entries = [
        F.array(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")))
        for f in IDENTIFIER_FIELDS if _has(registry, f)
    ] + [
        F.array(F.struct(F.lit("name").alias("field"), F.col(f).cast("string").alias("value")))
        for f in REGISTRY_NAMES if _has(registry, f)
    ] + [
        F.transform(
            F.coalesce(F.col(f), F.array().cast("array<string>")),
            lambda x: F.struct(F.lit("name").alias("field"), x.alias("value")),
        )
        for f in REGISTRY_NAME_LISTS if _has(registry, f)
    ]
    tokens = registry.select("entity_id", F.explode(F.flatten(F.array(*entries))).alias("e")).select(
        "entity_id", "e.field", mixed_token(F.col("e.value")).alias("token")
    )
    return (
        tokens.filter("token <> ''")
        .groupBy("field", "token")
        .agg(F.count_distinct("entity_id").alias("matches"), F.min("entity_id").alias("match_id"))
    )


def resolve(observations: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``resolved_id``, ``confidence``, ``matched_on`` and ``ambiguous``.

    An asserted id wins or stays unknown. Otherwise the first field, in priority order, whose
    token is known decides; if it names several vessels the search stops as ambiguous.

    Observations repeat few identities, so each distinct one is looked up once: its fields become
    rows, one join with the index finds them all, the first in priority decides, and one join
    brings the decision back. Rows without any identity never meet a key that another row has.
    """
    fields = [f for f in IDENTIFIER_FIELDS if _has(observations, f)]
    names = [f for f in QUERY_NAMES if _has(observations, f)]
    original = observations.columns
    given = F.to_json(F.struct("entity_id", *fields, *names))
    identities = observations.select("entity_id", *fields, *names, given.alias("__identity")).distinct()
    asserted = ~blank(F.col("entity_id"))

    def probe(rank: int, field: str, token, name: str):
        return F.struct(F.lit(rank).alias("rank"), F.lit(field).alias("field"), token.alias("token"), F.lit(name).alias("on"))

    searched = [
        probe(i, f if f in fields else "name", mixed_token(F.col(f)), f) for i, f in enumerate([*fields, *names], 1)]
    probes = identities.select("__identity", F.explode(
        F.when(asserted, F.array(probe(0, "entity_id", F.trim("entity_id"), "entity_id")))
        .otherwise(F.filter(F.array(*searched), lambda p: p["token"] != "") if searched else None)).alias("p")
    ).select("__identity", "p.*")
    ids = registry.filter("entity_id IS NOT NULL").select(
        F.lit("entity_id").alias("field"), F.col("entity_id").alias("token"), F.lit(1).cast("long").alias("matches"),
        F.col("entity_id").alias("match_id")).distinct()
    found = (
        probes.join(token_index(registry).unionByName(ids), ["field", "token"])
        .groupBy("__identity").agg(F.min_by(F.struct("matches", "match_id", "on"), "rank").alias("__f"))
        .select(F.col("__identity").alias("__found"), "__f")
    )
    anything = blank(F.col("entity_id"))
    for f in [*fields, *names]:
        anything = anything & blank(F.col(f))
    spread = F.concat(F.lit(" "), F.pmod(F.xxhash64(*original), F.lit(4096)).cast("string"))
    df = observations.withColumn("__identity", F.when(anything, spread).otherwise(given)).join(
        found, F.col("__identity") == F.col("__found"), "left")
    unique = F.col("__f.matches") == 1
    documented = F.col("__f.on").isin("entity_id", *fields)
    return df.select(
        *original,
        F.when(unique, F.col("__f.match_id")).alias("resolved_id"),
        F.when(unique, F.when(documented, "DOCUMENTED").otherwise("REPORTED")).otherwise("UNKNOWN").alias("confidence"),
        F.when(asserted, "entity_id").otherwise(F.col("__f.on")).alias("matched_on"),
        F.coalesce(~unique, F.lit(False)).alias("ambiguous"),
    )


def enrich(observations: DataFrame, registry: DataFrame) -> DataFrame:
    """Resolve, then let the registry override the actor and fill a blank name."""
    original = observations.columns
    resolved = resolve(observations, registry)
    take = blank(F.col("entity_id")) & F.col("resolved_id").isNotNull()
    name = F.col("canonical_name") if _has(registry, "canonical_name") else F.lit(None).cast("string")
    entity = registry.select(
        F.col("entity_id").alias("__id"), F.col("actor_type").alias("__actor"), name.alias("__name")
    )
    if _has(observations, "identity_confidence"):
        resolved = resolved.withColumn(
            "identity_confidence", F.when(take, F.col("confidence")).otherwise(F.col("identity_confidence")))
    df = resolved.withColumn("entity_id", F.when(take, F.col("resolved_id")).otherwise(F.col("entity_id")))
    # rows without an id probe keys that no vessel has, so they do not gather in one task
    spread = F.concat(F.lit(" "), F.pmod(F.xxhash64(*original), F.lit(4096)).cast("string"))
    key = F.when(blank(F.col("entity_id")), spread).otherwise(F.trim("entity_id"))
    df = df.withColumn("__key", key).join(entity, F.col("__key") == F.col("__id"), "left").withColumn(
        "actor_type", F.coalesce("__actor", "actor_type"))
    if _has(observations, "vessel_name"):
        df = df.withColumn(
            "vessel_name",
            F.when(blank(F.col("vessel_name")), F.coalesce("__name", "vessel_name")).otherwise(F.col("vessel_name")))
    return df.select(*original)


def registry_subset(registry: DataFrame, cleaned: DataFrame) -> DataFrame:
    present = cleaned.filter(~blank(F.col("entity_id"))).select("entity_id").distinct()
    return registry.join(present, "entity_id", "left_semi")
