"""Identity crosswalks against bulk archives, census tables and their content checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.identity import census_actor, strip_float_suffix

# Census vocabularies.
CENSUS_ACTORS = ("PLAN", "CCG", "RESEARCH_SURVEY", "FISHING", "MARITIME_MILITIA", "OTHER")
GEOGRAPHIES = (
    "Taiwan East", "Taiwan South", "Taiwan Strait", "Bashi/Luzon Strait", "East China Sea",
    "Senkaku/Diaoyu", "South China Sea", "Yellow Sea", "Western Pacific", "Indian Ocean", "Global",
)
EVIDENCE_MARKERS = (
    ("RAW", ("AIS_TRACK", "GPS_TRACK", "CRUISE_TRACK")),
    ("AGG", ("PRESENCE", "ACTIVITY")),
    ("DETECT", ("SAR", "VIIRS")),
    ("EVENT", ("EVENT", "OBSERVATION")),
)
# Fixed values.
ACCOUNT_CLASSES = ("OPEN_REGISTRATION", "COMMERCIAL", "PARTNER_ONLY", "CONTRIBUTOR_ONLY")
EVENT_KINDS = ("fishing", "encounter", "loitering", "port_visit", "AIS_gap")
# interface, authentication, account, token, display, export, format, download, status
TRACK_INTERFACES = (
    ("API", "YES", "YES", "YES", "NO", "NO", "NONE", "NO", "NOT_TESTED"),
    ("INTERACTIVE_UI", "UNKNOWN", "UNKNOWN", "NO", "NO", "NO", "NONE", "NO", "NOT_TESTED"),
    ("INTERACTIVE_EXPORT", "YES", "YES", "NO", "UNKNOWN", "YES", "CSV;GEOJSON", "NO",
     "EXPORT_DOCUMENTED_AUTH_REQUIRED"),
    ("BULK_ARCHIVE", "NO", "NO", "NO", "NO", "NO", "CSV", "YES", "BULK_ONLY_NO_INDIVIDUAL_TRACK"),
)
_INTERFACE_FIELDS = (
    "interface", "authentication_required", "account_required", "api_token_required",
    "track_display_available", "track_export_available", "export_format",
    "actual_download_success", "retrieval_status",
)
# Fixed values.
_QUERY_ORDER = (
    ("IMO", "imo"), ("MMSI", "mmsi_primary"), ("MMSI", "mmsi_secondary"), ("OTHER", "hull_number"),
    ("NAME", "name_en"), ("NAME", "name_zh"), ("ALIAS", "aliases"),
)


def _text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def strongest_query(crosswalk: DataFrame) -> DataFrame:
    """Add ``query_method`` and ``query_value``: the first non-blank identifying field."""
    steps = [
        F.when(_text(crosswalk, field) != "", F.struct(
            F.lit(kind).alias("query_method"), _text(crosswalk, field).alias("query_value")))
        for kind, field in _QUERY_ORDER if field in crosswalk.columns
    ]
    return crosswalk.withColumn("__q", F.coalesce(*steps)).select(*crosswalk.columns, "__q.*")


def slots(crosswalk: DataFrame) -> DataFrame:
    """(vessel_key, slot, mmsi) of the non-blank MMSI slots."""
    pair = F.array(_text(crosswalk, "mmsi_primary"), _text(crosswalk, "mmsi_secondary"))
    return crosswalk.select("vessel_key", F.posexplode(pair).alias("slot", "mmsi")).filter("mmsi <> ''")


def bulk_of_interest(bulk: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Rows of the archive whose MMSI is in some slot (a semi join, no duplication)."""
    targets = slots(crosswalk).select("mmsi").distinct()
    return bulk.withColumn("mmsi", F.trim("mmsi")).join(targets, "mmsi", "left_semi")


def resolve_crosswalk(crosswalk: DataFrame, bulk: DataFrame, bulk_loaded: bool = True) -> DataFrame:
    """Status, years, flags and classes of each crosswalk vessel in the archive.

    The archive is reduced to one row per MMSI before it meets the slots; of the slots
    with a match the first wins. A row without a class takes ``vessel_class_inferred``, where
    the archive has that column. ``executed_interface`` is NONE where nothing was searched.
    """
    if "vessel_class_inferred" in bulk.columns:
        bulk = bulk.withColumn("vessel_class", F.coalesce(F.nullif("vessel_class", F.lit("")), "vessel_class_inferred"))
    facts = (
        bulk_of_interest(bulk, crosswalk)
        .groupBy("mmsi")
        .agg(
            F.array_sort(F.collect_set(F.col("yr").cast("string"))).alias("years"),
            F.array_sort(F.collect_set(F.when(F.col("flag") != "", F.col("flag")))).alias("flags"),
            F.array_sort(F.collect_set(F.when(F.col("vessel_class") != "", F.col("vessel_class")))).alias("classes"),
        )
    )
    found = slots(crosswalk)
    matched = (
        found.join(facts, "mmsi")
        .groupBy("vessel_key")
        .agg(
            F.min_by(F.struct("mmsi", "years", "flags", "classes"), "slot").alias("m"),
            F.count("*").alias("candidate_count"),
        )
    )
    has_slot = (_text(crosswalk, "mmsi_primary") != "") | (_text(crosswalk, "mmsi_secondary") != "")
    base = strongest_query(crosswalk).withColumn(
        "successfully_searched", F.when(has_slot & F.lit(bulk_loaded), "YES").otherwise("NO"))
    hit = F.col("m").isNotNull()
    years = F.col("m.years")

    def joined(field: str) -> Column:
        return F.coalesce(F.array_join(F.col(f"m.{field}"), ";"), F.lit(""))

    return base.join(matched, "vessel_key", "left").select(
        F.col("vessel_key").alias("entity_key"), census_actor(F.col("actor_family")).alias("actor_type"),
        F.col("actor_family").alias("source_actor_type"), F.lit("YES").alias("attempted"),
        "successfully_searched", "query_method", "query_value",
        F.when(F.col("successfully_searched") == "YES", "BULK_ARCHIVE").otherwise("NONE").alias("executed_interface"),
        F.when(hit, F.concat(F.lit("mmsi:"), F.col("m.mmsi"))).otherwise("").alias("identity_key"),
        F.coalesce("m.mmsi", F.lit("")).alias("reported_mmsi"),
        joined("flags").alias("flag"), joined("classes").alias("vessel_class"),
        F.when(hit, F.concat(years[0], F.lit("-01-01"))).otherwise("").alias("first_available_date"),
        F.when(hit, F.concat(F.element_at(years, -1), F.lit("-12-31"))).otherwise("").alias("last_available_date"),
        joined("years").alias("bulk_summary_years"),
        F.when(hit, "EXACT_IDENTIFIER").otherwise("NO_MATCH").alias("match_status"),
        F.when(hit, "1.0").otherwise("").alias("match_confidence"),
        F.when(hit, "IDENTITY_MATCH_NO_TRACK")
        .when(F.col("successfully_searched") == "YES", "NO_IDENTITY_MATCH")
        .otherwise("NOT_TESTED").alias("resolution_status"),
        F.coalesce("candidate_count", F.lit(0)).cast("long").alias("candidate_count"),
        F.when(hit, "CHECKED_NO_NEW_SOURCE_LINK").otherwise("NOT_APPLICABLE").alias("snowball_status"),
    )


def matched_entities(resolution: DataFrame) -> DataFrame:
    return resolution.filter(F.col("match_status") == "EXACT_IDENTIFIER")


def _each(values: Sequence[Sequence[str]], fields: Sequence[str]) -> Column:
    """Literal definition rows as an array to explode: a product without a join."""
    return F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row)]) for row in values])


def track_tests(matches: DataFrame, period_start: str, period_end: str) -> DataFrame:
    """One row per matched vessel and access interface."""
    return matches.select(
        "entity_key", "identity_key", "actor_type",
        F.explode(_each(TRACK_INTERFACES, _INTERFACE_FIELDS)).alias("d"),
    ).select(
        "entity_key", "identity_key", "actor_type", "d.*",
        F.lit(period_start).alias("test_period_start"), F.lit(period_end).alias("test_period_end"),
        F.lit(0).cast("long").alias("position_count"),
        F.when(F.col("d.interface") == "BULK_ARCHIVE", "YES").otherwise("UNKNOWN").alias("vessel_identity_present"),
        F.when(F.col("d.interface") == "BULK_ARCHIVE", "IDENTITY_ONLY").otherwise("NO").alias("usable"),
    )


def event_tests(matches: DataFrame, period_start: str, period_end: str) -> DataFrame:
    """One row per matched vessel and event kind."""
    return matches.select(
        "entity_key", "identity_key", "actor_type",
        F.explode(F.array(*[F.lit(k) for k in EVENT_KINDS])).alias("event_type"),
        F.lit(period_start).alias("period_start"), F.lit(period_end).alias("period_end"),
        F.lit("UNKNOWN").alias("coordinates_available"), F.lit("API_TOKEN_REQUIRED").alias("access"),
        F.lit("NOT_TESTED").alias("retrieval_status"), F.lit("UNRESOLVED").alias("usability"),
    )


def relevance(matches: DataFrame, period_start: str, period_end: str) -> DataFrame:
    """Regional relevance record of each matched vessel."""
    return matches.select(
        "entity_key", "identity_key", "actor_type", F.lit("YES").alias("plausibly_relevant"),
        F.lit("YES").alias("identity_available"),
        F.col("first_available_date").alias("summary_start"), F.col("last_available_date").alias("summary_end"),
        F.col("bulk_summary_years").alias("summary_years"),
        F.lit(period_start).alias("tested_period_start"), F.lit(period_end).alias("tested_period_end"),
        F.lit("NO").alias("individual_positions_usable"), F.lit("NONE").alias("position_density"),
        F.lit("NO").alias("geographic_intersection_confirmed"),
        F.lit("BULK_ONLY_NO_INDIVIDUAL_TRACK").alias("retrieval_status"),
    )


def actor_summary(resolution: DataFrame) -> DataFrame:
    """Coverage per actor group, including groups without a vessel."""
    status, match = F.col("resolution_status"), F.col("match_status")
    searched = F.col("successfully_searched") == "YES"
    counts = resolution.groupBy("actor_type").agg(
        F.count("*").alias("entities"), F.count_if(searched).alias("successfully_searched"),
        F.count_if(match == "EXACT_IDENTIFIER").alias("exact_matches"),
        F.count_if(match == "STRONG_MULTI_FIELD").alias("strong_matches"),
        F.count_if(match == "AMBIGUOUS").alias("ambiguous"),
        F.count_if(searched & (status == "NO_IDENTITY_MATCH")).alias("no_match_when_searched"),
        F.count_if(status == "NOT_TESTED").alias("not_tested"),
    )
    spark = resolution.sparkSession
    actors = spark.createDataFrame([(a,) for a in CENSUS_ACTORS], "actor_type string")
    full = actors.join(counts, "actor_type", "left").na.fill(0)
    share = 100 * (F.col("exact_matches") + F.col("strong_matches")) / F.when(F.col("entities") > 0, F.col("entities"))
    return full.withColumn("match_percentage", F.coalesce(F.format_string("%.2f", share), F.lit("0.00"))).withColumn(
        "match_percentage", F.when(F.col("entities") > 0, F.col("match_percentage")).otherwise("0.00"))


# --- table maintenance ------------------------------------------------------------------------


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Update by key where a change column is non-null, insert keys that are new."""
    renamed = changes.withColumnsRenamed({c: f"__{c}" for c in changes.columns})
    joined = base.join(renamed, base[key] == renamed[f"__{key}"], "full_outer")
    out = [
        (F.coalesce(f"__{c}", c) if c in changes.columns else F.col(c)).alias(c) for c in base.columns
    ]
    return joined.select(*out)


def clone_rows(base: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """New rows copied from a template row: ``templates`` has (key, template, overrides…).
    Keys that exist already are skipped; follow with :func:`upsert` to change those."""
    new = templates.join(base.select(key), key, "left_anti").withColumnsRenamed(
        {c: f"__{c}" for c in templates.columns})
    joined = new.join(base, new["__template"] == base[key])
    out = []
    for c in base.columns:
        if c == key:
            out.append(F.col(f"__{key}").alias(c))
        elif c in templates.columns:
            out.append(F.coalesce(f"__{c}", c).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def append_new(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return base.unionByName(rows.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def drop_from_list(column: Column, value: str, sep: str = ";") -> Column:
    """Remove a value and blanks from a separated list."""
    items = F.filter(F.split(column, sep), lambda x: (x != "") & (x != value))
    return F.array_join(items, sep)


def append_note(column: Column, note: str) -> Column:
    """Append a sentence once."""
    return F.when(F.contains(column, F.lit(note)), column).otherwise(
        F.concat(F.rtrim(column, F.lit(".")), F.lit(". " + note)))


def apply_matches(crosswalk: DataFrame, resolution: DataFrame, archive_id: str, note: str, checked: str) -> DataFrame:
    """Edit the crosswalk rows of matched vessels: source list, note, date of check."""
    hits = matched_entities(resolution).select(F.col("entity_key").alias("vessel_key"), F.lit(True).alias("__hit"))
    df = crosswalk.join(hits, "vessel_key", "left")
    hit = F.col("__hit").isNotNull()
    return df.withColumns({
        "source_ids": F.when(hit, drop_from_list(F.col("source_ids"), archive_id)).otherwise(F.col("source_ids")),
        "notes": F.when(hit, append_note(F.col("notes"), note)).otherwise(F.col("notes")),
        "last_checked_utc": F.when(hit, checked).otherwise(F.col("last_checked_utc")),
    }).drop("__hit")


def crosswalk_union(bulk_rows: DataFrame, curated: DataFrame, prefix: str, order: str, width: int = 3) -> DataFrame:
    """Archive rows under a padded key, MMSI float suffixes removed, plus curated rows."""
    keyed = bulk_rows.select(
        F.concat(F.lit(prefix), F.lpad(F.col(order).cast("string"), width, "0")).alias("vessel_key"),
        F.trim("name").alias("name_en"), strip_float_suffix(F.col("mmsi_1")).alias("mmsi_primary"),
        strip_float_suffix(F.col("mmsi_2")).alias("mmsi_secondary"),
        F.translate(F.upper(F.trim("identification")), " ", "_").alias("identity_confidence"),
    )
    return keyed.unionByName(curated, allowMissingColumns=True)


def invalid_mmsi(crosswalk: DataFrame) -> DataFrame:
    return slots(crosswalk).filter(~F.col("mmsi").rlike("^[0-9]{9}$"))


# --- coverage, licences, checks ---------------------------------------------------------------


def coverage_matrix(sources: DataFrame) -> DataFrame:
    """Evidence marker of each source in each geography ('' where not covered).

    Global sources cover everything, any Taiwan text covers the three Taiwan areas, and
    Taiwan South or South China Sea also covers the strait between them and Luzon.
    """
    evidence, geo = F.col("evidence_type"), F.col("geographic_coverage")
    marker = F.lit("REF")
    for name, words in reversed(EVIDENCE_MARKERS):
        marker = F.when(F.greatest(*[F.contains(evidence, F.lit(w)) for w in words]), name).otherwise(marker)

    def mentions(word: str) -> Column:
        return F.contains(geo, F.lit(word))

    out = []
    for g in GEOGRAPHIES:
        covered = mentions("Global") | mentions(g)
        if g.startswith("Taiwan"):
            covered = covered | mentions("Taiwan")
        if g == "Bashi/Luzon Strait":
            covered = covered | mentions("Taiwan South") | mentions("South China Sea")
        out.append(F.when(covered, marker).otherwise("").alias(g))
    rest = [c for c in ("access_class", "connector_priority", "decision_reason") if c in sources.columns]
    return sources.filter(F.col("connector_priority") != "REJECT").select(
        "source_id", "provider", "evidence_type", *out, *rest)


def license_matrix(sources: DataFrame) -> DataFrame:
    """Access and legal-review columns of each source."""
    account = F.col("access_class").isin(*ACCOUNT_CLASSES)
    return sources.select(
        "source_id", "provider", "access_class", "default_eligible",
        F.when(account, "required").otherwise("not required for tested direct artifact").alias("account_or_contract"),
        F.when(F.col("default_eligible") == "YES", "NO").otherwise("YES before integration").alias("legal_review_needed"),
    )


def unlisted_references(rows: DataFrame, column: str, listed: DataFrame, key: str, sep: str = ";") -> DataFrame:
    """Values of a (multi-value) reference column that the listing lacks, with counts."""
    values = rows.select(F.explode(F.split(column, sep)).alias(key)).filter(F.trim(key) != "")
    # map-side counts first: a value held by most rows reaches the join once. A left anti join would be
    # moved below the counts by the optimiser, where every single value is shuffled and sorted
    counts = values.groupBy(key).agg(F.count("*").alias("references"))
    known = listed.select(key).distinct().withColumn("__known", F.lit(True))
    return counts.join(known, key, "left").filter(F.col("__known").isNull()).drop("__known")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that two tables do not share: empty means parity."""
    cols = a.columns
    left = a.exceptAll(b.select(*cols)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(*cols).exceptAll(a).withColumn("side", F.lit("right")))


def default_gate(sources: DataFrame, retrievals: DataFrame) -> DataFrame:
    """Default-eligible sources without a successful retrieval, and commercial sources that
    are default-eligible or not of the lowest priority."""
    success = retrievals.filter(
        F.startswith("access_result", F.lit("SUCCESS")) & (F.col("decision") != "REJECT_ARTIFACT")
    ).select("source_id").distinct()
    unproven = (
        sources.filter("default_eligible = 'YES'").join(success, "source_id", "left_anti")
        .select("source_id", F.lit("DEFAULT_WITHOUT_RETRIEVAL").alias("problem"))
    )
    commercial = sources.filter(
        (F.col("access_class") == "COMMERCIAL")
        & ((F.col("connector_priority") != "P3") | (F.col("default_eligible") != "NO"))
    ).select("source_id", F.lit("COMMERCIAL_NOT_P3_OR_DEFAULT").alias("problem"))
    return unproven.unionByName(commercial)


def search_saturated(log: DataFrame, order: str, flag: str, last: int = 2) -> DataFrame:
    """True iff the last searches of the log found nothing new (a two-row top-k, no sort of
    the log)."""
    tail = log.orderBy(F.desc(order)).limit(last)
    return tail.agg((F.bool_and(F.col(flag) == "NO") & (F.count("*") == last)).alias("saturated"))

