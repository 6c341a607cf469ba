"""Checked queries: crosswalk, census tables, licences, content checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from tidewake.functions.identity import census_actor
from tidewake.operators import crosswalk as cw

START, END = "2022-01-01", "2026-08-23"

RESOLVED = """
slots AS (
  SELECT vessel_key, 0 AS slot, mmsi_primary AS mmsi FROM crosswalk WHERE mmsi_primary <> ''
  UNION ALL SELECT vessel_key, 1, mmsi_secondary FROM crosswalk WHERE mmsi_secondary <> ''),
facts AS (
  SELECT mmsi, list_sort(list_distinct(list(CAST(yr AS varchar)))) AS years,
         array_to_string(list_sort(list_distinct(list(flag))), ';') AS flags,
         array_to_string(list_sort(list_distinct(list(vessel_class))), ';') AS classes
  FROM bulk GROUP BY mmsi),
hits AS (
  SELECT vessel_key, arg_min(mmsi, slot) AS mmsi, count(*) AS n FROM slots JOIN facts USING (mmsi) GROUP BY vessel_key),
resolution AS (
  SELECT c.vessel_key AS entity_key,
    CASE WHEN actor_family = 'MILITIA;FISHING' THEN 'MARITIME_MILITIA' WHEN actor_family = 'RESEARCH' THEN 'RESEARCH_SURVEY'
         WHEN actor_family IN ('PLAN','CCG','FISHING','OTHER') THEN actor_family ELSE 'OTHER' END AS actor_type,
    CASE WHEN mmsi_primary <> '' OR mmsi_secondary <> '' THEN 'YES' ELSE 'NO' END AS successfully_searched,
    CASE WHEN mmsi_primary <> '' OR mmsi_secondary <> '' THEN 'MMSI' WHEN hull_number <> '' THEN 'OTHER' ELSE 'NAME' END AS query_method,
    CASE WHEN mmsi_primary <> '' THEN mmsi_primary WHEN mmsi_secondary <> '' THEN mmsi_secondary
         WHEN hull_number <> '' THEN hull_number ELSE name_en END AS query_value,
    coalesce(h.mmsi, '') AS reported_mmsi, coalesce(f.flags, '') AS flag, coalesce(f.classes, '') AS vessel_class,
    CASE WHEN f.years IS NULL THEN '' ELSE concat(f.years[1], '-01-01') END AS first_available_date,
    CASE WHEN f.years IS NULL THEN '' ELSE concat(f.years[-1], '-12-31') END AS last_available_date,
    coalesce(array_to_string(f.years, ';'), '') AS bulk_summary_years,
    CASE WHEN h.mmsi IS NOT NULL THEN 'EXACT_IDENTIFIER' ELSE 'NO_MATCH' END AS match_status,
    CASE WHEN h.mmsi IS NOT NULL THEN 'IDENTITY_MATCH_NO_TRACK' WHEN mmsi_primary <> '' OR mmsi_secondary <> '' THEN 'NO_IDENTITY_MATCH'
         ELSE 'NOT_TESTED' END AS resolution_status,
    coalesce(h.n, 0) AS candidate_count
  FROM crosswalk c LEFT JOIN hits h USING (vessel_key) LEFT JOIN facts f ON f.mmsi = h.mmsi)"""
VIEWS = ("crosswalk", "bulk")
MATCHED = f"WITH {RESOLVED.strip()}, matched AS (SELECT *, concat('mmsi:', reported_mmsi) AS identity_key FROM resolution WHERE match_status = 'EXACT_IDENTIFIER')"


def resolution(t: Inputs):
    return cw.resolve_crosswalk(t.view("crosswalk"), t.view("bulk"))


def matches(t: Inputs):
    return cw.matched_entities(resolution(t))


@query("jn5_bulk_semi_join", f"WITH {RESOLVED.strip()} SELECT mmsi, yr, flag, vessel_class FROM bulk WHERE mmsi IN (SELECT mmsi FROM slots)", views=VIEWS)
def jn5(t):
    return cw.bulk_of_interest(t.view("bulk"), t.view("crosswalk"))


@query("src7_bulk_scan", "SELECT flag, CAST(yr AS varchar) AS yr, count(*) AS rows_read FROM bulk GROUP BY 1, 2", views=("bulk",))
def src7(t):
    from checks.files import written
    from tidewake.sources.observations import read_bulk

    path = written(t, "bulk", t.view("bulk"), "csv")
    return read_bulk(t.spark, path).groupBy("flag", "yr").agg(F.count("*").alias("rows_read"))


@query("jn6_crosswalk_resolution", f"WITH {RESOLVED.strip()} SELECT * FROM resolution", views=VIEWS)
def jn6(t):
    return resolution(t).select(
        "entity_key", "actor_type", "successfully_searched", "query_method", "query_value", "reported_mmsi", "flag",
        "vessel_class", "first_available_date", "last_available_date", "bulk_summary_years", "match_status",
        "resolution_status", "candidate_count")


# an archive that leaves classes empty and carries inferred ones
_INFERRED = ("CASE WHEN yr % 3 = 0 THEN '' WHEN yr % 3 = 1 THEN NULL ELSE vessel_class END", "CASE WHEN yr % 2 = 0 THEN concat('inferred-', flag) END")


@query("jn6_inferred_classes", f"""WITH archive AS (SELECT mmsi, CASE WHEN coalesce({_INFERRED[0]}, '') <> '' THEN vessel_class ELSE {_INFERRED[1]} END AS class FROM bulk),
  slots AS (SELECT vessel_key, 0 AS slot, mmsi_primary AS mmsi FROM crosswalk WHERE mmsi_primary <> '' UNION ALL SELECT vessel_key, 1, mmsi_secondary FROM crosswalk WHERE mmsi_secondary <> ''),
  facts AS (SELECT mmsi, array_to_string(list_sort(list_distinct(list(class) FILTER (WHERE class <> ''))), ';') AS classes FROM archive GROUP BY mmsi),
  hits AS (SELECT vessel_key, arg_min(mmsi, slot) AS mmsi FROM slots JOIN facts USING (mmsi) GROUP BY vessel_key)
  SELECT c.vessel_key AS entity_key, coalesce(f.classes, '') AS vessel_class FROM crosswalk c LEFT JOIN hits h USING (vessel_key) LEFT JOIN facts f ON f.mmsi = h.mmsi""", views=VIEWS)
def jn6b(t):
    bulk = t.view("bulk").selectExpr("mmsi", "yr", "flag", f"{_INFERRED[0]} AS vessel_class", f"{_INFERRED[1]} AS vessel_class_inferred")
    return cw.resolve_crosswalk(t.view("crosswalk"), bulk).select("entity_key", "vessel_class")


@query("ord3_strongest_query", f"WITH {RESOLVED.strip()} SELECT entity_key AS vessel_key, query_method, query_value FROM resolution", views=VIEWS)
def ord3(t):
    return cw.strongest_query(t.view("crosswalk")).select("vessel_key", "query_method", "query_value")


@query("flt9_matched_entities", MATCHED + " SELECT entity_key, identity_key FROM matched", views=VIEWS)
def flt9(t):
    return matches(t).select("entity_key", "identity_key")


@query("jn7_track_tests", MATCHED + """ SELECT entity_key, interface, export_format, retrieval_status, CASE WHEN interface = 'BULK_ARCHIVE' THEN 'IDENTITY_ONLY' ELSE 'NO' END AS usable
  FROM matched, (VALUES ('API','NONE','NOT_TESTED'), ('INTERACTIVE_UI','NONE','NOT_TESTED'), ('INTERACTIVE_EXPORT','CSV;GEOJSON','EXPORT_DOCUMENTED_AUTH_REQUIRED'),
    ('BULK_ARCHIVE','CSV','BULK_ONLY_NO_INDIVIDUAL_TRACK')) d(interface, export_format, retrieval_status)""", views=VIEWS)
def jn7(t):
    return cw.track_tests(matches(t), START, END).select("entity_key", "interface", "export_format", "retrieval_status", "usable")


@query("jn8_event_tests", MATCHED + """ SELECT entity_key, identity_key, actor_type, event_type, 'NOT_TESTED' AS retrieval_status
  FROM matched, (VALUES ('fishing'), ('encounter'), ('loitering'), ('port_visit'), ('AIS_gap')) d(event_type)""", views=VIEWS)
def jn8(t):
    return cw.event_tests(matches(t), START, END).select("entity_key", "identity_key", "actor_type", "event_type", "retrieval_status")


@query("agg5_actor_coverage", f"""WITH {RESOLVED.strip()} SELECT a.actor_type, count(r.entity_key) AS entities,
  count(*) FILTER (WHERE successfully_searched = 'YES') AS successfully_searched, count(*) FILTER (WHERE match_status = 'EXACT_IDENTIFIER') AS exact_matches,
  count(*) FILTER (WHERE resolution_status = 'NO_IDENTITY_MATCH') AS no_match_when_searched, count(*) FILTER (WHERE resolution_status = 'NOT_TESTED') AS not_tested,
  CASE WHEN count(r.entity_key) = 0 THEN '0.00' ELSE printf('%.2f', 100.0 * count(*) FILTER (WHERE match_status = 'EXACT_IDENTIFIER') / count(r.entity_key)) END AS match_percentage
  FROM (VALUES ('PLAN'),('CCG'),('RESEARCH_SURVEY'),('FISHING'),('MARITIME_MILITIA'),('OTHER')) a(actor_type) LEFT JOIN resolution r USING (actor_type) GROUP BY 1""", views=VIEWS)
def agg5(t):
    return cw.actor_summary(resolution(t)).select(
        "actor_type", "entities", "successfully_searched", "exact_matches", "no_match_when_searched", "not_tested", "match_percentage")


@query("cen2_regional_relevance", MATCHED + " SELECT entity_key, actor_type, first_available_date AS summary_start, last_available_date AS summary_end, bulk_summary_years AS summary_years, 'NO' AS individual_positions_usable FROM matched", views=VIEWS)
def cen2(t):
    return cw.relevance(matches(t), START, END).select(
        "entity_key", "actor_type", "summary_start", "summary_end", "summary_years", "individual_positions_usable")


@query("nrm15_census_actor", """SELECT vessel_key, actor_family, CASE actor_family WHEN 'MILITIA;FISHING' THEN 'MARITIME_MILITIA' WHEN 'RESEARCH' THEN 'RESEARCH_SURVEY'
  WHEN 'CCG' THEN 'CCG' WHEN 'PLAN' THEN 'PLAN' ELSE 'OTHER' END AS actor_type FROM crosswalk""", views=("crosswalk",))
def nrm15(t):
    return t.view("crosswalk").select("vessel_key", "actor_family", census_actor(F.col("actor_family")).alias("actor_type"))


# --- upsert, append, list edits ---------------------------------------------------------------

_CHANGES = """changes AS (SELECT concat('src-', CAST(p_partkey * 2 AS varchar(20))) AS source_id, p_type AS decision_reason,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'OPEN_BULK_ARCHIVE' END AS access_class FROM part)"""


def _changes(t):
    t.table("part").createOrReplaceTempView("part")
    return t.spark.sql(f"WITH {_CHANGES} SELECT * FROM changes")


@query("jn9_upsert", f"""WITH {_CHANGES} SELECT coalesce(c.source_id, s.source_id) AS source_id, coalesce(c.access_class, s.access_class) AS access_class,
  coalesce(c.decision_reason, s.decision_reason) AS decision_reason, s.provider FROM sources s FULL JOIN changes c ON s.source_id = c.source_id""", views=("sources",))
def jn9(t):
    base = t.view("sources").select("source_id", "access_class", "decision_reason", "provider")
    return cw.upsert(base, _changes(t), "source_id")


@query("jn9_append_new", f"""WITH {_CHANGES} SELECT source_id, access_class, provider FROM sources
  UNION ALL SELECT source_id, access_class, NULL FROM changes c WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.source_id = c.source_id)""", views=("sources",))
def jn9b(t):
    base = t.view("sources").select("source_id", "access_class", "provider")
    return cw.append_new(base, _changes(t).select("source_id", "access_class"), "source_id")


@query("jn9_clone_template", """SELECT concat(source_id, '-copy') AS source_id, provider, 'OPEN_API' AS access_class, evidence_type FROM sources""", views=("sources",))
def jn9c(t):
    base = t.view("sources").select("source_id", "provider", "access_class", "evidence_type")
    templates = base.select(F.concat("source_id", F.lit("-copy")).alias("source_id"), F.col("source_id").alias("template"),
                            F.lit("OPEN_API").alias("access_class"))
    return cw.clone_rows(base, templates, "source_id")


_NOTED = """noted AS (SELECT *, concat('registry;', flagsrc, ';archive_v3') AS source_ids, CASE WHEN vessel_key LIKE '%7' THEN 'Seen. Matched in archive.' ELSE 'Seen.' END AS notes,
  '2025-01-01' AS last_checked_utc FROM (SELECT *, CASE WHEN hull_number <> '' THEN 'hulls' ELSE '' END AS flagsrc FROM crosswalk))"""


@query("jn9_list_and_note_edit", f"WITH {RESOLVED.strip()}, {_NOTED}" + """ SELECT vessel_key,
  CASE WHEN h.mmsi IS NULL THEN source_ids WHEN flagsrc <> '' THEN 'registry;hulls' ELSE 'registry' END AS source_ids,
  CASE WHEN h.mmsi IS NULL OR vessel_key LIKE '%7' THEN notes ELSE 'Seen. Matched in archive.' END AS notes,
  CASE WHEN h.mmsi IS NULL THEN last_checked_utc ELSE '2026-08-25' END AS last_checked_utc
  FROM noted LEFT JOIN hits h USING (vessel_key)""", views=VIEWS)
def jn9d(t):
    t.view("crosswalk").createOrReplaceTempView("crosswalk")
    noted = t.spark.sql(f"WITH {_NOTED} SELECT * FROM noted")
    out = cw.apply_matches(noted, resolution(t), "archive_v3", "Matched in archive.", "2026-08-25")
    return out.select("vessel_key", "source_ids", "notes", "last_checked_utc")


# --- unions and referential checks ------------------------------------------------------------


@query("set2_crosswalk_union", """SELECT concat('MM-', lpad(CAST(c_custkey AS varchar), 7, '0')) AS vessel_key, c_name AS name_en, concat('4', lpad(CAST(c_custkey AS varchar), 8, '0')) AS mmsi_primary,
    upper(replace(c_mktsegment, ' ', '_')) AS identity_confidence, CAST(NULL AS varchar) AS hull_number FROM customer
  UNION ALL SELECT vessel_key, name_en, mmsi_primary, NULL, hull_number FROM crosswalk""", views=("crosswalk",))
def set2(t):
    c = t.table("customer")
    rows = c.select(
        "c_custkey", F.concat(F.lit(" "), "c_name").alias("name"),
        F.concat(F.lit("4"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit(".0")).alias("mmsi_1"),
        F.lit("").alias("mmsi_2"), F.lower("c_mktsegment").alias("identification"))
    curated = t.view("crosswalk").select("vessel_key", "name_en", "mmsi_primary", "hull_number")
    return cw.crosswalk_union(rows, curated, "MM-", "c_custkey", 7).select(
        "vessel_key", "name_en", "mmsi_primary", "identity_confidence", "hull_number")


@query("set4_unlisted_references", """WITH r AS (SELECT unnest(string_split(concat('src-', l_partkey * 2, ';src-', l_suppkey, ';'), ';')) AS source_id FROM lineitem)
  SELECT source_id, count(*) AS references FROM r WHERE source_id <> '' AND source_id NOT IN (SELECT source_id FROM sources) GROUP BY 1""".replace("AS references", 'AS "references"'), views=("sources",))
def set4(t):
    rows = t.table("lineitem").select(F.concat(
        F.lit("src-"), (F.col("l_partkey") * 2).cast("string"), F.lit(";src-"), F.col("l_suppkey").cast("string"), F.lit(";")).alias("refs"))
    return cw.unlisted_references(rows, "refs", t.view("sources"), "source_id")


@query("set4_key_difference", """WITH c AS (SELECT concat('src-', c_custkey + 700) AS source_id FROM customer)
  SELECT source_id, 'left' AS side FROM sources WHERE source_id NOT IN (SELECT source_id FROM c)
  UNION ALL SELECT source_id, 'right' FROM c WHERE source_id NOT IN (SELECT source_id FROM sources)""", views=("sources",))
def set4b(t):
    c = t.table("customer").select(F.concat(F.lit("src-"), (F.col("c_custkey") + 700).cast("string")).alias("source_id"))
    return cw.key_difference(t.view("sources"), c, "source_id")


@query("set4_repeated_keys", "SELECT source_id, count(*) AS copies FROM retrievals GROUP BY 1 HAVING count(*) > 1", views=("retrievals",))
def set4c(t):
    return cw.repeated_keys(t.view("retrievals"), "source_id")


@query("snk3_pair_parity", "SELECT 0 AS differing_rows, (SELECT count(*) FROM sources) AS table_rows".replace("0 AS", "CAST(0 AS bigint) AS"), views=("sources",))
def snk3(t):
    from checks.files import folder
    from tidewake.sources.sinks import pair_difference, write_pair

    base = t.view("sources").select("source_id", "provider", "version", "homepage", "commercial_use_known")
    root = folder(t, "pair")
    write_pair(base, root, "sources")
    return pair_difference(t.spark, root, "sources").agg(F.count("*").alias("differing_rows")).select(
        "differing_rows", base.agg(F.count("*")).scalar().alias("table_rows"))


# --- coverage, licences, content gates --------------------------------------------------------

_MARK = """CASE WHEN regexp_matches(evidence_type, 'AIS_TRACK|GPS_TRACK|CRUISE_TRACK') THEN 'RAW' WHEN regexp_matches(evidence_type, 'PRESENCE|ACTIVITY') THEN 'AGG'
  WHEN regexp_matches(evidence_type, 'SAR|VIIRS') THEN 'DETECT' WHEN regexp_matches(evidence_type, 'EVENT|OBSERVATION') THEN 'EVENT' ELSE 'REF' END"""


def _covered(name, pattern):
    return f"""CASE WHEN regexp_matches(geographic_coverage, 'Global|{pattern}') THEN {_MARK} ELSE '' END AS "{name}\""""


@query("agg9_coverage_matrix", "SELECT source_id, " + ", ".join([
    _covered("Taiwan East", "Taiwan"), _covered("Taiwan South", "Taiwan"), _covered("Taiwan Strait", "Taiwan"),
    _covered("Bashi/Luzon Strait", "Bashi/Luzon Strait|Taiwan South|South China Sea"), _covered("East China Sea", "East China Sea"),
    _covered("Senkaku/Diaoyu", "Senkaku/Diaoyu"), _covered("South China Sea", "South China Sea"), _covered("Yellow Sea", "Yellow Sea"),
    _covered("Western Pacific", "Western Pacific"), _covered("Indian Ocean", "Indian Ocean"), _covered("Global", "Global"),
]) + " FROM sources WHERE connector_priority <> 'REJECT'", views=("sources",))
def agg9(t):
    return cw.coverage_matrix(t.view("sources")).select("source_id", *[f"`{g}`" for g in cw.GEOGRAPHIES])


@query("cen1_license_matrix", """SELECT source_id, provider, access_class, default_eligible,
  CASE WHEN access_class IN ('OPEN_REGISTRATION','COMMERCIAL','PARTNER_ONLY','CONTRIBUTOR_ONLY') THEN 'required' ELSE 'not required for tested direct artifact' END AS account_or_contract,
  CASE WHEN default_eligible = 'YES' THEN 'NO' ELSE 'YES before integration' END AS legal_review_needed FROM sources""", views=("sources",))
def cen1(t):
    return cw.license_matrix(t.view("sources"))


@query("cen4_content_gates", """SELECT source_id, 'DEFAULT_WITHOUT_RETRIEVAL' AS problem FROM sources WHERE default_eligible = 'YES'
    AND source_id NOT IN (SELECT source_id FROM retrievals WHERE access_result LIKE 'SUCCESS%' AND decision <> 'REJECT_ARTIFACT')
  UNION ALL SELECT source_id, 'COMMERCIAL_NOT_P3_OR_DEFAULT' FROM sources WHERE access_class = 'COMMERCIAL' AND (connector_priority <> 'P3' OR default_eligible <> 'NO')""", views=("sources", "retrievals"))
def cen4(t):
    return cw.default_gate(t.view("sources"), t.view("retrievals"))


@query("cen4_search_saturated", """SELECT bool_and(novel = 'NO') AND count(*) = 2 AS saturated FROM (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 'YES' ELSE 'NO' END AS novel FROM orders ORDER BY o_orderkey DESC LIMIT 2)""")
def cen4b(t):
    log = t.table("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "YES").otherwise("NO").alias("novel"))
    return cw.search_saturated(log, "o_orderkey", "novel")


@query("set2_malformed_mmsi", """SELECT vessel_key, slot, mmsi FROM (SELECT vessel_key, 0 AS slot, mmsi_primary AS mmsi FROM short UNION ALL SELECT vessel_key, 1, mmsi_secondary FROM short)
  WHERE mmsi <> '' AND NOT regexp_full_match(mmsi, '[0-9]{9}')""".replace("SELECT vessel_key, slot", "WITH short AS (SELECT vessel_key, CASE WHEN hull_number <> '' THEN mmsi_primary ELSE substr(mmsi_primary, 1, CAST(6 + length(name_en) % 4 AS bigint)) END AS mmsi_primary, mmsi_secondary || hull_number AS mmsi_secondary FROM crosswalk) SELECT vessel_key, slot", 1), views=("crosswalk",))
def set2_malformed(t):
    short = t.view("crosswalk").select(
        "vessel_key", F.when(F.col("hull_number") != "", F.col("mmsi_primary")).otherwise(
            F.col("mmsi_primary").substr(F.lit(1), 6 + F.length("name_en") % 4)).alias("mmsi_primary"),
        F.concat("mmsi_secondary", "hull_number").alias("mmsi_secondary"))
    return cw.invalid_mmsi(short)
