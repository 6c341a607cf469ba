"""Input views over the driver tables; the same text runs in Spark and DuckDB.

Every view covers its whole base table. Dirty values come from coprime moduli.
"""

OBSERVATIONS = """
WITH base AS (
  SELECT
    event_id AS source_order,
    concat('obs-', CAST(event_id AS varchar(20))) AS observation_id,
    concat('rec-', CAST(event_id AS varchar(20))) AS source_record_id,
    CASE WHEN event_id % 127 = 0 THEN NULL
         ELSE concat('user-', CAST(user_id AS varchar(20))) END AS entity_id,
    CASE WHEN event_id % 113 = 0 THEN NULL ELSE ts END AS event_time,
    CASE WHEN event_id % 97 = 0 THEN NULL
         WHEN event_id % 101 = 0 THEN CAST(95.0 AS double)
         ELSE CAST(20.0 AS double) + CAST(user_id % 10 AS double) * CAST(0.5 AS double)
              + CAST(event_id % 13 AS double) * CAST(0.002 AS double)
              + CASE WHEN event_id % 401 = 0 THEN CAST(40.0 AS double) ELSE CAST(0.0 AS double) END
    END AS latitude,
    CAST(118.0 AS double) + CAST(user_id % 7 AS double) * CAST(0.5 AS double)
      + CAST(event_id % 17 AS double) * CAST(0.002 AS double) AS longitude,
    CASE WHEN user_id % 3 = 0 THEN 'OFFICIAL_OBSERVATION'
         WHEN user_id % 3 = 1 THEN 'AIS' ELSE 'USER_SUPPLIED' END AS source_type,
    CASE user_id % 6 WHEN 0 THEN 'PLAN' WHEN 1 THEN 'CCG' WHEN 2 THEN 'RESEARCH_SURVEY'
         WHEN 3 THEN 'FISHING' WHEN 4 THEN 'UNKNOWN' ELSE 'PLEASURE' END AS actor_type,
    CASE WHEN event_id % 89 = 0 THEN '123'
         ELSE concat('4120', lpad(CAST(user_id AS varchar(20)), 5, '0')) END AS mmsi,
    CASE WHEN event_id % 4 = 0 THEN NULL
         ELSE concat('seg-', CAST(CAST(floor(event_id / 500) AS bigint) AS varchar(20))) END AS source_segment_id,
    CASE WHEN event_id % 131 = 0 THEN 'GUESS' ELSE 'OBSERVED' END AS observed_or_inferred,
    event_type AS source_name
  FROM events)
SELECT * FROM base
UNION ALL
SELECT source_order + 1000000000, concat('dup-', observation_id), source_record_id, entity_id, event_time,
       latitude, longitude, source_type, actor_type, mmsi, source_segment_id, observed_or_inferred, source_name
FROM base WHERE source_order % 53 = 0
"""

SIGHTINGS = """
SELECT event_id AS source_order,
  CASE WHEN event_id % 5 = 0 THEN concat('user-', CAST(user_id AS varchar(20))) ELSE NULL END AS entity_id,
  CASE WHEN event_id % 5 = 1 THEN concat('4120', lpad(CAST(user_id AS varchar(20)), 5, '0')) ELSE NULL END AS mmsi,
  CASE WHEN event_id % 5 IN (1, 2) THEN CAST((user_id + 1) % 60 AS varchar(20)) ELSE NULL END AS hull_number,
  CASE WHEN event_id % 5 = 3 THEN concat('SUPPLIER no. ', lpad(CAST(user_id AS varchar(20)), 9, '0'))
       ELSE NULL END AS vessel_name,
  event_type AS source_name
FROM events
"""

REGISTRY = """
SELECT concat('user-', CAST(s_suppkey AS varchar(20))) AS entity_id,
       s_name AS canonical_name,
       concat('supplier no ', lpad(CAST(s_suppkey AS varchar(20)), 9, '0')) AS alias_name,
       concat('4120', lpad(CAST(s_suppkey AS varchar(20)), 5, '0')) AS mmsi,
       CAST(s_suppkey % 60 AS varchar(20)) AS hull_number,
       CASE s_nationkey % 4 WHEN 0 THEN 'PLAN' WHEN 1 THEN 'CCG'
            WHEN 2 THEN 'RESEARCH_SURVEY' ELSE 'FISHING' END AS actor_type
FROM supplier
"""

CROSSWALK = """
SELECT concat('V-', lpad(CAST(c_custkey AS varchar(20)), 6, '0')) AS vessel_key,
       CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('4', lpad(CAST(c_custkey AS varchar(20)), 8, '0')) END AS mmsi_primary,
       CASE WHEN c_custkey % 3 = 0 THEN concat('4', lpad(CAST(c_custkey + 7 AS varchar(20)), 8, '0')) ELSE '' END AS mmsi_secondary,
       CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 900 AS varchar(20)) ELSE '' END AS hull_number,
       c_name AS name_en,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'MILITIA;FISHING' WHEN 'MACHINERY' THEN 'RESEARCH'
            WHEN 'AUTOMOBILE' THEN 'CCG' WHEN 'FURNITURE' THEN 'PLAN' ELSE 'TANKER' END AS actor_family
FROM customer
"""

BULK = """
SELECT concat(CASE WHEN o_custkey % 4 = 0 THEN '9' ELSE '4' END, lpad(CAST(o_custkey AS varchar(20)), 8, '0')) AS mmsi,
       CAST(year(o_orderdate) AS int) AS yr,
       o_orderstatus AS flag,
       o_orderpriority AS vessel_class
FROM orders
"""

GRID = """
SELECT CAST(floor(o_orderkey / 120) AS bigint) AS grid_row,
       CAST(o_orderkey % 120 AS bigint) AS grid_col,
       CASE WHEN o_orderkey % 211 = 0 THEN CAST(-9999.0 AS double)
            ELSE CAST(o_orderkey * 37 % 8000 AS double) END AS value
FROM orders
"""

# Study boxes near the observations, both longitude conventions.
STUDY_REGIONS = """
SELECT concat('region-', CAST(s_suppkey AS varchar(20))) AS region,
       CAST(116.0 AS double) + CAST(s_suppkey % 50 AS double) * CAST(0.1 AS double) AS xmin,
       CAST(19.5 AS double) + CAST(s_suppkey % 40 AS double) * CAST(0.125 AS double) AS ymin,
       CAST(116.0 AS double) + CAST(s_suppkey % 50 AS double) * CAST(0.1 AS double)
         + CAST(0.5 AS double) + CAST(s_suppkey % 5 AS double) * CAST(0.25 AS double) AS xmax,
       CAST(19.5 AS double) + CAST(s_suppkey % 40 AS double) * CAST(0.125 AS double) + CAST(0.75 AS double) AS ymax,
       CASE WHEN s_suppkey % 3 = 0 THEN '360' ELSE '180' END AS convention,
       CASE s_suppkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'regional' ELSE 'theatre' END AS profile
FROM supplier
"""

# World-wide boxes: valid and invalid, narrow and Pacific-wide, polar.
BOXES = """
SELECT concat('box-', CAST(c_custkey AS varchar(20))) AS region,
       CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey * 7 % 340 AS double)
            ELSE CAST(c_custkey * 11 % 330 AS double) - CAST(180.0 AS double) END AS xmin,
       CAST(c_custkey * 3 % 150 AS double) - CAST(85.0 AS double) AS ymin,
       CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey * 7 % 340 AS double)
            ELSE CAST(c_custkey * 11 % 330 AS double) - CAST(180.0 AS double) END
         + CAST(c_custkey * 13 % 220 AS double) - CAST(5.0 AS double) AS xmax,
       CAST(c_custkey * 3 % 150 AS double) - CAST(85.0 AS double)
         + CAST(c_custkey * 5 % 30 AS double) - CAST(1.0 AS double) AS ymax,
       CASE WHEN c_custkey % 2 = 0 THEN '360' ELSE '180' END AS convention,
       CASE c_custkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'regional' WHEN 2 THEN 'theatre' ELSE 'atlas' END AS profile
FROM customer
"""

# Lines of 50 vertices that drift east over the antimeridian.
VERTICES = """
SELECT CAST(floor(o_orderkey / 50) AS bigint) AS feature_id,
       CAST(o_orderkey % 50 AS bigint) AS seq,
       CAST(165.0 AS double) + CAST(CAST(floor(o_orderkey / 50) AS bigint) % 20 AS double)
         + CAST(o_orderkey % 50 AS double) * CAST(0.625 AS double) AS x360,
       CASE WHEN CAST(165.0 AS double) + CAST(CAST(floor(o_orderkey / 50) AS bigint) % 20 AS double)
                 + CAST(o_orderkey % 50 AS double) * CAST(0.625 AS double) > CAST(180.0 AS double)
            THEN CAST(-195.0 AS double) + CAST(CAST(floor(o_orderkey / 50) AS bigint) % 20 AS double)
                 + CAST(o_orderkey % 50 AS double) * CAST(0.625 AS double)
            ELSE CAST(165.0 AS double) + CAST(CAST(floor(o_orderkey / 50) AS bigint) % 20 AS double)
                 + CAST(o_orderkey % 50 AS double) * CAST(0.625 AS double) END AS x,
       CAST(CAST(floor(o_orderkey / 50) AS bigint) % 80 AS double) - CAST(40.0 AS double)
         + CAST(o_orderkey % 7 AS double) * CAST(0.25 AS double) AS y
FROM orders
"""

# A scorecard of sources.
SOURCES = """
SELECT concat('src-', CAST(p_partkey AS varchar(20))) AS source_id, p_brand AS provider, p_name AS title,
       CASE p_partkey % 7 WHEN 0 THEN 'AIS_TRACK;EVENT' WHEN 1 THEN 'PRESENCE' WHEN 2 THEN 'SAR_DETECTION'
            WHEN 3 THEN 'OBSERVATION' WHEN 4 THEN 'VESSEL_IDENTITY' WHEN 5 THEN 'CRUISE_TRACK' ELSE 'VIIRS;ACTIVITY' END AS evidence_type,
       CASE p_partkey % 6 WHEN 0 THEN 'Global' WHEN 1 THEN 'Taiwan South' WHEN 2 THEN 'South China Sea;Yellow Sea'
            WHEN 3 THEN 'Taiwan' WHEN 4 THEN 'Western Pacific;Indian Ocean' ELSE 'Senkaku/Diaoyu' END AS geographic_coverage,
       CASE p_partkey % 5 WHEN 0 THEN 'COMMERCIAL' WHEN 1 THEN 'OPEN_DOWNLOAD' WHEN 2 THEN 'PARTNER_ONLY'
            WHEN 3 THEN 'OPEN_API' ELSE 'CONTRIBUTOR_ONLY' END AS access_class,
       CASE WHEN p_partkey % 11 = 0 THEN 'REJECT' WHEN p_partkey % 5 = 0 AND p_partkey % 3 <> 0 THEN 'P3'
            ELSE concat('P', CAST(p_partkey % 3 AS varchar(1))) END AS connector_priority,
       CASE WHEN p_partkey % 4 = 1 THEN 'YES' ELSE 'NO' END AS default_eligible,
       p_type AS decision_reason,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS varchar(10)) END AS version,
       CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE '2024' END AS released,
       CASE WHEN p_partkey % 4 = 0 THEN concat('https://example.org/', CAST(p_partkey AS varchar(20))) ELSE NULL END AS homepage,
       CASE WHEN p_partkey % 4 = 1 THEN '' ELSE 'https://example.org/repo' END AS repository,
       'CC BY 4.0' AS licence,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 9 > 4 END AS commercial_use_known
FROM part
"""

RETRIEVALS = """
SELECT concat('src-', CAST(l_partkey AS varchar(20))) AS source_id,
       CASE WHEN l_linenumber % 3 = 0 THEN 'SUCCESS_DOWNLOAD' WHEN l_linenumber % 3 = 1 THEN 'LOGIN_WALL'
            ELSE 'SUCCESS' END AS access_result,
       CASE WHEN l_returnflag = 'R' THEN 'REJECT_ARTIFACT' ELSE 'KEEP' END AS decision
FROM lineitem
"""

# An event release as text columns with bad dates, numbers and positions.
EVENT_RELEASE = """
SELECT CAST(o_orderkey AS varchar(20)) AS event_id, o_orderstatus AS event_id_cnty,
       CASE WHEN o_orderkey % 31 = 0 THEN 'unknown' ELSE
         concat(lpad(CAST(month(o_orderdate) AS varchar(2)), 2, '0'), '/', lpad(CAST(day(o_orderdate) AS varchar(2)), 2, '0'),
                '/', lpad(CAST(year(o_orderdate) % 100 AS varchar(2)), 2, '0')) END AS event_date,
       CASE WHEN o_orderkey % 29 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 60 AS varchar(10)) END AS latitude,
       CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE CAST(o_orderkey % 360 - 180 AS varchar(10)) END AS longitude,
       CASE WHEN o_orderkey % 8 = 7 THEN 'x' ELSE CAST(o_orderkey % 8 AS varchar(2)) END AS level,
       CAST(o_orderkey % 9 AS varchar(2)) AS radius, o_orderpriority AS source,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS location,
       CAST(o_custkey AS varchar(20)) AS number_of_report
FROM orders
"""

# Place labels with a rank and the profile of the map they are for.
PLACES = """
SELECT c_custkey AS place_id, c_name AS name, CAST(c_custkey % 9 - 1 AS int) AS scalerank,
       CASE c_custkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'regional' ELSE 'theatre' END AS profile
FROM customer
"""

# A user file: text columns under unusual names.
USER_FILE = """
SELECT event_id AS source_order, CAST(ts AS varchar(40)) AS observed_at,
       CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE CAST(CAST(event_id % 160 - 80 AS double) + CAST(0.25 AS double) AS varchar(20)) END AS lat,
       CAST(CAST(event_id % 340 - 170 AS double) + CAST(0.5 AS double) AS varchar(20)) AS lng,
       CASE WHEN event_id % 61 = 0 THEN NULL ELSE concat(CAST(412000000 + user_id AS varchar(20)), '.0') END AS mmsi,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS ship_name,
       CASE WHEN event_id % 5 = 0 THEN 'PORT_RECORD' ELSE NULL END AS source_type
FROM events
"""

# Documents with lines that an audit must find appended to some of them.
AUDIT_TEXTS = """
SELECT doc_id, source, concat(text, chr(10), CASE doc_id % 7
    WHEN 0 THEN concat('password = ', md5(text)) WHEN 1 THEN concat('Authorization: Bearer ', md5(text))
    WHEN 2 THEN concat('see C:', chr(92), 'Users', chr(92), 'someone', chr(92), 'notes.txt and api_key: ', md5(text))
    WHEN 3 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 4 THEN concat('from the Owner-Archive/', source) ELSE 'nothing here' END) AS text
FROM documents
"""

VIEWS = {
    name.lower(): text.strip() for name, text in list(globals().items()) if name.isupper() and isinstance(text, str)
}
