"""Checked queries: filters, longitude, boxes, regions, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.quality import HAVERSINE
from checks.registry import Inputs, query
from tidewake.functions import geo
from tidewake.functions.identity import malformed_identifier
from tidewake.operators import filters, layers, polygons, vectors
from tidewake.operators.audit import forbidden_paths

DAYS = "event_time::date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"


@query("flt1_date_range", f"SELECT source_order FROM observations WHERE {DAYS}", views=("observations",))
def flt1(t: Inputs):
    return t.view("observations").filter(
        filters.date_between(F.col("event_time"), "2024-01-05", "2024-01-20")).select("source_order")


@query("flt2_bbox_180", "SELECT source_order FROM observations WHERE longitude BETWEEN 118.5 AND 120 AND latitude BETWEEN 20.5 AND 23", views=("observations",))
def flt2(t):
    return filters.filter_observations(t.view("observations"), (118.5, 20.5, 120.0, 23.0)).select("source_order")


@query("flt2_bbox_360", """SELECT feature_id, seq FROM vertices WHERE (CASE WHEN x < 0 THEN x + 360 ELSE x END) BETWEEN 175 AND 190.5 AND y BETWEEN -20 AND 20""", views=("vertices",))
def flt2b(t):
    v = t.view("vertices")
    return v.filter(filters.in_bbox(F.col("x"), F.col("y"), (175.0, -20.0, 190.5, 20.0), "360")).select("feature_id", "seq")


@query("flt3_actor_filter", f"""SELECT source_order FROM observations WHERE actor_type IN ('RESEARCH_SURVEY','CCG')
 AND {DAYS} AND longitude BETWEEN 0 AND 360 AND latitude BETWEEN -90 AND 90""", views=("observations",))
def flt3(t):
    return filters.filter_observations(
        t.view("observations"), (0.0, -90.0, 360.0, 90.0), start="2024-01-05", end="2024-01-20",
        actors=["Survey", "coast guard"], default_actors=["PLAN"]).select("source_order")


@query("flt4_event_bbox", """SELECT event_id FROM (SELECT event_id, TRY_CAST(longitude AS double) AS lon, TRY_CAST(latitude AS double) AS lat FROM event_release)
 WHERE (CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) BETWEEN 100 AND 200 AND lat BETWEEN 5 AND 45""", views=("event_release",))
def flt4(t):
    from tidewake.sources.events import geocoded_events

    return filters.filter_events(geocoded_events(t.view("event_release")), (100.0, 5.0, 200.0, 45.0), "360").select("event_id")


_IDS = """ids AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN concat('IMO', lpad(CAST(c_custkey AS varchar(20)), 7, '0'))
  WHEN 3 THEN lpad(CAST(c_custkey AS varchar(20)), 9, '0') WHEN 4 THEN CAST(c_custkey AS varchar(20)) ELSE lpad(CAST(c_custkey AS varchar(20)), 7, '1') END AS code FROM customer)"""


@query("flt5_malformed_identifier", f"""WITH {_IDS} SELECT c_custkey, code,
  code NOT IN ('', 'nan') AND NOT regexp_full_match(code, '[0-9]{{9}}') AS bad_mmsi,
  code NOT IN ('', 'nan') AND NOT regexp_full_match(code, '(IMO)?[0-9]{{7}}') AS bad_imo FROM ids""")
def flt5(t):
    t.table("customer").createOrReplaceTempView("customer")
    ids = t.spark.sql(f"WITH {_IDS} SELECT * FROM ids")
    return ids.select("c_custkey", "code", malformed_identifier("MMSI", F.col("code")).alias("bad_mmsi"),
                      malformed_identifier("IMO", F.col("code")).alias("bad_imo"))


@query("flt6_extent_validation", """SELECT region, CASE WHEN NOT (xmin >= -180 AND xmin < xmax AND xmax <= 180) THEN 'LONGITUDE,' ELSE '' END
  || CASE WHEN NOT (ymin >= -90 AND ymin < ymax AND ymax <= 90) THEN 'LATITUDE,' ELSE '' END
  || CASE WHEN xmax - xmin > 300 THEN 'TOO_WIDE,' ELSE '' END AS problems FROM boxes""", views=("boxes",))
def flt6(t):
    b = t.view("boxes").withColumnsRenamed({"xmin": "west", "ymin": "south", "xmax": "east", "ymax": "north"})
    joined = F.array_join(F.transform("problems", lambda p: F.concat(p, F.lit(","))), "")
    return filters.extent_problems(b).select("region", joined.alias("problems"))


@query("flt8_label_rank", """SELECT place_id, name FROM places
  WHERE scalerank <= CASE profile WHEN 'local' THEN 4 WHEN 'regional' THEN 1 ELSE -1 END""", views=("places",))
def flt8(t):
    return layers.ranked_labels(t.view("places"), F.col("profile")).select("place_id", "name")


_PATHS = """paths AS (SELECT doc_id, concat(CASE doc_id % 6 WHEN 0 THEN '.local/' WHEN 1 THEN 'data/raw/' WHEN 2 THEN 'docs/' WHEN 3 THEN '.tmp/'
  WHEN 4 THEN 'data/derived/' ELSE 'src/data/raw/' END, source, CASE WHEN doc_id % 5 = 0 THEN '/.gitkeep' ELSE '/file.txt' END) AS path FROM documents)"""


@query("flt10_forbidden_paths", f"""WITH {_PATHS} SELECT doc_id, path FROM paths WHERE regexp_matches(path, '^(\\.local/|\\.tmp/|data/raw/|data/derived/)')
  AND path NOT LIKE '%/.gitkeep'""")
def flt10(t):
    t.table("documents").createOrReplaceTempView("documents")
    return forbidden_paths(t.spark.sql(f"WITH {_PATHS} SELECT * FROM paths"))


@query("jn11_region_assignment", """SELECT o.source_order, r.region FROM observations o JOIN study_regions r
  ON o.latitude BETWEEN r.ymin AND r.ymax AND o.longitude BETWEEN r.xmin AND r.xmax""", views=("observations", "study_regions"))
def jn11(t):
    return filters.assign_regions(
        t.view("observations").select("source_order", "longitude", "latitude"), t.view("study_regions"), 1.0
    ).select("source_order", "region")


# --- longitude and boxes ------------------------------------------------------------------------


@query("geo1_geodesic_distance", f"""SELECT feature_id, seq, round({HAVERSINE.format(lon1='px', lat1='py', lon2='x', lat2='y')}, 4) AS metres
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM vertices WINDOW w AS (PARTITION BY feature_id ORDER BY seq)) WHERE px IS NOT NULL""", views=("vertices",))
def geo1(t):
    e = vectors.edges(t.view("vertices"))
    d = geo.haversine_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return e.select("feature_id", "seq", F.round(d, 4).alias("metres"))


@query("geo2_longitude_conventions", """SELECT c_custkey, lon, lon - 360 * floor(lon / 360) AS lon360,
  CASE WHEN (lon + 180) - 360 * floor((lon + 180) / 360) - 180 = -180 AND lon > 0 THEN 180.0
       ELSE (lon + 180) - 360 * floor((lon + 180) / 360) - 180 END AS lon180
  FROM (SELECT c_custkey, CAST(c_custkey * 45 % 1080 - 540 AS double) AS lon FROM customer)""")
def geo2(t):
    c = t.table("customer").select("c_custkey", (F.col("c_custkey") * 45 % 1080 - 540).cast("double").alias("lon"))
    return c.select("c_custkey", "lon", geo.lon_to_360(F.col("lon")).alias("lon360"), geo.lon_to_180(F.col("lon")).alias("lon180"))


@query("geo3_transform_longitudes", "SELECT feature_id, seq, CASE WHEN x < 0 THEN x + 360 ELSE x END AS x, y FROM vertices", views=("vertices",))
def geo3(t):
    lines = t.view("vertices").groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("path"))
    pts = lines.withColumn("path", F.transform("path", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    moved = vectors.transform_longitudes(pts, "path", "360")
    return moved.select("feature_id", F.posexplode("path").alias("seq", "p")).select(
        "feature_id", F.col("seq").cast("long").alias("seq"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("geo4_bbox_parts", """SELECT region, part, px0 AS xmin, px1 AS xmax, ymin, ymax FROM (
  SELECT *, 0 AS part, CASE WHEN xmax > 180 AND xmin >= 180 THEN xmin - 360 ELSE xmin END AS px0,
         CASE WHEN xmax <= 180 THEN xmax WHEN xmin >= 180 THEN xmax - 360 ELSE 180.0 END AS px1
  FROM boxes WHERE xmin >= 0 AND xmax <= 360 AND xmin < xmax
  UNION ALL SELECT *, 1, -180.0, xmax - 360 FROM boxes WHERE xmin >= 0 AND xmax <= 360 AND xmin < 180 AND xmax > 180)""", views=("boxes",))
def geo4(t):
    return filters.split_bbox_360(t.view("boxes")).select("region", "part", "xmin", "xmax", "ymin", "ymax")


@query("geo5_shift_bounds", """SELECT region, xmin - 360 * floor(xmin / 360) AS xmin, ymin, xmax - 360 * floor(xmax / 360) AS xmax, ymax FROM boxes""", views=("boxes",))
def geo5(t):
    return filters.shift_bounds_360(t.view("boxes")).select("region", "xmin", "ymin", "xmax", "ymax")


@query("geo5b_western_request", """SELECT region, CASE WHEN convention = '360' AND xmax > 180 THEN greatest(-180.0, xmin - 360) ELSE xmin END AS xmin,
  CASE WHEN convention = '360' AND xmax > 180 THEN xmax - 360 ELSE xmax END AS xmax FROM boxes""", views=("boxes",))
def geo5b(t):
    return filters.western_request(t.view("boxes")).select("region", "xmin", "xmax")


@query("geo10_buffered_bbox", """SELECT region,
  CASE WHEN world THEN 0.0 ELSE greatest(lo, xmin - dx) END AS bxmin, CASE WHEN world THEN -89.0 ELSE greatest(-89.0, ymin - dy) END AS bymin,
  CASE WHEN world THEN 360.0 ELSE least(hi, xmax + dx) END AS bxmax, CASE WHEN world THEN 89.0 ELSE least(89.0, ymax + dy) END AS bymax
  FROM (SELECT *, CASE WHEN convention = '360' THEN 0.0 ELSE -180.0 END AS lo, CASE WHEN convention = '360' THEN 360.0 ELSE 180.0 END AS hi,
    convention = '360' AND xmax - xmin >= 180 AS world,
    CASE WHEN convention = '360' AND profile = 'regional' AND ymin >= 60 THEN 44.0
         ELSE greatest((xmax - xmin) * f, m) END AS dx, greatest((ymax - ymin) * f, m) AS dy
    FROM (SELECT *, CASE profile WHEN 'local' THEN 0.22 WHEN 'regional' THEN 0.30 WHEN 'theatre' THEN 0.15 ELSE 0.18 END::double AS f,
                 CASE profile WHEN 'local' THEN 1.5 WHEN 'regional' THEN 3.0 WHEN 'theatre' THEN 8.0 ELSE 3.0 END::double AS m FROM boxes))""", views=("boxes",))
def geo10(t):
    return filters.buffered_bbox(t.view("boxes")).select("region", "bxmin", "bymin", "bxmax", "bymax")


# --- lines and polygons -------------------------------------------------------------------------


@query("geo6_clip_lines", """WITH e AS (SELECT feature_id, seq, lag(x360) OVER w AS x1, lag(y) OVER w AS y1, x360 AS x2, y AS y2
    FROM vertices WINDOW w AS (PARTITION BY feature_id ORDER BY seq)),
  s AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM e WHERE x1 IS NOT NULL),
  r AS (SELECT *, greatest(0.0, CASE WHEN dx = 0 THEN CASE WHEN x1 BETWEEN 172 AND 196.5 THEN 0.0 ELSE 2.0 END ELSE least((172 - x1) / dx, (196.5 - x1) / dx) END,
                            CASE WHEN dy = 0 THEN CASE WHEN y1 BETWEEN -20.1 AND 25.1 THEN 0.0 ELSE 2.0 END ELSE least((-20.1 - y1) / dy, (25.1 - y1) / dy) END) AS t0,
               least(1.0, CASE WHEN dx = 0 THEN 1.0 ELSE greatest((172 - x1) / dx, (196.5 - x1) / dx) END,
                          CASE WHEN dy = 0 THEN 1.0 ELSE greatest((-20.1 - y1) / dy, (25.1 - y1) / dy) END) AS t1 FROM s)
  SELECT feature_id, count(*) AS edges, round(sum((t1 - t0) * sqrt(dx * dx + dy * dy)), 6) AS length FROM r WHERE t0 < t1 GROUP BY feature_id""", views=("vertices",))
def geo6(t):
    lines = t.view("vertices").select("feature_id", "seq", F.col("x360").alias("x"), "y")
    pieces = vectors.clip_lines(lines, (172.0, -20.1, 196.5, 25.1))
    # vertices of a part, renumbered so that consecutive ones form the clipped edges
    renumbered = pieces.select(
        F.struct("feature_id", "box", "part").alias("feature_id"), (F.col("seq") * 2 + F.col("sub")).alias("seq"), "x", "y")
    e = vectors.edges(renumbered)
    return e.groupBy(F.col("feature_id.feature_id").alias("feature_id")).agg(
        F.count("*").alias("edges"),
        F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 6).alias("length"))


@query("geo6_clip_lines_360", """WITH e AS (SELECT feature_id, seq, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2
    FROM vertices WINDOW w AS (PARTITION BY feature_id ORDER BY seq)),
  b(box, shift, xa, xb) AS (VALUES (0, 0.0::double, 170.0::double, 180.0::double), (1, 360.0::double, -180.0::double, -160.0::double)),
  d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM e, b WHERE x1 IS NOT NULL),
  r AS (SELECT *, greatest(0.0::double, CASE WHEN dx > 0 THEN (x1 - xa) / -dx WHEN dx < 0 THEN (xb - x1) / dx ELSE 0 END,
      CASE WHEN dy > 0 THEN (y1 + 30.0::double) / -dy WHEN dy < 0 THEN (35.0::double - y1) / dy ELSE 0 END) AS t0,
    least(1.0::double, CASE WHEN dx < 0 THEN (x1 - xa) / -dx WHEN dx > 0 THEN (xb - x1) / dx ELSE 1 END,
      CASE WHEN dy < 0 THEN (y1 + 30.0::double) / -dy WHEN dy > 0 THEN (35.0::double - y1) / dy ELSE 1 END) AS t1 FROM d
    WHERE NOT (dx = 0 AND (x1 < xa OR x1 > xb)) AND NOT (dy = 0 AND (y1 < -30 OR y1 > 35))),
  k AS (SELECT *, NOT coalesce(t0 = 0 AND lag(seq) OVER w = seq - 1 AND lag(t1) OVER w = 1, false) AS opens FROM r WHERE t0 < t1
    WINDOW w AS (PARTITION BY feature_id, box ORDER BY seq)),
  p AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY feature_id, box ORDER BY seq) AS bigint) AS part FROM k)
  SELECT feature_id, box, part, seq, 0 AS sub, round(x1 + t0 * dx + shift, 9) AS x, round(y1 + t0 * dy, 9) AS y FROM p WHERE opens
  UNION ALL SELECT feature_id, box, part, seq, 1, round(x1 + t1 * dx + shift, 9), round(y1 + t1 * dy, 9) FROM p""", views=("vertices",))
def geo6b(t):
    cut = vectors.clip_lines(t.view("vertices"), (170.0, -30.0, 200.0, 35.0), "360")
    return cut.withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})


_SQUARES = """squares AS (SELECT c_custkey AS feature_id, CAST(c_custkey % 60 AS double) AS x0, CAST(c_custkey % 37 AS double) AS y0,
  CAST(1 + c_custkey % 9 AS double) AS w, CAST(1 + c_custkey % 5 AS double) AS h FROM customer)"""


def _squares(t):
    t.table("customer").createOrReplaceTempView("customer")
    s = t.spark.sql(f"WITH {_SQUARES} SELECT * FROM squares")

    def p(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    return s.select("feature_id", F.lit(0).alias("ring_no"), F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1)).alias("ring"))


_CUT = "(least(x0 + w, 40.5) - greatest(x0, 10.25)) * (least(y0 + h, 30.0) - greatest(y0, 5.5))"


@query("geo6_clip_polygons", f"""WITH {_SQUARES} SELECT feature_id, round({_CUT}, 6) AS area FROM squares
  WHERE x0 + w > 10.25 AND x0 < 40.5 AND y0 + h > 5.5 AND y0 < 30.0""")
def geo6c(t):
    cut = vectors.clip_polygons(_squares(t), (10.25, 5.5, 40.5, 30.0))
    return cut.select("feature_id", F.round(vectors.ring_area(F.col("ring")), 6).alias("area"))


# a U of three unit-wide bars, open to the east: a box over its arms cuts two parts of it
@query("geo6_clip_concave", """WITH u AS (SELECT c_custkey AS feature_id, CAST(c_custkey % 60 AS double) AS x0, CAST(c_custkey % 37 AS double) AS y0 FROM customer),
  arms AS (SELECT *, unnest([0.0::double, 2.0::double]) AS dy FROM u),
  cut AS (SELECT feature_id, x0, y0, greatest(x0 + 1, 10.25) AS xa, least(x0 + 4, 40.5) AS xb, greatest(y0 + dy, 5.5) AS ya, least(y0 + dy + 1, 30.0) AS yb FROM arms),
  spine AS (SELECT feature_id, greatest(x0, 10.25) AS xa, least(x0 + 1, 40.5) AS xb, greatest(y0, 5.5) AS ya, least(y0 + 3, 30.0) AS yb FROM u),
  pieces AS (SELECT feature_id, xa, xb, ya, yb, false AS spine FROM cut WHERE xa < xb AND ya < yb UNION ALL SELECT *, true FROM spine WHERE xa < xb AND ya < yb)
  SELECT feature_id, CASE WHEN bool_or(spine) THEN 1 ELSE count(*) END AS parts, round(sum((xb - xa) * (yb - ya)), 6) AS area FROM pieces GROUP BY feature_id""")
def geo6d(t):
    c = t.table("customer").select("c_custkey", (F.col("c_custkey") % 60).cast("double").alias("x0"), (F.col("c_custkey") % 37).cast("double").alias("y0"))
    corners = ((0, 0), (4, 0), (4, 1), (1, 1), (1, 2), (4, 2), (4, 3), (0, 3))
    ring = F.array(*[F.struct((F.col("x0") + x).alias("x"), (F.col("y0") + y).alias("y")) for x, y in corners])
    cut = vectors.clip_polygons(c.select(F.col("c_custkey").alias("feature_id"), F.lit(0).alias("ring_no"), ring.alias("ring")), (10.25, 5.5, 40.5, 30.0))
    return cut.groupBy("feature_id").agg(F.count("*").alias("parts"), F.round(F.sum(vectors.ring_area(F.col("ring"))), 6).alias("area"))


# the U with a hole in its lower arm, one across its spine's western half and one that the box's sides may cut
_HOLES = ((2.25, 0.25, 0.5, 0.5), (0.25, 0.5, 0.25, 2.0), (3.0, 2.125, 0.75, 0.75))


@query("geo6_clip_holes", """WITH u AS (SELECT c_custkey AS feature_id, CAST(c_custkey % 60 AS double) AS x0, CAST(c_custkey % 37 AS double) AS y0 FROM customer),
  bars AS (SELECT feature_id, 0 AS hole, x0 + dx AS xa, y0 + dy AS ya, x0 + dx + w AS xb, y0 + dy + h AS yb FROM u, (VALUES (0.0::double, 0.0::double, 1.0::double, 3.0::double),
    (1.0, 0.0, 3.0, 1.0), (1.0, 2.0, 3.0, 1.0)) b(dx, dy, w, h)),
  gaps AS (SELECT feature_id, 1, x0 + dx, y0 + dy, x0 + dx + w, y0 + dy + h FROM u, (VALUES (2.25::double, 0.25::double, 0.5::double, 0.5::double),
    (0.25, 0.5, 0.25, 2.0), (3.0, 2.125, 0.75, 0.75)) g(dx, dy, w, h)),
  every AS (SELECT * FROM bars UNION ALL SELECT * FROM gaps),
  cut AS (SELECT feature_id, hole, greatest(xa, 10.25) AS xl, least(xb, 40.5) AS xr, greatest(ya, 5.5) AS yl, least(yb, 30.0) AS yr,
    xa >= 10.25 AND xb <= 40.5 AND ya >= 5.5 AND yb <= 30.0 AS whole FROM every)
  SELECT feature_id, count(*) FILTER (WHERE hole = 1 AND whole) AS holes,
    round(sum((xr - xl) * (yr - yl) * (1 - 2 * hole)), 6) AS area FROM cut WHERE xl < xr AND yl < yr GROUP BY feature_id""")
def geo6e(t):
    c = t.table("customer").select("c_custkey", (F.col("c_custkey") % 60).cast("double").alias("x0"), (F.col("c_custkey") % 37).cast("double").alias("y0"))
    corners = ((0, 0), (4, 0), (4, 1), (1, 1), (1, 2), (4, 2), (4, 3), (0, 3))

    def ring(points):
        return F.array(*[F.struct((F.col("x0") + x).alias("x"), (F.col("y0") + y).alias("y")) for x, y in points])

    rings = [ring(corners), *[ring(((x, y), (x + w, y), (x + w, y + h), (x, y + h))) for x, y, w, h in _HOLES]]
    table = c.select(F.col("c_custkey").alias("feature_id"), F.lit(0).alias("polygon_no"), F.posexplode(F.array(*rings)).alias("ring_no", "ring"))
    parts = polygons.polygon_areas(polygons.clip_with_holes(table, (10.25, 5.5, 40.5, 30.0)))
    return parts.groupBy("feature_id").agg(F.sum("holes").alias("holes"), F.round(F.sum("area"), 6).alias("area"))


@query("src10_zone_layer", f"""WITH {_SQUARES} SELECT feature_id, round({_CUT}, 6) AS area, 'zones_v1' AS source_id, 'eez_reference' AS boundary_type,
  'provider_reference' AS legal_status FROM squares WHERE x0 + w > 10.25 AND x0 < 40.5 AND y0 + h > 5.5 AND y0 < 30.0""")
def src10(t):
    z = vectors.zone_layer(_squares(t), (10.25, 5.5, 40.5, 30.0), "zones_v1", "eez_reference")
    return z.select("feature_id", F.round(vectors.ring_area(F.col("ring")), 6).alias("area"), "source_id",
                    "boundary_type", "legal_status")


@query("geo7_coastline", f"""WITH {_SQUARES}, c AS (SELECT feature_id, unnest([0, 1, 2, 3, 4]) AS seq, x0, y0, w, h FROM squares)
  SELECT feature_id, seq, CASE WHEN seq IN (1, 2) THEN x0 + w ELSE x0 END AS x, CASE WHEN seq IN (2, 3) THEN y0 + h ELSE y0 END AS y FROM c""")
def geo7(t):
    return vectors.coastline(_squares(t)).select("feature_id", "seq", "x", "y")


@query("geo8_antimeridian_split", """WITH l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM vertices WINDOW w AS (PARTITION BY feature_id ORDER BY seq)),
  c AS (SELECT *, coalesce(abs(x - px) > 180, false) AS crossed, sum(CASE WHEN abs(x - px) > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY feature_id ORDER BY seq) AS part FROM l),
  m AS (SELECT *, degrees(atan((tan(radians(py)) * sin(radians(x)) - tan(radians(y)) * sin(radians(px))) / sin(radians(px - x)))) AS lat FROM c)
  SELECT feature_id, CAST(part AS bigint) AS part, seq, 0 AS sub, x, round(y, 7) AS y FROM m
  UNION ALL SELECT feature_id, CAST(part AS bigint) - 1, seq, -2, CASE WHEN px >= 0 THEN 180.0 ELSE -180.0 END, round(lat, 7) FROM m WHERE crossed
  UNION ALL SELECT feature_id, CAST(part AS bigint), seq, -1, CASE WHEN px >= 0 THEN -180.0 ELSE 180.0 END, round(lat, 7) FROM m WHERE crossed""", views=("vertices",))
def geo8(t):
    s = vectors.antimeridian_split(t.view("vertices"))
    return s.withColumn("y", F.round("y", 7)).select("feature_id", "part", "seq", "sub", "x", "y")


@query("geo9_canonicalize_360", """SELECT feature_id, seq, CASE WHEN x360 > 180 OR (min(x360) OVER (PARTITION BY feature_id) >= 180 - 1e-9 AND x360 >= 180)
  THEN x360 - 360 ELSE x360 END AS x, y FROM vertices""", views=("vertices",))
def geo9(t):
    lines = t.view("vertices").select("feature_id", "seq", F.col("x360").alias("x"), "y")
    return vectors.canonicalize_360(lines).select("feature_id", "seq", "x", "y")


@query("geo11_baseline_sampling", """WITH e AS (SELECT feature_id, sqrt(pow(x360 - lag(x360) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS len
    FROM vertices WINDOW w AS (PARTITION BY feature_id ORDER BY seq)),
  n AS (SELECT feature_id, CAST(greatest(2, ceil(sum(len) / 2.5) + 1) AS bigint) AS samples FROM e GROUP BY feature_id HAVING sum(len) > 0)
  SELECT n.feature_id, n.samples, v.x AS x_first, v.y AS y_first, z.x AS x_last, z.y AS y_last FROM n
  JOIN (SELECT feature_id, arg_min(x360, seq) AS x, arg_min(y, seq) AS y FROM vertices GROUP BY 1) v USING (feature_id)
  JOIN (SELECT feature_id, arg_max(x360, seq) AS x, arg_max(y, seq) AS y FROM vertices GROUP BY 1) z USING (feature_id)""", views=("vertices",))
def geo11(t):
    lines = t.view("vertices").select("feature_id", "seq", F.col("x360").alias("x"), "y")
    s = vectors.sample_lines(lines, 2.5)
    return s.groupBy("feature_id").agg(
        F.count("*").alias("samples"),
        *[f(c, "n").alias(f"{c}_{w}") for w, f in (("first", F.min_by), ("last", F.max_by)) for c in ("x", "y")]
    ).withColumns({c: F.round(c, 9) for c in ("x_first", "y_first", "x_last", "y_last")})


def _baselines(t):
    c = t.table("customer")
    # gentle enough that no sample has two nearest points
    wiggle = F.sin(F.col("c_custkey") / 400.0) * 0.02
    seq, y = F.col("c_custkey").alias("seq"), (20.0 + F.col("c_custkey") * 0.0004).alias("y")
    a = c.select(F.lit(1).cast("long").alias("feature_id"), seq, (120.0 + wiggle).alias("x"), y)
    b = c.select(F.lit(2).cast("long").alias("feature_id"), seq, (122.0 - wiggle).alias("x"), y)
    return a, b


_PLANE = """SELECT feature_id, seq, 6371008.8 * atanh(cos(radians(y)) * sin(radians(x - 121.0::double))) AS x,
  6371008.8 * (atan2(tan(radians(y)), cos(radians(x - 121.0::double))) - radians(21.0::double)) AS y FROM """


def _side(name: str, number: int, sign: str) -> str:
    """Edges and samples of one baseline in the plane."""
    return f"""
  v{name} AS (SELECT {number}::bigint AS feature_id, c_custkey AS seq, {120 if number == 1 else 122}.0::double {sign} sin(c_custkey / 400.0::double) * 0.02::double AS x,
    20.0::double + c_custkey * 0.0004::double AS y FROM customer),
  p{name} AS ({_PLANE} v{name}),
  e{name} AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM (SELECT feature_id, seq, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2
    FROM p{name} WINDOW w AS (PARTITION BY feature_id ORDER BY seq)) WHERE x1 IS NOT NULL),
  u{name} AS (SELECT *, sum(len) OVER (ORDER BY seq) AS upto, sum(len) OVER () AS total, max(seq) OVER () AS last FROM e{name} WHERE len > 0),
  s{name} AS (SELECT '{name}:' || feature_id || ':' || lpad(n::varchar, 12, '0') AS sid, x1 + least(1.0, (n * step - upto + len) / len) * (x2 - x1) AS x,
    y1 + least(1.0, (n * step - upto + len) / len) * (y2 - y1) AS y FROM (
      SELECT *, unnest(range(ceil((upto - len) / step)::bigint, CASE WHEN seq = last THEN count ELSE ceil(upto / step)::bigint END)) AS n FROM (
        SELECT *, total / (count - 1) AS step FROM (SELECT *, greatest(2, ceil(total / 5000.0) + 1)::bigint AS count FROM u{name}))))"""


def _foot_sql(points: str, edges: str) -> str:
    """Every point with its nearest point on the edges: brute force."""
    return f"""SELECT sid, x, y, arg_min(fx, d) AS nx, arg_min(fy, d) AS ny, min(d) AS nd FROM (
    SELECT *, sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) AS d FROM (SELECT *, x1 + t * (x2 - x1) AS fx, y1 + t * (y2 - y1) AS fy FROM (
      SELECT q.*, x1, y1, x2, y2, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (len * len))) AS t FROM {points} q, {edges} WHERE len > 0)))
    GROUP BY sid, x, y"""


@query("geo12_equidistance", f"""WITH {_side("a", 1, "+").strip()}, {_side("b", 2, "-").strip()},
  mid AS (SELECT sid, (x + nx) / 2 AS x, (y + ny) / 2 AS y FROM ({_foot_sql("sa", "eb")}) UNION ALL SELECT sid, (x + nx) / 2, (y + ny) / 2 FROM ({_foot_sql("sb", "ea")})),
  near AS (SELECT a.sid, a.x, a.y FROM ({_foot_sql("mid", "ea")}) a JOIN ({_foot_sql("mid", "eb")}) b USING (sid) WHERE abs(a.nd - b.nd) <= 750.0),
  one AS (SELECT arg_max(x, sid) AS x, arg_max(y, sid) AS y FROM near GROUP BY round_even(x, 3), round_even(y, 3)),
  m AS (SELECT avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS g FROM one),
  o AS (SELECT mx, my, CASE WHEN g < -pi() / 4 THEN g + pi() ELSE g END AS g FROM m),
  l AS (SELECT x, y, (x - mx) * cos(g) + (y - my) * sin(g) AS along, y / 6371008.8 + radians(21.0) AS d, x / 6371008.8 AS e FROM one, o)
  SELECT 'computed-median-1' AS feature_id, round(along, 3) AS along, round(degrees(atan2(sinh(e), cos(d))) + 121.0, 9) AS x, round(degrees(asin(sin(d) / cosh(e))), 9) AS y,
    'computed_median_equidistance_reference' AS boundary_type, 'COMPUTED_REFERENCE' AS legal_status, 'MUTUAL_NEAREST_BASELINE_MIDPOINT_REFERENCE' AS method,
    'a' AS baseline_a, 'b' AS baseline_b, 5000.0::double AS sample_spacing_m, 750.0::double AS balance_tolerance_m FROM l""")
def geo12(t):
    a, b = _baselines(t)
    line = vectors.equidistance_points(a, b, 121.0, 21.0)
    return line.withColumns({"along": F.round("along", 3), "x": F.round("x", 9), "y": F.round("y", 9)})


@query("ord2_principal_axis", """WITH m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM p),
  a AS (SELECT mx, my, 0.5 * atan2(2 * xy, xx - yy) AS g FROM m)
  SELECT id, round((x - mx) * cos(g) + (y - my) * sin(g), 6) AS along FROM p, a""".replace(
    "WITH m", "WITH p AS (SELECT c_custkey AS id, CAST(c_custkey % 97 AS double) AS x, CAST(c_custkey % 97 AS double) * 0.5 + CAST(c_custkey % 13 AS double) AS y FROM customer), m"))
def ord2(t):
    k = F.col("c_custkey")
    p = t.table("customer").select(
        k.alias("id"), (k % 97).cast("double").alias("x"), ((k % 97).cast("double") * 0.5 + (k % 13).cast("double")).alias("y"))
    return vectors.principal_order(p).select("id", F.round("along", 6).alias("along"))


@query("set3_distinct_rounded", """SELECT round_even(x, 3) AS rx, round_even(y, 3) AS ry, arg_max(x, id) AS x, arg_max(y, id) AS y FROM (
  SELECT c_custkey AS id, CAST(c_custkey % 31 AS double) + CAST(c_custkey % 7 AS double) * 0.00001 AS x, CAST(c_custkey % 17 AS double) AS y FROM customer) GROUP BY 1, 2""")
def set3(t):
    k = F.col("c_custkey")
    p = t.table("customer").select(
        k.alias("id"), ((k % 31).cast("double") + (k % 7).cast("double") * 0.00001).alias("x"), (k % 17).cast("double").alias("y"))
    return vectors.distinct_rounded(p, "id")

