"""Checked queries: cell-table rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from tidewake.operators import grid

# 120 columns of 3 degrees; rows of 0.01 degrees from 85 N down.
FRAME = grid.Affine(-180.0, 85.0, 3.0, 0.01, 120, 16_000)
NODATA = -9999.0
LOG = "CASE WHEN value <> -9999 AND value >= 0 THEN ln(1 + value) ELSE -9999 END"


def cells(t: Inputs):
    return t.view("grid")


@query("src11_grid_cells", """SELECT grid_row, grid_col, value, -180 + (grid_col + 0.5::double) * 3.0::double AS x, 85 - (grid_row + 0.5::double) * 0.01::double AS y FROM grid""", views=("grid",))
def src11(t):
    return cells(t).select(
        "grid_row", "grid_col", "value", (FRAME.left + (F.col("grid_col") + 0.5) * FRAME.px).alias("x"),
        (FRAME.top - (F.col("grid_row") + 0.5) * FRAME.py).alias("y"))


@query("grd1_window_clip", """SELECT grid_row - 30 AS grid_row, grid_col - 93 AS grid_col, value FROM grid
  WHERE grid_row BETWEEN 30 AND 499 AND grid_col BETWEEN 93 AND 112""", views=("grid",))
def grd1(t):
    return grid.clip(cells(t), FRAME, (100.0, 80.0, 160.0, 84.7))[0]


@query("grd2_downsample_average", """SELECT CAST(floor(grid_row / 4.0) AS bigint) AS grid_row, CAST(floor(grid_col / 4.0) AS bigint) AS grid_col,
  round(coalesce(avg(CASE WHEN value <> -9999 THEN value END), -9999), 6) AS value FROM grid GROUP BY 1, 2""", views=("grid",))
def grd2(t):
    return grid.downsample_average(cells(t), 4.0, NODATA).withColumn("value", F.round("value", 6))


@query("grd2_downsample_fractional", """WITH s AS (SELECT grid_row, grid_col, CASE WHEN value <> -9999 AND NOT isnan(value) THEN value END AS v FROM grid),
  r AS (SELECT *, unnest(range(CAST(floor(grid_row / 2.5) AS bigint), CAST(ceil((grid_row + 1) / 2.5) AS bigint))) AS o FROM s),
  c AS (SELECT *, unnest(range(CAST(floor(grid_col / 2.5) AS bigint), CAST(ceil((grid_col + 1) / 2.5) AS bigint))) AS p FROM r),
  w AS (SELECT o, p, v, (least(grid_row + 1.0::double, (o + 1) * 2.5::double) - greatest(grid_row::double, o * 2.5::double))
    * (least(grid_col + 1.0::double, (p + 1) * 2.5::double) - greatest(grid_col::double, p * 2.5::double)) AS w FROM c)
  SELECT o AS grid_row, p AS grid_col, round(coalesce(sum(v * w) / sum(w) FILTER (WHERE v IS NOT NULL), -9999), 6) AS value FROM w GROUP BY 1, 2""", views=("grid",))
def grd2c(t):
    return grid.downsample_average(cells(t), 2.5, NODATA).withColumn("value", F.round("value", 6))


# the frame, or as many rows as the table has, up to a whole number of output rows at 2.5
_BILINEAR = """WITH h AS (SELECT greatest(16000, coalesce(CAST(ceil((max(grid_row) + 1) / 5.0) AS bigint) * 5, 0)) AS height FROM grid),
  r AS (SELECT o, greatest(0.0::double, least(height - 1.0::double, (o + 0.5::double) * 2.5::double - 0.5::double)) AS y
    FROM (SELECT height, unnest(range(0, height * 2 // 5)) AS o FROM h)),
  c AS (SELECT p, greatest(0.0::double, least(119.0::double, (p + 0.5::double) * 2.5::double - 0.5::double)) AS x FROM range(0, 48) t(p)),
  rr AS (SELECT o, unnest([CAST(floor(y) AS bigint), CAST(floor(y) AS bigint) + 1]) AS grid_row, unnest([1 - (y - floor(y)), y - floor(y)]) AS wy FROM r),
  cc AS (SELECT p, unnest([CAST(floor(x) AS bigint), CAST(floor(x) AS bigint) + 1]) AS grid_col, unnest([1 - (x - floor(x)), x - floor(x)]) AS wx FROM c)
  SELECT o AS grid_row, p AS grid_col, {value} AS value
  FROM grid JOIN rr USING (grid_row) JOIN cc USING (grid_col) WHERE wx > 0 AND wy > 0 GROUP BY 1, 2"""


@query("grd2_downsample_bilinear", _BILINEAR.format(value="round(sum(wx * wy * value) / sum(wx * wy), 6)"), views=("grid",))
def grd2b(t):
    return grid.downsample_bilinear(*_framed(t)).withColumn("value", F.round("value", 6))


def _framed(t):
    rows = F.coalesce(F.ceil((F.max("grid_row") + 1) / 5) * 5, F.lit(0))
    height = cells(t).agg(F.greatest(F.lit(FRAME.height), rows).alias("height"))
    return cells(t).crossJoin(height), 2.5, FRAME.width, F.col("height")


@query("grd2_bilinear_nodata", _BILINEAR.format(
    value="round(coalesce(sum(wx * wy * value) FILTER (WHERE value <> -9999) / sum(wx * wy) FILTER (WHERE value <> -9999), -9999), 6)"), views=("grid",))
def grd2d(t):
    return grid.downsample_bilinear(*_framed(t), nodata=NODATA).withColumn("value", F.round("value", 6))


@query("grd3_mosaic_360", """SELECT grid_row, CASE WHEN grid_col >= 110 THEN grid_col - 110 ELSE grid_col + 10 END AS grid_col, value FROM grid
  WHERE grid_row BETWEEN 0 AND 499 AND (grid_col >= 110 OR grid_col < 10)""", views=("grid",))
def grd3(t):
    return grid.clip_360(cells(t), FRAME, (150.0, 80.0, 210.0, 85.0))[0]


@query("grd3_first_valid_wins", """SELECT grid_row, grid_col, CASE WHEN a <> -9999 THEN a WHEN b IS NOT NULL AND b <> -9999 THEN b ELSE coalesce(a, b) END AS value FROM (
  SELECT coalesce(p.grid_row, q.grid_row) AS grid_row, coalesce(p.grid_col, q.grid_col) AS grid_col, p.value AS a, q.value AS b
  FROM grid p FULL JOIN (SELECT grid_row + 2 AS grid_row, grid_col + 5 AS grid_col, value FROM grid) q
  ON p.grid_row = q.grid_row AND p.grid_col = q.grid_col)""", views=("grid",))
def grd3b(t):
    return grid.mosaic([(cells(t), 0, 0), (cells(t), 2, 5)], NODATA)


@query("grd4_log_density", f"SELECT grid_row, grid_col, round({LOG}, 9) AS value FROM grid", views=("grid",))
def grd4(t):
    return grid.log_density(cells(t)).withColumn("value", F.round("value", 9))


@query("grd5_density_subset", """WITH w AS (SELECT grid_row, CASE WHEN grid_col >= 110 THEN grid_col - 110 ELSE grid_col + 10 END AS c, value FROM grid
    WHERE grid_row BETWEEN 0 AND 574 AND (grid_col >= 110 OR grid_col < 10)),
  d AS (SELECT CAST(floor(grid_row / 2.0) AS bigint) AS grid_row, CAST(floor(c / 2.0) AS bigint) AS grid_col,
    coalesce(avg(CASE WHEN value <> -9999 THEN value END), -9999) AS value FROM w GROUP BY 1, 2)
  SELECT grid_row, grid_col, round(CASE WHEN value <> -9999 AND value >= 0 THEN ln(1 + value) ELSE -9999 END, 9) AS value FROM d""", views=("grid",))
def grd5(t):
    sub = grid.density_subset(cells(t), FRAME, (150.0, 80.0, 210.0, 85.0), 0.75, factor=2.0)
    return sub.withColumn("value", F.round("value", 9))


@query("agg6_density_quantiles", """SELECT quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.9) AS q90,
  quantile_cont(value, 0.98) AS q98 FROM grid WHERE value <> -9999""", views=("grid",))
def agg6(t):
    return grid.density_quantiles(cells(t))


@query("grd6_fill_nodata", """WITH o AS (SELECT dr, dc, dr * dr + dc * dc AS d FROM range(-3, 4) a(dr), range(-3, 4) b(dc) WHERE dr * dr + dc * dc BETWEEN 1 AND 9),
  f AS (SELECT h.grid_row, h.grid_col, arg_min(v.value, (o.d, v.grid_row, v.grid_col)) AS fill FROM grid h, o
    JOIN grid v ON v.grid_row = h.grid_row + o.dr AND v.grid_col = h.grid_col + o.dc WHERE h.value = -9999 AND v.value <> -9999 GROUP BY 1, 2)
  SELECT g.grid_row, g.grid_col, CASE WHEN g.value = -9999 THEN coalesce(f.fill, -9999) ELSE g.value END AS value
  FROM grid g LEFT JOIN f USING (grid_row, grid_col)""", views=("grid",))
def grd6(t):
    return grid.fill_nodata(cells(t), NODATA)


_CLASS = """CASE WHEN -value <= -6000 THEN 'trench' WHEN -value <= -4000 THEN 'abyssal' WHEN -value <= -2000 THEN 'deep'
  WHEN -value <= -1000 THEN 'slope' WHEN -value <= -200 THEN 'upper_slope' WHEN -value <= 0 THEN 'shelf' END"""


@query("grd7_depth_classes", f"""SELECT {_CLASS} AS depth_class, count(*) AS cells, min(-value) AS deepest, max(-value) AS shallowest
  FROM grid WHERE value <> -9999 AND -value <= 0 GROUP BY 1""", views=("grid",))
def grd7(t):
    return grid.depth_areas(cells(t).filter(F.col("value") != NODATA).withColumn("value", -F.col("value")))


@query("grd8_depth_contours", """WITH s AS (SELECT a.grid_row, a.grid_col, -a.value AS nw, -b.value AS ne, -c.value AS sw, -d.value AS se, l.level FROM grid a
    JOIN grid b ON b.grid_row = a.grid_row AND b.grid_col = a.grid_col + 1 JOIN grid c ON c.grid_row = a.grid_row + 1 AND c.grid_col = a.grid_col
    JOIN grid d ON d.grid_row = a.grid_row + 1 AND d.grid_col = a.grid_col + 1, (VALUES (-6000.0), (-4000.0), (-2000.0), (-1000.0), (-200.0)) l(level)
    WHERE a.value <> -9999 AND b.value <> -9999 AND c.value <> -9999 AND d.value <> -9999),
  n AS (SELECT *, ((nw >= level) <> (ne >= level))::int + ((ne >= level) <> (se >= level))::int + ((sw >= level) <> (se >= level))::int + ((nw >= level) <> (sw >= level))::int AS cuts,
    CASE WHEN (nw >= level) <> (ne >= level) THEN (level - nw) / (ne - nw) ELSE 0 END + CASE WHEN (sw >= level) <> (se >= level) THEN (level - sw) / (se - sw) ELSE 0 END
    + ((ne >= level) <> (se >= level))::int AS offsets FROM s)
  SELECT level::double AS level, grid_row, grid_col, cuts / 2 AS pieces, round(offsets, 6) AS x_sum FROM n WHERE cuts > 0""".replace("cuts / 2", "CAST(cuts // 2 AS bigint)"), views=("grid",))
def grd8(t):
    depth = cells(t).filter(F.col("value") != NODATA).withColumn("value", -F.col("value"))
    lines = grid.contours(depth, (-200, -1000, -2000, -4000, -6000))
    return lines.groupBy("level", "grid_row", "grid_col").agg(
        F.count("*").alias("pieces"),
        F.round(F.sum(F.col("x1") + F.col("x2") - 2 * F.col("grid_col")), 6).alias("x_sum"))


#: The grid with cells that hold no number.
_HOLED = "SELECT grid_row, grid_col, CASE WHEN (grid_row * 120 + grid_col) % 97 = 0 THEN 'nan'::double ELSE value END AS value FROM grid"


def holed(t: Inputs):
    return cells(t).withColumn("value", F.when((F.col("grid_row") * 120 + F.col("grid_col")) % 97 == 0, float("nan")).otherwise(F.col("value")))


@query("agg6_quantiles_with_nan", f"""SELECT quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.9) AS q90,
  quantile_cont(value, 0.98) AS q98 FROM ({_HOLED}) WHERE value <> -9999 AND NOT isnan(value)""", views=("grid",))
def agg6b(t):
    return grid.density_quantiles(holed(t))


@query("grd8_contour_lines", f"""WITH g AS (SELECT grid_row AS r, grid_col AS c, -value AS v FROM ({_HOLED}) WHERE value <> -9999 AND NOT isnan(value)),
  s AS (SELECT a.r, a.c, a.v AS nw, b.v AS ne, x.v AS sw, y.v AS se, l.level::double AS lv, l.n AS ln FROM g a
    JOIN g b ON b.r = a.r AND b.c = a.c + 1 JOIN g x ON x.r = a.r + 1 AND x.c = a.c JOIN g y ON y.r = a.r + 1 AND y.c = a.c + 1,
    (VALUES (-6000.0, 0), (-4000.0, 1), (-2000.0, 2), (-1000.0, 3), (-200.0, 4)) l(level, n)),
  ends AS (
    SELECT *, 0 AS k, nw >= lv AS leaves, r AS er, c AS ec, 0 AS o, c + (lv - nw) / (ne - nw) AS x, r::double AS y FROM s WHERE (nw >= lv) <> (ne >= lv)
    UNION ALL SELECT *, 1, ne >= lv, r, c + 1, 1, c + 1, r + (lv - ne) / (se - ne) FROM s WHERE (ne >= lv) <> (se >= lv)
    UNION ALL SELECT *, 2, se >= lv, r + 1, c, 0, c + (lv - sw) / (se - sw), r + 1 FROM s WHERE (se >= lv) <> (sw >= lv)
    UNION ALL SELECT *, 3, sw >= lv, r, c, 1, c, r + (lv - nw) / (sw - nw) FROM s WHERE (sw >= lv) <> (nw >= lv)),
  keyed AS (SELECT *, ln * 144115188075855872 + (er + 134217728) * 536870912 + (ec + 134217728) * 2 + o AS edge,
    CASE WHEN count(*) OVER (PARTITION BY r, c, ln) = 2 THEN 0 WHEN ((nw + ne + sw + se) / 4 >= lv) = (nw >= lv) THEN k // 2
      ELSE (k IN (0, 3))::int END AS side FROM ends),
  p AS MATERIALIZED (SELECT a.lv, a.edge::bigint AS s, b.edge::bigint AS e, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
    FROM keyed a JOIN keyed b ON a.r = b.r AND a.c = b.c AND a.ln = b.ln AND a.side = b.side WHERE NOT a.leaves AND b.leaves),
  walk(line, lv, e, pos, x1, y1, x2, y2, closed) AS (
    SELECT s, lv, e, 0, x1, y1, x2, y2, s IN (SELECT e FROM p) FROM p
    UNION ALL SELECT w.line, w.lv, p.e, w.pos + 1, p.x1, p.y1, p.x2, p.y2, w.closed FROM walk w JOIN p ON p.s = w.e WHERE NOT w.closed OR p.s > w.line),
  kept AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY pos DESC) = 1 AS final FROM walk
    WHERE NOT closed OR line IN (SELECT line FROM walk WHERE e = line))
  SELECT lv AS level, line AS line_id, pos::bigint AS position, round(x1, 6) AS x, round(y1, 6) AS y, closed FROM kept
  UNION ALL SELECT lv, line, pos::bigint + 1, round(x2, 6), round(y2, 6), closed FROM kept WHERE final""", views=("grid",), recursive=True)
def grd8b(t):
    depth = holed(t).withColumn("value", F.when(F.col("value") != NODATA, -F.col("value")))
    lines = grid.contour_lines(depth, (-200, -1000, -2000, -4000, -6000))
    return lines.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("grd9_canonical_columns", """SELECT grid_row, CAST((grid_col + 60) % 120 AS bigint) AS grid_col, value FROM grid""", views=("grid",))
def grd9(t):
    return grid.canonical_columns(cells(t), 0.0, 3.0)


@query("grd10_density_ramp", """WITH m AS (SELECT greatest(1.0, max(value)) AS top FROM grid WHERE value <> -9999)
  SELECT grid_row, grid_col, CASE WHEN value <= 0 THEN 'No recorded density' WHEN value <= top * 0.72 THEN 'Lower' WHEN value <= top * 0.82 THEN 'Moderate'
    WHEN value <= top * 0.92 THEN 'Common corridor' ELSE 'Highest' END AS ramp FROM grid, m WHERE value <> -9999""", views=("grid",))
def grd10(t):
    return grid.density_ramp(cells(t)).select("grid_row", "grid_col", "ramp")


@query("grd10_ramp_with_nan", f"""WITH g AS ({_HOLED}), v AS (SELECT * FROM g WHERE value <> -9999 AND NOT isnan(value)), m AS (SELECT greatest(1.0, max(value)) AS top FROM v)
  SELECT grid_row, grid_col, CASE WHEN value <= 0 THEN 'No recorded density' WHEN value <= top * 0.72 THEN 'Lower' WHEN value <= top * 0.82 THEN 'Moderate'
    WHEN value <= top * 0.92 THEN 'Common corridor' ELSE 'Highest' END AS ramp FROM v, m""", views=("grid",))
def grd10b(t):
    return grid.density_ramp(holed(t)).select("grid_row", "grid_col", "ramp")


@query("grd11_invalid_cells", "SELECT count(*) AS cells, count(*) FILTER (WHERE value = -9999) AS invalid_cells FROM grid", views=("grid",))
def grd11(t):
    return grid.invalid_cells(cells(t), NODATA)
