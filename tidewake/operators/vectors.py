"""Lines and polygons as tables of vertices and arrays of rings.

Lines are long tables ``(feature_id, seq, x, y)``: one feature may have any number of
vertices. Polygons are one row per ring, ``ring array<struct<x,y>>``, without the closing
vertex repeated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.geo import SPHERE_RADIUS_M, bind, lon_to_180, lon_to_360
from tidewake.plans.ordered import order_slice, previous_and_count, previous_value, running_sum
from tidewake.session import stage

POINT = "struct<x:double,y:double>"


def transform_longitudes(df: DataFrame, column: str, convention: str) -> DataFrame:
    """Apply a longitude convention to every vertex of an array column."""
    if convention not in ("180", "360"):
        raise ValueError("convention must be '180' or '360'")
    fold = lon_to_180 if convention == "180" else lon_to_360
    return df.withColumn(
        column, F.transform(column, lambda p: F.struct(fold(p["x"]).alias("x"), p["y"].alias("y")))
    )


VERTEX_SLICE = 1 << 16


def _sliced(df: DataFrame) -> DataFrame:
    return df.withColumn("slice", order_slice(F.col("seq"), VERTEX_SLICE))


def edges(vertices: DataFrame) -> DataFrame:
    """Consecutive vertex pairs of each line: (feature_id, seq, x1, y1, x2, y2); ``seq`` is
    the one of the edge's end."""
    v = previous_value(_sliced(vertices), ["feature_id"], "slice", "seq", F.struct("x", "y"), "p")
    return v.filter(F.col("p").isNotNull()).select(
        "feature_id", "seq", "slice", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"),
        F.col("x").alias("x2"), F.col("y").alias("y2"),
    )


def canonicalize_360(vertices: DataFrame) -> DataFrame:
    """0..360 display vectors back to −180..180: x > 180 moves west; a feature that lies
    entirely at or beyond the seam also moves its vertices exactly on 180."""
    lowest = vertices.groupBy("feature_id").agg(F.min("x").alias("lowest"))
    shift = (F.col("x") > 180.0) | ((F.col("lowest") >= 180.0 - 1e-9) & (F.col("x") >= 180.0))
    return (
        vertices.join(lowest, "feature_id")
        .withColumn("x", F.when(shift, F.col("x") - 360.0).otherwise(F.col("x")))
        .drop("lowest")
    )


def coastline(polygons: DataFrame) -> DataFrame:
    """Rings of land polygons as closed lines in vertex form."""
    closed = F.concat(F.col("ring"), F.slice("ring", 1, 1))
    return (
        polygons.filter(F.size("ring") > 0)
        .select("feature_id", "ring_no", F.posexplode(closed).alias("seq", "p"))
        .select("feature_id", "ring_no", "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    )


def antimeridian_split(vertices: DataFrame) -> DataFrame:
    """Split lines where an edge crosses ±180, at the great-circle crossing latitude.

    Output: (feature_id, part, seq, sub, x, y); ``part`` counts crossings before the vertex.
    """
    def crosses(prev: Column, cur: Column) -> Column:
        return F.coalesce(F.abs(cur["x"] - prev["x"]) > 180.0, F.lit(False))

    point = F.struct("x", "y")
    v = previous_and_count(
        _sliced(vertices), ["feature_id"], "slice", "seq", point, crosses, "p", "part")
    v = v.select("*", F.col("p.x").alias("px"), F.col("p.y").alias("py"), crosses(F.col("p"), point).alias("cross"))
    lat = crossing_latitude(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    side = F.when(F.col("px") >= 0, F.lit(180.0)).otherwise(F.lit(-180.0))

    def vertex(part: Column, sub: int, x: Column, y: Column) -> Column:
        return F.struct(part.alias("part"), F.lit(sub).alias("sub"), x.alias("x"), y.alias("y"))

    here = vertex(F.col("part"), 0, F.col("x"), F.col("y"))
    seam = F.array(
        vertex(F.col("part") - 1, -2, side, lat), vertex(F.col("part"), -1, -side, lat), here
    )
    return v.select(
        "feature_id", "seq", F.explode(F.when(F.col("cross"), seam).otherwise(F.array(here))).alias("v")
    ).select("feature_id", "v.part", "seq", "v.sub", "v.x", "v.y")


def crossing_latitude(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Latitude where the great circle through two points meets the 180° meridian.

    Closed form: a great circle satisfies tan(lat) = A·sin(lon) + B·cos(lon).
    """
    a1, a2 = F.radians(lon1), F.radians(lon2)
    t1, t2 = F.tan(F.radians(lat1)), F.tan(F.radians(lat2))
    return F.degrees(F.atan((t1 * F.sin(a2) - t2 * F.sin(a1)) / F.sin(a1 - a2)))


# --- clip to a box ----------------------------------------------------------------------------


def clip_lines(vertices: DataFrame, bbox, convention: str = "180") -> DataFrame:
    """Parts of lines inside a box: (feature_id, part, seq, sub, x, y).

    Each edge is cut by the parametric entry/exit test; a new part begins where the line
    left the box in between. A 0..360 box is cut in its one or two source parts and the
    western one is shifted by +360.
    """
    if convention == "180":
        boxes = [(tuple(float(v) for v in bbox), 0.0)]
    elif convention == "360":
        boxes = source_boxes(bbox)
    else:
        raise ValueError("longitude must be '180' or '360'")
    e = edges(vertices)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    cut = []
    for no, ((xa, ya, xb, yb), shift) in enumerate(boxes):
        t_in, t_out = F.lit(0.0), F.lit(1.0)
        outside = F.lit(False)
        for direction, distance in ((-dx, x1 - xa), (dx, xb - x1), (-dy, y1 - ya), (dy, yb - y1)):
            r = distance / F.when(direction != 0, direction)
            t_in = F.when(direction < 0, F.greatest(t_in, r)).otherwise(t_in)
            t_out = F.when(direction > 0, F.least(t_out, r)).otherwise(t_out)
            outside = outside | ((direction == 0) & (distance < 0))
        cut.append(F.when(~outside & (t_in <= t_out), F.struct(
            F.lit(no).alias("box"), F.lit(shift).alias("shift"), t_in.alias("t0"), t_out.alias("t1"))))
    hits = e.withColumn("c", F.explode(F.array_compact(F.array(*cut)))).withColumn("box", F.col("c.box"))
    hits = hits.filter("c.t0 < c.t1")

    def opens(prev: Column, cur: Column) -> Column:
        joined = (cur["t0"] == 0) & (prev["seq"] == cur["seq"] - 1) & (prev["t1"] == 1)
        return ~F.coalesce(joined, F.lit(False))

    span = F.struct("seq", F.col("c.t0").alias("t0"), F.col("c.t1").alias("t1"))
    hits = previous_and_count(hits, ["feature_id", "box"], "slice", "seq", span, opens, "before", "part")
    hits = hits.withColumn("joined", ~opens(F.col("before"), span))

    def at(t: Column, sub: int) -> Column:
        return F.struct(
            F.lit(sub).alias("sub"), (x1 + t * dx + F.col("c.shift")).alias("x"), (y1 + t * dy).alias("y"))

    start, end = at(F.col("c.t0"), 0), at(F.col("c.t1"), 1)
    ends = F.when(F.col("joined"), F.array(end)).otherwise(F.array(start, end))
    return hits.select(
        "feature_id", "box", "part", "seq", F.explode(ends).alias("v")
    ).select("feature_id", "box", "part", "seq", "v.sub", "v.x", "v.y")


def source_boxes(bbox) -> list[tuple[tuple[float, float, float, float], float]]:
    xmin, ymin, xmax, ymax = (float(v) for v in bbox)
    if not 0 <= xmin < xmax <= 360:
        raise ValueError("0..360 bbox must satisfy 0 <= xmin < xmax <= 360")
    if xmax <= 180:
        return [((xmin, ymin, xmax, ymax), 0.0)]
    if xmin >= 180:
        return [((xmin - 360, ymin, xmax - 360, ymax), 360.0)]
    return [((xmin, ymin, 180.0, ymax), 0.0), ((-180.0, ymin, xmax - 360, ymax), 360.0)]


def clip_ring(ring: Column, bbox) -> Column:
    """Clip one polygon ring against an axis-aligned box, side by side, inside the JVM."""
    xmin, ymin, xmax, ymax = (float(v) for v in bbox)
    for axis, bound, sign in (("x", xmin, 1), ("x", xmax, -1), ("y", ymin, 1), ("y", ymax, -1)):
        ring = _clip_side(ring, axis, bound, sign)
    return ring


def _previous(ring: Column) -> Column:
    """Each vertex's predecessor; the first vertex follows the last."""
    return F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.size(ring) - 1))


def _clip_side(ring: Column, axis: str, bound: float, sign: int) -> Column:
    def inside(p: Column) -> Column:
        return p[axis] >= bound if sign > 0 else p[axis] <= bound

    def meet(a: Column, b: Column) -> Column:
        other = "y" if axis == "x" else "x"
        along = a[other] + (b[other] - a[other]) * (F.lit(bound) - a[axis]) / (b[axis] - a[axis])
        x, y = (F.lit(bound), along) if axis == "x" else (along, F.lit(bound))
        return F.struct(x.alias("x"), y.alias("y"))

    def step(prev: Column, cur: Column) -> Column:
        return (
            F.when(inside(prev) & inside(cur), F.array(cur))
            .when(inside(prev), F.array(meet(prev, cur)))
            .when(inside(cur), F.array(meet(prev, cur), cur))
            .otherwise(F.array().cast(f"array<{POINT}>"))
        )

    return bind(ring, lambda r: F.when(
        F.size(r) > 0, F.flatten(F.zip_with(_previous(r), r, step))).otherwise(r))


def _crossings(ring: Column, bbox) -> Column:
    """Most edges of a ring that cross the line of one side of a box."""
    xmin, ymin, xmax, ymax = (float(v) for v in bbox)

    def crossed(axis: str, bound: float) -> Column:
        return bind(ring, lambda r: F.size(F.filter(
            F.zip_with(_previous(r), r, lambda a, b: (a[axis] >= bound) != (b[axis] >= bound)), lambda c: c)))

    return F.greatest(crossed("x", xmin), crossed("x", xmax), crossed("y", ymin), crossed("y", ymax))


def cut_rings(
    rings: list[list[tuple[float, float]]], axis: int, bound: float, sign: int,
) -> tuple[list[int], list[list[tuple[float, float]]]]:
    """The rings of one polygon on one side of a line: indices of those that lie there whole, and the
    parts that the others form.

    Rings fall into chains on the inner side. Where the line enters and leaves the polygon, in order
    along the line, every second stretch lies inside; it joins the end of one chain to the start of
    another, and following these joints gives one ring per part. A hole that the line cuts becomes a
    bay of the part around it.
    """
    whole: list[int] = []
    chains: list[list[tuple[float, float]]] = []

    def meet(a, b):
        t = (bound - a[axis]) / (b[axis] - a[axis])
        at = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
        return (bound, at) if axis == 0 else (at, bound)

    for n, ring in enumerate(rings):
        inside = [sign * (p[axis] - bound) >= 0 for p in ring]
        if all(inside):
            whole.append(n)
            continue
        if not any(inside):
            continue
        first = next(i for i in range(len(ring)) if inside[i] and not inside[i - 1])
        order = ring[first:] + ring[:first]
        flags = inside[first:] + inside[:first]
        for i, (p, keep) in enumerate(zip(order, flags)):
            if keep:
                if not flags[i - 1]:
                    chains.append([meet(order[i - 1], p)])
                chains[-1].append(p)
            elif flags[i - 1]:
                chains[-1].append(meet(order[i - 1], p))
    ends = sorted([(c[0][1 - axis], k, 0) for k, c in enumerate(chains)] + [(c[-1][1 - axis], k, 1) for k, c in enumerate(chains)])
    partner = {}
    for (_, k, end), (_, m, other) in zip(ends[::2], ends[1::2]):
        partner[k, end], partner[m, other] = (m, other), (k, end)
    parts, left = [], set(range(len(chains)))
    while left:
        k, part = min(left), []
        start, end = k, 1
        while k in left:
            left.discard(k)
            part += chains[k] if end == 1 else chains[k][::-1]
            k, at = partner[k, end]
            end = 1 - at
        parts.append(part)
        assert k == start
    return whole, parts


def _half_plane(ring: list[tuple[float, float]], axis: int, bound: float, sign: int) -> list[list[tuple[float, float]]]:
    """Parts of a simple ring on one side of a line."""
    whole, parts = cut_rings([ring], axis, bound, sign)
    return [ring] if whole else parts


def _clip_to_parts(bbox):
    xmin, ymin, xmax, ymax = (float(v) for v in bbox)

    @F.pandas_udf(f"array<array<{POINT}>>")
    def parts(rings: pd.Series) -> pd.Series:
        out = []
        for ring in rings:
            if ring is None:
                out.append(None)
                continue
            pieces = [[(p["x"], p["y"]) for p in ring]]
            for axis, bound, sign in ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1)):
                pieces = [part for piece in pieces for part in _half_plane(piece, axis, bound, sign)]
            out.append([[{"x": x, "y": y} for x, y in piece] for piece in pieces])
        return pd.Series(out, dtype=object)

    return parts


def clip_polygons(rings: DataFrame, bbox, convention: str = "180") -> DataFrame:
    """Parts of rings inside a box, numbered by ``part`` from 0.

    Rings whose own bounds miss the box are excluded beforehand. A ring that crosses no side of the
    box more than twice has one part, cut by expressions; only others, which may fall into several
    parts, are cut in Python. Parts without an area (a touching side or corner) are dropped.
    """
    if convention == "180":
        boxes = [(tuple(float(v) for v in bbox), 0.0)]
    elif convention == "360":
        boxes = source_boxes(bbox)
    else:
        raise ValueError("longitude must be '180' or '360'")
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    out = None
    for no, (box, shift) in enumerate(boxes):
        xa, ya, xb, yb = box
        near = rings.filter(
            (F.array_max(xs) >= xa) & (F.array_min(xs) <= xb) & (F.array_max(ys) >= ya) & (F.array_min(ys) <= yb))
        near = near.withColumn("__many", _crossings(F.col("ring"), box) > 2)
        parts = F.when(F.col("__many"), _clip_to_parts(box)(F.when(F.col("__many"), F.col("ring")))).otherwise(
            F.array(clip_ring(F.col("ring"), box)))
        kept = [c for c in rings.columns if c != "ring"]
        cut = near.select(*kept, F.posexplode(parts).alias("part", "ring")).filter(
            (F.size("ring") >= 3) & (ring_area(F.col("ring")) > 0))
        cut = cut.withColumn("box", F.lit(no))
        if shift:
            east = F.lit(shift)
            cut = cut.withColumn("ring", F.transform(
                "ring", lambda p: F.struct((p["x"] + east).alias("x"), p["y"].alias("y"))))
        out = cut if out is None else out.unionByName(cut)
    return out


def ring_area(ring: Column) -> Column:
    """Planar area of a ring by the shoelace sum."""
    terms = bind(ring, lambda r: F.zip_with(_previous(r), r, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def zone_layer(rings: DataFrame, bbox, source_id: str, boundary_type: str, legal_status: str = "provider_reference") -> DataFrame:
    """Provider zones cut to the study box and tagged with their provenance."""
    return clip_polygons(rings, bbox).select(
        "*", F.lit(source_id).alias("source_id"), F.lit(boundary_type).alias("boundary_type"),
        F.lit(legal_status).alias("legal_status"),
    )


# --- equidistance reference -------------------------------------------------------------------


@dataclass(frozen=True)
class MedianReference:
    """How a median reference is computed; the defaults and the method's name are fixed values."""

    sample_spacing_m: float = 5000.0
    balance_tolerance_m: float = 750.0
    method: str = "MUTUAL_NEAREST_BASELINE_MIDPOINT_REFERENCE"


def project(vertices: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """Local metric plane: spherical transverse Mercator about (lon0, lat0)."""
    lam, phi = F.radians(F.col("x") - lon0), F.radians("y")
    b = F.cos(phi) * F.sin(lam)
    east = SPHERE_RADIUS_M * F.atanh(b)
    north = SPHERE_RADIUS_M * (F.atan2(F.tan(phi), F.cos(lam)) - F.radians(F.lit(lat0)))
    return vertices.withColumns({"x": east, "y": north})


def unproject(points: DataFrame, lon0: float, lat0: float) -> DataFrame:
    d = F.col("y") / SPHERE_RADIUS_M + F.radians(F.lit(lat0))
    e = F.col("x") / SPHERE_RADIUS_M
    return points.withColumns({
        "x": F.degrees(F.atan2(F.sinh(e), F.cos(d))) + lon0,
        "y": F.degrees(F.asin(F.sin(d) / F.cosh(e))),
    })


def sample_lines(vertices: DataFrame, spacing_m: float) -> DataFrame:
    """Evenly spaced points per line, ends included, at least two: (feature_id, n, x, y).

    Sample ``n`` belongs to the edge that ends at or after its distance; the last edge also
    takes the end point, which rounding could otherwise lose.
    """
    return sample_edges(edges(vertices), spacing_m)


def sample_edges(edge_table: DataFrame, spacing_m: float) -> DataFrame:
    e = edge_table.withColumn("len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    e = running_sum(e.filter("len > 0"), ["feature_id"], "slice", "seq", "len", "upto", total="total")
    final_edge = e.groupBy("feature_id").agg(F.max("seq").alias("final_seq"))
    e = e.join(final_edge, "feature_id")
    e = e.withColumn("from", F.col("upto") - F.col("len")).withColumn(
        "count", F.greatest(F.lit(2), F.ceil(F.col("total") / spacing_m) + 1))
    step = F.col("total") / (F.col("count") - 1)
    first = F.ceil(F.col("from") / step)
    final = F.when(F.col("seq") == F.col("final_seq"), F.col("count") - 1).otherwise(F.ceil(F.col("upto") / step) - 1)
    e = e.withColumn("n", F.explode(F.when(first <= final, F.sequence(first.cast("long"), final.cast("long")))))
    t = F.least(F.lit(1.0), (F.col("n") * step - F.col("from")) / F.col("len"))
    return e.select(
        "feature_id", "n", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"),
        (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"),
    )


def _foot(px: Column, py: Column) -> tuple[Column, Column]:
    """Closest point of edge (x1, y1, x2, y2) to (px, py)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sq = dx * dx + dy * dy
    t = F.when(sq > 0, ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / sq).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.col("x1") + t * dx, F.col("y1") + t * dy


def _grid_levels(points: DataFrame, edge_table: DataFrame, cell_m: float) -> int:
    """Levels after which one cell is as large as the extent of all points and edges, so that
    every point has every edge beside it at the last level."""
    ends = [F.max(F.greatest(F.abs(F.col(a)), F.abs(F.col(b)))) for a, b in (("x1", "x2"), ("y1", "y2"))]
    edge = edge_table.agg(*ends).first()
    point = points.agg(F.max(F.abs("x")), F.max(F.abs("y"))).first()
    reach = max([v for v in (*edge, *point) if v is not None], default=0.0)
    return max(0, math.ceil(math.log2(max(2 * reach, cell_m) / cell_m)))


def nearest_on_edges(points: DataFrame, edge_table: DataFrame, key: str, cell_m: float = 5000.0) -> DataFrame:
    """Exact nearest edge point for each point: adds ``nx``, ``ny``, ``nd``; no point is lost as
    long as there is an edge.

    Edges are entered in a pyramid of grids whose cell doubles per level, up to the extent of the
    data. For each point the finest level with an edge in the 3×3 block around it bounds the
    distance by the block's diagonal, so the true nearest edge lies within a 7×7 block of cells of
    that level. From there the cells are divided level by level: each has a least and a greatest
    distance at which its edges may lie, and cells farther than the least of a point's greatest
    distances are dropped before the next level. Only edges in what is left of the finest cells are
    measured, however far the coast; nothing is paired point × edge.
    """
    depth = _grid_levels(points, edge_table, cell_m)
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))

    def cells(value_a: Column, value_b: Column) -> Column:
        size = F.lit(cell_m) * F.pow(F.lit(2.0), F.col("level"))
        return F.sequence(
            F.floor(F.least(value_a, value_b) / size).cast("long"),
            F.floor(F.greatest(value_a, value_b) / size).cast("long"))

    # an edge enters the cells it passes: column by column, with its own span there
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    width = F.lit(cell_m) * F.pow(F.lit(2.0), F.col("level"))
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    from_x = F.greatest(low, F.col("gx") * width)
    to_x = F.least(high, (F.col("gx") + 1) * width)

    def at(x: Column) -> Column:
        return F.when(dx != 0, F.col("y1") + dy * (x - F.col("x1")) / dx)

    bottom = F.greatest(F.least("y1", "y2"), F.coalesce(F.least(at(from_x), at(to_x)), F.least("y1", "y2")) - 1e-6 * width)
    top = F.least(F.greatest("y1", "y2"), F.coalesce(F.greatest(at(from_x), at(to_x)), F.greatest("y1", "y2")) + 1e-6 * width)
    boxed = (
        edge_table.select("x1", "y1", "x2", "y2", levels.alias("level"))
        .withColumn("gx", F.explode(cells(F.col("x1"), F.col("x2"))))
        .withColumn("gy", F.explode(cells(bottom, top)))
    )
    occupied = boxed.select("level", "gx", "gy").distinct()
    size = F.lit(cell_m) * F.pow(F.lit(2.0), F.col("level"))

    def probe(df: DataFrame, reach: int) -> DataFrame:
        span = F.sequence(F.lit(-reach), F.lit(reach))
        return (
            df.withColumn("gx", F.explode(F.transform(span, lambda d: F.floor(F.col("x") / size).cast("long") + d)))
            .withColumn("gy", F.explode(F.transform(span, lambda d: F.floor(F.col("y") / size).cast("long") + d)))
        )

    at_level = points.select(key, "x", "y", levels.alias("level"))
    finest = stage(
        probe(at_level, 1).join(occupied, ["level", "gx", "gy"], "left_semi")
        .groupBy(key).agg(F.min("level").alias("level"))
    )
    top = finest.agg(F.max("level")).first()[0] or 0

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs (point, occupied cell) that can hold the point's nearest edge."""
        left, right = F.col("gx") * size, (F.col("gx") + 1) * size
        low, high = F.col("gy") * size, (F.col("gy") + 1) * size

        def gap(at: Column, a: Column, b: Column) -> Column:
            return F.greatest(a - at, at - b, F.lit(0.0))

        def reach(at: Column, a: Column, b: Column) -> Column:
            return F.greatest(F.abs(at - a), F.abs(at - b))

        # an edge may pass a cell at a millionth of its width
        slack = size * 1e-5
        bounded = pairs.join(occupied, ["level", "gx", "gy"], "left_semi").withColumns({
            "least": F.hypot(gap(F.col("x"), left, right), gap(F.col("y"), low, high)) - slack,
            "most": F.hypot(reach(F.col("x"), left, right), reach(F.col("y"), low, high)) + slack})
        bound = bounded.groupBy(key).agg(F.min("most").alias("bound"))
        return bounded.join(bound, key).where("least <= bound").select(key, "x", "y", "level", "gx", "gy")

    def entering(level: int) -> DataFrame:
        return probe(points.select(key, "x", "y").join(finest.where(F.col("level") == level), key), 3)

    halves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)])
    pairs = None
    for level in range(top, 0, -1):
        pairs = stage(near(entering(level) if pairs is None else pairs.unionByName(entering(level))))
        pairs = pairs.withColumn("h", F.explode(halves)).select(
            key, "x", "y", (F.col("level") - 1).alias("level"), (F.col("gx") * 2 + F.col("h.dx")).alias("gx"), (F.col("gy") * 2 + F.col("h.dy")).alias("gy"))
    pairs = near(entering(0) if pairs is None else pairs.unionByName(entering(0)))
    found = pairs.join(boxed, ["level", "gx", "gy"])
    fx, fy = _foot(F.col("x"), F.col("y"))
    best = (
        found.select(key, F.struct(
            F.hypot(F.col("x") - fx, F.col("y") - fy).alias("nd"), fx.alias("nx"), fy.alias("ny")).alias("hit"))
        .groupBy(key).agg(F.min("hit").alias("hit"))
    )
    return points.join(best.select(key, "hit.*"), key)


def principal_order(points: DataFrame) -> DataFrame:
    """Add ``along``: the coordinate on the principal axis of the point set, which points east or
    north (an axis has no direction of its own; the angle lies from -45 to 135 degrees)."""
    angle = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    angle = F.when(angle < -math.pi / 4, angle + math.pi).otherwise(angle)
    moments = points.agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("xx"),
        F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
    ).select(F.struct(
        "mx", "my", angle.alias("angle")))
    m = moments.scalar()
    return points.withColumn(
        "along",
        (F.col("x") - m["mx"]) * F.cos(m["angle"]) + (F.col("y") - m["my"]) * F.sin(m["angle"]),
    )


def distinct_rounded(points: DataFrame, order: str, digits: int = 3) -> DataFrame:
    """One point per rounded coordinate, the last in ``order``."""
    return (
        points.groupBy(F.bround("x", digits).alias("rx"), F.bround("y", digits).alias("ry"))
        .agg(F.max_by(F.struct("x", "y"), order).alias("p"))
        .select("rx", "ry", "p.x", "p.y")
    )


def equidistance_points(
    baseline_a: DataFrame, baseline_b: DataFrame, lon0: float, lat0: float,
    parameters: MedianReference = MedianReference(), names: tuple[str, str] = ("a", "b"),
) -> DataFrame:
    """Vertices of a computed median reference between two baselines, ordered by ``along``.

    A cartographic reference (legal_status COMPUTED_REFERENCE), never a declared boundary.
    Edges, samples and midpoints are read several times each, so they are written once.
    """
    sides = {
        "a": stage(edges(project(baseline_a, lon0, lat0))),
        "b": stage(edges(project(baseline_b, lon0, lat0))),
    }

    def samples(name: str) -> DataFrame:
        s = sample_edges(sides[name], parameters.sample_spacing_m).select(
            F.concat_ws(":", F.lit(name), F.col("feature_id").cast("string"), F.format_string("%012d", "n")).alias("sid"),
            "x", "y")
        other = sides["b" if name == "a" else "a"]
        return nearest_on_edges(stage(s), other, "sid").select(
            "sid", ((F.col("x") + F.col("nx")) / 2).alias("x"), ((F.col("y") + F.col("ny")) / 2).alias("y"))

    mid = stage(samples("a").unionByName(samples("b")))
    to_a = nearest_on_edges(mid, sides["a"], "sid").select("sid", "x", "y", F.col("nd").alias("da"))
    to_b = nearest_on_edges(mid, sides["b"], "sid").select("sid", F.col("nd").alias("db"))
    kept = to_a.join(to_b, "sid").filter(F.abs(F.col("da") - F.col("db")) <= parameters.balance_tolerance_m)
    line = principal_order(require_line(stage(distinct_rounded(kept, "sid").select("x", "y"))))
    return unproject(line, lon0, lat0).select(
        F.lit("computed-median-1").alias("feature_id"), "along", "x", "y",
        F.lit("computed_median_equidistance_reference").alias("boundary_type"),
        F.lit("COMPUTED_REFERENCE").alias("legal_status"), F.lit(parameters.method).alias("method"),
        F.lit(names[0]).alias("baseline_a"), F.lit(names[1]).alias("baseline_b"),
        F.lit(parameters.sample_spacing_m).alias("sample_spacing_m"), F.lit(parameters.balance_tolerance_m).alias("balance_tolerance_m"),
    )


def require_line(points: DataFrame) -> DataFrame:
    """The points of a median reference, of which a line needs two."""
    if len(points.select("x").take(2)) < 2:
        raise ValueError("the baselines do not give a stable equidistance reference")
    return points
