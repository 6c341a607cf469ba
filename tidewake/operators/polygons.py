"""Polygons with holes cut to a box.

A polygon is its rows of one ``feature_id`` and ``polygon_no``: ring 0 is the shell, the others are
holes. Only rings that reach over the box's sides have to meet: they are cut together, and a hole
that a side cuts becomes a bay. Holes that lie within the box stay in their own rows. If the shell
falls into several parts, each such hole finds its part by counting, along the scanline to its
left, the edges of every part: only edges in the scanline's band of the grid are met.
"""

from __future__ import annotations

from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.operators.vectors import POINT, cut_rings, ring_area, source_boxes
from tidewake.session import stage

#: Bands of the grid in which scanlines meet edges: one for about so many edges of a polygon.
BAND_EDGES = 16
MOST_BANDS = 1 << 16

_KEYS = ["feature_id", "polygon_no"]


def _bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def _cut_polygon(box):
    xa, ya, xb, yb = box

    @F.pandas_udf(f"array<struct<shell:boolean,ring_no:int,ring:array<{POINT}>>>")
    def parts(numbers: pd.Series, sizes: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for ring_numbers, lengths, x, y in zip(numbers, sizes, xs, ys):
            points = list(zip(x.tolist(), y.tolist()))
            ends = [0, *accumulate(lengths.tolist())]
            # (ring number, 0 for parts of the shell, points)
            held = [(n, points[a:b]) for n, (a, b) in zip(ring_numbers.tolist(), pairwise(ends))]
            for axis, bound, sign in ((0, xa, 1), (0, xb, -1), (1, ya, 1), (1, yb, -1)):
                whole, joined = cut_rings([points for _, points in held], axis, bound, sign)
                held = [held[i] for i in whole] + [(0, points) for points in joined]
            out.append([{"shell": n == 0, "ring_no": n, "ring": [{"x": x, "y": y} for x, y in points]} for n, points in held])
        return pd.Series(out, dtype=object)

    return parts


def _with_part(holes: DataFrame, shells: DataFrame) -> DataFrame:
    """``holes`` with the ``part`` of ``shells`` in which each lies; of shells with one part it is that one."""
    several = shells.groupBy(*_KEYS).agg(
        F.count("*").alias("parts"), F.min("part").alias("only"), F.sum(F.size("ring")).alias("edges"),
        F.min(_bounds(F.col("ring"))[1]).alias("low"), F.max(_bounds(F.col("ring"))[3]).alias("high"))
    several = several.withColumn("bands", F.greatest(F.lit(1), F.least(F.lit(MOST_BANDS), F.floor(F.col("edges") / BAND_EDGES)))).withColumn(
        "band", F.greatest((F.col("high") - F.col("low")) / F.col("bands"), F.lit(1e-300)))
    named = several.withColumnsRenamed({k: f"__{k}" for k in _KEYS})

    def placed(df: DataFrame) -> DataFrame:
        return df.join(named, (F.col("feature_id") == F.col("__feature_id")) & (F.col("polygon_no") == F.col("__polygon_no"))).drop(
            "__feature_id", "__polygon_no")

    def band_of(y: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("bands") - 1, F.floor((y - F.col("low")) / F.col("band")))).cast("long")

    known = placed(holes)
    alone = known.where("parts = 1").withColumn("part", F.col("only"))
    # a point of the hole's outline; holes meet shells in single points at most
    a, b = F.col("ring")[0], F.col("ring")[1]
    asked = known.where("parts > 1").withColumns({"px": (a["x"] + b["x"]) / 2, "py": (a["y"] + b["y"]) / 2})
    asked = asked.select(*holes.columns, "px", "py", band_of(F.col("py")).alias("at"))
    turned = F.concat(F.slice("ring", -1, 1), F.slice("ring", F.lit(1), F.size("ring") - 1))
    sides = placed(shells).where("parts > 1").select(
        *[F.col(k).alias(f"__{k}") for k in _KEYS], F.col("part").alias("__part"), "low", "bands", "band",
        F.explode(F.zip_with(turned, "ring", lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))).alias("e"))
    sides = sides.where("e.y1 <> e.y2").select(
        "__feature_id", "__polygon_no", "__part", "e.*",
        F.explode(F.sequence(band_of(F.least("e.y1", "e.y2")), band_of(F.greatest("e.y1", "e.y2")))).alias("__at"))
    met = asked.select(*_KEYS, "ring_no", "px", "py", "at").join(
        sides, (F.col("feature_id") == F.col("__feature_id")) & (F.col("polygon_no") == F.col("__polygon_no")) & (F.col("at") == F.col("__at")))
    over = ((F.col("y1") <= F.col("py")) != (F.col("y2") <= F.col("py"))) & (
        F.col("x1") + (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")) < F.col("px"))
    inside = met.where(over).groupBy(*_KEYS, "ring_no", "__part").agg((F.count("*") % 2).alias("odd")).where("odd = 1").groupBy(
        *_KEYS, "ring_no").agg(F.min("__part").alias("part"))
    found = asked.drop("px", "py", "at").join(inside, [*_KEYS, "ring_no"])
    return alone.select(*holes.columns, "part").unionByName(found.select(*holes.columns, "part"))


def clip_with_holes(rings: DataFrame, bbox, convention: str = "180") -> DataFrame:
    """Parts of polygons inside a box: (feature_id, polygon_no, box, part, ring_no, ring), one row per ring.

    ``rings``: (feature_id, polygon_no, ring_no, ring), rings without their first vertex repeated. In
    the result ring 0 of a part is its shell, further ones its holes under their own numbers.
    Polygons that miss the box, parts and holes without an area and NULL rings give no rows. A
    0..360 box is cut in its one or two source parts and the western one is shifted by +360.
    """
    if convention == "180":
        boxes = [(tuple(float(v) for v in bbox), 0.0)]
    elif convention == "360":
        boxes = source_boxes(bbox)
    else:
        raise ValueError("longitude must be '180' or '360'")
    out = None
    for no, (box, shift) in enumerate(boxes):
        xa, ya, xb, yb = box
        x0, y0, x1, y1 = _bounds(F.col("ring"))
        near = rings.select(*_KEYS, "ring_no", "ring").where(
            (F.size("ring") >= 3) & (x1 >= xa) & (x0 <= xb) & (y1 >= ya) & (y0 <= yb))
        free = (F.col("ring_no") > 0) & (x0 >= xa) & (x1 <= xb) & (y0 >= ya) & (y1 <= yb)
        reaching = near.where(~free).groupBy(*_KEYS).agg(F.sort_array(F.collect_list(F.struct("ring_no", "ring"))).alias("r"))
        # holes without their shell are not a polygon
        reaching = reaching.where(F.col("r")[0]["ring_no"] == 0)
        xs, ys = (F.flatten(F.transform("r", lambda q: F.transform(q["ring"], lambda p: p[axis]))) for axis in ("x", "y"))  # noqa: B023
        parts = _cut_polygon(box)(F.col("r.ring_no"), F.transform("r", lambda q: F.size(q["ring"])), xs, ys)
        cut = reaching.select(*_KEYS, F.posexplode(parts).alias("part", "c"))
        cut = stage(cut.select(*_KEYS, "part", "c.shell", "c.ring_no", "c.ring").where(
            (F.size("ring") >= 3) & (ring_area(F.col("ring")) > 0)))
        shells = cut.where("shell").select(*_KEYS, "part", "ring_no", "ring")
        # holes that only seemed to reach over a side lie within like the others
        holes = near.where(free).where(ring_area(F.col("ring")) > 0).unionByName(cut.where("NOT shell").select(*_KEYS, "ring_no", "ring"))
        both = shells.unionByName(_with_part(holes, shells)).withColumn("box", F.lit(no))
        if shift:
            east = F.lit(shift)
            both = both.withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] + east).alias("x"), p["y"].alias("y"))))
        out = both if out is None else out.unionByName(both)
    return out.select(*_KEYS, "box", "part", "ring_no", "ring")


def polygon_areas(parts: DataFrame) -> DataFrame:
    """Per part: ``holes`` and ``area`` (of the shell less its holes)."""
    area = ring_area(F.col("ring"))
    return parts.groupBy(*_KEYS, "box", "part").agg(
        F.count_if(F.col("ring_no") > 0).alias("holes"), F.sum(F.when(F.col("ring_no") == 0, area).otherwise(-area)).alias("area"))
