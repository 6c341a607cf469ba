"""Raster bands as cell tables ``(grid_row, grid_col, value)`` with an affine frame.

Cells of one grid row are neighbours in the table; every operator below is a projection, an
aggregate with map-side combine or an equi-join on the cell index, so the work spreads over
cells whatever the raster's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.operators.vectors import source_boxes
from tidewake.plans.chains import ordered_pieces
from tidewake.schema import DEPTH_CLASSES
from tidewake.session import stage

# Fixed values.
DENSITY_QUANTILES = (0.5, 0.75, 0.9, 0.98)
DENSITY_STEPS = (0.72, 0.82, 0.92, 1.0)
DENSITY_NODATA = -9999.0
DENSITY_LAT_LIMIT = 85.0
FILL_REACH = 3


@dataclass(frozen=True)
class Affine:
    """North-up frame: left edge, top edge, pixel width and height in degrees."""

    left: float
    top: float
    px: float
    py: float
    width: int
    height: int

    def window(self, bbox: Sequence[float]) -> tuple[int, int, int, int]:
        """(row0, col0, rows, cols) of a box: rounded offset and length, cut to the raster."""
        xmin, ymin, xmax, ymax = bbox
        col0, row0 = round_half((xmin - self.left) / self.px), round_half((self.top - ymax) / self.py)
        cols, rows = round_half((xmax - xmin) / self.px), round_half((ymax - ymin) / self.py)
        c0, r0 = max(0, col0), max(0, row0)
        c1, r1 = min(self.width, col0 + cols), min(self.height, row0 + rows)
        if c1 <= c0 or r1 <= r0:
            raise ValueError(f"empty raster window for bbox {tuple(bbox)}")
        return r0, c0, r1 - r0, c1 - c0

    def shifted(self, row0: int, col0: int, rows: int, cols: int) -> Affine:
        return Affine(self.left + col0 * self.px, self.top - row0 * self.py, self.px, self.py, cols, rows)


def round_half(value: float) -> int:
    return int(value + 0.5) if value >= 0 else -int(-value + 0.5)


def bbox_parts(bbox: Sequence[float]) -> list[tuple[float, float, float, float]]:
    return [box for box, _ in source_boxes(bbox)]


def clip(cells: DataFrame, frame: Affine, bbox: Sequence[float]) -> tuple[DataFrame, Affine]:
    """Window of a raster; indices restart at 0. The row filter prunes row-block partitions."""
    row0, col0, rows, cols = frame.window(bbox)
    cut = cells.filter(
        F.col("grid_row").between(row0, row0 + rows - 1) & F.col("grid_col").between(col0, col0 + cols - 1)
    ).withColumns({"grid_row": F.col("grid_row") - row0, "grid_col": F.col("grid_col") - col0})
    return cut, frame.shifted(row0, col0, rows, cols)


def clip_360(cells: DataFrame, frame: Affine, bbox: Sequence[float]) -> tuple[DataFrame, Affine]:
    """0..360 window of a −180..180 raster: clip the parts, shift the western one by +360."""
    out, base, offset = None, None, 0
    for part in bbox_parts(bbox):
        cut, sub = clip(cells, frame, part)
        if base is None:
            left = sub.left + 360.0 if part[0] < 0 else sub.left
            base = Affine(left, sub.top, sub.px, sub.py, sub.width, sub.height)
            out = cut
        else:
            offset = round_half((sub.left + 360.0 - base.left) / base.px)
            out = out.unionByName(cut.withColumn("grid_col", F.col("grid_col") + offset))
            base = Affine(base.left, base.top, base.px, base.py, offset + sub.width, max(base.height, sub.height))
    return out, base


def mosaic(parts: Sequence[tuple[DataFrame, int, int]], nodata: float | None = None) -> DataFrame:
    """Merge grids placed at (row, col) offsets; the first part with a valid cell wins."""
    tagged = [
        cells.select(
            (F.col("grid_row") + dr).alias("grid_row"), (F.col("grid_col") + dc).alias("grid_col"),
            F.col("value"), F.lit(no).alias("part"))
        for no, (cells, dr, dc) in enumerate(parts)
    ]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more)
    valid = F.col("value").isNotNull()
    if nodata is not None:
        valid = valid & (F.col("value") != nodata)
    rank = F.col("part") + F.when(valid, 0).otherwise(len(parts))
    return out.groupBy("grid_row", "grid_col").agg(F.min_by("value", rank).alias("value"))


def usable(value: Column, nodata: float | None = None) -> Column:
    """Whether a cell holds a number: NULL, NaN, infinite values and ``nodata`` are none."""
    held = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return held if nodata is None else held & (value != nodata)


def valid_density(value: Column, nodata: float = DENSITY_NODATA) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")) & (value != nodata) & (value >= 0), F.lit(False))


def log_density(cells: DataFrame, nodata: float = DENSITY_NODATA, out_nodata: float = DENSITY_NODATA) -> DataFrame:
    v = F.col("value")
    return cells.withColumn("value", F.when(valid_density(v, nodata), F.log1p(v)).otherwise(out_nodata))


def downsample_average(cells: DataFrame, factor: float, nodata: float | None = None) -> DataFrame:
    """Area-weighted mean of the valid cells of each output cell, ``factor`` (1 or more) source
    cells wide; a source cell on a border counts on both sides with its share.

    NULL, NaN and infinite values are no values, nor is ``nodata``; an output cell without a value
    is ``nodata`` (NULL where there is none).
    """
    if factor < 1:
        raise ValueError("the factor must be 1 or more")
    value = F.col("value")
    valid = usable(value, nodata)

    def shares(index: str) -> Column:
        i = F.col(index)
        outputs = F.sequence(F.floor(i / factor).cast("long"), F.ceil((i + 1) / factor).cast("long") - 1)
        return F.transform(outputs, lambda o: F.struct(
            o.alias("o"), (F.least(i + 1.0, (o + 1) * factor) - F.greatest(i.cast("double"), o * factor)).alias("w")))

    spread = cells.select(
        F.explode(shares("grid_row")).alias("r"), "grid_col", F.when(valid, value).alias("value")
    ).select("r", F.explode(shares("grid_col")).alias("c"), "value")
    weight = F.col("r.w") * F.col("c.w")
    mean = F.sum(weight * F.col("value")) / F.sum(F.when(F.col("value").isNotNull(), weight))
    return spread.groupBy(F.col("r.o").alias("grid_row"), F.col("c.o").alias("grid_col")).agg(
        (mean if nodata is None else F.coalesce(mean, F.lit(nodata))).alias("value"))


def downsample_bilinear(
    cells: DataFrame, factor: float, width: int | Column, height: int | Column, nodata: float | None = None,
) -> DataFrame:
    """Bilinear value at output-cell centres from the four source cells around them, of which those
    without a number (NULL, NaN, infinite or ``nodata``) weigh nothing; an output cell with no
    other around it is ``nodata`` (NULL where there is none).

    Every source cell knows which output centres it contributes to, so this is one
    weighted aggregate; weights of cells outside the raster fall to the border cell. Width and
    height may be columns of ``cells``. Cells outside them contribute to nothing.
    """

    def shares(index: str, size: int | Column) -> Column:
        i, size = F.col(index), F.lit(size) if isinstance(size, int) else size
        outputs = F.greatest(F.lit(1), F.floor(size / factor + 0.5)).cast("long")
        scale = size / outputs
        low = F.greatest(F.lit(0), F.floor((i - 1 + 0.5) / scale - 0.5).cast("long") - 1)
        high = F.least(outputs - 1, F.ceil((i + 1 + 0.5) / scale - 0.5).cast("long") + 1)

        def weigh(o: Column) -> Column:
            centre = F.greatest(F.lit(0.0), F.least(size - 1.0, (o + 0.5) * scale - 0.5))
            return F.struct(o.alias("o"), F.greatest(F.lit(0.0), 1 - F.abs(centre - i)).alias("w"))

        # a sequence whose start lies above its end would descend
        return F.filter(F.transform(F.when(low <= high, F.sequence(low, high)), weigh), lambda s: s["w"] > 0)

    spread = (
        cells.withColumn("r", F.explode(shares("grid_row", height)))
        .withColumn("c", F.explode(shares("grid_col", width)))
        .withColumn("w", F.col("r.w") * F.col("c.w"))
    )
    held = usable(F.col("value"), nodata)
    mean = F.sum(F.when(held, F.col("w") * F.col("value"))) / F.sum(F.when(held, F.col("w")))
    return spread.groupBy(F.col("r.o").alias("grid_row"), F.col("c.o").alias("grid_col")).agg(
        (mean if nodata is None else F.coalesce(mean, F.lit(nodata))).alias("value"))


#: Bits of a number that one pass of the selection decides.
DIGIT_BITS = 16


def order_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers that ascend with the numbers (-0.0 counts as 0.0)."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)


def from_order_bits(bits: int) -> float:
    signed = np.uint64(bits ^ (1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1)
    return float(np.array([signed], np.uint64).view(np.float64)[0])


def _digits(prefixes: Sequence[int], shift: int):
    """Histograms of one digit of the numbers that begin with a prefix, summed within a task."""

    def run(batches):
        sums: dict[int, np.ndarray] = {p: np.zeros(1 << DIGIT_BITS, np.int64) for p in prefixes}
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            bits = order_bits(values[np.isfinite(values)])
            for prefix, counts in sums.items():
                part = bits if shift + DIGIT_BITS == 64 else bits[bits >> np.uint64(shift + DIGIT_BITS) == np.uint64(prefix)]
                digit = (part >> np.uint64(shift) & np.uint64((1 << DIGIT_BITS) - 1)).astype(np.int64)
                counts += np.bincount(digit, minlength=1 << DIGIT_BITS)
        for prefix, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), prefix, np.uint64).view(np.int64)), pa.array(at), pa.array(counts[at])], ["prefix", "digit", "n"])

    return run


def order_statistics(values: DataFrame, column: str, ranks: Callable[[int], Sequence[int]]) -> tuple[int, dict[int, float]]:
    """Number of finite values and those at the ranks (from 0) that ``ranks`` names for that number.

    Digit selection: a pass counts the first 16 bits, in order, of every number; the bin that holds
    a rank is its prefix, and the next pass counts the next 16 bits below the wanted prefixes, all
    ranks at once. After four passes a rank's number is known to the bit. Nothing is sorted; what
    moves are histograms, of which the driver sees one row per bin in use.
    """
    narrow = stage(values.select(F.col(column).cast("double").alias("v")))
    open_ranks: dict[int, tuple[int, int]] = {}  # rank: (prefix, rank among the numbers with it)
    total = None
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        prefixes = sorted({p for p, _ in open_ranks.values()}) if total is not None else [0]
        bins = narrow.mapInArrow(_digits(prefixes, shift), "prefix long, digit long, n long").groupBy("prefix", "digit").agg(F.sum("n").alias("n"))
        table: dict[int, list[tuple[int, int]]] = {}
        for row in bins.collect():
            table.setdefault(row["prefix"] & (1 << 64) - 1, []).append((row["digit"], row["n"]))
        if total is None:
            total = sum(n for _, n in table.get(0, []))
            open_ranks = {k: (0, k) for k in ranks(total)} if total else {}
        for rank, (prefix, left) in open_ranks.items():
            for digit, n in sorted(table[prefix]):
                if left < n:
                    open_ranks[rank] = (prefix << DIGIT_BITS | digit, left)
                    break
                left -= n
        if not open_ranks:
            break
    return total or 0, {rank: from_order_bits(bits) for rank, (bits, _) in open_ranks.items()}


def exact_quantiles(values: DataFrame, column: str, quantiles: Sequence[float]) -> DataFrame:
    """One row ``q0, q1, …`` of linearly interpolated quantiles over all finite values (NULL without
    any), by :func:`order_statistics`."""
    places: list[tuple[int, int, float]] = []

    def ranks(total: int) -> list[int]:
        for q in quantiles:
            at = q * (total - 1)
            places.append((math.floor(at), math.ceil(at), at - math.floor(at)))
        return sorted({r for lo, hi, _ in places for r in (lo, hi)})

    _, found = order_statistics(values, column, ranks)
    row = [found[lo] + share * (found[hi] - found[lo]) for lo, hi, share in places] or [None] * len(quantiles)
    return values.sparkSession.createDataFrame([tuple(row)], ", ".join(f"q{i} double" for i in range(len(quantiles))))


def density_quantiles(cells: DataFrame, nodata: float = DENSITY_NODATA) -> DataFrame:
    """Median, 75th, 90th and 98th percentile of the cells that hold a number: q50, q75, q90, q98."""
    row = exact_quantiles(cells.filter(usable(F.col("value"), nodata)), "value", DENSITY_QUANTILES)
    return row.toDF(*[f"q{int(round(q * 100)):02d}" for q in DENSITY_QUANTILES])


def density_window(
    bbox: Sequence[float], buffer_degrees: float = 0.75, lat_limit: float = DENSITY_LAT_LIMIT,
) -> tuple[float, float, float, float]:
    """Buffered box, cut to its longitude frame and to ``lat_limit`` degrees north and south (the
    usual limit is that of the published density grids; cells beyond it are not returned)."""
    xmin, ymin, xmax, ymax = bbox
    low, high = (0.0, 360.0) if xmax > 180.0 else (-180.0, 180.0)
    return (
        max(low, xmin - buffer_degrees), max(-lat_limit, ymin - buffer_degrees),
        min(high, xmax + buffer_degrees), min(lat_limit, ymax + buffer_degrees),
    )


def _density_cut(cells, frame, bbox, buffer_degrees, lat_limit) -> tuple[DataFrame, Affine]:
    window = density_window(bbox, buffer_degrees, lat_limit)
    return clip_360(cells, frame, window) if window[2] > 180.0 else clip(cells, frame, window)


def factor_for_width(
    cells: DataFrame, frame: Affine, bbox: Sequence[float], width: int, buffer_degrees: float = 0.75,
    lat_limit: float = DENSITY_LAT_LIMIT,
) -> float:
    """Factor at which a density subset is ``width`` columns wide at most (1 where it is already)."""
    return max(1.0, _density_cut(cells, frame, bbox, buffer_degrees, lat_limit)[1].width / width)


def density_subset(
    cells: DataFrame, frame: Affine, bbox: Sequence[float], buffer_degrees: float = 0.75,
    factor: float = 1.0, nodata: float = DENSITY_NODATA, lat_limit: float = DENSITY_LAT_LIMIT,
) -> DataFrame:
    """Log density around a box: buffered window, averaged over ``factor`` cells (full resolution
    by default), log1p."""
    cut, _ = _density_cut(cells, frame, bbox, buffer_degrees, lat_limit)
    if factor != 1.0:
        cut = downsample_average(cut, factor, nodata)
    return log_density(cut, nodata)


def density_request_key(source_sha256: str, frame: Affine, window: Sequence[float], factor: float, nodata: float) -> str:
    """Folder key of a cached subset: same source content, frame, window and factor → same key."""
    import hashlib

    text = "|".join([source_sha256, repr(frame), *[repr(float(v)) for v in (*window, factor, nodata)], "log1p-average"])
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def cached_density_subset(
    cells: DataFrame, frame: Affine, bbox: Sequence[float], cache_root: str, source_sha256: str,
    buffer_degrees: float = 0.75, factor: float = 1.0, nodata: float = DENSITY_NODATA, lat_limit: float = DENSITY_LAT_LIMIT,
) -> tuple[DataFrame, bool]:
    """The subset as a Parquet dataset keyed by request; the flag tells a cache hit."""
    spark = cells.sparkSession
    key = density_request_key(source_sha256, frame, density_window(bbox, buffer_degrees, lat_limit), factor, nodata)
    path = f"{cache_root.rstrip('/')}/density-{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    hit = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if not hit:
        density_subset(cells, frame, bbox, buffer_degrees, factor, nodata, lat_limit).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), hit


def fill_nodata(cells: DataFrame, nodata: float, reach: int = FILL_REACH) -> DataFrame:
    """Nodata cells take the nearest valid value within ``reach`` cells; others stay nodata.

    Only the nodata cells ask their (at most 28) neighbours; ties go to the upper-left one.
    """
    offsets = [
        (dr, dc, dr * dr + dc * dc)
        for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1)
        if 0 < dr * dr + dc * dc <= reach * reach
    ]
    ring = F.array(*[
        F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(d).alias("d")) for dr, dc, d in offsets
    ])
    holes = cells.filter(F.col("value") == nodata).select("grid_row", "grid_col")
    asks = holes.withColumn("o", F.explode(ring)).select(
        F.col("grid_row").alias("r0"), F.col("grid_col").alias("c0"),
        (F.col("grid_row") + F.col("o.dr")).alias("grid_row"),
        (F.col("grid_col") + F.col("o.dc")).alias("grid_col"), F.col("o.d").alias("d"),
    )
    known = cells.filter(F.col("value") != nodata)
    nearest = (
        asks.join(known, ["grid_row", "grid_col"])
        .groupBy("r0", "c0")
        .agg(F.min_by("value", F.struct("d", "grid_row", "grid_col")).alias("fill"))
        .withColumnsRenamed({"r0": "grid_row", "c0": "grid_col"})
    )
    return cells.join(nearest, ["grid_row", "grid_col"], "left").select(
        "grid_row", "grid_col",
        F.when(F.col("value") == nodata, F.coalesce("fill", "value")).otherwise(F.col("value")).alias("value"),
    )


def depth_class(depth: Column) -> Column:
    """Class of a depth in metres (negative below the surface); NULL for land."""
    out = None
    for name, _, upper in DEPTH_CLASSES:
        cond = depth <= upper
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def depth_areas(cells: DataFrame) -> DataFrame:
    return (
        cells.withColumn("depth_class", depth_class(F.col("value")))
        .filter(F.col("depth_class").isNotNull())
        .groupBy("depth_class")
        .agg(F.count("*").alias("cells"), F.min("value").alias("deepest"), F.max("value").alias("shallowest"))
    )


def canonical_columns(cells: DataFrame, left: float, px: float) -> DataFrame:
    """Columns of a 0..360 raster moved to the −180..180 frame (cells off the frame drop)."""
    x = F.lit(left) + (F.col("grid_col") + 0.5) * px
    folded = F.pmod(x + 180.0, F.lit(360.0)) - 180.0
    col = F.floor((folded + 180.0) / px).cast("long")
    return cells.withColumn("grid_col", col).filter(
        (F.col("grid_col") >= 0) & (F.col("grid_col") < round_half(360.0 / px)))


def density_ramp(cells: DataFrame, nodata: float = DENSITY_NODATA) -> DataFrame:
    """Legend bin of each cell that holds a number, relative to the maximum of the band (at least 1)."""
    valid = cells.filter(usable(F.col("value"), nodata))
    top = F.greatest(F.lit(1.0), F.coalesce(valid.agg(F.max("value")).scalar(), F.lit(1.0)))
    v = F.col("value")
    # Legend texts.
    names = ("No recorded density", "Lower", "Moderate", "Common corridor", "Highest")
    ramp = F.when(v <= 0, names[0])
    for name, step in zip(names[1:], DENSITY_STEPS):
        ramp = ramp.when(v <= top * step, name)
    return valid.withColumn("ramp", ramp.otherwise(names[-1]))


def invalid_cells(cells: DataFrame, nodata: float) -> DataFrame:
    bad = F.col("value").isNull() | F.isnan("value") | (F.col("value") == nodata)
    return cells.agg(F.count("*").alias("cells"), F.count_if(bad).alias("invalid_cells"))


def _squares(cells: DataFrame, levels: Sequence[float], nodata: float | None) -> DataFrame:
    """Pieces ``s`` (from ``a`` to ``b``, the higher side on the left) of every square of four cells and
    level. The ends carry the edge of the grid on which they lie, which two squares share."""
    if len(levels) > 64:
        raise ValueError("at most 64 levels at a time")
    corner = F.array(*[
        F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(2 * dr + dc).alias("k"))
        for dr in (0, 1) for dc in (0, 1)
    ])
    squares = (
        cells.filter(usable(F.col("value"), nodata)).withColumn("o", F.explode(corner))
        .groupBy((F.col("grid_row") + F.col("o.dr")).alias("grid_row"), (F.col("grid_col") + F.col("o.dc")).alias("grid_col"))
        .agg(*[F.max(F.when(F.col("o.k") == k, F.col("value"))).alias(n) for k, n in enumerate(("nw", "ne", "sw", "se"))])
        .filter("nw IS NOT NULL AND ne IS NOT NULL AND sw IS NOT NULL AND se IS NOT NULL")
        .select("*", F.posexplode(F.array(*[F.lit(float(v)) for v in sorted(levels)])).alias("level_no", "level"))
    )
    lv = F.col("level")
    up = {n: F.col(n) >= lv for n in ("nw", "ne", "sw", "se")}

    def end(p: str, q: str, dr: int, dc: int, upright: bool) -> Column:
        """Where the level lies between the corners p and q, which follow each other clockwise; the
        edge begins dr rows and dc columns from the square's corner."""
        low, high = (p, q) if p == "nw" or q == "se" else (q, p)  # left to right or downwards
        share = (lv - F.col(low)) / (F.col(high) - F.col(low))
        x = F.lit(float(dc)) if upright else share
        y = share if upright else F.lit(float(dr))
        half = 1 << 27
        place = F.shiftleft(F.col("level_no").cast("long"), 57).bitwiseOR(
            F.shiftleft((F.col("grid_row") + (dr + half)).cast("long"), 29)).bitwiseOR(
            F.shiftleft((F.col("grid_col") + (dc + half)).cast("long"), 1)).bitwiseOR(F.lit(int(upright)).cast("long"))
        return F.when(up[p] != up[q], F.struct(
            (F.col("grid_col") + x).cast("double").alias("x"), (F.col("grid_row") + y).cast("double").alias("y"),
            place.alias("edge"), up[p].alias("out")))  # with the higher side on the left, a line leaves here

    top, right = end("nw", "ne", 0, 0, False), end("ne", "se", 0, 1, True)
    bottom, left = end("se", "sw", 1, 0, False), end("sw", "nw", 0, 0, True)

    def piece(a: Column, b: Column) -> Column:
        return F.when(b["out"], F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(b.alias("a"), a.alias("b")))

    hits = F.array_compact(F.array(top, right, bottom, left))
    centre_up = (F.col("nw") + F.col("ne") + F.col("sw") + F.col("se")) / 4 >= lv
    saddle = F.when(centre_up == up["nw"], F.array(piece(top, right), piece(left, bottom))).otherwise(
        F.array(piece(top, left), piece(right, bottom)))
    pieces = F.when(F.size(hits) == 4, saddle).when(F.size(hits) == 2, F.array(piece(hits[0], hits[1])))
    return squares.select("level", "grid_row", "grid_col", F.explode(pieces).alias("s"))


def contours(cells: DataFrame, levels: Sequence[float], nodata: float | None = None) -> DataFrame:
    """Line pieces where the surface crosses each level (marching squares).

    Squares are formed by letting each cell centre join its four squares in one aggregate; cells
    without a number (NULL, NaN, infinite or ``nodata``) give none. Output: (level, grid_row,
    grid_col, x1, y1, x2, y2) in cell coordinates, the higher side on the left. The two pieces of
    a saddle are told apart by the mean of its corners.
    """
    return _squares(cells, levels, nodata).select(
        "level", "grid_row", "grid_col", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"),
        F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


#: Rows and columns of the squares whose pieces one task chains.
CONTOUR_TILE = 256


def contour_lines(
    cells: DataFrame, levels: Sequence[float], nodata: float | None = None, tile: int = CONTOUR_TILE,
) -> DataFrame:
    """Vertices of the contour lines: (level, line_id, position, x, y, closed), one row each.

    A line runs with the higher side on its left; ``position`` counts from 0. The first vertex of a
    closed line is repeated as its last. Lines end where the raster or its numbers end. Neither
    ``line_id`` nor the order depends on ``tile`` or on how the table is partitioned. Rows and
    columns lie within 2^27 of zero.
    """
    pieces = _squares(cells, levels, nodata).select(
        "level", "grid_row", "grid_col", F.col("s.a.edge").alias("start"), F.col("s.b.edge").alias("stop"),
        F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    lines = ordered_pieces(pieces, [F.col("level"), F.floor(F.col("grid_row") / tile), F.floor(F.col("grid_col") / tile)])

    def vertex(position: Column, end: int) -> Column:
        return F.struct(position.alias("position"), F.col(f"x{end}").alias("x"), F.col(f"y{end}").alias("y"))

    here = F.array(vertex(F.col("position"), 1))
    ends = F.array(vertex(F.col("position"), 1), vertex(F.col("total"), 2))
    return lines.select("level", "line_id", F.explode(F.when(F.col("position") == F.col("total") - 1, ends).otherwise(here)).alias("v"), "closed").select(
        "level", "line_id", "v.position", "v.x", "v.y", "closed")
