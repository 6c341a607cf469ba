"""Ordered scans whose parallelism does not depend on the size of a key.

A plain ``lag`` or running sum over ``PARTITION BY vessel`` puts a vessel's whole history
into one task. Here the order is cut into slices (for example one day), the window runs per
(key, slice), and what a slice needs from the slices before it comes from a summary with one
row per (key, slice). Only that summary, never the rows, is windowed per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.session import stage


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def time_slice(ts: Column, width_seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(width_seconds * 1_000_000)).cast("long")


def order_slice(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width)).cast("long")


#: Bits of a slice number that count the parts of a time slice.
PART_BITS = 20
#: Sampled rows between two cuts; a part's size varies by about an eighth.
SAMPLES = 64


def by_size(df: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with at most ``most`` rows, and those of all others (None where there are none).

    A key of the first kind fits one window, so its rows move once and need no slices or summary.
    At most one key in ``most`` rows is of the other kind, so their list is short. Keys must be non-null.
    """
    counts = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    large = stage(counts.where(F.col("__n") > most).select("__key"))
    if not large.take(1):
        return df, None
    on = F.col(key) == F.col("__key")
    return df.join(large, on, "left_anti"), df.join(large, on, "left_semi")


def slice_start(part: Column, width_seconds: int) -> Column:
    """Microseconds at which the time slice of a :func:`bounded_slices` number begins."""
    return F.shiftright(part, PART_BITS) * F.lit(width_seconds * 1_000_000)


def bounded_slices(df: DataFrame, key: str, time: str, order: str, width_seconds: int, slice_rows: int) -> DataFrame:
    """``df`` with ``slice``, which ascends with (``time``, ``order``) in each key: time slices of a fixed width,
    those of more than ``slice_rows`` rows cut into parts of about so many.

    Rows are counted per key and time slice first. Only where there are too many, every
    ``slice_rows / 64``-th row by hash is sampled and every 64th of the samples in order becomes a
    cut, so cuts follow the rows however they bunch, down to rows of one instant. Nothing else
    depends on the sample. Without a full slice the cost is one count.
    """
    base = df.withColumn("slice", F.shiftleft(time_slice(F.col(time), width_seconds), PART_BITS))
    full = base.groupBy(key, "slice").agg(F.count("*").alias("__n")).where(F.col("__n") > slice_rows).select(
        F.col(key).alias("__key"), F.col("slice").alias("__slice"))
    if not full.take(1):
        return base
    full = stage(full)
    step = max(1, slice_rows // SAMPLES)
    every = max(1, slice_rows // step)
    point = F.struct(micros(F.col(time)).alias("t"), F.col(order).cast("long").alias("o"))
    sample = base.where(F.pmod(F.xxhash64(order), F.lit(step)) == 0).select(key, "slice", point.alias("__at"))
    sample = sample.join(full, (F.col(key) == F.col("__key")) & (F.col("slice") == F.col("__slice"))).select("__key", "__slice", "__at")
    nth = F.row_number().over(Window.partitionBy("__key", "__slice").orderBy("__at"))
    cuts = sample.withColumn("__nth", nth).where(F.col("__nth") % every == 0).groupBy("__key", "__slice").agg(
        F.sort_array(F.collect_list("__at")).alias("__cuts"))
    # two levels, so that a row looks at the square root of the cuts twice
    width = F.ceil(F.sqrt(F.size("__cuts"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__cuts") - 1) / F.col("__width")).cast("int")),
                         lambda i: F.slice("__cuts", i * F.col("__width") + 1, F.col("__width")))
    cuts = stage(cuts.withColumn("__width", width).withColumn("__blocks", blocks).select(
        "__key", "__slice", "__width", "__blocks", F.transform("__blocks", lambda b: b[0]).alias("__top")))
    joined = base.join(cuts, (F.col(key) == F.col("__key")) & (F.col("slice") == F.col("__slice")), "left")
    block = F.size(F.filter("__top", lambda c: c <= point))
    inner = F.size(F.filter(F.get("__blocks", block - 1), lambda c: c <= point))
    part = F.when(F.col("__key").isNull() | (block == 0), 0).otherwise((block - 1) * F.col("__width") + inner)
    return joined.withColumn("slice", F.col("slice") + part.cast("long")).drop("__key", "__slice", "__width", "__blocks", "__top")


def slice_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def attach(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join a per-(key, slice) summary back to its rows.

    The rows are already hash-partitioned on ``keys`` by the slice window, so only the
    summary moves. Keys must be non-null.
    """
    renamed = summary.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [df[k] == renamed[f"__{k}"] for k in keys]
    return df.join(renamed, on, "left").drop(*[f"__{k}" for k in keys])


def last_value_before(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: str, value: str, out: str
) -> DataFrame:
    """Last non-null ``value`` strictly before each row in ``order``, per key."""
    spec = slice_window([*keys, slice_col], [order])
    local = df.withColumn(
        "__local", F.last(value, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, -1))
    )
    summary = df.groupBy(*keys, slice_col).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__tail")
    )
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *keys, slice_col, F.last("__tail", ignorenulls=True).over(before).alias("__carry")
    )
    joined = attach(local, summary, [*keys, slice_col])
    return joined.withColumn(out, F.coalesce("__local", "__carry")).drop("__local", "__carry")


def previous_value(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: str, value: Column, out: str
) -> DataFrame:
    """``value`` of the row before each row in ``order``, per key (a sliced ``lag``)."""
    held = df.withColumn("__v", value)
    local = held.withColumn("__local", F.lag("__v").over(slice_window([*keys, slice_col], [order])))
    summary = held.groupBy(*keys, slice_col).agg(F.max_by("__v", order).alias("__tail"))
    summary = summary.select(
        *keys, slice_col,
        F.lag("__tail").over(Window.partitionBy(*keys).orderBy(slice_col)).alias("__carry"),
    )
    joined = attach(local, summary, [*keys, slice_col])
    return joined.withColumn(out, F.coalesce("__local", "__carry")).drop("__local", "__carry", "__v")


def previous_and_count(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: str, value: Column,
    opens: Callable[[Column, Column], Column], prev_out: str, count_out: str,
) -> DataFrame:
    """The previous ``value`` and the running count of rows where ``opens(prev, cur)`` holds.

    Both come from one summary. ``opens`` sees a NULL ``prev`` at the first row of a key.
    """
    spec = slice_window([*keys, slice_col], [order])
    held = df.withColumn("__v", value)
    local = held.withColumn("__local", F.lag("__v").over(spec))
    inner = F.col("__local").isNotNull() & opens(F.col("__local"), F.col("__v"))
    local = local.withColumn("__open", F.coalesce(inner, F.lit(False)).cast("long"))
    summary = local.groupBy(*keys, slice_col).agg(
        F.min_by("__v", order).alias("__head"), F.max_by("__v", order).alias("__tail"), F.sum("__open").alias("__inner"))
    by_key = Window.partitionBy(*keys).orderBy(slice_col)
    fresh = F.coalesce(opens(F.col("__carry"), F.col("__head")), F.lit(False)).cast("long")
    summary = (
        summary.withColumn("__carry", F.lag("__tail").over(by_key))
        .withColumn("__fresh", fresh)
        .withColumn("__before", F.sum(F.col("__inner") + F.col("__fresh")).over(by_key) - F.col("__inner"))
        .select(*keys, slice_col, "__carry", "__before")
    )
    joined = attach(local.withColumn("__n", F.sum("__open").over(spec)), summary, [*keys, slice_col])
    return joined.withColumns({
        prev_out: F.coalesce("__local", "__carry"), count_out: F.col("__before") + F.col("__n"),
    }).drop("__v", "__local", "__open", "__n", "__carry", "__before")


def running_sum(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: str, value: str, out: str,
    total: str | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` per key, optionally with the total."""
    local = df.withColumn("__local", F.sum(value).over(slice_window([*keys, slice_col], [order])))
    summary = df.groupBy(*keys, slice_col).agg(F.sum(value).alias("__sum"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carry")]
    if total:
        columns.append(F.sum("__sum").over(by_key).alias(total))
    joined = attach(local, summary.select(*keys, slice_col, *columns), [*keys, slice_col])
    return joined.withColumn(out, F.col("__carry") + F.col("__local")).drop("__carry", "__local")


def row_index(df: DataFrame, slice_col: str, order: str, out: str, total: str | None = None) -> DataFrame:
    """Zero-based position of each row in a global order, without a global sort.

    Rows are numbered inside their slice; the offset is the running count of earlier slices
    (one summary row per slice).
    """
    local = df.withColumn("__n", F.row_number().over(slice_window([slice_col], [order])))
    counts = df.groupBy(slice_col).agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(F.lit(0)).orderBy(slice_col)
    columns = [
        slice_col,
        (F.sum("__rows").over(before) - F.col("__rows")).alias("__offset"),
    ]
    if total:
        columns.append(F.sum("__rows").over(Window.partitionBy(F.lit(0))).alias(total))
    joined = attach(local, counts.select(*columns), [slice_col])
    return joined.withColumn(out, F.col("__offset") + F.col("__n") - 1).drop("__n", "__offset")
