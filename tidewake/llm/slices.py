"""Order-preserving slices of a table by an integer key.

A global order is cut at quantiles of the key, so that a slice is a bounded part of the rows
whatever the spacing of the keys. The cuts are the only thing the driver holds: their number
is bounded by ``MOST_SLICES``, beyond which slices grow instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SLICES = 65_536


def quantile_cuts(df: DataFrame, key: str, rows_per_slice: int) -> list[int]:
    """Sorted distinct lower bounds of the second and later slices.

    NULL keys are not counted; an empty table has no cuts. One pass for the count, one for the
    quantiles; both read the key column only.
    """
    rows = df.agg(F.count(key)).first()[0]
    slices = min(MOST_SLICES, math.ceil(rows / rows_per_slice))
    if slices < 2:
        return []
    shares = [i / slices for i in range(1, slices)]
    cuts = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * slices))).first()[0]
    return sorted({int(c) for c in cuts})


def slice_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below ``key`` (0 for NULL): a two-level search in a literal array."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts) - 1) + 1
    array = lambda values: F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")
    top, every = array(cuts[::width]), array(cuts)
    block = F.size(F.filter(top, lambda c: c <= key))
    inner = F.size(F.filter(F.slice(every, (block - 1) * width + 1, F.lit(width)), lambda c: c <= key))
    return F.when(key.isNull() | (block == 0), 0).otherwise((block - 1) * width + inner).cast("int")
