"""Order of linked pieces: which line a piece belongs to, and where in it the piece stands.

Every piece leads from one point to another; a point is the start of one piece at most and the
stop of one at most, so the pieces form open lines and rings. Pieces of a tile are chained in one
task. What leaves a tile is one row per open chain, and these are ranked by pointer doubling:
each round every chain learns of twice as many of its predecessors, so a line over a million
tiles takes twenty rounds, and no line is ever gathered in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.session import stage


def tile_chains(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece the index of its chain's first piece, its place in the chain, and whether the
    chain is a ring. A ring begins at the piece of the smallest start."""
    n = len(start)
    order = np.argsort(stop, kind="stable")
    at = np.minimum(np.searchsorted(stop, start, sorter=order), max(0, n - 1))
    before = np.where(stop[order[at]] == start, order[at], -1)
    ring = np.zeros(n, bool)
    while True:
        reach = np.where(before < 0, np.arange(n), before)
        place = (before >= 0).astype(np.int64)
        least = start.copy()
        for _ in range(max(1, n).bit_length() + 1):
            least = np.minimum(least, least[reach])
            place = place + place[reach]
            reach = reach[reach]
        endless = before[reach] >= 0
        if not endless.any():
            return reach, place, ring
        ring |= endless
        before[endless & (least == start)] = -1


def _chained(pieces: pd.DataFrame) -> pd.DataFrame:
    """Pieces of a tile with chain, place and, on a chain's first piece, its summary."""
    start, stop = pieces["start"].to_numpy(np.int64), pieces["stop"].to_numpy(np.int64)
    first, place, ring = tile_chains(start, stop)
    out = pieces.assign(chain=start[first], place=place, ring=ring)
    order = np.lexsort((place, first))
    heads = np.flatnonzero(place[order] == 0)
    ends = np.append(heads[1:], len(order))
    lowest = np.minimum.reduceat(start[order], heads)
    low_at = np.zeros(len(pieces), np.int64)
    is_low = start[order] == np.repeat(lowest, ends - heads)
    low_at[first[order[is_low]]] = place[order[is_low]]
    summary = {"pieces": ends - heads, "last": stop[order[ends - 1]], "low": lowest, "low_at": low_at[order[heads]]}
    for name, values in summary.items():
        column = np.zeros(len(pieces), np.int64)
        column[order[heads]] = values
        out[name] = column
    return out


def _doubled(state: DataFrame) -> DataFrame:
    """Rounds of doubling until every chain knows its line's first one (``done``) or only rings are
    left, whose ``least`` is then that of the ring."""
    known = None
    while True:
        seen = state.where("NOT done").agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("first", "least")), F.lit(0))).first()
        if seen[0] == 0 or tuple(seen) == known:
            return state
        known = tuple(seen)
        ahead = state.select(*[F.col(c).alias(f"a_{c}") for c in ("first", "reach", "before", "least", "done")])
        moved = state.where("NOT done").join(ahead, F.col("reach") == F.col("a_first")).select(
            *[c for c in state.columns if c not in ("reach", "before", "least", "done")],
            F.col("a_reach").alias("reach"), (F.col("before") + F.col("a_before")).alias("before"),
            F.least("least", "a_least").alias("least"), F.col("a_done").alias("done"))
        state = stage(state.where("done").unionByName(moved))


def rank_chains(chains: DataFrame) -> DataFrame:
    """``chain``, ``line_id``, ``skip``, ``total``, ``closed`` of chains ``first``, ``last``, ``pieces``, ``low``,
    ``low_at``: a piece at ``place`` of a chain stands at ``place + skip`` (modulo ``total``) of its line."""
    before = chains.select(F.col("last").alias("__at"), F.col("first").alias("prior"), F.col("pieces").alias("prior_pieces"))
    linked = chains.join(before, F.col("first") == F.col("__at"), "left").drop("__at")
    zero = F.lit(0).cast("long")

    def begin(head: Column):
        return {"reach": F.when(head, F.col("first")).otherwise(F.col("prior")), "before": F.when(head, zero).otherwise(F.col("prior_pieces")),
                "least": F.col("low"), "done": head}

    state = _doubled(stage(linked.withColumns(begin(F.col("prior").isNull()))))
    rings = state.where("NOT done")
    lines = state.where("done").withColumn("closed", F.lit(False))
    if rings.take(1):
        opened = rings.withColumn("opens", F.col("least") == F.col("low"))
        closed = _doubled(stage(opened.withColumns(begin(F.col("opens"))).drop("opens")))
        lines = stage(lines.unionByName(closed.withColumn("closed", F.lit(True))))
    lows = F.min_by(F.col("before") + F.col("low_at"), "low")
    totals = lines.groupBy(F.col("reach").alias("line")).agg(
        F.sum("pieces").alias("total"), F.when(F.first("closed"), lows).otherwise(zero).alias("shift"),
        F.when(F.first("closed"), F.min("low")).otherwise(F.col("line")).alias("line_id"))
    return lines.join(totals, F.col("reach") == F.col("line")).select(
        F.col("first").alias("__chain"), "line_id", (F.col("before") - F.col("shift")).alias("skip"), "total", "closed")


def ordered_pieces(pieces: DataFrame, tile: list[Column]) -> DataFrame:
    """``pieces`` (``start``, ``stop`` and further columns) with ``line_id``, ``position`` (from 0), ``total`` and
    ``closed``. The line of an open one is named by its first point, a ring by its smallest, where
    it also begins; neither depends on the tiles. A tile must have a bounded number of pieces."""
    names = [f"__t{i}" for i in range(len(tile))]
    keyed = pieces.select("*", *[t.alias(n) for n, t in zip(names, tile)])
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    extra = "chain long, place long, ring boolean, pieces long, last long, low long, low_at long"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return _chained(part.drop(columns=names))

    chained = stage(keyed.groupBy(*names).applyInPandas(run, f"{layout}, {extra}"))
    heads = chained.where("place = 0 AND NOT ring").select(F.col("chain").alias("first"), "last", "pieces", "low", "low_at")
    ranks = rank_chains(heads)
    rings = chained.where("ring")
    # a ring within a tile begins at its smallest start already
    sizes = rings.where("place = 0").select(F.col("chain").alias("__chain"), F.col("pieces").alias("total"))
    kept = pieces.columns
    inner = rings.drop("pieces").join(sizes, F.col("chain") == F.col("__chain")).select(
        *kept, F.col("chain").alias("line_id"), F.col("place").alias("position"), "total", F.lit(True).alias("closed"))
    outer = chained.where("NOT ring").join(ranks, F.col("chain") == F.col("__chain")).select(
        *kept, "line_id", F.pmod(F.col("place") + F.col("skip"), F.col("total")).alias("position"), "total", "closed")
    return inner.unionByName(outer)
