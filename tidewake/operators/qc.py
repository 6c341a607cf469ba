"""Deterministic position, time and identity quality control."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.geo import (
    KNOTS_PER_MPS,
    MAX_DISTANCE_M,
    SPHERE_HIGH,
    SPHERE_LOW,
    geodesic_m,
    geodesic_scalar,
    haversine_m,
    haversine_scalar,
)
from tidewake.functions.identity import malformed_identifier
from tidewake.plans.ordered import (
    attach,
    bounded_slices,
    by_size,
    last_value_before,
    micros,
    order_slice,
    seconds_between,
    slice_start,
    slice_window,
)
from tidewake.operators.normalize import parse_time
from tidewake.schema import ACTOR_TYPES, OBSERVATION_STATES, QualityConfig, blank, conform
from tidewake.session import stage


def prepare(observations: DataFrame) -> DataFrame:
    """Canonical columns plus the parsed ``event_time`` and a trimmed entity key."""
    df = conform(observations)
    if "event_time" not in df.columns:
        df = df.withColumn("event_time", parse_time(F.col("timestamp_start")))
    if "source_order" not in df.columns:
        raise ValueError("observations need a source_order column (see sources.observations)")
    return df.withColumn("entity_key", F.trim(F.coalesce("entity_id", F.lit(""))))


# --- row checks -------------------------------------------------------------------------------


def invalid_coordinate(lat: Column, lon: Column) -> Column:
    return ~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def row_rules() -> list[tuple[str, str, Column, Column]]:
    """(flag, severity, condition, detail); ERROR findings exclude the row."""
    state = F.coalesce(F.col("observed_or_inferred"), F.lit(""))
    actor = F.when(blank(F.col("actor_type")), "UNKNOWN").otherwise(F.col("actor_type"))
    return [
        ("INVALID_COORDINATE", "ERROR", invalid_coordinate(F.col("latitude"), F.col("longitude")),
         F.lit("latitude/longitude absent or out of range")),
        ("MISSING_TIME", "ERROR", F.col("event_time").isNull(), F.lit("timestamp cannot be parsed")),
        ("MISSING_VESSEL_IDENTITY", "ERROR", blank(F.col("entity_id")), F.lit("no entity")),
        ("MALFORMED_MMSI", "ERROR", malformed_identifier("MMSI", F.col("MMSI")), F.col("MMSI")),
        ("MALFORMED_IMO", "ERROR", malformed_identifier("IMO", F.col("IMO")), F.col("IMO")),
        ("UNKNOWN_ACTOR_TYPE", "WARNING", ~actor.isin(*ACTOR_TYPES), actor),
        ("UNKNOWN_OBSERVATION_STATE", "ERROR", ~state.isin(*OBSERVATION_STATES), state),
    ]


def _row_mask() -> Column:
    """Bit i is set where rule i fires: a number to test instead of a list to search."""
    mask = F.lit(0)
    for i, (_, _, cond, _) in enumerate(row_rules()):
        mask = mask + F.when(cond, F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def _error_bits() -> int:
    return sum(1 << i for i, (_, severity, _, _) in enumerate(row_rules()) if severity == "ERROR")


def _row_findings() -> Column:
    return F.array_compact(F.array(*[
        F.when(cond, F.struct(
            F.lit(flag).alias("flag"), F.lit(severity).alias("severity"),
            detail.cast("string").alias("detail"), F.lit(severity == "ERROR").alias("excluded")))
        for flag, severity, cond, detail in row_rules()
    ]))


def _explode_findings(df: DataFrame, found: Column) -> DataFrame:
    return df.select(
        "observation_id", "entity_id", "source_order", F.explode(found).alias("f")
    ).select("observation_id", "entity_id", "source_order", "f.*")


def row_flags(observations: DataFrame) -> DataFrame:
    """Flags that need only the row itself; one pass, no shuffle."""
    flagged = prepare(observations).withColumn("mask", _row_mask()).filter("mask <> 0")
    return _explode_findings(flagged, _row_findings())


# --- duplicates -------------------------------------------------------------------------------


def duplicate_key(df: DataFrame) -> list[Column]:
    """Raw time text where the source has it, the parsed time otherwise."""
    moment = F.coalesce(F.col("timestamp_start"), micros(F.col("event_time")).cast("string"))
    return [
        F.col("entity_id").alias("k_entity"), moment.alias("k_time"),
        F.col("latitude").alias("k_lat"), F.col("longitude").alias("k_lon"),
        F.col("source_record_id").alias("k_record"),
    ]


def mark_duplicates(df: DataFrame) -> DataFrame:
    """Add ``is_duplicate``: an earlier row (source order) has the same canonical key.

    The first row of each repeated key comes from a partial aggregate, so a key held by a
    large share of all rows is combined map-side; only keys that do repeat are joined back.
    """
    key = duplicate_key(df)
    names = ["k_entity", "k_time", "k_lat", "k_lon", "k_record"]
    repeated = (
        df.select(*key, "source_order")
        .groupBy(*names)
        .agg(F.min("source_order").alias("first_order"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    keyed = df.select("*", *[k.alias(f"__{n}") for n, k in zip(names, key)])
    on = [keyed[f"__{n}"].eqNullSafe(repeated[n]) for n in names]
    return (
        keyed.join(repeated.hint("shuffle_hash"), on, "left")
        .withColumn("is_duplicate", F.coalesce(F.col("source_order") > F.col("first_order"), F.lit(False)))
        .drop("first_order", *names, *[f"__{n}" for n in names])
    )


def duplicate_flags(observations: DataFrame) -> DataFrame:
    narrow = prepare(observations).select(
        "observation_id", "entity_id", "source_order", "timestamp_start", "event_time",
        "latitude", "longitude", "source_record_id",
    )
    return _duplicates(mark_duplicates(narrow))


def _duplicates(marked: DataFrame) -> DataFrame:
    return _flags(
        marked.filter("is_duplicate"), "DUPLICATE_OBSERVATION", "ERROR",
        F.lit("same entity, time, position and record id as an earlier row"),
    )


def screen(observations: DataFrame) -> DataFrame:
    """Narrow table of all that quality control needs to know about a row.

    Row findings, the duplicate mark and ``barred`` (excluded before any sequence check).
    Everything else in this module reads this table instead of the wide input.
    """
    df = mark_duplicates(prepare(observations)).withColumn("mask", _row_mask())
    return df.select(
        "observation_id", "entity_id", "entity_key", "source_order",
        F.col("event_time").cast("timestamp").alias("event_time"), "latitude", "longitude",
        F.when(F.col("mask") != 0, _row_findings()).alias("found"), "is_duplicate",
        ((F.col("mask").bitwiseAND(_error_bits()) != 0) | F.col("is_duplicate")).alias("barred"),
    )


def _flags(df: DataFrame, flag: str, severity: str, detail: Column) -> DataFrame:
    return df.select(
        "observation_id", "entity_id", "source_order", F.lit(flag).alias("flag"),
        F.lit(severity).alias("severity"), detail.alias("detail"),
        F.lit(severity == "ERROR").alias("excluded"),
    )


# --- time order -------------------------------------------------------------------------------


def disorder_flags(observations: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Rows whose time is before the last known time of the vessel in source order."""
    return _disorder(prepare(observations), config)


def _disorder(prepared: DataFrame, config: QualityConfig) -> DataFrame:
    rows = prepared.select(
        "observation_id", "entity_id", "entity_key", "source_order", "event_time",
        order_slice(F.col("source_order"), config.source_slice).alias("slice"),
    )
    small, large = by_size(rows, "entity_key", config.slice_rows)
    before = slice_window(["entity_key"], ["source_order"]).rowsBetween(Window.unboundedPreceding, -1)
    seen = small.withColumn("seen", F.last("event_time", ignorenulls=True).over(before))
    if large is not None:
        seen = seen.unionByName(last_value_before(large, ["entity_key"], "slice", "source_order", "event_time", "seen"))
    return _flags(
        seen.filter(F.col("event_time") < F.col("seen")), "TIMESTAMP_DISORDER", "WARNING",
        F.lit("earlier than the row before it"),
    )


# --- sequence checks --------------------------------------------------------------------------


def tested_pairs(observations: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Pairs of :func:`screened_pairs` straight from observations."""
    return screened_pairs(screen(observations), config)


def screened_pairs(screened: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Each row that is compared with the last accepted position of its vessel.

    A row that fails the speed test does not become the reference of the next one, so the
    result is a sequential fold. Almost all rows do not need it: as long as no adjacent pair
    failed within the time a vessel at the speed limit needs to reach any point on Earth,
    the last accepted row *is* the adjacent row. Only the rows within that horizon of an
    adjacent failure (and the one row after them) go through :func:`folded_pairs`; of vessels with
    more than ``slice_rows`` rows, the slices within it and the one slice after them.
    """
    rows = screened.filter(F.col("event_time").isNotNull() & (F.col("entity_key") != "")).select(
        "entity_id", "entity_key", "observation_id", "source_order", "event_time", "latitude", "longitude", "barred")
    horizon_us = int(MAX_DISTANCE_M / (config.max_speed_knots / KNOTS_PER_MPS) * 1e6) + 1_000_000
    order = ["event_time", "source_order"]
    point = F.struct("event_time", "latitude", "longitude", "barred", "source_order")

    def gap(prev: Column, cur: Column) -> Column:
        open_pair = ~prev["barred"] & ~cur["barred"]
        seconds = seconds_between(cur["event_time"], prev["event_time"])
        return F.when(open_pair & (seconds > 0), seconds)

    def sphere(prev: Column, cur: Column) -> Column:
        return haversine_m(prev["longitude"], prev["latitude"], cur["longitude"], cur["latitude"])

    def jump(prev: Column, cur: Column) -> Column:
        # an upper bound of the speed: a needless hit only widens the fold's share
        reach = sphere(prev, cur) * (1.0 if config.distance == "haversine" else SPHERE_HIGH)
        return reach / gap(prev, cur) * KNOTS_PER_MPS > config.max_speed_knots

    def within(rows: DataFrame) -> DataFrame:
        spec = slice_window(["entity_key"], order)
        upto = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (
            rows.withColumn("prev", F.lag(point).over(spec))
            .withColumn("last_hit", F.max(F.when(jump(F.col("prev"), point), micros(F.col("event_time")))).over(upto))
            .withColumn("near", F.coalesce(micros(F.col("event_time")) <= F.col("last_hit") + F.lit(horizon_us), F.lit(False)))
            .withColumn("zone", F.col("near") | F.coalesce(F.lag("near").over(spec), F.lit(False)))
            .withColumn("opens", F.col("zone") & ~F.coalesce(F.lag("zone").over(spec), F.lit(False)))
            .withColumn("island", F.when(F.col("zone"), F.sum(F.col("opens").cast("long")).over(upto)))
            .withColumn("piece", F.lit(0).cast("long"))
            .withColumn("alone", F.lit(True))
            .drop("last_hit", "near", "zone", "opens")
        )

    def over_slices(rows: DataFrame) -> DataFrame:
        rows = bounded_slices(rows, "entity_key", "event_time", "source_order", config.slice_seconds, config.slice_rows)
        spec = slice_window(["entity_key", "slice"], order)
        local = rows.withColumn("prev_local", F.lag(point).over(spec))
        ordinal = F.struct(*order)
        summary = local.groupBy("entity_key", "slice").agg(
            F.min_by(point, ordinal).alias("head"),
            F.max_by(point, ordinal).alias("tail"), F.count("*").alias("rows"),
            F.max(F.when(jump(F.col("prev_local"), point), micros(F.col("event_time")))).alias("hit"),
        )
        by_entity = Window.partitionBy("entity_key").orderBy("slice")
        by_island = Window.partitionBy("entity_key", "island")
        earlier = by_island.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        summary = (
            summary.withColumn("carry", F.lag("tail").over(by_entity))
            .withColumn("hit", F.greatest(
                "hit", F.when(jump(F.col("carry"), F.col("head")), micros(F.col("head.event_time")))))
            .withColumn("last_hit", F.last("hit", ignorenulls=True).over(by_entity))
            .withColumn("near", F.coalesce(
                slice_start(F.col("slice"), config.slice_seconds) <= F.col("last_hit") + F.lit(horizon_us), F.lit(False)))
            .withColumn("zone", F.col("near") | F.coalesce(F.lag("near").over(by_entity), F.lit(False)))
            .withColumn("opens", F.col("zone") & ~F.coalesce(F.lag("zone").over(by_entity), F.lit(False)))
            .withColumn("island", F.when(F.col("zone"), F.sum(F.col("opens").cast("long")).over(by_entity)))
            .withColumn("piece", F.floor(F.coalesce(F.sum("rows").over(earlier), F.lit(0)) / config.slice_rows))
            .withColumn("alone", F.max("piece").over(by_island) == 0)
            .select("entity_key", "slice", "carry", "island", "piece", "alone")
        )
        return attach(local, summary, ["entity_key", "slice"]).withColumn("prev", F.coalesce("prev_local", "carry")).drop(
            "prev_local", "carry", "slice")

    small, large = by_size(rows, "entity_key", config.slice_rows)
    joined = within(small)
    if large is not None:
        joined = joined.unionByName(over_slices(large))
    joined = stage(joined)  # read for the rows without and with the fold
    calm = (
        joined.filter(F.col("island").isNull())
        .withColumn("gap_seconds", gap(F.col("prev"), point))
        .filter(F.col("gap_seconds").isNotNull())
        .select(
            "entity_id", "observation_id", "source_order",
            "event_time", F.col("prev.event_time").alias("prev_time"), "gap_seconds",
            "prev", "longitude", "latitude", sphere(F.col("prev"), point).alias("distance_m"),
        )
    )
    if config.distance == "geodesic":
        calm = calm.withColumn("distance_m", _refined(config))
    calm = calm.drop("prev", "longitude", "latitude")
    rough = folded_pairs(joined.filter(F.col("island").isNotNull()), config).select(
        "entity_id", "observation_id", "source_order",
        F.timestamp_micros("t").alias("event_time"), F.timestamp_micros("p_t").alias("prev_time"),
        ((F.col("t") - F.col("p_t")) / F.lit(1e6)).alias("gap_seconds"), "distance_m",
    )
    return calm.unionByName(rough).withColumn(
        "knots", F.col("distance_m") / F.col("gap_seconds") * KNOTS_PER_MPS
    )


def _refined(config: QualityConfig) -> Column:
    """Ellipsoidal distance where the spherical one cannot decide a threshold, or where its
    value is reported; the costly formula is evaluated for those rows only."""
    d, seconds = F.col("distance_m"), F.col("gap_seconds")
    unclear = (d * SPHERE_LOW < 1.0) & (d * SPHERE_HIGH >= 1.0)
    fast = d * SPHERE_HIGH / seconds * KNOTS_PER_MPS > config.max_speed_knots
    return F.when(unclear | fast, geodesic_m(
        F.col("prev.longitude"), F.col("prev.latitude"), F.col("longitude"), F.col("latitude"))).otherwise(d)


# A reference: the accepted row that the next one is compared with (``ref`` is its source order,
# -1 where there is none).
_REFERENCE = ("ref", "ref_t", "ref_lat", "ref_lon")
#: References that a piece tries ahead of time.
TRIED_AHEAD = 4


def folded_pairs(rows: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The sequential fold over islands of slices (``entity_key``, ``island``), cut into pieces side by side.

    A piece is as many slices in a row as hold about ``slice_rows`` rows together, which one task runs
    through. An island of one piece (``alone``) is settled by a single run, because the row before
    its first is its true reference; no rounds and no reports are needed. In longer ones all pieces start at once from a guess,
    the row before their first, and report the reference they end with. Following the pieces of
    an island, the true reference of each is known as far as the piece before has been run from
    *its* true one; pieces that lack theirs are run again from it. To keep an error from moving
    one piece a round, a piece also tries the other references its predecessor has ended with, a
    few at most: where two ships share an identity, each piece knows both chains after two
    rounds. In every round at least the first open piece of an island is settled. Only the pieces
    concerned are read again; reports have one row per piece and reference.
    """
    schema = (
        "kind int, entity_key string, island long, piece long, ref long, ref_t long, ref_lat double, ref_lon double, entity_id string, "
        "observation_id string, source_order long, t long, p_t long, distance_m double, lat double, lon double")
    flat = rows.select(
        "entity_key", "island", "piece", "alone", micros(F.col("event_time")).alias("t"), "source_order", "entity_id",
        "observation_id", "latitude", "longitude", "barred",
        F.when(F.col("prev.barred"), None).otherwise(F.col("prev.source_order")).alias("p_ref"),
        micros(F.col("prev.event_time")).alias("p_t"), F.col("prev.latitude").alias("p_lat"), F.col("prev.longitude").alias("p_lon"))

    keys = ["entity_key", "island", "piece"]

    def run(part: DataFrame, asked: DataFrame | None) -> DataFrame:
        if asked is None:
            part = part.withColumns({n: F.lit(None).cast("double" if n in ("ref_lat", "ref_lon") else "long") for n in _REFERENCE})
        else:
            asked = asked.select(*[F.col(k).alias(f"__{k}") for k in keys], *_REFERENCE)
            part = part.join(asked, _same(keys)).drop(*[f"__{k}" for k in keys])
        placed = part.drop("alone").repartition(*keys, "ref").sortWithinPartitions(*keys, "ref", "t", "source_order")
        return placed.mapInPandas(_fold(config), schema)

    alone = run(flat.filter("alone"), None).filter("kind = 0")
    flat = flat.filter("NOT alone")
    if not flat.take(1):
        return alone
    done = stage(run(flat, None))
    while True:
        reports = done.filter("kind = 1")
        plan = stage(reports.groupBy("entity_key", "island").applyInPandas(
            _follow, "entity_key string, island long, piece long, ref long, ref_t long, ref_lat double, ref_lon double, settled boolean"))
        asked = plan.filter("NOT settled")
        if not asked.take(1):
            break
        done = done.unionByName(stage(run(flat, asked)))
    true = plan.select(*[F.col(k).alias(f"__{k}") for k in (*keys, "ref")])
    return alone.unionByName(done.filter("kind = 0").join(true, _same([*keys, "ref"]), "left_semi"))


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])


def _follow(reports: pd.DataFrame) -> pd.DataFrame:
    """True references of an island's pieces, as far as they are known, and references to run from:
    the first one that is missing, and others that a later piece may need."""
    pieces: dict[int, dict[int, tuple]] = {}
    for r in reports.sort_values("piece", kind="stable").itertuples(index=False):
        pieces.setdefault(r.piece, {})[r.ref] = (
            (r.ref, r.ref_t, r.ref_lat, r.ref_lon), (r.source_order, r.t, r.lat, r.lon))
    entity, island, out, wanted = reports["entity_key"].iloc[0], reports["island"].iloc[0], [], {}
    before, reference = None, next(iter(pieces[min(pieces)].values()))[0]  # the first piece's guess is true
    for number, known in pieces.items():
        if reference is not None:
            if reference[0] in known:
                out.append((entity, island, number, *reference, True))
                reference = known[reference[0]][1]
            else:
                wanted[number, reference[0]] = reference
                reference = None
        if before is not None:
            ends = {end[0]: end for _, end in before.values()}
            for end in list(ends.values())[: max(0, TRIED_AHEAD - len(known))]:
                if end[0] not in known:
                    wanted.setdefault((number, end[0]), end)
        before = known
    # nothing is run ahead once all is settled
    if reference is None:
        out += [(entity, island, number, *r, False) for (number, _), r in wanted.items()]
    return pd.DataFrame(out, columns=["entity_key", "island", "piece", *_REFERENCE, "settled"])


def _fold(config: QualityConfig):
    """Fold over rows sorted by (vessel, piece, reference, time). Yields tested pairs (kind 0) and, for
    each piece and reference, the reference it ends with (kind 1)."""
    metres = geodesic_scalar if config.distance == "geodesic" else haversine_scalar
    limit = config.max_speed_knots
    none = (-1, 0, 0.0, 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = begin = last = None
        columns = ["kind", "entity_key", "island", "piece", *_REFERENCE, "entity_id", "observation_id", "source_order", "t",
                   "p_t", "distance_m", "lat", "lon"]

        def report():
            ref, t, lat, lon = last or none
            return (1, *current[:3], *(begin or none), None, None, ref, t, 0, 0.0, lat, lon)

        for batch in batches:
            out = []
            rows = zip(*(batch[c].tolist() for c in (
                "entity_key", "island", "piece", *_REFERENCE, "p_ref", "p_t", "p_lat", "p_lon", "t", "latitude", "longitude",
                "barred", "entity_id", "observation_id", "source_order")))
            for entity, island, piece, ref, r_t, r_lat, r_lon, p_ref, p_t, p_lat, p_lon, t, lat, lon, barred, entity_id, observation_id, order in rows:
                key = (entity, island, piece, None if pd.isna(ref) else int(ref))
                if key != current:
                    if current is not None:
                        out.append(report())
                    current = key
                    if key[3] is not None:
                        last = None if key[3] < 0 else (key[3], int(r_t), r_lat, r_lon)
                    else:
                        last = None if pd.isna(p_ref) else (int(p_ref), int(p_t), p_lat, p_lon)
                    begin = last
                if barred:
                    last = None
                    continue
                here = (order, t, lat, lon)
                if last is None or t <= last[1]:
                    last = here
                    continue
                dist = metres(last[3], last[2], lon, lat)
                out.append((0, *current[:3], *(begin or none), entity_id, observation_id, order, t, last[1], dist, lat, lon))
                if not dist / ((t - last[1]) / 1e6) * KNOTS_PER_MPS > limit:
                    last = here
            yield pd.DataFrame(out, columns=columns)
        if current is not None:
            yield pd.DataFrame([report()], columns=columns)

    return run


def sequence_flags(pairs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Repeated point, impossible speed and large gap flags of tested pairs."""
    fast = F.col("knots") > config.max_speed_knots
    wide = ~fast & (F.col("gap_seconds") > config.large_gap_seconds)

    def finding(flag, severity, detail):
        return F.struct(
            F.lit(flag).alias("flag"), F.lit(severity).alias("severity"), detail.alias("detail"),
            F.lit(severity == "ERROR").alias("excluded"),
        )

    found = F.array_compact(F.array(
        F.when(F.col("distance_m") < 1.0, finding(
            "REPEATED_IDENTICAL_POINT", "WARNING", F.lit("within one metre of the position before"))),
        F.when(fast, finding(
            "IMPOSSIBLE_SPEED", "ERROR", F.format_string("%.1f knots", F.col("knots")))),
        F.when(wide, finding(
            "LARGE_OBSERVATION_GAP", "WARNING", F.format_string("%.0f seconds", F.col("gap_seconds")))),
    ))
    return _explode_findings(pairs, found)


def gaps(pairs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    return pairs.filter(
        (F.col("knots") <= config.max_speed_knots)
        & (F.col("gap_seconds") > config.large_gap_seconds)
    ).select(
        "entity_id", F.col("prev_time").alias("start_time"), F.col("event_time").alias("end_time"),
        "gap_seconds",
    )


# --- whole bundle -----------------------------------------------------------------------------


@dataclass
class QualityResult:
    """Frames over tables that :func:`quality_control` has written; reading one repeats no check."""

    cleaned_points: DataFrame
    excluded_points: DataFrame
    quality_flags: DataFrame
    gaps: DataFrame
    track_segments: DataFrame
    vessel_summary: DataFrame


def all_flags(observations: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Every flag; the screened rows are written once and read by each check."""
    screened = stage(screen(observations))
    return screened_flags(screened, screened_pairs(screened, config), config)


def screened_flags(screened: DataFrame, pairs: DataFrame, config: QualityConfig) -> DataFrame:
    return (
        _explode_findings(screened, F.col("found"))
        .unionByName(_duplicates(screened))
        .unionByName(_disorder(screened, config))
        .unionByName(sequence_flags(pairs, config))
    )


def exclusions(screened: DataFrame, pairs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The excluding flags as :func:`split` needs them (``source_order``, ``excluded``), without forming any flag."""
    fast = pairs.filter(F.col("knots") > config.max_speed_knots)
    return screened.filter("barred").select("source_order").unionByName(fast.select("source_order")).withColumn("excluded", F.lit(True))


def clean(observations: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The cleaned points alone, for callers that need no flags."""
    screened = stage(screen(observations))
    return split(observations, stage(exclusions(screened, screened_pairs(screened, config), config)))[0]


def split(observations: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned, excluded): the wide rows meet the keys of the excluding flags once and are written
    with the mark, so that every output is a scan."""
    out = flags.filter("excluded").select(F.col("source_order").alias("__order")).distinct()
    df = prepare(observations)
    marked = stage(df.join(out, F.col("source_order") == F.col("__order"), "left").withColumn(
        "__order", F.col("__order").isNotNull()))
    return marked.filter(~F.col("__order")).drop("__order"), marked.filter("__order").drop("__order")


def vessel_summary(cleaned: DataFrame, flags: DataFrame) -> DataFrame:
    """Per vessel: rows, first/last time, first actor, number of flags."""
    counts = flags.groupBy("entity_id").agg(F.count("*").alias("flag_count"))
    return (
        cleaned.groupBy("entity_id")
        .agg(
            F.min_by("actor_type", "source_order").alias("actor_type"),
            F.count("*").alias("observation_count"),
            F.min("event_time").alias("first_seen"),
            F.max("event_time").alias("last_seen"),
        )
        .join(counts, "entity_id", "left")
        .withColumn("flag_count", F.coalesce("flag_count", F.lit(0)))
    )


def require_distinct_order(screened: DataFrame) -> None:
    """Rows are excluded by their ``source_order``, so it must name one row only."""
    repeated = screened.groupBy("source_order").agg(F.count("*").alias("n")).filter("n > 1").take(1)
    if repeated:
        raise ValueError(f"source_order {repeated[0][0]} names several rows; number the sources first (plans.build.number_sources)")


def quality_control(observations: DataFrame, config: QualityConfig = QualityConfig()) -> QualityResult:
    """Run every check and build the six output frames.

    The narrow tables that several outputs share (screened rows, notable pairs, flags,
    linked points) are written once to the checkpoint folder, so the wide input is read for
    screening and for the cleaned/excluded rows only.
    """
    from tidewake.operators.segments import linked_points, segments_of, validate_segments

    screened = stage(screen(observations))
    require_distinct_order(screened)
    notable = stage(screened_pairs(screened, config).filter(
        (F.col("distance_m") < 1.0) | (F.col("knots") > config.max_speed_knots)
        | (F.col("gap_seconds") > config.large_gap_seconds)
    ))
    flags = stage(screened_flags(screened, notable, config))
    cleaned, excluded = split(observations, flags)
    segments = stage(segments_of(stage(linked_points(cleaned, config)), config))
    validate_segments(segments)
    return QualityResult(
        cleaned_points=cleaned.drop("entity_key"),
        excluded_points=excluded.drop("entity_key"),
        quality_flags=flags,
        gaps=gaps(notable, config),
        track_segments=segments,
        vessel_summary=vessel_summary(cleaned, flags),
    )
