"""Near-duplicate vectors by spherical-cap filters.

Filter directions are products of random codes: a vector is rotated at random, so that its energy
is spread over all dimensions, and cut into two blocks; each block has a code of random unit
vectors, and a filter is a pair of codewords. The score of a vector with a
filter is the sum of two inner products, so all filters that exceed a threshold are listed from
two short lists without visiting the others. Vectors meet in the filters that both exceed, and
every meeting is verified by the cosine in double precision.

The number of filters grows with the number of different vectors, so that an unrelated vector meets
a bounded number of others at every size, and the threshold follows from it: a pair at the least
similarity shares ``SHARED`` filters on average, whatever the number of filters.

A pair is counted in the smallest filter that both have, hence once. Filters move in buckets of
consecutive numbers, a vector once for each of its buckets; a bucket hands on counts and a
spanning forest of its links, never pairs. Equal vectors form one class and appear once
with their number. A bucket with many members is compared in blocks by several tasks.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.components import components
from tidewake.session import stage

#: Codewords of each block, the least number and that of books made without a table; the filters are their pairs.
LEAST_CODEWORDS, CODEWORDS = 64, 512
#: The number of filters grows with the table while a vector has at most this many, and not below this
#: number of dimensions: vectors of few dimensions are too close to one another for more filters to part them.
MOST_FILTERS, LEAST_DIMENSIONS = 72, 16
#: Members of a filter that a table of unrelated vectors would have.
MEMBERS = 8
#: Filters that a pair at the least similarity shares on average; below ``LEAST_DIMENSIONS`` more, by the square of the
#: lack, since the halves of short vectors differ much in length and few product codewords lie near some of them.
SHARED = 20
#: A vector with fewer filters above the threshold takes its best ones up to this number.
LEAST_FILTERS = 24
#: Members of a bucket in one block of comparisons.
BLOCK = 4096
#: Members of a filter that are multiplied at once.
TILE = 1024


@functools.lru_cache(8)
def codes(dimensions: int, words: int = CODEWORDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Unit codewords of the first and the second half of the rotated dimensions, turned back: their
    products with a vector are those of the codewords with the rotated vector."""
    rng = np.random.default_rng(seed)
    half = dimensions // 2
    # the only directions of a single dimension are two
    made = [rng.standard_normal((words, n)) if n > 1 else np.array([[1.0], [-1.0]])[: n + 1, :n] for n in (half, dimensions - half)]
    rotation, _ = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))
    return tuple(
        m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) @ rows for m, rows in zip(made, (rotation[:half], rotation[half:])))


def _tail(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cosines, and the chance that a random direction exceeds each with a given one."""
    angle = np.linspace(0.0, np.pi, 20_001)
    rank = np.sin(angle) ** max(0, dimensions - 2)
    upto = np.concatenate([[0.0], np.cumsum((rank[1:] + rank[:-1]) / 2)])
    return np.cos(angle)[::-1], (upto / upto[-1])[::-1]


@functools.lru_cache(256)
def threshold(dimensions: int, filters: int, least: float = 0.95) -> tuple[float, float]:
    """Score from which a filter counts, and the filters of a random vector then. Two vectors at a cosine
    of ``least`` share ``SHARED`` (or more, see there) of all ``filters`` on average."""
    wanted = SHARED * max(1.0, LEAST_DIMENSIONS / dimensions) ** 2
    x, exceeds = _tail(dimensions)
    rest_x, rest = _tail(dimensions - 1)
    width = -np.diff(exceeds)
    middle = (x[1:] + x[:-1]) / 2
    across = np.sqrt(np.maximum(1e-300, (1 - least**2) * (1 - middle**2)))

    def shared(s):
        above = middle > s
        both = np.interp((s - least * middle[above]) / across[above], rest_x, rest, 1.0, 0.0)
        return filters * (width[above] * both).sum()

    low, high = 0.0, 1.0
    for _ in range(40):
        s = (low + high) / 2
        low, high = (s, high) if shared(s) > wanted else (low, s)
    # a pair of codewords has length sqrt(2)
    return low * 2**0.5, float(filters * np.interp(low, x, exceeds))


@functools.lru_cache(256)
def shape(rows: int, dimensions: int, least: float = 0.95) -> tuple[int, int]:
    """Codewords of each block for a table of ``rows`` different vectors, and filters of a bucket."""

    def of(words):
        first, second = (n + 1 if n < 2 else words for n in (dimensions // 2, dimensions - dimensions // 2))
        return threshold(dimensions, first * second, least)[1], first * second, second

    words = LEAST_CODEWORDS
    while True:
        own, filters, second = of(words)
        wanted = own * rows / MEMBERS
        more = min(2 * words, int(np.ceil((wanted / filters) ** 0.5 * words)))
        if wanted <= 1.02 * filters or dimensions < LEAST_DIMENSIONS or of(more)[0] > MOST_FILTERS:
            break
        words = more
    # a bucket holds part of the filters of one first codeword
    expected = rows * own * second / filters
    return words, max(1, int(second / np.ceil(max(1.0, expected / BLOCK))))


def filters_of(vectors: np.ndarray, book: tuple[np.ndarray, np.ndarray], least: float = 0.95) -> list[np.ndarray]:
    """Sorted numbers of the filters of each unit vector (rows)."""
    words = len(book[1])
    bound, own = threshold(vectors.shape[1], len(book[0]) * words, least)
    at_least = max(LEAST_FILTERS, round(own / 2)) if vectors.shape[1] < LEAST_DIMENSIONS else LEAST_FILTERS
    first, second = vectors @ book[0].T, vectors @ book[1].T
    out = []
    for a, b in zip(first, second):
        at_a = np.flatnonzero(a >= bound - b.max())
        at_b = np.flatnonzero(b >= bound - a.max())
        scores = a[at_a][:, None] + b[at_b]
        rows, columns = np.nonzero(scores >= bound)
        if len(rows) < at_least:
            best_a, best_b = np.argsort(-a)[:at_least], np.argsort(-b)[:at_least]
            scores = (a[best_a][:, None] + b[best_b]).ravel()
            top = np.argsort(-scores, kind="stable")[:at_least]
            out.append(np.sort(best_a[top // len(best_b)] * words + best_b[top % len(best_b)]))
        else:
            out.append(np.sort(at_a[rows] * words + at_b[columns]))
    return out


def _classes(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``class`` (digest of the vector; NULL where it can't be compared), ``vector``
    (doubles of unit length)."""

    def run(batches):
        for batch in batches:
            names, units = [], []
            for row in batch.column("embedding").to_pylist():
                unit = None
                if row and None not in row:
                    v = np.asarray(row, float)
                    if np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
                        v = v / top
                        unit = v / np.sqrt(v @ v)
                names.append(None if unit is None else hashlib.blake2b(np.asarray(row, float).tobytes(), digest_size=16).digest())
                units.append(None if unit is None else unit.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(names, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "class", "vector"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        run, f"vec_id {kind}, class binary, vector binary")


def _packing(words: int) -> str:
    return "<i4" if words**2 < 2**31 else "<i8"


def _with_filters(classes: DataFrame, rows_in_all: int, least: float) -> DataFrame:
    """Classes with the sorted list ``filters`` (packed numbers) and the buckets ``found`` that hold them."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [np.frombuffer(v) for v in batch.column("vector").to_pylist()]
                found: list[np.ndarray] = [np.zeros(0, int)] * len(rows)
                buckets = list(found)
                for size in {len(r) for r in rows}:
                    words, span = shape(rows_in_all, size, least)
                    at_size = [i for i, r in enumerate(rows) if len(r) == size]
                    step = max(1, (1 << 22) // words)  # scores held at once
                    # vectors of other lengths share no filter
                    for part in (at_size[x : x + step] for x in range(0, len(at_size), step)):
                        for i, f in zip(part, filters_of(np.array([rows[i] for i in part]), codes(size, words), least)):
                            found[i], buckets[i] = f, np.unique(f // span)
                yield pa.RecordBatch.from_arrays([
                    batch.column("class"), batch.column("copies"), batch.column("vector"),
                    pa.array([f.astype(_packing(shape(rows_in_all, len(r), least)[0])).tobytes() for f, r in zip(found, rows)], pa.binary()),
                    pa.array([b.tolist() for b in buckets], pa.list_(pa.int64())),
                    pa.array([len(r) for r in rows], pa.int32())], ["class", "copies", "vector", "filters", "found", "size"])

    return classes.mapInArrow(run, "class binary, copies long, vector binary, filters binary, found array<long>, size int")


def _meet(vectors: np.ndarray, filters: list[np.ndarray], rows: np.ndarray, others: np.ndarray, number: int, least: float):
    """Links between two lists of a filter's members (or within one, if they are the same):
    boolean matrix of pairs that reach ``least`` and share no smaller filter."""
    linked = vectors[rows] @ vectors[others].T >= least
    if rows is others:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return linked
    own = [filters[i][: np.searchsorted(filters[i], number)] for i in rows]
    theirs = own if rows is others else [filters[i][: np.searchsorted(filters[i], number)] for i in others]
    names = np.unique(np.concatenate([*own, *theirs]))
    if len(names):
        def incidence(lists):
            out = np.zeros((len(lists), len(names)), np.float32)
            out[np.repeat(np.arange(len(lists)), [len(f) for f in lists]), np.searchsorted(names, np.concatenate(lists))] = 1
            return out

        left = incidence(own)
        right = left if rows is others else incidence(theirs)
        linked &= left @ right.T < 0.5
    return linked


def _forest(linked: np.ndarray) -> np.ndarray:
    """Smallest index that links reach from each index of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1)
        lower = np.minimum(label, near)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that the edges (a, b) reach, given the labels of earlier edges. Only labels are
    lowered, never the ends themselves: an end that left its label would lose the earlier edges."""
    while True:
        lower = label.copy()
        least = np.minimum(label[a], label[b])
        for ends in (label[a], label[b]):
            np.minimum.at(lower, ends, least)
        while (lower[lower] != lower).any():
            lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _links_of(vectors: np.ndarray, filters: list[np.ndarray], copies: np.ndarray, block: np.ndarray, i: int, j: int, low: int, high: int, least: float):
    """Of the members of a bucket (filters ``low`` to below ``high``): copies that each is linked with by pairs between
    blocks i and j, smallest member that those links reach, number of pairs compared."""
    counts, label, pairs = np.zeros(len(vectors), np.int64), np.arange(len(vectors)), 0
    flat = np.concatenate(filters).astype(np.int64)
    owner = np.repeat(np.arange(len(filters)), [len(f) for f in filters])
    inside = (flat >= low) & (flat < high)
    flat, owner = flat[inside], owner[inside]
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    cuts = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1, [len(flat)]]) if len(flat) else np.zeros(1, int)
    for at in np.flatnonzero(np.diff(cuts) > 1):
        members, number = owner[cuts[at] : cuts[at + 1]], flat[cuts[at]]
        first = members if i == j else members[block[members] == i]
        second = members if i == j else members[block[members] == j]
        for x in range(0, len(first), TILE):
            rows = first[x : x + TILE]
            for y in range(x if i == j else 0, len(second), TILE):
                others = rows if i == j and x == y else second[y : y + TILE]
                linked = _meet(vectors, filters, rows, others, number, least)
                pairs += linked.size
                if not linked.any():
                    continue
                counts[rows] += linked @ copies[others]
                if rows is not others:
                    counts[others] += linked.T @ copies[rows]
                    names, whole = np.concatenate([rows, others]), np.zeros((len(rows) + len(others),) * 2, bool)
                    whole[: len(rows), len(rows) :], whole[len(rows) :, : len(rows)] = linked, linked.T
                else:
                    names, whole = rows, linked
                label = _joined(label, names, names[_forest(whole)])
    return counts, label, pairs


def _blocks_linked(iterator, rows_in_all: int, least: float):
    """Links of runs of rows of equal (found, size, i, j): per class the copies it is linked with, and
    edges of a spanning forest."""
    import pandas as pd

    def compare(frame):
        bucket, i, j = (int(frame[c].iloc[0]) for c in ("found", "i", "j"))
        names, (words, span) = frame["class"].to_numpy(), shape(rows_in_all, int(frame["size"].iloc[0]), least)
        counts, label, _ = _links_of(
            np.frombuffer(b"".join(frame["vector"])).reshape(len(frame), -1), [np.frombuffer(f, _packing(words)) for f in frame["filters"]],
            frame["copies"].to_numpy(), frame["block"].to_numpy(), i, j, bucket * span, (bucket + 1) * span, least)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at], pa.binary()), pa.array(names[label[at]], pa.binary()), pa.array(counts[at], pa.int64())], ["a", "b", "links"])

    held = None
    for batch in iterator:
        rows = batch.to_pandas()
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        key = rows[["found", "size", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                yield from compare(rows.iloc[a:b])
        held = rows.iloc[cuts[-1] :] if len(rows) else None
    if held is not None and len(held) > 1:
        yield from compare(held)


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """Per row of ``vectors``: ``vec_id``, ``n_links`` (other rows with a cosine of ``least`` or more),
    ``component_id`` (smallest id that links reach, itself included), ``kept``.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components have no link; vectors
    of different lengths are not compared. Repeated rows and equal vectors are linked. An empty table gives an empty
    one. Columns other than ``vec_id`` and ``embedding`` are dropped, so none can clash.
    """
    rows = stage(_classes(vectors))
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("rep"), F.first("vector").alias("vector"))
    classes = stage(classes)
    count = classes.count()
    listed = stage(_with_filters(classes.select("class", "copies", "vector").repartition(F.col("class")), count, least))
    # only buckets of several blocks, at most one for each BLOCK rows: the others stay whole and need no look-up
    large = stage(
        listed.select(F.explode("found").alias("found"), "size").groupBy("found", "size").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK))
    blocks = F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1).cast("long"))
    met = (
        listed.withColumn("found", F.explode("found")).join(large, ["found", "size"], "left")
        .withColumn("block", F.pmod(F.xxhash64("class"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("found", "size", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "copies", "vector", "filters")
    )
    met = met.repartition("found", "size", "i", "j").sortWithinPartitions("found", "size", "i", "j")
    partial = stage(met.mapInArrow(lambda it: _blocks_linked(it, count, least), "a binary, b binary, links long").where("links > 0"))

    counts = partial.groupBy("a").agg(F.sum("links").alias("others"))
    roots = components(partial.select("a", "b"))
    node = classes.select("class", "copies", "rep").join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "copies", "rep", F.coalesce("root", "class").alias("root"))
    smallest = node.groupBy("root").agg(F.min("rep").alias("component_id"))
    labelled = node.join(smallest, "root").join(counts, F.col("class") == F.col("a"), "left").select(
        F.col("class").alias("of"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    compared = rows.where(F.col("class").isNotNull()).join(labelled, F.col("class") == F.col("of")).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("class").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return compared.unionAll(alone).select(
        "vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
