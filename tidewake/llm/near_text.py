"""Near-duplicate documents by min-max hashing.

Under every permutation of the shingle keys both the minimum and the maximum are kept: each
agrees for two sets with their Jaccard similarity as its chance, so 60 permutations give 120
values. Bands of five values propose candidates, the number of equal values screens them, and
full sets confirm them. The number of permutations follows from the similarity asked for: 60
at 0.85 and 90 at 0.8.

Documents with equal sets form one class and appear once. Within a band, members are compared
with the band's smallest member only; whoever it confirms needs no further comparison, because
components are wanted, not pairs. Only bands that still hold several components afterwards are
compared member by member, in blocks that several tasks share: a block screens its pairs by
signatures, confirms the rest on full sets and hands on a spanning forest of the links, so that
neither pairs nor links of a large group ever become rows.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.components import components
from tidewake.llm.textkeys import batches, mix, shingle_keys, text_bytes, word_keys
from tidewake.session import stage

BAND_VALUES = 5
#: Greatest chance that sets of exactly the similarity asked for share no band.
MISS = 1e-6
#: Members of a band in one block of the member-by-member comparison.
BLOCK = 512
#: Cells of a block's incidence matrix that are held at a time.
CELLS = 1 << 22



def permutations(percent: int) -> int:
    """Permutations whose bands miss a pair at the similarity with a chance of at most ``MISS``."""
    miss = 1 - min(percent / 100, 0.99) ** BAND_VALUES
    bands = math.ceil(math.log(MISS) / math.log(miss))
    return (bands + bands % 2) * BAND_VALUES // 2


@functools.cache
def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.arange(1, n + 1, dtype=np.uint64)
    return mix(ids) | np.uint64(1), mix(ids + np.uint64(1 << 20))


def signature(keys: np.ndarray, n: int) -> np.ndarray:
    """Minimum and maximum of a set under each of ``n`` permutations, as 32-bit values in turn."""
    out = np.empty(2 * n, np.uint64)
    times, plus = _constants(n)
    for i in range(n):
        order = (keys ^ plus[i]) * times[i]
        out[2 * i], out[2 * i + 1] = order.min(), order.max()
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_digest(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def mark() -> Column:
    return F.xxhash64("doc_id", "text").alias("mark")


def sketch(docs: DataFrame, width: int, n: int) -> DataFrame:
    """``doc_id``, ``mark`` (hash of id and text), ``n_shingles``, ``class`` (digest of the set, NULL
    without words), ``sig``."""

    def run(iterator):
        for batch, data, offsets in batches(iterator, "text"):
            sets = shingle_keys(*word_keys(data, offsets), width)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s, n).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], ["doc_id", "mark", "n_shingles", "class", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), mark()).mapInArrow(
        run, f"doc_id {kind}, mark long, n_shingles long, class binary, sig binary")


def _size_fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``class``, ``text`` of the classes wanted, one row each: the row of a class is found by id and
    mark, and repeated rows are folded before the shuffle."""
    ids = wanted.join(classes.select("class", "source"), "class").select(
        "class", F.col("source.doc_id").alias("__id"), F.col("source.mark").alias("__mark"))
    rows = docs.select("doc_id", mark(), F.col("text").cast("string").alias("text"))
    found = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    return found.groupBy("class").agg(F.first("text").alias("text"))


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of classes (``a``, ``b``) whose full sets reach the similarity.

    The texts of the classes in question are fetched by id and mark and their sets made anew; the
    digest tells whether it is the text that is meant.
    """
    wanted = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct()
    texts = _texts(wanted, classes, docs)
    left = texts.select(F.col("class").alias("a"), F.col("text").alias("left_text"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("right_text"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "left_text", "right_text")

    def run(iterator):
        held: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for whole in iterator:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                names_a, names_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                right_sets = shingle_keys(*word_keys(*text_bytes(batch.column("right_text"))), width)
                keep = []
                for i, (a, b, set_b) in enumerate(zip(names_a, names_b, right_sets)):
                    if held[0] != a:
                        set_a = shingle_keys(*word_keys(*text_bytes(batch.column("left_text").slice(i, 1))), width)[0]
                        if set_digest(set_a) != a:
                            continue
                        held = (a, set_a)
                    if set_digest(set_b) != b:
                        continue
                    common = len(np.intersect1d(held[1], set_b, assume_unique=True))
                    if 100 * common >= percent * (len(held[1]) + len(set_b) - common):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names_a[i] for i in keep], pa.binary()), pa.array([names_b[i] for i in keep], pa.binary())], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary").distinct()


def _screened(pairs: DataFrame, classes: DataFrame, values: int, least_equal: int) -> DataFrame:
    """Pairs whose signatures agree in at least ``least_equal`` values."""
    left = classes.select(F.col("class").alias("a"), F.col("sig").alias("sig_a"))
    right = classes.select(F.col("class").alias("b"), F.col("sig").alias("sig_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sig_a", "sig_b")

    def run(iterator):
        for batch in iterator:
            a, _ = text_bytes(batch.column("sig_a"))
            b, _ = text_bytes(batch.column("sig_b"))
            equal = (a.view(np.int32) == b.view(np.int32)).reshape(-1, values).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(equal >= least_equal))

    return both.mapInArrow(run, "a binary, b binary")


def _sets(texts: list[str], width: int) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    return shingle_keys(*word_keys(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])), width)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other: products of
    incidence matrices, which need the keys that occur on both sides only."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    step = max(1, CELLS // (len(left) + len(right)))

    def incidence(sets, keys):
        cells = np.zeros((len(sets), len(keys)), np.float32)
        for row, found in zip(cells, sets):
            at = np.searchsorted(keys, found)
            at[at == len(keys)] = 0
            row[at[keys[at] == found]] = 1
        return cells

    for at in range(0, len(shared), step):
        keys = shared[at : at + step]
        out += incidence(left, keys) @ incidence(right, keys).T
    return out


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


def _block_links(iterator, width: int, percent: int, least_equal: int):
    """Links within runs of rows of equal (band, i, j), members of block i with block j where
    components differ: edges of a spanning forest."""
    import pandas as pd

    def compare(frame):
        left, right = frame[frame["block"] == frame["i"]], frame[frame["block"] == frame["j"]]
        if not len(left) or not len(right):
            return
        unpack = lambda f: np.frombuffer(b"".join(f["sig"]), np.int32).reshape(len(f), -1)
        sig_l, sig_r = unpack(left), unpack(right)
        root_r, n_l, n_r = right["root"].to_numpy(), left["n"].to_numpy(), right["n"].to_numpy()
        fits = np.zeros((len(left), len(right)), bool)
        for row, root, n, sig in zip(fits, left["root"], n_l, sig_l):
            at = np.flatnonzero((root_r != root) & (100 * np.minimum(n, n_r) >= percent * np.maximum(n, n_r)))
            row[at] = (sig_r[at] == sig).sum(axis=1) >= least_equal
        rows, columns = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
        if not len(rows):
            return
        left, right, fits = left.iloc[rows], right.iloc[columns], fits[np.ix_(rows, columns)]
        sets_l, sets_r = _sets(left["text"].tolist(), width), _sets(right["text"].tolist(), width)
        # the digest tells whether it is the text that is meant
        true_l = np.array([set_digest(s) == c for s, c in zip(sets_l, left["class"])])
        true_r = np.array([set_digest(s) == c for s, c in zip(sets_r, right["class"])])
        common = _common(sets_l, sets_r)
        linked = fits & true_l[:, None] & true_r & (100 * common >= percent * (n_l[rows][:, None] + n_r[columns] - common))
        if not linked.any():
            return
        names, index = np.unique(np.concatenate([left["class"].to_numpy(), right["class"].to_numpy()]), return_inverse=True)
        whole = np.zeros((len(names), len(names)), bool)
        a, b = np.nonzero(linked)
        whole[index[a], index[len(left) + b]] = whole[index[len(left) + b], index[a]] = True
        label = _forest(whole)
        at = np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[at], pa.binary()), pa.array(names[label[at]], pa.binary())], ["a", "b"])

    held = None
    for batch in iterator:
        rows = batch.to_pandas()
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        key = rows[["band", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield from compare(rows.iloc[a:b])
        held = rows.iloc[cuts[-1] :] if len(rows) else None
    if held is not None:
        yield from compare(held)


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``mark``, ``n_shingles``, ``root`` (class that stands for its
    component, NULL without words) and ``component_id``."""
    values = 2 * permutations(percent)
    rows = stage(sketch(docs, width, values // 2))
    classes = stage(
        rows.where(F.col("class").isNotNull()).groupBy("class")
        .agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "mark")).alias("source"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))

    # six standard deviations below the similarity asked for
    p = percent / 100
    least_equal = int(values * p - 6 * (values * p * (1 - p)) ** 0.5)
    size = 4 * BAND_VALUES
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(values // BAND_VALUES - 1)),
        lambda i: F.xxhash64(i, F.substring("sig", i * size + 1, F.lit(size))))
    banded = classes.select("class", "n", F.explode(bands).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("m"), F.min(F.struct("class", "n")).alias("centre")).where("m > 1")
    members = stage(banded.join(shared, "band"))

    stars = members.where(F.col("class") != F.col("centre.class")).where(
        _size_fits(F.col("n"), F.col("centre.n"), percent)).select(F.col("centre.class").alias("a"), F.col("class").alias("b")).distinct()
    links = stage(confirm(stage(_screened(stars, classes, values, least_equal)), classes, docs, width, percent))
    roots = components(links)

    rooted = members.join(roots, F.col("class") == F.col("node"), "left").select(
        "band", "class", "n", "m", F.coalesce("root", "class").alias("root"))
    open_bands = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("m").alias("size")).where(
        "lo <> hi and size > 2").select("band")
    blocks = F.ceil(F.col("m") / BLOCK)
    unsettled = stage(rooted.join(open_bands, "band"))
    if unsettled.take(1):
        texts = _texts(unsettled.select("class").distinct(), classes, docs)
        rest = (
            unsettled.join(classes.select("class", "sig"), "class").join(texts, "class")
            .withColumn("block", F.pmod(F.xxhash64("class"), blocks))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "n", "root", "sig", "text")
        )
        ordered = rest.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
        more = ordered.mapInArrow(lambda it: _block_links(it, width, percent, least_equal), "a binary, b binary").distinct()
        roots = components(links.unionAll(stage(more)))

    node = classes.select("class", "rep").join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "rep", F.coalesce("root", "class").alias("root"))
    smallest = node.groupBy("root").agg(F.min("rep").alias("component_id"))
    labelled = node.join(smallest, "root").select(F.col("class").alias("of"), "root", "component_id")
    out = ("doc_id", "mark", "n_shingles", "root", "component_id")
    with_set = rows.where(F.col("class").isNotNull()).join(labelled, F.col("class") == F.col("of")).select(*out)
    alone = rows.where(F.col("class").isNull()).select(
        "doc_id", "mark", "n_shingles", F.col("class").alias("root"), F.col("doc_id").alias("component_id"))
    return with_set.unionAll(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` (size of its set of runs of ``width`` words),
    ``component_id`` (smallest id that links reach, itself included), ``kept``.

    Links join documents with 100 * intersection >= ``percent`` * union. Texts that are NULL or
    hold no word have an empty set and no link; fewer than ``width`` words count as one shingle.
    Rows with equal sets are linked whatever their ids. A NULL id is never a component's id
    unless all ids of it are NULL; such rows are kept. Repeated rows stay repeated.
    """
    return grouped(docs, width, percent).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """Rows of ``docs`` with one of each component: the one with the smallest id (then mark), and of
    repeated rows of it only one. Rows without words all stay. Columns are those of ``docs``."""
    rows = stage(grouped(docs, width, percent).where(F.col("root").isNotNull()).groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n")))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    marked = rows.join(first.withColumnRenamed("root", "of"), F.col("root") == F.col("of")).select(
        F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "n",
        F.struct("doc_id", "mark").eqNullSafe(F.col("first")).alias("stays"))
    going = marked.where("not stays or n > 1")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("doc_id", "text") == F.col("__mark"))
    repeated = docs.join(marked.where("stays and n > 1").drop("n", "stays"), same, "left_semi")
    return docs.join(going, same, "left_anti").unionAll(repeated.dropDuplicates(["doc_id", "text"]))
