"""Document fingerprints: threshold-scaled sketches.

Of all shingle keys of a text (16 bytes each) those below a fixed fraction of the key range are
kept. Sketches of any two texts are samples by the same rule, so unions merge them and shares of
common keys estimate resemblance and containment, also between very unequal texts. A text with
fewer than ``FLOOR`` keys below the fraction keeps its ``FLOOR`` smallest, and the sketch notes up
to where it is complete; two sketches are compared where both are.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.slices import quantile_cuts, slice_of
from tidewake.llm.textkeys import mix
from tidewake.session import stage

SHINGLE_BYTES = 16
FRACTION = 32
FLOOR = 32
#: Documents in a slice of the global order.
SLICE_DOCS = 256

_FULL = 1 << 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _keys(data: np.ndarray) -> np.ndarray:
    """32-bit key of every run of SHINGLE_BYTES bytes, by doubling the run."""
    key = data.astype(np.uint64) + np.uint64(1)
    step, width = _BASE, 1
    while width < SHINGLE_BYTES:
        key = key[:-width] * step + key[width:]
        step, width = np.uint64(int(step) * int(step) % (1 << 64)), 2 * width
    return (mix(key) >> np.uint64(32)).astype(np.uint32)


def _bounded(keys: np.ndarray, low: np.ndarray) -> tuple[int, np.ndarray]:
    """Sketch of a text: (bound below which it is complete, sorted distinct keys)."""
    low = np.unique(low)
    if len(low) >= FLOOR:
        return _FULL // FRACTION, low
    every = np.unique(keys)
    if len(every) <= FLOOR:
        return _FULL, every
    return int(every[FLOOR - 1]) + 1, every[:FLOOR]


def sketches(texts: list[bytes], group: int = 1 << 20) -> list[tuple[int, np.ndarray]]:
    """Sketch of each text; texts of about ``group`` bytes are hashed together."""
    out: list[tuple[int, np.ndarray]] = []
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= group):
            held += len(texts[end])
            end += 1
        # a text shorter than a shingle is one shingle, filled up with zero bytes
        part = [t.ljust(SHINGLE_BYTES, b"\0") if t else t for t in texts[at:end]]
        data = np.frombuffer(b"".join(part), np.uint8)
        keys = _keys(data) if len(data) >= SHINGLE_BYTES else np.zeros(0, np.uint32)
        low = np.flatnonzero(keys < _FULL // FRACTION)
        start = 0
        for text in part:
            stop = start + len(text) - SHINGLE_BYTES + 1
            if text:
                a, b = np.searchsorted(low, (start, stop))
                out.append(_bounded(keys[start:stop], keys[low[a:b]]))
            else:
                out.append((_FULL, np.zeros(0, np.uint32)))
            start += len(text)
        at = end
    return out


def to_text(sketch: tuple[int, np.ndarray]) -> str:
    return f"{sketch[0]:x}.{base64.b64encode(sketch[1].astype('<u4').tobytes()).decode()}"


def from_text(text: str) -> tuple[int, np.ndarray]:
    bound, keys = text.split(".")
    return int(bound, 16), np.frombuffer(base64.b64decode(keys), "<u4")


def merged(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """Sketch of two texts together, complete where both are."""
    bound, keys = min(a[0], b[0]), np.union1d(a[1], b[1])
    return bound, keys[keys < bound]


def overlap(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[float, float]:
    """Estimates of resemblance (common of all keys) and of the containment of ``a`` in ``b``; two
    empty texts give 1, a text and an empty one 0."""
    bound = min(a[0], b[0])
    left, right = a[1][a[1] < bound], b[1][b[1] < bound]
    common = len(np.intersect1d(left, right, assume_unique=True))
    either = len(left) + len(right) - common
    if not either:
        same = float(len(a[1]) == len(b[1]))
        return same, same
    return common / either, common / len(left) if len(left) else 0.0


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (NULL as empty), ``next``: the text of the next document in descending
    order of ids (NULL ids last, equal ids by descending text), after the last the first.

    Slices are ordered by themselves; each also gets the first row of the slice that follows it,
    so texts move once and no task holds more than a slice.
    """
    cuts = quantile_cuts(docs, "doc_id", SLICE_DOCS)
    keyed = docs.select(
        slice_of(F.col("doc_id"), cuts).alias("slice"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    around = Window.orderBy("slice")  # one row per slice, of which there are 65,536 at most
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = keyed.groupBy("slice").agg(F.max("doc_id").alias("top")).select(
        F.col("slice").alias("__slice"), "top",
        F.coalesce(F.lead("slice").over(around), F.first("slice").over(whole)).alias("__to"))
    tops = stage(tops)  # of a known small size, so that finding the first rows moves no text
    heads = (
        keyed.join(tops, (F.col("slice") == F.col("__slice")) & F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("__to").agg(F.max("text").alias("text"))
        .select(F.col("__to").alias("slice"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(1).alias("tail")))
    rows = keyed.withColumn("tail", F.lit(0)).unionByName(heads)
    order = Window.partitionBy("slice").orderBy("tail", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return rows.withColumn("next", F.lead("text").over(order)).where("tail = 0").select("doc_id", "text", "next")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text: the last half of its code points (rounded
    down) replaced by as many, or all, first ones of the next document.

    One row per input row with ``n_chars``, ``edited_sha256``, both fingerprints, resemblance to
    the edited text and to the next document, and how much of the text's keys these contain.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts, following = batch.column("text").to_pylist(), batch.column("next").to_pylist()
                halves = [len(t) // 2 for t in texts]
                edited = [(t[: len(t) - h] + n[:h]).encode() for t, n, h in zip(texts, following, halves)]
                raw, after = [t.encode() for t in texts], [n.encode() for n in following]
                own, changed = sketches(raw), sketches(edited)
                # mostly the next document is the next row
                other = [i for i, n in enumerate(after) if i + 1 == len(raw) or raw[i + 1] != n]
                extra = dict(zip(other, sketches([after[i] for i in other])))
                near = [overlap(a, b) for a, b in zip(own, changed)]
                to_next = [overlap(a, extra[i] if i in extra else own[i + 1]) for i, a in enumerate(own)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([to_text(s) for s in own]), pa.array([to_text(s) for s in changed]),
                    pa.array([n[0] for n in near], pa.float64()), pa.array([n[0] for n in to_next], pa.float64()),
                    pa.array([n[1] for n in near], pa.float64()), pa.array([n[1] for n in to_next], pa.float64()),
                ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                    "contained_in_edited", "contained_in_next"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs.select("doc_id", "text")).mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double, contained_in_edited double, contained_in_next double")
