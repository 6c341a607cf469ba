"""Ranked lexical search with bag deduplication.

Documents are restricted to the vocabulary of the queried items: what a score can depend on is
the count of each such term and the length class ``m``. Documents that agree in all of this form
a class: hashed together, verified by the counts themselves, scored once, and expanded to their
members by ascending ``doc_id`` at the end. As all members score alike, an item can only show the
first ``top`` of a class, and only the ``top`` best classes of a task.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.textkeys import batches
from tidewake.session import stage

#: Item terms that a worker holds at a time; more are taken in blocks of whole items.
BLOCK_TERMS = 1 << 18
#: Scores computed at a time.
SCORES = 1 << 20

# Characters of a term are all but these (letters beyond ASCII included).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte of a text to byte of its terms: A-Z lower-cased, everything outside a term a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32
FOLD[65:91] += 32


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id``, ``term``: the distinct terms of each item over all its rows."""
    folded = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    return items.select("item_id", F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def bags(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``terms`` (ascending places in the vocabulary), ``counts``."""
    known = pa.array(vocabulary, pa.large_string())

    def run(parts):
        for part, data, offsets in batches(parts, "text"):
            folded = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(FOLD[data]))
            split = pc.ascii_split_whitespace(folded)
            words = split.flatten()
            ends = np.asarray(split.offsets, np.int64)
            of = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
            n = np.bincount(of[np.asarray(pc.binary_length(words)) > 0], minlength=len(offsets) - 1)
            place = np.asarray(pc.fill_null(pc.index_in(words, value_set=known), -1), np.int64)
            held = place >= 0
            keys, counts = np.unique(of[held] * len(known) + place[held], return_counts=True)
            starts = pa.array(np.searchsorted(keys, np.arange(len(offsets)) * len(known)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(starts, pa.array(keys % max(1, len(known)), pa.int32())),
                pa.ListArray.from_arrays(starts, pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


def classes(counted: DataFrame, total: int, length: int, top: int) -> DataFrame:
    """Classes of equal ``m``, ``terms`` and ``counts``, with their first ``top`` members in order.

    Rows meet by a hash and are told apart by the counts; all but the first ``top`` of a class
    are dropped before the shuffle already, so a class may hold any share of the documents.
    """
    m = F.lit(10) + F.expr(f"(90L * n * {total}L) div {max(1, length)}L")
    key = ["m", "hash", "terms", "counts"]
    rows = counted.where(F.size("terms") > 0).select(
        "doc_id", m.alias("m"), F.xxhash64("terms", "counts").alias("hash"), "terms", "counts")
    order = Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last())
    first = rows.select("*", F.row_number().over(order).alias("place")).where(F.col("place") <= top)
    return first.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "doc_id"))).alias("members"))


def best_classes(found: DataFrame, weight: np.ndarray, first: np.ndarray, items: np.ndarray, n_items: int, top: int) -> DataFrame:
    """``item``, ``score``, ``members``: for every item and task the ``top`` classes of highest score,
    ties by the first member. Term ``t`` belongs to ``items[first[t]:first[t + 1]]``."""
    spread = np.diff(first)

    def chunks(batch):
        """Ranges of classes whose scores fit in a chunk, one class at least."""
        ends = np.asarray(batch.column("terms").offsets, np.int64)
        terms = np.asarray(batch.column("terms").flatten(), np.int64)
        upto = np.append(0, np.cumsum(spread[terms]))[ends - ends[0]]
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(upto, upto[at] + SCORES, side="right")) - 1
            end = min(max(end, at + 1), at + max(1, SCORES // n_items), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end

    def scores(part):
        terms = np.asarray(part.column("terms").flatten(), np.int64)
        tf = np.asarray(part.column("counts").flatten(), np.int64)
        row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(part.column("terms").offsets, np.int64)))
        m = np.asarray(part.column("m"), np.int64)[row]
        gain = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        times = spread[terms]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item = items[np.repeat(first[terms], times) + within]
        out = np.zeros(part.num_rows * n_items, np.int64)
        np.add.at(out, np.repeat(row * n_items, times) + item, np.repeat(gain, times))
        return out.reshape(part.num_rows, n_items)

    def run(parts):
        least = np.zeros(n_items, np.int64)  # what a later class must exceed
        held = np.zeros((0, 3), np.int64)  # item, score, class
        members, seen = {}, 0
        for batch in parts:
            for part in chunks(batch):
                score = scores(part)
                row, item = np.nonzero(score > least)
                if len(row):
                    held = np.concatenate([held, np.stack([item, score[row, item], row + seen], 1)])
                    held = held[np.lexsort((held[:, 2], -held[:, 1], held[:, 0]))]
                    opens = np.searchsorted(held[:, 0], held[:, 0])
                    held = held[np.arange(len(held)) - opens < top]
                    full = np.flatnonzero(np.bincount(held[:, 0], minlength=n_items) >= top)
                    least[full] = held[np.searchsorted(held[:, 0], full, side="right") - 1, 1]
                    lists = part.column("members")
                    for c in np.unique(held[:, 2]).tolist():
                        if c not in members:
                            members[c] = lists.take(pa.array([c - seen]))
                    if len(members) > 2 * len(held) + 1000:
                        members = {c: members[c] for c in np.unique(held[:, 2]).tolist()}
                seen += part.num_rows
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(held[:, 0], pa.int32()), pa.array(held[:, 1]), pa.concat_arrays([members[c] for c in held[:, 2].tolist()])],
                ["item", "score", "members"])

    kind = found.schema["members"].dataType.simpleString()
    ordered = found.sortWithinPartitions(F.element_at("members", 1)["doc_id"].asc_nulls_last())
    return ordered.select("m", "terms", "counts", "members").mapInArrow(run, f"item int, score long, members {kind}")


def _ranked_block(docs: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """The results of the items of ``terms``, which one worker can hold."""
    spark = docs.sparkSession
    rows = terms.orderBy("item_id", "term").collect()
    ids = list(dict.fromkeys(r["item_id"] for r in rows))
    number = {i: k for k, i in enumerate(ids)}
    vocabulary = sorted({r["term"] for r in rows})
    place = {t: k for k, t in enumerate(vocabulary)}
    pairs = np.array(sorted((place[r["term"]], number[r["item_id"]]) for r in rows), np.int64).reshape(-1, 2)
    first = np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1))

    counted = stage(bags(docs, vocabulary))
    total, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(vocabulary), np.int64)
    for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the vocabulary's
        weight[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))

    best = best_classes(stage(classes(counted, total, length, top)), weight, first, pairs[:, 1].copy(), max(1, len(ids)), top)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.select("item", "score", F.explode("members").alias("member")).select("item", "score", F.col("member.doc_id").alias("doc_id"))
    ranked = ranked.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    kind = terms.schema["item_id"].dataType.simpleString()
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
    return names.join(ranked, "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` documents of each item (``item_id``, ``text``).

    A score is the sum over the item's terms of an integer weight (scarce terms weigh more) times
    a saturating share of the term's count, in which longer documents need more.

    Items are taken in blocks of about ``block_terms`` terms (whole items; a worker holds a block's
    vocabulary), each block against all documents. Rows of one ``item_id`` are one item, NULL
    included; items without terms (NULL or empty text) have no rows, documents without terms
    appear nowhere. Equal scores are ordered by ``doc_id``, NULL last; repeated document rows
    each take a rank. Texts of any length are counted whole; other columns are not read. Empty
    tables give an empty result.
    """
    terms = stage(item_terms(items.select("item_id", "text")))
    blocks = max(1, math.ceil(terms.count() / block_terms))
    if blocks == 1:
        return _ranked_block(docs, terms, top)
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    return reduce(DataFrame.unionAll, [_ranked_block(docs, terms.where(block == b), top) for b in range(blocks)])
