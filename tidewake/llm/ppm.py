"""Language-model scoring by prediction by partial matching (PPM), and a word baseline.

The model is a trie of byte contexts of up to four bytes, learnt from the training documents and
held as tables: counts of (context, next byte) for every order, and per context its total and
the number of different next bytes. A byte that its longest context has not seen is reached by
escapes to shorter ones (method C: as many chances as there are different bytes), where the
bytes that the longer context has seen are excluded. Every document is followed by an end
symbol, so that the probabilities of all texts sum to one.

A document's log probability is the sum over its five-byte strings of a value that depends on the
string alone. These values are computed once per distinct string by joins of the tables. Scoring
looks them up: the most frequent strings, a bounded number, are given to every worker; rarer
ones are joined by key. Word counts take the same way.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.textkeys import batches, word_keys
from tidewake.llm.workers import kept
from tidewake.session import stage

#: Bytes of the longest context.
ORDER = 4
#: Bound on the entries of each table that every worker holds (16 bytes each).
HELD_KEYS = 1 << 20
#: Bytes of text taken at a time; arrays of a group take about a hundred times as much.
TEXT_BYTES = 1 << 18
#: Distinct keys that a counting task gathers before it hands them on.
TASK_KEYS = 1 << 21
#: Byte that no UTF-8 text holds: context before a text and symbol of its end.
END = 0xFF
SYMBOLS = 256
WORDS, STRINGS = 0, 1


def byte_strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The string of ORDER + 1 bytes that ends at each byte and at the end symbol of each text, as
    an integer, and the index of each text's first (n + 1)."""
    texts = len(offsets) - 1
    sizes = np.diff(offsets)
    # texts with ORDER end symbols before each, and ORDER after the last
    room = np.full(len(data) + ORDER * (texts + 1), END, np.uint8)
    row = np.repeat(np.arange(texts), sizes)
    room[np.arange(len(data)) + ORDER * (row + 1)] = data
    key = np.zeros(len(room) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        key = key << np.uint64(8) | room[i : i + len(key)]
    counted = np.ones(len(key), bool)
    starts = offsets[:-1] + ORDER * np.arange(texts)
    stops = starts + sizes + 1
    for extra in range(ORDER - 1):  # end symbols after the first are context only
        at = stops + extra
        counted[at[at < len(key)]] = False
    return key[counted], np.append(0, np.cumsum(sizes + 1))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


class _Counts:
    """Counts by key of one kind, summed within a task as far as memory allows."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, keys: np.ndarray):
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.rows += len(self.parts[-1][0])

    def taken(self, limit: int):
        """The sums, if there are more than ``limit`` rows that summing doesn't reduce."""
        if self.rows <= limit or not self.parts:
            return None
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*self.parts)))
        self.parts, self.rows = [(keys, counts)], len(keys)
        if self.rows <= limit // 2:
            return None
        self.parts, self.rows = [], 0
        return keys, counts


def count_keys(docs: DataFrame) -> DataFrame:
    """``kind``, ``key``, ``n`` in training documents, ``n_all``: words (training only) and strings."""

    def run(iterator):
        held = {(WORDS, True): _Counts(), (STRINGS, True): _Counts(), (STRINGS, False): _Counts()}

        def handed(limit):
            for (kind, train), counts in held.items():
                if (sums := counts.taken(limit)) is not None:
                    n = pa.array(sums[1], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind], pa.int32()).take(pa.array(np.zeros(len(n), np.int64))), pa.array(sums[0].view(np.int64)),
                         n if train else pa.array(np.zeros(len(n), np.int64)), n], ["kind", "key", "n", "n_all"])

        for batch, data, offsets in batches(iterator, "text", TEXT_BYTES):
            train = ~np.asarray(batch.column("held_out"))
            words, first = word_keys(data, offsets)
            held[WORDS, True].add(words[np.repeat(train, np.diff(first))])
            strings, first = byte_strings(data, offsets)
            of_train = np.repeat(train, np.diff(first))
            held[STRINGS, True].add(strings[of_train])
            held[STRINGS, False].add(strings[~of_train])
            yield from handed(TASK_KEYS)
        yield from handed(0)

    partial = docs.select("held_out", "text").mapInArrow(run, "kind int, key long, n long, n_all long")
    return partial.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def _low_bytes(key: Column, n: int) -> Column:
    return key.bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))


def _log10_share(part: Column, whole: Column) -> Column:
    return F.log10(part.cast("double") / whole.cast("double"))


def string_scores(strings: DataFrame) -> DataFrame:
    """``key``, ``n_all``, ``value``: log10 probability of the last byte after the bytes before it, for
    every string (``key``, ``n``, ``n_all``).

    Orders are joined from the longest down: ``need`` holds the strings that have not met a context
    which knows their byte, with the log probability of their escapes so far, and the number of
    symbols that the longer context excludes.
    """
    known = stage(strings.where("n > 0").select("key", "n"))
    need = strings.select("key", "n_all", F.lit(0.0).alias("escapes"), F.lit(None).cast("long").alias("d_above"), F.lit(None).cast("long").alias("excluded"))
    scored = []
    for order in range(ORDER, -1, -1):
        contexts = known.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("d"))
        context = F.shiftright(_low_bytes(F.col("key"), order + 1), 8)
        # what the longer contexts will exclude one order below
        if order > 0:
            below = stage(known.groupBy(_low_bytes(F.col("key"), order).alias("low")).agg(F.sum("n").alias("n_low")))
            shadow = (
                known.withColumn("low", _low_bytes(F.col("key"), order)).join(below, "low")
                .groupBy(F.shiftright("key", 8).alias("shadowed")).agg(F.sum("n_low").alias("excludes")))
            contexts = contexts.join(shadow, F.col("context") == F.col("shadowed")).drop("shadowed")
        else:
            below, contexts = None, contexts.withColumn("excludes", F.lit(0).cast("long"))
        step = (
            need.withColumn("string", _low_bytes(F.col("key"), order + 1)).withColumn("of", context)
            .join(known.select(F.col("key").alias("string"), "n"), "string", "left")
            .join(contexts, F.col("of") == F.col("context"), "left"))
        left = F.col("total") - F.coalesce("excluded", F.lit(0))
        different = F.col("d") - F.coalesce("d_above", F.lit(0))
        step = stage(step.select(
            "key", "n_all", "escapes", "n", "d", "excludes", "d_above", "excluded", left.alias("left"), different.alias("different")))
        scored.append(step.where("n is not null").select(
            "key", "n_all", (F.col("escapes") + _log10_share(F.col("n"), F.col("left") + F.col("different"))).alias("value")))
        escape = F.when(F.col("different") > 0, _log10_share(F.col("different"), F.col("left") + F.col("different"))).otherwise(0.0)
        need = step.where("n is null").select(
            "key", "n_all", (F.col("escapes") + F.coalesce(escape, F.lit(0.0))).alias("escapes"),
            F.coalesce("d", F.lit(0)).cast("long").alias("d_above"), F.coalesce("excludes", F.lit(0)).cast("long").alias("excluded"))
        if below is not None:
            known = below.select(F.col("low").alias("key"), F.col("n_low").alias("n"))
    scored.append(need.select("key", "n_all", (F.col("escapes") - F.log10((SYMBOLS - F.col("d_above")).cast("double"))).alias("value")))
    out = scored[0]
    for part in scored[1:]:
        out = out.unionAll(part)
    return out


class KeyTable:
    """Numbers by 64-bit key; the keys ascend. Tables are arrays as they were sent, without a copy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key (0 where it has none), and whether it has one; a key is looked up once."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        distinct, index = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
        hit = self.keys[at] == distinct
        return np.where(hit, self.values[at], 0.0)[index], hit[index]


def most_frequent(table: DataFrame, count: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``key`` (ascending) and ``value`` of the rows with the largest counts: as many powers of two of the
    count, from the top, as have ``limit`` rows at most."""
    level = F.floor(F.log2(F.col(count).cast("double")))
    rows = dict(table.groupBy(level.alias("l")).agg(F.count("*")).collect())  # at most 64 levels
    least, total = 64, 0
    while least > 0 and total + rows.get(least - 1, 0) <= limit:
        least -= 1
        total += rows.get(least, 0)
    part = table.where(F.col(count) >= float(2**least)).select("key", "value").toArrow()
    keys = part["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], part["value"].to_numpy()[order]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(values))
    return total[first[1:]] - total[first[:-1]]


def score_texts(docs: DataFrame, held_out: Column, held_keys: int = HELD_KEYS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens`` (words and one end), ``n_known``,
    ``train_tokens``, ``base_score`` (add-one word model), ``score`` (PPM), scores as log10.

    Learns from the rows where ``held_out`` is false. NULL texts are empty; repeated rows are
    learnt and scored repeatedly. Without training rows every byte has the chance 1 in 256.
    """
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = stage(count_keys(rows))
    words = counted.where(F.col("kind") == WORDS)
    ends = rows.where(~F.col("held_out")).count()
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    scale = float(tokens + kinds + 1)

    word_values = words.select("key", F.log10((F.col("n") + 1) / F.lit(scale)).alias("value"), "n")
    string_values = stage(string_scores(counted.where(F.col("kind") == STRINGS).select("key", "n", "n_all")))
    context = docs.sparkSession.sparkContext
    tables = context.broadcast((most_frequent(word_values, "n", held_keys), most_frequent(string_values, "n_all", held_keys)))
    end_value = float(np.log10((ends + 1) / scale))
    name = uuid.uuid4().hex

    def run(iterator):
        from pyspark import TaskContext

        known_words, known_strings = kept(("ppm", name), lambda: tuple(KeyTable(*t) for t in tables.value))
        number = TaskContext.get().partitionId() << 40
        for batch, data, offsets in batches(iterator, "text", TEXT_BYTES):
            words, first = word_keys(data, offsets)
            base, hit = known_words.find(words)
            strings, at = byte_strings(data, offsets)
            score, met = known_strings.find(strings)
            rare = lambda keys, found, cut: pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(~found))[cut], pa.int32()), pa.array(keys[~found].view(np.int64)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number, number + batch.num_rows)), batch.column("doc_id"), batch.column("held_out"),
                pa.array(np.diff(first) + 1, pa.int64()), pa.array((_sums(hit, first) + (ends > 0)).astype(np.int64)),
                pa.array(_sums(base, first) + end_value), pa.array(_sums(score, at)), rare(words, hit, first), rare(strings, met, at),
            ], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare_words", "rare_strings"])
            number += batch.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stage(rows.mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
        "rare_words array<long>, rare_strings array<long>"))

    unseen = float(np.log10(1.0 / scale))
    rare_words = found.select("row", F.explode("rare_words").alias("key")).join(word_values, "key", "left").select(
        "row", F.col("value").isNotNull().cast("long").alias("known"), F.coalesce("value", F.lit(unseen)).alias("base"), F.lit(0.0).alias("score"))
    rare_strings = found.select("row", F.explode("rare_strings").alias("key")).join(string_values, "key").select(
        "row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.col("value").alias("score"))
    rest = rare_words.unionAll(rare_strings).groupBy("row").agg(
        F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("rest"))
    return found.drop("rare_words", "rare_strings").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))
