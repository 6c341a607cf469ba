"""Encoding and decoding of document texts, with digests of both."""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.bpe import EncodedWords, WordEncoder
from tidewake.llm.workers import kept


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    return kept(("encoder", path), lambda: WordEncoder(path))


def text_groups(column: pa.Array, size: int = 1 << 20):
    """Texts of a column (NULL as empty), in groups of about ``size`` bytes; yields the index of the
    first with the group."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.append(0, np.cumsum(np.asarray(pc.binary_length(column), np.int64)))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield at, column.slice(at, end - at)
        at = end


class _Printed:
    """What each id is written as, with a space before it."""

    def __init__(self, texts: list[bytes]):
        self.table = pa.array([b" " + t for t in texts], pa.large_binary())

    def parts(self, ids: np.ndarray):
        """The ids' texts joined by one space, in pieces of a bounded number of ids."""
        for at in range(0, len(ids), 1 << 18):
            data = self.table.take(pa.array(ids[at : at + (1 << 18)])).buffers()[2]
            yield memoryview(data)[0 if at else 1 :]

    def sha256(self, ids: np.ndarray) -> str:
        digest = hashlib.sha256()
        for part in self.parts(ids):
            digest.update(part)
        return digest.hexdigest()


def encode_decode(docs: DataFrame, path: str, ids: bool = False, text: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space),
    ``decoded_sha256``; on request also the ``ids`` and the ``decoded`` text.

    NULL texts are encoded as empty ones: no ids, the hash of nothing. One row per input row,
    repeated rows, repeated and NULL ids included; other columns are dropped; an empty table gives
    an empty one. No shuffle; memory is bounded by the word cache and a group of texts of a
    mebibyte, or a single longer text, whose ids are hashed in pieces.
    """

    def run(batches):
        tokenizer = encoder(path)
        cache = kept(("ids", path), lambda: EncodedWords(tokenizer))
        numbers, tokens = kept(("printed", path), lambda: (
            _Printed([b"%d" % i for i in range(len(tokenizer.token))]), _Printed([t.encode() for t in tokenizer.token])))
        for batch in batches:
            for at, group in text_groups(batch.column("text")):
                found, ends = cache.ids(group)
                rows = [found[a:b] for a, b in pairwise(ends.tolist())]
                columns = {
                    "doc_id": batch.column("doc_id").slice(at, len(rows)), "n_tokens": pa.array(np.diff(ends), pa.int64()),
                    "ids_sha256": pa.array(list(map(numbers.sha256, rows)), pa.string()),
                    "decoded_sha256": pa.array(list(map(tokens.sha256, rows)), pa.string())}
                if ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.astype(np.int32)))
                if text:
                    columns["decoded"] = pa.array([b"".join(tokens.parts(r)).decode() for r in rows], pa.string())
                yield pa.RecordBatch.from_pydict(columns)
        pa.default_memory_pool().release_unused()  # the worker stays, beside those of other steps

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * text
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
