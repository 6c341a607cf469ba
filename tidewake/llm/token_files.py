"""Token ids of a corpus in wavelet matrix files, one or more per shard of consecutive documents."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.llm.bpe import EncodedWords
from tidewake.llm.bpe_codec import encoder, text_groups
from tidewake.llm.slices import quantile_cuts, slice_of
from tidewake.llm.wavelet import WaveletMatrix, encode
from tidewake.llm.workers import kept
from tidewake.session import stage_folder

#: Documents in a shard, about a million tokens where texts are of usual length.
SHARD_DOCS = 1024
#: Bytes of texts encoded at once: the more, the fewer words are looked up again.
GROUP_BYTES = 4 << 20
#: Tokens in a file; only a single longer document makes a larger one.
FILE_TOKENS = 1 << 22


def write_tokens(
    docs: DataFrame, path: str, folder: str, end_id: int = 1, shard_docs: int = SHARD_DOCS,
    file_tokens: int = FILE_TOKENS,
) -> None:
    """Encodes ``doc_id``, ``text`` and writes the files of every shard to ``folder``: pieces of whole
    documents with ``file_tokens`` ids at most, or of one document with more.

    Documents stand in ascending order of their id (NULL first, equal ids by their ids' bytes),
    shard after shard; a document is the ids of its text (none for NULL) and ``end_id``. Shards
    are written by Spark's own writer, so any storage it can reach will do.
    """
    keyed = docs.select(
        slice_of(F.col("doc_id"), quantile_cuts(docs, "doc_id", shard_docs)).alias("shard"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def to_ids(batches):
        cache = kept(("ids", path), lambda: EncodedWords(encoder(path)))
        for batch in batches:
            for at, group in text_groups(batch.column("text"), GROUP_BYTES):
                found, ends = cache.ids(group)
                stops = ends[1:] + np.arange(1, len(ends))  # with an end id each
                ids = np.full(int(stops[-1]), end_id, found.dtype)
                inner = np.ones(len(ids), bool)
                inner[stops - 1] = False
                ids[inner] = found
                places = np.append(0, stops * ids.itemsize).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(group), [None, pa.py_buffer(places), pa.py_buffer(ids)])
                part = batch.slice(at, len(group))
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("doc_id"), packed], ["shard", "doc_id", "ids"])

    def shard_file(shard: int, piece: int, doc_ids: list, ids: list[bytes], tokenizer):
        dtype = np.dtype("<u2" if len(tokenizer.token) <= 1 << 16 else "<u4")
        values = np.frombuffer(b"".join(ids), dtype)
        known = np.array([-1 if d is None else d for d in doc_ids], np.int64)
        sizes = np.array([len(i) // dtype.itemsize for i in ids], np.int64)
        image = encode(values, int(len(tokenizer.token) - 1).bit_length(), known, sizes)
        missing = sum(d is None for d in doc_ids)  # they stand first
        return pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([piece], pa.int32()), pa.array([len(values)], pa.int64()), pa.array([missing], pa.int64()),
            pa.array([image], pa.large_binary())], ["shard", "piece", "n_tokens", "missing_ids", "image"])

    def to_files(batches):
        tokenizer, shard, piece, doc_ids, ids, size = encoder(path), None, 0, [], [], 0
        most = file_tokens * (2 if len(tokenizer.token) <= 1 << 16 else 4)
        for batch in batches:
            for row in range(batch.num_rows):
                s, d, i = (batch.column(c)[row].as_py() for c in ("shard", "doc_id", "ids"))
                if ids and (s != shard or size + len(i) > most):
                    yield shard_file(shard, piece, doc_ids, ids, tokenizer)
                    piece, doc_ids, ids, size = piece + 1 if s == shard else 0, [], [], 0
                shard = s
                doc_ids.append(d)
                ids.append(i)
                size += len(i)
        if ids:
            yield shard_file(shard, piece, doc_ids, ids, tokenizer)

    encoded = keyed.mapInArrow(to_ids, f"shard int, doc_id {kind}, ids binary")
    ordered = encoded.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    files = ordered.mapInArrow(to_files, "shard int, piece int, n_tokens long, missing_ids long, image binary")
    files.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` of the ids as little-endian 32-bit integers; with ``with_ids`` also ``ids``."""
    files = spark.read.schema("shard int, piece int, n_tokens long, missing_ids long, image binary").parquet(folder)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard, piece, missing, image = (batch.column(c)[row].as_py() for c in ("shard", "piece", "missing_ids", "image"))
                matrix = WaveletMatrix(image)
                values = matrix.values().astype("<u4")
                ends = np.cumsum(matrix.sizes)
                starts = ends - matrix.sizes
                sums = [zlib.crc32(values[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                ids = matrix.doc_ids.tolist()
                columns = [
                    pa.array([shard] * len(ids), pa.int32()), pa.array([piece] * len(ids), pa.int32()), pa.array([None] * missing + ids[missing:], pa.int64()),
                    pa.array(starts, pa.int64()), pa.array(matrix.sizes, pa.int64()), pa.array(sums, pa.int64())]
                names = ["shard", "piece", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([values[a:b].tolist() for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    extra = ", ids array<long>" if with_ids else ""
    docs = files.select("shard", "piece", "missing_ids", "image").mapInArrow(
        run, f"shard int, piece int, doc_id long, within long, n_tokens long, ids_crc32 long{extra}")
    # one row per shard, of which there are 65,536 at most
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).select(
        F.col("shard").alias("__of"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("__upto"))
    within = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = files.select(
        F.col("shard").alias("__shard"), F.col("piece").alias("__piece"), F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("__inside"))
    starts = pieces.join(shards, F.col("__shard") == F.col("__of")).select("__shard", "__piece", (F.col("__upto") + F.col("__inside")).alias("__before"))
    return docs.join(starts, (F.col("shard") == F.col("__shard")) & (F.col("piece") == F.col("__piece"))).select(
        "doc_id", (F.col("__before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_folder(spark: SparkSession) -> str:
    return f"{stage_folder(spark)}/tokens-{uuid.uuid4().hex}"
