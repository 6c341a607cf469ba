"""Byte-level BPE by a local file of ranks: encoding with the tiktoken library, decoding to raw bytes.

The library splits a text by a regular expression and encodes every match by itself, so a text
may be cut wherever no match can cross: between a character and the white space after it, or
between a letter and the punctuation after it. Long texts are cut at such places and encoded
piece by piece; very long runs of white space, which the library's expression cannot take, are
matched here and encoded as the single piece that they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.workers import kept

#: Characters of a text that are encoded at a time, where it has a safe place to cut.
PIECE = 1 << 16
#: White space that the library need not match itself.
LONG_RUN = 1 << 11

# The White_Space property, as the library's expressions understand \s.
WHITE = "\t-\r \x85\xa0" + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A place that no match crosses.
SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-z一-龥])(?=[,.;:!?、。，！：；？])")
RUN = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")


class RankCodec:
    """Encoder and decoder of a rank file (lines of a token in base64 and its rank)."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = 1 + max(ranks.values())
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.numbers = pa.array([b",%d" % i for i in range(size)], pa.large_binary())

    def _cut(self, text: str, piece: int) -> Iterator[str]:
        """Parts of about ``piece`` characters whose encodings joined are the whole text's."""
        at = 0
        while len(text) - at > piece:
            place = SAFE.search(text, at + piece)
            if not place:
                break
            yield text[at : place.start()]
            at = place.start()
        yield text[at:] if at else text

    def pieces(self, text: str, piece: int = PIECE) -> Iterator[np.ndarray]:
        """Ids of the text, piece by piece."""
        at = 0
        for run in RUN.finditer(text) if len(text) >= LONG_RUN else ():
            # the last white space goes with what follows, unless nothing does
            end = run.end() if run.end() == len(text) else run.end() - 1
            for part in self._cut(text[at : run.start()], piece):
                yield np.array(self.library.encode_ordinary(part), np.uint32)
            yield np.array(self.library._encode_single_piece(text[run.start() : end]), np.uint32)
            at = end
        for part in self._cut(text[at:] if at else text, piece):
            yield np.array(self.library.encode_ordinary(part), np.uint32)

    @staticmethod
    def _joined(table: pa.Array, ids: np.ndarray) -> memoryview:
        """The table's entries of the ids, one after another."""
        data = table.take(pa.array(ids)).buffers()[2]
        return memoryview(data) if data is not None else memoryview(b"")

    def decimals(self, ids: np.ndarray) -> memoryview:
        """The decimal ids, a comma before each."""
        return self._joined(self.numbers, ids)

    def decode(self, ids: np.ndarray) -> memoryview:
        """The bytes that the ids stand for."""
        return self._joined(self.tokens, ids)


def encode_decode(docs: DataFrame, path: str, pattern: str, ids: bool = False, decoded: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256``
    (of the bytes that the ids stand for); on request also the ``ids`` and the ``decoded`` bytes.

    NULL texts are encoded as empty ones: no ids, the hash of nothing. One row per input row,
    repeated rows, repeated and NULL ids included; other columns are dropped; an empty table gives
    an empty one. Long texts are encoded and hashed piece by piece, so without ``ids`` and
    ``decoded`` a worker holds no more than a piece of a text besides the text itself. No shuffle.
    """

    def run(batches):
        codec = kept(("ranks", path, pattern), lambda: RankCodec(path, pattern))
        for batch in batches:
            counts, hashed, back, all_ids, all_bytes = [], [], [], [], []
            for text in batch.column("text"):
                n, numbers, content, parts, raw = 0, hashlib.sha256(), hashlib.sha256(), [], []
                for part in codec.pieces(text.as_py() or ""):
                    if not len(part):
                        continue
                    numbers.update(codec.decimals(part)[0 if n else 1 :])
                    plain = codec.decode(part)
                    content.update(plain)
                    n += len(part)
                    if ids:
                        parts.append(part)
                    if decoded:
                        raw.append(bytes(plain))
                counts.append(n)
                hashed.append(numbers.hexdigest())
                back.append(content.hexdigest())
                all_ids += parts
                all_bytes.append(b"".join(raw))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                ends = pa.array(np.append(0, np.cumsum(counts, dtype=np.int64)), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*all_ids, np.zeros(0, np.uint32)]), pa.int32())))
                names.append("ids")
            if decoded:
                columns.append(pa.array(all_bytes, pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded binary" * decoded
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
