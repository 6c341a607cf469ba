"""Alignment of two tokenizers' tokens, with exact deduplication of texts.

Documents are shuffled by their full text; each distinct text is tokenised and aligned once and
carries its number of copies. Pair counts are sums of copies, and a text's measures are joined
back to all documents that hold it.

Byte offsets where tokens of both sides end cut the tokens into groups; tokens of a group are
linked. Long texts are cut at single spaces between other characters, where tokens of both sides
end in any case, so that a piece is aligned by itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.bpe import Recent, byte_letters
from tidewake.llm.workers import kept
from tidewake.session import stage

#: Characters of a text that are tokenised by themselves, where it has a place to cut.
PIECE = 1 << 16
#: Characters of texts aligned at a time.
GROUP = 1 << 18
#: Links made at a time.
LINKS = 1 << 21
#: Id pairs of highest count that every executor holds (about 50 bytes each); others are joined.
HELD_PAIRS = 1 << 19

#: Words that each of the cache's two generations holds (about 250 bytes each).
CACHE_WORDS = 150_000

#: A place where both sides' tokens end: neither joins a character to a space after it.
CUT = re.compile("(?<=[!-~\xa1-\xff]) (?=[!-~\xa1-\xff])")


@dataclass
class Aligned:
    """What the alignment of one piece of text gives."""

    n_a: int
    n_b: int
    n_groups: int
    groups: bytes  # without the last semicolon
    pairs: np.ndarray  # distinct id pairs, ascending: a * size of B + b
    links: np.ndarray  # occurrences of each


class Aligner:
    """Side A: a byte-level file of the tokenizers library; side B: a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        spec = json.load(open(path_a, encoding="utf-8"))
        number = {letter: b for b, letter in enumerate(byte_letters())}
        tokens = [b""] * self.a.get_vocab_size()
        for token, i in spec["model"]["vocab"].items():
            tokens[i] = bytes(map(number.__getitem__, token))
        for token in spec["added_tokens"]:
            tokens[token["id"]] = token["content"].encode()
        self.bytes_a = pa.array(tokens, pa.large_binary())
        self.length_a = np.array(list(map(len, tokens)), np.int64)

        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        pieces = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i)
                  else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        self.bytes_b = pa.array(pieces, pa.large_binary())
        self.length_b = np.array(list(map(len, pieces)), np.int64)
        self.size_b = size
        # of each side's decimal ids, followed by a comma or, at the end of a group, by its mark
        marked = [b"%d%b" % (i, end) for n, last in ((len(tokens), b"|"), (size, b";")) for i in range(n) for end in (b",", last)]
        self.marked = pa.array(marked, pa.large_binary())
        self.first_b = 2 * len(tokens)
        self.packed = ["H" if n <= 1 << 16 else "I" for n in (len(tokens), size)]
        self.recent = Recent(CACHE_WORDS)

    @staticmethod
    def _taken(table: pa.Array, index: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Entries of a table one after another, and the n + 1 places where they begin."""
        taken = table.take(pa.array(index))
        data = taken.buffers()[2]
        return memoryview(data or b"").cast("B"), np.frombuffer(taken.buffers()[1], np.int64)[: len(index) + 1]

    def align(self, pieces: list[str]) -> list[Aligned | None]:
        """Alignment of each text by itself; None where the joined tokens are not the space and the text."""
        split = [CUT.split(p) for p in pieces]
        known = self._known(set().union(*split))
        (flat_a, ends_a), (flat_b, ends_b) = (
            _flat([b"".join([known[w][side] for w in words]) for words in split], self.packed[side]) for side in (0, 1))
        whole = [b" " + p.encode() for p in pieces]
        content_a, at_a = self._taken(self.bytes_a, flat_a)
        content_b, at_b = self._taken(self.bytes_b, flat_b)
        same = np.array([
            content_a[at_a[ends_a[i]] : at_a[ends_a[i + 1]]] == w and content_b[at_b[ends_b[i]] : at_b[ends_b[i + 1]]] == w
            for i, w in enumerate(whole)], bool)
        n_a, n_b = np.diff(ends_a) * same, np.diff(ends_b) * same
        keep_a, keep_b = np.repeat(same, np.diff(ends_a)), np.repeat(same, np.diff(ends_b))
        a, b = flat_a[keep_a], flat_b[keep_b]
        of_a = np.repeat(np.arange(len(pieces)), n_a)

        stop_a, stop_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        last_a, last_b = _among(stop_a, stop_b), _among(stop_b, stop_a)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        total = int(last_a.sum())
        of_group = of_a[last_a]
        groups = np.bincount(of_group, minlength=len(pieces))

        # tokens in the order in which they are written: of each group A's, then B's
        upto_a = np.append(0, np.flatnonzero(last_a) + 1)
        upto_b = np.append(0, np.flatnonzero(last_b) + 1)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + upto_b[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + upto_a[group_b + 1]] = self.first_b + 2 * b + last_b
        written, places = self._taken(self.marked, order)
        text_ends = places[np.append(0, np.cumsum(n_a + n_b))]

        out: list[Aligned | None] = [
            Aligned(int(n_a[i]), int(n_b[i]), int(groups[i]), bytes(written[text_ends[i] : max(text_ends[i], text_ends[i + 1] - 1)]),
                    np.zeros(0, np.int64), np.zeros(0, np.int64)) if same[i] else None for i in range(len(pieces))]
        collected: dict[int, list] = {}
        for of, pairs, links in self._links(a, group_a, b, group_b, of_group, total):
            for i in np.unique(of).tolist():
                lo, hi = np.searchsorted(of, [i, i + 1])
                collected.setdefault(i, []).append((pairs[lo:hi], links[lo:hi]))
        for i, parts in collected.items():  # parts are ascending
            out[i].pairs = np.concatenate([p for p, _ in parts])
            out[i].links = np.concatenate([n for _, n in parts])
        return out

    def _known(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Packed ids of both sides for each word; words met lately are not tokenised again."""
        new = self.recent.missing(words)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            found_a = self.a.encode_batch_fast([" " + w for w in part], add_special_tokens=False)
            found_b = self.b.encode(part, num_threads=1)
            for word, a, b in zip(part, found_a, found_b):
                self.recent.now[word] = array(self.packed[0], a.ids).tobytes(), array(self.packed[1], b).tobytes()
        return self.recent.now

    def _links(self, a, group_a, b, group_b, of_group, total: int):
        """(text, pair, links) in ascending order, in blocks of about ``LINKS`` of them. A pair of ids of a
        group is one link with a weight, however often either occurs in the group."""
        size_a = len(self.length_a)
        key = (of_group[group_a] * size_a + a) * max(1, total) + group_a  # by text, id, group
        key, times_a = np.unique(key, return_counts=True)
        head, of_key = np.divmod(key, max(1, total))
        b_key, times_b = np.unique(group_b * self.size_b + b, return_counts=True)
        b_first = np.searchsorted(b_key, np.arange(total + 1) * self.size_b)
        spread = (b_first[1:] - b_first[:-1])[of_key]
        # blocks of whole (text, id) runs
        opens = np.append(np.flatnonzero(np.append(True, head[1:] != head[:-1])[: len(head)]), len(head))
        upto = np.append(0, np.cumsum(spread))[opens]
        run = 0
        while run < len(opens) - 1:
            later = max(run + 1, int(np.searchsorted(upto, upto[run] + LINKS, side="right")) - 1)
            at, end, run = int(opens[run]), int(opens[later]), later
            part = slice(at, end)
            n = spread[part]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            index = np.repeat(b_first[of_key[part]], n) + within
            text, a_id = np.divmod(np.repeat(head[part], n), size_a)
            pair = a_id * self.size_b + b_key[index] % self.size_b
            weight = np.repeat(times_a[part], n) * times_b[index]
            order = np.lexsort((pair, text))
            text, pair, weight = text[order], pair[order], weight[order]
            new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])))
            if len(pair):
                yield text[new], pair[new], np.add.reduceat(weight, new)


def _flat(packed: list[bytes], code: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the n + 1 places where each text's begin."""
    size = array(code).itemsize
    return np.frombuffer(b"".join(packed), code).astype(np.int64), np.append(0, np.cumsum([len(p) // size for p in packed], dtype=np.int64))


def _among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Which of ``values`` occur in ``sorted_values``."""
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def cut(text: str, piece: int = PIECE) -> Iterator[str]:
    """Pieces of about ``piece`` characters; the spaces at the cuts belong to no piece."""
    at = 0
    while len(text) - at > piece:
        place = CUT.search(text, at + piece)
        if not place:
            break
        yield text[at : place.start()]
        at = place.end()
    yield text[at:]


class _Measures:
    """A text's measures, piece after piece."""

    def __init__(self):
        self.counts, self.hash, self.same, self.parts = np.zeros(3, np.int64), hashlib.sha256(), True, []

    def add(self, found: Aligned | None) -> None:
        if found is None or not self.same:
            self.same, self.parts = False, []
            return
        if self.parts:
            self.hash.update(b";")
        self.counts += (found.n_a, found.n_b, found.n_groups)
        self.hash.update(found.groups)
        self.parts.append((found.pairs, found.links))
        if len(self.parts) > 64:
            self.parts = [self.pairs()]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self.parts[0]
        pair = np.concatenate([p for p, _ in self.parts])
        links = np.concatenate([n for _, n in self.parts])
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        return pair[new], np.add.reduceat(links[order], new)


def align_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Alignment of each text (``key``, ``copies``, ``text``, none of it NULL or empty): ``key``, ``copies``,
    ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256``, ``pairs`` (distinct), ``links`` (of each).

    Texts whose tokens of either side do not give the space and the text have no row."""

    def run(batches):
        aligner = kept(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches:
            done: dict[int, _Measures] = {}
            waiting: list[tuple[int, str]] = []
            size = 0

            def flush():
                for (i, _), found in zip(waiting, aligner.align([p for _, p in waiting])):
                    done.setdefault(i, _Measures()).add(found)
                waiting.clear()

            for i, text in enumerate(batch.column("text")):
                for piece in cut(text.as_py()):
                    waiting.append((i, piece))
                    size += len(piece)
                    if size >= GROUP:
                        flush()
                        size = 0
                if len(done) > 1 and size == 0:
                    yield rows(batch, {k: done.pop(k) for k in list(done) if k != i})
            if waiting:
                flush()
            yield rows(batch, done)

    def rows(batch, done: dict[int, _Measures]):
        done = {i: m for i, m in done.items() if m.same}
        index = pa.array(list(done), pa.int64())
        counts = np.array([m.counts for m in done.values()], np.int64).reshape(-1, 3)
        lists = [m.pairs() for m in done.values()]
        ends = pa.array(np.append(0, np.cumsum([len(p) for p, _ in lists], dtype=np.int64)), pa.int32())
        pairs, links = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in lists)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([
            batch.column("key").take(index), batch.column("copies").take(index), *map(pa.array, counts.T.copy()),
            pa.array([m.hash.hexdigest() for m in done.values()], pa.string()),
            pa.ListArray.from_arrays(ends, pa.array(pairs)), pa.ListArray.from_arrays(ends, pa.array(links))],
            ["key", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "links"])

    return texts.select("key", "copies", "text").mapInArrow(
        run, "key binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, links array<long>")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked), ``best`` (1 where none of its A id has more)."""
    counts = aligned.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("n"))
    counts = stage(counts.withColumn("a", F.expr(f"pair div {size_b}")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def _least_held(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` pairs have it or more. Counts are binned by their
    binary logarithm in eighths, so the driver reads some hundred rows."""
    step = F.floor(F.log2("n") * 8)
    bins = counts.groupBy(step.alias("bin")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.col("bin").desc()).collect()
    held, least = 0, None
    for row in bins:
        held += row["pairs"]
        if held > most:
            break
        least = row["least"]
    return least if least is not None else (1 << 62)


def text_measures(aligned: DataFrame, counts: DataFrame, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """``key``, ``n_links``, ``n_best``, ``count_sum`` of each text.

    The ``held_pairs`` most frequent pairs, most of all links, are broadcast; links of the others
    are joined by a shuffle. Sums per text are formed before they move."""
    counts = stage(counts)
    least = _least_held(counts, held_pairs)
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "links")).alias("l")).select(
        "key", F.col("l.pairs").alias("pair"), F.col("l.links").alias("links"))
    held = F.broadcast(counts.where(F.col("n") >= least))
    matched = links.join(held, "pair").select("key", "links", "n", "best")
    others = counts.where(F.col("n") < least)
    if others.take(1):
        matched = matched.unionAll(links.join(held.select("pair"), "pair", "left_anti").join(others, "pair").select("key", "links", "n", "best"))
    return matched.groupBy("key").agg(
        F.sum("links").alias("n_links"), F.sum(F.col("links") * F.col("best")).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))


def vocabulary_size(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def align_documents(docs: DataFrame, path_a: str, path_b: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` of every document.

    A space and the text are tokenised by A, the text by B, which adds the space; special tokens in
    a text are plain text. Texts that are NULL or empty, or whose joined tokens of either side are
    not the space and the text, have no tokens: zeros and an empty hash column. A pair of ids
    counts once per document; ``n_best`` counts links whose pair no other of its A id exceeds, ties
    included. One row per input row, repeated rows and NULL ids included; other columns are
    dropped; an empty table gives an empty one. Long texts are taken in pieces; the links of a text
    are held together by their distinct id pairs.
    """
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = F.unhex(F.sha2("text", 256))
    texts = keyed.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies")).select(key.alias("key"), "copies", "text")
    aligned = stage(align_texts(texts, path_a, path_b))
    counts = pair_counts(aligned, vocabulary_size(path_b))
    totals = text_measures(aligned, counts, held_pairs).withColumnRenamed("key", "__of")
    measures = aligned.join(totals, F.col("key") == F.col("__of"), "left").select(
        "key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    named = keyed.select("doc_id", key.alias("__key"))
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return named.join(measures, F.col("__key") == F.col("key"), "left").select(
        "doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
