"""URL filtering by a blocked Bloom filter in front of an exact hash join.

Rules name a host and a path. A rule fits a URL of its host or of a subdomain whose path
starts with the rule's path; the longest fitting rule decides, and a URL without one gets the
default verdict. Listed keys (host + path) set eight bits in one 256-bit block of the filter.
A URL's possible keys (suffixes of its host by prefixes of its path, only of shapes that the
list has) are tested against the filter; URLs without a hit are decided at once and never
move. Only URLs with a hit go through the hash join, which removes the false positives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound on the filter: 2^18 blocks of 32 bytes, 8 MiB. A longer list fills the filter more
#: densely; more URLs then reach the exact join, with the same result.
MOST_BLOCKS = 1 << 18
BITS_PER_KEY = 16

_LANES = np.array([2 * i + 1 for i in range(8)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _marks(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash and its eight 32-bit words with one bit each."""
    hashes = hashes.astype(np.int64).view(np.uint64)
    block = (hashes >> np.uint64(20)) & np.uint64(blocks - 1)
    bit = (hashes[:, None] * _LANES) >> np.uint64(59)
    return block.astype(np.int64), np.uint32(1) << bit.astype(np.uint32)


def build_filter(keys: DataFrame) -> np.ndarray:
    """Filter (blocks x 8 words) over the string column ``key``.

    Tasks reduce their keys to one filter each, and filters are merged by OR in a tree: nothing
    but filters of a bounded size moves.
    """
    rows = keys.count()
    blocks = 1 << max(0, min(MOST_BLOCKS.bit_length() - 1, int(np.ceil(np.log2(max(1, rows) * BITS_PER_KEY / 256)))))

    def per_task(batches):
        bits, seen = np.zeros((blocks, 8), np.uint32), False
        for pdf in batches:
            block, mark = _marks(pdf["h"].to_numpy(), blocks)
            np.bitwise_or.at(bits, block, mark)
            seen = seen or len(pdf) > 0
        if seen:
            used = np.flatnonzero(bits.any(axis=1))
            yield pd.DataFrame({"block": used, "bits": list(bits[used].view(np.int32).astype(np.int64))})

    parts = keys.select(F.xxhash64("key").alias("h")).mapInPandas(per_task, "block long, bits array<long>")
    merged = parts.groupBy("block").agg(*[F.bit_or(F.col("bits")[i]).alias(f"w{i}") for i in range(8)])
    out = np.zeros((blocks, 8), np.uint32)
    for row in merged.toLocalIterator():  # at most `blocks` rows
        out[row[0]] = np.array(row[1:], np.int64).astype(np.uint32)
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and the path up to ``?`` or ``#``; empty
    where the URL is NULL or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    path = rest.substr(F.char_length(host) + 1, F.char_length(rest))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _possible(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys of a URL for the list's shapes (labels of the host, characters of the path), longest first."""
    labels = F.size(F.split(host, "\\."))
    keys = [
        F.when(
            (labels >= n) & (F.char_length(path) >= size),
            F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)),
        )
        for n, size in sorted(shapes, reverse=True)
    ]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Rows of ``urls`` with ``host``, ``path``, ``rule`` (host + path of the deciding rule) and
    ``verdict``; columns of those names are replaced, all others stay.

    ``rules`` has ``host``, ``path``, ``verdict``. Repeated rules count once; of rules for the
    same host and path with different verdicts ``block`` wins. Rules with a NULL are ignored.
    The longest rule has the most characters in host and path, among equals in the host. Empty tables give
    empty results; repeated rows of ``urls`` stay repeated. The shapes of the list (pairs of
    label count and path length, not of rules) are held by the driver.
    """
    listed = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy(F.concat("host", "path").alias("key"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.when(F.max((F.col("verdict") == "block").cast("int")) == 1, "block").otherwise(F.max("verdict")).alias("rule_verdict"))
    )
    shapes = [
        tuple(r) for r in listed.select(
            F.size(F.split("rule_host", "\\.")).alias("n"), F.char_length("rule_path").alias("size")).distinct().collect()
    ]
    bits = urls.sparkSession.sparkContext.broadcast(build_filter(listed))

    @F.pandas_udf("array<boolean>")
    def hits(hashes: pd.Series) -> pd.Series:
        if not len(hashes):
            return pd.Series([], dtype=object)
        filled = bits.value
        sizes = hashes.str.len().to_numpy()
        flat = np.concatenate([np.asarray(h, np.int64) for h in hashes]) if sizes.sum() else np.zeros(0, np.int64)
        block, mark = _marks(flat, len(filled))
        hit = ((filled[block] & mark) == mark).all(axis=1)
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1]))

    host, path = split_url(F.col(url))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = urls.select(*kept, host.alias("host"), path.alias("path"))
    tested = parsed.withColumn("__keys", _possible(F.col("host"), F.col("path"), shapes))
    tested = tested.withColumn("__hits", hits(F.transform("__keys", lambda k: F.xxhash64(k))))
    tested = tested.withColumn(
        "__keys", F.filter(F.zip_with("__keys", "__hits", lambda k, h: F.when(h, k)), lambda k: k.isNotNull()))

    # the exact join, once for each distinct URL part that has a possible hit
    exact = (
        tested.where(F.size("__keys") > 0).select(F.col("host").alias("__host"), F.col("path").alias("__path"), "__keys")
        .select("__host", "__path", F.explode("__keys").alias("key")).distinct()
        .join(listed, "key")
        .groupBy("__host", "__path")
        .agg(F.max(F.struct(
            F.char_length("key").alias("a"), F.char_length("rule_host").alias("b"),
            F.col("key").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
        .select("__host", "__path", "best.rule", "best.verdict")
    )
    decided = (
        tested.where(F.size("__keys") > 0)
        .join(exact, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
        .select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )
    clear = tested.where(F.size("__keys") == 0).select(
        *kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return decided.unionAll(clear)
