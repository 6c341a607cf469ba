"""File manifests, lineage checks and content fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import islice
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.session import stage

# Fixed value: the three manifests an artifact's lineage names.
MANIFESTS = ("build", "source", "style")
# Names of object stores in Hadoop and in Arrow.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
#: Entries of a folder that a task holds at once.
LISTED_ROWS = 10_000


def file_manifest(
    spark: SparkSession, root: str, open_stream: Callable[[str], BinaryIO] | None = None,
    list_folder: Callable[[str], Iterable[tuple[str, bool]]] | None = None,
) -> DataFrame:
    """(path, bytes, sha256) of every file under ``root`` (empty ones too), relative paths.

    Tasks list the folders and read the files, block by block, so a file of any size needs one
    block of memory and no list of paths passes through the driver. ``open_stream`` opens an address
    for reading and ``list_folder`` yields (address, whether it is a folder) where the defaults,
    Arrow's file systems, don't know its scheme. Names that begin with ``_`` or ``.`` are not listed.
    """
    base = root.rstrip("/")
    listed = _spread(list_files(spark, base, list_folder or _arrow_folder))
    hashed = listed.mapInPandas(_hashes(open_stream or _arrow_stream), "path string, bytes long, sha256 string")
    inner = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", base)
    below = F.when(F.startswith("path", F.lit(base + "/")), F.substring("path", len(base) + 2, 1 << 30))
    return hashed.withColumn("path", below.otherwise(F.regexp_replace("path", "^.*?" + _quoted(inner) + "/", "")))


def _spread(addresses: DataFrame) -> DataFrame:
    """Addresses over a fixed number of tasks: the work behind one is not seen in its bytes, by which
    Spark would merge them."""
    return addresses.repartition(int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions")), "address")


def list_files(spark: SparkSession, root: str, list_folder: Callable[[str], Iterable[tuple[str, bool]]]) -> DataFrame:
    """``address`` of every file under ``root``: round by round, the folders found in one round are
    listed side by side by the tasks of the next. There are as many rounds as levels of folders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = ((a, inner) for folder in batch["address"] for a, inner in list_folder(folder)
                     if not a.rstrip("/").rsplit("/", 1)[-1].startswith(("_", ".")))
            while some := list(islice(found, LISTED_ROWS)):
                yield pd.DataFrame(some, columns=["address", "folder"])

    level, files = spark.createDataFrame([(root,)], "address string"), []
    while True:
        entries = stage(_spread(level).mapInPandas(run, "address string, folder boolean"))
        files.append(entries.where("NOT folder").select("address"))
        level = entries.where("folder").select("address")
        if not level.take(1):
            return reduce(DataFrame.unionAll, files)


def _arrow_folder(address: str) -> Iterator[tuple[str, bool]]:
    from pyarrow import fs

    system, inner, prefix = arrow_place(address)
    if system.get_file_info(inner).type == fs.FileType.File:
        yield address, False
        return
    for entry in system.get_file_info(fs.FileSelector(inner)):
        yield prefix + entry.path, entry.type == fs.FileType.Directory


def arrow_place(address: str):
    """(file system, path in it, what to put before its paths) of an address."""
    from pyarrow import fs

    scheme, colon, rest = address.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), address, ""
    if scheme == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest), "file:"
    system, inner = fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}")
    return system, inner, address[: len(address.rstrip("/")) - len(inner)]


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def _arrow_stream(address: str) -> BinaryIO:
    system, inner, _ = arrow_place(address)
    return system.open_input_stream(inner)


def _hashes(open_stream: Callable[[str], BinaryIO]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for address in batch["address"]:
                digest, length = hashlib.sha256(), 0
                with open_stream(address) as stream:
                    while block := stream.read(1 << 20):
                        digest.update(block)
                        length += len(block)
                rows.append((address, length, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "bytes", "sha256"])

    return run


def checksum_lines(manifest: DataFrame) -> DataFrame:
    """Lines of a SHA256SUMS file in path order."""
    return manifest.orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("value"))


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``missing:<path>`` and ``sha256:<path>`` errors of an expected manifest."""
    have = actual.select(F.col("path").alias("__p"), F.col("sha256").alias("__s"))
    error = F.when(F.col("__p").isNull(), F.concat(F.lit("missing:"), "path")).when(
        ~F.col("sha256").eqNullSafe(F.col("__s")), F.concat(F.lit("sha256:"), "path"))
    return expected.join(have, F.col("path") == F.col("__p"), "left").select(error.alias("error")).filter("error IS NOT NULL")


def pinned_digests(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Pinned inputs: for each name the first listed location that exists, and whether its
    digest is the pinned one. ``expected``: (name, locations array, sha256)."""
    places = expected.select("name", F.col("sha256").alias("pinned"), F.posexplode("locations").alias("pos", "path"))
    have = actual.select("path", "sha256")
    first = places.join(have, "path").groupBy("name").agg(F.min_by(F.struct("path", "sha256"), "pos").alias("f"))
    return expected.join(first, "name", "left").select(
        "name", F.col("f.path").alias("path"),
        F.when(F.col("f").isNull(), "MISSING").when(F.col("f.sha256") == F.col("sha256"), "OK")
        .otherwise("DIGEST_MISMATCH").alias("status"),
    )


def row_fingerprint(df: DataFrame, columns=None) -> DataFrame:
    """sha256 of each row's canonical JSON: keys sorted, no spaces, NULL keys kept."""
    names = sorted(columns or df.columns)
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return df.withColumn("fingerprint", F.sha2(text, 256))


def table_fingerprint(df: DataFrame, columns=None) -> DataFrame:
    """Order-independent fingerprint of a table: row count and the sum of row digests.

    Each digest contributes its 256 bits as four 64-bit words, which are summed as decimals: a
    partial aggregate without any sort or collection.
    """
    rows = row_fingerprint(df, columns).select("fingerprint")

    def word(i: int):
        return F.conv(F.substring("fingerprint", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")

    sums = [F.sum(word(i)).cast("string").alias(f"w{i}") for i in range(4)]
    return rows.agg(F.count("*").alias("rows"), *sums).select(
        "rows", F.sha2(F.concat_ws(":", "rows", *[F.coalesce(f"w{i}", F.lit("0")) for i in range(4)]), 256).alias("fingerprint"))


def sidecars(artifacts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Lineage records: artifacts (path, sha256, build_path, source_path, style_path) with
    the digests of their three manifests (path, sha256)."""
    out = artifacts.select(
        F.col("path").alias("artifact"), F.col("sha256").alias("artifact_sha256"),
        *[F.col(f"{m}_path") for m in MANIFESTS])
    for m in MANIFESTS:
        part = manifests.select(F.col("path").alias(f"__{m}"), F.col("sha256").alias(f"{m}_sha256"))
        out = out.join(part, F.col(f"{m}_path") == F.col(f"__{m}"), "left").drop(f"__{m}")
    return out


def verify_lineage(records: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """Errors and warnings of each artifact's lineage record.

    ``records``: output of :func:`sidecars`; ``files``: current (path, sha256); ``contents``:
    parsed manifests (path, manifest_id, source_manifest_id, source_manifest_sha256,
    palette_sha256, canonical_repository, release_sha256).
    """
    def current(df: DataFrame, column: str, name: str) -> DataFrame:
        part = files.select(F.col("path").alias("__p"), F.col("sha256").alias(name))
        return df.join(part, F.col(column) == F.col("__p"), "left").drop("__p")

    df = current(records, "artifact", "now_artifact")
    for m in MANIFESTS:
        df = current(df, f"{m}_path", f"now_{m}")
        part = contents.select(F.col("path").alias("__p"), F.struct(*[c for c in contents.columns if c != "path"]).alias(f"c_{m}"))
        ok = F.when(F.col(f"now_{m}") == F.col(f"{m}_sha256"), F.col(f"{m}_path"))
        df = df.withColumn("__k", ok).join(part, F.col("__k") == F.col("__p"), "left").drop("__k", "__p")
    # The codes of errors and warnings below.
    errors = [
        F.when(F.col("now_artifact").isNull(), F.lit("missing-artifact"))
        .when(F.col("now_artifact") != F.col("artifact_sha256"), F.lit("artifact-sha256-mismatch")),
    ]
    for m in MANIFESTS:
        errors.append(
            F.when(F.col(f"{m}_path").isNull() | F.col(f"{m}_sha256").isNull(), F.lit(f"missing-{m}-manifest-reference"))
            .when(F.col(f"now_{m}").isNull(), F.lit(f"missing-{m}-manifest"))
            .when(F.col(f"now_{m}") != F.col(f"{m}_sha256"), F.lit(f"{m}-manifest-sha256-mismatch")))
    both = F.col("c_build").isNotNull() & F.col("c_source").isNotNull()
    errors += [
        F.when(both & ~F.col("c_build.source_manifest_sha256").eqNullSafe(F.col("now_source")),
               F.lit("build-source-manifest-link-mismatch")),
        F.when(both & ~F.col("c_build.source_manifest_id").eqNullSafe(F.col("c_source.manifest_id")),
               F.lit("build-source-manifest-id-mismatch")),
        F.when(F.col("c_build").isNotNull() & F.col("c_style").isNotNull()
               & ~F.col("c_build.palette_sha256").eqNullSafe(F.col("c_style.palette_sha256")),
               F.lit("build-style-theme-hash-mismatch")),
    ]
    warnings = [
        F.when(F.coalesce("c_build.canonical_repository", F.lit("")) == "",
               F.lit("canonical-repository-not-configured-before-publication")),
        F.when(F.coalesce("c_build.release_sha256", F.lit("")) == "",
               F.lit("canonical-release-manifest-anchor-not-configured")),
    ]
    return df.select(
        "artifact", F.array_compact(F.array(*errors)).alias("errors"),
        F.array_compact(F.array(*warnings)).alias("warnings"),
    ).withColumn("ok", F.size("errors") == 0)


def build_manifest(metrics: DataFrame, build_id: str, parameters: dict[str, str], source_manifest_sha256: str) -> DataFrame:
    """One row: build parameters, source manifest link and metrics as a map of counts.

    Entries are named ``metric/key``, or ``metric`` where the key is NULL or blank; values under
    one name are added. The map has an entry per distinct key, so keys must be enumerations;
    for free keys keep the metrics table itself.
    """
    params = F.create_map(*[F.lit(x) for kv in sorted(parameters.items()) for x in kv]) if parameters else F.create_map().cast("map<string,string>")
    named = metrics.groupBy(F.concat_ws("/", "metric", F.nullif(F.trim("key"), F.lit(""))).alias("k")).agg(F.sum("value").alias("v"))
    entry = F.struct("k", "v")
    return named.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("evidence")).select(
        F.lit(build_id).alias("build_id"), params.alias("parameters"),
        F.lit(source_manifest_sha256).alias("source_manifest_sha256"), "evidence")
