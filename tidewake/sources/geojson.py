"""GeoJSON feature collections, read by as many tasks as a file has scan splits.

A file is scanned as records that end at closing braces, wherever these stand, so Spark cuts it
at byte ranges like any text. Whether a record begins inside a string follows from the number of
quotation marks before it, and how deep it begins from the brackets before it: both are running
sums, formed per scan split and carried over by a summary with one row per split. A feature ends
where the depth falls back to that of the ``features`` array; the records between two such ends
are its text. Features become JSON lines, which Spark's own reader takes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.plans.ordered import running_sum
from tidewake.session import stage, stage_folder

_OPENING = re.compile(r'"features"\s*:\s*\[')
_SIGNS = re.compile(r'\\.|["{}\[\]]', re.S)


def _brackets(text: Column, inside: Column) -> Column:
    """Brackets of a record outside its strings; ``inside`` tells whether it begins in one. Pairs of
    square brackets, such as those of positions, are taken out."""
    plain = F.regexp_replace(text, r"\\.", "")
    plain = F.when(inside, F.regexp_replace(plain, '^[^"]*("|$)', "")).otherwise(plain)
    out = F.regexp_replace(F.regexp_replace(plain, '"[^"]*("|$)', ""), r"[^\[\]{}]", "")
    for _ in range(4):
        out = F.replace(out, F.lit("[]"), F.lit(""))
    return out


def _depths(brackets: Column) -> Column:
    """``net`` and ``least`` change of depth over a record's brackets."""
    start = F.struct(F.lit(0).alias("net"), F.lit(0).alias("least"))

    def turn(state: Column, sign: Column) -> Column:
        net = state["net"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(net.alias("net"), F.least(state["least"], net).alias("least"))

    return F.aggregate(F.split(brackets, ""), start, turn)


def _array_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the ``features`` member of the outermost object opens its array, in records that name one."""
    for batch in batches:
        found = []
        for file, start, row, value, inside, depth in zip(*(batch[c] for c in ("file", "start", "row", "value", "inside", "depth"))):
            openings = {m.end(): m.start() for m in _OPENING.finditer(value)}
            quoted, level, names = bool(inside), depth, set()
            for sign in _SIGNS.finditer(value):
                mark = sign.group()
                if mark == '"':
                    if not quoted and level == 1:
                        names.add(sign.start())
                    quoted = not quoted
                elif not quoted and mark in "[{":
                    if mark == "[" and level == 1 and openings.get(sign.end()) in names:
                        found.append((file, start, row, sign.end()))
                        break
                    level += 1
                elif not quoted and mark in "]}":
                    level -= 1
        yield pd.DataFrame(found, columns=["file", "start", "row", "offset"])


def feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``number`` (place among the file's features), ``feature`` (its text); for each file also a row
    with ``number`` NULL whose ``feature`` is the collection without its features.

    Files that hold no feature collection give none. The input is scanned once; the steps on its
    records are written as they are formed."""
    scanned = stage(spark.read.option("lineSep", "}").text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("start"),
        F.monotonically_increasing_id().alias("row"), "value"))
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '[^"]', ""))
    counted = running_sum(scanned.withColumn("quotes", quotes), ["file"], "start", "row", "quotes", "upto")
    inside = (F.col("upto") - F.col("quotes")) % 2 == 1
    turned = counted.withColumns({"inside": inside, "closed": F.col("upto") % 2 == 0}).withColumn(
        "brackets", _brackets(F.col("value"), F.col("inside"))).withColumn("turn", _depths(F.col("brackets")))
    # the brace after a record belongs to it
    turned = turned.withColumn("net", F.col("turn.net") - F.col("closed").cast("int")).drop("quotes", "upto", "brackets")
    # each running sum and what follows it reads its rows several times: they are formed once
    levels = stage(running_sum(stage(turned), ["file"], "start", "row", "net", "after").withColumn("depth", F.col("after") - F.col("net")))

    named = levels.where(F.contains("value", F.lit('"features"'))).select("file", "start", "row", "value", "inside", "depth")
    opening = stage(named.mapInPandas(_array_starts, "file string, start long, row long, offset int").groupBy("file").agg(
        F.min(F.struct("start", "row", "offset")).alias("o")).select(
        F.col("file").alias("__file"), F.struct("o.start", "o.row").alias("first"), F.col("o.offset").alias("offset")))
    place = F.struct("start", "row")
    known = levels.join(opening, F.col("file") == F.col("__file")).drop("__file")
    opens = place == F.col("first")
    # below the array: in its first record only what follows its bracket
    rest = F.expr("substring(value, offset + 1)")
    low = F.when(opens, 2 + _depths(_brackets(rest, F.lit(False)))["least"]).otherwise(F.col("depth") + F.col("turn.least"))
    closes = (place >= F.col("first")) & (low < 2)
    ends = (place >= F.col("first")) & F.col("closed") & (F.col("after") == 2) & (low >= 2)
    marked = known.select("file", "start", "row", "value", place.alias("place"), "first", "offset", opens.alias("opens"), closes.alias("closes"), ends.alias("ends"))
    last = marked.where("closes").groupBy("file").agg(F.min("place").alias("last")).withColumnRenamed("file", "__file")
    bounded = marked.join(last, F.col("file") == F.col("__file"), "left").drop("__file")
    within = (F.col("place") >= F.col("first")) & (F.col("last").isNull() | (F.col("place") < F.col("last")))
    bounded = bounded.withColumn("within", within).withColumn("ended", (F.col("within") & F.col("ends")).cast("int"))
    numbered = stage(running_sum(stage(bounded), ["file"], "start", "row", "ended", "upto").withColumn("number", F.col("upto") - F.col("ended")))

    text = F.when(F.col("opens"), rest).otherwise(F.col("value"))
    parts = stage(numbered.where("within").groupBy("file", "start", "number").agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", text.alias("t")))), lambda r: r["t"]), "}")).alias("t"),
        F.max("ended").alias("ended")))
    # a split's first feature may have begun before it, its last may end after it
    edges = parts.groupBy("file", "start").agg(F.min("number").alias("lo"), F.max("number").alias("hi")).select(
        F.col("file").alias("__file"), F.col("start").alias("__start"), "lo", "hi")
    split = parts.join(edges, (F.col("file") == F.col("__file")) & (F.col("start") == F.col("__start"))).withColumn(
        "edge", (F.col("number") == F.col("lo")) | (F.col("number") == F.col("hi")))
    merged = split.where("edge").groupBy("file", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "t"))), lambda r: r["t"]), "}").alias("t"), F.max("ended").alias("ended"))
    whole = split.where("NOT edge").select("file", "number", "t", "ended").unionByName(merged).where("ended = 1")
    features = whole.select("file", F.col("number").cast("long").alias("number"), F.concat(F.regexp_replace("t", r"^[\s,]*", ""), F.lit("}")).alias("feature"))

    head = F.when(F.col("opens"), F.expr("substring(value, 1, offset)")).otherwise(F.col("value"))
    frame = numbered.where("NOT within OR opens").groupBy("file").agg(F.array_sort(F.collect_list(F.struct(
        "place", F.when(F.col("opens") & F.col("closes"), F.col("value")).otherwise(head).alias("t"), F.col("opens").alias("o")))).alias("r"))
    joined = F.aggregate("r", F.lit(""), lambda text, r: F.concat(text, r["t"], F.when(r["o"] & ~F.endswith(r["t"], F.lit("[")), "}").when(r["o"], "").otherwise("}")))
    return features.unionByName(frame.select("file", F.lit(None).cast("long").alias("number"), joined.alias("feature")))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``number``, ``f`` (the parsed feature, all values text) of every feature, and of each file a row with
    ``frame``, the text of the collection without its features; columns that nothing fills are absent."""
    lines = feature_lines(spark, path)
    # JSON has line breaks between its signs only
    feature = F.concat(F.regexp_replace(F.to_json(F.struct("file", "number")), r"\}$", ',"f":'), F.regexp_replace("feature", r"[\r\n]", " "), F.lit("}"))
    frame = F.to_json(F.struct("file", F.col("feature").alias("frame")))
    folder = f"{stage_folder(spark)}/features-{uuid.uuid4().hex}"
    lines.select(F.when(F.col("number").isNull(), frame).otherwise(feature).alias("value")).write.text(folder)
    return spark.read.option("primitivesAsString", True).json(folder)


def file_offsets(counts: DataFrame) -> DataFrame:
    """Rows of all files before each (``file``, ``rows``) by name; one row per file."""
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(F.col("file").alias("__file"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__offset"))
