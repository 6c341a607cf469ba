"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, with u from a hash of its id and w its quality weight;
in ascending order of the keys, a prefix of a source is a weighted sample without replacement.
A source's target in words is met by complete epochs first, then by the prefix that fills the
rest; the document at the border is taken in part.

Only one slice of each source needs an order of rows. Keys are mapped to 1,024 slices, sums
per (source, slice) are running-summed per source, and every document outside the slice where
the budget ends is decided by its slice alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.session import stage

SLICES = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def usual_word_length(text: Column, size: Column) -> Column:
    """Quality weight from 0.05 to 1: 1 where a word has 5.5 characters on average (spaces
    counted), less the further the average is from it."""
    mean = F.char_length(text) / size
    return F.when(size > 0, F.greatest(F.least(mean / 5.5, F.lit(5.5) / mean), F.lit(0.05))).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def source_targets(sizes: DataFrame, repeat: int) -> DataFrame:
    """``source``, ``source_size`` -> also ``target``, one row per source.

    Sources in order of code points (NULL last) weigh 1, 2, 3, repeating. A target stops at
    ``repeat`` times the source's size; filling sources in ascending order of size by weight
    gives the fixed point of resharing the excess. Windows over one row per source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", ((F.row_number().over(named) - 1) % 3 + 1).cast("long"))
    filled = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    left = total - repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    full = repeat * F.col("source_size") * F.sum("w").over(rest) <= F.col("w") * left
    capped = ranked.withColumn("total", total).withColumn("full", full)
    free_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(whole)
    free = F.col("total") - repeat * F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(whole)
    target = F.when(F.col("full"), (repeat * F.col("source_size")).cast("double")).otherwise(
        (F.col("w") * free).cast("double") / free_w)
    return capped.select("source", "source_size", target.alias("target"))


def _mixed(docs: DataFrame, size: Column, weight: Column, doc_id: str, source: str, repeat: int, seed: str) -> DataFrame:
    """Rows of ``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__taken``; every column of ``docs`` stays."""
    keyed = docs.select("*", size.alias("__size")).withColumn("__key", sampling_key(F.col(doc_id), weight, seed))
    # 1 - exp(-key) rises with the key from 0 to 1
    keyed = keyed.withColumn(
        "__slice", F.least(F.floor((1 - F.exp(-F.col("__key"))) * SLICES), F.lit(SLICES - 1)).cast("int"))

    sums = keyed.groupBy(F.col(source).alias("source"), "__slice").agg(F.sum("__size").alias("slice_size"))
    sums = stage(sums)  # at most 1,024 rows per source
    targets = source_targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")), repeat)
    by_slice = Window.partitionBy("source").orderBy("__slice")
    ends = sums.withColumn("__end", F.sum("slice_size").over(by_slice)).withColumnRenamed("source", "__of")
    words = F.floor("target").cast("long")
    plan = targets.select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long").alias("__epochs"),
        F.when(F.col("source_size") > 0, words % F.col("source_size")).otherwise(0).alias("__rest"))
    border = (
        plan.join(ends, F.col("__source").eqNullSafe(F.col("__of")))
        .where(F.col("__end") >= F.col("__rest"))
        .groupBy("__source").agg(F.min(F.struct("__slice", (F.col("__end") - F.col("slice_size")).alias("before"))).alias("b")))
    plan = plan.join(
        border.withColumnRenamed("__source", "__at"), F.col("__source").eqNullSafe(F.col("__at")), "left"
    ).select("__source", "__source_size", "__target", "__epochs", "__rest", F.col("b.__slice").alias("__border"), F.col("b.before").alias("__before"))
    plan = stage(plan)  # one row per source

    out = [*docs.columns, "__size", "__source_size", "__target"]
    joined = keyed.join(plan, F.col(source).eqNullSafe(F.col("__source")))
    inside = joined.where(F.col("__slice") != F.col("__border")).select(
        *out, (F.col("__size") * (F.col("__epochs") + (F.col("__slice") < F.col("__border")).cast("long"))).alias("__taken"))
    order = Window.partitionBy(source).orderBy("__key", doc_id, "__size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("__size").over(order), F.lit(0))
    border_rows = joined.where(F.col("__slice") == F.col("__border")).select(
        *out, (F.col("__size") * F.col("__epochs") + F.least(F.greatest(left, F.lit(0)), F.col("__size"))).alias("__taken"))
    return inside.unionAll(border_rows)


def mix_sources(
    docs: DataFrame, size: Column, weight: Column, doc_id: str = "doc_id", source: str = "source",
    repeat: int = 3, seed: str = "mix",
) -> DataFrame:
    """Rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words that the mix
    takes, repeats counted); columns of those names are replaced, all others stay.

    NULL sources form a source of their own. Rows with equal keys (repeated rows, NULL ids) are
    ordered by id and size; equal ones are interchangeable. Empty texts have size and taken 0.
    Two passes over ``docs``; nothing but rows of the border slices is sorted.
    """
    names = ("size", "source_size", "target", "taken")
    mixed = _mixed(docs, size, weight, doc_id, source, repeat, seed)
    return mixed.select(*[c for c in docs.columns if c not in names], *[F.col(f"__{n}").alias(n) for n in names])


def mixed_documents(docs: DataFrame, repeat: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document as often as it is taken whole, and
    once more where it is taken in part, then with its first words joined by a space (``n_chars``
    follows). Documents that the mix doesn't take, empty ones among them, are absent."""
    size = word_count(F.col("text"))
    weight = usual_word_length(F.coalesce("text", F.lit("")), size)
    mixed = _mixed(docs, size, weight, "doc_id", "source", repeat, seed).where("__taken > 0")
    part = F.col("__taken") % F.col("__size")
    times = F.floor(F.col("__taken") / F.col("__size")) + (part > 0).cast("long")
    copies = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    cut = F.when(
        (part > 0) & (F.col("__copy") == times),
        F.concat_ws(" ", F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), part.cast("int"))))
    out = copies.withColumn("__cut", cut)
    changed = {"text": F.coalesce("__cut", "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__cut").isNotNull(), F.char_length("__cut")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
