"""Quality classifier: a sparse ensemble of rules over text statistics.

A small random forest is fitted to a bounded sample of labelled documents, every path from a
root to a node becomes a rule (a conjunction of comparisons of statistics), lasso logistic
regression keeps few of the rules, and these are compiled into one Spark column expression.
Scoring is a projection over whole texts: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.session import stage

#: Labelled rows to learn from at most, chosen by a hash of their id.
SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all finite; an empty text has words 0 and shares 0."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    lines = F.split(text, "\n")
    sentences = F.split(text, r"[.!?\n]+\s*")
    share = lambda n: n / F.greatest(words, F.lit(1))
    return {
        "words": F.log1p(words),
        "word_length": share(F.char_length(text)),
        "capitals": share(F.regexp_count(text, F.lit(r"\p{Lu}{2,}"))),
        "symbols": share(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()-]+"))),
        "doubled": share(F.regexp_count(text, F.lit(r"([!?.*#$%&=_-])\1"))),
        "digits": share(F.regexp_count(text, F.lit(r"\p{N}+"))),
        "stops": share(F.regexp_count(text, F.lit(r"[.!?](?=\s|$)"))),
        "distinct_words": share(F.size(F.array_distinct(F.split(text, " ")))),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "distinct_sentences": F.size(F.array_distinct(sentences)) / F.size(sentences),
    }


@dataclass(frozen=True)
class RuleModel:
    """Intercept, weighted rules; a rule is a tuple of (statistic, is_greater, threshold)."""

    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            holds = F.lit(True)
            for name, greater, threshold in rule:
                holds = holds & (stats[name] > threshold if greater else stats[name] <= threshold)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (1.0 + F.exp(-total))


def _paths(node, names: list[str], path=()):
    """Conjunctions on the way from a tree's root to each of its nodes."""
    if path:
        yield path
    if node.subtreeDepth() > 0:
        split = node.split()
        name, threshold = names[split.featureIndex()], float(split.threshold())
        yield from _paths(node.leftChild(), names, (*path, (name, False, threshold)))
        yield from _paths(node.rightChild(), names, (*path, (name, True, threshold)))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient; the intercept is free."""
    rows, columns = x.shape
    rate = 4.0 * rows / (np.linalg.norm(x, 2) ** 2 + rows)
    w, b = np.zeros(columns), float(np.log((y.sum() + 1) / (rows - y.sum() + 1)))
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        error = 1.0 / (1.0 + np.exp(-(x @ vw + vb))) - y
        nw = vw - rate * (x.T @ error) / rows
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0.0)
        nb = vb - rate * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit_rules(sample: DataFrame, names: list[str], trees: int = 16, depth: int = 3, penalty: float = 0.0005, seed: int = 7) -> RuleModel:
    """Fit to a bounded table with ``label`` (0 or 1) and the statistics ``names``.

    Without rows, or with labels of one kind only, the model is its intercept.
    """
    table = sample.select("label", *names).toPandas()
    y = table["label"].to_numpy(float)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(np.unique(y)) < 2:
        return RuleModel(prior, ())
    packed = VectorAssembler(inputCols=names, outputCol="features").transform(sample)
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt"
    ).fit(packed)
    rules = list(dict.fromkeys(p for tree in forest.trees for p in _paths(tree._call_java("rootNode"), names)))
    if not rules:
        return RuleModel(prior, ())
    x = np.ones((len(y), len(rules)))
    for j, rule in enumerate(rules):
        for name, greater, threshold in rule:
            values = table[name].to_numpy()
            x[:, j] *= values > threshold if greater else values <= threshold
    intercept, weights = _lasso(x, y, penalty)
    return RuleModel(float(intercept), tuple((float(w), r) for w, r in zip(weights, rules) if w != 0.0))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``label`` and statistics of at most ``rows`` labelled documents outside the held-out fifth.

    ``labels`` has ``doc_id`` and ``quality``; several labels of one id count as their majority
    (a tie as 1). Labels with a NULL are ignored.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    text = F.coalesce("text", F.lit(""))
    # at most `rows` narrow rows: small enough for every task
    joined = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    stats = joined.select("doc_id", "label", *[c.alias(n) for n, c in statistics(text).items()])
    return stage(stats.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id", "words"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` with ``score`` from 0 to 1 (NULL text: as the empty text); a column of that
    name is replaced, all others stay. Repeated rows get equal scores."""
    names = list(statistics(F.col("text")))
    model = fit_rules(labelled_sample(docs, labels, rows), names)
    kept = [c for c in docs.columns if c != "score"]
    stats = docs.select(*kept, *[c.alias(f"__{n}") for n, c in statistics(F.coalesce("text", F.lit(""))).items()])
    # one row each: a filter on the score stops here instead of repeating every statistic for every rule
    stats = stats.select(*kept, F.inline(F.array(F.struct(*[F.col(f"__{n}") for n in names]))))
    return stats.select(*kept, model.score({n: F.col(f"__{n}") for n in names}).alias("score"))
