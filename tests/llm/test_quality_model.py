"""The rule model against a plain evaluation of its rules, the lasso against a slow solver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import quality_rules as qr

SF = "/root/testdata/sf0.001"


def test_scores_are_the_rules_evaluated_plainly(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("text", F.lit("")))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = list(qr.statistics(F.col("text")))
    model = qr.fit_rules(qr.labelled_sample(docs, labels), names)
    assert len(model.rules) > 3
    stats = docs.select("doc_id", *[c.alias(n) for n, c in qr.statistics(F.coalesce("text", F.lit(""))).items()])
    want = []
    for row in stats.collect():
        total = model.intercept
        for weight, rule in model.rules:
            if all(row[name] > threshold if greater else row[name] <= threshold for name, greater, threshold in rule):
                total += weight
        want.append((row["doc_id"], 1 / (1 + math.exp(-total))))
    got = [(r["doc_id"], r["score"]) for r in qr.score_quality(docs, labels).select("doc_id", "score").collect()]
    assert sorted(d for d, _ in got) == sorted(d for d, _ in want)
    assert [s for _, s in sorted(got)] == pytest.approx([s for _, s in sorted(want)], rel=1e-12)


def test_lasso_against_plain_proximal_steps():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 12)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 3] + 0.5)))).astype(float)
    penalty = 0.01

    def loss(b, w):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + penalty * np.abs(w).sum()

    w, b = np.zeros(12), 0.0
    for _ in range(20_000):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w = w - 0.3 * x.T @ error / 300
        w = np.sign(w) * np.maximum(np.abs(w) - 0.3 * penalty, 0)
        b -= 0.3 * error.mean()
    intercept, weights = qr._lasso(x, y, penalty)
    assert loss(intercept, weights) <= loss(b, w) + 1e-7
    assert ((weights != 0) == (np.abs(w) > 1e-9)).all() and weights == pytest.approx(w, abs=1e-3)
