"""Text audits: secrets, private paths, forbidden words."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (rule, pattern, severity).
AUDIT_RULES = (
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "BLOCKER"),
    ("bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{20,}={0,2}", "BLOCKER"),
    ("google_oauth_token", r"\bya29\.[A-Za-z0-9_-]{20,}", "BLOCKER"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{8,}\b", "BLOCKER"),
    ("assigned_secret",
     r"(?i)\b(?:api[_-]?key|access[_-]?token|secret|password)\s*[:=]\s*['\"]?[A-Za-z0-9._~+/-]{20,}", "BLOCKER"),
    ("local_absolute_path", r"(?i)\b[A-Z]:\\Users\\[^\\\s]+\\", "REVIEW"),
)
# Every line separator of Unicode text, CR LF counted once.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
# Text of a redaction, folders that must not be published.
REDACTED = "[REDACTED-MATCH]"
FORBIDDEN_PREFIXES = (".local/", ".tmp/", "data/raw/", "data/derived/")


def private_path_rule(*names: str) -> tuple[str, str, str]:
    """A project's own rule: folder or file names that must never be published."""
    return ("private_dataset_path", "(?i)(?:" + "|".join(re.escape(n) for n in names) + ")", "BLOCKER")


def audit_texts(
    texts: DataFrame, id_column: str, text_column: str, rules: Sequence[tuple[str, str, str]] = AUDIT_RULES,
) -> DataFrame:
    """Findings (id, line, check, severity, excerpt) of every rule on every line.

    Every text is tested whole first, whatever its size; only those where some rule fires are
    split into lines and tested line by line. An excerpt is the whole line with its matches
    redacted.
    """
    suspect = F.lit(False)
    for _, pattern, _ in rules:
        # a rule that looks at line borders can only be judged on lines
        bordered = re.search(r"(?<!\[)\^|\$|\\[AZz]|\(\?[=!<]", pattern)
        suspect = suspect | (F.lit(True) if bordered else F.col(text_column).rlike(pattern))
    lines = texts.filter(suspect).select(
        F.col(id_column).alias("id"), F.posexplode(F.split(text_column, LINE_BREAK)).alias("pos", "text_line"))
    line = F.col("text_line")
    found = F.array_compact(F.array(*[
        F.when(line.rlike(pattern), F.struct(
            F.lit(name).alias("check"), F.lit(severity).alias("severity"),
            F.regexp_replace(line, pattern, REDACTED).alias("excerpt")))
        for name, pattern, severity in rules
    ]))
    return lines.select("id", (F.col("pos") + 1).cast("long").alias("line"), F.explode(found).alias("f")).select(
        "id", "line", "f.*")


def forbidden_paths(paths: DataFrame, column: str = "path", prefixes: Sequence[str] = FORBIDDEN_PREFIXES) -> DataFrame:
    p = F.col(column)
    hit = F.greatest(*[F.startswith(p, F.lit(x)) for x in prefixes])
    return paths.filter(hit & ~F.endswith(p, F.lit("/.gitkeep")))


def audit_summary(findings: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """Per scope: findings, blockers, review items; ``passed`` iff nothing blocks."""
    rows = findings.select("scope", "severity")
    if forbidden is not None:
        rows = rows.unionByName(forbidden.select("scope", F.lit("FORBIDDEN").alias("severity")))
    sev = F.col("severity")
    return rows.groupBy("scope").agg(
        F.count_if(sev != "FORBIDDEN").alias("findings"),
        F.count_if(sev.isin("BLOCKER", "FORBIDDEN")).alias("blockers"),
        F.count_if(sev == "REVIEW").alias("review_items"),
    ).withColumn("passed", F.col("blockers") == 0)


def forbidden_words(texts: DataFrame, text_column: str, words: Sequence[str]) -> DataFrame:
    """Number of texts that contain each forbidden word (case-insensitive)."""
    low = F.lower(text_column)
    flags = [F.count_if(F.contains(low, F.lit(w.lower()))).alias(f"w{i}") for i, w in enumerate(words)]
    counts = texts.agg(*flags)
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("texts")) for i, w in enumerate(words)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")
