"""Identity tokens, identifier checks and actor vocabulary."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Spellings of actor groups accepted from users.
ACTOR_ALIASES = {
    "plan": "PLAN",
    "pla_navy": "PLAN",
    "ccg": "CCG",
    "coast_guard": "CCG",
    "research": "RESEARCH_SURVEY",
    "survey": "RESEARCH_SURVEY",
    "research_survey": "RESEARCH_SURVEY",
    "fishing": "FISHING",
    "maritime_militia": "MARITIME_MILITIA",
}
# Texts that stand for "no value" in identifier columns.
NULL_WORDS = ("nan", "none", "<na>")


@F.pandas_udf(StringType())
def _unicode_token(values: pd.Series) -> pd.Series:
    given = values.dropna()
    folded = given.map(
        lambda text: "".join(
            ch for ch in unicodedata.normalize("NFKC", text).casefold() if ch.isalnum()
        )
    )
    return folded.reindex(values.index).astype(object).where(lambda s: s.notna(), None)


def mixed_token(value: Column) -> Column:
    """Identity token: compatibility-fold, casefold, keep letters and digits; '' for missing.

    ASCII text never leaves the JVM; the Arrow UDF sees NULL for it.
    """
    text = F.coalesce(value.cast("string"), F.lit(""))
    wide = text.rlike("[^\\x00-\\x7F]")
    return F.when(wide, F.coalesce(_unicode_token(F.when(wide, text)), F.lit(""))).otherwise(
        F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    )


def malformed_identifier(kind: str, value: Column) -> Column:
    """True for a non-blank MMSI/IMO of the wrong shape; blank and null words pass."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    given = (text != "") & ~F.lower(text).isin(*NULL_WORDS)
    shape = {"MMSI": "^[0-9]{9}$", "IMO": "^(?i)(IMO)?[0-9]{7}$"}[kind]
    return given & ~text.rlike(shape)


def strip_float_suffix(value: Column) -> Column:
    """'412000123.0' → '412000123' (identifiers that went through a float column)."""
    return F.regexp_replace(F.trim(value.cast("string")), "\\.0$", "")


def actor_name(value: Column) -> Column:
    """Canonical actor for one user spelling; unknown spellings are upper-cased."""
    text = F.trim(value)
    token = F.translate(F.lower(text), "- ", "__")
    table = F.create_map(*[F.lit(x) for pair in ACTOR_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, token), F.upper(text))


def actor_names(values: Column) -> Column:
    """Canonical actors of an array, first occurrence order, no repeats."""
    return F.array_distinct(F.transform(values, actor_name))


def census_actor(value: Column) -> Column:
    return (
        F.when(value == "MILITIA;FISHING", "MARITIME_MILITIA")
        .when(value == "RESEARCH", "RESEARCH_SURVEY")
        .when(value.isin("PLAN", "CCG", "FISHING", "OTHER"), value)
        .otherwise("OTHER")
    )


def local_entity(value: Column) -> Column:
    """Stable local entity id of a user's identity text; '' when blank."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(text == "", "").otherwise(
        F.concat(F.lit("user-"), F.substring(F.sha2(text, 256), 1, 16))
    )
