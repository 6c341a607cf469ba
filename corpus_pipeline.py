"""Corpus preparation: quality, near copies, mixing, encoding.

Every stage takes what its predecessor kept, as a table in the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.bpe_codec import encode_decode
from tidewake.llm.mixing import mixed_documents
from tidewake.llm.near_text import one_of_each
from tidewake.llm.quality_rules import score_quality
from tidewake.llm.queries import table, tokenizer_file
from tidewake.session import stage

#: Least score of a document that stays.
LEAST_QUALITY = 0.3
#: Least Jaccard similarity, in percent, of five-word shingle sets that counts as a near copy.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones among them.

    NULL and empty texts are scored as empty. Repeated rows and rows of one score share their fate.
    Columns of any name stay as they are. Without labelled rows every score is 0.5 and all stay; with
    labels of one kind only, every score follows from their number. An empty table gives an empty one.
    """
    named = docs.toDF(*[f"__{i}" for i in range(len(docs.columns))])
    place = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    inner = named.select("*", F.col(place["doc_id"]).alias("doc_id"), F.col(place["text"]).alias("text"))
    scored = score_quality(inner, table(spark, sf_dir, "labels"))
    return scored.where(scored["score"] >= LEAST_QUALITY).select(*named.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, once.

    Texts that are NULL or hold no word are nobody's copies and all stay; other columns play no part
    and stay as they are. An empty table gives an empty one.
    """
    return one_of_each(docs, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    NULL is a source of its own. Documents without words are not taken. Where a budget ends within
    a document, its first words are taken; equal keys are ordered by id and size. Columns of any
    name stay as they are, ``n_chars`` apart, which follows the text. An empty table gives an empty one.
    """
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they stand for.

    NULL texts have no ids. One row per row, repeated ones and NULL ids included; only ``doc_id`` of the
    other columns is handed on. An empty table gives an empty one.
    """
    return encode_decode(docs, tokenizer_file(), ids=True)


STAGES = [("quality", quality), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: Learnt scores and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
