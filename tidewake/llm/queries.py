"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import oracles
from tidewake.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.SQL


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
)


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    from tidewake.llm.url_filter import judge_urls

    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    from tidewake.llm.mixing import mix_sources, usual_word_length, word_count

    docs = table(spark, sf_dir, "documents")
    size = word_count(F.col("text"))
    narrow = docs.select("doc_id", "source", size.alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    narrow = stage(narrow.select("doc_id", "source", "n", usual_word_length(F.col("text"), F.col("n")).alias("w")))
    mixed = mix_sources(narrow, F.col("n"), F.col("w"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labels outside the held-out fifth."""
    from tidewake.llm.quality_rules import held_out, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    from tidewake.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to wavelet matrix files and read back."""
    from tidewake.llm.token_files import read_tokens, token_folder, write_tokens

    folder = token_folder(spark)
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(), folder)
    return read_tokens(spark, folder)


@query
def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they stand for, as digests."""
    from tidewake.llm.bpe_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


@query
def op7_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    from tidewake.llm.near_text import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the word baseline and PPM."""
    from tidewake.llm.ppm import score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tidewake.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components and link counts of all embeddings."""
    from tidewake.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    from tidewake.llm.bag_ranking import rank_documents

    return rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query
def op12_rank_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document and the bytes they stand for, as digests."""
    import public_tokenizers

    from tidewake.llm.rank_codec import encode_decode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over every document."""
    import public_tokenizers

    from tidewake.llm.token_alignment import align_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
