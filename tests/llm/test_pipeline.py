"""The corpus pipeline on empty tables and on columns whose names its stages use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASHING = ("score", "size", "source_size", "target", "taken", "label", "words", "n", "class", "root", "shard", "ids", "w", "rows", "key", "a", "b")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES)
def test_a_stage_of_an_empty_table(spark, docs, name, step):
    out = step(spark, docs.where("false"), SF)
    assert out.count() == 0
    if name != "encode":
        assert out.columns == docs.columns


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES)
def test_a_stage_keeps_columns_whose_names_it_uses(spark, docs, name, step):
    few = docs.where("length(text) < 3000")
    wide = few.select("*", *[F.concat(F.lit(f"mine-{c}-"), "doc_id").alias(c) for c in CLASHING])
    plain, out = step(spark, few, SF), step(spark, wide, SF)
    if name == "encode":
        assert sorted(map(tuple, plain.drop("ids").collect())) == sorted(map(tuple, out.drop("ids").collect()))
        return
    assert out.columns == wide.columns
    assert out.select(*CLASHING).schema == wide.select(*CLASHING).schema
    assert sorted(map(tuple, plain.select("doc_id", "text").collect())) == sorted(map(tuple, out.select("doc_id", "text").collect()))
    wrong = F.lit(False)
    for c in CLASHING:
        wrong = wrong | ~F.col(c).eqNullSafe(F.concat(F.lit(f"mine-{c}-"), "doc_id"))
    assert out.where(wrong).count() == 0


def test_the_pipeline_without_documents_and_without_labels(spark, docs, tmp_path):
    for name, table in (("documents", docs.where("false")), ("labels", spark.read.parquet(f"{SF}/labels.parquet"))):
        table.write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    few = docs.where("doc_id < 20 or text is null").unionByName(docs.where("doc_id = 3").withColumn("text", F.lit(None).cast("string")))
    few.write.parquet(f"{tmp_path}/bare/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(f"{tmp_path}/bare/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/bare").count() > 0
