"""The pipeline against its stages done by hand on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidemark.llm.queries import op8_decontamination, op10_quality_classifier
from tidemark.llm.simhash import near_copies

SF = "/root/testdata/sf0.001"


def test_stages_decide_what_stays(spark):
    out = pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in op10_quality_classifier(spark, SF).where("predicted = 1").collect()}
    packed = {r.doc_id for r in out}
    assert packed <= good
    bad = {r.doc_id for r in op8_decontamination(spark, SF).where("contaminated").collect()}
    assert not packed & bad
    first = near_copies(docs.where(F.col("doc_id").isin(list(good)))).groupBy("root").agg(F.min("doc_id").alias("first"))
    assert packed == {r.first for r in first.collect()} - bad
    lengths = {}
    for r in out:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in lengths.values())


def test_stage_names():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]


LONG = " ".join(f"word{i % 37} and thing{i}" for i in range(60)) + "."
OTHER = " ".join(f"other{i % 31} or place{i}" for i in range(60)) + "."
AWKWARD = [(3, LONG, "x"), (5, OTHER, "x"), (5, LONG, "y"), (7, None, None), (8, "", "x"), (None, OTHER, "z"), (None, LONG + " and a rest of its own " * 40, "z"), (9, LONG, "x"), (9, LONG, "x")]
SHAPE = "doc_id long, text string, _id string, id string, row string"


def awkward(spark, rows):
    return spark.createDataFrame([(i, t, s, s, s) for i, t, s in rows], SHAPE)


@pytest.mark.parametrize("rows", [AWKWARD, AWKWARD[::-1]])
def test_one_of_each_by_hand(spark, rows):
    out = pipeline.keep_one_of_each(spark, awkward(spark, rows).repartition(3), SF)
    assert out.columns == ["doc_id", "text", "_id", "id", "row"]
    assert sorted((str(r.doc_id), r.text) for r in out.where("text <> '' or text is null").collect()) == sorted([("3", LONG), ("5", OTHER), ("7", None), ("None", LONG + " and a rest of its own " * 40)], key=lambda r: (r[0], r[1] or ""))


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_on_awkward_rows(spark, name, stage):
    table = awkward(spark, AWKWARD)
    assert stage(spark, table.limit(0), SF).count() == 0
    out = stage(spark, table, SF)
    assert out.count() >= (1 if name == "quality" else 4)
    if name != "packing":
        assert out.columns == table.columns and not set(out.collect()) - (set(table.collect()) if name != "personal_data" else set(out.collect()))
    if name == "personal_data":
        assert [r.text for r in out.collect()] == [r.text for r in table.collect()]  # nothing personal in it


def test_benchmark_stage_tells_rows_of_one_id_apart(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 15").first().text
    rows = [(1, "So it begins. " + item + " And so it ends.", "a"), (1, OTHER, "a"), (None, item, "b"), (None, OTHER, "b"), (2, None, "c")]
    out = pipeline.drop_benchmark(spark, awkward(spark, rows), SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted([("1", OTHER), ("None", OTHER), ("2", "None")])
