"""A training corpus in five stages: quality, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the
last return the columns of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import checkpoint_folder, durable
from tidemark.llm.decontaminate import find_contamination
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import pseudonymous
from tidemark.llm.quality_classifier import quality_score, train_quality
from tidemark.llm.queries import pii_key, table, tokenizer_path
from tidemark.llm.simhash import near_copies


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, fitted on the whole corpus's labels, rejects.

    Every row is judged by its text alone, so rows with repeated or null ids are too. Null and empty texts get the
    score of an empty text. A score of exactly 0.5 stays. An empty table stays empty; further columns stay.
    """
    model = train_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(quality_score(model)(F.col("text")) >= 0.5)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of SimHash near-duplicates: that with the smallest id, then the smallest text hash.

    Rows without an id count as the largest, so such a row stays only where its group has no other. Null, empty and
    blank texts are one group. Of rows equal in id and text that with the smallest JSON text stays. An empty table
    stays empty; further columns stay, whatever their names.
    """
    marked = near_copies(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.coalesce("text_hash", F.lit(0)).alias("hash"))
    first = marked.groupBy("root").agg(F.min(order).alias("first")).select("first.id", "first.hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("hash"))
    kept = rows.join(first, rows["id"].eqNullSafe(first["id"]) & (rows["hash"] == first["hash"]), "left_semi")
    one = kept.groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return one.select("row.*").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs.

    Rows are told apart by id and text, so of rows with a repeated or null id only those with a hit go. Null and empty
    texts have no word and stay. An empty table stays empty, an empty benchmark drops nothing; further columns stay.
    """
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    # written before the filter, which would else be moved below the word lists
    told = durable(found.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), (F.size("hits") > 0).alias("hit")))
    hit = told.where("hit").select("id", "hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    kept = rows.join(hit, rows["id"].eqNullSafe(hit["id"]) & (rows["hash"] == hit["hash"]), "left_anti")
    return kept.select("row.*").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in the texts, and the new lengths in n_chars where that column exists; no row goes.

    The key is the session's (see pii_key). Null texts stay null, empty ones empty; further columns stay.
    """
    out = docs.withColumn("text", pseudonymous(pii_key(spark))(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row into sequences of 4096 tokens: one row per piece, with the columns of the packing operator.

    Null texts count as empty and take one token; repeated and null ids are packed row by row; an empty table gives
    no piece; further columns are left out.
    """
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows go through Parquet in the shared checkpoint folder."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
