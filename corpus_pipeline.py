"""A corpus pipeline: documents pass a quality classifier, near-duplicate removal, removal of personal data and mixing
to target weights, and are packed into sequences. Each stage reads what the one before it has written.

Defined results: an empty table passes through all stages; nulls and extra columns are kept by all stages but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import fresh, written
from linkloom.llm.compression import QUALITY_THRESHOLD, quality_model, score
from linkloom.llm.mixing import repeat
from linkloom.llm.near_dedup import near_duplicates, text_hash
from linkloom.llm.packing import best_fit_pack
from linkloom.llm.pii import sanitise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least QUALITY_THRESHOLD."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "score")
    return score(docs, model, docs.columns, name).where(F.col(name) >= QUALITY_THRESHOLD).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; of equal rows and of rows that share doc_id and text, one, the same in every
    run. A text that shares its doc_id with others goes or stays by itself."""
    found = written(near_duplicates(docs).where("doc_id IS NOT NULL").select("doc_id", "text_hash", "kept"), "pipeline-kept")
    own, key = fresh(docs, "text_key"), fresh(docs, "doc_key")
    rows = docs.withColumn(own, text_hash(F.col("text")))
    named = lambda df: df.select(F.col("doc_id").alias(key), F.col("text_hash").alias(f"{own}_of"))
    same = lambda: (F.col("doc_id").cast("long") == F.col(key)) & (F.col(own) == F.col(f"{own}_of"))
    gone = written(named(found.where(~F.col("kept"))).distinct(), "pipeline-gone")
    left = rows.join(gone, same(), "left_anti")
    repeated = written(named(found.where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")), "pipeline-repeated")
    if not repeated.take(1):
        return left.select(*docs.columns)
    place = fresh(docs, "place")
    order = Window.partitionBy("doc_id", own).orderBy(F.to_json(F.struct(*[docs[c] for c in docs.columns if c != "text"])))
    once = left.join(repeated, same(), "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return left.join(repeated, same(), "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return best_fit_pack(docs)


STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_dedup), ("pii", personal_data), ("source_mixing", mix), ("best_fit_packing", pack)]
#: Scores of trained dictionaries and ids of tokenizers are not expressible in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
