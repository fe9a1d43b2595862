"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Sources, by code point with null last, weigh 5, 2, 1, repeating. They share all words by weight; a target stops at
max_epochs times its source's words, and the excess is reshared by weight until none is above. Sources are ordered by
cap over weight: those below the water level are exactly a prefix of that order, so the fixed point is found in one
pass over running sums. A document is taken target // source times whole; the fraction that is left goes to documents
in the order of a seeded hash of doc_id until the nearest whole document.

Defined results: null text has size 0; a null doc_id is ordered by its text's checksum; rows that share a doc_id are
taken alike; sources without words have target 0; an empty table gives no rows; other columns are kept by repeat().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import fresh, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Bits of the order key that choose a bucket; cumulative sizes are first summed over buckets.
BUCKET_BITS = 12
KEY_BITS = 60


def order_key(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits of a seeded md5 of doc_id."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("string")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named).cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> and weight, target: min(max_epochs * source_size, level * weight), the targets sharing all words."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    level = weighed.withColumn("level", left / open_weight)
    clamped = F.col("cap") <= F.col("level") * F.col("weight")
    final = level.withColumn("clamped", clamped).withColumn("water", F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight"))
    return final.select("source", "source_size", "weight", target.alias("target"))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), order_key(F.col("doc_id"), text, seed).alias("order_key"))


def shares(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, target, whole (times every document is taken) and last_key (documents up to it are taken once more).

    The fraction's cut is found over buckets of the order key, then within the one bucket that holds it."""
    shift = KEY_BITS - BUCKET_BITS
    bucket = F.shiftright("order_key", shift).alias("bucket")
    by_bucket = rows.groupBy("source", bucket).agg(F.sum("size").alias("bucket_size"))
    by_bucket = written(by_bucket, "mix-buckets")
    filled = water_fill(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    whole = F.coalesce(F.floor(F.try_divide("target", F.col("source_size"))), F.lit(0)).cast("long")
    filled = written(filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = by_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    same = running.join(filled, running["source"].eqNullSafe(filled["source"])).select(filled["source"], "bucket", "before", "rest")
    cut = same.where(F.col("before") < F.col("rest")).groupBy("source").agg(F.max(F.struct("bucket", "before", "rest")).alias("cut"))
    cut = written(cut.select("source", "cut.*"), "mix-cuts")
    inside = rows.join(cut.withColumnRenamed("source", "cut_source"), rows["source"].eqNullSafe(F.col("cut_source")) & (F.shiftright("order_key", shift) == F.col("bucket")))
    ties = inside.groupBy("source", "order_key", "bucket", "before", "rest").agg(F.sum("size").alias("tie_size"))
    upto = Window.partitionBy("source").orderBy("order_key").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("start", F.col("before") + F.coalesce(F.sum("tie_size").over(upto), F.lit(0)))
    last = ties.groupBy("source").agg(F.max(F.when(2 * F.col("start") + F.col("tie_size") < 2 * F.col("rest"), F.col("order_key"))).alias("inner_key"), (F.shiftleft(F.max("bucket"), shift) - 1).alias("bucket_key"))
    last = last.select(F.col("source").alias("last_source"), F.coalesce("inner_key", "bucket_key").alias("last_key"))
    return written(filled.join(last, filled["source"].eqNullSafe(F.col("last_source")), "left").select("source", "source_size", "target", "whole", F.coalesce("last_key", F.lit(-1)).alias("last_key")), "mix-shares")


def times(whole: Column, key: Column, last_key: Column) -> Column:
    return whole + (key <= last_key).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for every document."""
    rows = written(sized(docs, seed), "mix-sizes")
    share = shares(rows, weights, max_epochs).withColumnRenamed("source", "share_source")
    joined = rows.join(share, rows["source"].eqNullSafe(F.col("share_source")))
    n = times(F.col("whole"), F.col("order_key"), F.col("last_key"))
    return joined.select("doc_id", "source", "size", "source_size", "target", n.alias("times"), (n * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with its own columns, each row as often as the mix takes it. Texts are scanned, never shuffled."""
    rows = written(sized(docs, seed), "mix-sizes")
    source, whole, last, copy = (fresh(docs, f"mix_{c}") for c in ("source", "whole", "last", "copy"))
    share = shares(rows, weights, max_epochs).select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("last_key").alias(last))
    joined = docs.join(share, docs["source"].cast("string").eqNullSafe(F.col(source)))
    n = times(F.col(whole), order_key(docs["doc_id"], docs["text"].cast("string"), seed), F.col(last))
    return joined.withColumn(copy, F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")))).select(*docs.columns)


def op4_water_filled_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 15))::BIGINT AS k
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS s FROM rows GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
leveled AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(3 * s) OVER below, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER below, 0))::DOUBLE AS level
  FROM weighed WINDOW below AS (ORDER BY (3 * s)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, (3 * s)::DOUBLE / w) AS level FROM leveled WHERE NOT (3 * s <= level * w)),
targets AS (
  SELECT source, s, CASE WHEN 3 * s <= l.level * w THEN (3 * s)::DOUBLE ELSE (SELECT level FROM water) * w END AS target FROM leveled l),
shares AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE floor(target / s)::BIGINT END AS whole FROM targets),
ties AS (SELECT source, k, sum(size) AS g FROM rows GROUP BY source, k),
ran AS (SELECT *, sum(g) OVER (PARTITION BY source ORDER BY k) - g AS start FROM ties)
SELECT r.doc_id, r.size, h.s AS source_size, h.target,
       (r.size * (h.whole + CASE WHEN 2 * n.start + n.g < 2 * (h.target - h.whole * h.s) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows r JOIN shares h ON r.source IS NOT DISTINCT FROM h.source
JOIN ran n ON r.source IS NOT DISTINCT FROM n.source AND r.k = n.k
"""
