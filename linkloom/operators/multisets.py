"""Weighted multisets in long form: rows (set, element, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collect_weights(rows: DataFrame, key: str, element: str) -> DataFrame:
    """key, element, w: how often a set holds an element."""
    return rows.groupBy(key, element).agg(F.count("*").alias("w"))


def sizes(sets: DataFrame, key: str) -> DataFrame:
    """Total weight and number of distinct elements of each set."""
    return sets.groupBy(key).agg(F.sum("w").alias("size"), F.count("*").alias("keysize"))


def intersection(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The least weight of what both have."""
    return a.join(b.withColumnRenamed("w", "w2"), on).select(*on, F.least("w", "w2").alias("w"))


def union(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The greatest weight of what either has."""
    return a.unionByName(b).groupBy(*on).agg(F.max("w").alias("w"))


def add(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*on).agg(F.sum("w").alias("w"))


def subtract(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Weights of a less those of b; what reaches zero goes, and so does what would fall below."""
    return add(a, b.withColumn("w", -F.col("w")), on).where("w > 0")


def jaccard(shared: Column, total_a: Column, total_b: Column) -> Column:
    """Weighted Jaccard similarity from the summed least weights and both totals; 0 for empty sets."""
    return F.coalesce(F.try_divide(shared, total_a + total_b - shared), F.lit(0.0))
