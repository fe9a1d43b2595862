"""Streams of reads: headers as they arrive, barcode counts within event time, repeated reads dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.scalars import parse_header


def parse_stream(lines: DataFrame, at: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """at, read_name, barcode_str of header lines (value), a read once within the watermark's delay."""
    rows = lines.select(F.col(at), parse_header("value").alias("h")).select(at, "h.read_name", "h.barcode_str").where("read_name IS NOT NULL")
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["read_name"])


def barcode_counts(reads: DataFrame, at: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """window, barcode_str, n; late reads within the delay count."""
    return reads.withWatermark(at, delay).groupBy(F.window(at, window), "barcode_str").agg(F.count("*").alias("n"))
