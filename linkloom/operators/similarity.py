"""Bins, weights of barcodes in bins, and similarity over the inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.multisets import jaccard

#: Barcodes of more bins than this generate no candidates (they still count towards similarity).
HOT_BARCODE = 10_000
#: Hot barcodes' pairs are all made while there are at most this many for each row and pair of the others.
HOT_PAIRS = 8


def chop_bins(contigs: DataFrame, bins: Column) -> DataFrame:
    """contig, bin, start, end from contig, length and an array of bins."""
    return contigs.select("contig", F.inline(bins))


def sample_barcodes(rows: DataFrame, ratio: float, barcode: str = "barcode") -> DataFrame:
    """Rows of a share of the barcodes, chosen by arithmetic on ids: the same in every run. The ratio is held to 0.1 to 1."""
    ratio = min(1.0, max(0.1, ratio))
    return rows.where(F.pmod(F.col(barcode) * 2654435761, F.lit(1_000_000)) < int(ratio * 1_000_000))


def barcodes_in_bins(positions: DataFrame, bins: DataFrame) -> DataFrame:
    """contig, bin, barcode, w: distinct positions of a barcode within a bin. Bins may overlap. positions: contig, pos, barcode."""
    distinct = positions.select("contig", "pos", "barcode").distinct()
    inside = distinct.join(bins, "contig").where(F.col("pos").between(F.col("start"), F.col("end")))
    return inside.groupBy("contig", "bin", "barcode").agg(F.count("*").alias("w"))


def pair_overlaps(weights: DataFrame, node: list[str], cap: int | None = None, same: str | None = None, apart: str | None = None) -> DataFrame:
    """Pairs of nodes with `shared`, the summed least weights of the barcodes that both have.

    node: the columns that name a node; a pair is kept once, lower node first. same: a column that both must agree on;
    apart: one in which they must differ. With a cap (HOT_BARCODE is the usual one), barcodes in more than cap nodes make no
    candidates, but count: where they hold few pairs they are joined like all others and mark no pair, else they are looked up
    for the candidates of the others."""
    keys = ["barcode"] + ([same] if same else [])
    rest = [c for c in node if c != same]
    pair = ([same] if same else []) + [f"{c}_{i}" for c in rest for i in (1, 2)]
    lower = F.struct(*[f"{c}_1" for c in rest]) < F.struct(*[f"{c}_2" for c in rest])
    if apart:
        lower = lower & (F.col(f"{apart}_1") != F.col(f"{apart}_2"))
    side = lambda df, i, *more: df.select(*keys, *[F.col(c).alias(f"{c}_{i}") for c in rest], F.col("w").alias(f"w_{i}"), *more)
    least = F.least("w_1", "w_2")
    if cap is None or same:
        return side(weights, 1).join(side(weights, 2), keys).where(lower).groupBy(*pair).agg(F.sum(least).alias("shared"))
    n = F.col("n").cast("double")
    held = weights.groupBy("barcode").agg(F.count("*").alias("n")).agg(F.sum(F.when(n > cap, n * (n - 1) / 2)).alias("hot"), F.sum(n + F.when(n > cap, 0).otherwise(n * (n - 1) / 2)).alias("cool")).first()
    if held["hot"] is None:
        return pair_overlaps(weights, node, apart=apart)
    counted = weights.withColumn("cool", F.count("*").over(Window.partitionBy("barcode")) <= cap)
    if held["hot"] <= HOT_PAIRS * held["cool"]:
        both = side(counted, 1, "cool").join(side(counted, 2), keys).where(lower)
        return both.groupBy(*pair).agg(F.sum(least).alias("shared"), F.max("cool").alias("cool")).where("cool").drop("cool")
    cool, hot = counted.where("cool"), counted.where("NOT cool")
    found = side(cool, 1).join(side(cool, 2), keys).where(lower).groupBy(*pair).agg(F.sum(least).alias("shared"))
    more = found.select(*pair).join(side(hot, 1), [f"{c}_1" for c in rest]).join(side(hot, 2), ["barcode", *[f"{c}_2" for c in rest]])
    return found.unionByName(more.select(*pair, least.alias("shared"))).groupBy(*pair).agg(F.sum("shared").alias("shared"))


def with_similarity(pairs: DataFrame, weights: DataFrame, node: list[str], same: str | None = None) -> DataFrame:
    """Adds sim, the weighted Jaccard similarity, to pairs with shared weights."""
    totals = weights.groupBy(*node).agg(F.sum("w").alias("t"))
    rest = [c for c in node if c != same]
    for i in (1, 2):
        named = totals.select(*([same] if same else []), *[F.col(c).alias(f"{c}_{i}") for c in rest], F.col("t").alias(f"t_{i}"))
        pairs = pairs.join(named, ([same] if same else []) + [f"{c}_{i}" for c in rest])
    return pairs.withColumn("sim", jaccard(F.col("shared"), F.col("t_1"), F.col("t_2")))


def symmetrise(pairs: DataFrame, columns: list[str], value: str) -> DataFrame:
    """Pairs in both directions. columns: names without their _1 and _2."""
    turned = pairs.select(*[F.col(f"{c}_{3 - i}").alias(f"{c}_{i}") for c in columns for i in (1, 2)], value)
    return pairs.select(*[f"{c}_{i}" for c in columns for i in (1, 2)], value).unionByName(turned)


def roll_up(pairs: DataFrame, group: str = "contig", value: str = "sim") -> DataFrame:
    """The greatest value between two groups, of pairs of their parts; none within a group."""
    return pairs.where(F.col(f"{group}_1") != F.col(f"{group}_2")).groupBy(f"{group}_1", f"{group}_2").agg(F.max(value).alias(value))


def neighbours_only(pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """Pairs of contigs that are the same or next to each other in a chain. chains: chain_id, idx, contig."""
    of = lambda i: chains.select(F.col("contig").alias(f"contig_{i}"), F.col("chain_id").alias(f"chain_{i}"), F.col("idx").alias(f"idx_{i}"))
    placed = pairs.join(of(1), "contig_1").join(of(2), "contig_2")
    return placed.where((F.col("chain_1") == F.col("chain_2")) & (F.abs(F.col("idx_1") - F.col("idx_2")) <= 1)).drop("chain_1", "chain_2", "idx_1", "idx_2")
