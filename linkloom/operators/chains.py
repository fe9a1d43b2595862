"""Operators on chains (chain_id, idx, contig): neighbours, orientation votes, gap model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _chain() -> Window:
    return Window.partitionBy("chain_id").orderBy("idx")



def consecutive(chains: DataFrame) -> DataFrame:
    """chain_id, prev, next for every two contigs in a row."""
    return chains.select("chain_id", F.col("contig").alias("prev"), F.lead("contig").over(_chain()).alias("next")).where("next IS NOT NULL")


def neighbours(chains: DataFrame, rank: int) -> DataFrame:
    """contig, other, step (other's place less contig's) for others at most rank places away."""
    steps = F.explode(F.expr(f"filter(sequence(-{rank}, {rank}), x -> x <> 0)")).alias("step")
    wide = chains.select("chain_id", "contig", "idx", steps).withColumn("at", F.col("idx") + F.col("step"))
    return wide.join(chains.select("chain_id", F.col("idx").alias("at"), F.col("contig").alias("other")), ["chain_id", "at"]).select("chain_id", "contig", "other", "step")


def orientation_votes(chains: DataFrame, sims: DataFrame, rank: int = 3, skip_empty: bool = True) -> DataFrame:
    """contig, side (L: by the neighbours before, R: by those after), ctg (contig, or contig + 1 turned round), quality, both counts.

    sims: c1, b1, c2, b2, sim in both directions, bin 0 the head and 1 the tail. For every bin of every neighbour, the
    bin that faces that side is held against the other one. skip_empty leaves out neighbours' bins that only the far bin knows."""
    slots = neighbours(chains, rank).withColumn("b2", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("side", F.when(F.col("step") < 0, "L").otherwise("R"))
    of = lambda b, name: sims.where(F.col("b1") == b).select(F.col("c1").alias("contig"), F.col("c2").alias("other"), F.col("b2"), F.col("sim").alias(name))
    key = ["contig", "other", "b2"]
    full = slots.join(of(0, "head"), key, "left").join(of(1, "tail"), key, "left").na.fill(0.0, ["head", "tail"])
    left = F.when(F.col("side") == "L", F.col("head")).otherwise(F.col("tail"))
    right = F.when(F.col("side") == "L", F.col("tail")).otherwise(F.col("head"))
    counted = ~((left == 0) & (right != 0)) if skip_empty else F.lit(True)
    votes = full.groupBy("contig", "side").agg(
        F.sum(F.when(counted & (left > right), 1).otherwise(0)).alias("l"), F.sum(F.when(counted & (left < right), 1).otherwise(0)).alias("r"), F.sum(left).alias("lt"), F.sum(right).alias("rt")
    )
    sides = chains.select("contig", F.explode(F.array(F.lit("L"), F.lit("R"))).alias("side"))
    votes = sides.join(votes, ["contig", "side"], "left").na.fill(0, ["l", "r"]).na.fill(0.0, ["lt", "rt"])
    turned = (F.col("l") < F.col("r")) | ((F.col("l") == F.col("r")) & (F.round("lt", 9) < F.round("rt", 9)))
    return votes.select("contig", "side", (F.col("contig") + turned.cast("int")).alias("ctg"), F.abs(F.col("l") - F.col("r")).cast("long").alias("quality"), F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))


def next_similarity(chains: DataFrame, sims: DataFrame) -> DataFrame:
    """contig, other, sim: the greatest similarity of bins of a contig and its successor."""
    pairs = consecutive(chains).select(F.col("prev").alias("c1"), F.col("next").alias("c2"))
    return sims.join(pairs, ["c1", "c2"]).groupBy(F.col("c1").alias("contig"), F.col("c2").alias("other")).agg(F.max("sim").alias("sim"))


def gap_orientations(chains: DataFrame, sims: DataFrame, rank: int = 3) -> DataFrame:
    """prev, next, true_prev, true_next, q_prev, q_next, sim_ppm for every gap."""
    votes = orientation_votes(chains, sims, rank)
    of = lambda side, key, ctg, q: votes.where(F.col("side") == side).select(F.col("contig").alias(key), F.col("ctg").alias(ctg), F.col("quality").alias(q))
    known = next_similarity(chains, sims).select(F.col("contig").alias("prev"), "sim")
    gaps = consecutive(chains).join(of("R", "prev", "true_prev", "q_prev"), "prev").join(of("L", "next", "true_next", "q_next"), "next").join(known, "prev", "left")
    return gaps.select("prev", "next", "true_prev", "true_next", "q_prev", "q_next", F.floor(F.coalesce("sim", F.lit(0.0)) * 1_000_000).cast("long").alias("sim_ppm"))


def total_least_squares(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """n, slope, intercept of the orthogonal regression line, in one pass; null under two points."""
    sums = points.agg(F.count("*").alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    least = (F.col("sxx") + F.col("syy") - F.sqrt(F.pow(F.col("sxx") - F.col("syy"), F.lit(2)) + 4 * F.pow("sxy", F.lit(2)))) / 2
    slope = F.when(F.col("n") >= 2, F.try_divide("sxy", F.col("sxx") - least))
    return sums.select("n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def same_contig_points(sims: DataFrame, bins: DataFrame) -> DataFrame:
    """x (distance from one bin's end to the next one's start) and y (similarity) of pairs of bins on one contig."""
    of = lambda i: bins.select(F.col("contig"), F.col("bin").alias(f"b{i}"), F.col("start").alias(f"s{i}"), F.col("end").alias(f"e{i}"))
    pairs = sims.where((F.col("c1") == F.col("c2")) & (F.col("b1") < F.col("b2"))).withColumnRenamed("c1", "contig")
    placed = pairs.join(of(1), ["contig", "b1"]).join(of(2), ["contig", "b2"])
    return placed.select((F.col("s2") - F.col("e1")).cast("double").alias("x"), F.col("sim").alias("y"))


def gap_table(line: DataFrame, max_gap: int) -> DataFrame:
    """gap (1 to max_gap - 1), predicted similarity."""
    return line.select(F.explode(F.sequence(F.lit(1), F.lit(max_gap - 1))).alias("gap"), "slope", "intercept").select("gap", (F.col("slope") * F.col("gap") + F.col("intercept")).alias("sim"))


def gap_of(sim: Column, slope: Column, intercept: Column, max_gap: int, default: int) -> Column:
    """The least gap from 1 on whose predicted similarity is under sim, at most max_gap - 1; the default for a line that doesn't fall."""
    g = F.floor((sim - intercept) / slope) + 1
    return F.when(slope.isNull() | (slope >= 0), F.lit(default)).otherwise(F.least(F.greatest(g, F.lit(1)), F.lit(max_gap - 1))).cast("int")


def resolve(base: Column, pe_prev: Column, pe_next: Column, sim_prev: Column, sim_next: Column, w_prev: Column, w_next: Column) -> Column:
    """A contig's orientation from up to four asks, 0 for none: no ask, base; one value, it; both of a pair agreeing, it;
    a majority; paired ends that don't conflict; the similarity with the greater weight, the next one's in a tie; base."""
    asks = F.filter(F.array(pe_prev, pe_next, sim_prev, sim_next), lambda x: x != 0)
    values = F.array_distinct(asks)
    count = lambda v: F.size(F.filter(asks, lambda x: x == v))
    ups, downs = count(base), count(base + 1)
    both = lambda a, b: (a != 0) & (a == b)
    pe = F.when(pe_prev == 0, pe_next).when(pe_next == 0, pe_prev)
    sim = F.when(w_prev > w_next, sim_prev).otherwise(sim_next)
    return (
        F.when(F.size(values) == 0, base).when(F.size(values) == 1, F.get(values, F.lit(0))).when(both(pe_prev, pe_next), pe_prev).when(both(sim_prev, sim_next), sim_prev)
        .when(ups > downs, base).when(downs > ups, base + 1).when(pe.isNotNull() & (pe != 0), pe).when(sim != 0, sim).otherwise(base)
    )
