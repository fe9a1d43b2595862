"""From oriented chains to scaffolds, sequences and AGP rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.scalars import reverse_complement
from linkloom.operators.chains import consecutive, gap_of, resolve


def contig_orientations(chains: DataFrame, gaps: DataFrame, fills: DataFrame) -> DataFrame:
    """contig, ctg: every contig's orientation by the asks of the gaps before and after it. gaps: prev, next, true_prev, true_next, q_prev, q_next; fills: prev, next, s, e."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    asks = chains.select("contig")
    asks = asks.join(gaps.select(F.col("prev").alias("contig"), F.col("true_prev").alias("sim_next"), F.col("q_prev").alias("w_next")), "contig", "left")
    asks = asks.join(gaps.select(F.col("next").alias("contig"), F.col("true_next").alias("sim_prev"), F.col("q_next").alias("w_prev")), "contig", "left")
    asks = asks.join(fills.select(F.col("prev").alias("contig"), F.col("s").alias("pe_next")), "contig", "left")
    asks = asks.join(fills.select(F.col("next").alias("contig"), F.col("e").alias("pe_prev")), "contig", "left")
    return asks.select("contig", resolve(F.col("contig").cast("long"), *[zero(c) for c in ("pe_prev", "pe_next", "sim_prev", "sim_next", "w_prev", "w_next")]).alias("ctg"))


def gap_sizes(chains: DataFrame, gaps: DataFrame, gap_sims: DataFrame, fills: DataFrame, line: DataFrame, max_gap: int = 15_000, gap_trunk: int = 5000, gap_petrunk: int = 1, gap_pe: int = 1, min_gap: int = 1) -> DataFrame:
    """prev, next, gap, path (contigs between, null if none): by a filling path, by a direct link, by similarity, or gap_trunk. line has one row: slope, intercept."""
    sims = gap_sims.select(F.col("contig").alias("prev"), F.col("sim").alias("own"))
    all_gaps = consecutive(chains).select("prev", "next").join(gaps.select("prev", (F.col("sim_ppm") / 1_000_000).alias("seen")), "prev", "left").join(sims, "prev", "left")
    placed = all_gaps.join(fills.select("prev", "next", "path"), ["prev", "next"], "left").crossJoin(F.broadcast(line.limit(1)))
    by_sim = gap_of(F.coalesce("own", "seen", F.lit(0.0)), F.col("slope"), F.col("intercept"), max_gap, gap_trunk)
    gap = F.when(F.size("path") > 2, gap_pe).when(F.size("path") == 2, gap_petrunk).otherwise(by_sim)
    between = F.when(F.size("path") > 2, F.slice("path", F.lit(2), F.size("path") - 2))
    return placed.select("prev", "next", F.greatest(gap, F.lit(min_gap)).cast("int").alias("gap"), between.alias("path"))


def build_scaffolds(chains: DataFrame, orientations: DataFrame, sizes: DataFrame, lengths: DataFrame, gap_pe: int = 1) -> DataFrame:
    """contig, strand, gap, length, start_pos, idx, scaff: a chain's contigs with filling contigs between, the last gap 0."""
    base = chains.join(orientations, "contig").join(sizes.select(F.col("prev").alias("contig"), "gap", "path"), "contig", "left")
    own = base.select("chain_id", "idx", F.lit(0).alias("sub"), "contig", F.when(F.col("ctg") == F.col("contig"), "+").otherwise("-").alias("strand"), F.coalesce("gap", F.lit(0)).alias("gap"))
    fill = base.where("path IS NOT NULL").select("chain_id", "idx", F.posexplode("path").alias("p", "node"))
    fill = fill.select("chain_id", "idx", (F.col("p") + 1).alias("sub"), (F.col("node") - (F.col("node") + 1) % 2).alias("contig"), F.when(F.col("node") % 2 == 1, "+").otherwise("-").alias("strand"), F.lit(gap_pe).alias("gap"))
    rows = own.unionByName(fill).join(lengths, "contig")
    order = Window.partitionBy("chain_id").orderBy("idx", "sub")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("length") + F.col("gap")).over(before), F.lit(0)) + 1
    return rows.select("contig", "strand", F.col("gap").cast("int").alias("gap"), "length", start.cast("long").alias("start_pos"), F.row_number().over(order).alias("idx"), F.col("chain_id").alias("scaff"))


def piece(seq, gap, min_n: int, min_c: int):  # noqa: ANN001, ANN201
    """A contig's sequence with what stands for its gap: Ns, at least min_n, for a gap; for an overlap it is cut by that much and min_c Ns follow."""
    return F.when(gap > 0, F.concat(seq, F.repeat(F.lit("N"), F.greatest(gap, F.lit(min_n))))).when(gap < 0, F.concat(F.substring(seq, F.lit(1), F.greatest(F.length(seq) + gap, F.lit(0))), F.repeat(F.lit("N"), F.lit(min_c)))).otherwise(seq)


def scaffold_sequences(scaffolds: DataFrame, sequences: DataFrame, min_n: int = 11, min_c: int = 11) -> DataFrame:
    """scaff, seq. sequences: contig, seq. Sequences are joined last; a scaffold is one row."""
    strands = scaffolds.join(sequences, "contig").withColumn("s", F.when(F.col("strand") == "+", F.col("seq")).otherwise(reverse_complement("seq")))
    pieces = strands.select("scaff", F.struct("idx", piece(F.col("s"), F.col("gap"), min_n, min_c).alias("s")).alias("p"))
    return pieces.groupBy("scaff").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("seq"))


def unused_contigs(contigs: DataFrame, scaffolds: DataFrame) -> DataFrame:
    return contigs.join(scaffolds.select("contig"), "contig", "left_anti")


def agp_rows(scaffolds: DataFrame, names: DataFrame | None = None, min_n: int = 11) -> DataFrame:
    """object, object_beg, object_end, part_number, component_type and the five last columns of AGP, as text; a contig's gap follows it as an N row."""
    named = scaffolds.withColumn("name", F.col("contig").cast("string"))
    if names is not None:
        named = scaffolds.join(names.select("contig", F.col("name").alias("n")), "contig", "left").withColumn("name", F.coalesce("n", F.col("contig").cast("string")))
    s = lambda c: c.cast("string")
    contig = F.struct(F.lit(0).alias("k"), F.lit("W").alias("type"), F.col("length").cast("long").alias("n"), F.col("name").alias("c6"), F.lit("1").alias("c7"), s(F.col("length")).alias("c8"), F.col("strand").alias("c9"))
    long = F.greatest(F.col("gap"), F.lit(min_n)).cast("long")
    empty = F.struct(F.lit(1).alias("k"), F.lit("N").alias("type"), long.alias("n"), s(long).alias("c6"), F.lit("scaffold").alias("c7"), F.lit("yes").alias("c8"), F.lit("map").alias("c9"))
    rows = named.select("scaff", "idx", F.explode(F.when(F.col("gap") > 0, F.array(contig, empty)).otherwise(F.array(contig))).alias("r")).select("scaff", "idx", "r.*")
    order = Window.partitionBy("scaff").orderBy("idx", "k")
    end = F.sum("n").over(order)
    return rows.select(F.concat(F.lit("scaffold "), s(F.col("scaff"))).alias("object"), (end - F.col("n") + 1).alias("object_beg"), end.alias("object_end"), F.row_number().over(order).alias("part_number"), F.col("type").alias("component_type"), "c6", "c7", "c8", "c9")
