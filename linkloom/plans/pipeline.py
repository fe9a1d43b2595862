"""The whole run as one DataFrame program: from reads and contigs to scaffolds, each stage a table that a rerun resumes from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.scalars import end_bins, equal_bins, whole_bin
from linkloom.operators import chains as ch
from linkloom.operators import graph, ingest, pairs, scaffolds, similarity
from linkloom.plans.config import Config


class Stages:
    """Tables of a run under a folder. A stage whose table is complete is read, not computed."""

    def __init__(self, spark: SparkSession, folder: str, resume: bool = True):
        self.spark, self.folder, self.resume = spark, folder.rstrip("/"), resume

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        there = done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
        if not (self.resume and there):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def _similar(stage: Stages, name: str, positions: DataFrame, contigs: DataFrame, bins: DataFrame, threshold: float, config: Config, same: bool = False, chains: DataFrame | None = None) -> DataFrame:
    """Bin pairs in both directions: c1, b1, c2, b2, sim; between contigs, or within them."""
    weights = stage(f"{name}_weights", lambda: similarity.barcodes_in_bins(similarity.sample_barcodes(positions, config.sampling_ratio), bins))
    node = ["contig", "bin"]

    def between() -> DataFrame:
        found = similarity.with_similarity(similarity.pair_overlaps(weights, node, similarity.HOT_BARCODE, apart="contig"), weights, node).where(F.col("sim") >= threshold)
        found = similarity.neighbours_only(found, chains) if chains is not None else found
        both = similarity.symmetrise(found, node, "sim")
        return both.select(F.col("contig_1").alias("c1"), F.col("bin_1").alias("b1"), F.col("contig_2").alias("c2"), F.col("bin_2").alias("b2"), "sim")

    def within() -> DataFrame:
        found = similarity.with_similarity(similarity.pair_overlaps(weights, node, same="contig"), weights, node, same="contig").where(F.col("sim") >= threshold)
        return found.select(F.col("contig").alias("c1"), F.col("bin_1").alias("b1"), F.col("contig").alias("c2"), F.col("bin_2").alias("b2"), "sim")

    return stage(f"{name}_{'within' if same else 'sims'}", within if same else between)


def run(spark: SparkSession, sam: DataFrame, names: DataFrame, reads: DataFrame, contigs: DataFrame, folder: str, config: Config | None = None, resume: bool = True) -> dict[str, DataFrame]:
    """scaffolds, agp, sequences and what they were made from.

    sam: alignment rows; reads: read_no, read_name, barcode_str; names: read_name, read_no; contigs: contig, length, cov, seq."""
    c, stage = config or Config(), Stages(spark, folder, resume)
    dictionary = stage("barcodes", lambda: ingest.masked(ingest.barcode_frequencies(reads), ingest.barcode_dictionary(reads), c.min_pair_of_barcode, c.max_pair_of_barcode))
    on_contig = stage("read_on_contig", lambda: ingest.alignments(sam, names, dictionary))
    positions = stage("positions", lambda: ingest.barcode_positions(on_contig))
    lengths = contigs.select("contig", "length")
    seeds = stage("seeds", lambda: ingest.seeds(contigs, c.k, c.order_bin))
    bins = lambda of, b: similarity.chop_bins(of, b)

    order_bins = bins(seeds, equal_bins("length", c.order_bin, c.order_reach, c.bin_factor))
    order_sims = _similar(stage, "order", positions, seeds, order_bins, c.order_threshold, c)
    rolled = order_sims.groupBy(F.col("c1").alias("u"), F.col("c2").alias("v")).agg(F.max("sim").alias("sim")).where("u < v")
    edges = stage("order_edges", lambda: graph.similarity_graph(rolled, c.order_threshold))
    trunk = stage("chains", lambda: graph.order_contigs(edges, c.order_delete_share, c.order_rounds)[0])

    head_tail = bins(seeds, end_bins("length", c.end_bin, c.end_reach))
    end_sims = _similar(stage, "ends", positions, seeds, head_tail, c.end_threshold, c)
    gap_oo = stage("gap_orientations", lambda: ch.gap_orientations(trunk, end_sims, c.end_rank))

    paired, _ = ingest.mates(on_contig)
    insert = ingest.mean_insert(paired, c.read_len).first()["avg_insert"] or 0
    of = lambda i: lengths.select(F.col("contig").alias(f"contig{i}"), F.col("length").alias(f"len{i}"))
    pe_seeds = stage("pe_seeds", lambda: ingest.seeds(contigs, c.k, c.pe_min_contig))
    nodes = pe_seeds.select(F.explode(F.array(F.col("contig"), F.col("contig") + 1)).alias("node"))
    links = stage("links", lambda: graph.induced(pairs.link_graph(pairs.pair_links(paired.where("contig1 <> contig2").join(of(1), "contig1").join(of(2), "contig2"), insert, c.pe_max_insert)), nodes, "src", "dst"))
    strong = pairs.strong_links(links, c.pe_max_link, c.pe_min_count)
    one = bins(pe_seeds, whole_bin("length", c.pe_margin))
    whole = stage("whole_weights", lambda: similarity.barcodes_in_bins(positions, one).select("contig", "barcode", "w"))
    shared = similarity.symmetrise(similarity.pair_overlaps(whole, ["contig"], similarity.HOT_BARCODE).where(F.col("shared") >= c.pe_shared), ["contig"], "shared")
    relations = stage("relations", lambda: shared.select(F.col("contig_1").alias("node"), F.col("contig_2").alias("other")))
    candidates = pairs.gap_candidates(ch.consecutive(trunk), relations)
    sub = pairs.subgraphs(pairs.closure(candidates), strong)
    node_lengths = lengths.select(F.explode(F.array(F.col("contig"), F.col("contig") + 1)).alias("node"), "length")
    fills = stage("fills", lambda: pairs.fill_gaps(sub, node_lengths, trunk.select("contig"), c.pe_search))

    gap_bins = stage("gap_bins", lambda: bins(seeds, equal_bins("length", c.gap_bin, c.gap_reach, c.bin_factor)))
    within = _similar(stage, "gap", positions, seeds, gap_bins, c.gap_threshold, c, same=True)
    across = _similar(stage, "gap", positions, seeds, gap_bins, c.gap_threshold, c, chains=trunk)
    line = stage("gap_line", lambda: ch.total_least_squares(ch.same_contig_points(within, gap_bins)))

    turned = stage("orientations", lambda: scaffolds.contig_orientations(trunk, gap_oo, fills))
    sizes = stage("gap_sizes", lambda: scaffolds.gap_sizes(trunk, gap_oo, ch.next_similarity(trunk, across), fills, line, c.max_gap, c.gap_trunk, c.gap_petrunk, c.gap_pe, c.min_gap))
    built = stage("scaffolds", lambda: scaffolds.build_scaffolds(trunk, turned, sizes, lengths, c.gap_pe))
    agp = stage("agp", lambda: scaffolds.agp_rows(built, min_n=c.min_n))
    sequences = stage("sequences", lambda: scaffolds.scaffold_sequences(built, contigs.select("contig", "seq"), c.min_n, c.min_c))
    return {"scaffolds": built, "agp": agp, "sequences": sequences, "unused": scaffolds.unused_contigs(contigs, built), "chains": trunk, "gaps": gap_oo, "fills": fills, "line": line}
