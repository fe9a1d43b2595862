"""Read names, barcodes and alignments: dictionaries, masks, joins, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.scalars import cigar_ops, cigar_total, flag_bits, READ_OPS, insert_size, read1_position

#: Barcode texts that stand for no barcode.
NO_BARCODE = ("0", "0_0", "0_0_0", "0_0_0_0")


def barcode_frequencies(reads: DataFrame) -> DataFrame:
    """barcode_str, n of reads with a barcode."""
    return reads.where(~F.col("barcode_str").isin(*NO_BARCODE)).groupBy("barcode_str").agg(F.count("*").alias("n"))


def barcode_dictionary(reads: DataFrame) -> DataFrame:
    """barcode_str, barcode: numbers from 1 by first appearance (read_no), 0 for no barcode."""
    first = reads.where(~F.col("barcode_str").isin(*NO_BARCODE)).groupBy("barcode_str").agg(F.min("read_no").alias("first"))
    return first.select("barcode_str", F.row_number().over(Window.orderBy("first", "barcode_str")).cast("long").alias("barcode"))


def masked(frequencies: DataFrame, dictionary: DataFrame, least: int = 10, most: int = 500) -> DataFrame:
    """barcode_str, barcode, with 0 for barcodes of fewer than least or more than most reads."""
    keep = F.col("n").between(least, most)
    return dictionary.join(frequencies, "barcode_str").select("barcode_str", F.when(keep, F.col("barcode")).otherwise(F.lit(0)).cast("long").alias("barcode"))


def alignments(sam: DataFrame, names: DataFrame, barcodes: DataFrame, position: Column | None = None) -> DataFrame:
    """read_no, read_id, contig, pos_1bp, match_reverse, barcode, is_p, pe_match, insert_size of mapped primary alignments.

    sam: qname, flag, rname, pos, cigar, rnext, tlen, tags; qname is name#barcode. names: read_name, read_no. Names that are not
    known are -1, barcodes that are not known 0. position: where a read begins, if not by its own CIGAR."""
    bits = flag_bits("flag")
    rows = sam.where(~bits["unmapped"] & bits["primary"])
    rows = rows.withColumns({"read_name": F.substring_index("qname", "#", 1), "barcode_str": F.regexp_extract("qname", r"#([^/\s]+)", 1), "ops": cigar_ops("cigar", "pos"), "read_len": cigar_total("cigar", READ_OPS), "match_reverse": bits["reverse"], "is_p": bits["read1"]})
    rows = rows.withColumn("pe_match", (F.col("rnext") != "*") & ~F.exists("tags", lambda t: t.startswith("XA")))
    rows = rows.withColumn("pos_1bp", read1_position("ops", "match_reverse", "read_len") if position is None else position)
    rows = rows.join(names, "read_name", "left").join(barcodes, "barcode_str", "left")
    no = F.coalesce("read_no", F.lit(-1))
    return rows.select(no.alias("read_no"), (no + (~F.col("is_p")).cast("int")).alias("read_id"), F.col("rname").cast("long").alias("contig"), "pos_1bp", "match_reverse", F.coalesce("barcode", F.lit(0)).cast("long").alias("barcode"), "is_p", "pe_match", F.col("tlen").alias("insert_size"))


def barcode_positions(reads: DataFrame) -> DataFrame:
    """contig, pos, barcode: distinct, without masked barcodes."""
    return reads.where("barcode <> 0").select("contig", F.col("pos_1bp").alias("pos"), "barcode").distinct()


def contigs_of_barcodes(reads: DataFrame) -> DataFrame:
    """barcode, contig, n_reads, repeats counted."""
    return reads.where("barcode <> 0").groupBy("barcode", "contig").agg(F.count("*").alias("n_reads"))


def mates(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of first and second reads that match as pairs, by read number, and second reads without such a first one."""
    paired = reads.where("pe_match")
    of = lambda p, i: paired.where(F.col("is_p") == p).select("read_no", F.col("read_id").alias(f"read{i}"), F.col("contig").alias(f"contig{i}"), F.col("pos_1bp").alias(f"pos{i}"), F.col("match_reverse").alias(f"rev{i}"))
    return of(True, 1).join(of(False, 2), "read_no"), of(False, 2).join(of(True, 1).select("read_no"), "read_no", "left_anti")


def mean_insert(pairs: DataFrame, read_len: int = 100) -> DataFrame:
    """avg_insert: whole mean of what pairs on one contig cover; null without any."""
    one = pairs.where("contig1 = contig2").select(insert_size("pos1", "rev1", "pos2", "rev2", read_len).alias("n"))
    return one.agg(F.sum("n").alias("s"), F.count("*").alias("c")).select(F.expr("try_divide(s - s % c, c)").cast("int").alias("avg_insert"))


def mean_coverage(contigs: DataFrame, k: int) -> DataFrame:
    """coverage: mean over bases of contigs longer than 2k + 1 with more than 10."""
    base = contigs.where((F.col("length") > 2 * k + 1) & (F.col("cov") > 10))
    return base.agg(F.try_divide(F.sum(F.col("length") * F.col("cov")), F.sum("length")).alias("coverage"))


def seeds(contigs: DataFrame, k: int, least: int) -> DataFrame:
    """contig, length of contigs of at least `least`, covered within half of the mean, and not followed by their own reverse."""
    followed = F.coalesce(F.lead("contig").over(Window.partitionBy((F.col("contig") + 1 - F.col("contig") % 2).cast("long")).orderBy("contig")) == F.col("contig") + 1, F.lit(False))
    known = contigs.withColumn("followed", followed).crossJoin(F.broadcast(mean_coverage(contigs, k)))
    fits = (F.col("length") >= least) & (F.col("cov") > 0.5 * F.col("coverage")) & (F.col("cov") < 1.5 * F.col("coverage")) & ~F.col("followed")
    return known.where(fits).select("contig", "length")
