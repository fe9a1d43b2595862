"""Text formats read as DataFrames; gzip by suffix. Long records stay whole, files split where the codec allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.scalars import parse_header


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_no (from 1), read_name, barcode_str, read_index, barcode_num. Only headers are kept.

    Records are split before '@' lines that a '+' line follows two lines later, so quality lines that begin with '@' don't mislead."""
    records = spark.read.option("lineSep", "\n@").text(path).where(F.col("value").rlike(r"^@?[^#\s]+#[^/\s]+.*\n[^\n]*\n\+"))
    placed = records.select(F.monotonically_increasing_id().alias("at"), parse_header(F.split("value", "\n")[0]).alias("h"))
    return numbered(placed, "at").select("read_no", "h.read_name", "h.barcode_str", "h.read_index", "h.barcode_num")


def numbered(rows: DataFrame, at: str) -> DataFrame:
    """Adds read_no, dense from 1 in the order of at (partition in the upper bits), without bringing the rows together."""
    from pyspark.sql import Window

    part = F.shiftright(at, 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("shift"))
    local = rows.withColumn("part", part).withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy(at)))
    return local.join(before, "part").withColumn("read_no", F.col("local") + F.col("shift")).drop("part", "local", "shift", at)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (up to the first blank), header, seq; empty sequences are left out."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("r"))
    header = F.regexp_extract("r", r"^([^\n\r]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "")
    return records.select(F.regexp_extract(header, r"^(\S*)", 1).alias("name"), header.alias("header"), seq.alias("seq")).where("seq <> ''")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig, length, cov, tip, seq of a FASTA whose headers read: id length L cvg_C_tip_T."""
    rows = read_fasta(spark, path)
    g = lambda i: F.regexp_extract("header", r"^(\d+)\s+length\s+(\d+)\s+cvg_([0-9.]+)_tip_(\d+)", i)
    return rows.where(g(1) != "").select(g(1).cast("long").alias("contig"), g(2).cast("int").alias("length"), g(3).cast("double").alias("cov"), g(4).cast("int").alias("tip"), "seq")


def import_contigs(rows: DataFrame) -> DataFrame:
    """contig (1, 3, 5, ... by `at`), name, length, cov, tip, seq from name, seq and at: any FASTA as a contig table."""
    return numbered(rows, "at").select((2 * F.col("read_no") - 1).alias("contig"), "name", F.length("seq").alias("length"), F.lit(18.0).alias("cov"), F.lit(0).alias("tip"), "seq")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, tags of alignment lines."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith("@"))
    return rows.select(p[0].alias("qname"), p[1].cast("int").alias("flag"), p[2].alias("rname"), p[3].cast("int").alias("pos"), p[4].cast("int").alias("mapq"), p[5].alias("cigar"), p[6].alias("rnext"), p[7].cast("int").alias("pnext"), p[8].cast("int").alias("tlen"), F.slice(p, 12, F.greatest(F.size(p) - 11, F.lit(0))).alias("tags"))


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """kind (HD, SQ, RG, PG, CO) and the fields of header lines as a map."""
    rows = spark.read.text(path).where(F.col("value").startswith("@"))
    fields = F.filter(F.split("value", "\t"), lambda x: x.rlike(r"^[A-Za-z][A-Za-z0-9]:"))
    return rows.select(F.substring("value", 2, 2).alias("kind"), F.map_from_entries(F.transform(fields, lambda x: F.struct(F.substring(x, 1, 2), F.regexp_replace(x, r"^..:", "")))).alias("fields"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """name, id of lines of two fields."""
    p = F.split("value", "\t")
    return spark.read.text(path).where(F.size(p) >= 2).select(p[0].alias("name"), p[1].cast("long").alias("id"))


def read_contig_index(spark: SparkSession, path: str) -> DataFrame:
    """contig, length, reverse_add; lines that don't begin with a digit are skipped, a missing third field is true."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.col("value").rlike(r"^[0-9]")).select(p[0].cast("long").alias("contig"), p[1].cast("int").alias("length"), F.coalesce(F.get(p, F.lit(2)).cast("int") != 0, F.lit(True)).alias("reverse_add"))


def read_barcode_positions(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """contig, pos, barcode from lines: contig, then pos:barcode|barcode...; only of the contigs given."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).select(p[0].cast("long").alias("contig"), F.filter(p, lambda x: x.contains(":")).alias("items"))
    if contigs is not None:
        rows = rows.join(contigs.select("contig"), "contig", "left_semi")
    items = rows.select("contig", F.explode("items").alias("i")).select("contig", F.split("i", ":").alias("q"))
    return items.select("contig", F.col("q")[0].cast("int").alias("pos"), F.explode(F.transform(F.split(F.col("q")[1], r"\|"), lambda b: b.cast("long"))).alias("barcode")).distinct()


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """chain_id, idx, contig of files in which a line of dashes and a number begins a chain."""
    chains = spark.read.option("lineSep", "---\n").text(path)
    return _chain_rows(chains)


def _chain_rows(chains: DataFrame) -> DataFrame:
    placed = chains.select(F.monotonically_increasing_id().alias("at"), F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^\d+$")).alias("ids")).where(F.size("ids") > 0)
    return numbered(placed, "at").select(F.col("read_no").alias("chain_id"), F.posexplode("ids").alias("idx", "c")).select("chain_id", "idx", F.col("c").cast("long").alias("contig"))


def read_links(spark: SparkSession, path: str, max_len: int | None = None, min_count: int | None = None) -> DataFrame:
    """src, dst, cnt, len of a DOT digraph's links; weak or long ones are left out while reading."""
    g = lambda i: F.regexp_extract("value", r"(\d+)\s*->\s*(\d+)\s*\[\s*count=\s*(\d+)\s+len=\s*(-?\d+)", i)
    rows = spark.read.text(path).where(F.col("value").contains("->")).select(g(1).cast("long").alias("src"), g(2).cast("long").alias("dst"), g(3).cast("long").alias("cnt"), g(4).cast("int").alias("len"))
    rows = rows if max_len is None else rows.where(F.abs("len") <= max_len)
    return rows if min_count is None else rows.where(F.col("cnt") >= min_count)


def read_scaffolds(spark: SparkSession, path: str) -> DataFrame:
    """contig, strand, gap, length, start_pos, idx, scaff."""
    p = F.split("value", "\t")
    types = [("contig", "long"), ("strand", "string"), ("gap", "int"), ("length", "int"), ("start_pos", "long"), ("idx", "int"), ("scaff", "long")]
    return spark.read.text(path).where(F.size(p) == 7).select(*[p[i].cast(t).alias(n) for i, (n, t) in enumerate(types)])
