"""The driver's tables in the roles of reads, contigs, positions, chains and pairs, as DataFrames and as SQL.

contigs: suppliers, with odd ids 2 * suppkey + 1. barcodes: orders. positions: ship dates as days from 1995 on. pairs: the first two
lines of an order. chains: the suppliers of a nation in order. alignments: order lines with a CIGAR and a FLAG made from their
numbers. shingles: three words in a row of a document. links: nations weighed by the orders that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.operators.tiles import Blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select((2 * s + 1).alias("contig"), (2500 + 10 * (s % 50)).cast("int").alias("length"), (15.0 + s % 20).alias("cov"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) + 1
    return table(spark, sf_dir, "lineitem").select((2 * F.col("l_suppkey").cast("long") + 1).alias("contig"), pos.cast("int").alias("pos"), F.col("l_orderkey").cast("long").alias("barcode"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    sized = contigs(spark, sf_dir)
    of = lambda i: line.where(F.col("l_linenumber") == i).select(F.col("l_orderkey").cast("long").alias("read_no"), (2 * F.col("l_suppkey").cast("long") + 1).alias(f"contig{i}"), (F.col("l_partkey") % 2000 + 1).cast("int").alias(f"pos{i}"), (F.col("l_quantity").cast("long") % 2 == 1).alias(f"rev{i}")).join(sized.select(F.col("contig").alias(f"contig{i}"), F.col("length").alias(f"len{i}")), f"contig{i}")
    return of(1).join(of(2), "read_no")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_nation = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("chain_id"), (F.row_number().over(of_nation) - 1).alias("idx"), (2 * F.col("s_suppkey").cast("long") + 1).alias("contig"))


def sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    cigar = F.when(F.col("l_linenumber") == 7, "*").otherwise(F.concat(n, F.lit("S"), q, F.lit("M"), n, F.lit("I"), n, F.lit("D"), q, F.lit("=")))
    key = F.col("l_orderkey").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("r"), key.cast("string"), F.lit("#"), F.col("l_partkey").cast("string"), F.lit("_1")).alias("qname"), (key % 4096).cast("int").alias("flag"), (2 * F.col("l_suppkey").cast("long") + 1).cast("string").alias("rname"),
        (F.col("l_partkey") % 2000 + 1).cast("int").alias("pos"), cigar.alias("cigar"), F.when(F.col("l_linenumber") % 4 == 0, "*").otherwise("=").alias("rnext"), F.col("l_quantity").cast("int").alias("tlen"),
        F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit("XA:Z:x"))).otherwise(F.array(F.lit("NM:i:0"))).alias("tags"), F.col("l_linenumber").cast("int").alias("line"), key.alias("key"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_no, read_name, barcode_str: orders, the barcode by customer; every seventh customer stands for no barcode."""
    c = F.col("o_custkey").cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("read_no"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("read_name"), F.when(c % 7 == 0, "0_0_0").otherwise(F.concat(c.cast("string"), F.lit("_1"))).alias("barcode_str"))


def shingle_blocks(spark: SparkSession, sf_dir: str) -> Blocks:
    """Three words in a row of a document, and how often, as an index in blocks of documents."""
    words = F.filter(F.split(F.lower(F.trim("text")), r"\s+"), lambda x: x != "")
    return Blocks(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("node"), "text"), words)


def nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, sim (whole number of shared orders)."""
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("n"))
    has = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(nation, "l_suppkey").select("l_orderkey", "n").distinct()
    both = has.withColumnRenamed("n", "u").join(has.withColumnRenamed("n", "v"), "l_orderkey").where("u < v")
    return both.groupBy("u", "v").agg(F.count("*").cast("double").alias("sim"))


#: The same as SQL, by name; each may use those before it.
SQL = {
    "contigs": "contigs AS (SELECT 2 * s_suppkey::BIGINT + 1 AS contig, (2500 + 10 * (s_suppkey % 50))::INTEGER AS length, (15.0 + s_suppkey % 20)::DOUBLE AS cov FROM supplier)",
    "positions": "positions AS (SELECT 2 * l_suppkey::BIGINT + 1 AS contig, (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) + 1)::INTEGER AS pos, l_orderkey::BIGINT AS barcode FROM lineitem)",
    "pairs": """side AS (SELECT l_orderkey::BIGINT AS read_no, l_linenumber AS i, 2 * l_suppkey::BIGINT + 1 AS contig, (l_partkey % 2000 + 1)::INTEGER AS pos, l_quantity::BIGINT % 2 = 1 AS rev, c.length AS len FROM lineitem JOIN contigs c ON c.contig = 2 * l_suppkey + 1),
pairs AS (SELECT a.read_no, a.contig AS contig1, a.pos AS pos1, a.rev AS rev1, a.len AS len1, b.contig AS contig2, b.pos AS pos2, b.rev AS rev2, b.len AS len2 FROM side a JOIN side b ON a.read_no = b.read_no AND a.i = 1 AND b.i = 2)""",
    "chains": "chains AS (SELECT s_nationkey::BIGINT AS chain_id, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INTEGER AS idx, 2 * s_suppkey::BIGINT + 1 AS contig FROM supplier)",
    "sam": """sam AS (SELECT 'r' || l_orderkey || '#' || l_partkey || '_1' AS qname, (l_orderkey % 4096)::INTEGER AS flag, 2 * l_suppkey::BIGINT + 1 AS rname, (l_partkey % 2000 + 1)::INTEGER AS pos,
  CASE WHEN l_linenumber = 7 THEN '*' ELSE l_linenumber || 'S' || l_quantity::INTEGER || 'M' || l_linenumber || 'I' || l_linenumber || 'D' || l_quantity::INTEGER || '=' END AS cigar,
  CASE WHEN l_linenumber % 4 = 0 THEN '*' ELSE '=' END AS rnext, l_quantity::INTEGER AS tlen, l_linenumber % 3 = 0 AS xa, l_linenumber::INTEGER AS line, l_orderkey::BIGINT AS key FROM lineitem)""",
    "reads": "reads AS (SELECT o_orderkey::BIGINT AS read_no, 'r' || o_orderkey AS read_name, CASE WHEN o_custkey % 7 = 0 THEN '0_0_0' ELSE o_custkey || '_1' END AS barcode_str FROM orders)",
    "shingles": """tokens AS (SELECT doc_id::BIGINT AS contig, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '') AS t FROM documents),
shingles AS (SELECT contig, barcode, count(*) AS w FROM (SELECT contig, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS barcode FROM tokens WHERE len(t) >= 3) GROUP BY 1, 2)""",
    "links": """has AS (SELECT DISTINCT l_orderkey, s_nationkey::BIGINT AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
links AS (SELECT a.n AS u, b.n AS v, count(*)::DOUBLE AS sim FROM has a JOIN has b ON a.l_orderkey = b.l_orderkey AND a.n < b.n GROUP BY 1, 2)""",
}


def sql(*names: str, also: str = "", recursive: bool = False) -> str:
    """WITH and the fragments of these names, and more of the query's own."""
    parts = [SQL[n] for n in names] + ([also] if also else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
