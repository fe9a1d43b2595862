"""DataFrames as lines of text formats. Each returns a DataFrame of order columns and `value`; save() writes it in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.scalars import blocked


def save(lines: DataFrame, path: str, order: list[str] | None = None, gzip: bool = False) -> None:
    """Writes value as text, range-partitioned by order, so the files in name order are the whole in order."""
    ordered = lines.orderBy(*order) if order else lines
    writer = ordered.select("value").write.mode("overwrite")
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def _s(*columns: str) -> list:
    return [F.col(c).cast("string") for c in columns]


def dictionary_lines(rows: DataFrame, name: str, number: str) -> DataFrame:
    """name, id; a first line stands for no barcode."""
    lines = rows.select(F.lit(1).alias("k"), F.col(name).alias("name"), F.concat_ws("\t", F.col(name), F.col(number).cast("string")).alias("value"))
    zero = rows.sparkSession.createDataFrame([(0, "0_0_0", "0_0_0\t0")], lines.schema)
    return zero.unionAll(lines)


def histogram_lines(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).select(key, F.concat_ws("\t", *_s(key, "n")).alias("value"))


def position_lines(positions: DataFrame) -> DataFrame:
    """contig, then pos:barcode|barcode... in order."""
    one = positions.groupBy("contig", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_set("barcode")), lambda b: b.cast("string")), "|").alias("b"))
    one = one.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("pos", "b"))).alias("p"))
    return one.select("contig", F.concat(F.col("contig").cast("string"), F.lit("\t"), F.array_join(F.transform("p", lambda p: F.concat(p["pos"].cast("string"), F.lit(":"), p["b"])), "\t")).alias("value"))


def weighted_lines(rows: DataFrame, key: list[str], item: list[str]) -> DataFrame:
    """Key fields joined by ':', then item fields joined by ':' (a barcode and its weight, a bin and its similarity) in order."""
    one = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*item))).alias("i"))
    text = F.array_join(F.transform("i", lambda x: F.concat_ws(":", *[x[c].cast("string") for c in item])), "\t")
    return one.select(*key, F.concat_ws("\t", F.concat_ws(":", *_s(*key)), text).alias("value"))


def dot_lines(edges: DataFrame, directed: bool = False) -> DataFrame:
    """A link a line, as DOT; the frame's first and last lines have order 0 and 2."""
    arrow = "->" if directed else "--"
    body = (
        edges.select(F.lit(1).alias("k"), F.concat(F.lit("\t"), *_s("src"), F.lit(f"\t{arrow}\t"), *_s("dst"), F.lit(" [  count= "), *_s("cnt"), F.lit(" len= "), *_s("len"), F.lit(" ]")).alias("value"))
        if directed
        else edges.select(F.lit(1).alias("k"), F.concat(F.lit("\t"), *_s("u"), F.lit(f"\t{arrow}\t"), *_s("v"), F.lit(" [sim="), *_s("sim"), F.lit("]")).alias("value"))
    )
    frame = edges.sparkSession.createDataFrame([(0, "digraph {" if directed else "graph {"), (2, "}")], body.schema)
    return frame.unionAll(body)


def chain_lines(chains: DataFrame) -> DataFrame:
    heads = chains.select("chain_id").distinct().select("chain_id", F.lit(-1).alias("idx"), F.concat(F.lit("---\t"), *_s("chain_id"), F.lit("\t---")).alias("value"))
    return heads.unionAll(chains.select("chain_id", F.col("idx").cast("int").alias("idx"), F.col("contig").cast("string").alias("value")))


def tab_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Fields joined by tabs, an array's elements each a field."""
    kinds = dict(rows.dtypes)
    parts = [F.array_join(F.transform(c, lambda x: x.cast("string")), "\t") if kinds[c].startswith("array") else F.col(c).cast("string") for c in columns]
    return rows.select(*columns, F.concat_ws("\t", *parts).alias("value"))


def scaffold_lines(scaffolds: DataFrame) -> DataFrame:
    heads = scaffolds.select("scaff").distinct().select("scaff", F.lit(0).alias("idx"), F.concat(F.lit(">scaffold "), *_s("scaff")).alias("value"))
    return heads.unionAll(scaffolds.select("scaff", "idx", F.concat_ws("\t", *_s("contig", "strand", "gap", "length", "start_pos", "idx", "scaff"))))


def fasta_lines(rows: DataFrame, name: str = "name", width: int = 100) -> DataFrame:
    return rows.select(name, F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.regexp_replace(blocked("seq", width), r"\n$", "")).alias("value"))


def agp_lines(rows: DataFrame, date: str, organism: str = "unknown") -> DataFrame:
    """AGP 2.0: comment lines, then rows. The date is a parameter, so reruns agree."""
    comments = ["##agp-version 2.0", f"# ORGANISM: {organism}", "# ASSEMBLY NAME: scaffolds", f"# ASSEMBLY DATE: {date}", "# DESCRIPTION: scaffolds of co-barcoded reads"]
    body = rows.select("object", F.col("part_number").cast("int").alias("part_number"), F.concat_ws("\t", *_s("object", "object_beg", "object_end", "part_number", "component_type", "c6", "c7", "c8", "c9")).alias("value"))
    head = rows.sparkSession.createDataFrame([("", i, c) for i, c in enumerate(comments)], body.schema)
    return head.unionAll(body)
