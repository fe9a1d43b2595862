"""Queries of multisets, bins and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom import adapters as ad
from linkloom.adapters import sql
from linkloom.catalog_scalars import _equal_sql
from linkloom.functions import scalars as s
from linkloom.operators import multisets as m
from linkloom.operators import similarity as sim
from linkloom.operators import tiles
from linkloom.sources import writers

QUERIES: dict = {}
ORACLES: dict = {}


def query(text: str | None = None):  # noqa: ANN201
    def register(run):  # noqa: ANN001, ANN202
        QUERIES[run.__name__] = run
        if text:
            ORACLES[run.__name__] = text
        return run

    return register


SIZE, REACH = 600, 1300
_BINS = _equal_sql(SIZE, REACH) + """,
weights AS (SELECT p.contig, b.bin, p.barcode, count(*) AS w FROM (SELECT DISTINCT * FROM positions) p JOIN bins b ON p.contig = b.contig AND p.pos BETWEEN b.start AND b."end" GROUP BY 1, 2, 3),
totals AS (SELECT contig, bin, sum(w) AS t FROM weights GROUP BY 1, 2)"""


def weights(spark, d):  # noqa: ANN001, ANN201
    return sim.barcodes_in_bins(ad.positions(spark, d), sim.chop_bins(ad.contigs(spark, d), s.equal_bins("length", SIZE, REACH)))


def contig_weights(spark, d):  # noqa: ANN001, ANN201
    return ad.positions(spark, d).repartition("barcode").distinct().groupBy("contig", "barcode").agg(F.count("*").alias("w"))  # dealt once, as the self-join needs it


_CONTIG = """cw AS (SELECT contig, barcode, count(*) AS w FROM (SELECT DISTINCT * FROM positions) GROUP BY 1, 2),
ct AS (SELECT contig, sum(w) AS t FROM cw GROUP BY 1),
shared AS (SELECT a.contig AS contig_1, b.contig AS contig_2, sum(least(a.w, b.w))::BIGINT AS shared FROM cw a JOIN cw b ON a.barcode = b.barcode AND a.contig < b.contig GROUP BY 1, 2)"""
_PPM = "floor(shared / (p.t + q.t - shared)::DOUBLE * 1000000)::BIGINT AS ppm"


@query(sql("contigs", "positions", also=_BINS) + "SELECT contig, bin::INTEGER AS bin, barcode, w FROM weights")
def J3_barcodes_in_bins(spark, d):  # noqa: ANN001, ANN201, N802
    return weights(spark, d)


@query(sql("contigs", "positions", also=_BINS) + "SELECT contig, bin::INTEGER AS bin, sum(w)::BIGINT AS size, count(*) AS keysize FROM weights GROUP BY 1, 2")
def A7_multiset_sizes(spark, d):  # noqa: ANN001, ANN201, N802
    w = weights(spark, d)
    return w.groupBy("contig", "bin").agg(F.sum("w").alias("size"), F.count("*").alias("keysize"))


@query(sql("positions", also=_CONTIG) + "SELECT contig_1, contig_2, shared FROM shared")
def J4_barcode_self_join(spark, d):  # noqa: ANN001, ANN201, N802
    return sim.pair_overlaps(contig_weights(spark, d), ["contig"])


@query(sql("positions", also=_CONTIG) + f"SELECT contig_1, contig_2, {_PPM} FROM shared JOIN ct p ON p.contig = contig_1 JOIN ct q ON q.contig = contig_2")
def A11_weighted_jaccard(spark, d):  # noqa: ANN001, ANN201, N802
    w = contig_weights(spark, d)
    return sim.with_similarity(sim.pair_overlaps(w, ["contig"]), w, ["contig"]).select("contig_1", "contig_2", s.ppm("sim").alias("ppm"))


_BINPAIRS = _BINS + """,
bp AS (SELECT a.contig AS c1, a.bin AS b1, b.contig AS c2, b.bin AS b2, sum(least(a.w, b.w))::BIGINT AS shared FROM weights a JOIN weights b ON a.barcode = b.barcode AND a.contig < b.contig GROUP BY 1, 2, 3, 4),
bs AS (SELECT c1, b1, c2, b2, shared / (p.t + q.t - shared)::DOUBLE AS sim FROM bp JOIN totals p ON p.contig = c1 AND p.bin = b1 JOIN totals q ON q.contig = c2 AND q.bin = b2)"""


def bin_sims(spark, d):  # noqa: ANN001, ANN201
    w, node = weights(spark, d), ["contig", "bin"]
    return sim.with_similarity(sim.pair_overlaps(w, node, apart="contig"), w, node)


@query(sql("contigs", "positions", also=_BINPAIRS) + "SELECT c1, c2, floor(max(sim) * 1000000)::BIGINT AS ppm FROM bs GROUP BY 1, 2")
def A13_contig_roll_up(spark, d):  # noqa: ANN001, ANN201, N802
    rolled = sim.roll_up(bin_sims(spark, d))
    return rolled.select(F.col("contig_1").alias("c1"), F.col("contig_2").alias("c2"), s.ppm("sim").alias("ppm"))


@query(sql("contigs", "positions", also=_BINPAIRS) + "SELECT c1, b1::INTEGER AS b1, c2, b2::INTEGER AS b2, floor(sim * 1000000)::BIGINT AS ppm FROM bs WHERE sim >= 0.01")
def F10_similar_bins(spark, d):  # noqa: ANN001, ANN201, N802
    return bin_sims(spark, d).where(F.col("sim") >= 0.01).select(F.col("contig_1").alias("c1"), F.col("bin_1").alias("b1"), F.col("contig_2").alias("c2"), F.col("bin_2").alias("b2"), s.ppm("sim").alias("ppm"))


@query(sql("contigs", "positions", also=_BINPAIRS) + """SELECT c1, b1::INTEGER AS b1, c2, b2::INTEGER AS b2, floor(sim * 1000000)::BIGINT AS ppm FROM bs WHERE sim >= 0.01
UNION ALL SELECT c2, b2::INTEGER, c1, b1::INTEGER, floor(sim * 1000000)::BIGINT FROM bs WHERE sim >= 0.01""")
def U4_symmetrise(spark, d):  # noqa: ANN001, ANN201, N802
    both = sim.symmetrise(bin_sims(spark, d).where(F.col("sim") >= 0.01), ["contig", "bin"], "sim")
    return both.select(F.col("contig_1").alias("c1"), F.col("bin_1").alias("b1"), F.col("contig_2").alias("c2"), F.col("bin_2").alias("b2"), s.ppm("sim").alias("ppm"))


@query(sql("contigs", "positions", also=_BINS) + f"""SELECT contig, bin_1::INTEGER AS bin_1, bin_2::INTEGER AS bin_2, {_PPM.replace('p.t', 'pt').replace('q.t', 'qt')} FROM (
  SELECT a.contig, a.bin AS bin_1, b.bin AS bin_2, sum(least(a.w, b.w))::BIGINT AS shared, any_value(p.t) AS pt, any_value(q.t) AS qt FROM weights a JOIN weights b ON a.barcode = b.barcode AND a.contig = b.contig AND a.bin < b.bin
  JOIN totals p ON p.contig = a.contig AND p.bin = a.bin JOIN totals q ON q.contig = b.contig AND q.bin = b.bin GROUP BY 1, 2, 3)""")
def J5_same_contig_bins(spark, d):  # noqa: ANN001, ANN201, N802
    w, node = weights(spark, d), ["contig", "bin"]
    found = sim.with_similarity(sim.pair_overlaps(w, node, same="contig"), w, node, same="contig")
    return found.select("contig", "bin_1", "bin_2", s.ppm("sim").alias("ppm"))


@query(sql("positions", also=_CONTIG) + """, hot AS (SELECT barcode FROM cw GROUP BY 1 HAVING count(*) > 4),
cand AS (SELECT DISTINCT a.contig AS contig_1, b.contig AS contig_2 FROM cw a JOIN cw b ON a.barcode = b.barcode AND a.contig < b.contig WHERE a.barcode NOT IN (SELECT barcode FROM hot))
SELECT contig_1, contig_2, shared FROM shared JOIN cand USING (contig_1, contig_2)""")
def F9_hot_barcode_cap(spark, d):  # noqa: ANN001, ANN201, N802
    return sim.pair_overlaps(contig_weights(spark, d), ["contig"], cap=4)


@query(sql("contigs", "positions", "chains", also=_BINPAIRS) + "SELECT c1, b1::INTEGER AS b1, c2, b2::INTEGER AS b2, floor(sim * 1000000)::BIGINT AS ppm FROM bs JOIN chains x ON x.contig = c1 JOIN chains y ON y.contig = c2 WHERE x.chain_id = y.chain_id AND abs(x.idx - y.idx) <= 1")
def F13_neighbours_only(spark, d):  # noqa: ANN001, ANN201, N802
    near = sim.neighbours_only(bin_sims(spark, d), ad.chains(spark, d))
    return near.select(F.col("contig_1").alias("c1"), F.col("bin_1").alias("b1"), F.col("contig_2").alias("c2"), F.col("bin_2").alias("b2"), s.ppm("sim").alias("ppm"))


@query(sql("shingles", also="""st AS (SELECT contig, sum(w) AS t FROM shingles GROUP BY 1),
shared AS (SELECT a.contig AS contig_1, b.contig AS contig_2, sum(least(a.w, b.w))::BIGINT AS shared FROM shingles a JOIN shingles b ON a.barcode = b.barcode AND a.contig < b.contig GROUP BY 1, 2)""") + f"SELECT contig_1, contig_2, {_PPM} FROM shared JOIN st p ON p.contig = contig_1 JOIN st q ON q.contig = contig_2 WHERE shared / (p.t + q.t - shared)::DOUBLE >= 0.02")
def J4_document_shingles(spark, d):  # noqa: ANN001, ANN201, N802
    return tiles.similar_pairs(ad.shingle_blocks(spark, d), 0.02).select("contig_1", "contig_2", s.ppm("sim").alias("ppm"))


def _order_sets(spark, d):  # noqa: ANN001, ANN202
    """Two multisets of parts per supplier parity: what even and odd orders hold."""
    line = ad.table(spark, d, "lineitem").select((F.col("l_orderkey") % 2).alias("side"), F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 50).alias("e"))
    of = lambda v: m.collect_weights(line.where(F.col("side") == v), "k", "e")
    return of(0), of(1)


_SETS = """side AS (SELECT l_orderkey % 2 AS side, l_suppkey AS k, l_partkey % 50 AS e, count(*) AS w FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT k, e, w FROM side WHERE side = 0), b AS (SELECT k, e, w FROM side WHERE side = 1)"""


@query("WITH " + _SETS + "SELECT k, e, least(a.w, b.w) AS w FROM a JOIN b USING (k, e)")
def A8_multiset_intersection(spark, d):  # noqa: ANN001, ANN201, N802
    return m.intersection(*_order_sets(spark, d), ["k", "e"])


@query("WITH " + _SETS + "SELECT k, e, greatest(coalesce(a.w, 0), coalesce(b.w, 0)) AS w FROM a FULL JOIN b USING (k, e)")
def A9_multiset_union(spark, d):  # noqa: ANN001, ANN201, N802
    return m.union(*_order_sets(spark, d), ["k", "e"])


@query("WITH " + _SETS + "SELECT k, e, coalesce(a.w, 0) + coalesce(b.w, 0) AS w FROM a FULL JOIN b USING (k, e)")
def A10_multiset_sum(spark, d):  # noqa: ANN001, ANN201, N802
    return m.add(*_order_sets(spark, d), ["k", "e"])


@query("WITH " + _SETS + "SELECT k, e, a.w - coalesce(b.w, 0) AS w FROM a LEFT JOIN b USING (k, e) WHERE a.w > coalesce(b.w, 0)")
def A10_multiset_difference(spark, d):  # noqa: ANN001, ANN201, N802
    return m.subtract(*_order_sets(spark, d), ["k", "e"])


@query("SELECT l_suppkey AS k, l_partkey % 50 AS e, min(l_quantity) AS least, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2")
def A14_least_and_total(spark, d):  # noqa: ANN001, ANN201, N802
    return ad.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 50).alias("e")).agg(F.min("l_quantity").alias("least"), F.sum("l_quantity").alias("total"))


@query(sql("positions") + """, spots AS (SELECT contig, pos, string_agg(barcode::VARCHAR, '|' ORDER BY barcode) AS b FROM (SELECT DISTINCT * FROM positions) GROUP BY 1, 2)
SELECT contig, contig || chr(9) || string_agg(pos || ':' || b, chr(9) ORDER BY pos) AS value FROM spots GROUP BY 1""")
def K4_position_lines(spark, d):  # noqa: ANN001, ANN201, N802
    return writers.position_lines(ad.positions(spark, d))


@query(sql("contigs", "positions", also=_BINS) + "SELECT contig, bin::INTEGER AS bin, contig || ':' || bin || chr(9) || string_agg(barcode || ':' || w, chr(9) ORDER BY barcode, w) AS value FROM weights GROUP BY contig, bin")
def K5_weight_lines(spark, d):  # noqa: ANN001, ANN201, N802
    return writers.weighted_lines(weights(spark, d), ["contig", "bin"], ["barcode", "w"])


@query("SELECT l_linenumber, l_linenumber || chr(9) || count(*) AS value FROM lineitem GROUP BY 1")
def K3_histogram_lines(spark, d):  # noqa: ANN001, ANN201, N802
    return writers.histogram_lines(ad.table(spark, d, "lineitem"), "l_linenumber")


@query(sql("reads", also="dict AS (SELECT barcode_str, row_number() OVER (ORDER BY min(read_no), barcode_str) AS barcode FROM reads WHERE barcode_str NOT IN ('0', '0_0', '0_0_0', '0_0_0_0') GROUP BY 1)") + "SELECT barcode_str || chr(9) || barcode AS value FROM dict UNION ALL SELECT '0_0_0' || chr(9) || '0'")
def K2_dictionary_lines(spark, d):  # noqa: ANN001, ANN201, N802
    from linkloom.operators.ingest import barcode_dictionary

    return writers.dictionary_lines(barcode_dictionary(ad.reads(spark, d)), "barcode_str", "barcode").select("value")


@query(r"""SELECT 'doc' || doc_id AS name, '>doc' || doc_id || chr(10) || regexp_replace(regexp_replace(text, '(.{100})', '\1' || chr(10), 'gs'), '\n$', '') AS value FROM documents""")
def K10_fasta_lines(spark, d):  # noqa: ANN001, ANN201, N802
    docs = ad.table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("seq"))
    return writers.fasta_lines(docs)
