"""Queries of chains, orientation, gaps, paired ends and scaffolds."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom import adapters as ad
from linkloom.adapters import sql
from linkloom.catalog_similarity import _BINS
from linkloom.functions import scalars as s
from linkloom.operators import chains as ch
from linkloom.operators import pairs as pe
from linkloom.operators import scaffolds as sc
from linkloom.operators import similarity as sim
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


# Ends of contigs: weights in head and tail bins, similarities in both directions, in millionths so that both engines agree.

_ENDS = """bins AS (SELECT contig, 0 AS bin, 1 AS start, least(length // 2 - 1, 1200) AS "end" FROM contigs UNION ALL SELECT contig, 1, greatest(length // 2, length - 1199), length FROM contigs),
weights AS (SELECT p.contig, b.bin, p.barcode, count(*) AS w FROM (SELECT DISTINCT * FROM positions) p JOIN bins b ON p.contig = b.contig AND p.pos BETWEEN b.start AND b."end" GROUP BY 1, 2, 3),
totals AS (SELECT contig, bin, sum(w) AS t FROM weights GROUP BY 1, 2),
bp AS (SELECT a.contig AS c1, a.bin AS b1, b.contig AS c2, b.bin AS b2, sum(least(a.w, b.w))::BIGINT AS shared FROM weights a JOIN weights b ON a.barcode = b.barcode AND a.contig <> b.contig GROUP BY 1, 2, 3, 4),
sims AS (SELECT c1, b1, c2, b2, floor(shared / (p.t + q.t - shared)::DOUBLE * 1000000)::BIGINT AS sim FROM bp JOIN totals p ON p.contig = c1 AND p.bin = b1 JOIN totals q ON q.contig = c2 AND q.bin = b2)"""


def end_sims(spark, d):  # noqa: ANN001, ANN201
    w = sim.barcodes_in_bins(ad.positions(spark, d), sim.chop_bins(ad.contigs(spark, d), s.end_bins("length", 1200, 1_000_000)))
    node = ["contig", "bin"]
    found = sim.with_similarity(sim.pair_overlaps(w, node, apart="contig"), w, node).withColumn("sim", s.ppm("sim"))
    both = sim.symmetrise(found, node, "sim")
    return both.select(F.col("contig_1").alias("c1"), F.col("bin_1").alias("b1"), F.col("contig_2").alias("c2"), F.col("bin_2").alias("b2"), F.col("sim").cast("double").alias("sim"))


_SLOTS = _ENDS + """,
slots AS (SELECT a.chain_id, a.contig, b.contig AS other, b.idx - a.idx AS step FROM chains a JOIN chains b ON a.chain_id = b.chain_id AND b.idx <> a.idx AND abs(b.idx - a.idx) <= 3),
full_slots AS (SELECT x.*, k.b, coalesce(h.sim, 0) AS head, coalesce(t.sim, 0) AS tail FROM slots x CROSS JOIN (VALUES (0), (1)) k(b)
  LEFT JOIN sims h ON h.c1 = x.contig AND h.b1 = 0 AND h.c2 = x.other AND h.b2 = k.b LEFT JOIN sims t ON t.c1 = x.contig AND t.b1 = 1 AND t.c2 = x.other AND t.b2 = k.b),
faced AS (SELECT contig, CASE WHEN step < 0 THEN 'L' ELSE 'R' END AS side, CASE WHEN step < 0 THEN head ELSE tail END AS near, CASE WHEN step < 0 THEN tail ELSE head END AS far FROM full_slots),
counted AS (SELECT contig, side, count(*) FILTER (WHERE near > far) AS l, count(*) FILTER (WHERE near < far AND near <> 0) AS r, sum(near) AS lt, sum(far) AS rt FROM faced GROUP BY 1, 2),
votes AS (SELECT c.contig, k.side, coalesce(v.l, 0) AS l, coalesce(v.r, 0) AS r, coalesce(v.lt, 0) AS lt, coalesce(v.rt, 0) AS rt FROM chains c CROSS JOIN (VALUES ('L'), ('R')) k(side) LEFT JOIN counted v ON v.contig = c.contig AND v.side = k.side),
turned AS (SELECT contig, side, contig + CASE WHEN l < r OR (l = r AND lt < rt) THEN 1 ELSE 0 END AS ctg, abs(l - r)::BIGINT AS quality, l::BIGINT AS l, r::BIGINT AS r FROM votes)"""


@query(sql("contigs", "positions", "chains", also=_SLOTS) + "SELECT contig, side, ctg, quality, l, r FROM turned")
def A18_orientation_votes(spark, d):  # noqa: ANN001, ANN201, N802
    return ch.orientation_votes(ad.chains(spark, d), end_sims(spark, d), 3)


_STEPS = "steps AS (SELECT chain_id, contig AS prev, lead(contig) OVER (PARTITION BY chain_id ORDER BY idx) AS next FROM chains), nexts AS (SELECT * FROM steps WHERE next IS NOT NULL)"


@query(sql("chains", also=_STEPS) + "SELECT chain_id, prev, next FROM nexts")
def W1_consecutive(spark, d):  # noqa: ANN001, ANN201, N802
    return ch.consecutive(ad.chains(spark, d))


@query(sql("chains") + "SELECT a.chain_id, a.contig, b.contig AS other, (b.idx - a.idx)::INTEGER AS step FROM chains a JOIN chains b ON a.chain_id = b.chain_id AND b.idx <> a.idx AND abs(b.idx - a.idx) <= 3")
def J8_chain_neighbours(spark, d):  # noqa: ANN001, ANN201, N802
    return ch.neighbours(ad.chains(spark, d), 3)


@query(sql("contigs", "positions", "chains", also=_ENDS + ",\n" + _STEPS) + "SELECT c1 AS contig, c2 AS other, max(sim)::DOUBLE AS sim FROM sims JOIN nexts ON c1 = prev AND c2 = next GROUP BY 1, 2")
def A15_next_similarity(spark, d):  # noqa: ANN001, ANN201, N802
    return ch.next_similarity(ad.chains(spark, d), end_sims(spark, d))


_OO = _SLOTS + ",\n" + _STEPS + """,
oo AS (SELECT n.prev, n.next, a.ctg AS true_prev, b.ctg AS true_next, a.quality AS q_prev, b.quality AS q_next, coalesce(m.sim, 0)::BIGINT AS sim_ppm FROM nexts n
  JOIN turned a ON a.contig = n.prev AND a.side = 'R' JOIN turned b ON b.contig = n.next AND b.side = 'L'
  LEFT JOIN (SELECT c1, c2, max(sim) AS sim FROM sims GROUP BY 1, 2) m ON m.c1 = n.prev AND m.c2 = n.next)"""


def gap_orientations(spark, d):  # noqa: ANN001, ANN201
    sims = end_sims(spark, d).withColumn("sim", F.col("sim"))
    found = ch.gap_orientations(ad.chains(spark, d), sims, 3)
    return found.withColumn("sim_ppm", (F.col("sim_ppm") / 1_000_000).cast("long"))  # similarities were in millionths already


@query(sql("contigs", "positions", "chains", also=_OO) + "SELECT prev, next, true_prev, true_next, q_prev, q_next, sim_ppm FROM oo")
def W8_gap_orientations(spark, d):  # noqa: ANN001, ANN201, N802
    return gap_orientations(spark, d)


# Gap model: similarity of bins on one contig by their distance.

_POINTS = _BINS + """,
inner_pairs AS (SELECT a.contig, a.bin AS b1, b.bin AS b2, sum(least(a.w, b.w))::BIGINT AS shared FROM weights a JOIN weights b ON a.barcode = b.barcode AND a.contig = b.contig AND a.bin < b.bin GROUP BY 1, 2, 3),
points AS (SELECT (y.start - x."end")::DOUBLE AS x, shared / (p.t + q.t - shared)::DOUBLE AS y FROM inner_pairs i JOIN totals p ON p.contig = i.contig AND p.bin = b1 JOIN totals q ON q.contig = i.contig AND q.bin = b2
  JOIN bins x ON x.contig = i.contig AND x.bin = b1 JOIN bins y ON y.contig = i.contig AND y.bin = b2),
lsums AS (SELECT regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM points),
line AS (SELECT n, sxy / (sxx - ((sxx + syy) - sqrt((sxx - syy) ** 2 + 4 * sxy ** 2)) / 2) AS slope, mx, my FROM lsums)"""


def points(spark, d):  # noqa: ANN001, ANN201
    from linkloom.catalog_similarity import REACH, SIZE, weights

    w, node = weights(spark, d), ["contig", "bin"]
    found = sim.with_similarity(sim.pair_overlaps(w, node, same="contig"), w, node, same="contig")
    sims = found.select(F.col("contig").alias("c1"), F.col("bin_1").alias("b1"), F.col("contig").alias("c2"), F.col("bin_2").alias("b2"), "sim")
    return ch.same_contig_points(sims, sim.chop_bins(ad.contigs(spark, d), s.equal_bins("length", SIZE, REACH)))


@query(sql("contigs", "positions", also=_POINTS) + "SELECT x, floor(y * 1000000)::BIGINT AS ppm FROM points")
def J10_same_contig_points(spark, d):  # noqa: ANN001, ANN201, N802
    return points(spark, d).select("x", s.ppm("y").alias("ppm"))


@query("""WITH q AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part),
l AS (SELECT count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx, avg(y) AS my FROM q),
f AS (SELECT *, sxy / (sxx - ((sxx + syy) - sqrt((sxx - syy) ** 2 + 4 * sxy ** 2)) / 2) AS slope FROM l)
SELECT n, round(slope, 5) AS slope, round(my - slope * mx, 3) AS intercept FROM f""")
def A17_total_least_squares(spark, d):  # noqa: ANN001, ANN201, N802
    line = ch.total_least_squares(ad.table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")))
    return line.select("n", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("SELECT unnest(range(1, 300))::INTEGER AS gap, floor((-0.0025 * unnest(range(1, 300)) + 0.8) * 1000000 + 0.5)::BIGINT AS ppm")
def K8_gap_table(spark, d):  # noqa: ANN001, ANN201, N802
    line = spark.createDataFrame([(-0.0025, 0.8)], "slope double, intercept double")
    return ch.gap_table(line, 300).select("gap", F.floor(F.col("sim") * 1_000_000 + 0.5).cast("long").alias("ppm"))


@query("""WITH q AS (SELECT p_partkey, ((p_partkey * 37) % 1000) / 1000.0 + 0.0007 AS y FROM part), g AS (SELECT unnest(range(1, 300)) AS gap)
SELECT p_partkey, coalesce((SELECT min(gap) FROM g WHERE -0.0025 * gap + 0.8 < y), 299)::INTEGER AS gap FROM q""")
def J11_gap_lookup(spark, d):  # noqa: ANN001, ANN201, N802
    y = (F.col("p_partkey") * 37 % 1000) / 1000.0 + 0.0007
    return ad.table(spark, d, "part").select("p_partkey", ch.gap_of(y, F.lit(-0.0025), F.lit(0.8), 300, 5000).alias("gap"))


# Paired ends

_P22 = """axis AS (SELECT *, CASE WHEN rev1 THEN -(len1 - pos1) ELSE 1 - pos1 END AS l1, CASE WHEN rev1 THEN pos1 - 1 ELSE len1 - pos1 END AS h1,
  CASE WHEN rev2 THEN 299 - (pos2 - 1) ELSE 299 - (len2 - pos2) END AS l2, CASE WHEN rev2 THEN 299 + len2 - pos2 ELSE 299 + pos2 - 1 END AS h2,
  contig1 + CASE WHEN rev1 THEN 1 ELSE 0 END AS f1, contig1 + CASE WHEN rev1 THEN 0 ELSE 1 END AS m1, contig2 + CASE WHEN rev2 THEN 0 ELSE 1 END AS f2, contig2 + CASE WHEN rev2 THEN 1 ELSE 0 END AS m2 FROM pairs WHERE contig1 <> contig2),
both_links AS (SELECT f1 AS src, f2 AS dst, l2 - h1 AS gap FROM axis WHERE l1 < l2 AND h1 < h2 UNION ALL SELECT m2, m1, l2 - h1 FROM axis WHERE l1 < l2 AND h1 < h2
  UNION ALL SELECT f2, f1, l1 - h2 FROM axis WHERE l1 > l2 AND h1 > h2 UNION ALL SELECT m1, m2, l1 - h2 FROM axis WHERE l1 > l2 AND h1 > h2),
pl AS (SELECT src, dst, gap::INTEGER AS gap FROM both_links WHERE 300 - gap <= 3000),
pg AS (SELECT src, dst, count(*) AS cnt, trunc(sum(gap) / count(*)::DOUBLE)::INTEGER AS len FROM pl GROUP BY 1, 2)"""


def links(spark, d):  # noqa: ANN001, ANN201
    return pe.pair_links(ad.pairs(spark, d).where("contig1 <> contig2"), 300, 3000)


@query(sql("contigs", "pairs", also=_P22) + "SELECT src, dst, gap FROM pl")
def P22_pair_geometry(spark, d):  # noqa: ANN001, ANN201, N802
    return links(spark, d)


@query(sql("contigs", "pairs", also=_P22) + "SELECT src, dst, cnt, len FROM pg")
def A16_pair_links(spark, d):  # noqa: ANN001, ANN201, N802
    return pe.link_graph(links(spark, d))


@query(sql("contigs", "pairs", also=_P22) + "SELECT src, dst, cnt, len FROM pg WHERE abs(len) <= 1500 AND cnt >= 1")
def F15_strong_links(spark, d):  # noqa: ANN001, ANN201, N802
    return pe.strong_links(pe.link_graph(links(spark, d)), 1500, 1)


@query(sql("contigs", "pairs", also=_P22) + "SELECT src, dst, cnt, len, row_number() OVER (PARTITION BY src ORDER BY cnt DESC, dst DESC)::INTEGER AS place FROM pg")
def O1_ranked_links(spark, d):  # noqa: ANN001, ANN201, N802
    return pe.ranked_links(pe.link_graph(links(spark, d)))


_CANDS = _P22 + ",\n" + _STEPS + """,
rel AS (SELECT DISTINCT src - (src + 1) % 2 AS node, dst - (dst + 1) % 2 AS other FROM pg),
from_prev AS (SELECT DISTINCT prev, next, other AS node FROM nexts JOIN rel ON node = prev), from_next AS (SELECT DISTINCT prev, next, other AS node FROM nexts JOIN rel ON node = next),
cu AS (SELECT * FROM (SELECT * FROM from_prev UNION SELECT * FROM from_next) WHERE node <> prev AND node <> next),
ci AS (SELECT * FROM from_prev INTERSECT SELECT * FROM from_next)"""


def relations(spark, d):  # noqa: ANN001, ANN201
    graph = pe.link_graph(links(spark, d))
    base = lambda c: F.col(c) - (F.col(c) + 1) % 2
    return graph.select(base("src").alias("node"), base("dst").alias("other")).distinct()


def gaps(spark, d):  # noqa: ANN001, ANN201
    return ch.consecutive(ad.chains(spark, d)).select("prev", "next")


@query(sql("contigs", "pairs", "chains", also=_CANDS) + "SELECT prev, next, node FROM cu")
def U1_candidates_union(spark, d):  # noqa: ANN001, ANN201, N802
    return pe.gap_candidates(gaps(spark, d), relations(spark, d), "union")


@query(sql("contigs", "pairs", "chains", also=_CANDS) + "SELECT prev, next, node FROM ci WHERE node <> prev AND node <> next")
def U1_candidates_inter(spark, d):  # noqa: ANN001, ANN201, N802
    return pe.gap_candidates(gaps(spark, d), relations(spark, d), "intersection")


_HOPS = _CANDS + """,
r1 AS (SELECT prev, next, node, end_ FROM (SELECT prev, next, node, 0 AS end_ FROM from_prev UNION ALL SELECT prev, next, node, 1 FROM from_next)),
r2 AS (SELECT DISTINCT prev, next, node, end_ FROM (SELECT * FROM r1 UNION ALL SELECT r.prev, r.next, rel.other, r.end_ FROM r1 r JOIN rel ON rel.node = r.node))"""


@query(sql("contigs", "pairs", "chains", also=_HOPS) + "SELECT prev, next, node FROM r2 WHERE end_ = 0 AND node <> prev AND node <> next INTERSECT SELECT prev, next, node FROM r2 WHERE end_ = 1 AND node <> prev AND node <> next")
def U2_hop_candidates(spark, d):  # noqa: ANN001, ANN201, N802
    return pe.hop_candidates(gaps(spark, d), relations(spark, d), 2)


_CLOSE = _CANDS + ",\ncl AS (SELECT DISTINCT prev, next, unnest([node, node + 1]) AS node FROM (SELECT * FROM cu UNION SELECT prev, next, prev FROM cu UNION SELECT prev, next, next FROM cu))"


@query(sql("contigs", "pairs", "chains", also=_CLOSE) + "SELECT prev, next, node FROM cl")
def U3_candidate_closure(spark, d):  # noqa: ANN001, ANN201, N802
    return pe.closure(pe.gap_candidates(gaps(spark, d), relations(spark, d)))


def subgraph(spark, d, graph=None):  # noqa: ANN001, ANN201
    return pe.subgraphs(pe.closure(pe.gap_candidates(gaps(spark, d), relations(spark, d))), graph if graph is not None else pe.link_graph(links(spark, d)))


@query(sql("contigs", "pairs", "chains", also=_CLOSE) + "SELECT a.prev, a.next, g.src, g.dst, g.cnt, g.len FROM cl a JOIN pg g ON g.src = a.node JOIN cl b ON b.prev = a.prev AND b.next = a.next AND b.node = g.dst")
def J16_gap_subgraphs(spark, d):  # noqa: ANN001, ANN201, N802
    return subgraph(spark, d)


def fills(spark, d):  # noqa: ANN001, ANN201
    nodes = ad.contigs(spark, d).select(F.explode(F.array(F.col("contig"), F.col("contig") + 1)).alias("node"), "length")
    trunk = ad.chains(spark, d).where("idx % 4 = 0").select("contig")
    return pe.fill_gaps(subgraph(spark, d, pe.strong_links(pe.link_graph(links(spark, d)), 3000, 2)), nodes, trunk, 5000)


@query()
def G13_gap_fills(spark, d):  # noqa: ANN001, ANN201, N802
    return fills(spark, d)


# Scaffolds

_ASKS = """asks AS (SELECT p_partkey AS k, 1::BIGINT AS base, p_partkey % 3 AS pp, (p_partkey // 3) % 3 AS pn, (p_partkey // 9) % 3 AS sp, (p_partkey // 27) % 3 AS sn, p_size % 4 AS wp, p_size % 3 AS wn FROM part)"""


@query("WITH " + _ASKS + """, c AS (SELECT *, (pp = 1)::INT + (pn = 1)::INT + (sp = 1)::INT + (sn = 1)::INT AS ups, (pp = 2)::INT + (pn = 2)::INT + (sp = 2)::INT + (sn = 2)::INT AS downs FROM asks)
SELECT k, (CASE WHEN ups + downs = 0 THEN 1 WHEN downs = 0 THEN 1 WHEN ups = 0 THEN 2 WHEN pp <> 0 AND pp = pn THEN pp WHEN sp <> 0 AND sp = sn THEN sp WHEN ups > downs THEN 1 WHEN downs > ups THEN 2
  WHEN pp = 0 AND pn <> 0 THEN pn WHEN pn = 0 AND pp <> 0 THEN pp WHEN wp > wn AND sp <> 0 THEN sp WHEN wp <= wn AND sn <> 0 THEN sn ELSE 1 END)::BIGINT AS ctg FROM c""")
def A19_vote_resolution(spark, d):  # noqa: ANN001, ANN201, N802
    k = F.col("p_partkey")
    ask = lambda n: F.expr(f"(p_partkey div {n}) % 3").cast("long")
    return ad.table(spark, d, "part").select(k.alias("k"), ch.resolve(F.lit(1).cast("long"), ask(1), ask(3), ask(9), ask(27), (F.col("p_size") % 4).cast("long"), (F.col("p_size") % 3).cast("long")).alias("ctg"))


@query(sql("contigs", "positions", "chains", also=_OO) + """, asks AS (SELECT c.contig, coalesce(p.true_prev, 0) AS sn, coalesce(n.true_next, 0) AS sp, coalesce(p.q_prev, 0) AS wn, coalesce(n.q_next, 0) AS wp FROM chains c LEFT JOIN oo p ON p.prev = c.contig LEFT JOIN oo n ON n.next = c.contig)
SELECT contig, CASE WHEN sn = 0 AND sp = 0 THEN contig WHEN sn = 0 THEN sp WHEN sp = 0 THEN sn WHEN sn = sp THEN sn WHEN wp > wn THEN sp ELSE sn END AS ctg FROM asks""")
def J12_contig_orientations(spark, d):  # noqa: ANN001, ANN201, N802
    none = spark.createDataFrame([], "prev long, next long, s long, e long")
    return sc.contig_orientations(ad.chains(spark, d), gap_orientations(spark, d), none)


_SCAFF = """fixed AS (SELECT c.chain_id AS scaff, c.idx, c.contig, k.length, CASE WHEN c.contig % 4 = 1 THEN '+' ELSE '-' END AS strand,
  CASE WHEN lead(c.contig) OVER (PARTITION BY c.chain_id ORDER BY c.idx) IS NULL THEN 0 ELSE (c.contig % 40)::INTEGER END AS gap FROM chains c JOIN contigs k ON k.contig = c.contig),
scaffs AS (SELECT contig, strand, gap, length, (coalesce(sum(length + gap) OVER (PARTITION BY scaff ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS start_pos,
  row_number() OVER (PARTITION BY scaff ORDER BY idx)::INTEGER AS idx, scaff FROM fixed)"""


def built(spark, d):  # noqa: ANN001, ANN201
    """Chains as scaffolds: strand and gap by the contig's number."""
    chains = ad.chains(spark, d)
    turned = chains.select("contig", F.when(F.col("contig") % 4 == 1, F.col("contig")).otherwise(F.col("contig") + 1).alias("ctg"))
    sizes = ch.consecutive(chains).select("prev", (F.col("prev") % 40).cast("int").alias("gap"), F.lit(None).cast("array<long>").alias("path"))
    return sc.build_scaffolds(chains, turned, sizes, ad.contigs(spark, d).select("contig", "length"))


@query(sql("contigs", "chains", also=_SCAFF) + "SELECT contig, strand, gap, length, start_pos, idx, scaff FROM scaffs")
def W5_running_coordinates(spark, d):  # noqa: ANN001, ANN201, N802
    return built(spark, d)


_AGP = _SCAFF + """,
rows AS (SELECT scaff, idx, 0 AS k, 'W' AS t, length::BIGINT AS n, contig::VARCHAR AS c6, '1' AS c7, length::VARCHAR AS c8, strand AS c9 FROM scaffs
  UNION ALL SELECT scaff, idx, 1, 'N', greatest(gap, 11)::BIGINT, greatest(gap, 11)::VARCHAR, 'scaffold', 'yes', 'map' FROM scaffs WHERE gap > 0)"""


@query(sql("contigs", "chains", also=_AGP) + """SELECT 'scaffold ' || scaff AS object, (sum(n) OVER w - n + 1)::BIGINT AS object_beg, (sum(n) OVER w)::BIGINT AS object_end, (row_number() OVER w)::INTEGER AS part_number, t AS component_type, c6, c7, c8, c9
FROM rows WINDOW w AS (PARTITION BY scaff ORDER BY idx, k)""")
def K11_agp_rows(spark, d):  # noqa: ANN001, ANN201, N802
    return sc.agp_rows(built(spark, d))


_SEQ = _SCAFF + """,
seqs AS (SELECT 2 * doc_id::BIGINT + 1 AS contig, text AS seq FROM documents),
pieces AS (SELECT s.scaff, s.idx, CASE WHEN s.strand = '+' THEN q.seq ELSE regexp_replace(translate(reverse(q.seq), 'ACGTacgt', 'TGCATGCA'), '[^ACGT]', 'N', 'g') END || CASE WHEN s.gap > 0 THEN repeat('N', greatest(s.gap, 11)) ELSE '' END AS p FROM scaffs s JOIN seqs q ON q.contig = s.contig)"""


def sequences(spark, d):  # noqa: ANN001, ANN201
    return ad.table(spark, d, "documents").select((2 * F.col("doc_id").cast("long") + 1).alias("contig"), F.col("text").alias("seq"))


@query(sql("contigs", "chains", also=_SEQ) + "SELECT scaff, string_agg(p, '' ORDER BY idx) AS seq FROM pieces GROUP BY scaff")
def A20_scaffold_sequences(spark, d):  # noqa: ANN001, ANN201, N802
    return sc.scaffold_sequences(built(spark, d), sequences(spark, d))


@query(sql("contigs", "chains", also=_SEQ) + "SELECT contig, seq FROM seqs WHERE contig NOT IN (SELECT contig FROM scaffs)")
def F19_unused_contigs(spark, d):  # noqa: ANN001, ANN201, N802
    return sc.unused_contigs(sequences(spark, d), built(spark, d))


@query(sql("contigs", "chains", also=_SCAFF) + "SELECT scaff, idx, concat_ws(chr(9), contig, strand, gap, length, start_pos, idx, scaff) AS value FROM scaffs UNION ALL SELECT DISTINCT scaff, 0, '>scaffold ' || scaff FROM scaffs")
def K9_scaffold_lines(spark, d):  # noqa: ANN001, ANN201, N802
    return writers.scaffold_lines(built(spark, d))


@query("SELECT s.s_suppkey AS contig, coalesce(n.n_name, s.s_suppkey::VARCHAR) AS name FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_suppkey")
def P26_name_resolution(spark, d):  # noqa: ANN001, ANN201, N802
    names = ad.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("contig"), F.col("n_name").alias("name"))
    return ad.table(spark, d, "supplier").select(F.col("s_suppkey").alias("contig")).join(names, "contig", "left").select("contig", F.coalesce("name", F.col("contig").cast("string")).alias("name"))
