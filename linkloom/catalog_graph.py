"""Queries of graph operators: nations linked by the orders that they share, suppliers' chains, documents' shingles."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom import adapters as ad
from linkloom.adapters import sql
from linkloom.operators import graph as g
from linkloom.operators import tiles
from linkloom.operators.chains import consecutive
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


_MEAN = "mean AS (SELECT avg(sim) AS m FROM links), edges AS (SELECT u, v, sim FROM links, mean WHERE sim >= m)"
_DEGREE = "both AS (SELECT u AS node, v AS other FROM edges UNION ALL SELECT v, u FROM edges), degree AS (SELECT node, count(*) AS degree FROM both GROUP BY 1)".replace("both", "ends")


def mean_edges(spark, d):  # noqa: ANN001, ANN201
    """The links of at least mean weight."""
    links = ad.nation_links(spark, d)
    return links.crossJoin(F.broadcast(links.agg(F.avg("sim").alias("m")))).where("sim >= m").select("u", "v", "sim")


#: The spanning forest of edges: an edge stays unless its ends are joined by better ones alone.
_FOREST = """ranked AS (SELECT u, v, sim, row_number() OVER (ORDER BY sim DESC, u, v) AS rk FROM edges),
sym AS (SELECT u, v, rk FROM ranked UNION ALL SELECT v, u, rk FROM ranked),
nodes AS (SELECT DISTINCT u AS n FROM sym),
w0 AS (SELECT u, v, min(rk) AS m FROM sym GROUP BY 1, 2),
w1 AS (SELECT u, v, min(m) AS m FROM (SELECT * FROM w0 UNION ALL SELECT a.u, b.v, greatest(a.m, b.m) FROM w0 a JOIN w0 b ON a.v = b.u WHERE a.u <> b.v) GROUP BY 1, 2),
w2 AS (SELECT u, v, min(m) AS m FROM (SELECT * FROM w1 UNION ALL SELECT a.u, b.v, greatest(a.m, b.m) FROM w1 a JOIN w1 b ON a.v = b.u WHERE a.u <> b.v) GROUP BY 1, 2),
w3 AS (SELECT u, v, min(m) AS m FROM (SELECT * FROM w2 UNION ALL SELECT a.u, b.v, greatest(a.m, b.m) FROM w2 a JOIN w2 b ON a.v = b.u WHERE a.u <> b.v) GROUP BY 1, 2),
w4 AS (SELECT u, v, min(m) AS m FROM (SELECT * FROM w3 UNION ALL SELECT a.u, b.v, greatest(a.m, b.m) FROM w3 a JOIN w3 b ON a.v = b.u WHERE a.u <> b.v) GROUP BY 1, 2),
w5 AS (SELECT u, v, min(m) AS m FROM (SELECT * FROM w4 UNION ALL SELECT a.u, b.v, greatest(a.m, b.m) FROM w4 a JOIN w4 b ON a.v = b.u WHERE a.u <> b.v) GROUP BY 1, 2),
forest AS (SELECT r.u, r.v, r.sim FROM ranked r JOIN w5 w ON w.u = r.u AND w.v = r.v WHERE r.rk <= w.m)"""


@query(sql("links", also=_MEAN) + "SELECT u, v, sim FROM edges")
def G1_similarity_graph(spark, d):  # noqa: ANN001, ANN201, N802
    return mean_edges(spark, d)


@query(sql("links", also=_MEAN + ",\n" + _DEGREE) + "SELECT node, degree FROM degree")
def G2_degrees(spark, d):  # noqa: ANN001, ANN201, N802
    return g.degrees(mean_edges(spark, d))


@query(sql("links", also=_MEAN + ",\n" + _DEGREE) + "SELECT node FROM degree WHERE degree > 2")
def G8_junctions(spark, d):  # noqa: ANN001, ANN201, N802
    return g.junctions(mean_edges(spark, d))


@query(sql("links") + "SELECT u, v, sim FROM links WHERE u % 3 <> 0 AND v % 3 <> 0")
def G2_without_nodes(spark, d):  # noqa: ANN001, ANN201, N802
    links = ad.nation_links(spark, d)
    return g.without_nodes(links, g.degrees(links).where("node % 3 = 0").select("node")).select("u", "v", "sim")


@query(sql("links") + "SELECT u, v, sim FROM links WHERE u % 2 = 0 AND v % 2 = 0")
def J16_induced_subgraph(spark, d):  # noqa: ANN001, ANN201, N802
    links = ad.nation_links(spark, d)
    return g.induced(links, g.degrees(links).where("node % 2 = 0").select("node")).select("u", "v", "sim")


_CHAIN_EDGES = "ce AS (SELECT contig AS u, lead(contig) OVER (PARTITION BY chain_id ORDER BY idx) AS v FROM chains), edges AS (SELECT u, v FROM ce WHERE v IS NOT NULL AND u % 7 <> 0)"


def chain_edges(spark, d):  # noqa: ANN001, ANN201
    """The steps of all chains, broken where a contig is a multiple of 7."""
    return consecutive(ad.chains(spark, d)).where("prev % 7 <> 0").select(F.col("prev").alias("u"), F.col("next").alias("v"))


@query("WITH RECURSIVE " + sql("chains", also=_CHAIN_EDGES)[5:].rstrip() + """, steps AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), reach AS (SELECT u, v FROM steps UNION SELECT r.u, s.v FROM reach r JOIN steps s ON s.u = r.v)
SELECT u AS node, least(u, min(v)) AS component FROM reach GROUP BY u""")
def G4_components(spark, d):  # noqa: ANN001, ANN201, N802
    return g.components(chain_edges(spark, d))


@query("WITH RECURSIVE " + sql("chains", also=_CHAIN_EDGES)[5:].rstrip() + """, starts AS (SELECT u FROM edges WHERE u NOT IN (SELECT v FROM edges)),
walk AS (SELECT u AS start, u AS contig, 0 AS idx FROM starts UNION ALL SELECT w.start, e.v, w.idx + 1 FROM walk w JOIN edges e ON e.u = w.contig)
SELECT min(contig) OVER (PARTITION BY start) AS chain, idx::BIGINT AS idx, contig FROM walk""")
def G10_chain_ranks(spark, d):  # noqa: ANN001, ANN201, N802
    return g.chain_ranks(chain_edges(spark, d))


@query(sql("links", also="edges AS (SELECT * FROM links),\n" + _FOREST) + "SELECT u, v, sim FROM forest")
def G5_spanning_forest(spark, d):  # noqa: ANN001, ANN201, N802
    return g.spanning_forest(ad.nation_links(spark, d))


@query(sql("links", also="edges AS (SELECT * FROM links),\n" + _FOREST) + "SELECT u, v, sim FROM forest")
def G5_forest_by_rounds(spark, d):  # noqa: ANN001, ANN201, N802
    return g.spanning_forest(ad.nation_links(spark, d), small=0)


_TREE = "edges AS (SELECT * FROM links),\n" + _FOREST + """,
ends AS (SELECT u AS node, v AS other FROM forest UNION ALL SELECT v, u FROM forest), degree AS (SELECT node, count(*) AS degree FROM ends GROUP BY 1)"""


@query(sql("links", also=_TREE) + "SELECT DISTINCT e.node FROM ends e JOIN degree a ON a.node = e.node AND a.degree = 1 JOIN degree b ON b.node = e.other AND b.degree > 2")
def G6_tips(spark, d):  # noqa: ANN001, ANN201, N802
    return g.tips(g.spanning_forest(ad.nation_links(spark, d)))


@query()
def G7_deep_tip_removal(spark, d):  # noqa: ANN001, ANN201, N802
    return g.remove_tips(g.spanning_forest(ad.nation_links(spark, d)).select("u", "v"))[1]


def document_forests(spark, d, least: float = 0.02):  # noqa: ANN001, ANN201
    """What holds the maximum spanning forest of documents' pairs, given the nodes that are left out."""
    return tiles.Forests(ad.shingle_blocks(spark, d), least)


@query()
def G9_screened_chains(spark, d):  # noqa: ANN001, ANN201, N802
    return g.order_by_forests(document_forests(spark, d), 0.9, 1000)[0]


@query()
def G11_masked_nodes(spark, d):  # noqa: ANN001, ANN201, N802
    return g.order_by_forests(document_forests(spark, d), 0.9, 1000)[1]


@query()
def G5_document_forest(spark, d):  # noqa: ANN001, ANN201, N802
    return g.spanning_forest(document_forests(spark, d)()).select("u", "v", F.floor(F.col("sim") * 1_000_000).cast("long").alias("ppm"))


@query(sql("links", also=_MEAN) + "SELECT chr(9) || u || chr(9) || '--' || chr(9) || v || ' [sim=' || sim::BIGINT || ']' AS value FROM edges UNION ALL SELECT 'graph {' UNION ALL SELECT '}'")
def K6_dot_lines(spark, d):  # noqa: ANN001, ANN201, N802
    return writers.dot_lines(mean_edges(spark, d).withColumn("sim", F.col("sim").cast("long"))).select("value")


@query(sql("chains") + "SELECT chain_id, idx, contig::VARCHAR AS value FROM chains UNION ALL SELECT DISTINCT chain_id, -1, '---' || chr(9) || chain_id || chr(9) || '---' FROM chains")
def K7_chain_lines(spark, d):  # noqa: ANN001, ANN201, N802
    return writers.chain_lines(ad.chains(spark, d))
