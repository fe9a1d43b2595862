import pytest
from pyspark.sql import functions as F

from linkloom.operators import chains as ch
from linkloom.operators import graph as g
from linkloom.operators import multisets as m
from linkloom.operators import pairs as pe
from linkloom.operators import scaffolds as sc
from linkloom.operators import similarity as sim

MST = [("a", "b", 4), ("a", "h", 8), ("b", "c", 8), ("b", "h", 11), ("c", "d", 7), ("c", "f", 4), ("h", "i", 7), ("h", "g", 1), ("i", "c", 2), ("i", "g", 6), ("g", "f", 2), ("f", "d", 17), ("d", "e", 9), ("f", "e", 10)]
TREE = {("a", "b"), ("a", "h"), ("g", "h"), ("f", "g"), ("c", "f"), ("c", "i"), ("c", "d"), ("d", "e")}
TIPS = "a-e b-e c-f d-f e-g f-g g-h h-i i-j j-k k-m k-n n-o aa-bb"


def edges(spark, rows):
    return spark.createDataFrame([(min(u, v), max(u, v), float(w)) for u, v, w in rows], "u string, v string, sim double")


@pytest.mark.parametrize("small", [None, 0])
def test_spanning_forest(spark, small):
    found = g.spanning_forest(edges(spark, [(u, v, -w) for u, v, w in MST]), small).collect()
    assert {(r["u"], r["v"]) for r in found} == TREE and -sum(r["sim"] for r in found) == 37


def test_tips(spark):
    graph = edges(spark, [(*e.split("-"), 1) for e in TIPS.split()]).select("u", "v")
    left, gone = g.remove_tips(graph)
    assert {(r["node"], r["round"]) for r in gone.collect()} == {*[(x, 1) for x in "abcdm"], ("e", 2), ("f", 2)}
    assert {r["node"] for r in g.both_ways(left).collect()} == {"g", "h", "i", "j", "k", "n", "o", "aa", "bb"}


def test_components(spark):
    rows = ["A-B", "B-C", "C-D", "A-F", "B-D", "X-Y", "X-Z", "O-X", "Z-F", "M-N"]
    found = g.components(edges(spark, [(*e.split("-"), 1) for e in rows]))
    assert {(r["node"], r["component"]) for r in found.collect()} == {*[(x, "A") for x in "ABCDFOXYZ"], ("M", "M"), ("N", "M")}


def test_degrees_and_subgraph(spark):
    graph = edges(spark, [("A", "B", 1), ("A", "C", 1), ("B", "C", 1), ("B", "D", 1), ("C", "D", 1)])
    assert dict(g.degrees(graph).collect()) == {"A": 2, "B": 3, "C": 3, "D": 2}
    nodes = lambda *x: spark.createDataFrame([(n,) for n in x], "node string")
    assert dict(g.degrees(g.without_nodes(graph, nodes("A"))).collect()) == {"B": 2, "C": 2, "D": 2}
    assert g.induced(graph, nodes("A", "B", "C")).count() == 3


def test_chain_ranks(spark):
    rows = [(3, 1), (1, 7), (7, 5), (5, 11), (20, 22)]
    found = {(r["chain"], r["idx"]): r["contig"] for r in g.chain_ranks(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert found == {(1, 0): 3, (1, 1): 1, (1, 2): 7, (1, 3): 5, (1, 4): 11, (20, 0): 20, (20, 1): 22}


def test_ordering_small_and_large_agree(spark, monkeypatch):
    """A line with a junction hanging off it, and a second line."""
    line = [(i, i + 1, 0.5 + i / 100) for i in range(1, 9)] + [(4, 20, 0.9), (20, 21, 0.8), (21, 22, 0.8), (30, 31, 0.5), (31, 32, 0.5)]
    graph = spark.createDataFrame([(int(u), int(v), float(w)) for u, v, w in line], "u long, v long, sim double")
    read = lambda x: (sorted(map(tuple, x[0].select("idx", "contig").collect())), sorted(r[0] for r in x[1].collect()))
    small = read(g.order_contigs(graph, 0.5, 10))
    monkeypatch.setattr(g, "SMALL_COMPONENT", 0)
    assert read(g.order_contigs(graph, 0.5, 10)) == small
    assert small[1] == [4]


def test_multisets(spark):
    make = lambda text: m.collect_weights(spark.createDataFrame([("x", c) for c in text], "k string, e string"), "k", "e")
    a, b = make("Hello"), make("World")
    on = ["k", "e"]
    size = lambda df: tuple(df.agg(F.sum("w"), F.count("*")).first())
    assert size(m.add(a, b, on)) == (10, 7) and size(m.union(a, b, on)) == (8, 7) and size(m.intersection(a, b, on)) == (2, 2)
    assert size(m.subtract(a, b, on)) == (3, 3)
    pairs = a.withColumn("contig", F.lit(1)).union(b.withColumn("contig", F.lit(2))).select("contig", F.col("e").alias("barcode"), "w")
    assert sim.with_similarity(sim.pair_overlaps(pairs, ["contig"]), pairs, ["contig"]).first()["sim"] == 0.25


def test_line_fit(spark):
    fit = lambda pts: ch.total_least_squares(spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double")).first()
    assert fit([(0, 0), (1, 2), (2, 4), (3, 6)])["slope"] == pytest.approx(2)
    assert fit([(0, 1), (1, 2.5), (2, 2), (3, 4.5)])["slope"] == pytest.approx(1.16118742)
    assert fit([(1, 0.9), (4001, 0.5), (8001, 0.35), (12001, 0.1)])["slope"] == pytest.approx(-6.375e-05, rel=1e-3)
    assert fit([(1, 1)])["slope"] is None


@pytest.mark.parametrize("left,right,turned,quality", [((0.3, 0.2), (0.1, 0.1), 0, 2), ((0.1, 0.1), (0.3, 0.2), 1, 2), ((0, 0.2), (0.5, 0.1), 0, 1), ((0.2, 0.1), (0.1, 0.2), 0, 0)])
def test_votes(spark, left, right, turned, quality):
    chains = spark.createDataFrame([(1, 0, 11), (1, 1, 21)], "chain_id long, idx int, contig long")
    rows = [(21, 0, 11, b, float(x)) for b, x in enumerate(left) if x] + [(21, 1, 11, b, float(x)) for b, x in enumerate(right) if x]
    votes = ch.orientation_votes(chains, spark.createDataFrame(rows, "c1 long, b1 int, c2 long, b2 int, sim double"), 3)
    got = votes.where("contig = 21 AND side = 'L'").first()
    assert (got["ctg"], got["quality"]) == (21 + turned, quality)


@pytest.mark.parametrize("asks,value", [((0, 0, 0, 0), 1), ((0, 0, 2, 2), 2), ((2, 2, 1, 1), 2), ((1, 2, 2, 2), 2), ((0, 2, 1, 2), 2), ((0, 2, 1, 0), 2)])
def test_resolution(spark, asks, value):
    columns = [F.lit(x).cast("long") for x in (1, *asks, 1, 1)]
    assert spark.range(1).select(ch.resolve(*columns).alias("x")).first()["x"] == value


@pytest.mark.parametrize("weights,value", [((3, 1), 1), ((2, 2), 2)])
def test_resolution_by_weight(spark, weights, value):
    assert spark.range(1).select(ch.resolve(*[F.lit(x).cast("long") for x in (1, 0, 0, 1, 2, *weights)]).alias("x")).first()["x"] == value


@pytest.mark.parametrize(
    "pos1,rev1,pos2,rev2,links",
    [(900, 0, 150, 1, {(1, 3, 50), (4, 2, 50)}), (100, 1, 150, 1, {(2, 3, 51), (4, 1, 51)}), (900, 0, 700, 0, {(1, 4, 99), (3, 2, 99)}), (100, 1, 700, 0, {(2, 4, 100), (3, 1, 100)}), (10, 0, 150, 1, set())],
)
def test_pair_geometry(spark, pos1, rev1, pos2, rev2, links):
    row = spark.createDataFrame([(1, 1000, pos1, bool(rev1), 3, 800, pos2, bool(rev2))], "contig1 long, len1 int, pos1 int, rev1 boolean, contig2 long, len2 int, pos2 int, rev2 boolean")
    assert {tuple(r) for r in pe.pair_links(row, 300, 1000).collect()} == links


def test_path_search_takes_the_strongest_link_first():
    links = {1: [5, 9], 5: [7], 9: [3], 7: [3]}
    assert pe._path(pe.search(links, {5: 10, 7: 10, 9: 10}, 1, {3, 4}, 100), 3) == [1, 5, 7, 3]
    assert pe._path(pe.shortest(links, {5: 10, 7: 10, 9: 10}, 1, {3, 4}, 100), 3) == [1, 9, 3]
    assert pe._path(pe.search(links, {5: 200, 7: 10, 9: 10}, 1, {3, 4}, 100), 3) == [1, 9, 3]


def test_gap_fill_needs_one_pair_of_strands(spark):
    sub = spark.createDataFrame([(1, 3, 1, 9, 5, 0), (1, 3, 9, 4, 5, 0), (11, 13, 11, 13, 5, 0), (11, 13, 12, 14, 5, 0)], "prev long, next long, src long, dst long, cnt long, len int")
    lengths = spark.createDataFrame([(9, 100)], "node long, length int")
    trunk = spark.createDataFrame([(1,), (3,), (11,), (13,)], "contig long")
    assert [tuple(r) for r in pe.fill_gaps(sub, lengths, trunk).collect()] == [(1, 3, 1, 4, [1, 9, 4])]


def test_scaffold_rows(spark):
    scaffolds = spark.createDataFrame([(1, "+", 5, 4, 1, 1, 1), (3, "-", 0, 3, 10, 2, 1)], "contig long, strand string, gap int, length int, start_pos long, idx int, scaff long")
    sequences = spark.createDataFrame([(1, "ACGT"), (3, "AAC")], "contig long, seq string")
    assert sc.scaffold_sequences(scaffolds, sequences, 2, 1).first()["seq"] == "ACGT" + "N" * 5 + "GTT"
    agp = [tuple(r) for r in sc.agp_rows(scaffolds, min_n=2).orderBy("part_number").collect()]
    assert agp == [("scaffold 1", 1, 4, 1, "W", "1", "1", "4", "+"), ("scaffold 1", 5, 9, 2, "N", "5", "scaffold", "yes", "map"), ("scaffold 1", 10, 12, 3, "W", "3", "1", "3", "-")]


def test_overlaps_are_cut(spark):
    cut = lambda gap: spark.range(1).select(sc.piece(F.lit("ACGTAC"), F.lit(gap), 11, 2).alias("x")).first()["x"]
    assert cut(-2) == "ACGTNN" and cut(0) == "ACGTAC" and cut(-9) == "NN"


def test_hot_barcodes_count_but_make_no_candidates(spark):
    rows = [(c, 1, 1) for c in range(1, 7)] + [(1, 2, 1), (2, 2, 1)]
    weights = spark.createDataFrame(rows, "contig long, barcode long, w long")
    assert [tuple(r) for r in sim.pair_overlaps(weights, ["contig"], cap=4).select("contig_1", "contig_2", "shared").collect()] == [(1, 2, 2)]


@pytest.mark.parametrize("bound", [0, 8])
def test_hot_barcodes_joined_or_looked_up_agree(spark, monkeypatch, bound):
    """Pairs, and that where hot barcodes hold few pairs one join does, and no candidate meets all barcodes of one of its nodes."""
    rows = [(c, b, 1 + (c + b) % 3) for b in range(40) for c in range(b % 7 + 1)]
    weights = spark.createDataFrame(rows, "contig long, barcode long, w long")
    want = {}
    for c1, b1, w1 in rows:
        for c2, b2, w2 in rows:
            if b1 == b2 and c1 < c2:
                total, cool = want.get((c1, c2), (0, False))
                want[c1, c2] = (total + min(w1, w2), cool or b1 % 7 + 1 <= 4)
    monkeypatch.setattr(sim, "HOT_PAIRS", bound)
    found = sim.pair_overlaps(weights, ["contig"], cap=4)
    assert {(r["contig_1"], r["contig_2"]): r["shared"] for r in found.collect()} == {p: total for p, (total, cool) in want.items() if cool}
    assert (found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1) == bool(bound)


@pytest.mark.parametrize("loops", [1, 2, 3, 4])
def test_hops_against_plain_search(spark, loops):
    """Ids on both sides of words' ends, one below zero, a repeated relation and a repeated gap."""
    steps = [(1, 3), (3, 63), (63, 64), (64, 127), (127, 129), (129, 3), (-5, 1), (3, -5), (7, 7), (7, 63), (64, 7), (3, 63)]
    near = {a: {y for x, y in steps if x == a} for a, _ in steps}
    want = set()
    for a, b in [(1, 64), (3, 7), (127, 63), (-5, 999)]:
        reached = []
        for x in (a, b):
            at = near.get(x, set())
            for _ in range(loops - 1):
                at = at | {z for y in at for z in near.get(y, ())}
            reached.append(at)
        want |= {(a, b, n) for n in reached[0] & reached[1] if n not in (a, b)}
    gaps = spark.createDataFrame([(1, 64), (3, 7), (127, 63), (-5, 999), (3, 7)], "prev long, next long")
    found = pe.hop_candidates(gaps, spark.createDataFrame(steps, "node long, other long"), loops)
    assert sorted(map(tuple, found.select("prev", "next", "node").collect())) == sorted(want)


def test_hops_go_by_words_of_ids(spark):
    """Rows that steps are made of: a node's 64 neighbours are a row or two of its reach."""
    relations = spark.range(64).select(F.col("id").alias("node")).crossJoin(spark.range(64).select(F.col("id").alias("other")))
    plan = pe.hop_candidates(spark.createDataFrame([(1, 2)], "prev long, next long"), relations, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan


def test_screening_against_plain_rounds():
    """Random graphs with equal similarities: masked nodes, tips and chains by rounds made anew with plain Kruskal."""
    import random

    import numpy as np

    for turn in range(150):
        r = random.Random(turn)
        rows = {}
        for _ in range(r.randint(1, 80)):
            x, y = sorted(r.sample(range(r.randint(2, 40)), 2))
            rows[x, y] = r.choice([0.1, 0.2, 0.5, r.random()])
        rows = [(u, v, s) for (u, v), s in rows.items()]
        share, rounds = r.choice([0.9, 0.5, 0.0]), r.choice([1, 3, 1000])
        base, nodes, masked, n = list(rows), {x for u, v, _ in rows for x in (u, v)}, set(), 0
        first = len(nodes)
        while True:
            n, size, tips, cut = n + 1, len(nodes), set(), set()
            tree = [e[:2] for e in g.kruskal(base)]
            while size > 3:
                degree = {x: sum(x in e for e in tree) for x in nodes}
                found = {x for u, v in tree for x, y in ((u, v), (v, u)) if degree[x] == 1 and degree[y] > 2}
                if not found:
                    cut = {x for x, d in degree.items() if d > 2}
                    break
                tips |= found
                tree = [e for e in tree if not found & set(e)]
            masked, nodes = masked | cut, nodes - cut
            base = [e for e in base if not cut & set(e[:2])]
            if size < 4 or n >= rounds or not nodes or len(nodes) / first <= share or not cut:
                break
        want = sorted(g._linear([e for e in tree if not cut & set(e)])), sorted(masked), sorted(tips)
        got = g.screen_component(*[np.array(x) for x in zip(*rows, strict=True)], share, rounds)
        assert tuple(map(sorted, got)) == want


def test_a_component_of_many_edges_is_screened_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(g, "_order_large", lambda *_: pytest.fail("rounds over all edges"))
    rows = spark.range(120_000).selectExpr("id % 400 AS u", "400 + id % 401 AS v", "(id * 7919 % 100003) / 100003.0D AS sim").distinct()
    assert g.order_contigs(rows, 0.9, 3)[1].count() > 0
