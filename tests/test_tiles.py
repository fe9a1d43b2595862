"""The self-join by pairs of blocks, against all pairs one by one."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom import catalog
from linkloom.operators import graph as g
from linkloom.operators import tiles


def made(seed=5, n=150):
    """Texts of few words, some of them empty, null, copies, or under an id that another has."""
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.choice((1, 1, 2)) for _ in range(rng.choice((0, 2, 3, 9, 40))))) for i in range(n)]
    rows += [(n + i, rows[3 * i][1]) for i in range(20)] + [(i, rows[i + 1][1]) for i in range(0, 30, 3)] + [(n + 50, None), (None, "a b c d")]
    return rows


def expected(rows, least):
    sets = {}
    for node, text in rows:
        w = (text or "").split()
        if node is not None and len(w) > 2:
            sets.setdefault(node, Counter()).update(zip(w, w[1:], w[2:], strict=False))
    found = {}
    for a, b in combinations(sorted(sets), 2):
        shared = sum((sets[a] & sets[b]).values())
        if shared and (sim := shared / (sets[a].total() + sets[b].total() - shared)) >= least:
            found[a, b] = sim
    return found


def index(spark, rows, documents):
    return tiles.Blocks(spark.createDataFrame(rows, "node long, text string").repartition(3), F.filter(F.split("text", " "), lambda w: w != ""), documents)


@pytest.mark.parametrize("documents", [7, 4096])
def test_pairs(spark, documents):
    rows = made()
    got = {(r["contig_1"], r["contig_2"]): r["sim"] for r in tiles.similar_pairs(index(spark, rows, documents), 0.05).collect()}
    assert got == expected(rows, 0.05)


def test_no_pairs(spark):
    assert not tiles.similar_pairs(index(spark, [(1, "a b"), (2, ""), (3, "a b c")], 4096), 0.05).count()
    assert not tiles.similar_pairs(index(spark, [], 4096), 0.05).count()


def test_prints_of_64_bits_that_agree_are_told_apart():
    side = lambda more: type("Side", (), {"key": np.array([4, 9, 9], np.uint64), "more": np.array(more, np.uint16), "mixed": True})
    one, two = tiles._met(side([1, 2, 3]), side([1, 3, 5]))
    assert list(zip(one.tolist(), two.tolist(), strict=True)) == [(0, 0), (2, 1)]


def test_pairs_are_never_dealt(spark):
    """Disk is to grow with the texts, not with the pairs."""
    plan = catalog.queries()["J4_document_shingles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "contig_1" in plan and "Exchange hashpartitioning" not in plan


def test_forests_and_rounds_without_all_pairs(spark):
    rows, least = made(9, 90), 0.05
    blocks = index(spark, rows, 20)
    pairs = [(u, v, sim) for (u, v), sim in expected(rows, least).items()]
    got = g.spanning_forest(tiles.forest_edges(blocks, least)).collect()
    assert sorted(map(tuple, got)) == sorted(g.kruskal(pairs))
    gone = spark.createDataFrame([(i,) for i in range(0, 90, 4)], "node long")
    got = g.spanning_forest(tiles.forest_edges(blocks, least, gone)).collect()
    assert sorted(map(tuple, got)) == sorted(g.kruskal([p for p in pairs if not any(x < 90 and x % 4 == 0 for x in p[:2])]))


def test_rounds_by_forests(spark):
    rng = random.Random(2)
    edges = [(max(0, i - rng.randint(1, 6)), i, rng.random()) for i in range(1, 120)] + [(i, i + 9, rng.random() / 2) for i in range(0, 100, 5)] + [(500, 501, 0.1)]
    table = spark.createDataFrame(list({e[:2]: e for e in edges}.values()), "u long, v long, sim double")
    want = g.order_contigs(table, 0.5)
    got = g.order_by_forests(lambda gone: table if gone is None else g.without_nodes(table, gone), 0.5)
    for one, other in zip(got, want, strict=True):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    once = g.order_contigs(table, 0.5, 1)[1].count()
    assert 0 < once < want[1].count()  # more than one round


def test_strongest_is_kruskal():
    rng = np.random.default_rng(3)
    edges = [(int(u), int(v), float(s)) for u, v, s in zip(rng.integers(0, 30, 200), rng.integers(30, 60, 200), rng.integers(0, 5, 200), strict=True)]
    edges = list({e[:2]: e for e in edges}.values())
    assert list(zip(*(x.tolist() for x in g.strongest(*map(np.array, zip(*edges, strict=True)))), strict=True)) == g.kruskal(edges)


@pytest.mark.parametrize("fewer", [0.0, 0.7])
def test_rounds_go_over_open_components_only(spark, monkeypatch, fewer):
    """Most texts share nothing; they are left out of the index, or out of its pairs, from the second round on."""
    monkeypatch.setattr(tiles, "FEWER", fewer)
    rows, least = made(3, 90) + [(1000 + i, f"x{i} y{i} z{i} w{i}") for i in range(300)], 0.02
    blocks, asked = index(spark, rows, 25), []
    pairs = spark.createDataFrame([(u, v, sim) for (u, v), sim in expected(rows, least).items()], "u long, v long, sim double")

    class Seen(tiles.Forests):
        def among(self, nodes):
            edges = super().among(nodes)
            asked.append((self.blocks.size, {x for r in self.blocks.rows.collect() for x in np.frombuffer(r["nodes"], np.int64).tolist()}))
            return edges

    got, want = g.order_by_forests(Seen(blocks, least), 0.5), g.order_contigs(pairs, 0.5)
    for one, other in zip(got, want, strict=True):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert len(asked) > 1
    if fewer:
        assert len(asked[0][1]) == asked[0][0] < 150 and not any(x >= 1000 for _, nodes in asked for x in nodes)
