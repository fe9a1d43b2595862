"""What both ends of gaps reach, by bits inside tasks, against plain search."""

import random

import pytest

from linkloom.operators import hops
from linkloom.operators import pairs as pe


@pytest.mark.parametrize("loops", [2, 3, 4])
def test_bits_against_plain_search(spark, monkeypatch, loops):
    """Several slices and pieces, a node of many targets, ids below zero, repeats, and gaps whose ends have no relation."""
    monkeypatch.setattr(pe, "JOINED", -1)
    for name, value in (("STATE", 2000), ("STEPS", 100), ("FEW", 3)):
        monkeypatch.setattr(hops, name, value)
    rng = random.Random(loops)
    steps = [(rng.randrange(-40, 200), 3 * rng.randrange(-10, 100)) for _ in range(260)] + [(7, x) for x in range(0, 200, 3)] + [(7, 7)]
    pairs = [(rng.randrange(-40, 200), rng.randrange(-40, 200)) for _ in range(80)] + [(7, 999), (7, 8), (9, 9)]
    near = {}
    for a, b in steps:
        near.setdefault(a, set()).add(b)

    def reached(x):
        at = near.get(x, set())
        for _ in range(loops - 1):
            at = at | {z for y in at for z in near.get(y, ())}
        return at

    want = {(a, b, n) for a, b in pairs for n in reached(a) & reached(b) if n not in (a, b)}
    gaps = spark.createDataFrame(pairs + pairs[:5] + [(None, 7)], "prev long, next long")
    found = pe.hop_candidates(gaps, spark.createDataFrame(steps + steps[:9] + [(7, None), (None, 7)], "node long, other long"), loops)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_what_a_dense_graph_reaches_is_never_dealt(spark, monkeypatch):
    monkeypatch.setattr(pe, "JOINED", -1)
    relations = spark.range(64 * 64).selectExpr("id div 64 AS node", "id % 64 AS other")
    found = pe.hop_candidates(spark.createDataFrame([(1, 2)], "prev long, next long"), relations, 3)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 62
