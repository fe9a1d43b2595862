import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import ann


def table(spark, vectors, ids=None):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def brute(x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        out[q] = [int(i) for i in np.lexsort((np.arange(len(x)), d))[:k]]
    return out


@pytest.mark.parametrize("clusters", [1, 20])
def test_recall(spark, clusters):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(clusters, 24))[rng.integers(clusters, size=3000)] * 2 + rng.normal(size=(3000, 24))
    queries = list(range(0, 3000, 50))
    t = table(spark, x)
    got = {}
    for r in ann.search(t, t.where(F.col("id") % 50 == 0)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(x, queries, 10)
    hits = 0
    for q in queries:
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and q not in [f[1] for f in found]
        assert [f[2] for f in found] == pytest.approx([np.linalg.norm(x[q] - x[f[1]]) for f in found], rel=1e-12)
        hits += len({f[1] for f in found} & set(want[q]))
    assert hits >= 0.9 * 10 * len(queries)


def test_odd_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 10)
    good = [[1, 0], [1, 0], [0, 1], [2, 0]] + [[3, 3]] * 40
    odd = [None, [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], []]
    t = table(spark, good + odd)
    got = ann.search(t, t, k=3).collect()
    assert {r["query_id"] for r in got} == set(range(len(good)))
    of = lambda q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert of(0) == [1, 3, 2] and of(4) == [5, 6, 7] and of(43) == [4, 5, 6]


def test_repeated_and_null_ids(spark):
    t = table(spark, [[1, 0], [1, 0], [0, 1], [5, 5]], [7, 7, 8, None])
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(t, t).collect())
    assert got == [(7, 1, 8), (8, 1, 7)]


def measured(x, n_queries=100):
    """The index of rows x and the share of all rows that a query reads, over all its tables, counted by brute force."""
    queries = x[:n_queries]
    near = []
    for i, q in enumerate(queries):
        d = ((x - q) ** 2).sum(1)
        d[i] = np.inf
        near.append(x[np.argsort(d)[:10]])
    index = ann.fit(x[: ann.SAMPLE], queries, near, len(x))
    seen = np.zeros((len(queries), len(x)), dtype=bool)
    for t in range(ann.TABLES):
        seen |= index.costs(index.places(queries, t), np.floor(index.places(x, t))) <= index.reach
    return index, seen.mean()


def test_candidates_are_a_small_and_falling_share():
    """On clustered rows below a tenth; on isotropic ones, the worst there are, the share falls with the rows."""
    rng = np.random.default_rng(5)
    clustered = rng.normal(size=(200, 32))[rng.integers(200, size=20_000)] * 2 + rng.normal(size=(20_000, 32)) * 0.3
    assert measured(clustered)[1] < 0.1
    isotropic = rng.normal(size=(32_000, 32))
    shares = [measured(isotropic[:n])[1] for n in (500, 4000, 32_000)]
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.5 * shares[0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_embeddings(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in ann.op10_multiprobe_pstable(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = wanted = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits, wanted = hits + len(best & got[int(ids[q])]), wanted + len(best)
    assert set(got) == set(ids[ids % 100 == 0].tolist()) and hits >= 0.9 * wanted


def test_extra_columns(spark):
    t = table(spark, [[1, 0], [0, 1], [1, 1]]).withColumn("part", F.lit(1)).withColumn("slice", F.lit("x")).withColumn("score", F.lit(None)).withColumn("tab", F.lit(2.5))
    assert ann.search(t, t).count() == 6


@pytest.mark.parametrize("vectors", [[], [[1, 2]], [None, [0, 0]]])
def test_few_rows(spark, vectors):
    t = table(spark, vectors)
    assert ann.search(t, t).collect() == []
