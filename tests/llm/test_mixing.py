import random
from collections import Counter

import pytest

from linkloom.llm.mixing import mix_sources, repeat, water_fill
from tests.llm.helpers import ODD, docs, prose


def brute_fill(sizes, weights=(5, 2, 1), epochs=3):
    """Share, clamp, reshare until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in clamped]
        left, weight = total - sum(clamped.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / weight > epochs * sizes[s]]
        if not over:
            return clamped | {s: left * w[s] / weight for s in rest}
        clamped |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 50, "c": 1000, None: 7}, {"a": 1000, "b": 1, "c": 1, "d": 2, "e": 3}, {"a": 0, "b": 5}, {"a": 9}])
def test_water_fill(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in water_fill(rows).collect()}
    assert got == pytest.approx(brute_fill(sizes))


def test_taken_words_come_near_targets(spark):
    rng = random.Random(2)
    rows = ODD + [(100 + i, prose(rng, rng.randint(1, 60)), "en", rng.choice(["hot"] * 6 + ["b", "c", "d", None])) for i in range(600)]
    table = docs(spark, rows)
    mixed = mix_sources(table).collect()
    assert len(mixed) == len(rows)
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in mixed:
        sizes[r["source"]] += r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (r["size"] * k for k in range(4))
    target = brute_fill(sizes)
    for r in mixed:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    key = lambda x: sorted(str((r["doc_id"], r["taken"])) for r in x)
    assert key(mix_sources(table.repartition(7)).collect()) == key(mixed)
    copies = Counter(r["doc_id"] for r in repeat(table).collect())
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += r["times"]
    assert copies == +want and repeat(table).columns == table.columns


def test_empty_table(spark):
    assert mix_sources(docs(spark, [])).collect() == [] and repeat(docs(spark, [])).collect() == []
