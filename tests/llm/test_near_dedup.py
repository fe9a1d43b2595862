import random

import pytest

from linkloom.llm import near_dedup as nd
from tests.llm.helpers import ODD, docs, prose


def brute(rows, size=5):
    sets = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split() if (text or "").isascii() else (text or "").split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset())
    ids = [r[0] for r in rows]
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            same = ids[i] is not None and ids[i] == ids[j]
            if None not in (ids[i], ids[j]) and (same or (both and 100 * both >= 85 * either)):
                above[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted(str((ids[i], len(sets[i]), least.get(root(i)) if ids[i] is not None else None)) for i in range(len(rows)))


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def result(spark, rows):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in nd.near_duplicates(docs(spark, rows)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = list(ODD)
    passage = prose(rng, 30)
    for g in range(12):
        base = prose(rng, rng.choice([8, 60, 150, 150])) + " " + passage * (g % 3 == 0)
        for k in range(rng.choice([1, 2, 6, 25])):
            rows.append((len(rows) + 100, edited(rng, base, rng.randint(0, 4)) if k else base))
    rng.shuffle(rows)
    assert result(spark, rows) == brute(rows)


def test_dense_blocks_are_confirmed_inside_tasks(spark, monkeypatch):
    """A large group of near copies of near copies, with blocks so small that lists have to be dealt over several."""
    monkeypatch.setattr(nd, "BLOCK", 12)
    monkeypatch.setattr(nd, "PAIRS_PER_ROW", 0.2)
    rng = random.Random(5)
    base = prose(rng, 140)
    rows = [(i, edited(rng, base, rng.randint(0, 7))) for i in range(90)]
    for i in range(60):
        rows.append((100 + i, edited(rng, rows[rng.randrange(len(rows))][1], rng.randint(0, 2))))
    assert result(spark, rows) == brute(rows)


def test_chain_of_links_is_one_component(spark):
    rng = random.Random(7)
    text, rows = prose(rng, 200), []
    for i in range(12):
        rows.append((50 - i, text))
        text = edited(rng, text, 2)
    got = nd.near_duplicates(docs(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {39} and sum(r["kept"] for r in got) == 1


def test_empty_table(spark):
    assert nd.near_duplicates(docs(spark, [])).collect() == []


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 3), (20, 21), (30, 31), (31, 32), (32, 30)]
    got = {(r["node"], r["component"]) for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {*[(x, 1) for x in (1, 2, 3, 8, 9)], (20, 20), (21, 20), *[(x, 30) for x in (30, 31, 32)]}


def test_a_passage_shared_by_thousands_of_unlike_texts_makes_no_postings(spark):
    """Rows of every step stay in proportion to the texts, not to their pairs."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = " ".join(word() for _ in range(40))
    table = docs(spark, [(i, " ".join([*(word() for _ in range(30)), passage, *(word() for _ in range(30))])) for i in range(3000)])
    sets = nd.shingle_table(table).withColumnRenamed("n_shingles", "n").withColumnRenamed("doc_id", "node")
    posts = nd.postings(sets.select("node", "n", "posted", "sig"))
    assert posts.count() <= 300
    got = nd.near_duplicates(table)
    assert got.where("kept").count() == 3000


def test_a_text_with_very_many_near_copies(spark, monkeypatch):
    """Keys and centres that are split give the links that whole ones give."""
    monkeypatch.setattr(nd, "HOT", 20)
    monkeypatch.setattr(nd, "CHECKS", 7)
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    rows = [(1000 + i, " ".join(w if j != i % 190 else f"x{i}" for j, w in enumerate(base))) for i in range(300)]
    got = nd.near_duplicates(docs(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {1000} and sum(r["kept"] for r in got) == 1


def test_sets_hold_each_distinct_shingle_once_in_odd_and_long_texts():
    from linkloom.llm.common import lower_bytes
    from linkloom.llm.near_dedup import _sets

    texts = ["", "  ", "a", "A b", "x\x1cy z", "é f g h i j", "a b c d e a b c d e", None, "word " * 300_000 + "and a tail", "q" * 1_500_000 + " r s t u v"]
    together = dict(_sets(texts, 5))
    for place, text in enumerate(texts):
        words = lower_bytes(text).split()
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
        assert len(together.get(place, [])) == len(runs)
        assert list(together.get(place, [])) == list(dict(_sets([text], 5)).get(0, []))
