import random

import corpus_pipeline as cp
from linkloom.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import ODD, docs, prose


def make(spark, folder):
    rng = random.Random(3)
    rows = list(ODD)
    for i in range(260):
        text = prose(rng, rng.randint(40, 160))
        if i % 5 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split(" "))
        elif i % 5 == 1:
            text += " mail x@y.org"
        rows.append((100 + i, text, "en", rng.choice(["a", "b", "c"])))
    rows += [(1000 + i, rows[12][1], "en", "a") for i in range(5)]
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(100 + i, int(i % 5 != 0), 0) for i in range(260)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = make(spark, tmp_path)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen, columns = [], table.columns
    for name, stage in cp.STAGES:
        out = stage(spark, table, str(tmp_path))
        if name != cp.STAGES[-1][0]:
            assert out.columns == columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        table = spark.read.parquet(path)
        seen.append(table.collect())
    quality, near, clean, mixed, packed = seen
    loud = {100 + i for i in range(0, 260, 5)}
    assert not loud & {r["doc_id"] for r in quality} and len({r["doc_id"] for r in quality} & {100 + i for i in range(260) if i % 5}) >= 200
    kept = [r["doc_id"] for r in near]
    assert len(kept) == len(set(kept)) and not {1001, 1002, 1003, 1004} & set(kept)
    assert all("@" not in (r["text"] or "") for r in clean) and len(clean) == len(near)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed} and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    assert len(rows) > len(near) > 200
    assert cp.run(spark, str(tmp_path)).count() == len(packed)


def test_empty_tables(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_rows_that_share_an_id(spark, tmp_path):
    """Unlike texts of one id stay, a copy of another document goes alone, equal rows become one."""
    rng = random.Random(5)
    a, b, c = (prose(rng, 60) for _ in range(3))
    table = docs(spark, [(5, a), (5, c), (5, c), (7, b), (9, b), (9, "other words that stand alone here")])
    got = sorted((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, table, "").collect())
    assert got == sorted([(5, a), (5, c), (7, b), (9, "other words that stand alone here")])
