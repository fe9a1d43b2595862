import random
import zlib

import pytest
from pyspark.sql import functions as F

from linkloom.llm import compression as c
from tests.llm.helpers import ODD, docs, prose

INSULTS = ["grumblefot", "snarkwit", "blightmug"]


def corpus(rng, n):
    rows, labels = list(ODD), []
    for i in range(n):
        text, bad, toxic = prose(rng, rng.randint(20, 120)), rng.random() < 0.3, rng.random() < 0.3
        words = text.split(" ")
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        rows.append((100 + i, text))
        labels.append((100 + i, int(not bad), int(toxic)))
    return rows, labels + [(100, None, None), (None, 1, 1)]


@pytest.mark.parametrize("label,model,mod,held,threshold", [("quality", c.quality_model, 4, 2, 0.7), ("toxic", c.toxic_model, 5, 0, 0.5)])
def test_held_out_accuracy(spark, label, model, mod, held, threshold):
    rows, labels = corpus(random.Random(4), 900)
    table = docs(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted = model(table, known)
    got = {r["doc_id"]: r["score"] for r in c.score(table, fitted).collect()}
    truth = {i: (q, t)[label == "toxic"] for i, q, t in labels if i and q is not None}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % mod == held]
    right = sum((got[i] >= threshold) == bool(truth[i]) for i in out)
    assert len(out) > 100 and right >= 0.9 * len(out)
    assert all(0 <= s <= 1 for s in got.values()) and c.score(table, fitted).count() == len(rows)
    whole = c.score(table, fitted, table.columns, "own_score")
    assert whole.columns == [*table.columns, "own_score"] and whole.count() == len(rows)


def test_held_out_labels_are_not_learnt(spark):
    rows = [(i, f"text {i}") for i in range(40)]
    labels = [(i, i % 2, 0) for i in range(40)]
    ones, zeros, _ = c.labelled_sample(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "quality", 4, 2)
    used = {int(t.split()[1]) for t in ones + zeros}
    assert used == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_sample_is_bounded_and_leaves_long_texts_out(spark):
    rows = [(i, "a" * (c.LONGEST + 1) if i < 3 else f"t{i}") for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    ones, zeros, share = c.labelled_sample(docs(spark, rows), labels, "quality", 4, 9, per_class=10)
    assert len(ones) <= 20 and not zeros and share == 1.0 and max(map(len, ones)) < 10


def test_long_and_empty_texts_leave_room_for_others(spark):
    """Rows are drawn from those that can be learnt from."""
    rows = [(i, "a" * (c.LONGEST + 1) if i < 20 else "" if i < 25 else f"t{i}") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(45)], "doc_id long, quality int, toxic int")
    ones, _, _ = c.labelled_sample(docs(spark, rows), labels, "quality", 4, 9, per_class=15)
    assert sorted(ones) == sorted(f"t{i}" for i in range(25, 40))


def test_conflicting_labels_and_tied_scores(spark):
    """A document with labels of both kinds counts as the majority, ties as 1; equal texts score alike."""
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    ones, zeros, share = c.labelled_sample(docs(spark, [(1, "one"), (2, "two")]), labels, "quality", 4, 9)
    assert (ones, zeros, share) == (["two"], ["one"], 0.5)


def test_both_toxic_dictionaries_are_trained():
    """What both classes hold is in neither's telling parts, and the toxic dictionary extends the ordinary one."""
    rng = random.Random(3)
    ordinary = [prose(rng, 80) for _ in range(200)]
    toxic = [f"{prose(rng, 40)} {rng.choice(INSULTS)} {prose(rng, 40)}" for _ in range(200)]
    parts = c.telling_parts(toxic, ordinary)
    marked = [p for p in parts if any(w.encode() in p for w in INSULTS)]
    assert len(marked) >= 200 and len(parts) <= 1.2 * len(marked)
    usual, extended = c.toxic_dictionaries(toxic, ordinary)
    assert extended.endswith(usual) and c.coded(b"snarkwit") in extended and c.coded(b"snarkwit") not in usual


def test_a_very_long_text(spark):
    table = docs(spark, [(1, "word " * 400_000), (2, "x" * 2_000_000), (3, "fine")])
    model = c.learn_crossed(["bad snarkwit words"] * 4, ["good plain words"] * 4, 0.5, c.toxic_dictionaries, c.toxic_compressors, c.toxic_features)
    assert all(0 <= r["score"] <= 1 for r in c.score(table, model).collect())


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1, 0)], 1.0)])
def test_without_labels_of_both_classes(spark, labels, score):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table = docs(spark, ODD)
    assert {r["score"] for r in c.score(table, c.quality_model(table, known)).collect()} == {score}


def test_empty_table(spark):
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = docs(spark, [])
    assert c.score(table, c.toxic_model(table, known)).collect() == []


def test_whole_texts_count():
    """What marks a text may stand at its very end."""
    rng = random.Random(9)
    toxic = [prose(rng, 60) + " " + rng.choice(INSULTS) + " " + rng.choice(INSULTS) for _ in range(80)]
    plain = [prose(rng, 60) for _ in range(80)]
    model = c.learn(toxic, plain, 0.5, c.toxic_dictionaries, c.toxic_compressors, c.toxic_features)
    tools = model.compressors(model.dictionaries)
    clean = prose(rng, 3000)
    scores = model.scores([clean + " snarkwit grumblefot snarkwit blightmug", clean], tools)
    assert scores[0] > scores[1]


def test_column_of_the_same_name(spark):
    table = docs(spark, ODD).withColumn("text", F.col("text"))
    model = c.Model((), c.quality_compressors, c.quality_features, None, 0.25)
    assert c.score(table, model, ["doc_id"]).columns == ["doc_id", "score"]
