import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from linkloom.llm import preference as p
from linkloom.llm import quality_rules as q
from tests.llm.helpers import ODD, docs, prose


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts():
    rng = random.Random(1)
    texts = [None, "", " \n ", "a b c d e a b c d e", "x\nx\n x\n\n\nx", "é#*$ %& |<>\x0b\x0c\x1c ü", "r " * 300, prose(rng, 500)] + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    assert [q.base_counts(t)[:5] for t in texts] == [brute_counts(t) for t in texts]


def table(spark):
    rng = random.Random(6)
    rows = [*ODD, *[(100 + i, prose(rng, rng.randint(30, 150)), rng.choice(["en", "de"]), rng.choice(["hot", "hot", "s2", None])) for i in range(500)]]
    rows += [(900 + i, " ".join(w.upper() + "!!#$" for w in prose(rng, 60).split()), "en", "hot") for i in range(12)]
    return docs(spark, rows), rows


def test_outliers_go_and_prose_stays(spark):
    docs_, rows = table(spark)
    got = {r["doc_id"]: r for r in q.judge(docs_).collect() if r["doc_id"] is not None}
    assert q.judge(docs_).count() == len(rows)
    clean = [got[i]["kept"] for i in range(100, 600) if not got[i]["base_failed"]]
    assert sum(clean) >= 0.99 * len(clean) and not any(got[i]["kept"] for i in range(900, 912))
    assert not got[1]["kept"] and got[1]["base_failed"] and got[1]["n_words"] == 0


def plain_mcd(x, floors, starts=60, steps=30):
    """The least determinant of exact concentration steps from many random starts: mean, covariance, log determinant."""
    rng, h, best = np.random.default_rng(1), int(np.ceil(q.SHARE * len(x))), None
    for _ in range(starts):
        part = x[rng.choice(len(x), 12, replace=False)]
        for _ in range(steps):
            mu, cov = part.mean(0), np.cov(part.T, bias=True) + np.diag(floors**2)
            part = x[np.argsort(np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu), kind="stable")[:h]]
        mu, cov = part.mean(0), np.cov(part.T, bias=True) + np.diag(floors**2)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[2]:
            best = mu, cov, det
    return best


def test_estimates_are_those_of_a_plain_mcd(spark):
    """Whole bins of distance instead of the exact share, and few starts, lose next to nothing; the same rows are rejected."""
    docs_, _ = table(spark)
    rows = q.grouped(q.statistics(docs_)).where("NOT base_failed").cache()
    found = {r["grp"]: r for r in q.estimates(rows).collect()}
    grp = '{"lang":"en","source":"hot"}'
    x = np.array([r["x"] for r in rows.where(F.col("grp") == grp).collect()]) / q.UNIT
    mu, cov, det = plain_mcd(x, np.array(list(q.STATISTICS.values())))
    own = found[grp]
    assert own["determinant"] <= det + 0.3
    far = lambda m, w: np.square((x - m) @ w.T).sum(1)
    plain = far(mu, np.linalg.inv(np.linalg.cholesky(cov)))
    q1, q3 = np.quantile(np.log(plain), (0.25, 0.75))
    cut = max(q.CHI_SQUARE * np.median(plain) / q.NORMAL_MEDIAN, np.exp(q3 + q.FENCE * (q3 - q1)))
    ours = far(np.array(own["mu"]), np.array(own["whiten"]).reshape(6, 6)) > own["cut"]
    assert (ours == (plain > cut)).mean() >= 0.99 and ours.sum() >= 12


def test_small_groups_are_pooled(spark):
    docs_, _ = table(spark)
    names = {r["grp"] for r in q.grouped(q.statistics(docs_)).select("grp").distinct().collect()}
    assert '{"lang":"en","source":"hot"}' in names
    few = q.judge(docs(spark, [(1, "a few words " * 3 + "and other ones that do not repeat")]))
    assert [r["distance"] for r in few.collect()] == [None]


def test_empty_table(spark):
    assert q.judge(docs(spark, [])).collect() == []


def conv(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string, n long")


def test_common_prefix_once_and_masks(spark):
    turn = lambda r, t: (r, t)
    pairs = spark.createDataFrame(
        [
            (1, [turn("user", "hi"), turn("assistant", "A"), turn("user", "go"), turn("assistant", "yes")], [turn("user", "hi"), turn("assistant", "A"), turn("user", "go"), turn("assistant", "no"), turn("user", "x")]),
            (2, [turn("user", "hi")], [turn("user", "hi")]),
            (3, [], [turn("assistant", "only <|im_end|>")]),
        ],
        "pair long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>",
    )
    got = {r["pair"]: r for r in p.format_preferences(pairs).collect()}
    one = got[1]
    assert one["n_prompt_turns"] == 3 and one["prompt"].count("<|im_start|>") == 3
    marked = lambda side, m: [(one["prompt"] + one[side])[int(s) : int(e)] for s, e in (x.split(":") for x in one[m].split(","))]
    assert marked("chosen", "chosen_mask") == ["yes<|im_end|>"] and marked("rejected", "rejected_mask") == ["no<|im_end|>"]
    assert (got[2]["chosen"], got[2]["rejected"], got[2]["chosen_mask"]) == ("", "", "")
    assert got[3]["prompt"] == "" and got[3]["chosen"] == "" and got[3]["rejected"].count("<|im_end|>") == 1


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", "a", "c", 1), (1, 1, "assistant", None, "c", 1), (1, 1, "assistant", "b", "c", 1), (1, 1, "assistant", "b", "c", 1), (1, None, None, "first", "c", 1), (None, 0, "user", "lost", "c", 1), (2, 5, "assistant", "sole", "c", 1)]
    turns = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in p.turns_of(conv(spark, rows)).collect()}
    assert turns == {1: [("", "first"), ("user", "a"), ("assistant", ""), ("assistant", "b"), ("assistant", "b")], 2: [("assistant", "sole")]}
    got = {r["conv_id"]: r for r in p.format_preferences(p.with_stale_reply(p.turns_of(conv(spark, rows)))).collect()}
    assert got[2]["n_prompt_turns"] == 0 and "sole" in got[2]["chosen"] and "sole" not in got[2]["rejected"]
    assert p.format_preferences(p.with_stale_reply(p.turns_of(conv(spark, [])))).collect() == []
