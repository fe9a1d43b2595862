import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import pii
from tests.llm.helpers import ODD, docs, prose


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15],
    }


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"a1.@-+ 9(0", "a@b.c", "1.2.3.4", "256", "4111111111111111", "4111-1111 1111 1111", "+1 (555) 123-4567", "é", "@@", "..", "0001.2.3.04"]), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000, "+" * 200_000):
        pii.base_spans(text)


def disclosed():
    """A rare term stands near one address in eight different passages; the address's own and other words are common."""
    rng = random.Random(8)
    rows = list(ODD)
    for i in range(8):
        rows.append((200 + i, f"{prose(rng, 30)} Zorblax mailed from jane.doe@example.org today {prose(rng, 30)}"))
    rows += [(300 + i, prose(rng, 40) + " today mailed from") for i in range(200)]
    rows += [(600, "nobody but Zorblax, again"), (601, "four copies john@x.org qwxyz"), (602, "four copies john@x.org qwxyz"), (603, "four copies john@x.org qwxyz"), (604, "four copies john@x.org qwxyz")]
    return rows


def test_disclosing_terms(spark):
    rows = disclosed()
    table = docs(spark, rows)
    found = {r["doc_id"]: r for r in pii.find_pii(table).collect() if r["doc_id"] is not None}
    added = lambda i: [s for s in found[i]["spans"].split(",") if s.startswith(("removed", "generalised"))]
    text = {r[0]: r[1] for r in rows}
    at = text[600].index("Zorblax")
    assert len(added(600)) == 1 and added(600)[0].endswith(f":{at}:{at + 7}") and len(added(200)) == 1
    assert all(not added(i) for i in (300, 350, 601, 604))
    assert found[200]["spans"].startswith("email:") and found[601]["spans"] == found[601]["base"] != ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert "Zorblax" not in clean[600] and "jane.doe" not in clean[200] and "[EMAIL]" in clean[200] and clean[300] == text[300]


def naive(rows):
    """Added spans of all rows, from scratch: exact copies are one origin, no other two texts are near copies."""
    texts = {t for _, t, *_ in rows if t}
    texts |= {""} if any(not t for _, t, *_ in rows) else set()
    holds, near, pairs = {}, {}, {}
    for text in texts:
        base = pii.base_spans(text)
        words = [(m.start(), m.end(), pii.terms_of(m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        spans = [(s, e, k) for k, x in base.items() for s, e in x]
        for t in {t for w in words for t in w[2]}:
            holds.setdefault(t, set()).add(text)
        kinds = [k for k in base if base[k]] + ["any"] * bool(spans)
        for k in kinds:
            near.setdefault(k, set()).add(text)
            for t in {t for w in words for t in w[2]}:
                pairs.setdefault((k, t), set()).add(text)
        for s, e, k in spans:
            inside = [i for i, (a, b, _) in enumerate(words) if a < e and s < b]
            for c in pii.classes(k, text[s:e]):
                for a, b, terms in words[max(0, inside[0] - pii.RADIUS) : inside[-1] + 1 + pii.RADIUS]:
                    if not any(x < b and a < y for x, y, _ in spans):
                        for t in terms:
                            pairs.setdefault((c, t), set()).add(text)
                            near.setdefault(c, set()).add(text)
    n, tests = len(texts), len({c for c, _ in pairs}) * len({t for _, t in pairs})
    found = {}
    for (c, t), both in pairs.items():
        n_et, n_e, n_t = len(both), len(near[c]), max(len(holds[t]), len(both))
        expected = n_e * n_t / n
        if n_et * math.log(n_et / expected) - n_et + expected >= math.log(tests / pii.ALPHA):
            found[t] = max(found.get(t, 0), math.log(n_et / expected) / math.log(n / min(n_e, n - 1)))
    kinds = {t: "removed" if x >= pii.REMOVE else "generalised" for t, x in found.items() if x >= pii.GENERALISE}
    out = {}
    for doc_id, text, *_ in rows:
        spans = [x for v in pii.base_spans(text or "").values() for x in v]
        places = {}
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
            s = m.start() + len(m[0]) - len(m[0].lstrip(pii._EDGES))
            e = s + len(m[0].strip(pii._EDGES))
            of = [kinds[t] for t in pii.terms_of(m[0]) if t in kinds]
            if of and not any(x < e and s < y for x, y in spans):
                places[s, e] = max(of)
        base = [f"{k}:{s}:{e}" for k, v in pii.base_spans(text or "").items() for s, e in v]
        out.setdefault(doc_id, []).append(",".join(base + [f"{k}:{s}:{e}" for k, s, e in sorted((k, s, e) for (s, e), k in places.items())]))
    return kinds, out


def test_added_spans_equal_a_naive_recomputation(spark):
    """Kinds, hosts, prefixes and values; words and shapes; copies; very long texts; nulls."""
    rng = random.Random(21)
    rows = list(ODD)
    for i in range(40):
        rows.append((100 + i, f"{prose(rng, 40)} Vexlo wrote to {rng.choice('abcdefgh')}{i}.rowan@mail.example.org {prose(rng, 40)} badge = q{rng.randrange(10**6, 10**7)}x"))
        rows.append((200 + i, f"{prose(rng, 40)} paid by {rng.choice(['4111111111111111', '4111111111111112'])} and {prose(rng, 40)}"))
        rows.append((300 + i, f"{prose(rng, 40)} at 10.20.{i}.{rng.randrange(255)} Zorblax {prose(rng, 40)}"))
    rows += [(1000 + i, prose(rng, 50) + rng.choice(["", " wrote to", " paid by 12 and"])) for i in range(700)]
    rows += [(5000, prose(rng, 60_000) + " Vexlo 4111111111111112 "), (5001, rows[60][1]), (5001, rows[60][1])]
    kinds, want = naive(rows)
    got = {}
    for r in pii.find_pii(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r["spans"])
    assert {"vexlo", "zorblax", "~016"} <= set(kinds)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum("removed" in x or "generalised" in x for v in got.values() for x in v) > 40


def test_shapes_and_classes():
    assert pii.shape_of("ab12-345") == "~x4-03" and pii.shape_of("word") is None and pii.terms_of("a") == ()
    assert pii.classes("email", "Jane.Doe7@Mail.org") == ["email:jane.doe7@mail.org", "host:mail.org", "name:jane", "name:doe"]
    assert pii.classes("ip", "10.20.3.4")[1] == "ip of:10.20" and pii.classes("phone", "+1 (407) 555-7710")[1] == "phone of:1407"


def test_session_settings_stay(spark):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    pii.find_pii(docs(spark, ODD)).collect()
    assert [spark.conf.get(k) for k in keys] == before


def test_near_copies_are_no_evidence(spark):
    """Forty edited copies of a passage that holds an address disclose nothing about it."""
    rng = random.Random(2)
    base = f"{prose(rng, 50)} Quibblefex wrote to sam@example.org lately {prose(rng, 50)}".split(" ")
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(4):
            at = rng.randrange(len(words))
            words[at] = words[at] if "@" in words[at] else f"edit{rng.randrange(999)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(rng, 30)) for i in range(300)]
    got = pii.find_pii(docs(spark, rows))
    assert got.where("spans <> base").count() == 0 and got.where("n_email = 1").count() == 40


def edited(rng, passage, i):
    words = passage.split(" ")
    for _ in range(2):
        at = rng.randrange(len(words))
        words[at] = words[at] if "@" in words[at] or "uibble" in words[at] else f"edit{rng.randrange(999)}"
    return (i, " ".join(words))


@pytest.mark.parametrize(("copies", "others"), [(40, 10), (200, 100)])
def test_near_copies_count_once_beside_other_texts(spark, copies, others):
    """A group of near copies doesn't cancel the evidence of independent texts."""
    rng = random.Random(4)
    passage = f"{prose(rng, 60)} Quibblefex wrote to sam@example.org lately {prose(rng, 60)}"
    rows = [edited(rng, passage, i) for i in range(copies)]
    rows += [(1000 + i, f"{prose(rng, 30)} {prose(rng, 2)} Quibblefex {prose(rng, 2)} sam@example.org {prose(rng, 30)}") for i in range(others)]
    rows += [(2000 + i, prose(rng, 30)) for i in range(2000)]
    table = docs(spark, rows)
    base = pii.base_table(table)
    of = pii.with_origin(base.select("doc_id", "text_hash"), pii.origins(base)).collect()
    assert len({r["origin"] for r in of if r["doc_id"] < 1000}) == 1
    assert len({r["origin"] for r in of if 1000 <= r["doc_id"] < 2000}) == others
    seen = pii.with_origin(base.selectExpr("inline(contexts)", "text_hash"), pii.origins(base))
    assert pii.different(seen.where("term = xxhash64('quibblefex')"), ["term"]).first()["n"] == others + 1


@pytest.mark.parametrize("near", [True, False])
def test_copies_dont_hide_a_term(spark, near):
    """Neither of a text with the entity and its term, nor (not near) of one with the term alone."""
    rng = random.Random(6)
    rows = [(i, f"{prose(rng, 30)} {prose(rng, 2)} Quibblefex {prose(rng, 2)} sam@example.org {prose(rng, 30)}") for i in range(5)]
    rows += [(1000 + i, rows[0][1] if near else "Quibblefex alone in a text of many copies") for i in range(200)]
    rows += [(2000 + i, prose(rng, 30)) for i in range(2000)]
    table = docs(spark, rows)
    weighed = pii.weighed(table, pii.base_table(table)).where("text = 'quibblefex'").collect()
    n = 2005 if near else 2006
    assert {r["n"] for r in weighed} == {n}
    assert max(r["strength"] for r in weighed) == pytest.approx(math.log(n / (5 if near else 6)) / math.log(n / 5))


def test_a_fixed_signature_counts_in_every_unlike_text(spark):
    rng = random.Random(7)
    rows = [(i, f"{prose(rng, 60)} kind regards Quibblefex desk sam@example.org") for i in range(50)] + [(1000 + i, prose(rng, 30)) for i in range(500)]
    table = docs(spark, rows)
    assert "quibblefex" in {r["term"] for r in pii.disclosing_terms(table, pii.base_table(table)).collect()}
    assert all("Quibblefex" not in r["text"] for r in pii.sanitise(table).where("doc_id < 1000").collect())


def test_common_words_are_ruled_out_without_a_scan(spark, monkeypatch):
    """Counts per task of words that stand in every text would grow with tasks times words."""
    rng = random.Random(9)
    usual = [f"usual{i}" for i in range(60)]
    mixed = lambda: " ".join(rng.sample(usual, 30) + prose(rng, 20).split())
    rows = [(i, f"{mixed()} Quibblefex desk sam{i}@example.org {mixed()}") for i in range(60)] + [(1000 + i, mixed()) for i in range(1500)]
    table = docs(spark, rows)
    base = pii.base_table(table)
    held = base.where("mask = 0").select("doc_id", "text_hash", "terms").collect()
    assert {len(r["terms"]) > 0 for r in held if r["text_hash"] % pii.PART == 0} == {True} and {len(r["terms"]) for r in held if r["text_hash"] % pii.PART} == {0}
    counted, scan = [], pii._scan

    def spied(docs, terms, schema, emit):  # noqa: ANN001, ANN202
        counted.append({r[0] for r in terms.collect()})
        return scan(docs, terms, schema, emit)

    monkeypatch.setattr(pii, "_scan", spied)
    found = {r["text"] for r in pii.weighed(table, base, least=pii.GENERALISE).collect()}
    assert len(counted) == 1 and not counted[0] & {pii._spark_hash(w) for w in usual}
    assert "quibblefex" in found and counted[0] >= set(map(pii._spark_hash, found))


def test_sets_of_bits_hold_few_others(spark):
    members = pii._Set(*pii._bits(spark.range(60_000).selectExpr("xxhash64(id)")))
    tried = [r[0] for r in spark.range(60_000, 80_000).selectExpr("xxhash64(id)").collect()]
    assert sum(x in members for x in tried) < 0.02 * len(tried)
    assert all(r[0] in members for r in spark.range(1_000).selectExpr("xxhash64(id)").collect())


def test_rows_and_columns_stay(spark):
    table = docs(spark, ODD)
    got = pii.sanitise(table)
    assert got.columns == table.columns and Counter(str(r["doc_id"]) for r in got.collect()) == Counter(str(r[0]) for r in ODD)
    assert {r["text"] for r in got.collect() if r["doc_id"] in (1, 8)} == {None}
    assert pii.find_pii(table).count() == len(ODD)


def test_mask_and_count(spark):
    row = pii.sanitise(docs(spark, [(1, "call +1 555 123 4567 or a@b.co")])).first()
    assert row["text"] == "call [PHONE] or [EMAIL]" and row["n_chars"] == len(row["text"])
    assert pii.masked("ab cd", [{"kind": "generalised", "start": 3, "end": 5}]) == "ab [WORD]"


def test_empty_table(spark):
    assert pii.find_pii(docs(spark, [])).collect() == [] and pii.sanitise(docs(spark, [])).collect() == []
