import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm.packing import Encoder, best_fit_pack, plan_best_fit
from tests.llm.helpers import ODD, docs, prose


def encoder():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def brute(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_equals_best_fit_piece_by_piece(lengths):
    plan = plan_best_fit(Counter(lengths), 20)
    used, seen = {}, Counter()
    for length, first, ranks, each, sequence, offset in plan:
        for r in range(ranks):
            s = sequence + r // each
            assert 0 <= offset + r % each * length <= 20 - length
            used[s] = used.get(s, 0) + length
            seen[length, first + r] += 1
    assert set(seen) == {(n, r) for n, c in Counter(lengths).items() for r in range(c)} and set(seen.values()) <= {1}
    assert sorted(20 - x for x in used.values()) == brute(lengths, 20)


@pytest.mark.parametrize("text", ["Plain words, here.", "tabs\tand\nlines\r\n  x", "Ünïcödé ÉÀ straße ΣΑΣ İx", "a<|endoftext|>b <|ENDOFTEXT|>", "don't we'll 3rd $5.00 ...,,. A.B.", "é café 가", "日本語 テキスト", " nbsp em ́x", ""])
def test_encoder_agrees_with_the_tokenizer(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(encoder()).encode(text, add_special_tokens=False).ids
    e = Encoder(encoder())
    assert np.frombuffer(e(text), "<u4").tolist() == whole and np.frombuffer(e(text), "<u4").tolist() == whole


def test_round_trip(spark):
    rng = random.Random(1)
    rows = ODD + [(100 + i, prose(rng, rng.choice([3, 40, 400, 3000]))) for i in range(40)]
    packed = best_fit_pack(docs(spark, rows), capacity=512, with_ids=True).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(encoder())
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, lo in enumerate(range(0, len(ids), 512)):
            want[doc_id, piece, lo, tuple(ids[lo : lo + 512])] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in packed)
    by: dict = {}
    for r in packed:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= 1.05 * sum(r["length"] for r in packed) / 512 + 1


def test_empty_table(spark):
    assert best_fit_pack(docs(spark, [])).collect() == []
