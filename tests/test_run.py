"""A genome of known order is cut up and sequenced; the run has to put it together again."""

import random

from linkloom.plans.config import Config
from linkloom.plans.pipeline import run


def make(seed=4, contigs=10, length=6000, gap=600, molecules=900, span=16_000):
    rng = random.Random(seed)
    total = contigs * (length + gap)
    order = list(range(contigs))
    rng.shuffle(order)
    place = [(2 * order[i] + 1, i * (length + gap), rng.random() < 0.5) for i in range(contigs)]  # id, start, turned
    sam, reads, no = [], [], 0

    def locate(at, reverse):
        for contig, start, turned in place:
            if start <= at and at + 100 <= start + length:
                pos = at - start + 1
                return (contig, length - (pos + 99) + 1, not reverse) if turned else (contig, pos, reverse)
        return None

    for m in range(molecules):
        begin = rng.randrange(-span // 2, total - span // 2)
        for _ in range(16):
            at = begin + rng.randrange(span)
            ends = [locate(at, False), locate(at + 200, True)]
            if not all(ends) or not 0 <= at < total - 300:
                continue
            no += 1
            reads.append((no, f"r{no}", f"{m}_1"))
            for i, (contig, pos, reverse) in enumerate(ends):
                flag = 0x1 | 0x2 | (0x10 if reverse else 0) | (0x40 if i == 0 else 0x80)
                sam.append((f"r{no}#{m}_1", flag, str(contig), pos, "100M", "=" if ends[0][0] == ends[1][0] else str(ends[1 - i][0]), 300, ["NM:i:0"]))
    rows = [(c, length, 20.0, "".join(rng.choice("ACGT") for _ in range(length))) for c, _, _ in place]
    return place, sam, reads, rows


def test_known_order_comes_back(spark, tmp_path):
    place, sam, reads, rows = make()
    sam = spark.createDataFrame(sam, "qname string, flag int, rname string, pos int, cigar string, rnext string, tlen int, tags array<string>")
    reads = spark.createDataFrame(reads, "read_no long, read_name string, barcode_str string")
    contigs = spark.createDataFrame(rows, "contig long, length int, cov double, seq string")
    config = Config(min_pair_of_barcode=2, order_bin=3000, order_threshold=0.1, end_bin=2500, end_threshold=0.02, gap_bin=1500, gap_threshold=0.02, pe_min_contig=1000, max_gap=5000, gap_trunk=700)
    out = run(spark, sam, reads.select("read_name", "read_no"), reads, contigs, str(tmp_path), config)
    truth = [c for c, _, _ in place]
    chains: dict = {}
    for r in out["chains"].orderBy("chain_id", "idx").collect():
        chains.setdefault(r["chain_id"], []).append(r["contig"])
    assert sum(map(len, chains.values())) >= 8
    for chain in chains.values():
        at = [truth.index(c) for c in chain]
        assert at == sorted(at) or at == sorted(at, reverse=True)
    turned = {c: t for c, _, t in place}
    longest = max(chains.values(), key=len)
    forward = truth.index(longest[0]) < truth.index(longest[-1])
    strand = {r["contig"]: r["strand"] for r in out["scaffolds"].collect()}
    right = sum((strand[c] == "-") == (turned[c] == forward) for c in longest)
    assert right >= 0.8 * len(longest)
    scaffolds = out["scaffolds"].count()
    assert scaffolds + out["unused"].count() == len(truth)
    ends = {r["object"]: r["m"] for r in out["agp"].groupBy("object").agg({"object_end": "max"}).withColumnRenamed("max(object_end)", "m").collect()}
    assert ends == {f"scaffold {r['scaff']}": len(r["seq"]) for r in out["sequences"].collect()}
    again = run(spark, sam, reads.select("read_name", "read_no"), reads, contigs, str(tmp_path), config)
    assert again["scaffolds"].count() == scaffolds
