"""Consistent hashing with virtual nodes and bounded loads.

A ring of hash values carries `vnodes` points of every shard; a document belongs to the first point clockwise of its
key's hash. No shard takes more than its bound; keys that overflow a full shard continue clockwise to the next point of
a shard with room. What overflows is decided on counts of arcs (shards x vnodes of them, whatever the input), and
documents find their place by their rank within their arc.

With load_factor 1 the bounds are n // shards or one more, so counts are at most one apart; with more slack fewer keys
overflow and fewer move when a shard is added. Defined results: null text has no bytes; a null doc_id is placed by its
text's checksum; repeated rows are placed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import rank_in_groups, written

SHARDS = 40
VNODES = 256


def ring(shards: int, vnodes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Points of the ring in order (signed 64-bit) and the shard of each. Points of a shard don't depend on the number of shards."""
    import xxhash

    points = sorted((xxhash.xxh3_64_intdigest(f"{seed}/{s}/{v}".encode()) - 2**63, s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points], dtype=np.int64)


def bounds(rows: int, shards: int, load_factor: float) -> list[int]:
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [int(np.ceil(load_factor * rows / shards))] * shards


def place(counts: dict[int, int], owner: np.ndarray, bound: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Rows (arc, first rank, ranks, shard, first slot): every shard first takes what is its own, arc by arc; the rest continues clockwise."""
    arcs, room, filled = len(owner), list(bound), [0] * len(bound)
    onward = list(range(arcs))  # towards the next arc whose shard has room
    rows, over = [], []

    def find(arc: int) -> int:
        trail = []
        while room[owner[arc]] == 0:
            trail.append(arc)
            onward[arc] = (arc + 1) % arcs if onward[arc] == arc else onward[arc]
            arc = onward[arc]
            if len(trail) > arcs:
                raise ValueError("all shards are full")
        for x in trail:
            onward[x] = arc
        return arc

    def take(arc: int, rank: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            rows.append((arc, rank, n, int(shard), filled[shard]))
            room[shard], filled[shard] = room[shard] - n, filled[shard] + n
        return n

    for arc in sorted(counts):
        taken = take(arc, 0, counts[arc], owner[arc])
        if taken < counts[arc]:
            over.append((arc, taken, counts[arc] - taken))
    for arc, rank, n in over:
        at = arc
        while n:
            at = find(at)
            taken = take(arc, rank, n, owner[at])
            rank, n = rank + taken, n - taken
    return rows


def assign_shards(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, load_factor: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, home_shard (the ring's own choice), shard, slot (gapless from 0 in every shard)."""
    points, owner = ring(shards, vnodes, seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.crc32(text).cast("string")))

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, h.to_numpy(np.int64)) % len(points)).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(key).alias("hash"))
    keyed = written(rows.withColumn("arc", arc_of("hash")), "arcs")
    counts = {r["arc"]: r["n"] for r in keyed.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # at most shards x vnodes rows
    n = sum(counts.values())
    plan = place(counts, owner, bounds(n, shards, load_factor))
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    high = np.int64(1) << np.int64(44)
    starts = table[:, 0] * high + table[:, 1]

    @F.pandas_udf("shard int, slot long, home_shard int")
    def slot(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        a, r = arc.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = table[np.searchsorted(starts, a * high + r, side="right") - 1]
        return pd.DataFrame({"shard": row[:, 3].astype(np.int32), "slot": row[:, 4] + r - row[:, 1], "home_shard": owner[a].astype(np.int32)})

    ranked = rank_in_groups(keyed, "arc", ["hash", "doc_id", "text_crc32", "size"], counts)
    return ranked.withColumn("__slot", slot("arc", "rank")).select("doc_id", "size", "text_crc32", "__slot.home_shard", "__slot.shard", "__slot.slot")


def op8_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
