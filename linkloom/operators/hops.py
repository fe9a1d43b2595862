"""What nodes of a dense graph reach in a few steps: a bit for each node that is reached, slice of targets by slice, inside tasks.

A task keeps the bits of all nodes for one slice of targets and goes over the steps, in pieces from the shared folder, once for every
loop; neither steps nor what is reached are dealt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.checkpoints import persisted
from linkloom.plans.shipping import ship

#: Bytes of a slice's bits, about; steps of a piece, about; bits looked through at once; targets up to which a node's are taken one by one.
STATE, STEPS, AT_ONCE, FEW = 32_000_000, 1_000_000, 1_000_000, 32

_PIECE = "gap boolean, a binary, b binary, n binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gap, a, b) of a part in pieces, in the order of a: ids as they are, how often each a stands, b."""
    kept = [tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("gap", "a", "b")) for batch in batches if batch.num_rows]
    if not kept:
        return
    gap, a, b = (np.concatenate(c) for c in zip(*kept, strict=True))
    for kind in (False, True):
        x, y = a[gap == kind], b[gap == kind]
        order = np.lexsort((y, x))
        for i in range(0, len(order), STEPS):
            of, to = x[order[i : i + STEPS]], y[order[i : i + STEPS]]
            of, n = (of, np.empty(0, np.int64)) if kind else np.unique(of, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([kind]), *[pa.array([c.astype(np.int64).tobytes()], pa.binary()) for c in (of, to, n)]], names=["gap", "a", "b", "n"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with places among all names instead of ids; gaps only if both ends have one."""
    for batch in batches:
        names = batch.column("names")
        for row in range(batch.num_rows):
            known = names[row].values.to_numpy()
            a, b, n = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in ("a", "b", "n"))
            gap = batch.column("gap")[row].as_py()
            if gap:
                named = np.isin(a, known) & np.isin(b, known)
                a, b = a[named], b[named]
            a, b = (np.searchsorted(known, x).astype(np.int32) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array([gap]), *[pa.array([x.tobytes()], pa.binary()) for x in (a, b, n.astype(np.int32))]], names=["gap", "a", "b", "n"])


def widened(now: np.ndarray, before: np.ndarray, nodes: np.ndarray, n: np.ndarray, others: np.ndarray) -> None:
    """Adds to what each of these nodes (once each) reaches now what its n next others reached before."""
    ends = np.cumsum(n, dtype=np.int64)
    starts = ends - n
    for i in np.flatnonzero(n > FEW).tolist():
        for j in range(starts[i], ends[i], 1 << 12):
            now[nodes[i]] |= np.bitwise_or.reduce(before[others[j : min(j + (1 << 12), ends[i])]], axis=0)
    few, k = np.flatnonzero(n <= FEW), 0
    while len(few := few[n[few] > k]):
        now[nodes[few]] |= before[others[starts[few] + k]]
        k += 1


def _both(now: np.ndarray, prev: np.ndarray, nxt: np.ndarray, targets: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Targets of the slice that both ends of gaps reach, without the ends."""
    many = max(1, AT_ONCE // (64 * now.shape[1]))
    for i in range(0, len(prev), many):
        p, q = prev[i : i + many], nxt[i : i + many]
        bits = np.unpackbits((now[p] & now[q]).view(np.uint8), axis=1, bitorder="little", count=len(targets))
        at, place = np.nonzero(bits)
        columns = names[p][at], names[q][at], targets[place]
        apart = (columns[2] != columns[0]) & (columns[2] != columns[1])
        if not apart.all():
            columns = tuple(c[apart] for c in columns)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prev", "next", "node"])


def reached_by_both(gaps: DataFrame, steps: DataFrame, loops: int, nodes: int) -> DataFrame:
    """prev, next, node: what both ends of a gap (prev, next) reach in up to `loops` steps (node, other), both without repeats.

    nodes: how many different ids the steps hold."""
    ship(steps.sparkSession)
    words = max(1, min(-(-nodes // 64), STATE // (8 * max(1, nodes))))
    width, slices = 64 * words, -(-nodes // (64 * words))
    names = steps.select("node").unionAll(steps.select("other")).distinct().agg(F.array_sort(F.collect_list("node")).alias("names"))
    names = persisted(names, "hop-names")
    rows = steps.select(F.lit(False).alias("gap"), F.col("node").alias("a"), F.col("other").alias("b"))
    rows = rows.unionAll(gaps.select(F.lit(True), "prev", "next"))
    parts = max(1, min(200, -(-steps.count() // STEPS)))
    pieces = rows.repartition(parts, "a").mapInArrow(_pieces, _PIECE)
    pieces = persisted(pieces.crossJoin(F.broadcast(names)).mapInArrow(_numbered, _PIECE), "hop-steps")
    # A slice's turns follow each other in a task: the steps, again for each loop more, and then the gaps.
    of = names.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "names").repartitionById(slices, F.col("slice"))
    of = of.select("slice", F.explode(F.sequence(F.lit(1), F.lit(loops + 1))).alias("turn"), "names")
    due = (F.col("gap") & (F.col("turn") > loops)) | (~F.col("gap") & (F.col("turn") <= loops))  # not an equality, which would be a join by its key
    both = of.hint("shuffle_replicate_nl").crossJoin(pieces.coalesce(1)).where(due)
    return both.select("slice", "turn", F.when(F.col("turn").isin(1, loops + 1), F.col("names")).alias("names"), "a", "b", "n").mapInArrow(lambda x: _walked(x, loops, width, nodes), "prev long, next long, node long")


def _walked(batches: Iterator[pa.RecordBatch], loops: int, width: int, nodes: int) -> Iterator[pa.RecordBatch]:
    at, names, now, before = (None, 0), None, None, None
    for batch in batches:
        for row in range(batch.num_rows):
            part, turn = (batch.column(c)[row].as_py() for c in ("slice", "turn"))
            a, b, n = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in ("a", "b", "n"))
            lo = part * width
            if (part, turn) != at:
                if turn != (at[1] + 1 if at[0] == part else 1):
                    raise ValueError(f"slice {part}: turn {turn} came after {at}")
                at = part, turn
                if turn == 1:
                    names, before = batch.column("names")[row].values.to_numpy(), None
                    now = np.zeros((nodes, width // 64), np.uint64)
                elif turn <= loops:
                    before, now = now, now.copy()
            if turn == 1:
                to = b.astype(np.int64) - lo
                inside = (to >= 0) & (to < width)
                to = to[inside]
                np.bitwise_or.at(now.ravel(), np.repeat(a, n)[inside].astype(np.int64) * (width // 64) + (to >> 6), np.uint64(1) << (to & 63).astype(np.uint64))
            elif turn <= loops:
                widened(now, before, a, n, b)
            else:
                yield from _both(now, a, b, names[lo : lo + width], names)
