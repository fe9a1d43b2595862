"""Paired ends: geometry, the directed graph of links, candidates of gaps, and the search for filling paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.checkpoints import persisted
from linkloom.operators.hops import reached_by_both
from linkloom.plans.shipping import ship

#: Rows of a step up to which it is always a join; times that a row of a join is dearer than a word of bits in a task.
JOINED, DEARER = 20_000_000, 1000


def pair_links(pairs: DataFrame, insert: int, max_insert: int = 1000) -> DataFrame:
    """src, dst, gap: both mirrored links of every pair (contig1, len1, pos1, rev1, contig2, len2, pos2, rev2).

    Both contigs are laid on an axis on which read 1 begins at 0 and read 2 at insert - 1; the contig that begins and ends
    first leads. Where one holds the other, or the gap needs more than max_insert, there is no link."""
    p1, p2, r1, r2 = F.col("pos1"), F.col("pos2"), F.col("rev1"), F.col("rev2")
    far = F.lit(insert - 1)
    axis = pairs.withColumns({
        "l1": F.when(r1, -(F.col("len1") - p1)).otherwise(1 - p1),
        "h1": F.when(r1, p1 - 1).otherwise(F.col("len1") - p1),
        "l2": F.when(r2, far - (p2 - 1)).otherwise(far - (F.col("len2") - p2)),
        "h2": F.when(r2, far + F.col("len2") - p2).otherwise(far + p2 - 1),
        "f1": F.col("contig1") + r1.cast("int"), "m1": F.col("contig1") + (~r1).cast("int"),
        "f2": F.col("contig2") + (~r2).cast("int"), "m2": F.col("contig2") + r2.cast("int"),
    })
    leads = (F.col("l1") < F.col("l2")) & (F.col("h1") < F.col("h2"))
    follows = (F.col("l1") > F.col("l2")) & (F.col("h1") > F.col("h2"))
    gap = F.when(leads, F.col("l2") - F.col("h1")).when(follows, F.col("l1") - F.col("h2"))
    link = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    links = F.when(leads, F.array(link("f1", "f2"), link("m2", "m1"))).when(follows, F.array(link("f2", "f1"), link("m1", "m2")))
    return axis.withColumn("gap", gap.cast("int")).where(F.col("gap").isNotNull() & (F.lit(insert) - F.col("gap") <= max_insert)).select(F.explode(links).alias("e"), "gap").select("e.src", "e.dst", "gap")


def link_graph(links: DataFrame) -> DataFrame:
    """src, dst, cnt, len (mean gap, cut off towards zero)."""
    return links.groupBy("src", "dst").agg(F.count("*").alias("cnt"), F.sum("gap").alias("s")).select("src", "dst", "cnt", F.expr("s div cnt").cast("int").alias("len"))


def strong_links(graph: DataFrame, max_len: int, min_count: int) -> DataFrame:
    return graph.where((F.abs("len") <= max_len) & (F.col("cnt") >= min_count))


def ranked_links(graph: DataFrame) -> DataFrame:
    """Adds place: links of a node from the strongest on, ties to the greater target."""
    return graph.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.col("cnt").desc(), F.col("dst").desc())))


def gap_candidates(gaps: DataFrame, relations: DataFrame, strategy: str = "union") -> DataFrame:
    """prev, next, node: contigs related to both (intersection) or either (union) end of a gap. relations: node, other."""
    of = lambda end: gaps.join(relations.select(F.col("node").alias(end), F.col("other").alias("found")), end).select("prev", "next", F.col("found").alias("node"))
    found = of("prev").distinct().join(of("next").distinct(), ["prev", "next", "node"]) if strategy == "intersection" else of("prev").union(of("next")).distinct()
    return found.where((F.col("node") != F.col("prev")) & (F.col("node") != F.col("next")))


def hop_candidates(gaps: DataFrame, relations: DataFrame, loops: int = 2) -> DataFrame:
    """prev, next, node: both ends' neighbours, widened loops - 1 times, then what both reach.

    What a node reaches is one set for all gaps that it ends, in words of 64 neighbouring ids: a node reaches its neighbours and
    what these reach in a step less. Where a step has more than JOINED rows of these, and not far fewer than a dense graph's, the sets
    are kept as bits inside tasks."""
    gaps, steps = gaps.select("prev", "next").distinct(), persisted(relations.select("node", "other").where("node IS NOT NULL AND other IS NOT NULL").distinct(), "relations")
    bit = F.expr("shiftleft(1L, cast(other & 63L as int))")
    first = steps.select("node", F.shiftright("other", 6).alias("word"), bit.alias("bits")).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    if loops > 1 and (nodes := _dense(steps, first)):
        return reached_by_both(gaps.where("prev IS NOT NULL AND next IS NOT NULL"), steps, loops, nodes)
    reach = first
    for _ in range(loops - 1):
        step = steps.join(reach.withColumnRenamed("node", "other"), "other").select("node", "word", "bits")
        reach = first.unionAll(step).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    of = lambda end: reach.select(F.col("node").alias(end), "word", F.col("bits").alias(f"{end}_bits"))
    both = gaps.join(of("prev"), "prev").join(of("next"), ["next", "word"])
    both = both.withColumn("bits", F.col("prev_bits").bitwiseAND(F.col("next_bits"))).where((F.col("bits") != 0) & F.lit(loops > 0))
    place = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1))
    found = both.select("prev", "next", "word", place.alias("place")).select("prev", "next", (F.col("word") * 64 + F.col("place")).alias("node"))
    return found.where((F.col("node") != F.col("prev")) & (F.col("node") != F.col("next")))


def _dense(steps: DataFrame, first: DataFrame) -> int:
    """How many nodes steps have, if sets of bits are to be kept; else 0."""
    into = steps.groupBy(F.col("other").alias("node")).agg(F.count("*").alias("n"))
    made = first.groupBy("node").agg(F.count("*").alias("words")).join(into, "node").agg(F.sum(F.col("n") * F.col("words"))).first()[0] or 0
    if made <= JOINED:
        return 0
    size = steps.agg(F.count("*").alias("n")).first()["n"]
    nodes = steps.select("node").unionAll(steps.select("other")).distinct().count()
    return nodes if size * (nodes / 64) <= DEARER * made else 0


def closure(candidates: DataFrame) -> DataFrame:
    """prev, next, node: both strands of the candidates and of the gap's ends."""
    named = candidates.select("prev", "next", "node").union(candidates.select("prev", "next", "prev")).union(candidates.select("prev", "next", "next"))
    return named.select("prev", "next", F.explode(F.array(F.col("node"), F.col("node") + 1)).alias("node")).distinct()


def subgraphs(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """prev, next, src, dst, cnt, len of links with both ends among a gap's nodes."""
    at = nodes.join(graph, F.col("node") == F.col("src")).drop("node")
    return at.join(nodes.select("prev", "next", F.col("node").alias("dst")), ["prev", "next", "dst"], "left_semi")


def search(links: dict[int, list[int]], lengths: dict[int, int], start: int, stops: set[int], most: int) -> dict[int, int]:
    """Parents of the nodes that a depth-first search from start discovers.

    links: targets of a node, strongest first. A discovered node is not entered if it is a stop, or if the lengths of the nodes
    on the way to it already exceed most; the start has no length."""
    parent, stack = {start: start}, [(start, 0, iter(links.get(start, ())))]
    while stack:
        _, used, targets = stack[-1]
        for node in targets:
            if node not in parent:
                parent[node] = stack[-1][0]
                if node not in stops and used <= most:
                    stack.append((node, used + lengths.get(node, 0), iter(links.get(node, ()))))
                    break
        else:
            stack.pop()
    return parent


def shortest(links: dict[int, list[int]], lengths: dict[int, int], start: int, stops: set[int], most: int) -> dict[int, int]:
    """As search(), by least summed length."""
    import heapq

    parent, best, heap = {start: start}, {start: 0}, [(0, start)]
    while heap:
        used, node = heapq.heappop(heap)
        if used > best[node] or (node != start and (node in stops or used - lengths.get(node, 0) > most)):
            continue
        for target in links.get(node, ()):
            way = used + lengths.get(target, 0)
            if way < best.get(target, 1 << 62):
                best[target], parent[target] = way, node
                heapq.heappush(heap, (way, target))
    return parent


def _path(parent: dict[int, int], target: int) -> list[int]:
    path = [target]
    while parent[path[-1]] != path[-1] and len(path) <= 1000:
        path.append(parent[path[-1]])
    return path[::-1]


def fill_gaps(subgraph: DataFrame, lengths: DataFrame, trunk: DataFrame, most: int = 5000, method: str = "strongest") -> DataFrame:
    """prev, next, s, e, path: gaps of which exactly one of the four pairs of strands is joined by a path.

    subgraph: prev, next, src, dst, cnt, len; lengths: node, length; trunk: contig. A gap's graph is small: it is bounded by the
    candidates of two contigs, so each gap is searched inside a task."""
    sized = subgraph.join(lengths.select(F.col("node").alias("dst"), F.col("length").alias("dst_length")), "dst", "left")
    marked = sized.join(trunk.select(F.explode(F.array(F.col("contig"), F.col("contig") + 1)).alias("dst"), F.lit(True).alias("is_trunk")).distinct(), "dst", "left")

    def solve(of_gap: pd.DataFrame) -> pd.DataFrame:
        prev, nxt = int(of_gap["prev"].iloc[0]), int(of_gap["next"].iloc[0])
        ordered = of_gap.sort_values(["cnt", "dst"], ascending=[False, False])
        links = {int(s): [int(x) for x in g["dst"]] for s, g in ordered.groupby("src", sort=False)}
        sizes = {int(n): int(x) for n, x in zip(of_gap["dst"], of_gap["dst_length"].fillna(0), strict=True)}
        stops = {int(n) for n, t in zip(of_gap["dst"], of_gap["is_trunk"], strict=True) if t is True} | {nxt, nxt + 1}
        found = []
        for s in (prev, prev + 1):
            parent = (search if method == "strongest" else shortest)(links, sizes, s, stops, most)
            found += [(prev, nxt, s, e, _path(parent, e)) for e in (nxt, nxt + 1) if e in parent]
        return pd.DataFrame(found if len(found) == 1 else [], columns=["prev", "next", "s", "e", "path"])

    ship(marked.sparkSession)
    return marked.groupBy("prev", "next").applyInPandas(solve, "prev long, next long, s long, e long, path array<long>")
