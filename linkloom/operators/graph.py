"""Graphs as tables: undirected edges (u < v, sim), nodes (node), chains (chain_id, idx, contig).

Loops run on the driver; what they look at there are counts. Each round is written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.checkpoints import persisted
from linkloom.plans.shipping import ship

#: Components with at most this many edges are treated whole, each inside a task; there an edge takes some 100 bytes.
SMALL_COMPONENT = 10_000_000


def similarity_graph(pairs: DataFrame, threshold: float) -> DataFrame:
    """Edges u < v of similarity at least threshold, repeated pairs once, by their greatest similarity."""
    kept = pairs.where((F.col("sim") >= threshold) & (F.col("u") != F.col("v")))
    return kept.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("sim").alias("sim"))


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other for every direction of every edge."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(edges.select("v", "u"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def junctions(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("degree > 2").select("node")


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("u")), "u", "left_anti").join(nodes.select(F.col("node").alias("v")), "v", "left_anti")


def induced(edges: DataFrame, nodes: DataFrame, source: str = "u", target: str = "v") -> DataFrame:
    """Edges with both ends among nodes."""
    for end in (source, target):
        edges = edges.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return edges


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node of it). Large-star and small-star rounds; a node's neighbours are aggregated, never gathered."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        near = now.unionAll(now.select("v", "u"))
        lowest = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = near.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(lowest, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = persisted(moved.unionAll(lowest.select("u", F.col("low").alias("v"))).distinct(), "stars")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark


def _boruvka(edges: DataFrame) -> DataFrame:
    """The maximum spanning forest: each round every tree takes its best edge in the total order (sim falling, u, v)."""
    left = persisted(edges.select("u", "v", "sim", F.col("u").alias("cu"), F.col("v").alias("cv")), "forest-edges")
    forest = None
    while left.take(1):
        order = F.struct((-F.col("sim")).alias("cost"), "u", "v")
        ends = left.select(F.col("cu").alias("c"), order.alias("e"), "cv").unionAll(left.select("cv", order.alias("e"), "cu"))
        best = ends.groupBy("c").agg(F.min_by(F.struct("e", F.col("cv").alias("other")), "e").alias("b"))
        best = persisted(best.select("c", "b.other", F.col("b.e.u").alias("u"), F.col("b.e.v").alias("v"), (-F.col("b.e.cost")).alias("sim")), "forest-best")
        chosen = best.select("u", "v", "sim").distinct()
        forest = chosen if forest is None else forest.unionAll(chosen)
        merged = components(best.select(F.col("c").alias("u"), F.col("other").alias("v")))
        of = lambda c: merged.select(F.col("node").alias(c), F.col("component").alias(f"n{c}"))
        left = left.join(of("cu"), "cu").join(of("cv"), "cv").where("ncu <> ncv")
        left = persisted(left.select("u", "v", "sim", F.col("ncu").alias("cu"), F.col("ncv").alias("cv")), "forest-edges")
    return forest if forest is not None else edges.select("u", "v", "sim")


def kruskal(rows: list[tuple], ) -> list[tuple]:
    """Edges (u, v, sim) of the maximum spanning forest, in the order (sim falling, u, v)."""
    above: dict = {}

    def root(x):  # noqa: ANN001, ANN202
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    kept = []
    for u, v, sim in sorted(rows, key=lambda e: (-e[2], e[0], e[1])):
        a, b = root(u), root(v)
        if a != b:
            above[a] = b
            kept.append((u, v, sim))
    return kept


def _sized(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Edges with their component and its number of edges; whether any component is large."""
    of = components(edges)
    placed = edges.join(of, F.col("u") == F.col("node")).drop("node")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n_edges"))
    placed = persisted(placed.join(sizes, "component"), "sized")
    return placed, bool(placed.where(F.col("n_edges") > SMALL_COMPONENT).take(1))


def spanning_forest(edges: DataFrame, small: int | None = None) -> DataFrame:
    """u, v, sim of the maximum spanning forest: small components each inside a task, large ones by rounds over all edges."""
    small = SMALL_COMPONENT if small is None else small
    placed = persisted(edges.select("u", "v", "sim"), "forest-in")
    if small < 1:
        return _boruvka(placed)
    placed, _ = _sized(placed)

    def solve(of_component: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("u", "v", "sim"), strongest(*(of_component[c].to_numpy() for c in ("u", "v", "sim"))), strict=True)))

    ship(edges.sparkSession)
    forest = placed.where(F.col("n_edges") <= small).groupBy("component").applyInPandas(solve, edges.select("u", "v", "sim").schema)
    large = placed.where(F.col("n_edges") > small)
    return forest.unionAll(_boruvka(large)) if large.take(1) else forest


def tips(edges: DataFrame, most: int = 2) -> DataFrame:
    """Nodes of tips: a leaf and what follows it through nodes of degree 2, fewer than `most` nodes, up to a node of degree 3 or more."""
    near = both_ways(edges)
    degree = degrees(edges)
    at = near.join(degree.where("degree = 1").select("node"), "node").select(F.array("node").alias("tip"), F.col("node").alias("last"), "other")
    found = None
    for _ in range(most - 1):
        at = at.join(degree.select(F.col("node").alias("other"), "degree"), "other")
        ended = at.where("degree > 2").select(F.explode("tip").alias("node"))
        found = ended if found is None else found.unionAll(ended)
        step = near.select(F.col("node").alias("other"), F.col("other").alias("next"))
        at = at.where("degree = 2").join(step, "other").where(F.col("next") != F.col("last"))
        at = at.select(F.concat("tip", F.array("other")).alias("tip"), F.col("other").alias("last"), F.col("next").alias("other"))
    return found.distinct()


def remove_tips(edges: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Removes all tips at once, and again until there are none: the edges left, and node, round of what went."""
    left, gone, turn = persisted(edges, "tips-edges"), None, 0
    while True:
        found = persisted(tips(left, most), "tips")
        if not found.take(1):
            return left, gone if gone is not None else found.withColumn("round", F.lit(0))
        turn += 1
        marked = found.withColumn("round", F.lit(turn))
        gone = marked if gone is None else gone.unionAll(marked)
        left = persisted(without_nodes(left, found), "tips-edges")


def _linear(edges: list[tuple]) -> list[list]:
    """Paths of a graph without junctions, each from its smaller end; single nodes are none."""
    near: dict = {}
    for u, v in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    chains, seen = [], set()
    for start in sorted(n for n, x in near.items() if len(x) == 1):
        if start in seen:
            continue
        chain, last, now = [], None, start
        while now is not None:
            chain.append(now)
            seen.add(now)
            last, now = now, next((x for x in near[now] if x != last), None)
        chains.append(chain)
    return chains


def _joined(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the forest's edges (a, b), the first ones the best, that join what label (a root for each node) holds apart; new labels."""
    chosen, at, here = [], np.arange(len(a)), np.arange(len(label))
    while True:
        la, lb = label[a[at]], label[b[at]]
        apart = la != lb
        at, la, lb = at[apart], la[apart], lb[apart]
        if not len(at):
            return np.unique(np.concatenate([np.empty(0, np.int64), *chosen])), label
        # Every tree takes its best edge: of repeated writes the last, hence from the worst edge on.
        best, other, falling = np.full(len(label), len(at)), np.full(len(label), len(at)), np.arange(len(at))[::-1]
        best[la[::-1]], other[lb[::-1]] = falling, falling
        best = np.minimum(best, other)
        trees = np.flatnonzero(best < len(at))
        taken = best[trees]
        chosen.append(at[taken])
        up = here.copy()
        up[trees] = la[taken] + lb[taken] - trees
        mutual = (up[up] == here) & (here < up)
        up[mutual] = here[mutual]
        while not np.array_equal(further := up[up], up):
            up = further
        label = up[label]


def strongest(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of the maximum spanning forest, in the order (sim falling, u, v)."""
    order = np.lexsort((v, u, -sim))
    u, v, sim = u[order], v[order], sim[order]
    names = np.union1d(u, v)
    chosen = _joined(np.searchsorted(names, u), np.searchsorted(names, v), np.arange(len(names)))[0]
    return u[chosen], v[chosen], sim[chosen]


def _trimmed(a: np.ndarray, b: np.ndarray, tree: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is left of the tree (indices of edges a, b) without all its tips, which of n nodes were tips, and the degrees left."""
    tip = np.zeros(n, bool)
    while True:
        degree = np.bincount(np.concatenate([a[tree], b[tree]]), minlength=n)
        found = np.zeros(n, bool)
        for x, y in ((a[tree], b[tree]), (b[tree], a[tree])):
            found[x[(degree[x] == 1) & (degree[y] > 2)]] = True
        if not found.any():
            return tree, tip, degree
        tip |= found
        tree = tree[~found[a[tree]] & ~found[b[tree]]]


def screen_component(u: np.ndarray, v: np.ndarray, sim: np.ndarray, delete_share: float, rounds: int) -> tuple[list[list], list, list]:
    """Chains, masked nodes and the last round's tips of one component (edges u, v, sim).

    A round: spanning tree of the base graph, of more than 3 nodes all tips removed, then junctions found and deleted
    from the base graph. It ends after a round on fewer than 4 nodes, without junctions, after `rounds`, or once the share of
    nodes left is at most delete_share. What a junction's deletion leaves of the tree stays in the next round's tree."""
    order = np.lexsort((v, u, -sim))
    names = np.union1d(u, v)
    a, b = (np.searchsorted(names, x).astype(np.int32)[order] for x in (u, v))
    del order
    first = size = len(names)
    whole, masked, turn = np.empty(0, np.int64), np.zeros(first, bool), 0
    while True:
        turn += 1
        _, label = _joined(a[whole], b[whole], np.arange(first))
        open_ = np.flatnonzero(~masked[a] & ~masked[b] & (label[a] != label[b]))
        whole = np.sort(np.concatenate([whole, open_[_joined(a[open_], b[open_], label)[0]]]))
        tree, tip, cut, before = whole, np.zeros(first, bool), np.zeros(first, bool), size
        if size > 3:
            tree, tip, degree = _trimmed(a, b, tree, first)
            cut = degree > 2
            masked |= cut
            whole = whole[~cut[a[whole]] & ~cut[b[whole]]]
            size -= int(cut.sum())
        if before < 4 or turn >= rounds or size <= 0 or size / first <= delete_share or not cut.any():
            tree = tree[~cut[a[tree]] & ~cut[b[tree]]]
            return _linear(list(zip(names[a[tree]].tolist(), names[b[tree]].tolist(), strict=True))), names[masked].tolist(), names[tip].tolist()


def order_contigs(edges: DataFrame, delete_share: float = 0.9, rounds: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chains (chain_id, idx, contig), masked junctions (contig) and tips of last rounds (contig).

    Components of at most SMALL_COMPONENT edges are screened each inside a task; larger ones by spanning_forest(),
    remove_tips() and junctions() over all of them at once. Chains are numbered by their least contig."""
    placed, any_large = _sized(persisted(edges.select("u", "v", "sim"), "order-in"))
    schema = "kind string, chain long, idx int, contig long"

    def work(of_component: pd.DataFrame) -> pd.DataFrame:
        chains, masked, tip_nodes = screen_component(*[of_component[c].to_numpy() for c in ("u", "v", "sim")], delete_share, rounds)
        out = [("chain", min(c), i, x) for c in chains for i, x in enumerate(c)]
        out += [(k, 0, 0, x) for k, found in (("masked", masked), ("tip", tip_nodes)) for x in found]
        return pd.DataFrame(out, columns=["kind", "chain", "idx", "contig"])

    ship(edges.sparkSession)
    found = placed.where(F.col("n_edges") <= SMALL_COMPONENT).groupBy("component").applyInPandas(work, schema)
    if any_large:
        found = found.unionAll(_order_large(placed.where(F.col("n_edges") > SMALL_COMPONENT), delete_share, rounds))
    return _ordered(persisted(found, "order"))


def _round(delete_share: float, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One round on a component's edges (component, u, v, sim, nodes at first, nodes now): chains and tips if it is the last one, junctions, else that it stays open."""

    def work(of_component: pd.DataFrame) -> pd.DataFrame:
        u, v, _ = strongest(*(of_component[c].to_numpy() for c in ("u", "v", "sim")))
        component, first, size = (int(of_component[c].iloc[0]) for c in ("component", "first", "size"))
        names = np.union1d(u, v)
        a, b = np.searchsorted(names, u), np.searchsorted(names, v)
        tree, tip, cut = np.arange(len(a)), np.zeros(len(names), bool), np.zeros(len(names), bool)
        if size > 3:
            tree, tip, degree = _trimmed(a, b, tree, len(names))
            cut = degree > 2
        after = size - int(cut.sum())
        out = [("masked", 0, 0, x) for x in names[cut].tolist()]
        if size < 4 or last or after <= 0 or after / first <= delete_share or not cut.any():
            tree = tree[~cut[a[tree]] & ~cut[b[tree]]]
            lines = _linear(list(zip(names[a[tree]].tolist(), names[b[tree]].tolist(), strict=True)))
            out += [("chain", min(c), i, x) for c in lines for i, x in enumerate(c)] + [("tip", 0, 0, x) for x in names[tip].tolist()]
        else:
            out.append(("open", component, 0, 0))
        return pd.DataFrame(out, columns=["kind", "chain", "idx", "contig"])

    return work


def order_by_forests(forest_of: Callable[[DataFrame | None], DataFrame], delete_share: float = 0.9, rounds: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As order_contigs(), of edges that are never all written: forest_of(gone) is some of those without the nodes (node) gone, and among them
    all of their maximum spanning forest. If it has it, forest_of.among(left) is asked instead from the second round on: left are the nodes of
    components that are open, so all that never had an edge is passed by.

    A round asks for that once; what it gets of a component is treated inside a task."""
    out = gone = of = None
    left, among = None, getattr(forest_of, "among", None)
    turn, schema = 0, "kind string, chain long, idx int, contig long"
    while True:
        turn += 1
        edges = persisted((among(left) if among and turn > 1 else forest_of(gone)).select("u", "v", "sim"), "order-in")
        if of is None:
            of = persisted(components(edges), "order-of")
            first = of.groupBy("component").agg(F.count("*").alias("first"))
        rest = of if gone is None else of.join(gone, "node", "left_anti")
        sizes = first.join(rest.groupBy("component").agg(F.count("*").alias("size")), "component")
        placed = edges.join(of, F.col("u") == F.col("node")).drop("node").join(sizes, "component")
        ship(edges.sparkSession)
        found = persisted(placed.groupBy("component").applyInPandas(_round(delete_share, turn >= rounds), schema), "order")
        out = found if out is None else out.unionAll(found)
        still = found.where("kind = 'open'").select(F.col("chain").alias("component"))
        if not still.take(1):
            return _ordered(out)
        ended = of.join(still, "component", "left_anti").select("node")
        gone = persisted(ended.unionAll(out.where("kind = 'masked'").select("contig")).distinct(), "order-gone")
        left = persisted(of.select("node").join(gone, "node", "left_anti").distinct(), "order-left")


def _ordered(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    numbered = found.where("kind = 'chain'").select("chain").distinct().orderBy("chain")
    number = numbered.select("chain", F.row_number().over(_by("chain")).cast("long").alias("chain_id"))
    chains = found.where("kind = 'chain'").join(number, "chain").select("chain_id", "idx", "contig")
    return chains, found.where("kind = 'masked'").select("contig").distinct(), found.where("kind = 'tip'").select("contig").distinct()


def _by(*columns: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def _order_large(placed: DataFrame, delete_share: float, rounds: int) -> DataFrame:
    """The screening rounds for large components, all at once."""
    base = persisted(placed.select("component", "u", "v", "sim"), "large-base")
    nodes = persisted(both_ways(base).select("node").distinct().join(both_ways(base.select("u", "v")).select("node").distinct(), "node").join(base.select(F.col("u").alias("node"), "component").unionAll(base.select("v", "component")).distinct(), "node"), "large-nodes")
    first = nodes.groupBy("component").agg(F.count("*").alias("first"))
    out, turn = None, 0
    add = lambda out, df: df if out is None else out.unionAll(df)
    while nodes.take(1):
        turn += 1
        tree = spanning_forest(base, small=0)
        cut_tree, tip_nodes = remove_tips(tree.select("u", "v"))
        cut = persisted(junctions(cut_tree).join(nodes, "node"), "large-cut")
        state = nodes.groupBy("component").agg(F.count("*").alias("size")).join(cut.groupBy("component").agg(F.count("*").alias("cut")), "component", "left").na.fill(0, ["cut"]).join(first, "component")
        done = (F.col("size") < 4) | (F.col("cut") == 0) | F.lit(turn >= rounds) | ((F.col("size") - F.col("cut")) / F.col("first") <= delete_share)
        ended = persisted(state.where(done).select("component"), "large-done")
        in_ended = nodes.join(ended, "component", "left_semi").select("node")
        lines = chain_ranks(without_nodes(induced(cut_tree, in_ended), cut))
        out = add(out, lines.select(F.lit("chain").alias("kind"), F.col("chain"), F.col("idx").cast("int").alias("idx"), F.col("contig")))
        out = add(out, cut.select(F.lit("masked"), F.lit(0).cast("long"), F.lit(0), F.col("node")))
        out = add(out, tip_nodes.select("node").join(in_ended, "node", "left_semi").select(F.lit("tip"), F.lit(0).cast("long"), F.lit(0), F.col("node")))
        base = persisted(without_nodes(base, cut).join(ended, "component", "left_anti"), "large-base")
        nodes = persisted(nodes.join(cut.select("node"), "node", "left_anti").join(ended, "component", "left_anti"), "large-nodes")
    return persisted(out, "large-out")


def chain_ranks(edges: DataFrame) -> DataFrame:
    """chain (least node), idx (from 0, counted from the smaller end), contig of paths, by pointer doubling: rounds grow with the logarithm of the longest path.

    Edges must form paths. A half edge a -> b points to the half edge that goes on from b; its jumps add up to the way to the path's end."""
    both = both_ways(edges).select(F.col("node").alias("a"), F.col("other").alias("b"))
    on = both.select(F.col("a").alias("b"), F.col("b").alias("c"))
    now = both.join(on, "b", "left").groupBy("a", "b").agg(F.max(F.when(F.col("c") != F.col("a"), F.col("c"))).alias("c"))
    now = persisted(now.select("a", "b", F.when(F.col("c").isNotNull(), F.col("b")).alias("pa"), F.col("c").alias("pb"), F.lit(1).cast("long").alias("d"), F.col("b").alias("end")), "ranks")
    while now.where("pa IS NOT NULL").take(1):
        ahead = now.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("d").alias("e"), F.col("end").alias("far"))
        now = persisted(now.join(ahead, ["pa", "pb"], "left").select("a", "b", F.col("qa").alias("pa"), F.col("qb").alias("pb"), (F.col("d") + F.coalesce("e", F.lit(0))).alias("d"), F.coalesce("far", "end").alias("end")), "ranks")
    # The end that a node sees on each side; the smaller end is the start, so a node's place is its way there.
    ways = now.select(F.col("a").alias("contig"), "end", "d")
    starts = both.groupBy("a").agg(F.count("*").alias("n")).where("n = 1").select(F.col("a").alias("contig"), F.col("a").alias("end"), F.lit(0).cast("long").alias("d"))
    place = ways.unionAll(starts).groupBy("contig").agg(F.min_by("d", "end").alias("idx"), F.min("end").alias("start"))
    least = place.groupBy("start").agg(F.min("contig").alias("chain"))
    return place.join(least, "start").select("chain", "idx", "contig")
