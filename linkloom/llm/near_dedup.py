"""MinHash near-duplicate detection by an inverted join on signature coordinates.

1. Every whole text becomes the set of its distinct word shingles, a fingerprint of that set and a signature. Equal sets
   are one node from here on, however many copies there are: sets are taken as equal if their sizes and two 64-bit prints,
   a sum and a mixed exclusive or of all members, are.
2. Nodes are posted under their (coordinate, value) pairs. A pair that no other node has can't collide and is skipped; a node
   with fewer than `matches` pairs left can't collide often enough with anyone and is skipped as a whole, so what any number
   of unlike documents share in a passage makes no postings. Two signatures that agree on at least `matches` coordinates must
   share one of the rarest pairs of each, its prefix, so only prefixes are joined.
3. In every list of postings the node with the most common values is the centre; each node's collisions with the centres of
   its lists are counted, links are confirmed on the full sets, and components are formed. No list is expanded into all its pairs.
4. What may be missing are links between nodes of a list that are still in different components. Their collisions are counted in
   blocks inside tasks, a pair only where it first meets, and pairs over the threshold of all coordinates are confirmed on the
   full sets; in blocks that are dense in such pairs, inside tasks too, so that pairs stay in proportion to the postings. Then
   components are formed again. A node of a list of L nodes in different components is dealt to L / BLOCK blocks: that is work
   in proportion to the square of L, which only sets that agree on over half of their signatures, and yet are not linked, cause.

Lists and centres of many rows are salted: postings of a key with more than HOT rows are dealt by key and node, and a text that
is compared with many others is sent once for every CHECKS of them.

A link of similarity 0.85 is missed where its signatures agree on fewer than 36 of 60 or 84 of 128 coordinates: a chance of
less than 1e-6. Everything else that is reported is confirmed on whole sets.

Defined results: null and empty texts have no shingles and no links; fewer words than a shingle make one shingle; repeated
rows and rows that share a doc_id are one node each where their sets are equal; a null doc_id has a null component and is
kept; an empty table gives no rows; texts of any length are read whole, hashed together with others up to _BYTES_AT_ONCE bytes;
columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from linkloom.llm.common import in_arrow, lower_bytes, mixed, shingles, sliced, word_hashes, written

#: Posted coordinates are bits of a positive long.
COORDINATES, POSTED = 128, 60
POSTED_MATCHES, ALL_MATCHES = 36, 84
SHINGLE = 5
NUMERATOR, DENOMINATOR = 85, 100
BLOCK = 500
PAIRS_PER_ROW = 2
#: Rows of a key, and comparisons with a text, that may come to one task unsplit.
HOT, CHECKS = 2_000, 500
_WORDS_AT_ONCE = 400_000
_BYTES_AT_ONCE = 1 << 20
_ONE = np.dtype([("posted", "<u4", POSTED), ("more", "<u2", COORDINATES - POSTED)])


def _functions(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, COORDINATES, dtype=np.uint64).astype(np.uint32), rng.integers(0, 2**31, COORDINATES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(members: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every run of members (64-bit hashes) that begins at starts, the least value of each hash function."""
    flip, factor = _functions()
    x = (members >> np.uint64(32)).astype(np.uint32)
    out = np.empty(len(starts), dtype=_ONE)
    for k in range(COORDINATES):
        least = np.minimum.reduceat((x ^ flip[k]) * factor[k], starts)
        if k < POSTED:
            out["posted"][:, k] = least
        else:
            out["more"][:, k - POSTED] = least >> np.uint32(16)
    return out


def _sets(texts: list[str | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sorted distinct shingle hashes) of every text with words; texts are hashed together up to a number of bytes."""
    factors = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(5).integers(0, 2**62, size)]
    run: list[tuple[int, bytes]] = []

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        flat, starts = word_hashes(b"\n".join(data for _, data in run))
        n = len(flat) - size + 1
        if n > 0:
            acc = flat[:n] * factors[0]
            for i in range(1, size):
                acc += flat[i : i + n] * factors[i]
            acc = mixed(acc)
        ends = np.searchsorted(starts, np.cumsum([len(data) + 1 for _, data in run]))
        at = 0
        for (place, _), end in zip(run, ends.tolist(), strict=True):
            if end - at >= size:
                part = np.sort(acc[at : end - size + 1])
                keep = np.empty(len(part), dtype=bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                yield place, part[keep]
            elif end > at:
                yield place, shingles(flat[at:end], size)
            at = end
        run.clear()

    held = 0
    for place, text in enumerate(texts):
        if text:
            data = lower_bytes(text)
            if run and held + len(data) > _BYTES_AT_ONCE:
                yield from flush()
                held = 0
            run.append((place, data))
            held += len(data)
    if run:
        yield from flush()


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string")).alias("text_hash")


def shingle_table(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, print1, print2 (of the set), posted (array<int>), sig (binary) for every document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            n, print1, print2 = (np.zeros(len(texts), dtype=t) for t in (np.int64, np.uint64, np.uint64))
            sig: list[bytes | None] = [None] * len(texts)
            posted: list[np.ndarray | None] = [None] * len(texts)
            places, parts, held = [], [], 0

            def flush() -> None:
                if not places:
                    return
                flat = np.concatenate(parts)
                starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
                all_sig = signatures(flat, starts)
                print1[places] = np.add.reduceat(flat, starts)
                print2[places] = np.bitwise_xor.reduceat(mixed(flat + np.uint64(0x632BE59BD9B4E019)), starts)
                n[places] = [len(p) for p in parts]
                for place, one in zip(places, all_sig, strict=True):
                    sig[place], posted[place] = one.tobytes(), one["posted"].view(np.int32)
                places.clear()
                parts.clear()

            for place, members in _sets(texts, size):
                places.append(place)
                parts.append(members)
                held += len(members)
                if held > _WORDS_AT_ONCE:
                    flush()
                    held = 0
            flush()
            columns = [batch.column(0), batch.column(2), pa.array(n), pa.array(print1.view(np.int64)), pa.array(print2.view(np.int64)), pa.array(posted, pa.list_(pa.int32())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "print1", "print2", "posted", "sig"])

    schema = "doc_id long, text_hash long, n_shingles long, print1 long, print2 long, posted array<int>, sig binary"
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash(F.col("text"))), work, schema)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["posted"] == b["posted"]).sum(axis=-1) + (a["more"] == b["more"]).sum(axis=-1)


@F.pandas_udf(IntegerType())
def _matches(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s.tolist()), dtype=_ONE) for s in (a, b))
    return pd.Series(_agree(x, y).astype(np.int32))


def near_sizes(a: str, b: str) -> Column:
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def postings(nodes: DataFrame) -> DataFrame:
    """key, coordinate, node, n, sig, mask, weight: every node under its rarest keys that others have too. nodes: node, n, posted, sig."""
    keys = nodes.select("node", F.posexplode("posted").alias("coordinate", "value"))
    key = F.shiftleft(F.col("coordinate").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    keys = keys.select("node", "coordinate", key.alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    of_node = Window.partitionBy("node")
    ranked = keys.join(shared, "key").withColumns({"place": F.row_number().over(of_node.orderBy("df", "key")), "common": F.count("*").over(of_node), "weight": F.sum("df").over(of_node)})
    prefix = POSTED - POSTED_MATCHES + 1
    chosen = ranked.where(F.col("place") <= prefix - (POSTED - F.col("common")))
    bit = F.expr("shiftleft(1L, coordinate)")
    chosen = chosen.withColumn("mask", F.sum(bit).over(of_node)).select("key", "coordinate", "node", "mask", "weight")
    return chosen.join(nodes.select("node", "n", "sig"), "node")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents in ids (node)."""
    needed = written(ids.select(F.col("node").alias("doc_id")).distinct(), "dedup-needed")
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(needed, "doc_id", "left_semi"), "dedup-texts")


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A text a comes once for every CHECKS of its pairs, before these."""
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHECKS).cast("int").alias("salts"))
    text = texts.select("doc_id", "text")
    first = heads.join(text, F.col("a") == F.col("doc_id")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("b"), "text")
    many = heads.where("salts > 1").withColumnRenamed("a", "many")
    rest = pairs.join(text, F.col("b") == F.col("doc_id")).join(many, F.col("a") == F.col("many"), "left")
    rest = rest.select("a", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(1).alias("kind"), "b", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        head, head_set = None, none
        for batch in sliced(batches):
            a, kind, b = (batch.column(i).to_pylist() for i in (0, 2, 3))
            sets = dict(_sets(batch.column(4).to_pylist(), size))
            keep = []
            for i in range(len(a)):
                if not kind[i]:
                    head, head_set = a[i], sets.get(i, none)
                elif a[i] == head and _alike(head_set, sets.get(i, none)):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    dealt = first.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return in_arrow(dealt, check, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least reachable node) for every node with a link: alternating large and small stars until nothing moves.

    A node's neighbours are only ever aggregated and joined, so a node of any degree is spread over tasks."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(floor.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "dedup-stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """Complete groups of rows with equal values in the first `by` columns; rows come sorted."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        held = now if held is None else [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
        change = np.zeros(len(held[0]) - 1, dtype=bool)
        for x in held[:by]:
            change |= x[1:] != x[:-1]
        ends = np.flatnonzero(change) + 1
        for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True) if len(ends) else ():
            yield [x[lo:hi] for x in held]
        if len(ends):
            held = [x[ends[-1] :] for x in held]
    if held is not None:
        yield held


def salted(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings with a salt, and key, salts of keys with more than HOT of them."""
    hot = posts.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts")).where("salts > 1")
    hot = written(hot, "dedup-hot")  # at most a row for every HOT postings
    with_salt = posts.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return with_salt, hot


def for_salts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of one for each key, once for every salt of the key."""
    return rows.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def rest_candidates(posts: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """Candidates of different components that share a list, found in blocks of bounded size.

    A row has node and other, or, where a block holds more than PAIRS_PER_ROW pairs a row, other is null and the row is a
    member of that block: its pairs are confirmed inside a task. So rows stay in proportion to postings. posts, hot: of salted()."""
    marked = posts.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_component = marked.groupBy("key", "component").agg(F.count("*").alias("c"))
    lists = by_component.groupBy("key").agg(F.count("*").alias("components"), F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("largest")).where("components > 1")
    lists = lists.select("key", F.col("largest.component").alias("main"), F.ceil(F.col("largest.c") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("largest.c")) / BLOCK).cast("int").alias("rests"))
    rows = marked.join(for_salts(lists, hot), ["key", "salt"])
    is_main = F.col("component") == F.col("main")
    block = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    rows = rows.withColumn("block", block)
    part = lambda kind, i, j, side: F.struct(kind.cast("int").alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    whole = F.array(part(F.lit(2), F.lit(0), F.lit(0), F.lit(-1)))
    of_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: part(F.lit(0), F.col("block"), r, F.lit(0)))
    of_rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: part(F.lit(0), m, F.col("block"), F.lit(1))),
        F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: part(F.lit(1), F.least(r, F.col("block")), F.greatest(r, F.col("block")), F.when(r == F.col("block"), F.lit(-1)).when(r < F.col("block"), F.lit(1)).otherwise(F.lit(0)))),
    )
    # A rest block meets itself with side -1 and each other block with sides 0 and 1.
    dealt = rows.withColumn("part", F.explode(F.when((F.col("mains") == 1) & (F.col("rests") == 1), whole).when(is_main, of_main).otherwise(of_rest)))
    dealt = dealt.select("key", "part.kind", "part.i", "part.j", "part.side", "coordinate", "node", "component", "n", "mask", "sig")

    by, names = ["key", "kind", "i", "j"], [*dealt.columns, "other"]
    spread = dealt.repartition(*by).sortWithinPartitions(*by)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, len(by)):
            if len(group[0]) < 2:
                continue
            pairs = [(x, y) for x, near in _candidates(group) for y in near]
            if not pairs:
                continue
            dense = len(pairs) > PAIRS_PER_ROW * len(group[0])
            rows = np.unique(np.array(pairs).ravel()) if dense else np.array([x for x, _ in pairs])
            other = np.array([y for _, y in pairs])
            columns = [pa.array(c[rows]) for c in group]
            columns.append(pa.nulls(len(rows), pa.int64()) if dense else pa.array(group[_NODE][other]))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _TYPES, strict=True)], names)

    return in_arrow(spread, compare, ", ".join(f"{n} {t.simpleString()}" for n, t in ((f.name, f.dataType) for f in dealt.schema)) + ", other long")


_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
_SIDE, _COORDINATE, _NODE, _COMPONENT, _N, _MASK, _SIG = range(4, 11)


def _candidates(group: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows that may be linked with it): of another component, near in size and signature, and first met in this list."""
    side, component, n, mask = group[_SIDE], group[_COMPONENT], group[_N], group[_MASK]
    s = np.frombuffer(b"".join(group[_SIG].tolist()), dtype=_ONE)
    here = np.int64(1) << np.int64(group[_COORDINATE][0])
    bits = np.int64(1) << np.arange(POSTED, dtype=np.int64)
    for x in range(len(side) - 1):
        y = np.arange(x + 1, len(side))
        ok = (component[y] != component[x]) & (DENOMINATOR * np.minimum(n[y], n[x]) >= NUMERATOR * np.maximum(n[y], n[x]))
        if side[x] >= 0:
            ok &= side[y] != side[x]
        y = y[ok]
        if len(y):
            y = y[_agree(s[y], s[x]) >= ALL_MATCHES]
            common = ((s["posted"][y] == s["posted"][x]) @ bits) & mask[y] & mask[x]
            y = y[(common & -common) == here]
            if len(y):
                yield x, y


def linked_inside(members: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Links (a, b) within lists, or pairs of their blocks, that are dense in candidates: confirmed where they are found, one for each join of components."""
    by = ["key", "kind", "i", "j"]
    names = [*by, "side", "coordinate", "node", "component", "n", "mask", "sig"]
    rows = members.join(texts, F.col("node") == F.col("doc_id")).select(*names, "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)

        def with_sets() -> Iterator[pa.RecordBatch]:
            """Texts give way to their sets, in batches."""
            for batch in batches:
                found = dict(_sets(batch.column(len(names)).to_pylist(), size))
                sets = pa.array([found.get(i, none).tobytes() for i in range(batch.num_rows)], pa.large_binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], sets], [*names, "set"])

        for group in _groups(with_sets(), len(by)):
            node, component = group[_NODE], group[_COMPONENT]
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group[len(names)]]
            above: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := above.get(c, c)) != c:
                    above[c] = above.get(up, up)
                    c = up
                return c

            a, b = [], []
            for x, near in _candidates(group) if len(node) > 1 else ():
                for y in near:
                    p, q = root(int(component[x])), root(int(component[y]))
                    if p != q and _alike(sets[x], sets[y]):
                        above[max(p, q)] = min(p, q)
                        a.append(int(min(node[x], node[y])))
                        b.append(int(max(node[x], node[y])))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return in_arrow(rows.repartition(*by).sortWithinPartitions(*by), check, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every document."""
    sets = written(shingle_table(docs), "dedup-sets")
    nodes = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("print1", "print2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("posted").alias("posted"), F.first("sig").alias("sig"))
    nodes = written(nodes.withColumnRenamed("n_shingles", "n"), "dedup-nodes")
    posts = written(postings(nodes.select("node", "n", "posted", "sig")), "dedup-posts")
    posts, hot = salted(posts)
    centres = posts.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("order"), "n", "sig")).alias("c"))
    centres = centres.select("key", (-F.col("c.order")).alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.sig").alias("centre_sig"))
    near = posts.join(for_salts(centres, hot), ["key", "salt"]).where((F.col("node") != F.col("centre")) & near_sizes("n", "centre_n"))
    near = near.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), "sig", "centre_sig").dropDuplicates(["a", "b"])
    near = written(near.where(_matches("sig", "centre_sig") >= ALL_MATCHES).select("a", "b"), "dedup-star")
    star = written(confirmed(near, texts_of(docs, near.select(F.explode(F.array("a", "b")).alias("node")))), "dedup-links")
    labels = written(components(star), "dedup-labels")
    rest = written(rest_candidates(posts, labels, hot), "dedup-rest")
    texts = texts_of(docs, rest.select("node").union(rest.select("other")).where("node IS NOT NULL"))
    pairs = rest.where("other IS NOT NULL").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = written(confirmed(pairs, texts).union(linked_inside(rest.where("other IS NULL"), texts)), "dedup-links")
    final = written(components(star.union(links)), "dedup-components") if links.take(1) else labels
    own = nodes.select(F.col("print1").alias("p1"), F.col("print2").alias("p2"), F.col("n").alias("pn"), "node").join(final, "node", "left").select("p1", "p2", "pn", F.coalesce("component", "node").alias("component"))
    match = (sets["print1"] == own["p1"]) & (sets["print2"] == own["p2"]) & (sets["n_shingles"] == own["pn"]) & sets["doc_id"].isNotNull()
    found = sets.select("doc_id", "n_shingles", "print1", "print2", "text_hash").join(own, match, "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def op6_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


OP6_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM steps UNION SELECT r.x, s.y FROM reach r JOIN steps s ON s.x = r.y),
lowest AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN lowest l ON l.x = d.doc_id
"""
