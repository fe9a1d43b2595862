"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is posted in TABLES tables under the cell of a Gaussian projection whose directions are made orthogonal within
a table, and whose number grows with the logarithm of the rows, so cells stay small. A query visits cells in the order of
their estimated success, by how much farther a cell's middle is, squared, than its own cell's, up to a reach; what the
tables yield is merged and ranked by exact distance on the original vectors.

Width and reach are fitted by recall on the given table: for at most SAMPLE_QUERIES rows all true neighbours among all rows
are found, in blocks, and the reach is the least at which COVERAGE of these lie in visited cells; of several widths the one
is taken that reads fewest of SAMPLE sampled rows. What share that is, is kept in the index (`share`, `work`): on vectors as
isotropic as random ones it is large at any setting, on clustered ones small.

A table's rows are dealt to parts by their first coordinates, as many as it takes for parts of about PART_ROWS rows, so a
query goes only to parts that are within reach by these; a part that a hot cell makes larger is sliced, and queries go to
every slice. Tasks hold a slice's queries, stream its rows against them and keep k for each, so pairs are never rows of a plan.

Defined results: vectors that are null, zero, of another length than most of the sample, or hold null or non-finite
components take no part; rows that share a vec_id are no candidates of each other and appear once; a null vec_id takes
no part; fewer than k candidates found give fewer rows; an empty table gives none; columns besides id and vec are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from linkloom.llm.common import in_arrow, mixed, written

K = 10
TABLES = 3
#: Projections of a table for each doubling of the rows, and the least of them.
PER_DOUBLING, FEWEST = 1.5, 4
SAMPLE, SAMPLE_QUERIES = 4096, 200
COVERAGE = 0.97
#: Widths of cells that are tried, in standard deviations of a projection.
WIDTHS = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
PART_ROWS = 20_000
#: Queries whose cells a task weighs at once.
QUERY_BLOCK = 64


@dataclass
class Index:
    """Projections, offsets and width of all tables; reach in squared units of the projections; leading coordinates that name a part."""

    a: np.ndarray
    b: np.ndarray
    width: float
    reach: float
    leading: int
    share: float = 1.0
    work: float = 1.0

    @property
    def dims(self) -> int:
        return self.a.shape[1]

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        """Places in units of cells, rows x projections."""
        return x @ self.a[table] / self.width + self.b[table]

    def costs(self, place: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For places x cells, how much farther the cell's middle is, squared, than that of the place's own cell."""
        middle, own = cells + 0.5, np.square(np.floor(place) + 0.5 - place).sum(axis=1)
        squares = np.square(place).sum(axis=1)[:, None] + np.square(middle).sum(axis=1)[None] - 2 * place @ middle.T
        return np.maximum(0, squares - own[:, None]) * self.width**2


def projections(dims: int, rows: int) -> int:
    return min(dims, max(FEWEST, round(PER_DOUBLING * math.log2(max(2, rows)))))


def _frames(dims: int, count: int) -> np.ndarray:
    """For every table, `count` orthogonal directions of a Gaussian matrix, dims long in square, as Gaussian ones are on average."""
    rng = np.random.default_rng(3)
    return np.stack([np.linalg.qr(rng.normal(size=(dims, count)))[0] * math.sqrt(dims) for _ in range(TABLES)])


def fit(sample: np.ndarray, queries: np.ndarray, near: list[np.ndarray], rows: int, coverage: float = COVERAGE) -> Index:
    """near: for every query its true neighbours among all rows."""
    dims = sample.shape[1]
    a = _frames(dims, projections(dims, rows))
    b = np.random.default_rng(4).uniform(0, 1, (TABLES, a.shape[2]))
    spread = float((sample @ a[0]).std()) or 1.0
    best: Index | None = None
    for width in WIDTHS:
        index = Index(a, b, width * spread, 0.0, 0)
        first, costs = [], []
        for t in range(TABLES):
            place = index.places(queries, t)
            first.append(np.concatenate([index.costs(place[i : i + 1], np.floor(index.places(x, t)))[0] for i, x in enumerate(near)] or [np.empty(0)]))
            costs.append(index.costs(place, np.floor(index.places(sample, t))))
        needed = np.sort(np.min(first, axis=0))
        index.reach = float(needed[min(len(needed) - 1, int(coverage * len(needed)))]) if len(needed) else 0.0
        index.work = float(sum((c <= index.reach).mean() for c in costs))
        index.share = float((np.min(costs, axis=0) <= index.reach).mean())
        if best is None or index.work < best.work:
            best = index
    cells = np.floor(best.places(sample, 0)).astype(np.int64)
    while best.leading < cells.shape[1]:
        n = np.unique(cells[:, : best.leading], axis=0, return_counts=True)[1] if best.leading else np.array([len(cells)])
        if rows * float(np.square(n / len(cells)).sum()) <= PART_ROWS:
            break
        best.leading += 1
    return best


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _codes(cells: np.ndarray, table: int) -> np.ndarray:
    """The part of rows with these leading coordinates, of which there may be none."""
    factors = np.random.default_rng(17 + table).integers(1, 2**62, cells.shape[1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return mixed((cells.astype(np.int64).astype(np.uint64) * factors).sum(axis=-1, dtype=np.uint64) + np.uint64(table)).view(np.int64)


def _post(rows: DataFrame, index: Index) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), index.dims)
            for t in range(TABLES):
                codes = _codes(np.floor(index.places(x, t)[:, : index.leading]), t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(codes), *batch.columns], ["tab", "part", "id", "vec"])

    vec = rows.schema["vec"].dataType.simpleString()
    return in_arrow(rows, work, f"tab int, part long, id long, vec {vec}")


def _probe(queries: DataFrame, index: Index) -> DataFrame:
    """tab, part, id: the parts whose leading coordinates are within reach, in the order of their estimated success."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column(1), index.dims), batch.column(0).to_numpy(zero_copy_only=False)
            for t in range(TABLES):
                place = index.places(x, t)
                who, cost, cells = np.arange(len(x)), np.zeros(len(x)), np.empty((len(x), 0))
                for j in range(index.leading):
                    found, own = [], np.floor(place[who, j])
                    for way in (-1, 1):
                        step = 0 if way < 0 else 1
                        while True:
                            farther = np.square(own + way * step + 0.5 - place[who, j]) - np.square(own + 0.5 - place[who, j])
                            more = cost + np.maximum(0, farther) * index.width**2
                            keep = np.flatnonzero(more <= index.reach * (1 + 1e-9))
                            if not len(keep):
                                break
                            found.append((who[keep], more[keep], np.c_[cells[keep], (own + way * step)[keep]]))
                            step += 1
                    who, cost, cells = (np.concatenate([f[i] for f in found]) if found else np.empty((0, *z.shape[1:])).astype(z.dtype) for i, z in enumerate((who, cost, np.empty((0, j + 1)))))
                order = np.argsort(cost, kind="stable")
                codes = _codes(cells[order], t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), t, dtype=np.int32)), pa.array(codes), pa.array(ids[who[order]])], ["tab", "part", "id"])

    return in_arrow(queries, work, "tab int, part long, id long").distinct()


def _best(squares: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least by (square, id)."""
    if len(squares) > k:
        near = np.flatnonzero(squares <= np.partition(squares, k - 1)[k - 1])
        return near[np.lexsort((ids[near], squares[near]))[:k]]
    return np.lexsort((ids, squares))


class _Nearest:
    """Queries and the k nearest rows that each has met."""

    def __init__(self, k: int):
        self.k, self.ids, self.vectors, self.found = k, [], [], []

    def add(self, query: int, vector: np.ndarray) -> None:
        self.ids.append(query)
        self.vectors.append(vector)
        self.found.append((np.empty(0), np.empty(0, np.int64)))

    def meet(self, q: int, ids: np.ndarray, x: np.ndarray) -> None:
        squares = np.square(x - self.vectors[q]).sum(axis=1)
        squares[ids == self.ids[q]] = np.inf
        at = _best(squares, ids, self.k)
        at = at[np.isfinite(squares[at])]
        s, i = np.r_[self.found[q][0], squares[at]], np.r_[self.found[q][1], ids[at]]
        at = _best(s, i, self.k)
        self.found[q] = s[at], i[at]

    def batch(self) -> pa.RecordBatch:
        q = np.repeat(np.array(self.ids, dtype=np.int64), [len(s) for s, _ in self.found])
        s, i = (np.concatenate([f[n] for f in self.found]) if self.found else np.empty(0) for n in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i.astype(np.int64)), pa.array(np.sqrt(s.astype(np.float64)))], ["query_id", "vec_id", "score"])


def _visit(index: Index, table: int, nearest: _Nearest, places: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    """Rows of a part meet its queries cell by cell, in the order of the cells' costs, up to the reach, and on until there are k of them."""
    all_cells = np.floor(index.places(x, table))
    _, first, of_row, sizes = np.unique(_codes(all_cells, table), return_index=True, return_inverse=True, return_counts=True)
    cells, by_cell = all_cells[first], np.argsort(of_row, kind="stable")
    starts = np.r_[0, np.cumsum(sizes)]
    for lo in range(0, len(places), QUERY_BLOCK):
        for q, cost in enumerate(index.costs(places[lo : lo + QUERY_BLOCK], cells), lo):
            visited = np.flatnonzero(cost <= index.reach * (1 + 1e-9))
            visited = visited[np.argsort(cost[visited], kind="stable")]
            if sizes[visited].sum() <= nearest.k:  # beyond the reach, until there are k rows besides the query
                order = np.argsort(cost, kind="stable")
                visited = order[: int(np.searchsorted(np.cumsum(sizes[order]), nearest.k + 1)) + 1]
            n = sizes[visited]
            rows = by_cell[np.repeat(starts[visited] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            nearest.meet(q, ids[rows], x[rows])


def nearest_of(queries: np.ndarray, query_ids: np.ndarray, vectors: DataFrame, k: int, dims: int) -> list[np.ndarray]:
    """For a bounded block of queries, their k nearest among all rows: every partition keeps k for each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _Nearest(k)
        for q, v in zip(query_ids, queries, strict=True):
            nearest.add(int(q), v)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dims)
            for q in range(len(queries)):
                nearest.meet(q, ids, x)
        yield nearest.batch()

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = in_arrow(vectors, work, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = written(found, "ann-truth")
    rows = found.join(vectors, found["vec_id"] == vectors["id"]).select("query_id", "vec").collect()  # at most k for each query, but for repeated ids
    by_query: dict[int, list] = {}
    for r in rows:
        by_query.setdefault(r["query_id"], []).append(r["vec"])
    return [np.array(by_query.get(int(q), []), dtype=np.float64).reshape(-1, dims) for q in query_ids]


def build(vectors: DataFrame, k: int = K, coverage: float = COVERAGE) -> Index | None:
    """The index of clean vectors (id, vec), or none without rows."""
    rows = vectors.count()
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not drawn:
        return None
    dims = Counter(len(r["vec"]) for r in drawn).most_common(1)[0][0]
    drawn = [r for r in drawn if len(r["vec"]) == dims]
    sample = np.array([r["vec"] for r in drawn], dtype=np.float64)
    ids = np.array([r["id"] for r in drawn[:SAMPLE_QUERIES]], dtype=np.int64)
    near = nearest_of(sample[: len(ids)], ids, vectors.where(F.size("vec") == dims), k, dims)
    return fit(sample, sample[: len(ids)], near, rows, coverage)


def clean(df: DataFrame) -> DataFrame:
    """id, vec of the rows that take part."""
    kind = "array<float>" if df.schema["vec"].dataType == ArrayType(FloatType(), df.schema["vec"].dataType.containsNull) else "array<double>"
    return df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(kind).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found among vectors for every query. Both: id, vec."""
    spark = vectors.sparkSession
    vectors, queries = clean(vectors), clean(queries)
    index = build(vectors, k, coverage)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same, dims = F.size("vec") == index.dims, index.dims
    posted = _post(vectors.where(same), index)
    slices = written(posted.groupBy("tab", "part").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("slices")), "ann-slices")
    data = posted.join(slices, ["tab", "part"]).select("tab", "part", F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"), F.lit(1).alias("kind"), "id", "vec")
    wanted = written(_probe(queries.where(same), index).join(slices, ["tab", "part"]), "ann-probes")
    probes = wanted.select("tab", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), "id").join(queries.where(same), "id").select(*data.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nearest, places = None, _Nearest(k), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            ids, x = batch.column(4).to_numpy(zero_copy_only=False), _matrix(batch.column(5), dims)
            lo = 0
            for hi in np.r_[np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]:
                where = tuple(key[lo, :3])
                if where != now:
                    if now is not None:
                        yield nearest.batch()
                    now, nearest, places = where, _Nearest(k), None
                if key[lo, 3] == 0:
                    for i in range(lo, hi):
                        nearest.add(int(ids[i]), x[i])
                elif nearest.ids:
                    places = index.places(np.array(nearest.vectors), int(key[lo, 0])) if places is None else places
                    _visit(index, int(key[lo, 0]), nearest, places, ids[lo:hi], x[lo:hi])
                lo = hi
        yield nearest.batch()

    # By hash of part and slice; within a task, queries come before the rows they meet.
    by = ["tab", "part", "slice"]
    dealt = data.union(probes).repartition(*by).sortWithinPartitions(*by, "kind")
    found = in_arrow(dealt, work, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_multiprobe_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return search(vectors, vectors.where(F.col("id") % 100 == 0))
