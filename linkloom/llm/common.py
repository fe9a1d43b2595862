"""What the operators of this subpackage share: the shared scratch folder, ranks within keys, word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkloom.plans.shipping import ship

#: Texts that a Python worker turns into objects at once.
TEXT_ROWS_PER_BATCH = 256
#: Rows that written() hands to Python at once: a batch lies in the JVM's and in the worker's memory, beside the heap, as a whole.
ROWS_PER_BATCH, _ROWS_SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that one group of a ranking window may reach on average before it is split further.
ROWS_PER_SALT = 5_000

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in plain local mode, where it is unset, a temporary one."""
    global _own_folder
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_folder = _own_folder or tempfile.mkdtemp(prefix="linkloom-")
    return _own_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, outlives executors, goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_ROWS_SETTING)
    spark.conf.set(_ROWS_SETTING, str(min(ROWS_PER_BATCH, int(before)) if int(before) > 0 else ROWS_PER_BATCH))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_ROWS_SETTING, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, work: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow, with the package's code at hand for workers that don't have it."""
    ship(df.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()  # workers stay for later tasks

    return df.mapInArrow(released, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that a worker holds few texts as Python objects at once. Their bytes are bounded by
    spark.sql.execution.arrow.maxBytesPerBatch, their rows by written() while it writes; the session's settings stay as they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def rank_in_groups(df: DataFrame, key: str, order: list[str], counts: dict[int, int], rank: str = "rank") -> DataFrame:
    """Adds rank (long, from 0, gapless within key), the same in every run for the same rows. counts: rows of each key, a long or int.

    A key may hold most of the rows: such a key's rows are salted by a hash of what orders them, by as many salts as its own
    count asks for, numbered within (key, salt), and shifted by the number of rows of the key's smaller salts."""
    hot = [(int(k), -(-n // ROWS_PER_SALT)) for k, n in counts.items() if n > ROWS_PER_SALT]  # at most rows / ROWS_PER_SALT of them, and no more than keys
    salts = df.sparkSession.createDataFrame(hot, "__key long, __salts long")
    salted = df.join(F.broadcast(salts), F.col(key) == F.col("__key"), "left")
    salted = salted.withColumn("__salt", F.pmod(F.xxhash64(*order), F.coalesce("__salts", F.lit(1))).cast("int"))
    before = Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.where("__salts IS NOT NULL").groupBy(key, "__salt").agg(F.count("*").alias("__n")).select(key, "__salt", F.sum("__n").over(before).alias("__shift"))
    numbered = salted.withColumn("__local", F.row_number().over(Window.partitionBy(key, "__salt").orderBy(*order)).cast("long") - 1)
    ranked = numbered.join(shift, [key, "__salt"], "left").withColumn(rank, F.col("__local") + F.coalesce("__shift", F.lit(0)))
    return ranked.drop("__key", "__salts", "__salt", "__local", "__shift")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of doc_id as text, mod m: which rows labels are learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def fresh(df: DataFrame, name: str) -> str:
    """The name, or with underscores before it, that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles of `size` words, sorted; fewer words: all of them as one; none: none."""
    if not len(words):
        return words
    if len(words) < size:
        size = len(words)
    n = len(words) - size + 1
    acc = np.full(n, np.uint64(size))
    for i in range(size):
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(acc)


#: What separates words, and what stands for each byte in a word's hash.
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_OF_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
#: Bytes of a text that are hashed at once; a text is only cut between words.
_BYTES_AT_ONCE = 1 << 20


def lower_bytes(text: str | None) -> bytes:
    """The text's UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = _GAP[data]
    edges = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    factors = mixed(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    sums = np.add.reduceat(_OF_BYTE[data[~gap]] * factors[at], first)
    return mixed(sums + lengths.astype(np.uint64)), starts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in order, repeats too, and where each begins. A word's hash is the mixed sum of its bytes'
    numbers, each times an odd number for its place."""
    whole = np.frombuffer(data, np.uint8)
    hashes, starts, at = [], [], 0
    while True:
        end = min(at + _BYTES_AT_ONCE, len(whole))
        while end < len(whole) and not _GAP[whole[end]]:
            step = np.flatnonzero(_GAP[whole[end : end + _BYTES_AT_ONCE]])
            end = end + int(step[0]) if len(step) else min(end + _BYTES_AT_ONCE, len(whole))
        found, places = _word_hashes(whole[at:end])
        hashes.append(found)
        starts.append(places + at)
        at = end
        if at >= len(whole):
            return np.concatenate(hashes), np.concatenate(starts)
