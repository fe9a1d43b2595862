"""Classification of texts by compression with zstandard dictionaries.

Two dictionaries are made from a bounded sample of labelled rows; a text's windows are compressed with both, and the
normalised differences of the sizes become a calibrated score. Dictionaries are calibrated on texts they were not made
from, weighed by the classes' shares among all labels that may be learnt from.

Defined results: null and empty texts score as empty texts; rows that share a doc_id count once as labels, by their
mean; without labels of both classes the score is the share of label 1, or 0.5 without any; repeated rows score alike;
an empty table gives no rows; texts of any length are scored whole, window by window; columns besides doc_id and text are
not read, whatever their names, or are kept as they are (`keep`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from linkloom.llm.common import crc_mod, fresh, in_arrow, sliced, written

#: Labelled rows of a class that are learnt from, and the longest of them in code points.
PER_CLASS, LONGEST = 3000, 16_384
_NO_HEADER = {"write_content_size": False, "write_dict_id": False, "write_checksum": False}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, per_class: int = PER_CLASS) -> tuple[list[str], list[str], float]:
    """Texts of label 1 and of label 0, in a seeded order, and the share of label 1; nothing of rows with crc32(doc_id) mod `mod` = held_out.

    Of every class the first per_class documents of that order that have a text of 1 to LONGEST code points."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(crc_mod(F.col("doc_id"), mod) != held_out)
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).alias("y"))
    share = known.agg(F.avg(F.col("y").cast("double"))).first()[0]
    order = F.xxhash64(F.lit(label), F.col("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where((F.length("text") <= LONGEST) & (F.length("text") > 0))
    able = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    drawn = [able.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (True, False)]
    chosen = written(drawn[0].union(drawn[1]).select(F.col("doc_id").alias("__id"), "y", order.alias("__order")), "labelled")  # 2 * per_class rows
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).orderBy("__order", "doc_id", F.crc32(F.col("text").cast("binary"))).limit(2 * per_class).select("y", "text").collect()  # at most 2 * per_class rows of LONGEST code points
    return [r["text"] for r in rows if r["y"]], [r["text"] for r in rows if not r["y"]], 0.5 if share is None else float(share)


def calibrate(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps with classes weighed to their share: mean, deviation, weights."""
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / deviation]
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    w, penalty = np.zeros(z.shape[1]), ridge * len(y) * np.r_[0, np.ones(x.shape[1])]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (weight * (p - y)) + penalty * w)
        w = w - np.clip(step, -5, 5)
    return mean, deviation, w


@dataclass
class Model:
    """What a scan needs to score a text: bytes of the dictionaries, how texts become features, the calibration."""

    dictionaries: tuple[bytes, ...]
    compressors: Callable[[tuple[bytes, ...]], list]
    features: Callable[[list, str], tuple[float, ...]]
    fitted: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    share: float

    def scores(self, texts: list[str | None], tools: list) -> np.ndarray:
        if self.fitted is None:
            return np.full(len(texts), self.share)
        mean, deviation, w = self.fitted
        x = np.array([self.features(tools, t or "") for t in texts], dtype=np.float64).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - mean) / deviation] @ w, -30, 30)))


def learn(ones: list[str], zeros: list[str], share: float, dictionaries: Callable, compressors: Callable, features: Callable) -> Model:
    if not ones[1::2] or not zeros[1::2]:
        return Model((), compressors, features, None, share)
    made = dictionaries(ones[::2], zeros[::2])
    tools = compressors(made)
    texts = ones[1::2] + zeros[1::2]
    x = np.array([features(tools, t) for t in texts], dtype=np.float64)
    return Model(made, compressors, features, calibrate(x, np.r_[np.ones(len(ones[1::2])), np.zeros(len(zeros[1::2]))], share), share)


def learn_crossed(ones: list[str], zeros: list[str], share: float, dictionaries: Callable, compressors: Callable, features: Callable) -> Model:
    """Each half of the sample is measured with dictionaries made from the other half, for the calibration; the model's are made from all of it."""
    if not ones[1::2] or not zeros[1::2]:
        return Model((), compressors, features, None, share)
    x, y = [], []
    for half in (0, 1):
        tools = compressors(dictionaries(ones[half::2], zeros[half::2]))
        x += [features(tools, t) for t in ones[1 - half :: 2] + zeros[1 - half :: 2]]
        y += [1] * len(ones[1 - half :: 2]) + [0] * len(zeros[1 - half :: 2])
    return Model(dictionaries(ones, zeros), compressors, features, calibrate(np.array(x, dtype=np.float64), np.array(y), share), share)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """doc_id (or the columns `keep`) and the score, under a name that is none of these, for every document."""
    names = keep if keep is not None else ["doc_id"]
    plain = docs.select(*[docs[c] for c in names], docs["text"].cast("string").alias(fresh(docs, "whole_text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors(model.dictionaries) if model.fitted else []
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(batch.column(len(names)).to_pylist(), tools), pa.float64())], [*names, name])

    schema = StructType([*plain.schema.fields[:-1], StructField(name, DoubleType())])
    return in_arrow(plain, work, schema)


def windows(raw: bytes, size: int) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)] or [b""]


# Quality: dictionaries of what one class has and the other has not.

QUALITY_WINDOW, QUALITY_DICTIONARY = 512, 65_536
QUALITY_MOD, QUALITY_HELD_OUT, QUALITY_THRESHOLD = 4, 2, 0.7


def quality_dictionaries(good: list[str], bad: list[str]) -> tuple[bytes, ...]:
    """Dictionaries trained on the classes' own distinct lines; a line of both classes says nothing."""
    import zstandard

    lines = [list(dict.fromkeys(line for t in texts for line in t.split("\n"))) for texts in (good, bad)]
    made = []
    for own, other in ((lines[0], set(lines[1])), (lines[1], set(lines[0]))):
        samples = [w for line in own if line not in other for w in windows((line + "\n").encode("utf-8", "surrogatepass"), QUALITY_WINDOW)]
        try:
            made.append(zstandard.train_dictionary(QUALITY_DICTIONARY, samples, level=1).as_bytes())
        except zstandard.ZstdError:  # too few samples to train on: their end is the dictionary
            made.append(b"".join(samples)[-QUALITY_DICTIONARY:] or b"\0" * 8)
    return tuple(made)


def quality_compressors(dictionaries: tuple[bytes, ...]) -> list:
    import zstandard

    return [zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), **_NO_HEADER) for d in dictionaries]


def quality_features(tools: list, text: str) -> tuple[float, ...]:
    """Difference of the compressed sizes over the size, overall and in its least window, and the good size over the size, likewise."""
    parts = windows(text.encode("utf-8", "surrogatepass"), QUALITY_WINDOW)
    if len(parts) > 1 and len(parts[-1]) < QUALITY_WINDOW // 2:  # a short end joins the window before it
        parts[-2:] = [parts[-2] + parts[-1]]
    n = np.array([len(p) + 1 for p in parts], dtype=np.float64)
    good, bad = (np.array([len(c.compress(p)) for p in parts], dtype=np.float64) for c in tools)
    return (bad - good).sum() / n.sum(), ((bad - good) / n).min(), good.sum() / n.sum(), (good / n).min()


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    return learn(*labelled_sample(docs, labels, "quality", QUALITY_MOD, QUALITY_HELD_OUT), quality_dictionaries, quality_compressors, quality_features)


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), QUALITY_MOD) == QUALITY_HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


# Toxicity: small windows, coded so that every letter of a match counts, and a toxic dictionary laid over the ordinary one.

TOXIC_WINDOW = 128
TOXIC_MOD, TOXIC_HELD_OUT, TOXIC_THRESHOLD = 5, 0, 0.5
#: Bytes of the two dictionaries, and the trainer's segment and match lengths for the toxic one.
ORDINARY_BYTES, TOXIC_BYTES = 64_000, 4096
_SEGMENT, _MATCH = 24, 6
#: The toxic dictionary is trained on the parts of toxic texts whose strings of GRAM bytes stand in at least SUPPORT of the
#: toxic texts (three, where that is more) and in LIFT times the share of ordinary ones: what both classes hold says nothing.
GRAM, SUPPORT, LIFT = 7, 0.02, 25
#: Saved bytes at which a window counts half as a hit: a match of a coded word saves about ten, of chance two.
HALF_HIT = 5.0
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """A-Z in lower case, all other ASCII as single spaces."""
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "


def _strings(raw: bytes, size: int) -> np.ndarray:
    """All strings of `size` (at most 8) bytes, each as a number."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(b) - size + 1), dtype=np.uint64)
    for i in range(size if len(out) else 0):
        out = (out << np.uint64(8)) | b[i : i + len(out)]
    return out


def coded(raw: bytes) -> bytes:
    """Two bytes of hash for every three bytes in a row: literals cost their full size, so what a dictionary holds shows in a window's size."""
    x = _strings(raw, 3).astype(np.uint32) * np.uint32(0x9E3779B1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
    return (x >> np.uint32(16)).astype("<u2").tobytes()


def telling_parts(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The longest parts of toxic texts that are covered by strings which are common in them and rare in ordinary texts."""
    own = [_strings(plain(t), GRAM) for t in toxic]
    counts = lambda many: np.unique(np.concatenate([np.unique(x) for x in many]), return_counts=True)
    (a, n), (b, m) = counts(own), counts([_strings(plain(t), GRAM) for t in ordinary])
    at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    other = np.where(b[at] == a, m[at], 0) if len(b) else np.zeros(len(a))
    telling = a[(n >= max(3, SUPPORT * len(toxic))) & (n / len(toxic) >= LIFT * (other + 0.3) / len(ordinary))]
    parts = []
    for text, strings in zip(toxic, own, strict=True):
        raw = plain(text)
        starts = np.flatnonzero(np.isin(strings, telling))
        covered = np.zeros(len(raw) + 1, dtype=np.int64)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + GRAM, -1)
        edges = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(covered) > 0).astype(np.int8), 0]))
        parts += [raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)]
    return parts


def trained(samples: list[bytes], size: int, segment: int, match: int) -> bytes:
    """A dictionary by zstandard's trainer; of samples too few to train on, their end."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=match).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\0" * 8


def toxic_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, ...]:
    """A dictionary trained on windows of ordinary texts, and one trained on the telling parts of toxic texts, laid before
    the ordinary one: what is ordinary lies at the same distance for both, so sizes differ by what is toxic alone."""
    usual = trained([coded(w) for t in ordinary for w in windows(plain(t), TOXIC_WINDOW)], ORDINARY_BYTES, 64, 8)
    parts = [coded(p) for p in telling_parts(toxic, ordinary)]
    return usual, trained([b"".join(parts[i : i + 4]) for i in range(0, len(parts), 4)], TOXIC_BYTES, _SEGMENT, _MATCH) + usual


def toxic_compressors(dictionaries: tuple[bytes, ...]) -> list:
    import zstandard as z

    how = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, strategy=z.STRATEGY_LAZY, min_match=4, window_log=18, hash_log=16, chain_log=16, search_log=6, target_length=64, write_content_size=0, write_dict_id=0, write_checksum=0)
    return [z.ZstdCompressor(compression_params=how, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)) for d in dictionaries]


def toxic_features(tools: list, text: str) -> tuple[float, ...]:
    """Of the bytes that the toxic dictionary saves in a window: whether the best and the second best are hits, the number and share of hits, the best."""
    ordinary, toxic = tools
    parts = [coded(w) for w in windows(plain(text), TOXIC_WINDOW)]
    saved = np.array([0, 0, *(len(ordinary.compress(p)) - len(toxic.compress(p)) for p in parts)], dtype=np.float64)
    hit = 1 / (1 + np.exp(HALF_HIT - saved))
    best = np.sort(saved)[-2:]
    high = 1 / (1 + np.exp(HALF_HIT - best))
    return high[1], high[0], np.log1p(hit[2:].sum()), hit[2:].mean(), best[1] / (1 + best[1])


def toxic_model(docs: DataFrame, labels: DataFrame) -> Model:
    return learn_crossed(*labelled_sample(docs, labels, "toxic", TOXIC_MOD, TOXIC_HELD_OUT), toxic_dictionaries, toxic_compressors, toxic_features)


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, toxic_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), TOXIC_MOD) == TOXIC_HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"))
