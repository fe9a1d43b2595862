"""Best-fit packing planned on the histogram of lengths.

The plan is made from counts, never from documents: best-fit decreasing places whole runs of equal lengths into
runs of equal bins. Documents then take the planned slots by their rank within their length.

Defined results: null text counts as empty; an empty text is the end id alone; a text longer than a sequence is cut
into full pieces and a last shorter one; repeated rows are packed once each; an empty table gives no rows; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import in_arrow, rank_in_groups, sliced, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, ranks, per sequence, first sequence, offset).

    Ranks [first, first + ranks) of that length go, `per sequence` at a time, to consecutive sequences, from `offset` on.
    Rows are bounded by the capacity alone: classes of equal bins, never bins, are kept."""
    free: dict[int, list[tuple[int, int]]] = {}
    residuals: list[int] = []
    rows, sequences = [], 0

    def put(residual: int, first: int, bins: int) -> None:
        if residual and bins:
            if residual not in free:
                insort(residuals, residual)
                free[residual] = []
            free[residual].append((first, bins))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(residuals, length)
            if at == len(residuals):
                bins = -(-left // (capacity // length))
                put(capacity, sequences, bins)
                sequences += bins
                continue
            residual = residuals[at]
            first, bins = free[residual].pop()
            if not free[residual]:
                del free[residual]
                residuals.pop(at)
            each = residual // length
            full = min(bins, left // each)
            if full:
                rows.append((length, rank, full * each, each, first, capacity - residual))
                put(residual - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            used = full
            if left and used < bins:  # fewer than `each` are left: they share one more bin
                rows.append((length, rank, left, left, first + used, capacity - residual))
                put(residual - left * length, first + used, 1)
                left, used = 0, used + 1
            put(residual, first + used, bins - used)
    return rows


class Encoder:
    """Ids of whole texts as little-endian bytes, with a bounded memory of words.

    White space never joins pieces of this tokenizer, so ids of a text are its words' ids in order. A word of letters and
    trailing stops goes to the tokenizer's model directly, anything else through the whole tokenizer."""

    MOST = 300_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[str, bytes] = {}
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= outer.MOST:
                    self.clear()
                ids = outer.word(word)
                if len(word) <= 40:
                    self[word] = ids
                return ids

        self.words = Words({"": b""})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        core = word.rstrip(".,")
        if core != word and core and core.isalpha():
            return self.words[core] + self.words[word[len(core) :]]
        if core and core == word and core.isalpha() and core.islower():
            piece = core if core.isascii() else self.bytes.pre_tokenize_str(core)[0][0]
            return np.array([t.id for t in self.model.tokenize(piece)], dtype="<u4").tobytes()
        return self.whole(word)

    def __call__(self, text: str) -> bytes:
        import unicodedata

        plain = text.isascii()
        if not plain and (not unicodedata.is_normalized("NFC", text) or "Σ" in text or "İ" in text):
            return self.whole(text)
        if "<|" not in text:
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece of every whole text."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for piece, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    row = [doc_id, piece, lo // 4, len(part) // 4, zlib.crc32(part)] + [np.frombuffer(part, dtype="<i4").tolist()] * with_ids
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, schema)


def slot_lookup(plan: list[tuple[int, int, int, int, int, int]]) -> Callable:
    """(length, rank) -> (sequence_id, offset), found in the plan by bisection. The plan's size is bounded by the capacity."""
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 6)
    high = np.int64(1) << np.int64(44)
    starts = table[:, 0] * high + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = table[np.searchsorted(starts, n * high + r, side="right") - 1]
        at = r - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 4] + at // row[:, 3], "offset": row[:, 5] + at % row[:, 3] * n})

    return slot


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...) of 1 to capacity tokens."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    ranked = rank_in_groups(pieces, "length", ["doc_id", "piece", "ids_crc32", "start"], histogram, "__rank")
    placed = ranked.withColumn("__slot", slot_lookup(plan_best_fit(histogram, capacity))("length", "__rank"))
    return placed.select(*pieces.columns, "__slot.sequence_id", "__slot.offset")


def best_fit_pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens."""
    import public_tokenizers

    pieces = written(token_pieces(docs, tokenizer_path or public_tokenizers.path(TOKENIZER), capacity, with_ids=with_ids), "pieces")
    return pack_pieces(pieces, capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
