"""Personal data: fixed kinds found by pattern, and terms that give protected entities away.

What is protected are classes of entities: the value of a base span (in lower case, without what separates digits), what
values share (an address's host and name parts, an ip's first two parts, a card's first six digits, a phone's all but the
last seven), its kind, and that there is any entity. Terms are words and, for words with digits, their shapes. A term goes
with a value, or what values share, where it stands within RADIUS words of the entity; with a kind, where it stands in the
same text, the entity's own words included.

With p(e) and p(t) the shares of origins that hold class and term, and p(e, t) of those where they go together, a term
discloses PMI(e; t) of the IC(e) = -log p(e) bits of the class. From GENERALISE of IC(e) on it is generalised to its shape,
from REMOVE on removed, wherever it stands outside of base spans. There is no fixed number of origins that it must have: the
Chernoff bound of the chance that as many of its origins meet the class as do must be under ALPHA over the number of
class-term pairs there may be (an estimate of it, as only its logarithm matters). Near copies are one origin: see origins().

There is a scan for spans, contexts and, of texts with entities and of a part of the others, distinct terms' hashes; one for
candidates' counts; and one for disclosing terms' places. The part rules out common words exactly, as no term is in fewer texts
than in those with entities and in a part of the others together. Between scans, terms are 64-bit hashes and sets of bits of a size that follows their number.

Defined results: null and empty texts have no spans; repeated rows get the same spans each; a null doc_id is kept; an
empty table gives no rows; texts of any length are read whole; find_pii() reads doc_id and text alone, whatever other
columns are named; sanitise() keeps other columns as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import fresh, in_arrow, mixed, sliced, written
from linkloom.llm.near_dedup import SHINGLE, _functions, _sets, components

KINDS = ("email", "ip", "card", "phone")
RADIUS = 6
#: The chance, over all pairs of class and term, that a term that has nothing to do with a class passes.
ALPHA = 0.01
#: Of one in so many texts without entities the terms are kept, for a first bound of how many hold a term.
PART = 8
#: Texts that agree in a band, some of their signatures' coordinates together, are of one origin. Of copies with a fifth of their
#: shingles changed 1e-5 stay apart; of texts with a tenth of their shingles in common 0.02 come together.
BANDS, COORDINATES_PER_BAND = 16, 3
_WORDS_AT_ONCE = 400_000
GENERALISE, REMOVE = 0.8, 0.9
#: Least and most bits of the sets that are handed to scans, and bits for each member between these. The most is 32 MB.
FEWEST_BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 28, 64
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that begins within a run of digits would have begun at its start; so no start after a digit need be tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGIT_BYTE = re.compile(rb"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"[^\W_]+")
_PART = re.compile(r"[^\W\d_]{3,}")
_EDGES = ".,;:!?\"'()[]{}<>"
_EDGE_BYTES = _EDGES.encode()


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            found.append(m.span())
            after = m.end()
        at = text.find("@", max(at + 1, after))
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) by kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        small = lambda part: len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def term_of(word: str) -> str:
    return word.strip(_EDGES).lower()


def _bands(texts: list[str]) -> list[list[int]]:
    """BANDS 64-bit hashes of every text, each of the least values of some hash functions over the text's shingles; none without words."""
    flip, factor = _functions()
    out: list[list[int]] = [[] for _ in texts]
    places: list[int] = []
    parts: list[np.ndarray] = []

    def flush() -> None:
        if not places:
            return
        members = (np.concatenate(parts) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        bands = np.empty((len(places), BANDS), dtype=np.uint64)
        for i in range(BANDS):
            acc = np.full(len(places), np.uint64(i + 1))
            for k in range(i * COORDINATES_PER_BAND, (i + 1) * COORDINATES_PER_BAND):
                acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((members ^ flip[k]) * factor[k], starts))
            bands[:, i] = acc
        for place, row in zip(places, bands.view(np.int64).tolist(), strict=True):
            out[place] = row
        places.clear()
        parts.clear()

    held = 0
    for place, members in _sets(texts, SHINGLE):
        places.append(place)
        parts.append(members)
        held += len(members)
        if held > _WORDS_AT_ONCE:
            flush()
            held = 0
    flush()
    return out


def shape_of(word: str) -> str | None:
    """For a word with a digit: its runs of digits, of letters and of both as 0, a and x with their lengths (a without), other characters as they are."""

    def run(m: re.Match) -> str:
        digits = sum(c.isdigit() for c in m[0])
        return "a" if not digits else f"{'0' if digits == len(m[0]) else 'x'}{len(m[0])}"

    if not _DIGIT.search(word):
        return None
    if word.isalnum():  # the usual case: a single run
        return f"~{'0' if word.isdigit() else 'x'}{len(word)}"
    return f"~{_RUN.sub(run, word)}"


def terms_of(word: str) -> tuple[str, ...]:
    """The terms that a word of a text stands for."""
    term = term_of(word)
    if len(term) < 2:
        return ()
    shape = shape_of(term)
    return (term, shape) if shape else (term,)


class TermHashes(dict):
    """word -> hashes of its terms; forgets all once it holds `most` words, so its memory is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = tuple(map(_spark_hash, terms_of(word)))
        return out


def classes(kind: str, raw: str) -> list[str]:
    """What of an entity recurs: its value and what it shares with other values."""
    if kind == "email":
        name, _, host = raw.lower().rpartition("@")
        return [f"email:{raw.lower()}", f"host:{host}", *(f"name:{p}" for p in dict.fromkeys(_PART.findall(name)))]
    value = re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", raw)
    shared = ".".join(value.split(".")[:2]) if kind == "ip" else value[:6] if kind == "card" else value[:-7]
    return [f"{kind}:{value}", f"{kind} of:{shared}"]


def _contexts(text: str, found: dict[str, list[tuple[int, int]]], hashes: TermHashes) -> tuple[list[tuple[int, int]], list[int]]:
    """(class, term) for words near entities, but for what covers them, and the distinct terms of the text, as hashes."""
    spans = sorted((s, e, k) for k, x in found.items() for s, e in x)
    words = list(_WORD.finditer(text))
    starts = np.array([m.start() for m in words])
    ends = [m.end() for m in words]
    out: dict[tuple[int, int], None] = {}
    edges = np.array([(s, e) for s, e, _ in spans])
    upto = np.maximum.accumulate(edges[:, 1])  # the last end of the spans so far
    for start, end, kind in spans:
        lo = max(0, int(np.searchsorted(starts, start, "right")) - 1 - RADIUS)
        hi = int(np.searchsorted(starts, end)) + RADIUS
        near = dict.fromkeys(t for i in range(lo, min(hi, len(words))) if not _meets(edges, upto, int(starts[i]), ends[i]) for t in hashes[words[i][0]])
        for c in classes(kind, text[start:end]):
            entity = _spark_hash(c)
            out.update(dict.fromkeys((entity, t) for t in near))
    return list(out), list(_terms(text, hashes))


def _terms(text: str, hashes: TermHashes) -> set[int]:
    """The distinct terms of the text, as hashes."""
    return set(chain.from_iterable(map(hashes.__getitem__, set(_WORD.findall(text)))))


def _meets(edges: np.ndarray, upto: np.ndarray, start: int, end: int) -> bool:
    """Whether [start, end) meets one of the spans, which are sorted by start."""
    before = int(np.searchsorted(edges[:, 0], end)) - 1
    return before >= 0 and bool(upto[before] > start)


def base_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, counts, base_sha256, base (spans), mask (of kinds), contexts array<struct<entity, term>>, terms array<long> (empty
    for most texts without entities, see PART), bands."""
    item = pa.struct([("entity", pa.int64()), ("term", pa.int64())])
    names = ["doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "mask", "contexts", "terms", "bands"]
    types = [pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int32(), pa.list_(item), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_hashes = TermHashes()
        for batch in sliced(batches):
            out: list[list] = [[] for _ in names]
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, text, bands in zip(batch.column(0).to_pylist(), texts, _bands(texts), strict=True):
                found = base_spans(text)
                base = joined([(k, s, e) for k in KINDS for s, e in found[k]])
                text_hash = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63
                if base:
                    contexts, terms = _contexts(text, found, terms_hashes)
                else:
                    contexts, terms = [], list(_terms(text, terms_hashes)) if text_hash % PART == 0 else []
                contexts = [{"entity": x, "term": t} for x, t in contexts]
                mask = sum(1 << i for i, k in enumerate(KINDS) if found[k])
                row = [doc_id, text_hash, *(len(found[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base, mask, contexts, terms, bands]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    schema = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, mask int, contexts array<struct<entity:long,term:long>>, terms array<long>, bands array<long>"
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


def _bits(hashes: DataFrame) -> tuple[bytes, int]:
    """The set of the column's hashes as packed bits, the first bit of a byte its lowest, and how many bits it has: BITS_EACH
    for each (about), within the bounds, so what comes to the driver is MOST_BITS / 8 bytes at most."""
    rows = hashes.toDF("hash")
    size = FEWEST_BITS
    members = rows.agg(F.approx_count_distinct("hash")).first()[0]
    while size < min(MOST_BITS, BITS_EACH * members):
        size *= 2
    bit = rows.select(F.pmod("hash", F.lit(size)).alias("bit"))
    pages = bit.groupBy(F.shiftright("bit", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in pages.collect():  # pages of 4,096 bytes
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes(), size


class _Set:
    """Tests hashes (signed or not: sizes are powers of two) against packed bits, without unpacking them."""

    def __init__(self, packed: bytes, size: int):
        self.packed, self.last = packed, size - 1

    def __contains__(self, value: int) -> bool:
        bit = value & self.last
        return self.packed[bit >> 3] >> (bit & 7) & 1 == 1


def _scan(docs: DataFrame, terms: DataFrame, schema: str, emit: Callable) -> DataFrame:
    """Runs emit(batches, test) over all texts, with test[word] the terms of the word (its UTF-8) that may be of `terms` (a column of hashes)."""
    packed, size = _bits(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Set(packed, size)

        class Test(dict):
            def __missing__(self, word: bytes) -> tuple[str, ...]:
                if len(self) > 400_000:
                    self.clear()
                # The same as terms_of(), but most words have one term and that not of the set, so ASCII ones stay bytes.
                term = word.strip(_EDGE_BYTES).lower() if word.isascii() else term_of(word.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")
                if xxhash.xxh64_intdigest(term, 42) in known or _DIGIT_BYTE.search(term):
                    self[word] = out = tuple(t for t in terms_of(word.decode("utf-8", "surrogatepass")) if _spark_hash(t) in known)
                else:
                    self[word] = out = ()
                return out

        yield from emit(sliced(batches), Test())

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


def _spark_hash(term: str) -> int:
    """xxhash64 as Spark computes it, with seed 42, as a signed number."""
    h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42)
    return h - 2**64 if h >= 2**63 else h


def _held(text: bytes | None, test: dict) -> set[str]:
    """The terms of the text that may be of the set. Words between bytes.split()'s white space are those of _WORD."""
    return set(chain.from_iterable(map(test.__getitem__, set((text or b"").split()))))


def _count(packed: bytes, size: int) -> Callable:
    """Emits term, text_hash, n: numbers of texts without a copy, with a null hash, and every text whose hash's bit is in the set."""

    def emit(batches: Iterator[pa.RecordBatch], test: dict) -> Iterator[pa.RecordBatch]:
        shared = _Set(packed, size)
        counts: Counter = Counter()
        as_batch = lambda t, h, n: pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["term", "text_hash", "n"])
        single = lambda: as_batch(list(counts), [None] * len(counts), list(counts.values()))
        for batch in batches:
            copied: dict[tuple[str, int], None] = {}
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                if found := _held(text, test):
                    key = xxhash.xxh3_64_intdigest(text) - 2**63
                    if key in shared:
                        copied.update(dict.fromkeys((t, key) for t in found))
                    else:
                        counts.update(found)
            if copied:
                yield as_batch([t for t, _ in copied], [h for _, h in copied], [1] * len(copied))
            if len(counts) > 100_000:
                yield single()
                counts.clear()
        yield single()

    return emit


def _locate(batches: Iterator[pa.RecordBatch], test: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            places = []
            if not _held(data, test):
                continue
            text = data.decode("utf-8", "surrogatepass")
            held = {w.decode("utf-8", "surrogatepass"): test[w] for w in set(data.split()) if test[w]}
            for m in _WORD.finditer(text):
                for t in held.get(m[0], ()):
                    start = m.start() + len(m[0]) - len(m[0].lstrip(_EDGES))
                    places.append((t, start, start + len(m[0].strip(_EDGES))))
            if places:
                edges = np.array(sorted(x for found in base_spans(text).values() for x in found)).reshape(-1, 2)
                upto = np.maximum.accumulate(edges[:, 1])
                key = xxhash.xxh3_64_intdigest(data) - 2**63
                for t, s, e in places:
                    if not len(edges) or not _meets(edges, upto, s, e):
                        for column, value in zip(out, (doc_id, key, t, s, e), strict=True):
                            column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()], strict=True)], ["doc_id", "text_hash", "term", "start", "end"])


def origins(base: DataFrame) -> DataFrame:
    """text_hash, origin: the texts that are linked with others by bands, and the least of those they are linked with.
    Any other text is its own origin. A group of near copies, of whatever size, is one origin."""
    keys = base.groupBy("text_hash").agg(F.first("bands").alias("bands")).select("text_hash", F.explode("bands").alias("band"))
    keys = written(keys, "pii-bands")
    shared = keys.groupBy("band").agg(F.min("text_hash").alias("least"), F.count("*").alias("c")).where("c > 1").select("band", "least")
    links = keys.join(shared, "band").where("text_hash <> least").select(F.col("text_hash").alias("a"), F.col("least").alias("b")).distinct()
    return written(components(written(links, "pii-links")).select(F.col("node").alias("text_hash"), F.col("component").alias("origin")), "pii-origins")


def with_origin(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with origin instead of text_hash. known: of origins()."""
    return rows.join(known, "text_hash", "left").withColumn("origin", F.coalesce("origin", "text_hash")).drop("text_hash")


def different(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: of how many different origins a key's rows are. Equal words around an entity in unlike texts count for each text."""
    return rows.select(*keys, "origin").distinct().groupBy(*keys).agg(F.count("*").alias("n"))


def copied_texts(base: DataFrame, known: DataFrame) -> DataFrame:
    """The hashes of texts that are not the only ones of their origin."""
    return base.groupBy("text_hash").agg(F.count("*").alias("c")).where("c > 1").select("text_hash").union(known.select("text_hash"))


def at_least(base: DataFrame, copied: DataFrame, terms: DataFrame) -> DataFrame:
    """term (its hash), n_least: in how many texts it is of the part without entities whose terms are kept, copies left out."""
    part = base.where("mask = 0 AND size(terms) > 0").join(copied, "text_hash", "left_anti").select(F.explode("terms").alias("term"))
    return part.groupBy("term").agg(F.count("*").alias("n_least")).join(terms, "term", "left_semi")


def origins_with(docs: DataFrame, copied: tuple[bytes, int], terms: DataFrame, known: DataFrame) -> DataFrame:
    """text (of the term), term (its hash), n_t: how many different origins hold it. terms: their hashes."""
    texts = _scan(docs, terms, "term string, text_hash long, n long", _count(*copied)).groupBy("term", "text_hash").agg(F.sum("n").alias("n"))
    by_origin = with_origin(texts, known).groupBy("term", "origin").agg(F.sum("n").alias("n"))
    return by_origin.groupBy(F.col("term").alias("text"), F.xxhash64("term").alias("term")).agg(F.sum(F.when(F.col("origin").isNull(), F.col("n")).otherwise(1)).alias("n_t"))


#: Classes of kinds, by their bit of a text's mask; any entity at all is the last.
_ANY = len(KINDS)


def of_kinds(texts: DataFrame, sizes: dict[int, int], n: float, enough: float) -> tuple[DataFrame, DataFrame]:
    """entity (a kind's number), term, n_et: of the texts with an entity (origin, grouped, mask, terms), counted in origins. And
    term, n_held: of how many origins with any entity the more frequent terms are.

    Only pairs that can pass: a term of too few texts for any kind is dropped by a plain count before kinds are told apart."""
    least = {k: enough / max(1e-9, math.log(n / n_e) - 1 + n_e / n) for k, n_e in sizes.items() if n_e < n}
    exploded = texts.select("origin", "grouped", F.col("mask").bitwiseOR(F.lit(1 << _ANY)).alias("mask"), F.explode("terms").alias("term"))
    frequent = written(exploded.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min(least.values(), default=math.inf)).select("term"), "pii-frequent")
    kept = exploded.join(frequent, "term", "left_semi")
    counts = [F.sum((F.col("mask").bitwiseAND(F.lit(1 << k)) > 0).cast("long")).alias(f"k{k}") for k in range(_ANY + 1)]
    met = kept.where("grouped").groupBy("term", "origin").agg(F.bit_or("mask").alias("mask")).groupBy("term").agg(*counts)
    pairs = kept.where("grouped IS NULL").groupBy("term").agg(*counts).union(met).groupBy("term").agg(*[F.sum(f"k{k}").alias(f"k{k}") for k in range(_ANY + 1)])
    pairs = written(pairs, "pii-kinds")
    able = F.array(*[F.struct(F.lit(k).cast("long").alias("entity"), F.col(f"k{k}").alias("n_et"), F.lit(float(least.get(k, math.inf))).alias("least")) for k in range(_ANY + 1)])
    return pairs.select("term", F.inline(able)).where("n_et >= least").select("entity", "term", "n_et"), pairs.select("term", F.col(f"k{_ANY}").alias("n_held"))


def weighed(docs: DataFrame, base: DataFrame, alpha: float = ALPHA, least: float = 0.0) -> DataFrame:
    """entity (its hash or kind), term (its hash), text, n_e, n_t, n_et, n, strength: the pairs of class and term that chance
    doesn't explain, of a strength of at least `least`.

    The texts with entities and a part of the others show of most common words that they are of too many; only the others are
    counted in all texts."""
    known = origins(base)
    n = float(base.select("text_hash").distinct().join(known, "text_hash", "left").agg(F.countDistinct(F.coalesce("origin", "text_hash"))).first()[0])
    texts = base.where("mask > 0").groupBy("text_hash").agg(F.first("mask").alias("mask"), F.first("contexts").alias("contexts"), F.first("terms").alias("terms"))
    texts = written(with_origin(texts, known.withColumn("grouped", F.lit(True))), "pii-texts")
    seen = texts.select(F.explode("contexts").alias("c"), "origin").select("c.*", "origin")
    entities = different(seen, ["entity"]).withColumnRenamed("n", "n_e")
    of_kind = [F.count_distinct(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) > 0, F.col("origin"))) for k in range(_ANY)]
    found = texts.groupBy("origin").agg(F.bit_or("mask").alias("mask")).agg(*of_kind, F.count("*")).first()
    sizes = {k: found[k] for k in range(_ANY + 1) if found[k]}
    # The numbers of classes and terms only matter by their logarithms.
    tests = (seen.agg(F.approx_count_distinct("entity")).first()[0] + len(sizes)) * texts.select(F.explode("terms").alias("t")).agg(F.approx_count_distinct("t")).first()[0]
    enough = math.log(max(1, tests) / alpha)
    chance = lambda holders: F.col("n_et") * F.log(F.col("n_et") * n / (F.col("n_e") * holders)) - F.col("n_et") + F.col("n_e") * holders / n
    near = different(seen, ["entity", "term"]).withColumnRenamed("n", "n_et").join(entities, "entity")
    kind_sizes = docs.sparkSession.createDataFrame(list(sizes.items()), "entity long, n_e long")
    kinds, held = of_kinds(texts, sizes, n, enough)
    near = near.union(kinds.join(kind_sizes, "entity"))
    information = F.log(n / F.least(F.col("n_e"), F.lit(max(1.0, n - 1))))
    strength = lambda holders: F.log(F.col("n_et") * n / (F.col("n_e") * holders)) / information
    passes = lambda holders: (chance(holders) >= enough) & (strength(holders) >= least)
    # With fewer holders than n_et no term can do better, so what fails then needs no count. Nor has it fewer than it has among
    # origins with an entity, all of them counted, and among a part of the other texts together.
    near = near.where(chance(F.col("n_et")) >= enough).join(held, "term", "left").withColumn("n_held", F.greatest("n_et", F.coalesce("n_held", F.lit(0))))
    able = written(near.where(passes(F.col("n_held"))), "pii-candidates")
    copied = copied_texts(base, known)
    few = able.join(at_least(base, copied, able.select("term").distinct()), "term", "left").where(passes(F.col("n_held") + F.coalesce("n_least", F.lit(0))))
    able = written(few.drop("n_held", "n_least"), "pii-able")
    counts = origins_with(docs, _bits(copied), able.select("term").distinct(), known)
    holders = F.greatest("n_t", "n_et")
    return able.join(counts, "term").where(passes(holders)).withColumns({"n": F.lit(n), "strength": strength(holders)})


def disclosing_terms(docs: DataFrame, base: DataFrame, alpha: float = ALPHA, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """term, strength (largest share of a class's information), kind (generalised or removed)."""
    found = weighed(docs, base, alpha, generalise).groupBy(F.col("text").alias("term")).agg(F.max("strength").alias("strength")).where(F.col("strength") >= generalise)
    return written(found.withColumn("kind", F.when(F.col("strength") >= remove, "removed").otherwise("generalised")), "pii-terms")


def added_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, text_hash, added (spans by kind, then start) for documents that hold disclosing terms outside of base spans; a place that is of two kinds is removed."""
    places = _scan(docs, terms.select(F.xxhash64("term")), "doc_id long, text_hash long, term string, start int, end int", _locate).join(terms, "term")
    places = places.groupBy("doc_id", "text_hash", "start", "end").agg(F.max("kind").alias("kind"))
    return written(places.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added")), "pii-added")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, counts, base_sha256, base, added (array, null if none), spans for every document."""
    base = written(base_table(docs), "pii-base")
    added = added_spans(docs, disclosing_terms(docs, base))
    if not added.take(1):
        return base.drop("contexts", "terms", "bands", "mask").withColumns({"added": F.lit(None).cast("array<struct<kind:string,start:int,end:int>>"), "spans": F.col("base")})
    more = added.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "added")
    text = F.array_join(F.transform("added", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = base.drop("contexts", "terms", "bands", "mask").join(more, base["doc_id"].eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")), "left").drop("__d", "__h")
    return found.withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).when(F.col("base") == "", text).otherwise(F.concat_ws(",", "base", text)))


def shape(term: str) -> str:
    return "[NUMBER]" if any(c.isdigit() for c in term) else "[NAME]" if term[:1].isupper() else "[WORD]"


def masked(text: str, added: list[dict]) -> str:
    """The text with base spans and removed terms replaced by their kinds, generalised terms by their shapes. Overlaps merge into the first."""
    spans = [(s, e, f"[{k.upper()}]") for k, x in base_spans(text).items() for s, e in x]
    spans += [(a["start"], a["end"], "[REMOVED]" if a["kind"] == "removed" else shape(text[a["start"] : a["end"]])) for a in added]
    out, after = [], 0
    for start, end, label in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= after:
            out += [text[after:start], label]
        after = max(after, end)
    return "".join([*out, text[after:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with its own columns, text without personal data, and n_chars, where it is a column, counted anew."""
    base = written(base_table(docs), "pii-base")
    added = added_spans(docs, disclosing_terms(docs, base))
    of, more = fresh(docs, "pii_doc"), fresh(docs, "pii_added")
    if added.take(1):
        by_doc = added.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("text_hash", "added")).alias(more))
        found = docs.join(by_doc, docs["doc_id"].eqNullSafe(F.col(of)), "left")
    else:
        found = docs.withColumn(more, F.lit(None).cast("array<struct<text_hash:long,added:array<struct<kind:string,start:int,end:int>>>>"))
    names = [c for c in docs.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = []
            for text, spans in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                if text:
                    key = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63 if spans else 0
                    text = masked(text, [a for x in spans or [] if x["text_hash"] == key for a in x["added"]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], [*names, "text"])

    plain = found.select(*[docs[c] for c in names], docs["text"].cast("string").alias("text"), more)
    schema = plain.drop(more).schema
    clean = in_arrow(plain, work, schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    clean = clean.select(*docs.columns)
    return clean if "void" in clean.schema.simpleString() else written(clean, "pii-clean")  # in small batches; Parquet has no void columns


def op9_disclosure_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_added = F.coalesce(F.size("added"), F.lit(0)).cast("long")
    n_spans = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.greatest(n_added, F.lit(0))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", n_spans.alias("n_spans"))
