"""Quality rules: base counts, then robust multivariate outliers by minimum covariance determinant.

Per language and source, concentration steps look for the share of documents whose statistic vectors have the smallest
covariance determinant. They start from coordinate-wise medians and quartiles, from mean and covariance of all rows, and of
DRAWS seeded parts of the rows; of what the starts lead to, the estimate of the least determinant is kept (that of the
covariance with the variances of STATISTICS added, so a constant statistic doesn't make it zero). A step is one aggregation:
sums, by group, start and bin of distance, of whole-number vectors and their products. So any group, however hot, is summed
up before it is shuffled, all documents count, and the sums don't depend on their order.

A vector is rejected where its squared Mahalanobis distance is beyond the chi-square quantile (with distances scaled so the
group's median is the normal one) and beyond the outer fence of the group's own log distances, the third quartile and two
and a half times the quartiles' range: prose has heavier tails than a normal distribution, and what is rejected must stand out of them.

Defined results: null and empty texts have zero counts and fail the base rule; null lang or source is a value like
others; groups of fewer than MIN_ROWS documents that pass the base rule are pooled by language, then altogether, and
without MIN_ROWS there nothing is rejected; repeated rows count each; an empty table gives no rows; texts of any length are
read whole; columns besides doc_id, text, lang and source are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import in_arrow, sliced, total, written

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
STOPS = b".,!?;:"
WINDOW = 5
#: The transformed statistics and the standard deviation that is added to each, so a constant statistic can't decide alone.
STATISTICS = {"log_words": 0.1, "log_word_length": 0.05, "symbols": 0.1, "capitals": 0.1, "stops": 0.1, "distinct": 0.05}
#: Vectors are whole numbers of this fraction of one.
UNIT = 256
SHARE = 0.75
STEPS = 6
MIN_ROWS = 60
#: Seeded parts of a group that steps start from, each of one in PART of its rows.
DRAWS, PART = 2, 8
#: Chi-square of as many degrees as there are statistics, at 0.999 and in the middle; times the quartiles' range to the fence.
CHI_SQUARE, FENCE = 22.458, 2.5
NORMAL_MEDIAN = 5.348
#: Bins of distance for every doubling.
_BINS = 16
_LOW_BIN, _HIGH_BIN = -5 * _BINS, 25 * _BINS


def base_counts(text: str | None) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, capitals, stops, distinct words of a whole text."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - sum(map(len, words))
    counted = lambda kind: len(raw) - len(raw.translate(None, kind))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) != len(windows):
            times = Counter(windows)
            until = 0
            for at, window in enumerate(windows):
                if times[window] > 1:
                    repeated += at + WINDOW - max(at, until)
                    until = at + WINDOW
    return n, len(text) - spaces, counted(SYMBOLS), len(lines) - len(set(lines)), repeated, counted(UPPER), counted(STOPS), len(set(words))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed and x, the transformed vector in units of 1 / UNIT."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts = np.array([base_counts(t) for t in batch.column(3).to_pylist()], dtype=np.int64).reshape(-1, 8)
            n = np.maximum(counts[:, 0], 1)
            x = np.stack([np.log(n), np.log(np.maximum(counts[:, 1], 1) / n), np.log1p(20 * counts[:, 2] / n), np.log1p(5 * counts[:, 5] / n), np.log1p(5 * counts[:, 6] / n), counts[:, 7] / n], axis=1)
            vectors = pa.array(list(np.rint(x * UNIT).astype(np.int64)), pa.list_(pa.int64()))
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), vectors], ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "x"])

    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, x array<long>"
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")), work, schema)


def grouped(rows: DataFrame) -> DataFrame:
    """Adds grp: language and source, or what a small group is pooled into; null where even that is too small."""
    fine, coarse = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}), F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    rows = rows.withColumns({"__fine": fine, "__coarse": coarse})
    sizes = rows.where("NOT base_failed").groupBy("__fine", "__coarse").agg(F.count("*").alias("n"))
    small = F.col("n") < MIN_ROWS
    by_lang, by_all = Window.partitionBy("__coarse"), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.withColumn("of_lang", F.sum(F.when(small, F.col("n"))).over(by_lang))
    pooled = small & (F.col("of_lang") < MIN_ROWS)
    sizes = sizes.withColumn("of_all", F.sum(F.when(pooled, F.col("n"))).over(by_all))
    name = F.when(~small, F.col("__fine")).when(~pooled, F.col("__coarse")).when(F.col("of_all") >= MIN_ROWS, F.lit("{}"))
    names = written(sizes.select(F.col("__fine").alias("__name"), name.alias("grp")), "rules-groups")
    return rows.join(names, F.col("__fine") == F.col("__name"), "left").drop("__fine", "__coarse", "__name")


def _start(rows: DataFrame) -> DataFrame:
    """grp, start (0), mu, whiten from medians and quartiles, exact in the vectors' units."""
    bins = rows.select("grp", F.posexplode("x").alias("k", "v")).groupBy("grp", "k", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("grp", "k").orderBy("v")
    cum = bins.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("grp", "k"))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("v")))
    quartiles = cum.groupBy("grp", "k").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    floors = F.array(*[F.lit(v) for v in STATISTICS.values()])
    deviation = F.sqrt(F.pow((F.col("q3") - F.col("q1")) / UNIT / 1.349, F.lit(2)) + F.pow(F.element_at(floors, F.col("k") + 1), F.lit(2)))
    one = quartiles.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("q2") / UNIT).alias("m"), deviation.alias("s")))).alias("c"))
    p = len(STATISTICS)
    diagonal = F.array(*[(1 / F.col("c")[i]["s"]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)])
    return one.select("grp", F.lit(0).alias("start"), F.transform("c", lambda c: c["m"]).alias("mu"), diagonal.alias("whiten"))


def _sums() -> list[Column]:
    p = len(STATISTICS)
    first = [F.sum(F.col("x")[i]) for i in range(p)]
    second = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(p) for j in range(i + 1)]
    return [F.count("*").alias("n"), F.array(*first).alias("sums"), F.array(*second).alias("products")]


def _moments(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse Cholesky factor and log determinant of the covariance, from sums in whole numbers."""
    p = len(STATISTICS)
    mu = sums.astype(np.float64) / n / UNIT
    cov = np.zeros((p, p))
    cov[np.tril_indices(p)] = products.astype(np.float64) / n / UNIT**2
    cov = np.tril(cov) + np.tril(cov, -1).T - np.outer(mu, mu) + np.diag(np.square(list(STATISTICS.values())))
    factor = np.linalg.cholesky(cov)
    return mu, np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())


def _moment_start(of_start: pd.DataFrame) -> pd.DataFrame:
    r = of_start.iloc[0]
    mu, whiten, _ = _moments(float(r["n"]), np.array(r["sums"]), np.array(r["products"]))
    return pd.DataFrame({"grp": [r["grp"]], "start": [r["start"]], "mu": [mu.tolist()], "whiten": [whiten.ravel().tolist()]})


def _starts(rows: DataFrame) -> DataFrame:
    """grp, start, mu, whiten: from medians (0), all rows (1) and seeded parts of them (2 on)."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda i: F.when(F.pmod(F.xxhash64(i, "x"), F.lit(PART)) == 0, i + 2))
    of = rows.select("grp", "x", F.explode(F.filter(F.concat(F.array(F.lit(1)), draws), lambda i: i.isNotNull())).alias("start"))
    moments = of.groupBy("grp", "start").agg(*_sums()).groupBy("grp", "start").applyInPandas(_moment_start, "grp string, start int, mu array<double>, whiten array<double>")
    return _start(rows).union(moments)


def _squared(p: int) -> Column:
    centred = [F.col("x")[j] / float(UNIT) - F.col("mu")[j] for j in range(p)]
    return total([F.pow(total([F.col("whiten")[i * p + j] * centred[j] for j in range(i + 1)]), F.lit(2)) for i in range(p)])


def _fit(of_start: pd.DataFrame) -> pd.DataFrame:
    """The estimate from the sums by bin of distance: of the nearest SHARE of a group, in whole bins. Of the distances it was
    given, the median over the normal one and the cut-off."""
    rows = of_start.sort_values("bin")
    n = rows["n"].to_numpy(np.float64)
    upto = n.cumsum()
    last = int(np.searchsorted(upto, SHARE * upto[-1])) + 1
    first = np.stack(rows["sums"].to_numpy())[:last].astype(object).sum(axis=0)
    second = np.stack(rows["products"].to_numpy())[:last].astype(object).sum(axis=0)
    mu, whiten, determinant = _moments(float(n[:last].sum()), first, second)
    q1, q2, q3 = (rows["bin"].iloc[int(np.searchsorted(upto, q * upto[-1]))] + 0.5 for q in (0.25, 0.5, 0.75))
    scale = 2.0 ** (q2 / _BINS) / NORMAL_MEDIAN
    cut = max(CHI_SQUARE * scale, 2.0 ** ((q3 + FENCE * (q3 - q1)) / _BINS))
    return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "start": [rows["start"].iloc[0]], "mu": [mu.tolist()], "whiten": [whiten.ravel().tolist()], "determinant": [determinant], "scale": [scale], "cut": [cut]})


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """grp, mu, whiten (inverse Cholesky factor of the covariance), determinant (its logarithm), scale (median of squared
    distances over the normal one), cut (squared distance beyond which a vector is rejected)."""
    rows = rows.where("NOT base_failed AND grp IS NOT NULL").select("grp", "x")
    now = written(_starts(rows), "rules-start")
    for step in range(steps + 1):
        apart = rows.join(now, "grp").withColumn("d", _squared(len(STATISTICS)))  # broadcast as long as groups are few, by their size
        binned = apart.withColumn("bin", F.floor(_BINS * F.log2(F.greatest("d", F.lit(2.0**-5)))).cast("int")).withColumn("bin", F.greatest(F.lit(_LOW_BIN), F.least("bin", F.lit(_HIGH_BIN))))
        fitted = binned.groupBy("grp", "start", "bin").agg(*_sums()).groupBy("grp", "start").applyInPandas(_fit, "grp string, start int, mu array<double>, whiten array<double>, determinant double, scale double, cut double")
        if step == steps - 1:  # of what the starts have led to, the least determinant
            best = Window.partitionBy("grp").orderBy("determinant", "start")
            fitted = fitted.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
        if step == steps:  # the last pass only measures the distances of the kept estimate
            fitted = now.drop("scale", "cut").join(fitted.select("grp", "scale", "cut"), "grp")
        now = written(fitted, "rules-step")
    return now


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, base counts, base_failed, distance (squared, over its group's cut-off; null where no estimate is), kept."""
    rows = written(grouped(written(statistics(docs), "rules-statistics")), "rules-rows")
    found = rows.join(estimates(rows), "grp", "left")
    distance = _squared(len(STATISTICS)) / F.col("cut")
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= 1, F.lit(True))
    return found.withColumn("distance", distance).withColumn("kept", kept).drop("grp", "start", "mu", "whiten", "determinant", "scale", "cut", "x")


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
