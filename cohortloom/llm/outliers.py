"""Quality rules: base rules on words and lines, then robust multivariate outliers by language and source.

Each text becomes a vector of transformed statistics. For every (language, source) the minimum covariance determinant
estimates mean and scatter: concentration steps keep the share ``core`` of rows with the smallest Mahalanobis distance
and estimate again, from two starts, and the smaller determinant wins. A step is one aggregate over all rows: distances
are counted and summed in fixed bins of their logarithm, the bins up to the core share are added up, and nothing but
those sums leaves the map side, so a source of any size is no single task's work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.common import written

WINDOW = 8
_SPACE = b" \t\n\v\f\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]
COUNT_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_NUMBERS = T.ArrayType(T.DoubleType())
FIT_TYPE = T.StructType([
    T.StructField("mean", _NUMBERS), T.StructField("inverse", _NUMBERS), T.StructField("log_det", T.DoubleType())
])
#: Transformed statistics with the least spread each is given, so that a rare mark in a uniform group is no outlier.
STATISTICS = {"length": 0.08, "symbols": 0.6, "dup_lines": 0.6, "repeats": 0.8, "upper": 0.08, "marks": 0.08}
#: Squared distance beyond which a row is an outlier; normal rows of six statistics exceed it about seven times in a million.
CUTOFF = 34.0
_BINS, _LOW, _HIGH = 400, -6.0, 14.0


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    mix = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    code = np.zeros(n, np.uint64)
    for k in range(window):
        code = (code ^ mix[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(32)
    order = np.sort(code)
    if not (order[1:] == order[:-1]).any():  # different codes are different windows
        return 0
    seen: dict[bytes, list[int]] = {}
    twice = np.isin(code, order[1:][order[1:] == order[:-1]])
    for at in np.flatnonzero(twice).tolist():
        seen.setdefault(ids[at : at + window].tobytes(), []).append(at)
    covered = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            covered[places] += 1
            covered[np.array(places) + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of one text."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACE)]
    bare = len(raw.translate(None, _SPACE))
    return (
        len(words), len(raw.decode()) - (len(raw) - bare), len(raw) - len(raw.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)), repeated_words(words), len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, b"!?.,;:")),
    )


@F.pandas_udf(COUNT_TYPE)
def text_counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_text(t) for t in texts], columns=COUNTS, dtype="int64")


# Else a filter on the counts is pushed below them with a call of its own: every text is then counted twice, by two Python
# workers at once for each task, and executors keep all the workers that they have started.
text_counts = text_counts.asNondeterministic()


def base_failed(c: Column, least_words: int = 20, most_repeated: int = 30) -> Column:
    return (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeated * c["n_words"])


def statistics(c: Column) -> list[Column]:
    """The transformed statistics of counts: logarithms of rates and shares, each zero for a text without words."""
    words = F.greatest(c["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(c["word_chars"], F.lit(1)).cast("double")
    rate = lambda name: F.log1p(100 * c[name] / words)
    return [
        F.log(chars / words), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words"),
        F.sqrt(c["n_upper"] / chars), F.sqrt(c["n_marks"] / chars),
    ]


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """Mean, inverse scatter and log determinant of each row of sums; spreads are held at their floors."""
    floor = np.array(list(STATISTICS.values()))
    p, out = len(floor), []
    for n, sums, products in zip(rows["n"], rows["sums"], rows["products"], strict=True):
        mean = np.array(sums, float) / n
        scatter = np.zeros((p, p))
        scatter[np.triu_indices(p)] = np.array(products, float) / n
        scatter = np.triu(scatter) + np.triu(scatter, 1).T - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(scatter), 0))
        held = np.maximum(spread, floor)
        share = n / (n + 10.0 * p)  # small groups lean on the floors
        scatter = share * scatter * np.outer(spread > 0, spread > 0)
        scatter[np.diag_indices(p)] = np.maximum(np.diag(scatter), held**2)
        out.append((mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
    return pd.DataFrame(out, columns=["mean", "inverse", "log_det"])


@F.pandas_udf(FIT_TYPE)
def _estimate(n: pd.Series, sums: pd.Series, products: pd.Series) -> pd.DataFrame:
    return _solve(pd.DataFrame({"n": n, "sums": sums, "products": products}))


def distance(x: list[Column], fit: Column) -> Column:
    """Squared Mahalanobis distance."""
    p = len(x)
    off = [x[i] - fit["mean"][i] for i in range(p)]
    terms = [off[i] * off[j] * fit["inverse"][i * p + j] for i in range(p) for j in range(p)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))


def _sums(x: list[Column]) -> list[Column]:
    p = len(x)
    return [
        F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("sums"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p)]).alias("products"),
    ]


def robust_fits(rows: DataFrame, core: float = 0.75, steps: int = 6) -> DataFrame:
    """``lang``, ``source`` and ``fit`` (mean, inverse, log_det), from rows of ``lang``, ``source`` and ``x``.

    The starts are all rows of the group, and the rows nearest to the group's bin-wise median of each statistic.
    """
    p = len(STATISTICS)
    x = [F.col("x")[i] for i in range(p)]
    keys = ["lang", "source", "start"]
    floor = list(STATISTICS.values())

    def fitted(sums: DataFrame) -> DataFrame:
        return written(sums.select(*keys, _estimate("n", "sums", "products").alias("fit")), "fits")

    whole = rows.groupBy("lang", "source").agg(*_sums(x)).withColumn("start", F.lit(0))
    middle = rows.groupBy("lang", "source").agg(*[F.percentile_approx(x[i], 0.5, 1000).alias(f"m{i}") for i in range(p)])
    plain = [float(i == j) / floor[i] ** 2 for i in range(p) for j in range(p)]
    middle = middle.select(
        "lang", "source", F.lit(1).alias("start"),
        F.struct(
            F.array(*[f"m{i}" for i in range(p)]).alias("mean"), F.array(*map(F.lit, plain)).alias("inverse"),
            F.lit(0.0).alias("log_det"),
        ).alias("fit"),
    )
    fits = fitted(whole).unionByName(written(middle, "fits"))
    for _ in range(steps):
        f = fits.select(F.col("lang").alias("l"), F.col("source").alias("s"), "start", "fit")
        near = rows.join(f, rows["lang"].eqNullSafe(f["l"]) & rows["source"].eqNullSafe(f["s"])).drop("l", "s")
        scale = (F.log(distance(x, F.col("fit")) + 1e-12) - _LOW) * (_BINS / (_HIGH - _LOW))
        binned = near.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(_BINS), scale)).cast("int"))
        bins = binned.groupBy(*keys, "bin").agg(*_sums(x))
        upto = Window.partitionBy(*keys).orderBy("bin")
        bins = bins.withColumn("before", F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        bins = bins.withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
        inner = bins.where(F.col("before") < F.lit(core) * F.col("all"))
        size = p * (p + 1) // 2
        added = inner.groupBy(*keys).agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(p)]).alias("sums"),
            F.array(*[F.sum(F.col("products")[i]) for i in range(size)]).alias("products"),
        )
        fits = fitted(added)
    best = fits.groupBy("lang", "source").agg(F.min_by("fit", F.struct("fit.log_det", "start")).alias("fit"))
    return best


def _name(col: str) -> Column:
    return F.col(f"`{col}`").cast("string")


def screened(
    docs: DataFrame, core: float = 0.75, cutoff: float = CUTOFF, lang_col: str = "lang", source_col: str = "source",
    text_col: str = "text", into: str = "outlier",
) -> DataFrame:
    """``docs`` with one more column ``into``: a struct of ``counts``, ``base_failed``, ``distance`` and ``kept``.

    ``kept`` is false for rows that fail the base rules or lie farther than ``cutoff`` (squared distance, scaled to the
    core) from their (language, source); null languages and sources are groups of their own. Rows that fail the base
    rules take no part in the estimates; a group of which all fail has no estimate and needs none. Null and empty texts
    have no words and fail. Repeated rows count each; an empty table gives an empty result. All columns are kept; ``into``
    replaces a column of that name.
    """
    counted = docs.withColumn(into, text_counts(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    c = F.col(into)
    vectors = counted.where(~base_failed(c)).select(
        _name(lang_col).alias("lang"), _name(source_col).alias("source"), F.array(*statistics(c)).alias("x")
    )
    fits = written(robust_fits(written(vectors, "statistics"), core), "fits")
    return _judged(counted, fits, cutoff, lang_col, source_col, into)


def _judged(counted: DataFrame, fits: DataFrame, cutoff: float, lang_col: str, source_col: str, into: str) -> DataFrame:
    f = fits.select(F.col("lang").alias("_fit_lang"), F.col("source").alias("_fit_source"), F.col("fit").alias("_fit"))
    joined = counted.join(
        f, _name(lang_col).eqNullSafe(F.col("_fit_lang")) & _name(source_col).eqNullSafe(F.col("_fit_source")), "left"
    )
    c = F.col(into)
    failed, far = base_failed(c), distance(statistics(c), F.col("_fit"))
    verdict = F.struct(
        c.alias("counts"), failed.alias("base_failed"), far.alias("distance"),
        (~failed & F.coalesce(far <= cutoff, F.lit(False))).alias("kept"),
    )
    return joined.withColumn(into, verdict).drop("_fit_lang", "_fit_source", "_fit")


def document_verdicts(docs: DataFrame, core: float = 0.75, cutoff: float = CUTOFF, id_col: str = "doc_id") -> DataFrame:
    """Per document: ``doc_id``, the counts, ``base_failed``, ``kept`` and ``distance``. Texts are counted once, and only
    counts are kept for the estimates and the verdicts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = written(
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), "lang", "source", text_counts(text).alias("outlier")), "counts"
    )
    c = F.col("outlier")
    vectors = counted.where(~base_failed(c)).select(
        _name("lang").alias("lang"), _name("source").alias("source"), F.array(*statistics(c)).alias("x")
    )
    judged = _judged(counted, written(robust_fits(vectors, core), "fits"), cutoff, "lang", "source", "outlier")
    return judged.select(
        "doc_id", *[F.col(f"outlier.counts.{c}").alias(c) for c in COUNTS[:5]], "outlier.base_failed", "outlier.kept", "outlier.distance"
    )
