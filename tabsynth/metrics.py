"""Comparison of a real table with a synthetic one: distributions, moments, bounds.

Results are long (metric, column, value) or one-row frames. Only moments, ranges and category lists reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsynth.moments import wide_matrices
from tabsynth.ordered import running_sums
from tabsynth.schema import CATEGORICAL, NUMERICAL, nan_to_null, numeric_columns
from tabsynth.session import written

#: Columns whose pairs are aggregates of one expression.
WIDE = 24


_kept: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def keep(df: DataFrame) -> DataFrame:
    """df, of which limits, moments and counts of values are found once, for a table that many others are compared with."""
    _kept.setdefault(df, {})
    return df


def _once(df: DataFrame, what: tuple, make: Callable[[], Any]) -> Any:
    found = _kept.get(df)
    if found is None:
        return make()
    if what not in found:
        found[what] = make()
    return found[what]


def exact_mean(col: str) -> Column:
    """The mean of a column as decimals of 16 places, so that it doesn't depend on the order of adding: a mean that lies on a limit stays there.

    Groups with values that have no such decimal (NaN, infinite, 1e12 and beyond) get the mean of doubles.
    """
    number = F.col(col)
    exact = number.try_cast("decimal(28,16)")
    return F.when(F.count(exact) == F.count(number), F.avg(exact).cast("double")).otherwise(F.avg(number.cast("double")))


def _sides(real: DataFrame, synth: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """column, value, r, s: how often each value occurs on each side. Missing values are left out."""
    if real in _kept:
        known = _once(real, ("counts", kind, *cols), lambda: written(_values(real, cols, kind, 1).groupBy("column", "value").agg(F.sum("_real").alias("r")), "counts"))
        both = known.withColumn("s", F.lit(0).cast("long")).unionByName(_values(synth, cols, kind, 0).select("column", "value", F.lit(0).cast("long").alias("r"), F.lit(1).cast("long").alias("s")))
        return both.groupBy("column", "value").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    long = _values(real, cols, kind, 1).unionByName(_values(synth, cols, kind, 0))
    return long.groupBy("column", "value").agg(F.sum("_real").alias("r"), F.sum(1 - F.col("_real")).alias("s"))


def _values(df: DataFrame, cols: list[str], kind: str, side: int) -> DataFrame:
    part = nan_to_null(df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c in cols])).withColumn("_real", F.lit(side))
    long = part.unpivot("_real", [f"`{c}`" for c in cols], "column", "value").where("value is not null")
    return long.withColumn("value", F.col("value") + F.lit(0.0)) if kind == "double" else long  # -0.0 is 0.0


def ecdf_pair(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """column, value, real_cdf, synth_cdf, following (the next value) over the merged values of both sides."""
    counts = written(_sides(real, synth, cols, "double"), "counts")
    summed = running_sums(counts, ["column"], "value", {"cr": "r", "cs": "s"}, "following", {"nr": "r", "ns": "s"})
    return summed.select("column", "value", F.try_divide("cr", "nr").alias("real_cdf"), F.try_divide("cs", "ns").alias("synth_cdf"), "following")


def _ks(cdf: DataFrame) -> DataFrame:
    return cdf.groupBy("column").agg((1 - F.max(F.abs(F.col("real_cdf") - F.col("synth_cdf")))).alias("value"))


def _w1(cdf: DataFrame) -> DataFrame:
    return cdf.groupBy("column").agg(F.sum(F.abs(F.col("real_cdf") - F.col("synth_cdf")) * (F.coalesce("following", "value") - F.col("value"))).alias("value"))


def ks_complement(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """column, value: 1 - the greatest distance of the two empirical distributions. NULL if a side has no values."""
    return _ks(ecdf_pair(real, synth, cols))


def tv_complement(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """column, value: 1 - half the summed differences of the shares; a side without values has share 0 of all."""
    counts = _sides(real, synth, cols, "string")
    totals = counts.groupBy("column").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"))
    share = lambda n, t: F.coalesce(F.try_divide(F.col(n), F.col(t)), F.lit(0.0))
    return counts.join(F.broadcast(totals), "column").groupBy("column").agg((1 - 0.5 * F.sum(F.abs(share("r", "nr") - share("s", "ns")))).alias("value"))


def marginals(real: DataFrame, synth: DataFrame, meta: dict[str, str]) -> DataFrame:
    """metric, column, value: KS for numerical and TV for categorical columns that both tables have, and their mean as Marginal."""
    cols = [c for c in meta if c in real.columns and c in synth.columns]
    parts = []
    if number := [c for c in cols if meta[c] == NUMERICAL]:
        parts.append(ks_complement(real, synth, number))
    if other := [c for c in cols if meta[c] == CATEGORICAL]:
        parts.append(tv_complement(real, synth, other))
    if not parts:
        raise ValueError("no common column")
    each = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _with_mean(each)


def _with_mean(each: DataFrame) -> DataFrame:
    rows = each.rollup("column").agg(F.avg("value").alias("value"))
    return rows.select(F.when(F.col("column").isNull(), F.lit("Marginal")).otherwise(F.lit("marginal")).alias("metric"), F.coalesce("column", F.lit("")).alias("column"), "value")


def wasserstein(real: DataFrame, synth: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One row, wd_score: the mean over numerical columns of the area between the two distributions."""
    return _w1(ecdf_pair(real, synth, numeric_columns(meta, real, synth))).agg(F.avg("value").alias("wd_score"))


def boundary_adherence(real: DataFrame, synth: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One row, boundary_score: mean share of synthetic rows within the real range; a missing value is outside."""
    cols = numeric_columns(meta, real, synth)
    if not cols:
        return synth.sparkSession.range(1).select(F.lit(1.0).alias("boundary_score"))
    synth = nan_to_null(synth)
    limit = _once(real, ("limits", *cols), lambda: nan_to_null(real).agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]).first())
    inside = [F.coalesce(F.col(c).cast("double").between(limit[f"lo{i}"], limit[f"hi{i}"]), F.lit(False)).cast("int") for i, c in enumerate(cols)]
    return synth.agg((sum((F.avg(x) for x in inside), F.lit(0.0)) / len(cols)).alias("boundary_score"))


def pairwise_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, n, mean_a, mean_b, var_a, var_b (n - 1 below), cov of each pair of columns a <= b, over rows that have both.

    One pass, with partial sums in each task; the covariances are the engine's own, which don't cancel.
    """
    df = nan_to_null(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]))
    out = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
            out.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), F.var_samp(x).alias("var_a"), F.var_samp(y).alias("var_b"), F.covar_samp(x, y).alias("cov")))
    return df.agg(F.array(*out).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def moment_matrices(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, covariances, correlations (0 where undefined), pairwise complete; d by d numbers.

    Up to WIDE columns the engine's own aggregates give them; of more, matrix products of batches do (see moments).
    """
    return _once(df, ("moments", *cols), lambda: _matrices(df, cols))


def _matrices(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(cols) > WIDE:
        return wide_matrices(nan_to_null(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])), cols)
    d, place = len(cols), {c: i for i, c in enumerate(cols)}
    mean, cov, corr = np.zeros(d), np.zeros((d, d)), np.zeros((d, d))
    for r in pairwise_moments(df, cols).collect():
        i, j = place[r["a"]], place[r["b"]]
        if i == j:
            mean[i] = r["mean_a"] if r["mean_a"] is not None else np.nan
        cov[i, j] = cov[j, i] = r["cov"] if r["cov"] is not None else 0.0
        # partial sums of a constant can differ in the last digit of its mean, which is no variance
        var = [r[f"var_{x}"] or 0.0 for x in "ab"]
        scale = var[0] * var[1] if all(v > 1e-24 * (r[f"mean_{x}"] or 0.0) ** 2 for v, x in zip(var, "ab", strict=True)) else 0.0
        corr[i, j] = corr[j, i] = r["cov"] / np.sqrt(scale) if scale > 0 else 0.0
    return mean, cov, corr


def _row(df: DataFrame, **values: float | None) -> DataFrame:
    return df.sparkSession.range(1).select(*[F.lit(None if v is None else float(v)).cast("double").alias(k) for k, v in values.items()])


def correlation_similarity(real: DataFrame, synth: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One row, corr_score: 1 - the sum of absolute differences of the correlations / (d^2 - d)."""
    cols = numeric_columns(meta, real, synth)
    d = len(cols)
    if d < 2:
        return _row(real, corr_score=1.0)
    diff = np.abs(moment_matrices(real, cols)[2] - moment_matrices(synth, cols)[2]).sum()
    return _row(real, corr_score=1 - diff / (d * d - d))


def scales(ref: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and sample standard deviation of each column."""
    if not cols:
        return {}
    row = nan_to_null(ref).agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standardized(c: str, scale: tuple[float | None, float | None]) -> Column:
    mean, std = scale
    if mean is None or not std:
        return F.lit(0.0)
    return F.coalesce((F.col(c).cast("double") - mean) / std, F.lit(0.0))


def standardize_by(ref: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """df with cols in units of ref's mean and standard deviation; missing values and constant columns become 0."""
    found = scales(ref, cols)
    return nan_to_null(df).withColumns({c: standardized(c, found[c]) for c in cols}) if cols else df


def covariance_similarity(real: DataFrame, synth: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One row, cov_score: 1 - the Frobenius norm of the covariances' difference over the real one's, at least 0."""
    cols = numeric_columns(meta, real, synth)
    a = moment_matrices(standardize_by(real, real, cols), cols)[1]
    b = moment_matrices(standardize_by(real, synth, cols), cols)[1]
    norm = np.linalg.norm(a)
    return _row(real, cov_score=max(0.0, 1 - np.linalg.norm(a - b) / norm) if norm else 0.0)


def frechet(real: DataFrame, synth: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One row, fd_score: |mean difference|^2 + trace of both covariances - 2 trace of the root of their product."""
    cols = numeric_columns(meta, real, synth)
    (m1, s1, _), (m2, s2, _) = moment_matrices(real, cols), moment_matrices(synth, cols)
    root = np.sqrt(np.clip(np.linalg.eigvals(s1 @ s2).real, 0, None)).sum()
    return _row(real, fd_score=float(((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * root))


def classification_scores(pred: DataFrame, by: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """by, accuracy, balanced_accuracy, f1_macro of predictions, from their confusion counts."""
    cells = pred.groupBy(*by, F.col(label).cast("string").alias("t"), F.col(prediction).cast("string").alias("p")).count()
    sides = cells.select(*by, F.col("t").alias("k"), F.col("count").alias("true"), F.lit(0).alias("said"), F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0).alias("hit")).unionByName(cells.select(*by, F.col("p").alias("k"), F.lit(0).alias("true"), F.col("count").alias("said"), F.lit(0).alias("hit")))
    each = sides.groupBy(*by, "k").agg(*[F.sum(c).alias(c) for c in ("true", "said", "hit")])
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("true") + F.col("said")), F.lit(0.0))
    return each.groupBy(*by).agg((F.sum("hit") / F.sum("true")).alias("accuracy"), F.avg(F.when(F.col("true") > 0, F.col("hit") / F.col("true"))).alias("balanced_accuracy"), F.avg(f1).alias("f1_macro"))


def roc_auc(pred: DataFrame, by: list[str], positive: str = "positive", score: str = "score") -> DataFrame:
    """by, roc_auc: from mid-ranks of the scores. positive: boolean. NULL with one class only."""
    counts = pred.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.count_if(positive if isinstance(positive, Column) else F.col(positive)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    summed = running_sums(written(counts, "counts"), by, "_s", {"_cn": "_n"})
    rank = F.col("_cn") - (F.col("_n") - 1) / 2
    p, n = F.sum("_p"), F.sum(F.col("_n") - F.col("_p"))
    return summed.groupBy(*by).agg(F.try_divide(F.sum(F.col("_p") * rank) - p * (p + 1) / 2, (p * n).cast("double")).alias("roc_auc"))


def regression_scores(pred: DataFrame, by: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """by, mae, rmse, r2, mape (percent, the label's size at least 1e-8)."""
    y, e = F.col(label).cast("double"), F.col(prediction).cast("double") - F.col(label).cast("double")
    return pred.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), (100 * F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(1e-8)))).alias("mape"),
    )
