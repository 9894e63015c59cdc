"""Sums of products of many columns from Arrow batches: a task adds up matrices, and only sums of fixed size leave it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that one row of partial sums is dealt to before the last addition, so that none has a row from each task.
FAN = 64


def _summed(df: DataFrame, cols: list[str], work: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """key, sums: what work makes of batches (rows by columns, NaN where missing), added by key over the whole table."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, s in work(batch.to_numpy(float)).items():
                held[k] = held[k] + s if k in held else s
        yield pd.DataFrame({"key": pd.Series(list(held), dtype=object), "sums": pd.Series(list(held.values()), dtype=object)})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": rows["key"].iloc[:1], "sums": [np.sum(np.stack(rows["sums"].to_list()), 0)]})

    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    parts = numbers.mapInPandas(partial, "key string, sums array<double>").withColumn("fan", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    some = parts.groupBy("key", "fan").applyInPandas(add, "key string, sums array<double>")
    return some.groupBy("key").applyInPandas(add, "key string, sums array<double>")


def wide_matrices(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, covariances and correlations, pairwise complete, of any number of columns in one pass after the means.

    Columns are shifted by their means first, so that sums of products don't cancel. A row of each matrix is one partial sum.
    """
    d = len(cols)
    row = df.agg(*[F.avg(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(d)])

    def work(x: np.ndarray) -> dict[str, np.ndarray]:
        has = ~np.isnan(x)
        y, k = np.where(has, x - shift, 0.0), has.astype(float)
        stats = np.stack([k.T @ k, y.T @ k, (y * y).T @ k, y.T @ y], 1)  # of column i over rows that have j too
        return {str(i): stats[i].reshape(-1) for i in range(d)}

    n, s, q, p = (np.zeros((d, d)) for _ in range(4))
    for r in _summed(df, cols, work).collect():
        n[int(r["key"])], s[int(r["key"])], q[int(r["key"])], p[int(r["key"])] = np.array(r["sums"]).reshape(4, d)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = np.where(n > 1, (p - s * s.T / n) / (n - 1), 0.0)
        var = np.where(n > 1, (q - s * s / n) / (n - 1), 0.0)
        tiny = 1e-12 * np.where(n > 0, q / n, 0.0)
        scale = np.where((var > tiny) & (var.T > tiny.T), np.sqrt(np.maximum(var * var.T, 0)), 0.0)
        corr = np.where(scale > 0, cov / scale, 0.0)
        mean = np.where(np.diag(n) > 0, np.diag(s) / np.diag(n) + shift, np.nan)
    return mean, cov, corr


def pattern_moments(df: DataFrame, cols: list[str], shift: np.ndarray, most: int) -> dict[str, np.ndarray] | None:
    """For each pattern of known (1) and missing (0) columns: sums of products of (1, the columns less shift, missing ones 0). None beyond `most` patterns."""
    d = len(cols)

    def work(x: np.ndarray) -> dict[str, np.ndarray]:
        has = ~np.isnan(x)
        y = np.concatenate([np.ones((len(x), 1)), np.where(has, x - shift, 0.0)], 1)
        kinds, at = np.unique(has, axis=0, return_inverse=True)
        at = at.reshape(-1)
        return {"".join("01"[int(v)] for v in kind): (y[at == k].T @ y[at == k]).reshape(-1) for k, kind in enumerate(kinds)}

    patterns = df.select(F.concat(*[F.when(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")), F.lit("0")).otherwise(F.lit("1")) for c in cols]).alias("p")).distinct()
    if patterns.limit(most + 1).count() > most:
        return None
    return {r["key"]: np.array(r["sums"]).reshape(d + 1, d + 1) for r in _summed(df, cols, work).collect()}
