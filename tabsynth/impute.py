"""Filling of missing values. Statistics come from the first (training) table and are applied to all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsynth.features import category_lists, decode_categories, encode_categories
from tabsynth.metrics import moment_matrices
from tabsynth.moments import pattern_moments
from tabsynth.nearest import nearest_in_spaces
from tabsynth.ordered import BUFFER_ROWS, running_sums
from tabsynth.schema import CATEGORICAL, INDICATOR, NUMERICAL, infer_schema
from tabsynth.session import written
from tabsynth.tiles import blocks, tile_pairs

#: Pairs of patterns of known columns that neighbours are sought for by an index.
MOST_SPACES = 1_000
#: Patterns of gaps whose sums of products the driver holds.
MOST_PATTERNS = 2_000


def fill_values(df: DataFrame, cols: list[str]) -> dict:
    """Median of numerical and mode (least of ties) of other columns; None where all is missing.

    Up to BUFFER_ROWS rows it is one pass whose buffers hold the distinct values; larger tables count the values in a shuffle and
    find the middle ones by running sums. Both are exact.
    """
    kinds = infer_schema(df)
    if not cols:
        return {}
    if df.count() > BUFFER_ROWS:
        return _medians(df, [c for c in cols if kinds[c] == NUMERICAL]) | _modes(df, [c for c in cols if kinds[c] != NUMERICAL])
    row = df.agg(*[(F.median(c) if kinds[c] == NUMERICAL else F.mode(F.col(c), True)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"v{i}"] for i, c in enumerate(cols)}


def _value_counts(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """column (its place in cols), value and n of each distinct value."""
    long = df.select(*[F.col(f"`{c}`").cast(kind).alias(f"v{i}") for i, c in enumerate(cols)]).unpivot([], [f"v{i}" for i in range(len(cols))], "column", "value")
    return written(long.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "values")


def _medians(df: DataFrame, cols: list[str]) -> dict:
    if not cols:
        return {}
    placed = running_sums(_value_counts(df, cols, "double"), ["column"], "value", {"upto": "n"}, totals={"all": "n"})
    least = lambda k: F.min(F.when(F.col("upto") >= k, F.col("value")))
    rows = placed.groupBy("column").agg(((least(F.floor((F.col("all") + 1) / 2)) + least(F.ceil((F.col("all") + 1) / 2))) / 2).alias("m")).collect()
    found = {r["column"]: r["m"] for r in rows}
    return {c: found.get(f"v{i}") for i, c in enumerate(cols)}


def _modes(df: DataFrame, cols: list[str]) -> dict:
    if not cols:
        return {}
    best = _value_counts(df, cols, "string").groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
    found = {r["column"]: r["v"] for r in best.select("column", F.col("b.value").alias("v")).collect()}
    typed = df.sparkSession.range(1).select(*[F.lit(found.get(f"v{i}")).cast(df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return {c: typed[f"v{i}"] for i, c in enumerate(cols)}


def impute_simple(train: DataFrame, *others: DataFrame, keep: list[str] | None = None, missing: str | None = None) -> list[DataFrame]:
    """Median or mode of train. A text column without any value stays, or becomes `missing` if that is given."""
    cols = [c for c in train.columns if c not in (keep or [])]
    kinds, values = infer_schema(train), fill_values(train, cols)
    out = {}
    for c in cols:
        if values[c] is not None:
            out[c] = F.coalesce(F.col(c).cast("double") if kinds[c] == NUMERICAL else F.col(c), F.lit(values[c]))
        elif kinds[c] == CATEGORICAL and missing is not None:
            out[c] = F.coalesce(F.col(c).cast("string"), F.lit(missing))
    return [df.withColumns({c: x for c, x in out.items() if c in df.columns}) if out else df for df in (train, *others)]


def columns_with_missing(df: DataFrame) -> list[str]:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[f"n{i}"]]


def add_missing_indicators(df: DataFrame) -> DataFrame:
    """Filled, and for each column with missing values a boolean that says where they were."""
    marks = {INDICATOR + c: F.col(c).isNull() for c in columns_with_missing(df)}
    marked = df.withColumns(marks) if marks else df
    return impute_simple(marked, keep=list(marks))[0]


def impute_categorical_rf(train: DataFrame, *others: DataFrame, meta: dict[str, str], trees: int = 100, seed: int = 42, exclude: tuple[str, ...] = (), fold: bool = False) -> list[DataFrame]:
    """Missing categories predicted by a random forest on the numerical columns.

    No numerical columns: as they are (fold: the mode). No known value: 'Missing'. One known class: that one. The forest is fit on all known rows.
    """
    frames = [train, *others]
    numbers = [c for c, k in meta.items() if k == NUMERICAL and c in train.columns and c not in exclude]
    medians = fill_values(train, numbers)
    numbers = [c for c in numbers if medians[c] is not None]
    for c in [c for c, k in meta.items() if k == CATEGORICAL and c in train.columns]:
        if not any(df.where(F.col(c).isNull()).limit(1).count() for df in frames):
            continue
        values = category_lists(frames[0], [c])[c]
        text = F.col(c).cast("string")
        if not values:
            frames = [df.withColumn(c, F.coalesce(text, F.lit("Missing"))) for df in frames]
        elif len(values) == 1:
            frames = [df.withColumn(c, F.coalesce(text, F.lit(values[0]))) for df in frames]
        elif not numbers:
            if fold:
                mode = fill_values(frames[0], [c])[c]
                frames = [df.withColumn(c, F.coalesce(F.col(c), F.lit(mode))) for df in frames]
        else:
            inputs = {f"_x{i}": F.coalesce(F.col(n).cast("double"), F.lit(float(medians[n]))) for i, n in enumerate(numbers)}
            assembler = VectorAssembler(inputCols=list(inputs), outputCol="_features")
            known = assembler.transform(frames[0].where(F.col(c).isNotNull()).withColumns(inputs).withColumn("_text", text))
            indexer = StringIndexer(inputCol="_text", outputCol="_label", stringOrderType="alphabetAsc").fit(known)
            forest = RandomForestClassifier(labelCol="_label", featuresCol="_features", predictionCol="_said", probabilityCol="_p", rawPredictionCol="_r", numTrees=trees, seed=seed).fit(indexer.transform(known))
            back = IndexToString(inputCol="_said", outputCol="_value", labels=indexer.labels)
            done = []
            for df in frames:
                said = back.transform(forest.transform(assembler.transform(df.withColumns(inputs))))
                done.append(said.withColumn(c, F.coalesce(text, F.col("_value"))).select(*df.columns))
            frames = done
    return frames


def _coded(frames: list[DataFrame], meta: dict[str, str]) -> tuple[list[DataFrame], dict, list[str], list[str]]:
    numbers = [c for c, k in meta.items() if k == NUMERICAL and c in frames[0].columns]
    texts = [c for c, k in meta.items() if k == CATEGORICAL and c in frames[0].columns]
    lists = {c: v for c, v in category_lists(frames[0], texts).items() if v}
    coded = [encode_categories(df, list(lists), lists)[0].withColumns({c: F.col(c).cast("double") for c in numbers}) for df in frames]
    return coded, lists, numbers, [*numbers, *lists]


def _spaces(gaps: list[str], donors: list[str]) -> list[tuple[int, str, str, list[int], list[int]]]:
    """(number, gaps' pattern, donors' pattern, shared columns, columns to fill) of patterns of known (1) columns that can be compared."""
    out = []
    for q in gaps:
        for s in donors:
            shared = [i for i, (a, b) in enumerate(zip(q, s, strict=True)) if a == b == "1"]
            wanted = [i for i, (a, b) in enumerate(zip(q, s, strict=True)) if a == "0" and b == "1"]
            if shared and wanted:
                out.append((len(out), q, s, shared, wanted))
    return out


def _found_in_spaces(gaps: DataFrame, donors: DataFrame, spaces: list[tuple], key: str, vector: Column, width: int, k: int) -> DataFrame:
    """key, col, d, other, v: nearest donors by an index for each pair of patterns. Distances are scaled up for columns that aren't shared."""
    spark = gaps.sparkSession
    table = F.broadcast(spark.createDataFrame(spaces, "space int, q string, s string, shared array<int>, wanted array<int>"))
    shared = F.transform("shared", lambda i: F.get("_v", i))
    left = gaps.select(F.col(key).alias("key"), vector.alias("_v"), _pattern(vector).alias("q")).join(table, "q").select("space", "key", shared.alias("v"))
    right = donors.select(F.col(key).alias("key"), vector.alias("_v"), _pattern(vector).alias("s")).join(table, "s").select("space", "key", shared.alias("v"), F.col("_v").alias("extra"))
    near = nearest_in_spaces(left, right, k).join(table, "space").select("key", "shared", "wanted", F.explode("near").alias("n"))
    each = near.select("key", "shared", "n", F.explode("wanted").alias("col"))
    return each.select("key", "col", (F.col("n.d") * F.sqrt(F.lit(float(width)) / F.size("shared"))).alias("d"), F.col("n.other").alias("other"), F.get("n.extra", F.col("col")).alias("v"))


def _pattern(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda v: F.when(v.isNull(), F.lit("0")).otherwise(F.lit("1"))), "")


def _found_in_tiles(gaps: DataFrame, donors: DataFrame, key: str, vector: Column, kind: str, k: int) -> DataFrame:
    """The same by comparing all rows with gaps with all donors: for tables with very many patterns."""
    left, n = blocks(gaps, key, vector)
    right, m = blocks(donors, key, vector)

    def work(ka: np.ndarray, a: np.ndarray, kb: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        out = {"key": [], "col": [], "d": [], "other": [], "v": []}
        if len(a) and len(b):
            has_a, has_b = ~np.isnan(a), ~np.isnan(b)
            both = has_a.astype(float) @ has_b.T.astype(float)
            d = np.zeros((len(a), len(b)))
            for c in range(a.shape[1]):
                diff = np.where(has_a[:, c, None] & has_b[None, :, c], a[:, c, None] - b[None, :, c], 0.0)
                d += diff * diff
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(both > 0, np.sqrt(d * a.shape[1] / both), np.nan)
            for i, c in zip(*np.nonzero(~has_a), strict=True):
                ok = np.flatnonzero(has_b[:, c] & ~np.isnan(d[i]))
                ok = ok[np.argsort(d[i, ok], kind="stable")[:k]]
                out["key"] += [ka[i]] * len(ok)
                out["col"] += [int(c)] * len(ok)
                out["d"] += d[i, ok].tolist()
                out["other"] += kb[ok].tolist()
                out["v"] += b[ok, c].tolist()
        return pd.DataFrame(out).astype({"col": "int32", "d": "float64", "v": "float64"})

    return tile_pairs(left, right, n, m, work, f"key {kind}, col int, d double, other {kind}, v double")


def impute_knn(train: DataFrame, *others: DataFrame, meta: dict[str, str], key: str, k: int = 5, most_spaces: int = MOST_SPACES) -> list[DataFrame]:
    """Missing cells become the mean of the k nearest training rows that have the cell.

    Distances skip missing coordinates and are scaled up for them; columns are unscaled, categories are codes. Fewer
    donors: their mean; none at a usable distance: the column's mean. Rows with gaps and donors are compared by an index over the columns
    that both patterns of known columns share; beyond most_spaces pairs of patterns, in tiles of all pairs.
    """
    frames = [train, *others]
    coded, lists, _, cols = _coded(frames, {c: t for c, t in meta.items() if c != key})
    if not cols:
        return frames
    means = coded[0].agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    vector = F.array(*[F.col(c) + F.lit(0.0) for c in cols])
    kind = dict(train.dtypes)[key]
    patterns = lambda df: [r["p"] for r in df.select(_pattern(vector).alias("p")).distinct().limit(most_spaces + 1).collect()]
    known = patterns(coded[0])
    done = []
    for df, raw in zip(coded, frames, strict=True):
        gaps = df.where(F.exists(vector, lambda v: v.isNull()))
        asked = patterns(gaps)
        spaces = _spaces(asked, known) if len(asked) * len(known) <= most_spaces else None
        if spaces == []:  # nothing is missing, or nothing can be compared
            filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(means[f"m{i}"])) for i, c in enumerate(cols)}).select(*raw.columns)
            done.append(decode_categories(filled, lists))
            continue
        found = _found_in_spaces(gaps, coded[0], spaces, key, vector, len(cols), k) if spaces else _found_in_tiles(gaps, coded[0], key, vector, kind, k)
        best = F.slice(F.sort_array(F.collect_list(F.struct("d", "other", "v"))), 1, k)
        cells = found.groupBy("key", "col").agg(best.alias("x")).select("key", "col", F.expr("aggregate(x, 0D, (a, e) -> a + e.v) / size(x)").alias("v"))
        wide = cells.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("_cells")).withColumnRenamed("key", "_key")
        joined = df.join(wide, df[key] == wide["_key"], "left")
        filled = joined.withColumns({c: F.coalesce(F.col(c), F.try_element_at("_cells", F.lit(i)), F.lit(means[f"m{i}"])) for i, c in enumerate(cols)}).select(*raw.columns)
        done.append(decode_categories(filled, lists))
    return done


def bayesian_ridge(xx: np.ndarray, xy: np.ndarray, yy: float, n: float, turns: int = 300, tol: float = 1e-3) -> np.ndarray:
    """Weights from centred sums of products: the noise and weight precisions are those of greatest evidence."""
    values, vectors = np.linalg.eigh(xx)
    values, rot = np.clip(values, 0, None), vectors.T @ xy
    tiny = 1e-6
    alpha, lam, w = 1 / max(yy / n, tiny), 1.0, np.zeros(len(xy))
    for _ in range(turns):
        new = vectors @ (rot * alpha / (alpha * values + lam))
        gamma = float((alpha * values / (lam + alpha * values)).sum())
        error = max(yy - 2 * new @ xy + new @ xx @ new, 0.0)
        lam = (gamma + 2 * tiny) / (float(new @ new) + 2 * tiny)
        alpha = (n - gamma + 2 * tiny) / (error + 2 * tiny)
        stop = np.abs(new - w).sum() < tol
        w = new
        if stop:
            break
    return w


def chained_steps(moments: dict[str, np.ndarray], cols: int, order: list[int], largest: float, gaps: dict[int, int], max_iter: int, tol: float) -> list[tuple[int, np.ndarray, float]]:
    """(column, weights of all columns, constant) of each regression of each round, from the patterns' sums of products alone.

    A step makes a missing value a linear function of its row, so it changes its pattern's sums by a linear map: no row is read again.
    """
    moments, steps = {k: m.copy() for k, m in moments.items()}, []
    for _ in range(max_iter):
        before = sum(m[0] for m in moments.values())
        for c in order:
            whole = sum((m for k, m in moments.items() if k[c] == "1"), np.zeros((cols + 1, cols + 1)))
            n = whole[0, 0]
            rest = [x for x in range(cols) if x != c]
            mean = whole[0, 1:] / n
            cov = whole[1:, 1:] - n * np.outer(mean, mean)
            w = bayesian_ridge(cov[np.ix_(rest, rest)], cov[rest, c], cov[c, c], n)
            weights = np.zeros(cols)
            weights[rest] = w
            constant = float(mean[c] - weights @ mean)
            steps.append((c, weights, constant))
            change = np.eye(cols + 1)
            change[c + 1] = np.concatenate([[constant], weights])
            for k, m in moments.items():
                if k[c] == "0":
                    moments[k] = change @ m @ change.T
        after = sum(m[0] for m in moments.values())
        if all(abs(after[c + 1] - before[c + 1]) <= tol * max(largest, 1e-12) * max(1, gaps[c]) * 1e-3 for c in order):
            break
    return steps


def impute_iterative(train: DataFrame, *others: DataFrame, meta: dict[str, str], max_iter: int = 10, tol: float = 1e-3, most_patterns: int = MOST_PATTERNS) -> list[DataFrame]:
    """Chained equations: from the means, columns with the fewest gaps first, each regressed on all others, for some rounds.

    One pass gives the sums of products of each pattern of gaps; all rounds of regressions follow from them, and one more pass fills
    the gaps. Tables with more than most_patterns patterns are filled round by round instead.
    """
    frames = [train, *others]
    coded, lists, _, cols = _coded(frames, meta)
    row = coded[0].agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)], *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.max(F.abs(F.col(c))).alias(f"x{i}") for i, c in enumerate(cols)]).first() if cols else None
    at = {c: i for i, c in enumerate(cols)}
    cols = [c for c in cols if row[f"m{at[c]}"] is not None] if cols else []
    gaps = sorted((c for c in cols if row[f"n{at[c]}"]), key=lambda c: row[f"n{at[c]}"])
    if len(cols) < 2 or not (gaps or others):
        return frames
    means = np.array([row[f"m{at[c]}"] for c in cols])
    order, missing = [cols.index(c) for c in gaps or cols], {i: row[f"n{at[c]}"] for i, c in enumerate(cols)}
    largest = max(row[f"x{at[c]}"] or 0.0 for c in cols)
    moments = pattern_moments(coded[0], cols, means, most_patterns)
    if moments is None:
        done = _rounds(coded, cols, [cols[i] for i in order], dict(zip(cols, means.tolist(), strict=True)), largest, {c: missing[i] for i, c in enumerate(cols)}, max_iter, tol)
    else:
        steps = chained_steps(moments, len(cols), order, largest, missing, max_iter, tol)
        done = [_filled(df, cols, means, steps) for df in coded]
    return [decode_categories(df.select(*raw.columns), lists) for df, raw in zip(done, frames, strict=True)]


def _filled(df: DataFrame, cols: list[str], means: np.ndarray, steps: list[tuple[int, np.ndarray, float]]) -> DataFrame:
    """df with the steps taken in turn by each row's gaps."""

    @F.pandas_udf("array<double>")
    def fill(x: pd.Series) -> pd.Series:
        v = np.array(x.tolist(), float).reshape(len(x), len(cols)) - means
        gap = np.isnan(v)
        v = np.where(gap, 0.0, v)
        for c, weights, constant in steps:
            some = gap[:, c]
            if some.any():
                v[some, c] = v[some] @ weights + constant
        return pd.Series(list(v + means))

    whole = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    out = df.withColumn("_filled", F.when(F.exists(whole, lambda v: v.isNull()), fill(whole)))
    return out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.get("_filled", F.lit(i))) for i, c in enumerate(cols)}).drop("_filled")


def _rounds(coded: list[DataFrame], cols: list[str], order: list[str], means: dict[str, float], largest: float, missing: dict[str, int], max_iter: int, tol: float) -> list[DataFrame]:
    """The same with a pass of moments for each column, and a checkpoint for each round."""
    start = {c: F.coalesce(F.col(c), F.lit(means[c])) for c in cols}
    now = [df.withColumns({f"_was_{c}": F.col(c).isNull() for c in cols}).withColumns(start) for df in coded]
    for _ in range(max_iter):
        before = now[0]
        for c in order:
            rest = [x for x in cols if x != c]
            mean, cov, _ = moment_matrices(now[0].where(~F.col(f"_was_{c}")), [*rest, c])
            n = now[0].where(~F.col(f"_was_{c}")).count()
            w = bayesian_ridge(cov[:-1, :-1] * (n - 1), cov[:-1, -1] * (n - 1), cov[-1, -1] * (n - 1), n)
            said = sum((F.col(x) * float(v) for x, v in zip(rest, w, strict=True)), F.lit(float(mean[-1] - w @ mean[:-1])))
            now = [df.withColumn(c, F.when(F.col(f"_was_{c}"), said).otherwise(F.col(c))) for df in now]
        now = [df.checkpoint() for df in now]
        moved = now[0].agg(*[F.sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(order)]).first(), before.agg(*[F.sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(order)]).first()
        if all(abs(a - b) <= tol * max(largest, 1e-12) * max(1, missing[c]) * 1e-3 for a, b, c in zip(*moved, order, strict=True)):
            break
    return now


def impute_fold(train: DataFrame, test: DataFrame, meta: dict[str, str], method: str, target: str, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Categories by forest, then all but the target by method: iter, knn or mi (median and mode)."""
    own = {c: k for c, k in meta.items() if c not in (target, key)}
    train, test = impute_categorical_rf(train, test, meta=own, seed=seed, fold=True)
    if method == "iter":
        train, test = impute_iterative(train, test, meta=own)
    elif method == "knn":
        train, test = impute_knn(train, test, meta=own, key=key)
    else:
        train, test = impute_simple(train, test, keep=[target, key], missing="Missing")
    return train, test
