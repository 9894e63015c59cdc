"""Sampling, folds and splits. All draws come from hashes of keys, so results don't depend on partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsynth.ordered import number_within, ranked
from tabsynth.rand import draw, uniform


def class_counts(df: DataFrame, col: str) -> DataFrame:
    """The column's values and n, without missing ones."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def _resample(df: DataFrame, group: str, keys: list[str], seed: int) -> DataFrame:
    """Each group drawn with replacement to the largest one's size. Adds draw (from 1, in the group)."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n")).first()[0]
    if not most:
        return df.withColumn("draw", F.lit(1).cast("long")).limit(0)
    h = draw(seed, keys, "row")
    rows = number_within(df.withColumn("_h", h), [group], ["_h", *keys], "_rn", spread="_h")
    # the draws are made in blocks, so that no row is exploded into more than 10,000
    blocks = counts.select(group, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((most - 1) // 10_000).cast("long"))).alias("_b"))
    draws = blocks.select(group, "_n", F.explode(F.sequence(F.col("_b") * 10_000 + 1, F.least(F.lit(most), (F.col("_b") + 1) * 10_000))).alias("draw"))
    picks = draws.withColumn("_rn", 1 + F.floor(uniform(seed, [F.col(group)], F.col("draw")) * F.col("_n")))
    # the draws come from a few counts, so their size is taken for that of these: without the hint all of them would be broadcast
    picks = picks.select(F.col(group).alias("_g"), "draw", "_rn").hint("merge")
    return rows.join(picks, [rows[group].eqNullSafe(F.col("_g")), rows["_rn"] == picks["_rn"]]).select(*df.columns, "draw")


def oversample(df: DataFrame, target: str, keys: list[str], seed: int = 42, shuffle_rows: bool = False) -> DataFrame:
    """Every class of target, the largest too, drawn with replacement to the largest class's size. Rows without a class go.
    An unknown column leaves df as it is. Adds draw."""
    if target not in df.columns:
        return df
    out = _resample(df.where(F.col(target).isNotNull()), target, keys, seed)
    return shuffle(out, [*keys, "draw"], seed) if shuffle_rows else out


def oversample_multi(df: DataFrame, meta: dict[str, str], keys: list[str], seed: int = 42) -> DataFrame:
    """As oversample, on the tuple of all categorical columns, where missing is a value of its own."""
    cols = [c for c, kind in meta.items() if kind == "categorical" and c in df.columns]
    if not cols:
        return df
    if len(cols) == 1:
        return oversample(df, cols[0], keys, seed)
    group = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols]))
    return _resample(df.withColumn("_group", group), "_group", keys, seed).drop("_group")


def bootstrap(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows drawn with replacement; adds draw, from 0."""
    spark, count = df.sparkSession, df.count()
    if not count:
        return df.withColumn("draw", F.lit(0).cast("long")).limit(0)
    rows = number_within(df.withColumn("_h", draw(seed, keys, "row")), [], ["_h", *keys], "_rn", spread="_h").drop("_h")
    picks = spark.range(n).select(F.col("id").alias("draw"), (1 + F.floor(uniform(seed, [F.col("id")], "draw") * count)).alias("_rn"))
    return rows.join(picks, "_rn").select(*df.columns, "draw")


def kfold(df: DataFrame, k: int, repeats: int, keys: list[str], seed: int = 42) -> DataFrame:
    """df once for each repeat, with repeat and fold (0 to k - 1); folds differ by a row at most. Empty with fewer than k rows."""
    if df.count() < k:
        return _no_folds(df)
    parts = []
    for r in range(repeats):
        h = df.withColumn("_h", draw(seed, keys, r))
        parts.append(number_within(h, [], ["_h", *keys], "_rn", spread="_h").select(*df.columns, F.lit(r).alias("repeat"), ((F.col("_rn") - 1) % k).cast("int").alias("fold")))
    return reduce(DataFrame.unionByName, parts)


def stratified_kfold(df: DataFrame, target: str, k: int, repeats: int, keys: list[str], seed: int = 42) -> DataFrame:
    """As kfold within each class. Empty with fewer than 2 classes or a class of fewer than k rows; rows without class go."""
    df = df.where(F.col(target).isNotNull())
    few = class_counts(df, target).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).first()
    if few["c"] < 2 or few["n"] < k:
        return _no_folds(df)
    parts = []
    for r in range(repeats):
        h = df.withColumn("_h", draw(seed, keys, r))
        parts.append(number_within(h, [target], ["_h", *keys], "_rn", spread="_h").select(*df.columns, F.lit(r).alias("repeat"), ((F.col("_rn") - 1) % k).cast("int").alias("fold")))
    return reduce(DataFrame.unionByName, parts)


def _no_folds(df: DataFrame) -> DataFrame:
    return df.withColumns({"repeat": F.lit(0), "fold": F.lit(0)}).limit(0)


def stratified_split(df: DataFrame, label: str, test: float, keys: list[str], seed: int = 42) -> DataFrame:
    """df with is_test: of each class, the rows after the first round(n * (1 - test)) in hash order."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(label, "_l")
    rows = number_within(df.withColumn("_h", draw(seed, keys, "split")), [label], ["_h", *keys], "_rn", spread="_h")
    out = rows.join(counts, rows[label].eqNullSafe(counts["_l"]))
    return out.select(*df.columns, (F.col("_rn") > F.bround(F.col("_n") * F.lit(1 - test))).alias("is_test"))


def take_exact(df: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    """The first n rows in order: each task keeps n at most."""
    return df.orderBy(*order).limit(n)


def shuffle(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(draw(seed, keys, "shuffle"), *keys)


def augment(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Both tables' rows, with source; columns that one lacks are NULL there."""
    return real.withColumn("source", F.lit("real")).unionByName(synth.withColumn("source", F.lit("synthetic")), allowMissingColumns=True)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def rank_deciles(df: DataFrame, cols: list[str], keys: list[str], least_distinct: int = 20) -> DataFrame:
    """cols with more than least_distinct values become decile numbers 0 to 9 by rank; ties go by keys."""
    if not cols:
        return df
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    n, out = row["n"], df
    for i, c in enumerate(cols):
        if row[f"d{i}"] > least_distinct:
            out = _decile_column(out, c, keys, n)
    return out


def _decile_column(df: DataFrame, c: str, keys: list[str], n: int) -> DataFrame:
    rank = F.col("_rank")
    decile = F.greatest(F.ceil((rank - 1) * 10 / F.lit(float(max(n - 1, 1)))) - 1, F.lit(0)).cast("int")
    return ranked(df, [c, *keys], "_rank").withColumn(c, decile).select(*df.columns)
