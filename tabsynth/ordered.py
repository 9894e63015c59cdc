"""Numbering and running sums in order, at any size.

A window over a whole table puts it into one task. Here a grid of the order column's approximate quantiles cuts it
into ranges of some RANGE_ROWS rows; each range has its own window, and the ranges' totals, a small table, say where each begins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsynth.session import written

#: Rows of a range, about; and ranges at most, which percentile_approx tells apart.
RANGE_ROWS, MOST_RANGES = 200_000, 10_000
#: Rows whose distinct values one buffer may hold.
BUFFER_ROWS = 1_000_000


def range_count(df: DataFrame) -> int:
    """How many ranges a table of this size is cut into."""
    return min(MOST_RANGES, max(1, math.ceil(df.count() / RANGE_ROWS)))


def _values_below(grid: Column, value: Column, size: int) -> Column:
    """How many values of a sorted grid lie below value: found in every step-th value first, then among the step that is left."""
    step = math.isqrt(size) + 1
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size(grid), F.lit(step)), lambda i: F.element_at(grid, i)), lambda q: q < value))
    start = F.greatest(coarse - 1, F.lit(0)) * step
    return start + F.size(F.filter(F.slice(grid, start + 1, step), lambda q: q < value))


def range_number(df: DataFrame, by: list[str], order: str, ranges: int) -> DataFrame:
    """df with _range: the number of grid values below order (null: 0)."""
    if ranges < 2:
        return df.withColumn("_range", F.lit(0))
    grid = df.groupBy(*by).agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("_grid"))
    if by:
        joined = df.join(grid.withColumnsRenamed({c: f"_by_{c}" for c in by}), [df[c].eqNullSafe(F.col(f"_by_{c}")) for c in by], "left").drop(*[f"_by_{c}" for c in by])
    else:
        values = grid.first()["_grid"]
        joined = df.withColumn("_grid", F.lit(values) if values else F.lit(None).cast(f"array<{dict(df.dtypes)[order]}>"))
    at = _values_below(F.col("_grid"), F.col(order), ranges)
    return joined.withColumn("_range", F.when(F.col("_grid").isNull() | F.col(order).isNull(), F.lit(0)).otherwise(at)).drop("_grid")


def running_sums(df: DataFrame, by: list[str], order: str, sums: dict[str, str], following: str | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """df with, for each new column of sums, the sum of a column over the rows up to this one; following: the next order
    value; totals: the whole sum of a column within by. df is read more than once: pass a written table.

    The order column must have no ties within by (aggregate by it first).
    """
    cut, whole = range_number(df, by, order, range_count(df)), totals or {}
    small = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in (sums | whole).items()], F.min(order).alias("_least"))
    each = Window.partitionBy(*by).orderBy("_range")
    before, over_all = each.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    starts = small.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.sum(f"_t_{n}").over(over_all).alias(f"_a_{n}") for n in whole], F.lead("_least").over(each).alias("_next"))
    within = Window.partitionBy(*by, "_range").orderBy(order)
    out = cut.withColumns({n: F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()})
    if following:
        out = out.withColumn(following, F.lead(order).over(within))
    keys = {c: f"_k_{c}" for c in [*by, "_range"]}
    out = out.join(starts.withColumnsRenamed(keys), [out[c].eqNullSafe(F.col(k)) for c, k in keys.items()])
    done = {n: F.col(n) + F.col(f"_b_{n}") for n in sums} | {n: F.col(f"_a_{n}") for n in whole}
    if following:
        done[following] = F.coalesce(following, "_next")
    return out.withColumns(done).select(*df.columns, *done)


def number_within(df: DataFrame, by: list[str], order: list[str | Column], name: str = "rn", spread: str | Column | None = None) -> DataFrame:
    """df with name: each row's place in its group, from 1, by order (nulls first, as it is given).

    spread: an integer column from 0 below 2^32 that order begins with, such as a hash. With it a group is cut into
    ranges of equal width, so that a large group isn't numbered in one task. Without it each group is one task's work, and there must be groups.
    """
    if spread is None:
        if not by:
            raise ValueError("a whole table is numbered by a spread column")
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    cut = df.withColumn("_range", F.floor((F.col(spread) if isinstance(spread, str) else spread) * range_count(df) / F.lit(2.0**32)).cast("int"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*by, "_range").count().select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_range").alias("_k_range"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    numbered = cut.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    same = [numbered[c].eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col("_range") == F.col("_k_range")]
    return numbered.join(starts, same).withColumn(name, F.col(name) + F.col("_from")).select(*df.columns, name)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name: each row's place in the order of all these columns, from 1.

    Ranges are cut by all of them and by the place in the table, so a value that most rows share is spread like any other.
    """
    ranges, by = range_count(df), [*order, "_at"]
    if ranges < 2:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
    df = df if hasattr(df, "written_path") else written(df, "rows")  # places in a written table don't change
    dealt = df.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    placed = written(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of as many rows as there are ranges
    sizes = placed.groupBy("_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)


def quantiles(df: DataFrame, col: str, probs: list[float], buffer_rows: int = BUFFER_ROWS) -> list[float] | None:
    """Exact quantiles with linear interpolation of a column of doubles without nulls; None without rows.

    Up to buffer_rows rows one buffer holds the distinct values; of more, values are counted in a shuffle and the ranks found by running sums.
    """
    n = df.count()
    if not n:
        return None
    if n <= buffer_rows:
        return df.agg(F.percentile(col, F.array(*[F.lit(float(p)) for p in probs])).alias("q")).first()["q"]
    counts = written(df.groupBy(F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("n")), "values")
    upto = running_sums(counts, [], "x", {"upto": "n"})
    places = [p * (n - 1) for p in probs]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    row = upto.agg(*[F.min(F.when(F.col("upto") > r, F.col("x"))).alias(f"r{r}") for r in ranks]).first()
    return [row[f"r{math.floor(p)}"] + (p - math.floor(p)) * (row[f"r{math.ceil(p)}"] - row[f"r{math.floor(p)}"]) for p in places]
