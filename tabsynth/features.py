"""Scalar preparation of columns: codes, one-hot columns, precision, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsynth.schema import infer_schema

MISSING_TARGET = "__MISSING_TARGET__"


def category_lists(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values as text of each column, without missing ones. As many as there are categories reach the driver."""
    if not cols:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"c{i}"] for i, c in enumerate(cols)}


def _code(c: str, values: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(v) for v in values]).cast("array<string>"), F.col(c).cast("string"))
    return F.when(at > 0, (at - 1).cast("double"))


def encode_categories(df: DataFrame, cols: list[str], lists: dict[str, list[str]] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """Each value's rank among the sorted distinct ones, from 0; missing and unseen ones NULL."""
    lists = lists or category_lists(df, cols)
    return df.withColumns({c: _code(c, lists[c]) for c in cols}) if cols else df, lists


def decode_categories(df: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """Codes rounded half to even, clipped to the range, back to text; missing stays missing."""
    out = {}
    for c, values in lists.items():
        at = F.greatest(F.least(F.rint(c).cast("int"), F.lit(len(values) - 1)), F.lit(0))
        out[c] = F.when(F.col(c).isNotNull(), F.get(F.array(*[F.lit(v) for v in values]).cast("array<string>"), at))
    return df.withColumns(out) if out else df


def encode_target(train: DataFrame, test: DataFrame, col: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Text, missing as a class of its own, coded by rank over both tables."""
    text = F.coalesce(F.col(col).cast("string"), F.lit(MISSING_TARGET))
    train, test = train.withColumn(col, text), test.withColumn(col, text)
    values = category_lists(train.select(col).union(test.select(col)), [col])[col]
    return train.withColumn(col, _code(col, values)), test.withColumn(col, _code(col, values)), values


def one_hot(train: DataFrame, *others: DataFrame, cols: list[str]) -> list[DataFrame]:
    """A 0/1 column <name>_<value> for each value that train has; unseen values give zeros. Column values are replaced."""
    lists = category_lists(train, cols)
    made = {f"{c}_{v}": F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("int"), F.lit(0)) for c, vs in lists.items() for v in vs}
    return [df.select(*[F.col(f"`{c}`") for c in df.columns if c not in cols], *[x.alias(n) for n, x in made.items()]) for df in (train, *others)]


def prepare_features(train: DataFrame, test: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Filled, one-hot, numerical columns and the target as it is; test has train's columns."""
    from tabsynth.impute import impute_simple

    kinds = infer_schema(train.drop(target))
    train, test = impute_simple(train, test, keep=[target], missing="Missing")
    a, b = one_hot(train, test, cols=[c for c, k in kinds.items() if k == "categorical"])
    return a, b


def align_precision(real: DataFrame, synth: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides rounded half to even: to whole numbers where all real values are whole, else to 4 digits."""
    if not cols:
        return real, synth
    row = real.agg(*[F.coalesce(F.bool_and(F.col(c).cast("double") == F.rint(F.col(c).cast("double"))), F.lit(True)).alias(f"w{i}") for i, c in enumerate(cols)]).first()
    done = {c: F.bround(F.col(c).cast("double"), 0 if row[f"w{i}"] else 4) for i, c in enumerate(cols)}
    return real.withColumns(done), synth.withColumns(done)


def fill_union(df: DataFrame) -> DataFrame:
    """Missing numbers become the mean, other values the mode (least of ties), or 'Missing' where there is none."""
    from tabsynth.impute import fill_values

    kinds = infer_schema(df)
    numbers = [c for c, k in kinds.items() if k == "numerical"]
    row = df.agg(*[F.avg(c).alias(f"v{i}") for i, c in enumerate(numbers)]).first() if numbers else ()
    values = dict(zip(numbers, row, strict=True)) | fill_values(df, [c for c in kinds if c not in numbers])
    out = {}
    for c, k in kinds.items():
        value = values[c]
        if k == "numerical":
            out[c] = F.coalesce(F.col(c).cast("double"), F.lit(value).cast("double"))
        else:
            out[c] = F.coalesce(F.col(c), F.lit(value)) if value is not None else F.coalesce(F.col(c).cast("string"), F.lit("Missing"))
    return df.withColumns(out)


def frequencies(df: DataFrame, col: str) -> DataFrame:
    """value, frequency (share of all rows)."""
    total = df.count()
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg((F.count(F.lit(1)) / F.lit(float(max(total, 1)))).alias("frequency"))


def frequency_encode(df: DataFrame, col: str) -> DataFrame:
    table = frequencies(df, col)
    return df.join(table, df[col] == table["value"], "left").drop("value").withColumn(col, F.col("frequency")).drop("frequency")


def frequency_decode(df: DataFrame, col: str, table: DataFrame) -> DataFrame:
    """The value whose frequency is nearest; the least of ties. table: value, frequency, one row for each category."""
    pairs = [(r["frequency"], r["value"]) for r in table.orderBy("value").collect()]
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(col) - f).alias("d"), F.lit(v).alias("v")) for f, v in pairs]))["v"]
    return df.withColumn(col, F.when(F.col(col).isNotNull(), nearest))


def to_numeric_types(df: DataFrame) -> DataFrame:
    """Times as seconds, intervals as seconds, booleans as 0 and 1."""
    out = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            out[f.name] = F.unix_micros(c) / F.lit(1e6)
        elif isinstance(f.dataType, T.TimestampNTZType):
            out[f.name] = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), c) / F.lit(1e6)
        elif isinstance(f.dataType, T.DateType):
            out[f.name] = F.unix_date(c) * F.lit(86400.0)
        elif isinstance(f.dataType, T.DayTimeIntervalType):
            part = lambda p, c=c: F.expr(f"extract({p} from `{f.name}`)").cast("double")
            out[f.name] = part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = c.cast("int")
    return df.withColumns(out) if out else df


def from_numeric_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Back to the types of schema: whole numbers rounded half to even, booleans too; its columns, in its order."""
    out = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.timestamp_micros(F.rint(c * 1e6).cast("long"))
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.expr(f"timestampadd(MICROSECOND, cast(rint(`{f.name}` * 1e6D) as bigint), timestamp_ntz'1970-01-01')")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_from_unix_date(F.rint(c / 86400).cast("int"))
        elif isinstance(f.dataType, T.DayTimeIntervalType):
            c = F.make_dt_interval(secs=F.round(c, 6).cast("decimal(18,6)"))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.rint(c) >= 1
        elif isinstance(f.dataType, T.IntegralType):
            c = F.rint(c.cast("double")).cast(f.dataType)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


restore_types = from_numeric_types
