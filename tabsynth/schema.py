"""Logical column types, column names, keys."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERICAL, CATEGORICAL = "numerical", "categorical"
INDICATOR = "missingindicator_"


def infer_schema(df: DataFrame) -> dict[str, str]:
    """Each column's logical type, from its physical type: numbers are numerical, all else (booleans too) categorical. No scan."""
    return {f.name: NUMERICAL if isinstance(f.dataType, T.NumericType) else CATEGORICAL for f in df.schema}


def align_schema(df: DataFrame, base: dict[str, str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """base for the columns of df: known entries stay, new columns are inferred, absent ones go; overrides win."""
    wrong = {k: v for k, v in (overrides or {}).items() if v not in (NUMERICAL, CATEGORICAL, "primary_key")}
    if wrong:
        raise ValueError(f"unknown types: {wrong}")
    return {c: (overrides or {}).get(c, base.get(c, kind)) for c, kind in infer_schema(df).items()}


def numeric_columns(meta: dict[str, str], *frames: DataFrame) -> list[str]:
    """Numerical columns of meta that the first frame has; the other frames must have them as well."""
    cols = [c for c, kind in meta.items() if kind == NUMERICAL and (not frames or c in frames[0].columns)]
    for df in frames[1:]:
        if missing := [c for c in cols if c not in df.columns]:
            raise ValueError(f"columns missing from a table: {missing}")
    return cols


def categorical_columns(meta: dict[str, str], df: DataFrame) -> list[str]:
    return [c for c, kind in meta.items() if kind == CATEGORICAL and c in df.columns]


def sanitize_name(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z]", "_", name.strip()).strip("_")


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Every character of a name that isn't an ASCII letter or digit becomes _, none stands at an end. Raises if names
    become empty or equal."""
    names = [sanitize_name(c) for c in df.columns]
    if "" in names or len({n.lower() for n in names}) < len(names):
        raise ValueError(f"names are empty or collide: {names}")
    return df.toDF(*names)


def drop_by_index(df: DataFrame, indexes: list[int]) -> DataFrame:
    """Without the columns at these places (from 0); places out of range are passed over."""
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if i not in set(indexes)])


def drop_indicators(df: DataFrame, meta: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    return df.drop(*[c for c in df.columns if c.startswith(INDICATOR)]), {c: k for c, k in meta.items() if not c.startswith(INDICATOR)}


def nan_to_null(df: DataFrame) -> DataFrame:
    """The one missing value is NULL: NaN sorts above all numbers and spoils sums."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate_table(df: DataFrame, meta: dict[str, str]) -> None:
    """Raises if a declared column is absent or a primary key has duplicates."""
    if missing := [c for c in meta if c not in df.columns]:
        raise ValueError(f"declared columns are absent: {missing}")
    for c in (c for c, kind in meta.items() if kind == "primary_key"):
        if duplicate_keys(df, [c]).limit(1).count():
            raise ValueError(f"primary key {c} has duplicates")


def save_schema(meta: dict[str, str], path: str, table: str = "table") -> None:
    """A small file on the driver."""
    spec = {"tables": {table: {"columns": {c: {"sdtype": k} for c, k in meta.items()}}}, "relationships": [], "METADATA_SPEC_VERSION": "V1"}
    Path(path).write_text(json.dumps(spec, indent=2))


def load_schema(path: str) -> dict[str, str]:
    tables = json.loads(Path(path).read_text())["tables"]
    return {c: x["sdtype"] for c, x in next(iter(tables.values()))["columns"].items()} if tables else {}
