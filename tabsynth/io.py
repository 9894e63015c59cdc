"""Reading tables, writing datasets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsynth.schema import nan_to_null


def read_table(spark: SparkSession, path: str, fmt: str = "csv", drop_first: bool = False) -> DataFrame:
    """csv (with header, types inferred), parquet or json. NaN becomes NULL. drop_first: the first column is an id and goes."""
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    elif fmt in ("parquet", "json"):
        df = getattr(spark.read, fmt)(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return nan_to_null(df.drop(df.columns[0]) if drop_first else df)


def write_datasets(df: DataFrame, path: str, imputation: str, generator: str, mode: str = "append") -> None:
    """One folder for each imputation and generator."""
    df.withColumns({"imputation": F.lit(imputation), "generator": F.lit(generator)}).write.partitionBy("imputation", "generator").mode(mode).parquet(path)


def write_report(frames: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """A folder of one file for each report table; these are small."""
    for name, df in frames.items():
        writer = df.coalesce(1).write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(f"{path}/{name}")
