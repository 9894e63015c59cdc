"""Sharding by jump consistent hashing.

The shard of a row follows from a stable key and the number of shards alone: no ring, no table of
assignments. With one more shard, only the fraction 1/(n+1) of the rows moves, and only into the new shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsynth.llm.common import shuffle_partitions, written


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys (Lamping and Veach, 2014), for all keys at once; some ln(shards) rounds."""
    key, at, ahead = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        scale = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((at[live] + 1) * scale).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def stable_key(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; null has a key of its own. The same in any engine and run."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\0null")).cast("binary")), 1, 15), 16, 10).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards), dtype="int32")

    return shard_of(stable_key(key))


def number_in_shards(df: DataFrame, shard: str, key: str, order: list[str], slot: str = "slot", bucket_rows: int = 50_000) -> DataFrame:
    """Adds the place of each row in its shard, gapless from 0, by (32 hashed bits of the key, order).

    A shard may hold billions of rows, so it isn't numbered in one task: it is cut by ranges of the hash, each
    range is numbered, and the ranges' counts give where each starts. df is read twice: pass a written table.
    """
    spark, names = df.sparkSession, [c for c in ("_h", "_b", "_from") if c in df.columns]
    if names:
        raise ValueError(f"reserved columns: {names}")
    shards = max(1, df.select(shard).distinct().count())
    buckets = math.ceil(max(df.count() / bucket_rows, 2 * shuffle_partitions(spark)) / shards)
    text = F.coalesce(F.col(key).cast("string"), F.lit("\0null")).cast("binary")
    df = df.withColumn("_h", F.conv(F.substring(F.md5(text), 17, 8), 16, 10).cast("long"))
    df = df.withColumn("_b", F.floor(F.col("_h") * buckets / F.lit(2.0**32)))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(shard, "_b").count().select(shard, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy(shard, "_b").orderBy("_h", *order)
    df = df.withColumn(slot, F.row_number().over(within).cast("long") - 1)
    return df.join(starts, [shard, "_b"]).withColumn(slot, F.col(slot) + F.col("_from")).drop("_h", "_b", "_from")


def assign_shards(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str | None = None) -> DataFrame:
    """df with its shard, and with the shard it has when one more is appended (column grown). No shuffle.

    Null keys share one shard; equal keys always share one; empty tables stay empty. A column of the
    same name is replaced.
    """
    out = {shard: jump_shard(F.col(key), shards)}
    if grown:
        out[grown] = jump_shard(F.col(key), shards + 1)
    return df.withColumns(out)


def write_shards(df: DataFrame, path: str, key: str, shards: int, shard: str = "shard") -> None:
    """Writes df as Parquet, one folder for each shard."""
    assign_shards(df, key, shards, shard).write.partitionBy(shard).parquet(path)


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Null and empty texts have size 1 and CRC 0. Repeated rows each have a slot; a null doc_id is a key like
    any other. Other columns are left out, so their names can't clash.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = docs.select(F.col(key).alias("doc_id"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    put = written(assign_shards(sized, "doc_id", shards, grown="grown_shard"), "shards")
    slots = number_in_shards(put, "shard", "doc_id", ["doc_id", "size", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
