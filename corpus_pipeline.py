"""A training corpus from raw documents: quality rules, near duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsynth.llm.common import WORD, table, written
from tabsynth.llm.jaccard import keep_one_of_each
from tabsynth.llm.linededup import drop_repeated_units
from tabsynth.llm.packing import pack_documents
from tabsynth.llm.quality import quality_verdicts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality_verdicts(docs, trusted).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of Jaccard similarity 0.8 or more make."""
    return keep_one_of_each(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes clauses that an earlier ranked document, or the document itself, has before. Texts left without a word go."""
    cleaned = drop_repeated_units(docs, unit="clause").where(F.col("text").rlike(WORD))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("packing", packing)]

#: The tokenizer's merges and the growing of groups have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over documents, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
