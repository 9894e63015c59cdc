"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsynth.llm import oracles
from tabsynth.llm.common import table


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsynth.llm.warc import archive_pages

    index = archive_pages(table(spark, sf_dir, "pages"))[0]
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsynth.llm.linededup import drop_repeated_units

    cleaned = drop_repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"), unit="clause")
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), " ")
    return cleaned.select("doc_id", "text", "n_removed", spans.alias("removed"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabsynth.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabsynth.llm.unigram import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsynth.llm.mixing import score_documents

    return score_documents(table(spark, sf_dir, "documents"), group="lang")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsynth.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsynth.llm.neardup_vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsynth.llm.quality import quality_verdicts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality_verdicts(docs, trusted).drop("text")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabsynth.llm.bpe import encode_documents

    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsynth.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsynth.llm.phrases import mine_phrases

    return mine_phrases(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsynth.llm.manifest import merkle_manifest, without_line_ends

    docs = table(spark, sf_dir, "documents")
    return merkle_manifest(docs, without_line_ends(docs))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabsynth.llm.tokenfile import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc_index, op2_line_dedup, op3_best_fit_packing, op4_token_counts, op5_lm_scores, op6_jaccard_join, op7_vector_near_dedup, op8_quality_rules, op9_byte_bpe, op10_sharding, op11_phrases, op12_merkle_manifest, op13_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": oracles.OP1, "op2_line_dedup": oracles.OP2, "op6_jaccard_join": oracles.OP6, "op7_vector_near_dedup": oracles.OP7, "op10_sharding": oracles.OP10, "op11_phrases": oracles.OP11, "op12_merkle_manifest": oracles.OP12}
