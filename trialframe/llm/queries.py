"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat import PREFERENCE_SQL, preference_pairs, with_other_answers
from .lmscore import score_texts
from .mixing import MIX_SQL, mix_sources
from .neardup import near_duplicates
from .packing import pack
from .pages import main_text
from .quality import quality
from .repair import REPAIR_SQL, damaged_turns, repair_conversations
from .runs import periodic_runs
from .secrets import find_secrets
from .topk import TOP_K_SQL, exact_top_k
from .warc import archive_pages


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; every machine has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_pairs(with_other_answers(_table(spark, sf_dir, "conversations")))


def op4_warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", "record_id", "date", "uri", "error")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"), damaged=True)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged_turns(_table(spark, sf_dir, "conversations")))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_source_mixing,
        op2_quality_classifier,
        op3_preference_formatting,
        op4_warc_conversion,
        op5_exact_top_k,
        op6_main_text,
        op7_packing,
        op8_minhash_near_dedup,
        op9_nearest_neighbours,
        op10_secret_scans,
        op11_periodic_runs,
        op12_conversation_repair,
        op13_lm_scoring,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": MIX_SQL, "op3_preference_formatting": PREFERENCE_SQL, "op5_exact_top_k": TOP_K_SQL, "op12_conversation_repair": REPAIR_SQL}
