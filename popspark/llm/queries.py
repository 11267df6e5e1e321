"""The registered queries of the subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, html, toxicity
from .audit import filter_audit
from .codes import product_codes
from .durable import table
from .jaccard import jaccard_components
from .lines import dedup_lines
from .lm import score_texts
from .mixing import mix_sources
from .oracles import ORACLE_SQL
from .pii import personal_data
from .quality import quality_rules
from .substrings import remove_repeats
from .tokens import token_counts

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
BENCH_TOKENIZER = "byte_bpe_50k.json"


def fold(rest: int, modulus: int = 5):
    """Rows whose crc32(doc_id as text) mod ``modulus`` is ``rest``; a null id is not among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), ~fold(1))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """The model of all training rows: those that are not in fold 0 of 5."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~fold(0))
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", fold(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix_sources(table(spark, sf_dir, "documents"))
    return m.withColumns({"target": F.round("target", 6), "finish_time": F.round("finish_time", 9)})


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(BENCH_TOKENIZER)
    return token_counts(table(spark, sf_dir, "documents"), Path(tokenizer).read_text(encoding="utf-8"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, fit = product_codes(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(fit.digest()).alias("codebooks_sha256"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_substrings": op4_substrings,
    "op5_main_text": op5_main_text,
    "op6_quality_rules": op6_quality_rules,
    "op7_mix_sources": op7_mix_sources,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_personal_data": op12_personal_data,
    "op13_filter_audit": op13_filter_audit,
}
