"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from schemaloom.llm.packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from schemaloom.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from schemaloom.llm.quality import THRESHOLD, quality_scores

    return judged(quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")), THRESHOLD)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from schemaloom.llm.toxicity import THRESHOLD, toxicity_scores

    return judged(toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")), THRESHOLD)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from schemaloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from schemaloom.llm.pii import digests, personal_data

    return digests(personal_data(table(spark, sf_dir, "documents")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from schemaloom.llm.rules import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    from schemaloom.llm.linear import held_out

    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from schemaloom.llm.linededup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from schemaloom.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from schemaloom.llm.simhash import near_groups

    groups = near_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2, segments=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_decontamination, op3_quality, op4_licenses, op5_pii, op6_quality_rules, op7_line_dedup, op8_toxicity, op9_html_text, op10_simhash]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from schemaloom.llm import licenses, linededup, rules

    return {"op4_licenses": licenses.oracle_sql(), "op6_quality_rules": rules.oracle_sql(), "op7_line_dedup": linededup.oracle_sql()}
