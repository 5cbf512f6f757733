"""Corpus pipeline: quality, line dedup, near dedup, decontamination, packing; each stage reads what the one before wrote.

Defined cases of all stages: a null text is an empty one; a row without an id is judged like any other and stays until the
last stage, unless its text is rejected, but belongs to no group of near duplicates; texts of any length are taken whole;
repeated rows are judged alike, and near_dedup leaves one of them; an empty table gives an empty one; extra columns are
carried to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.common import free_name, materialise, table
from schemaloom.llm.decontam import clean_documents
from schemaloom.llm.entries import tokenizer_path
from schemaloom.llm.linededup import dedup_lines
from schemaloom.llm.packing import pack_documents
from schemaloom.llm.quality import good_documents
from schemaloom.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores as good; it learns from labelled rows that aren't held out. A tie at the threshold stays."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that a larger id of at least three holds; a text that loses all lines is empty."""
    kept = dedup_lines(docs, counts=(free_name(docs, "n_lines"), free_name(docs, "n_dropped"))).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each near-duplicate group: a similarity of 0.8 of five-word shingles or more."""
    return keep_one(docs, similarity=0.8, shingle=5, max_bits=3, segments=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; items of the same text are one."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can't train the classifier or tokenise; tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
