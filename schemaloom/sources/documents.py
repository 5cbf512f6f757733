"""Where JSON documents come from: text files, URLs, standard input, rows in memory, and tables."""

from __future__ import annotations

import json
import sys
import urllib.request
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "doc_id long, json string"


def numbered(df: DataFrame, column: str) -> DataFrame:
    """(doc_id, json): documents named by their partition and their order in it; another split of the files names them anew."""
    return df.select(F.monotonically_increasing_id().alias("doc_id"), F.col(column).alias("json"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One document a line. Lines that don't parse are dropped later and can be counted with bad_documents."""
    return numbered(spark.read.text(path), "value").where(F.trim("json") != "")


def from_values(spark: SparkSession, values: Iterable) -> DataFrame:
    return spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], COLUMNS)


def from_strings(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], COLUMNS)


def from_text_column(df: DataFrame, column: str, id_column: str | None = None) -> DataFrame:
    """Documents in a string column; with an id column it names them, and the plan stays deterministic."""
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("json")) if id_column else numbered(df, column)


def from_table(df: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """Each row as a document; null fields are absent keys."""
    fields = columns or tuple(df.columns)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.to_json(F.struct(*fields)).alias("json"))


def read_any(spark: SparkSession, place: str | None) -> DataFrame:
    """A path that Spark reads, an http(s) URL, or standard input (None or "-"); the last two are read by the driver."""
    if place in (None, "-"):
        return from_strings(spark, (line for line in sys.stdin if line.strip()))
    if place.startswith(("http://", "https://")):
        with urllib.request.urlopen(place) as r:
            return from_strings(spark, [x for x in r.read().decode("utf-8", "replace").splitlines() if x.strip()])
    return read_ndjson(spark, place)


def bad_documents(docs: DataFrame) -> DataFrame:
    """How many documents don't parse, and how many hold characters that weren't UTF-8."""
    return docs.agg(F.count_if(F.expr("try_parse_json(json)").isNull()).alias("unparsable"), F.count_if(F.col("json").contains("�")).alias("bad_encoding"), F.count("*").alias("documents"))
