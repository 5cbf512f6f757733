"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space of the contracts: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode
    (tests), where there is one machine; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="schemaloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialise(df: DataFrame, name: str, *parts: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet under the shared folder, in folders by parts, and read it again: cuts the lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256, size: str = "32m") -> None:
    """Keep Arrow batches small in rows and bytes, as one row may hold a text of megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast df if a count shows that it has at most max_rows rows (narrow ones); else leave the join to shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made of it, that df has no column of (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def bucket_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; remainder 2 is held out. A null id has no text and is hashed as an empty one."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def with_arrow_columns(df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., list[list]]], fields: str, keep: Callable | None = None) -> DataFrame:
    """df with Arrow-batched Python columns added (old columns of these names are replaced).

    make() runs once per task and returns a function from lists of the inputs' values to lists of the new columns'
    values; keep, if given, gets the same lists of new columns and says for each row whether it stays.
    """
    small_batches(df.sparkSession)
    added = StructType.fromDDL(fields)
    names = [c for c in df.columns if c not in added.names]
    kinds = to_arrow_schema(added)
    at = [names.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            new = work(*(batch.column(k).to_pylist() for k in at))
            out = pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, kinds.field(k).type) for k, v in enumerate(new))], names=[*names, *added.names])
            yield out if keep is None else out.filter(pa.array(keep(*new), pa.bool_()))

    schema = StructType([*(f for f in df.schema if f.name in names), *added])
    plain = df.select(*(F.col(f"`{c}`") for c in names)).toDF(*(f"c{k}" for k in range(len(names))))  # mapInArrow can't name columns with dots
    return plain.mapInArrow(run, schema)
