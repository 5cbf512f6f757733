"""Line deduplication over levelled sorted runs of line hashes.

A store is a folder of runs, Parquet files sorted by line hash. A new batch is aggregated to a row per hash (in how many of
its documents the line occurs, and the largest id of these) and merge-anti-joined with the runs: lines that no run holds become
a run of their own at level 0, so that each hash stands in one run only; what the runs hold already goes to a log of repeats,
which is small. As soon as a level holds ``fanout`` runs they are merged into one run of the next level, so that N batches
leave O(log N) runs. Lines to drop come from one merge of the runs with the log. A whole table is added as some batches, by
hash of its ids. Hashes are 128 bits wide, lines are reduced to (hash, id) before the first shuffle, and texts move once, to
meet their dropped hashes.

Runs and logs are never changed, only replaced: a merged run says which runs it replaces, and these don't count from the
moment it is there, whether or not they are deleted yet; a batch that is added again after a failure is recognised by its name.

Line keys: the line without ASCII white space at both ends, A-Z in lower case; keys of at least ``min_chars`` code points
found in at least ``min_docs`` documents lose all lines but those of the largest id. Defined cases: null and empty texts
are one empty line; repeated rows of an id count as one document; rows with a null id are deduplicated as one document
whose id is smaller than all others; texts of any length are cut into lines whole; there are no ties, as the largest id is
one; an empty table gives an empty one; extra columns are carried along.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.common import BLANKS, broadcast_if_small, free_name, materialise, shared_dir, small_batches

STRIP = BLANKS.encode()
NULL_ID = -(1 << 63)


def line_hashes(text: str | None, min_chars: int) -> list[bytes | None]:
    """For each line its key's hash, None if the key is too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "replace").lower().split(b"\n"):
        key = line.strip(STRIP)
        long = len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def document_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, doc_id, salt) of every line key that is long enough, once per row and key. salt tells rows without an id apart."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids, salts = [], [], []
            for name, salt, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = set(line_hashes(text, min_chars)) - {None}
                hashes += own
                ids += [name] * len(own)
                salts += [salt] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64()), pa.array(salts, pa.int64())], names=["h", "doc_id", "salt"])

    source = docs.select(*keys_of(id_col, text_col), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "h binary, doc_id long, salt long")


def keys_of(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What a row is joined by: its id, and for rows without one a hash of the text, so that they don't meet in one task."""
    own = F.col(id_col).cast("long")
    return F.coalesce(own, F.lit(NULL_ID)).alias("doc_id"), F.when(own.isNull(), F.xxhash64(text_col)).otherwise(0).cast("long").alias("salt")


class LineRuns:
    """A levelled store of sorted runs (h, docs, last) in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _child(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def _names(self, folder) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _finished(self) -> dict[str, list[str]]:
        """Marks of each run or log that Spark has committed and that no other one replaces."""
        marks = {}
        for name in self._names(self._root):
            if name[0] in "LR" and "_SUCCESS" in (own := self._names(self._child(name))):
                marks[name] = own
        gone = {m.removeprefix("_replaces.") for own in marks.values() for m in own if m.startswith("_replaces.")}
        return {name: own for name, own in marks.items() if name not in gone}

    def runs(self) -> dict[int, list[str]]:
        """Runs by level."""
        out: dict[int, list[str]] = {}
        for name in self._finished():
            if name[0] == "L":
                out.setdefault(int(name[1:].split("-")[0]), []).append(name)
        return out

    def _read(self, names: list[str]) -> DataFrame:
        schema = "h binary, docs long, last long"
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str, replaces: tuple[str, ...] = (), batch: str | None = None) -> None:
        """A finished folder with its marks appears at once, by a rename."""
        name = f"{kind}-{uuid.uuid4().hex}" if batch is None else f"{kind}-{batch}"
        df.sortWithinPartitions("h").write.mode("overwrite").parquet(f"{self.path}/tmp-{name}")
        for old in replaces:
            self._fs.create(self._child(f"tmp-{name}/_replaces.{old}")).close()
        if not self._fs.rename(self._child(f"tmp-{name}"), self._child(name)):
            raise OSError(f"can't rename the run {name}")

    def lines(self) -> DataFrame:
        """(h, docs, last) of all runs: each hash once, as its first batch had it."""
        return self._read([n for own in self.runs().values() for n in own])

    def repeats(self) -> DataFrame:
        """(h, docs, last) of what later batches had of lines that a run held already."""
        return self._read([n for n in self._finished() if n[0] == "R"])

    def all(self) -> DataFrame:
        """(h, docs, last) of every line of all batches."""
        again = self.repeats().groupBy("h").agg(F.sum("docs").alias("_docs"), F.max("last").alias("_last"))
        met = self.lines().join(again.hint("merge"), "h", "left")
        return met.select("h", (F.col("docs") + F.coalesce("_docs", F.lit(0))).alias("docs"), F.greatest("last", "_last").alias("last"))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Lines (h, ...) that no run holds."""
        return lines.join(self.lines().select("h").hint("merge"), "h", "left_anti")

    def add(self, lines: DataFrame, batch: str | None = None) -> None:
        """Add a batch of (h, doc_id); a document belongs to one batch only. A batch of a name that is there is not added again."""
        batch = batch or uuid.uuid4().hex
        names = self._names(self._root)
        if f"added-{batch}" in names or f"L0-{batch}" in names:
            return
        self._fs.delete(self._child(f"R-{batch}"), True)  # of an attempt that broke off before its run was there
        once = lines.groupBy("h", "doc_id").agg(F.lit(1).alias("one"))  # by document first, so that no line's documents meet in one task
        own = materialise(once.groupBy("h").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")), "batch")
        if self.runs():
            held = self.lines().select("h")
            self._write(own.join(held.hint("merge"), "h", "left_semi"), "R", batch=batch)
            self._write(self.unseen(own), "L0", batch=batch)
        else:
            self._write(own, "L0", batch=batch)
        self._fs.create(self._child(f"added-{batch}")).close()
        self.compact()

    def compact(self) -> None:
        """Merge levels that are full. Replaced runs don't count any more; deleting them only frees space."""
        level = 0
        while level in (now := self.runs()):
            if len(now[level]) >= self.fanout:
                self._write(self._read(now[level]).repartition(F.col("h")), f"L{level + 1}", tuple(now[level]))
            level += 1
        live = self._finished()
        for name in self._names(self._root):
            if name[0] == "L" and name not in live:
                self._fs.delete(self._child(name), True)


def dropped_lines(docs: DataFrame, store: LineRuns | None = None, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, max_broadcast: int = 200_000) -> DataFrame:
    """doc_id, salt and drop, the hashes of the lines that the row loses; adds the documents to the store, in batches."""
    spark = docs.sparkSession
    store = store or LineRuns(spark)
    lines = materialise(document_lines(docs, min_chars, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "lines", "batch")
    for k in range(batches):
        store.add(lines.where(F.col("batch") == k))
    repeated = materialise(store.all().where(F.col("docs") >= min_docs).select("h", "last"), "repeated")
    if repeated.limit(max_broadcast + 1).count() <= max_broadcast:
        met = lines.join(F.broadcast(repeated), "h")
    else:  # a line of very many documents is dealt over some tasks
        part = F.pmod(F.xxhash64("doc_id", "salt"), F.lit(16))
        met = lines.withColumn("part", part).join(repeated.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<long>"))), ["h", "part"])
    return met.where("doc_id < last").groupBy("doc_id", "salt").agg(F.collect_set("h").alias("drop"))


def dedup_lines(docs: DataFrame, store: LineRuns | None = None, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text replaced by its kept lines, and two counts added: lines, and dropped ones (old columns of these names go)."""
    drops = dropped_lines(docs, store, min_docs, min_chars, id_col, text_col)
    key, salt, drop_id, drop_salt, drop = (free_name(docs, x) for x in ("key", "salt", "drop_id", "drop_salt", "drop"))
    drops = drops.toDF(drop_id, drop_salt, drop)
    own = keys_of(id_col, text_col)
    met = docs.withColumns({key: own[0], salt: own[1]}).join(drops, (F.col(key) == F.col(drop_id)) & (F.col(salt) == F.col(drop_salt)), "left")
    fields = [f for f in docs.schema if f.name not in counts]
    at = [f.name for f in fields].index(text_col)
    met = met.select(*(f"`{f.name}`" for f in fields), drop).toDF(*(f"c{k}" for k in range(len(fields) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(len(fields)).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                if drop:
                    drop = set(drop)
                    stay = [x for x, h in zip(lines, line_hashes(text, min_chars), strict=True) if h not in drop]
                else:
                    stay = lines
                kept.append("\n".join(stay))
                total.append(len(lines))
                gone.append(len(lines) - len(stay))
            columns = list(batch.columns[: len(fields)])
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*(f.name for f in fields), *counts])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{counts[0]}` long, `{counts[1]}` long"
    return met.mapInArrow(run, schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def oracle_sql(min_docs: int = 3, min_chars: int = 20) -> str:
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    upper = "".join(chr(65 + k) for k in range(26))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
cut AS (SELECT r, doc_id, unnest(own) AS line, unnest(range(1, len(own) + 1)) AS n FROM docs),
lines AS (SELECT *, translate(trim(line, {blanks}), '{upper}', '{upper.lower()}') AS k FROM cut),
repeated AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= {min_chars} GROUP BY k HAVING count(DISTINCT doc_id) >= {min_docs}),
marked AS (SELECT lines.*, coalesce(doc_id < last, false) AS gone FROM lines LEFT JOIN repeated USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(CASE WHEN gone THEN 1 END)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY r, doc_id
"""
