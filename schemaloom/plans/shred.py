"""Documents to nodes: one row per JSON value, level by level.

At each level one small aggregation by path tells which values are containers, and for each array path whether all its
arrays have one length (then it is a tuple, with children at [0], [1], ...) or not (a list, with children at [*]). As a
path fixes its depth, parents are settled before their children are made, and no path is ever rewritten. Levels are
JVM-side (VARIANT); the decisions, as many rows as the schema has paths, are all that the driver sees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from schemaloom.functions.exprs import shown
from schemaloom.params import Params

NODE_COLUMNS = ("doc_id", "node_id", "parent_id", "path", "parent", "key", "depth", "type", "n", "s", "i", "d", "m", "b", "keys", "unique")


@dataclass
class Shredded:
    """nodes: every value. kinds: (path, type) to (count, least n, greatest n). tuples: array paths that are tuples."""

    nodes: DataFrame
    kinds: dict[tuple[str, str], tuple[int, int | None, int | None]]
    tuples: set[str] = field(default_factory=set)
    levels: list[DataFrame] = field(default_factory=list)

    def lifted(self) -> list[str]:
        """Paths that hold integers and other numbers: all are numbers there."""
        return [p for p, t in self.kinds if t == "integer" and (p, "number") in self.kinds]

    def release(self) -> None:
        for df in self.levels:
            df.unpersist()


def once(c: Column) -> Column:
    """c as a generated column: filters on it aren't pushed below, where each mention of it would be worked out again."""
    return F.explode(F.array(c))


_WHOLE = [f"DECIMAL({digits},0)" for digits in range(19, 39)]


def scalar_type(name: Column, whole: str = "integer") -> Column:
    """The type of what schema_of_variant calls name, unless it holds others."""
    return (
        F.when(name == "STRING", "string")
        .when(name.isin("BIGINT", *_WHOLE), whole)
        .when(name.isin("DOUBLE", "FLOAT") | name.startswith("DECIMAL"), "number")
        .when(name == "BOOLEAN", "boolean")
        .otherwise("null")
    )


def _unique() -> Column:
    """Whether an array's items are all strings or all numbers and no two are the same: within its row, so that no item moves."""
    items = F.expr("cast(v as array<variant>)")
    kinds = F.array_distinct(F.transform(F.transform(items, F.schema_of_variant), lambda name: scalar_type(name, whole="number")))
    texts = F.transform(items, lambda x: shown(F.try_variant_get(x, "$", "string")))
    numbers = F.transform(items, lambda x: F.coalesce(*(F.try_variant_get(x, "$", t).cast("string") for t in ("decimal(38,12)", "double"))))
    unlike = lambda values: (F.size(F.array_distinct(values)) == F.col("n")) & ~F.exists(values, F.isnull)
    deep = F.expr("try_variant_get(v, '$[0]', 'array<variant>') IS NOT NULL OR try_variant_get(v, '$[0]', 'map<string, variant>') IS NOT NULL")
    return F.when(F.col("n") == 0, True).when(deep, False).when(kinds == F.array(F.lit("string")), unlike(texts)).when(kinds == F.array(F.lit("number")), unlike(numbers)).otherwise(False)


def _typed(level: DataFrame) -> DataFrame:
    # Sizes say which values hold others; schema_of_variant, which goes through all that a value holds, is asked of the rest.
    sizes = F.struct(F.expr("array_size(try_variant_get(v, '$', 'array<variant>'))").alias("items"), F.expr("array_size(map_keys(try_variant_get(v, '$', 'map<string, variant>')))").alias("fields"))
    level = level.select("*", once(sizes).alias("_size"))
    level = level.select("*", once(F.when(F.col("_size.items").isNull() & F.col("_size.fields").isNull(), F.schema_of_variant("v"))).alias("_name"))
    kind = F.when(F.col("_size.items").isNotNull(), "array").when(F.col("_size.fields").isNotNull(), "object").otherwise(scalar_type(F.col("_name")))
    level = level.withColumns({"type": kind, "n": F.coalesce("_size.items", "_size.fields").cast("long")}).drop("_size", "_name")
    is_ = lambda *t: F.col("type").isin(*t)
    return level.select(
        *(c for c in level.columns if c != "v"),
        F.when(F.col("n") > 0, F.col("v")).alias("v"),  # all that levels below need
        F.when(is_("string"), F.expr("cast(v as string)")).alias("s"),
        F.when(is_("integer"), F.expr("try_variant_get(v, '$', 'decimal(38,0)')")).alias("i"),
        F.when(is_("integer", "number"), F.expr("try_variant_get(v, '$', 'double')")).alias("d"),
        F.when(is_("integer", "number"), F.expr("try_variant_get(v, '$', 'decimal(38,12)')")).alias("m"),
        F.when(is_("boolean"), F.expr("cast(v as boolean)")).alias("b"),
        F.when(is_("object"), F.expr("array_sort(map_keys(cast(v as map<string, variant>)))")).alias("keys"),
        F.when(is_("array"), _unique()).alias("unique"),
    )


def _kept(df: DataFrame, params: Params) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK) if params.cache else df


def _summary(typed: DataFrame) -> DataFrame:
    return typed.groupBy("path", "type").agg(F.count("*").alias("count"), F.min("n").alias("low"), F.max("n").alias("high"))


def _wide(level: DataFrame, params: Params) -> DataFrame:
    """(_wide): the paths of those objects that have more than max_keys keys; some of the level above, which were few enough to collect."""
    wide = level.where("key IS NOT NULL").groupBy("parent").agg(F.approx_count_distinct("path").alias("keys")).where(F.col("keys") > params.max_keys)
    return F.broadcast(wide.select(F.col("parent").alias("_wide")))


def _maps(level: DataFrame, wide: DataFrame) -> DataFrame:
    """The level with one path for all keys of wide objects."""
    met = level.join(wide, F.col("parent") == F.col("_wide"), "left")
    is_wide = F.col("_wide").isNotNull() & F.col("key").isNotNull()
    return met.withColumns({"path": F.when(is_wide, F.concat("parent", F.lit(".*"))).otherwise(F.col("path")), "key": F.when(is_wide, F.lit(None)).otherwise(F.col("key"))}).drop("_wide")


def _without_keys(typed: DataFrame, wide: DataFrame) -> DataFrame:
    """Wide objects have no keys."""
    met = typed.join(wide, F.col("path") == F.col("_wide"), "left")
    return met.withColumn("keys", F.when(F.col("_wide").isNotNull() & F.col("keys").isNotNull(), F.array().cast("array<string>")).otherwise(F.col("keys"))).drop("_wide")


def shred(docs: DataFrame, params: Params = Params(), depth: int | None = None) -> Shredded:
    """docs: (doc_id, json), other columns ignored. Documents that don't parse are left out. depth: no values below it are asked for."""
    level = docs.select("doc_id", once(F.expr("try_parse_json(json)")).alias("v")).where("v IS NOT NULL")
    none = F.lit(None).cast("string")
    level = level.select("doc_id", F.xxhash64("doc_id", F.lit("$")).alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("$").alias("path"), none.alias("parent"), none.alias("key"), F.lit(0).alias("depth"), "v")
    found, own = Shredded(None, {}), []
    while True:
        typed = _kept(_typed(level), params)
        summary = _summary(typed).limit(params.max_paths + 1).collect()  # as many rows as paths
        if len(summary) > params.max_paths:
            typed.unpersist()
            wide = _wide(level, params)
            typed = _kept(_typed(_maps(level, wide)), params)
            own[-1:] = [_without_keys(x, wide) for x in own[-1:]]
            summary = _summary(typed).collect()  # at most max_keys rows and types for each path of the level above
        found.levels.append(typed)
        own.append(typed)
        tuples = [r.path for r in summary if r.type == "array" and r.low == r.high and 0 < r.high <= params.max_tuple]
        found.tuples.update(tuples)
        found.kinds.update({(r.path, r.type): (r["count"], r.low, r.high) for r in summary})
        if len(own) - 1 == depth or not any(r.type in ("object", "array") and r.high for r in summary):
            break
        if len(found.levels) > params.max_depth:
            found.release()
            raise ValueError(f"documents are nested deeper than max_depth = {params.max_depth}; raise it, or use shred_strict")
        inner = typed.where(F.col("type").isin("object", "array") & (F.col("n") > 0)).select("doc_id", "node_id", "path", "depth", "type", "v")
        kids = inner.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "k", "item"))
        step = F.when(F.col("type") == "object", F.concat(F.lit("."), "k"))
        if tuples:
            step = step.when(F.col("path").isin(tuples), F.concat(F.lit("["), "pos", F.lit("]")))
        step = step.otherwise("[*]")
        level = kids.select("doc_id", F.xxhash64("node_id", "pos", "k").alias("node_id"), F.col("node_id").alias("parent_id"), F.concat("path", step).alias("path"), F.col("path").alias("parent"), F.col("k").alias("key"), (F.col("depth") + 1).alias("depth"), F.col("item").alias("v"))
    for df in own:
        df = df.select(*NODE_COLUMNS)
        found.nodes = df if found.nodes is None else found.nodes.unionByName(df)
    return found


# --- strict shredding: the last of duplicate keys counts, whole numbers of any size stay exact ---


def walk_values(value, path: str = "$") -> Iterator[tuple]:
    """(path, parent, key, depth, type, n, text) of each value, arrays as lists; used where VARIANT isn't exact enough."""
    todo = [(value, path, None, None, 0)]
    while todo:
        v, here, parent, key, depth = todo.pop()
        if isinstance(v, dict):
            yield here, parent, key, depth, "object", len(v), None
            todo += [(x, f"{here}.{k}", here, k, depth + 1) for k, x in v.items()]
        elif isinstance(v, list):
            yield here, parent, key, depth, "array", len(v), None
            todo += [(x, f"{here}[*]", here, None, depth + 1) for x in v]
        elif v is None:
            yield here, parent, key, depth, "null", None, None
        elif isinstance(v, bool):
            yield here, parent, key, depth, "boolean", None, str(v).lower()
        elif isinstance(v, str):
            yield here, parent, key, depth, "string", None, v
        else:
            yield here, parent, key, depth, "integer" if isinstance(v, int) else "number", None, str(v)


def parse_strict(text: str | None):
    """The document, or None if it can't be read; infinite numbers aren't JSON."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        return json.loads(text, parse_float=Decimal, parse_constant=refuse)
    except (ValueError, TypeError, RecursionError, InvalidOperation):
        return None


def shred_strict(docs: DataFrame) -> DataFrame:
    """(doc_id, path, parent, key, depth, type, n, text), by Arrow batches; arrays are lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None and (text.strip() == "null" or parse_strict(text) is not None):
                    rows += [(doc, *r) for r in walk_values(parse_strict(text))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "path", "parent", "key", "depth", "type", "n", "text"])

    return docs.select("doc_id", "json").mapInArrow(run, "doc_id long, path string, parent string, key string, depth int, type string, n long, text string")
