"""When objects found at one place are one schema: all of them, or by their keys (equivalence relations).

Each object gets a group; objects of different groups are different schemas. Only distinct key sets (or key and type
signatures), which are few, decide about groups; objects are joined to their group by signature.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.operators.monoids import key_sets


def signatures(nodes: DataFrame, with_types: bool = False) -> DataFrame:
    """(path, node_id, signature) of every object; keys are sorted, types are shallow and numbers are one type."""
    if not with_types:
        return key_sets(nodes).select("path", "node_id", F.array_join("keys", "\x00").alias("signature"))
    kind = F.when(F.col("type") == "integer", "number").otherwise(F.col("type"))
    part = F.concat("key", F.lit("\x01"), kind)
    own = nodes.where(F.col("key").isNotNull()).groupBy("parent_id").agg(F.array_join(F.array_sort(F.collect_set(part)), "\x00").alias("signature"))
    return nodes.where("type = 'object'").select("path", "node_id").join(own, F.col("node_id") == F.col("parent_id"), "left").select("path", "node_id", F.coalesce("signature", F.lit("")).alias("signature"))


def label_groups(nodes: DataFrame) -> DataFrame:
    """(path, signature, objects): one group per key set."""
    return signatures(nodes).groupBy("path", F.regexp_replace("signature", "\x00", ",").alias("keys")).agg(F.count("*").alias("objects"))


def connected(sets: Iterable[frozenset[str]]) -> list[set[str]]:
    """Keys of sets that share keys, joined until none do; a key that is alone stays a set of its own."""
    out: list[set[str]] = []
    for s in sets:
        merged = set(s)
        rest = []
        for o in out:
            if o & merged:
                merged |= o
            else:
                rest.append(o)
        out = [*rest, merged]
    return sorted(out, key=lambda s: sorted(s))


def groups(nodes: DataFrame, relation: str) -> DataFrame:
    """(path, node_id, group): group is a number, dense per path, in the order of the groups' least signatures."""
    spark = nodes.sparkSession
    own = signatures(nodes, with_types=relation == "TypeMatch")
    if relation == "Kind":
        return own.select("path", "node_id", F.lit(0).alias("group"))
    kinds: dict[str, list[str]] = {}
    for r in own.select("path", "signature").distinct().orderBy("path", "signature").collect():  # a row per key set
        kinds.setdefault(r.path, []).append(r.signature)
    rows = []
    for path, all_ in kinds.items():
        if relation == "Label":
            rows += [(path, s, k) for k, s in enumerate(all_)]
        elif relation == "IntersectingLabel":
            joined = connected(frozenset(s.split("\x00")) for s in all_)
            rows += [(path, s, next(k for k, g in enumerate(joined) if set(s.split("\x00")) & g)) for s in all_]
        else:  # TypeMatch: a greedy grouping, in order
            made: list[dict[str, str]] = []
            for s in all_:
                types = dict(p.split("\x01") for p in s.split("\x00") if p)
                for k, g in enumerate(made):
                    if all(g[key] == t for key, t in types.items() if key in g):
                        g.update(types)
                        rows.append((path, s, k))
                        break
                else:
                    made.append(types)
                    rows.append((path, s, len(made) - 1))
    table = F.broadcast(spark.createDataFrame(rows, "path string, signature string, `group` int"))
    return own.join(table, ["path", "signature"]).select("path", "node_id", "group")


def disjoint_key_sets(nodes: DataFrame) -> dict[str, list[set[str]]]:
    """For each path of an object the groups of its keys that never occur together across groups.

    Keys of an object are linked to its least one; each task reduces its links to a forest, so that the driver gets at
    most (keys x tasks) of them.
    """
    own = key_sets(nodes).where(F.size("keys") > 0).select("path", "keys").distinct()
    links = own.select("path", F.col("keys")[0].alias("least"), F.explode("keys").alias("key")).distinct()

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[tuple[str, str], str] = {}

        def find(path: str, key: str) -> str:
            while (up := root.setdefault((path, key), key)) != key:
                key = up
            return key

        for batch in batches:
            for path, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = find(path, a), find(path, b)
                root[path, max(a, b)] = min(a, b)
        rows = [(path, find(path, key), key) for path, key in root]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["path", "least", "key"])

    sets: dict[str, list[frozenset[str]]] = {}
    for r in links.mapInArrow(forest, "path string, least string, key string").collect():
        sets.setdefault(r.path, []).append(frozenset([r.least, r.key]))
    return {p: connected(s) for p, s in sets.items()}
