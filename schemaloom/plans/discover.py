"""Documents to a property table and on to a schema tree.

The property table has one row per path, type and object group; all facts that are plain aggregates come from one
grouped aggregation. Facts of another shape (bins, examples, key pairs, divisors) are small tables of their own. Only
these tables reach the driver, where they are put together to a tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions import membership
from schemaloom.functions.exprs import format_of, formats
from schemaloom.model import ZERO, Node, merge, plain, top_format
from schemaloom.operators import monoids as M
from schemaloom.operators import relations
from schemaloom.params import Params
from schemaloom.plans.shred import Shredded, shred


def property_columns(params: Params) -> dict[str, Column]:
    """Aggregates for the wanted facts; the others are never computed."""
    d, s, n = F.col("d"), F.col("s"), F.col("n")
    numbers = params.properties["integer"] | params.properties["number"]
    out = {"count": F.count("*")}
    if "minimum" in numbers:
        out["min_d"], out["min_i"] = F.min(d), F.min("i")
    if "maximum" in numbers:
        out["max_d"], out["max_i"] = F.max(d), F.max("i")
    if "statistics" in numbers:
        out |= {"mean": F.avg(d), "variance": F.var_pop(d), "skewness": F.skewness(d), "kurtosis": F.kurtosis(d)}
    if "histogram" in numbers:
        out["extreme"] = F.bool_or(~F.col("i").between(-(2**63), 2**63 - 1))
    if "distinct" in numbers | params.properties["string"]:
        out["distinct"] = F.approx_count_distinct(F.coalesce(s, F.col("i").cast("string"), d.cast("string")))
    if params.properties["array"] - {"items"}:
        out["min_n"], out["max_n"] = F.min(n), F.max(n)
    text = params.properties["string"]
    if text & {"min_length", "max_length"}:
        out["min_length"], out["max_length"] = F.min(F.length(s)), F.max(F.length(s))
    if "format" in text:
        out["formats"] = F.struct(*(F.count_if(F.col("format") == name).alias(name) for name, _ in (*formats(params.extended_formats), ("none", ""))))
    if "pattern" in text:
        out |= {"low": F.min(s), "high": F.max(s), "back_low": F.min(F.reverse(s)), "back_high": F.max(F.reverse(s))}
    if params.numeric_strings:
        out["numeric"] = F.bool_and(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
    out |= {"trues": F.count_if("b"), "falses": F.count_if(~F.col("b"))}
    return out


def property_table(nodes: DataFrame, params: Params = Params(), by: tuple[str, ...] = ()) -> DataFrame:
    if "format" in params.properties["string"]:  # the cascade of patterns once a string, not once a format
        nodes = nodes.withColumn("format", F.when(F.col("type") == "string", format_of(F.col("s"), params.extended_formats)))
    return nodes.groupBy("path", "parent", "key", "type", *by).agg(*(c.alias(k) for k, c in property_columns(params).items()))


@dataclass
class Discovery:
    shredded: Shredded
    nodes: DataFrame
    table: DataFrame
    params: Params

    def schema(self) -> Node:
        return assemble(self)


def discover(docs: DataFrame, params: Params = Params()) -> Discovery:
    """docs: (doc_id, json). With a relation other than Kind, paths carry the group of each object: $.a<1>.b."""
    found = shred(docs, params)
    nodes = M.lift(found.nodes, found.lifted())
    if params.relation != "Kind":
        nodes = grouped_nodes(nodes, params.relation)
    return Discovery(found, nodes, property_table(nodes, params), params)


def grouped_nodes(nodes: DataFrame, relation: str) -> DataFrame:
    """Nodes whose path says to which group each object on the way belongs, from the root down."""
    own = relations.groups(nodes, relation).select(F.col("node_id").alias("_id"), F.when(F.col("group") > 0, F.concat(F.lit("<"), "group", F.lit(">"))).otherwise("").alias("mark"))
    marked = nodes.join(own, F.col("node_id") == F.col("_id"), "left").drop("_id")
    depths = [r.depth for r in nodes.select("depth").distinct().orderBy("depth").collect()]
    out = level = None
    for depth in depths:
        here = marked.where(F.col("depth") == depth)
        if level is not None:
            up = level.select(F.col("node_id").alias("_up"), F.col("path").alias("up_path"), F.col("plain").alias("up_plain"))
            here = here.join(up, F.col("parent_id") == F.col("_up")).withColumn("plain", F.col("path")).withColumn("parent", F.col("up_path"))
            here = here.withColumn("path", F.concat("up_path", F.expr("substring(plain, length(up_plain) + 1)"), F.coalesce("mark", F.lit(""))))
        else:
            here = here.withColumn("plain", F.col("path")).withColumn("path", F.concat("path", F.coalesce("mark", F.lit(""))))
        level = here.select(*nodes.columns, "plain")
        out = level if out is None else out.unionByName(level)
    return out.drop("plain")


def _prefix(a: str, b: str) -> str:
    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def _integer(x) -> int:
    return int(x)


def _facts(r, d: Discovery, extra: dict[str, dict]) -> dict[str, Any]:
    p, row, at = d.params, r.asDict(), (r.path, r.type)
    f: dict[str, Any] = {}
    has = lambda name: p.has(r.type, name)
    if r.type in ("integer", "number"):
        for name, col in (("minimum", "min"), ("maximum", "max")):
            if has(name):
                v = row[f"{col}_i"] if r.type == "integer" else row[f"{col}_d"]
                f[name] = (int(v) if r.type == "integer" else v, False)
        if has("multiple") and at in extra["multiple"]:
            m = extra["multiple"][at]
            f["multiple"] = int(m) if r.type == "integer" else m.normalize()
        if has("statistics") and row["mean"] is not None:
            n, var = r["count"], row["variance"] or 0.0
            f["statistics"] = {"n": n, "mean": row["mean"], "m2": var * n, "m3": (row["skewness"] or 0.0) * var**1.5 * n, "m4": ((row["kurtosis"] or 0.0) + 3) * var**2 * n}
        if has("distinct"):
            f["distinct"] = row["distinct"]
        if has("histogram"):
            f["histogram"] = extra["bins"].get(at, {})
            if row["extreme"]:
                f["extreme"] = True
    elif r.type == "string":
        f |= {k: row[k] for k in ("min_length", "max_length") if has(k)}
        if has("format"):
            found = {k: c for k, c in row["formats"].asDict().items() if c}
            best = top_format(found, p.format_threshold)
            f["formats"] = {best: r["count"]} if best else found
        if has("pattern"):
            pre, suf = _prefix(r.low, r.high), _prefix(r.back_low, r.back_high)[::-1]
            if len(pre) + len(suf) < r.min_length:
                f["affixes"] = {"prefix": pre, "suffix": suf, "count": r["count"]}
        if has("distinct"):
            f["distinct"] = row["distinct"]
        if has("length_histogram"):
            f["length_histogram"] = extra["lengths"].get(at, {})
        if p.numeric_strings:
            f["numeric"] = row["numeric"]
    elif r.type == "boolean":
        if has("constant"):
            f["constant"] = True if not r.falses else False if not r.trues else None
        if has("percent"):
            f["percent"] = (r.trues, r["count"])
    elif r.type == "array":
        if has("min_items"):
            f["min_items"] = row["min_n"]
        if has("max_items"):
            f["max_items"] = row["max_n"]
        if has("unique"):
            f["unique"] = extra["unique"].get(r.path, False)
        if has("length_histogram"):
            f["length_histogram"] = extra["lengths"].get(at, {})
    if has("bloom") and at in extra["bloom"]:
        f["bloom"] = extra["bloom"][at]
    if has("examples") and at in extra["examples"]:
        cast = {"integer": _integer, "number": lambda x: plain(Decimal(x)), "string": str}[r.type]
        f["examples"] = {cast(x) for x in extra["examples"][at]}
    return f


def _tables(d: Discovery) -> dict[str, dict]:
    p, nodes = d.params, d.nodes
    met = {t for _, t in d.shredded.kinds}  # no pass for facts of types that don't occur
    wanted_of = {t: v for t, v in p.properties.items() if t in met}
    numbers, any_ = wanted_of.get("integer", set()) | wanted_of.get("number", set()), lambda name: any(name in v for v in wanted_of.values())
    extra: dict[str, dict] = {k: {} for k in ("multiple", "bins", "lengths", "unique", "examples", "bloom", "dependencies")}
    if "multiple" in numbers:
        extra["multiple"] = {(r.path, r.type): r.multiple for r in M.multiples(nodes).collect()}
    for name, wanted, table in (("bins", "histogram", M.number_bins), ("lengths", "length_histogram", M.length_bins)):
        if any_(wanted):
            for r in table(nodes).collect():
                extra[name].setdefault((r.path, r.type), {})[(r.sign, r.bin)] = r["count"]
    if "unique" in wanted_of.get("array", ()):
        extra["unique"] = {r.path: r.is_unique for r in M.unique_arrays(nodes, p.max_examples).collect()}
    if any_("examples"):
        for r in M.examples(nodes, p.max_examples, p.seed).collect():
            extra["examples"].setdefault((r.path, r.type), []).append(r.value)
    if any_("bloom"):
        extra["bloom"] = {(r.path, r.type): membership.of_words(r.words) for r in M.bloom_filters(nodes).collect()}
    if "dependencies" in wanted_of.get("object", ()):
        for r in M.dependencies(nodes).collect():
            extra["dependencies"].setdefault(r.path, {}).setdefault(r.key, set()).add(r.needs)
    return extra


def assemble(d: Discovery) -> Node:
    """The tree of a discovery: children before parents."""
    rows, extra = d.table.collect(), _tables(d)
    kids: dict[str, dict[str | None, list]] = {}
    for r in rows:
        kids.setdefault(r.parent, {}).setdefault(r.path, []).append(r)

    def build(group: list) -> Node:
        nodes = []
        for r in sorted(group, key=lambda r: r.type):
            n = Node(r.type, _facts(r, d, extra))
            below = kids.get(r.path, {})
            if r.type == "object" and f"{r.path}.*" in below and all(x.key is None for x in below[f"{r.path}.*"]):
                n = Node("dynamic", items=build(below[f"{r.path}.*"]))
            elif r.type == "object":
                keyed: dict[str, list] = {}
                for own in below.values():
                    for x in own:
                        if x.key is not None:
                            keyed.setdefault(x.key, []).append(x)
                n.keys = {k: build(own) for k, own in sorted(keyed.items())}
                present = {k: sum(x["count"] for x in own) for k, own in keyed.items()}
                if d.params.has("object", "required"):
                    n.facts["required"] = {k for k, c in present.items() if c == r["count"]}
                if d.params.has("object", "presence"):
                    n.facts |= {"presence": present, "count": r["count"]}
                if d.params.has("object", "dependencies") and r.path in extra["dependencies"]:
                    n.facts["dependencies"] = extra["dependencies"][r.path]
                if d.params.has("object", "additional"):
                    n.facts["additional"] = d.params.additional_properties
            elif r.type == "array":
                inside = {p: own for p, own in below.items() if all(x.key is None for x in own)}
                base = r.path
                at = {}
                for p, own in inside.items():
                    step = p[len(base) :].split("]")[0] + "]"
                    at.setdefault(step, []).extend(own)
                if "[*]" in at:
                    n.items = build(at["[*]"])
                elif at:
                    n.tuple = [build(own) for _, own in sorted(at.items(), key=lambda kv: int(kv[0][1:-1]))]
                else:
                    n.tuple = []
            nodes.append(n)
        if len(nodes) == 1:
            return nodes[0]
        return Node("product", parts=nodes, counts=[sum(x["count"] for x in group if x.type == n.kind) if sum(1 for m in nodes if m.kind == n.kind) == 1 else 1 for n in nodes])

    roots = [r for own in kids.get(None, {}).values() for r in own]
    return build(roots) if roots else ZERO


def discover_schema(docs: DataFrame, params: Params = Params()) -> Node:
    d = discover(docs, params)
    try:
        return d.schema()
    finally:
        d.shredded.release()


def united(schemas: list[Node], relation: str = "Kind") -> Node:
    out: Node = ZERO
    for s in schemas:
        out = merge(out, s, "union", relation)
    return out
