"""Command line: discover a schema, validate documents, or serve validation requests line by line."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from typing import IO

from pyspark.sql import DataFrame, SparkSession

from schemaloom.model import LEVELS, Node, anomalies, worst
from schemaloom.operators import passes
from schemaloom.operators.relations import disjoint_key_sets
from schemaloom.operators.split import split_discover
from schemaloom.operators.validate import find_anomalies
from schemaloom.params import PROPERTY_SETS, Params
from schemaloom.plans.discover import discover_schema
from schemaloom.plans.shred import shred
from schemaloom.sources.documents import read_any
from schemaloom.sources.schema_import import Unsupported, load
from schemaloom.sources.sinks import dump, schema_json, value_csv, write_schema


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="schemaloom", description=__doc__)
    p.add_argument("input", nargs="?", help="path, URL or - for standard input")
    p.add_argument("--validate", metavar="SCHEMA", help="validate the input against a JSON Schema file")
    p.add_argument("--serve", action="store_true", help="answer validation requests on standard input")
    p.add_argument("--write-output", metavar="FILE")
    p.add_argument("--write-values", metavar="FILE")
    p.add_argument("--prop", choices=sorted(PROPERTY_SETS), default="All")
    p.add_argument("--only-properties", nargs="*")
    p.add_argument("--without-properties", nargs="*")
    p.add_argument("--equivalence-relation", choices=["Kind", "Label", "IntersectingLabel", "TypeMatch"], default="Kind")
    p.add_argument("--additional-properties", action="store_true")
    p.add_argument("--max-examples", type=int, default=100)
    p.add_argument("--format-threshold", type=float, default=1.0)
    p.add_argument("--extended-formats", action="store_true")
    p.add_argument("--numeric-strings", action="store_true")
    p.add_argument("--reset-format-length", action="store_true")
    p.add_argument("--add-definitions", action="store_true")
    p.add_argument("--detect-dynamic", action="store_true")
    p.add_argument("--detect-disjoint", action="store_true")
    p.add_argument("--detect-enums", action="store_true")
    p.add_argument("--split", type=float, metavar="FRACTION")
    p.add_argument("--never-expand", action="store_true")
    p.add_argument("--oblivious-expansion", action="store_true")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--debug", metavar="FOLDER")
    p.add_argument("--compact", action="store_true")
    return p


def params_of(a: argparse.Namespace) -> Params:
    out = Params(relation=a.equivalence_relation, additional_properties=a.additional_properties, extended_formats=a.extended_formats, format_threshold=a.format_threshold, max_examples=a.max_examples, numeric_strings=a.numeric_strings, reset_format_length=a.reset_format_length, seed=a.seed).named(a.prop)
    if a.only_properties:
        out = out.only(*a.only_properties)
    if a.without_properties:
        out = out.without(*a.without_properties)
    return replace(out)


def serve(lines: IO[str], out: IO[str]) -> None:
    """The start/dialect/run/stop protocol of schema test harnesses: one JSON request a line."""
    for line in lines:
        request = json.loads(line)
        command = request.get("cmd")
        if command == "start":
            reply = {"version": 1, "implementation": {"language": "python", "name": "schemaloom", "dialects": ["https://json-schema.org/draft/2020-12/schema"]}}
        elif command == "dialect":
            reply = {"ok": True}
        elif command == "run":
            case = request["case"]
            try:
                schema = load(case["schema"])
                reply = {"seq": request.get("seq"), "results": [{"valid": worst(anomalies(schema, t["instance"])) < LEVELS["info"]} for t in case["tests"]]}
            except Unsupported as e:
                reply = {"seq": request.get("seq"), "skipped": True, "message": str(e)}
        else:
            break
        out.write(json.dumps(reply) + "\n")
        out.flush()


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.serve:
        serve(sys.stdin, sys.stdout)
        return 0
    spark = SparkSession.builder.appName("schemaloom").getOrCreate()
    docs = read_any(spark, a.input)
    if a.validate:
        with open(a.validate, encoding="utf-8") as f:
            found = find_anomalies(docs, load(json.load(f)))
        rows = found.groupBy("level").count().collect()
        print(json.dumps({r["level"]: r["count"] for r in rows}))
        return int(any(r["level"] == "fatal" for r in rows))
    params, other = params_of(a), None
    if a.split:
        parts = split_discover(docs, a.split, params, expand_=not a.never_expand, oblivious=a.oblivious_expansion)
        schema, other = parts.final, parts.test
        if a.debug:
            dump(a.debug, train=parts.train, test=parts.test, final=parts.final)
        for path, name in parts.incompatible:
            print(f"incompatible: {path} {name}", file=sys.stderr)
    else:
        schema = discover_schema(docs, params)
    schema = finish(schema, a, params, other, docs)
    if a.debug:
        dump(a.debug, transformed=schema)
    if a.write_values:
        with open(a.write_values, "w", encoding="utf-8") as f:
            f.write(value_csv(schema))
    if a.write_output:
        write_schema(schema, a.write_output, not a.compact)
    else:
        print(schema_json(schema, not a.compact))
    return 0


def finish(schema: Node, a: argparse.Namespace, params: Params, other: Node | None, docs: DataFrame) -> Node:
    groups = disjoint_key_sets(shred(docs).nodes) if a.detect_disjoint else None
    return passes.apply(schema, params, dynamic_=a.detect_dynamic, disjoint=a.detect_disjoint, definitions=a.add_definitions, enum=a.detect_enums, other=other, key_groups=groups)


if __name__ == "__main__":
    sys.exit(main())
