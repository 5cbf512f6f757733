"""Where schemas and tables of values go."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame

from schemaloom.model import Node, document, walk


def schema_json(n: Node, pretty: bool = True) -> str:
    return json.dumps(document(n), indent=2 if pretty else None, ensure_ascii=False, default=str)


def write_schema(n: Node, path: str, pretty: bool = True) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(schema_json(n, pretty) + "\n")


def value_rows(n: Node) -> list[list]:
    """A header of leaf paths in order, and their examples in order below, filled up with empty strings."""
    found = sorted((p, sorted(x.facts["examples"], key=lambda v: (isinstance(v, str), v))) for p, x in walk(n) if x.get("examples"))
    height = max((len(v) for _, v in found), default=0)
    return [[p for p, _ in found], *([v[k] if k < len(v) else "" for _, v in found] for k in range(height))]


def value_csv(n: Node) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(value_rows(n))
    return out.getvalue()


def write_values(values: DataFrame, path: str) -> None:
    """The value table in long form, for tables too wide for the driver."""
    values.write.mode("overwrite").option("header", True).csv(path)


def dump(path: str, **schemas: Node) -> None:
    """Debug dumps: one file per schema (train, test, final, transformed)."""
    for name, n in schemas.items():
        write_schema(n, f"{path}/{name}.json")
