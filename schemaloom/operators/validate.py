"""Documents against any schema tree (imported ones too), by Arrow batches; the tree, which is small, is broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from schemaloom.model import LEVELS, Node, anomalies, ready
from schemaloom.plans.shred import parse_strict


def find_anomalies(docs: DataFrame, schema: Node, level: str = "info") -> DataFrame:
    """(doc_id, path, message, level) of at least that level. A document that can't be parsed is fatal."""
    shared = docs.sparkSession.sparkContext.broadcast(ready(schema))
    least = LEVELS[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = parse_strict(text)
                if value is None and (text or "").strip() != "null":
                    rows.append((doc, "$", "document can't be parsed", "fatal"))
                    continue
                rows += [(doc, a.path, a.message, a.level) for a in anomalies(tree, value) if LEVELS[a.level] >= least]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["doc_id", "path", "message", "level"])

    return docs.select("doc_id", "json").mapInArrow(run, "doc_id long, path string, message string, level string")
