"""Split discovery: a schema of one part of the documents, widened until it accepts the other part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from schemaloom.model import Node, covers, expand, gaps
from schemaloom.operators.tables import split_documents
from schemaloom.params import Params
from schemaloom.plans.discover import discover_schema


@dataclass(frozen=True)
class Split:
    train: Node
    test: Node
    final: Node
    incompatible: list[tuple[str, str]]


def split_discover(docs: DataFrame, fraction: float, params: Params = Params(), *, expand_: bool = True, oblivious: bool = False) -> Split:
    """``fraction`` of the documents train. Oblivious expansion doesn't look at the test schema."""
    first, second = split_documents(docs, fraction, params.seed)
    train, test = discover_schema(first, params), discover_schema(second, params)
    final = train
    if oblivious:
        final = expand(train, None, params.relation)
    elif expand_:
        final = expand(train, test, params.relation)
    return Split(train, test, final, [] if covers(final, test) else list(gaps(final, test)))
