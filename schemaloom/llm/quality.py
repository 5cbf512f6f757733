"""Document quality: hashed word n-gram logistic regression with FTRL updates (see linear.py).

Defined cases: those of linear.py; a column named score is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from schemaloom.llm.common import free_name
from schemaloom.llm.linear import Model, Settings, labelled_sample, scored, train

SETTINGS = Settings()
THRESHOLD = 0.7


def fit_quality(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> Model:
    return train(labelled_sample(docs, labels, "quality", settings.max_train), settings)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return scored(docs, fit_quality(docs, labels, settings))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, settings: Settings = SETTINGS) -> DataFrame:
    """The documents that score the threshold or more, with their own columns."""
    columns = docs.columns
    return scored(docs, fit_quality(docs, labels, settings), at_least=threshold, name=free_name(docs, "score")).select(*(f"`{c}`" for c in columns))
