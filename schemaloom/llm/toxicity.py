"""Toxicity: n-gram logistic regression with counterfactual regularisation.

Each training text gets a counterfactual: its identity terms swapped for others of their group or, if it has none, one
term put in at a fixed place. Training penalises the squared change of the score between the two, so that neither the mention
of a group nor which group it is moves the score, and neutral mentions aren't flagged. Features of counterfactuals count for
the least number of texts that a feature needs, so a term that few texts hold is held to the penalty as well.

Defined cases: those of linear.py; a text without words has no counterfactual; a column named score is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from schemaloom.llm.linear import Model, Settings, labelled_sample, scored, train

SETTINGS = Settings(prefixes=(4, 5, 6, 7, 8), min_docs=4, bits=20, l1=4.0, l2=0.0, epochs=4, swap_penalty=1.0)
THRESHOLD = 0.3

#: Identity terms by group, in lower case. A term is swapped for the next one of its group.
IDENTITY_TERMS = (
    "women men girls boys",
    "woman man girl boy",
    "black white asian latino arab indigenous",
    "muslim christian jewish hindu buddhist sikh atheist",
    "muslims christians jews hindus buddhists sikhs atheists",
    "gay lesbian straight bisexual transgender queer",
    "african european american mexican chinese indian turkish polish",
    "immigrants refugees foreigners locals citizens",
    "deaf blind disabled autistic",
    "frauen männer mädchen jungen",
    "femmes hommes filles garçons",
    "mujeres hombres chicas chicos",
)


def swaps() -> dict[bytes, bytes]:
    out = {}
    for group in IDENTITY_TERMS:
        terms = [t.encode() for t in group.split()]
        out |= dict(zip(terms, terms[1:] + terms[:1], strict=True))
    return out


SWAPS = swaps()
TERMS = sorted(SWAPS)


def counterfactual(words: list[bytes], number: int) -> list[bytes] | None:
    """The text with other identity terms, or with one put in; None for a text without words."""
    if any(w in SWAPS for w in words):
        return [SWAPS.get(w, w) for w in words]
    if not words:
        return None
    at = number % (len(words) + 1)
    return [*words[:at], TERMS[number % len(TERMS)], *words[at:]]


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> Model:
    return train(labelled_sample(docs, labels, "toxic", settings.max_train), settings, counterfactual)


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return scored(docs, fit_toxicity(docs, labels, settings))
