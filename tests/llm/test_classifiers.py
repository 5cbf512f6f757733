import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, prose

from schemaloom.llm.linear import Ftrl, Settings, bucket_of, difference, features, held_out, labelled_sample, score_text, tokens, train
from schemaloom.llm.quality import good_documents, quality_scores
from schemaloom.llm.toxicity import SETTINGS, SWAPS, counterfactual, fit_toxicity, toxicity_scores

JUNK = "win!!! $$$ click### now%%%"


def corpus(n=400):
    rng = random.Random(2)
    return [(i, prose(rng, 60) + (f" {JUNK}" * 5 if i % 5 == 0 else "") + (" awful idiot" if i % 7 == 0 else ""), "en", "s", 1) for i in range(n)] + [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "x", None, None, None)]


def labels(spark, n=400):
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(0, n, 2)] + [(1, None, None), (None, 1, 1), (777_777, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out_rows_are_never_learned_from(spark):
    got = {r.doc_id for r in labelled_sample(documents(spark, corpus()), labels(spark), "quality", 10_000).collect()}
    assert got and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in got)
    df = documents(spark, corpus())
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.select("doc_id", held_out(df.doc_id).alias("h")).collect() if r.doc_id is not None)
    assert df.select(bucket_of(df.doc_id)).count() == len(corpus())


def test_quality_on_held_out_rows(spark):
    s = Settings(bits=14)
    got = quality_scores(documents(spark, corpus()), labels(spark), s).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    judged = [(r.doc_id % 5 != 0, r.score >= 0.7) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97
    kept = good_documents(documents(spark, corpus()), labels(spark), settings=s)
    assert kept.columns == documents(spark).columns and 0 < kept.count() < len(corpus())
    clash = good_documents(documents(spark, corpus()).selectExpr("*", "'mine' AS score"), labels(spark), settings=s)
    assert {r.score for r in clash.collect()} == {"mine"}


def test_toxicity_and_neutral_mentions(spark):
    docs = documents(spark, corpus() + [(5000 + k, prose(random.Random(k), 40) + " women and muslims and gay people", "en", "s", 1) for k in range(10)])
    got = {r.doc_id: r.score for r in toxicity_scores(docs, labels(spark), SETTINGS).collect()}
    judged = [(i % 7 == 0, got[i] >= 0.3) for i in range(400)]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97
    assert all(got[5000 + k] < 0.3 for k in range(10))


def test_counterfactuals_and_penalty():
    assert counterfactual([b"women", b"x"], 1) == [b"men", b"x"] and counterfactual([], 1) is None
    assert sum(w in SWAPS for w in counterfactual([b"a", b"b"], 4)) == 1
    s = Settings(bits=12, l1=0.0, swap_penalty=1.0)
    rows = [(tokens("women are idiots"), 1.0), (tokens("men are fine"), 0.0)] * 40
    drift = []
    for penalty in (0.0, 1.0):
        f = Ftrl(Settings(bits=12, l1=0.0, swap_penalty=penalty))
        for words, y in rows:
            f.learn(*features(words, s), y)
            f.agree(*difference(features(words, s), features(counterfactual(words, 0), s)))
        a, b = features(tokens("women"), s), features(tokens("men"), s)
        drift.append(abs(float(f.weights(a[0]) @ a[1] - f.weights(b[0]) @ b[1])))
    assert drift[1] < drift[0]


def test_without_labels_and_empty(spark):
    none = labels(spark).limit(0)
    assert {r.score for r in quality_scores(documents(spark, corpus(5)), none, Settings(bits=10)).collect()} == {0.5}
    assert quality_scores(documents(spark, []), labels(spark), Settings(bits=10)).count() == 0
    assert train(labelled_sample(documents(spark), none, "toxic", 5), Settings(bits=10)).trained_on == 0


def plain_ftrl(rows, s, swap):
    """FTRL-proximal over dictionaries, one feature at a time."""
    rows = [(features(w, s), y, swap and features(swap(w, k), s)) for k, (w, y) in enumerate(rows)]
    rows = [(dict(zip(i.tolist(), map(float, x.astype(np.float32)))), y, o and dict(zip(o[0].tolist(), o[1].tolist()))) for (i, x), y, o in rows]
    seen = Counter(i for own, _, other in rows for i in {*own, *(other or {})})
    z, n, zb, nb = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    def move(x, slope):
        w = {i: weight(i) for i in x}
        for i, v in x.items():
            g = slope * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
            n[i] += g * g

    for _ in range(s.epochs):
        for own, y, other in rows:
            own = {i: v for i, v in own.items() if seen[i] >= s.min_docs}
            b = -zb / ((s.beta + math.sqrt(nb)) / s.alpha)
            e = 1 / (1 + math.exp(-b - sum(weight(i) * v for i, v in own.items()))) - y
            move(own, e)
            zb, nb = zb + e - (math.sqrt(nb + e * e) - math.sqrt(nb)) / s.alpha * b, nb + e * e
            if other:
                gap = {i: own.get(i, 0.0) - other.get(i, 0.0) for i in {*own, *other} if seen[i] >= s.min_docs}
                gap = {i: v for i, v in gap.items() if v}
                move(gap, 2 * s.swap_penalty * sum(weight(i) * v for i, v in gap.items()))
    return {i: weight(i) for i in seen}


@pytest.mark.parametrize(("s", "swap"), [(Settings(bits=12), None), (Settings(bits=12, prefixes=(4, 5), min_docs=2, l1=0.2, l2=0.0, swap_penalty=1.0), counterfactual)])
def test_training_equals_plain_loops(spark, s, swap):
    rows = [(i, t, "en", "s", 1) for i, t in ((i, prose(random.Random(i), 12) + (" awful women" if i % 3 == 0 else "")) for i in range(30))]
    y = {i: float(i % 3 == 0) for i in range(30)}
    sample = spark.createDataFrame([(i, t, y[i]) for i, t, *_ in rows], "doc_id long, text string, y double")
    model = train(sample, s, swap)
    order = [r.doc_id for r in sample.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect()]
    texts = {i: t for i, t, *_ in rows}
    want = plain_ftrl([(tokens(texts[i]), y[i]) for i in order], s, swap)
    assert any(want.values())
    assert all(abs(model.weights[i] - w) < 1e-5 for i, w in want.items())


def test_repeated_rows_count_once_and_features_are_bounded(spark):
    s = Settings(bits=12, max_train=20)
    rows = corpus(60)
    once, often = documents(spark, rows), documents(spark, rows + [rows[4]] * 90 + [(rows[4][0], "zz other text", "en", "s", 1)])
    a, b = (train(labelled_sample(d, labels(spark, 60), "quality", s.max_train), s) for d in (once, often))
    assert a.trained_on == b.trained_on == 20 and (a.weights == b.weights).all()
    few = train(labelled_sample(once, labels(spark, 60), "quality", 20), Settings(bits=12, max_features=300))
    assert 0 < few.trained_on < 20


def test_the_penalty_spares_neutral_mentions(spark):
    """A group that mostly toxic sentences mention: without the penalty its mere mention is flagged, with it far less."""
    rng = random.Random(9)
    rows = [(i, prose(rng, 25) + (" muslims" if rng.random() < (0.9 if i % 3 == 0 else 0.02) else "") + (rng.choice([" awful", " idiot", " vile"]) if i % 3 == 0 and rng.random() < 0.7 else ""), "en", "s", 1) for i in range(300)]
    tags = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    neutral = [tokens(prose(random.Random(5000 + k), 25) + " muslims") for k in range(60)]
    flagged = []
    for penalty in (0.0, 1.0):
        s = Settings(prefixes=(4, 5, 6, 7, 8), min_docs=4, bits=16, l1=1.0, l2=0.0, epochs=4, swap_penalty=penalty)
        model = fit_toxicity(documents(spark, rows), tags, s)
        flagged.append(sum(score_text(w, model) >= 0.3 for w in neutral))
    assert flagged[0] > 30 and flagged[1] < flagged[0] / 2


def test_toxicity_of_empty_tables_clashing_columns_and_long_texts(spark):
    s = Settings(prefixes=(4, 5), min_docs=2, bits=10)
    assert toxicity_scores(documents(spark, []), labels(spark), s).count() == 0
    df = documents(spark, [*corpus(40), (8000, "word " * 50_000, "en", "s", 1)]).selectExpr("*", "'mine' AS score", "1 AS y", "2 AS toxic")
    got = toxicity_scores(df, labels(spark), s).collect()
    assert len(got) == 44 and all(0 <= r.score <= 1 and r.y == 1 for r in got)
