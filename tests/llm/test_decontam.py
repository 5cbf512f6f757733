import random
from dataclasses import replace

from helpers import awkward, documents, prose

from schemaloom.llm.decontam import Index, Settings, clean_documents, leaks, parts, words


def items():
    rng = random.Random(7)
    return [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(12, 50))) + ". " + prose(rng, 6)) for i in range(60)]


def test_wand_finds_exactly_what_full_scoring_finds():
    rng = random.Random(0)
    index = Index(items(), Settings())
    for threshold in (0.05, 0.2, 0.5):
        index.s = replace(index.s, threshold=threshold)
        for _ in range(60):
            terms = sorted(set(rng.sample(range(len(index.lists)), 40)) | {index.number[w] for w in words(rng.choice(items())[1])})
            scores = {}
            for t in terms:
                for i, x in zip(index.lists[t].items, index.lists[t].impacts, strict=True):
                    scores[i] = scores.get(i, 0) + x
            assert sorted(i for i, _ in index.search(terms)) == sorted(i for i, x in scores.items() if x >= threshold - 1e-9)


def test_bound_never_loses_a_passage():
    rng = random.Random(3)
    index = Index(items(), Settings(threshold=0.3))
    for _ in range(30):
        ws = words(prose(rng, 200) + " " + rng.choice(items())[1] + " " + prose(rng, 90))
        numbers = [index.number.get(w, -1) for w in ws]
        import numpy as np

        found = set(index.passages(np.array(numbers)).tolist())
        for k in range(-(-len(ws) // 32)):
            if index.search(sorted({t for t in numbers[k * 32 : k * 32 + 64] if t >= 0})):
                assert k in found


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(1)
    own = items()
    rows = [(i, prose(rng, 150), "en", "s", 1) for i in range(20)]
    for i in range(20):
        text = own[i][1]
        if i % 2:
            ws = text.split()
            ws[len(ws) // 2] = "CHANGED"
            text = " ".join(ws).upper()
        rows.append((100 + i, prose(rng, rng.randint(0, 120)) + "\n" + text + " " + prose(rng, 40), "en", "s", 1))
    bench = spark.createDataFrame([*own, (1000, None), (1001, "")], "item_id long, text string")
    for block in (64_000_000, 2_000):
        s = Settings(max_block_chars=block)
        got = {(r.doc_id, r.item_id) for r in leaks(documents(spark, rows), bench, s).collect()}
        assert got == {(100 + i, i) for i in range(20)}
        kept = clean_documents(documents(spark, rows), bench, s)
        assert {r.doc_id for r in kept.collect()} == set(range(20)) and kept.columns == documents(spark).columns


def test_awkward_rows(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert leaks(documents(spark), bench).count() == 0
    clash = clean_documents(documents(spark).selectExpr("*", "'mine' AS leaks", "1 AS `a.b`"), bench).collect()
    assert len(clash) == len(awkward()) and {r.leaks for r in clash} == {"mine"}
    assert leaks(documents(spark, []), bench).count() == 0
    assert leaks(documents(spark), bench.limit(0)).count() == 0
    assert parts("What is it? It is this one.") == (["what", "is", "it"], ["it", "is", "this", "one"]) and parts("a b c") == (["a", "b"], ["c"])


def test_long_items_are_found_whole():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    rows = [(i, " ".join(word() for _ in range(n - 12)) + "? " + " ".join(word() for _ in range(12))) for i, n in enumerate((70, 100, 150, 220, 330, 500, 1000))]
    index = Index([*rows, *((100 + i, t) for i, t in items())], Settings())
    for shift in (0, 7, 33, 90):
        for i, t in rows:
            ws = t.split()
            edited = [w if k % 20 else "changed" for k, w in enumerate(ws)]
            for text in (ws, edited):
                got = index.matches(" ".join([prose(rng, shift), *text, prose(rng, 40)]))
                assert [g[0] for g in got] == [i]
            assert index.matches(" ".join([prose(rng, shift), *ws[: len(ws) // 2], prose(rng, 40)])) == []
