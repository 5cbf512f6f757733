import random
from collections import Counter

import pytest
from helpers import awkward, documents, prose

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402

from schemaloom.llm.simhash import fingerprint  # noqa: E402


def tables(spark, folder):
    rng = random.Random(11)
    line = "one line of more than twenty characters that many documents share"
    item = "which " + " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(25)) + "? " + "the answer is " + " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(5))
    rows = []
    for i in range(300):
        text = prose(rng, 80)
        if i % 6 == 0:
            text += " win!!! $$$ click### now%%%" * 6
        if i % 10 == 1:
            text = line + "\n" + text
        if i % 50 == 3:
            text += " " + item
        rows.append([i, text, "en", "src0", len(text)])
    for i in range(20):
        rows.append([1000 + i, rows[7][1], "en", "src1", rows[7][4]])
    documents(spark, [tuple(r) for r in rows]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, line


def test_each_stage_does_its_work_on_what_is_left(spark, tmp_path):
    rows, line = tables(spark, tmp_path)
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        got = out.collect()
        sizes.append(len(got))
        if name != "pack":
            assert out.columns == docs.columns
        if name == "quality":
            kept = {r.doc_id for r in got}
            assert len(kept & {i for i in range(300) if i % 6 == 0}) <= 2 and len(kept) >= 265
        elif name == "line_dedup":
            holders = [r.doc_id for r in got if line in r.text]
            assert {r.doc_id for r in got} == kept and holders == [max(i for i in kept if i % 10 == 1 and i < 300)]
            assert all(r.n_chars == len(r.text) for r in got)
        elif name == "near_dedup":
            before = {r.doc_id: fingerprint(r.text, 5) for r in last}
            left = {r.doc_id for r in got}
            # The copies are one line each, which the stage before left in the last of them; the rest are empty, and one stays.
            assert left <= before.keys() and left & {7, *range(1000, 1020)} == {7, 1019}
            for i in before.keys() - left:
                assert any((before[i] ^ before[j]).bit_count() <= 3 for j in before if j < i)
        elif name == "decontaminate":
            assert {r.doc_id for r in got} == {i for i in left if i % 50 != 3 or i >= 300}
            clean = {r.doc_id for r in got}
        else:
            assert {r.doc_id for r in got} == clean
            used = Counter()
            for r in got:
                used[r.sequence_id] += r.length
            assert max(used.values()) <= 4096
        docs, last = out, got
    assert sizes[0] > sizes[2] > sizes[3]


def test_stages_take_nulls_repeats_clashing_names_and_empty_tables(spark, tmp_path):
    tables(spark, tmp_path)
    docs = documents(spark, awkward()).selectExpr("*", "1 AS score", "2 AS h", "'x' AS salt", "3 AS component_id", "4 AS hits", "5 AS piece", "6 AS id")
    for df in (docs, docs.limit(0)):
        rows = df.count()
        for name, stage in P.STAGES:
            got = stage(spark, df, str(tmp_path))
            n = got.count()
            assert n <= rows if not rows or name == "quality" else n >= 1
            if name != "pack":
                assert got.columns == docs.columns
            if rows and name == "line_dedup":
                assert n == rows
            if rows and name == "near_dedup":
                left = [r.doc_id for r in got.collect()]
                assert left.count(None) == 2 and all(left.count(i) == 1 for i in left if i is not None)
            if rows and name == "pack":
                assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}
