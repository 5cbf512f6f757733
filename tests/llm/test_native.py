import re
from collections import Counter
from pathlib import Path

from helpers import awkward, documents

from schemaloom.llm.licenses import KNOWN, TITLES, scan_licenses
from schemaloom.llm.rules import judge, measured


def measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts = Counter(windows)
    inside = {j for i, g in enumerate(windows) if counts[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def rows():
    return awkward() + [(900, "a b c d e f g h " * 3 + "x y", "en", "s", 1), (901, "l1 # |\nl1 # |\n \n \nl1 # |", "en", "s", 1), (902, "a " * 40, "en", "s", 1)]


def test_measures_equal_brute_force(spark):
    got = sorted((tuple(r)[:1] + (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in measured(documents(spark, rows())).collect()), key=str)
    assert got == sorted(((d, *measures(t)) for d, t, *_ in rows()), key=str)


def test_verdicts(spark):
    got = judge(documents(spark, rows())).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert any(r.kept for r in got)
    assert judge(documents(spark, [])).count() == 0


def test_thresholds_follow_the_group(spark):
    text = lambda k, symbols: " ".join(f"w{k}x{j}" + "#" * symbols for j in range(30))
    rows = [(i, text(i, 2), "en", "loud", 1) for i in range(300)] + [(1000 + i, text(i, 0), "en", "calm", 1) for i in range(300)] + [(5000, text(1, 2), "en", "calm", 1)]
    got = {r.doc_id: r.kept for r in judge(documents(spark, rows)).collect()}
    assert all(got[i] for i in range(300)) and all(got[1000 + i] for i in range(300)) and not got[5000]


def test_licenses(spark):
    mit = next(t for n, t in KNOWN if n == "MIT" and len(t) > 500)
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE"), None, None, None), (2, "text\n  released under the mit licence!\nmore", None, None, None), (3, mit + " and more", None, None, None), (4, None, None, None, None), (None, "Released under the MIT License.", None, None, None), (2, "Licensed under CC BY-NC 4.0.", None, None, None)]
    got = sorted(((r.doc_id, r.license_id, r.n_notices, r.notices) for r in scan_licenses(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "MIT", 0, ""), (2, None, 2, "CC-BY-NC-4.0,MIT"), (2, "CC-BY-NC-4.0", 2, "CC-BY-NC-4.0,MIT"), (3, None, 0, ""), (4, None, 0, ""), (None, "MIT", 0, "")], key=str)
    assert scan_licenses(documents(spark, [])).count() == 0


def test_small_groups_are_drawn_to_larger_ones_and_names_may_clash(spark):
    text = lambda k, symbols: " ".join(f"w{k}x{j}" + "#" * symbols for j in range(30))
    rows = [(i, text(i, 0), "en", "calm", 1) for i in range(200)] + [(900 + i, text(i, 1), "en", "tiny", 1) for i in range(2)] + [(950 + i, text(i, 1), "xx", None, 1) for i in range(200)] + [(2000, "# " * 60_000, "en", "calm", 1), (None, text(7, 0), None, "calm", 1)] * 2
    df = documents(spark, rows).selectExpr("*", "1 AS t", "2 AS size", "'x' AS measure", "3 AS max_symbols", "4 AS n_words")
    got = judge(df).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and all(kept[i] for i in range(200)) and kept[None] and not kept[2000]
    assert all(kept[950 + i] for i in range(200))  # symbols are usual there


def test_licenses_of_tables_with_clashing_names(spark):
    df = documents(spark, [(1, "Released under the MIT License.", "en", "s", 1), (1, "", None, None, None)]).selectExpr("*", "'x' AS digest", "'y' AS license_id", "1 AS line", "2 AS notices")
    assert sorted((r.doc_id, r.license_id or "", r.notices) for r in scan_licenses(df).collect()) == [(1, "", "MIT"), (1, "MIT", "MIT")]


def test_licence_files_as_published(spark):
    text = {n: t for n, t in KNOWN if len(t) > 300}
    rows = [(k, f"{title}\n\nCopyright (c) 2021, A. Writer\nAll rights reserved.\n\n{text[n]}\n", "en", "s", 1) for k, (n, title) in enumerate(TITLES)]
    files = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    found = {k: p for k, p in ((k, Path("/usr/share/common-licenses", v)) for k, v in files.items()) if p.exists()}
    rows += [(100 + k, p.read_text(), "en", "s", 1) for k, p in enumerate(found.values())]
    got = {r.doc_id: r.license_id for r in scan_licenses(documents(spark, rows)).collect()}
    assert [got[k] for k in range(len(TITLES))] == [n for n, _ in TITLES]
    assert [got[100 + k] for k in range(len(found))] == list(found)
