import hashlib
from collections import defaultdict

from helpers import awkward, documents

from schemaloom.llm.linededup import LineRuns, dedup_lines, document_lines, dropped_lines


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    where = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(-1 if d is None else d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(where[key(x)]) >= 3 and max(where[key(x)]) != (-1 if d is None else d))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    got = dedup_lines(documents(spark)).collect()
    mine = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got), key=str)
    assert mine == brute(awkward())
    assert any(r.n_dropped for r in got)


def test_batches_and_compaction_agree_with_one_batch(spark):
    lines = document_lines(documents(spark))
    store, whole = LineRuns(spark, fanout=2), LineRuns(spark)
    whole.add(lines)
    for k in range(5):
        store.add(lines.where(f"pmod(doc_id, 5) = {k}"))
    assert sum(map(len, store.runs().values())) <= 3
    assert sorted(map(tuple, store.all().collect())) == sorted(map(tuple, whole.all().collect()))
    assert store.unseen(lines).count() == 0
    assert LineRuns(spark).unseen(lines).count() == lines.count()


def test_each_line_stands_in_one_run_and_batches_are_merged(spark):
    store = LineRuns(spark, fanout=4)
    got = dedup_lines(documents(spark), store).collect()  # four batches
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got), key=str) == brute(awkward())
    assert list(store.runs()) == [1] and store.repeats().count() > 0
    hashes = [bytes(r.h) for r in store.lines().collect()]
    assert len(hashes) == len(set(hashes)) == document_lines(documents(spark)).select("h").distinct().count()


def test_compaction_that_breaks_off_loses_and_doubles_nothing(spark):
    lines = document_lines(documents(spark))
    whole, store = LineRuns(spark), LineRuns(spark, fanout=99)
    whole.add(lines)
    for k in range(3):
        store.add(lines.where(f"pmod(doc_id, 3) = {k}"), f"b{k}")
    want = sorted(map(tuple, whole.all().collect()))
    store._write(store._read(store.runs()[0]), "L1", tuple(store.runs()[0]))  # merged, nothing deleted yet
    assert sorted(map(tuple, store.all().collect())) == want and store.runs().keys() == {1}
    store.add(lines.where("pmod(doc_id, 3) = 1"), "b1")  # a batch that is there already
    store._fs.create(store._child("added-b7")).close()
    store.add(lines.where("pmod(doc_id, 3) = 1"), "b7")
    store._write(store._read(store.runs()[1]), "tmp-L9")  # a run that was never finished
    store.compact()
    assert sorted(map(tuple, store.all().collect())) == want and store.runs().keys() == {1}


def test_many_repeated_lines_without_broadcast(spark):
    rows = [(i, "\n".join(f"this is line number {k} of them all" for k in range(i % 7, 40)), "en", "s", 1) for i in range(12)]
    want = {i: gone for i, _, gone, _ in brute(rows)}
    got = {r.doc_id: len(r.drop) for r in dropped_lines(documents(spark, rows), max_broadcast=3).collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_empty_table_and_clashing_columns(spark):
    assert dedup_lines(documents(spark, [])).count() == 0
    df = documents(spark).selectExpr("*", "1 AS h", "2 AS n_lines", "'x' AS drop", "3 AS key", "4 AS drop_id", "5 AS salt", "6 AS batch")
    assert {"h", "drop", "n_lines", "n_dropped"} <= set(dedup_lines(df).columns)
    assert dedup_lines(df).count() == len(awkward())
