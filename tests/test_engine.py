import io
import json
import os
from functools import reduce

import pytest

from schemaloom import cli, model
from schemaloom.catalog import nodes_of
from schemaloom.model import of_value
from schemaloom.operators import monoids as M
from schemaloom.operators import relations
from schemaloom.operators import tables as X
from schemaloom.operators.split import split_discover
from schemaloom.operators.validate import find_anomalies
from schemaloom.params import Params
from schemaloom.plans.discover import discover, discover_schema
from schemaloom.plans.shred import shred, shred_strict
from schemaloom.sources.documents import bad_documents, from_strings, from_values, read_ndjson
from schemaloom.sources.schema_import import load
from schemaloom.streaming.discover import StreamingSchema, key_counts

DOCS = [
    {"a": 1, "b": [1, 2], "c": {"d": "x", "e": None}, "f": True, "g.h": 2.5, "u": 3},
    {"a": 2, "b": [3, 4], "c": {"d": "y"}, "f": False, "u": "s", "l": [[1, 2], [3, 4]]},
    {"a": 5, "b": [1, 1], "l": [[5, 6]], "u": 1.0},
]


@pytest.fixture(scope="module")
def nodes(spark):
    s = shred(from_values(spark, DOCS))
    return M.lift(s.nodes, s.lifted()).cache()


def test_paths_types_and_tuples(spark):
    s = shred(from_values(spark, DOCS))
    assert s.tuples == {"$.b", "$.l[*]"} and s.lifted() == ["$.u"]
    assert {r.path for r in s.nodes.where("depth = 3").collect()} == {"$.l[*][0]", "$.l[*][1]"}
    assert shred(from_values(spark, [])).nodes.count() == 0


def test_bad_lines_are_dropped_and_counted(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    docs = read_ndjson(spark, str(tmp_path / "x.json"))
    assert bad_documents(docs).first().unparsable == 1
    assert shred(docs).kinds[("$.a", "integer")][0] == 2
    strict = shred_strict(from_strings(spark, ['{"a": 1, "a": 123456789012345678901234567890123456789012}', "null", "NaN", "{"])).collect()
    assert {(r.doc_id, r.path, r.text) for r in strict if r.path == "$.a"} == {(0, "$.a", "123456789012345678901234567890123456789012")}


def test_discovery_agrees_with_folding_values(spark):
    found, folded = discover_schema(from_values(spark, DOCS)), reduce(model.merge, map(of_value, DOCS))
    assert model.covers(folded, found)
    assert set(found.keys) == set(folded.keys) and found.facts["required"] == folded.facts["required"]
    for v in DOCS:
        assert model.worst(model.anomalies(found, v)) == 0
    assert find_anomalies(from_values(spark, DOCS), found).count() == 0
    assert {r.level for r in find_anomalies(from_values(spark, [{"a": "x"}]), found).collect()} == {"fatal"}


def test_property_sets_limit_facts(spark):
    n = discover_schema(from_values(spark, DOCS), Params().named("Min"))
    assert n.keys["a"].facts == {} and "required" not in n.facts
    assert set(discover_schema(from_values(spark, DOCS), Params().only("minimum")).keys["a"].facts) == {"minimum"}


def test_too_many_keys_become_a_map(spark):
    docs = from_values(spark, [{"id": i, "by": {f"k{i}_{j}": {"n": j} for j in range(5)}} for i in range(20)])
    n = discover_schema(docs, Params(max_paths=30, max_keys=10, cache=False).named("Simple"))
    assert n.keys["by"].kind == "dynamic" and n.keys["by"].items.keys["n"].facts["maximum"] == (4, False) and set(n.keys) == {"id", "by"}


def test_objects_and_dependencies(spark):
    n = shred(from_values(spark, [{"foo": 1, "bar": 2}, {"baz": 3}, {"foo": 4}])).nodes
    assert {(r.key, r.needs) for r in M.dependencies(n).collect()} == {("bar", "foo")}
    groups = relations.disjoint_key_sets(n)
    assert groups["$"] == [{"bar", "foo"}, {"baz"}]
    wide = shred(from_values(spark, [{f"k{i}": 1 for i in range(51)}])).nodes
    assert M.key_pairs(wide).count() == 0


def test_numbers(spark):
    n = shred(from_values(spark, [{"i": 12, "x": 3.14, "z": 0.0}, {"i": 18, "x": 4.28, "z": 1.0}, {"i": 30, "x": 7.42, "z": 2.0}])).nodes
    assert {(r.path, float(r.multiple)) for r in M.multiples(n).collect()} == {("$.i", 6.0), ("$.x", 0.02)}
    f = {r.path: r for r in M.number_facts(n).collect()}
    assert f["$.i"].mean == 20 and abs(f["$.i"].variance - 84) < 1e-9


def test_strings(spark):
    n = shred(from_values(spark, [{"s": f"pre{i:02}post", "d": f"2020-01-{i:02}", "n": f"{i}.5"} for i in range(10, 22)])).nodes
    assert {(r.path, r.prefix, r.suffix) for r in M.affixes(n).collect() if r.path == "$.s"} == {("$.s", "pre", "post")}
    assert {(r.path, r.format) for r in M.string_formats(n).collect()} == {("$.d", "date")}
    mostly = from_values(spark, [{"d": f"2020-01-{i:02}"} for i in range(10, 22)] + [{"d": "soon"}])
    for threshold, format_ in ((1.0, None), (0.9, "date")):
        assert model.document(discover_schema(mostly, Params(format_threshold=threshold).named("Simple")))["properties"]["d"].get("format") == format_
    assert {r.path: r.is_numeric for r in M.numeric_strings(n).collect()} == {"$.s": False, "$.d": False, "$.n": True}


def test_unique_arrays(nodes, spark):
    assert {r.path: r.is_unique for r in M.unique_arrays(nodes).collect()}["$.b"] is False
    n = shred(from_values(spark, [{"u": [1, 2], "m": [1, "1"], "e": []}])).nodes
    assert {r.path: r.is_unique for r in M.unique_arrays(n).collect()} == {"$.u": True, "$.m": False, "$.e": False}


def test_keys(spark):
    rows = [{"id": i, "name": f"n{i}", "v": i % 3} for i in range(20)]
    n = shred(from_values(spark, rows)).nodes
    assert [r.path for r in X.primary_keys(n).collect()] == ["$.id"]
    pairs = {(r.source, r.target) for r in X.foreign_keys(n).collect()}
    assert ("$.v", "$.id") in pairs and ("$.id", "$.v") not in pairs


@pytest.mark.parametrize(("relation", "groups"), [("Kind", 1), ("Label", 3), ("IntersectingLabel", 2), ("TypeMatch", 1)])
def test_relations(spark, relation, groups):
    n = shred(from_values(spark, [{"a": 1, "b": 2}, {"a": 1}, {"c": "x"}])).nodes
    assert relations.groups(n, relation).select("group").distinct().count() == groups
    assert discover(from_values(spark, [{"a": 1}, {"c": {"d": 1}}]), Params(relation=relation)).schema().kind in ("object", "product")


def test_split(spark):
    s = split_discover(from_values(spark, [{"a": i} for i in range(60)]), 0.5, Params().without("multiple"))
    assert model.covers(s.final, s.test) and not s.incompatible


def test_validate_nodes(spark):
    n = shred(from_values(spark, [{"a": 1, "s": "xx"}, {"a": 5, "s": "xxx"}, {"a": 9, "t": 1}])).nodes
    ids = [r.doc_id for r in n.where("path = '$.t'").collect()]
    found = {(r.path, r.message) for r in X.validate_nodes(n.where(n.doc_id.isin(ids)), n.where(~n.doc_id.isin(ids))).collect()}
    assert found == {("$.a", "above maximum"), ("$.t", "unknown field"), ("$.s", "missing required field")}
    assert X.verdicts(X.validate_nodes(n.where(n.doc_id.isin(ids)), n.where(~n.doc_id.isin(ids)))).first().level == "fatal"


def test_streaming_union(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"a": k, f"k{k}": "x"}) + "\n")
    running = StreamingSchema(Params().named("Simple"))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).selectExpr("xxhash64(value) AS doc_id", "value AS json")
    running.start(lines, str(tmp_path / "ck")).awaitTermination()
    assert running.schema.keys["a"].facts["maximum"] == (2, False) and set(running.schema.keys) == {"a", "k0", "k1", "k2"} and running.schema.facts["required"] == {"a"}


def test_streaming_goes_on_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).selectExpr("xxhash64(value) AS doc_id", "value AS json")
    for part in (["a", "b", "c"], ["d", "e"], []):
        for k in part:
            (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"x": ord(k), k: 1.5}) + "\n")
        running = StreamingSchema()  # as a new driver would
        running.start(lines(), str(tmp_path / "ck")).awaitTermination()
    assert set(running.schema.keys) == {"x", *"abcde"} and running.schema.facts["count"] == 5 and running.schema.facts["required"] == {"x"}
    assert running.schema.keys["x"].facts["minimum"] == (97, False) and running.schema.keys["x"].facts["statistics"]["n"] == 5
    before = running.schema
    running.update(spark.createDataFrame([(1, "{}")], "doc_id long, json string"), running.last)  # a batch run again
    assert running.schema is before


def test_windowed_counts_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, (t, keys) in enumerate([("2024-01-01 00:01:00", "ab"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 05:00:00", "b"), ("2024-01-01 05:01:00", "b"), ("2024-01-01 00:03:00", "a"), ("2024-01-02 00:00:00", "c")]):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"ts": t, "json": json.dumps(dict.fromkeys(keys, 1))}))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k,) * 2)
    docs = spark.readStream.schema("ts timestamp, json string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = key_counts(docs, "ts", "10 minutes", "1 hour")
    out.writeStream.format("memory").queryName("windowed_counts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    found = {(str(r.start), r.key, r.documents) for r in spark.table("windowed_counts").collect()}
    assert found == {("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:00:00", "b", 1), ("2024-01-01 05:00:00", "b", 2)}  # a watermark counts from the batch after next; the last window is still open


def test_discovered_filters_equal_folded_ones(spark):
    docs = [{"i": k, "s": f"é{k}", "x": k / 7, "u": 2**70 + k if k % 2 else -0.0} for k in range(30)]
    found, folded = discover_schema(from_values(spark, docs)), reduce(model.merge, map(of_value, docs))
    for k in "isxu":
        assert found.keys[k].facts["bloom"] == folded.keys[k].facts["bloom"]
    assert discover_schema(from_values(spark, [{"u": 2**70}])).keys["u"].facts["extreme"] and "extreme" not in found.keys["i"].facts


def test_serving_protocol():
    lines = [{"cmd": "start", "version": 1}, {"cmd": "dialect"}, {"cmd": "run", "seq": 1, "case": {"schema": {"type": "integer"}, "tests": [{"instance": 1}, {"instance": "x"}]}}, {"cmd": "run", "seq": 2, "case": {"schema": {"if": {}}, "tests": []}}, {"cmd": "stop"}]
    out = io.StringIO()
    cli.serve(io.StringIO("\n".join(map(json.dumps, lines))), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert replies[2]["results"] == [{"valid": True}, {"valid": False}] and replies[3]["skipped"]


def test_command_line(spark, tmp_path):
    (tmp_path / "in.json").write_text("\n".join(json.dumps(d) for d in DOCS))
    assert cli.main([str(tmp_path / "in.json"), "--prop", "Simple", "--write-output", str(tmp_path / "s.json"), "--write-values", str(tmp_path / "v.csv")]) == 0
    doc = json.loads((tmp_path / "s.json").read_text())
    assert load({k: v for k, v in doc.items() if k in ("type", "required")}).kind == "object" and (tmp_path / "v.csv").read_text().startswith("$.a,")


def test_deep_documents_are_refused_not_cut(spark):
    docs = from_strings(spark, ["[" * 9 + "1" + "]" * 9])
    assert shred(docs).nodes.where("type = 'integer'").count() == 1
    with pytest.raises(ValueError, match="max_depth"):
        shred(docs, Params(max_depth=4))


def test_disjoint_pass_of_the_command_line_accepts_its_documents(spark, tmp_path):
    lines = ['{"a": 1, "b": 2}', '{"a": 1}', '{"b": 2}'] * 5 + ['{"c": 1}'] * 3
    path = tmp_path / "docs.ndjson"
    path.write_text("\n".join(lines))
    assert cli.main([str(path), "--detect-disjoint", "--write-output", str(tmp_path / "schema.json"), "--compact"]) == 0
    schema = load(json.loads((tmp_path / "schema.json").read_text()))
    assert all(not list(model.anomalies(schema, json.loads(x))) for x in lines)
    assert list(model.anomalies(schema, {"a": 1, "c": 1}))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_queries_keep_no_levels_that_nobody_can_release(spark):
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert nodes_of(from_values(spark, DOCS)).where("type = 'object'").count() == 5
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_no_level_below_the_asked_depth(spark):
    docs = from_values(spark, DOCS)
    whole, top = shred(docs), shred(docs, depth=1)
    assert len(top.levels) == 2 and sorted(r.path for r in top.nodes.collect()) == sorted(r.path for r in whole.nodes.where("depth <= 1").collect())


def test_shredding_counts_the_bounds_of_arrays(spark, nodes):
    assert sorted(M.bounds_of_kinds(spark, shred(from_values(spark, DOCS)).kinds).collect()) == sorted(M.array_bounds(nodes).collect())


def test_items_stay_in_the_row_of_their_array(spark):
    docs = [{"m": [1, "1"], "t": [1, 1.0], "o": [{"a": 1}, {"a": 2}], "n": [1, None], "b": [True, False], "big": [2**70, 2**70 + 1], "x": [1e300, 2e300], "l": ["a" * 101 + "b", "a" * 101 + "c"], "d": [[1], [2]], "s": ["1", "2"], "i": [1, 2.5]}]
    unique = M.unique_arrays(shred(from_values(spark, docs)).nodes)
    assert {r.path for r in unique.collect() if r.is_unique} == {"$.big", "$.x", "$.s", "$.i"} and "Join" not in plan_of(unique)


def test_parsing_is_written_once_in_a_level(spark):
    """Filters on a value's type or size would repeat the parser, once for each mention."""
    docs = from_values(spark, DOCS)
    assert plan_of(shred(docs, Params(cache=False), depth=0).nodes.where("type = 'object' AND n > 0")).lower().count("parsejson") <= 1


def test_validation_joins_only_tables_of_schema_size(spark):
    n = nodes_of(from_values(spark, [{"a": 1, "b": 2, "c": 3}, {"a": 1, "c": 3}, {"c": 4}, {"a": 1}]))
    ids = [r.doc_id for r in n.where("path = '$' AND array_contains(keys, 'c') = false").collect()]
    found = X.validate_nodes(n.where(n.doc_id.isin(ids)), n.where(~n.doc_id.isin(ids)))
    assert {(r.path, r.message) for r in found.collect()} == {("$.c", "missing required field")}
    needs = X.validate_nodes(shred(from_values(spark, [{"b": 2, "c": 3}])).nodes, n)
    assert ("$.a", "unmet dependency", "fatal") in {(r.path, r.message, r.level) for r in needs.collect()}
    assert plan_of(found).count("node_id") == 0  # no value is joined to its object
