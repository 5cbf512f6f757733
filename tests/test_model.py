import json
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from schemaloom import model as m
from schemaloom.functions.numbers import contract, factors, widen
from schemaloom.functions.text import format_name
from schemaloom.operators import passes
from schemaloom.params import Params
from schemaloom.sources.schema_import import Unsupported, detect, load
from schemaloom.sources.sinks import value_csv
from schemaloom.streaming import state

values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False, width=32) | st.text(max_size=8),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4),
    max_leaves=12,
)


def schema_of(vs):
    return reduce(m.merge, map(m.of_value, vs), m.ZERO)


@settings(max_examples=150, deadline=None)
@given(st.lists(values, min_size=1, max_size=5))
def test_values_fit_their_schema_and_schemas_cover_themselves(vs):
    s = schema_of(vs)
    for v in vs:
        assert m.worst(m.anomalies(s, v)) <= m.LEVELS["info"]
    assert m.covers(s, s)


@settings(max_examples=100, deadline=None)
@given(values, values)
def test_a_union_covers_both(a, b):
    x, y = m.of_value(a), m.of_value(b)
    whole = m.merge(x, y)
    assert m.covers(whole, x) and m.covers(whole, y)
    assert m.covers(x, y) == (not list(m.gaps(x, y)))


@settings(max_examples=100, deadline=None)
@given(values, values)
def test_expansion_covers(a, b):
    x, y = m.of_value(a), m.of_value(b)
    assert m.covers(m.expand(x, y), y)


def test_decimal_divisors_are_exact():
    assert m.decimal_gcd(8000000491520.0, "8E-16") == m.Decimal("8E-16")
    assert m.decimal_gcd("0.3", "0.45") == m.Decimal("0.15") and m.decimal_lcm("0.3", "0.45") == m.Decimal("0.9")
    assert m.divides("1e-300", 1e300) and not m.divides(0, 1) and not m.divides("0.2", "0.3")
    whole = m.of_value([1, 0.99, 8000000491520.0])
    assert m.covers(m.expand(m.of_value([]), whole), whole)


def test_bound_steps():
    assert widen(101, 117) == (120, False) and widen(123, 124) == (127, False) and widen(-123, 124) == (None, False)
    assert widen(1196296863810379800, 1196296863810379801) == (1200000000000000000, False)
    assert contract(117, 101) == (100, False) and contract(130, 129) == (128, False) and contract(14, 28) == (14, False)
    assert widen(5, None, force=True) == (None, False) and factors(84) == [2, 2, 3, 7]


@pytest.mark.parametrize(
    ("text", "name"),
    [("2020-02-30", "none"), ("2020-02-28", "date"), ("2020-02-28T10:11:12Z", "date-time"), ("10:11:12+01:00", "time"), ("https://a.example/x", "uri"), ("123e4567-e89b-12d3-a456-426614174000", "uuid"), ("a.b@example.org", "email"), ("10.0.0.1", "ipv4"), ("fe80::1", "ipv6"), ("word", "none")],
)
def test_formats(text, name):
    assert format_name(text) == name


@pytest.mark.parametrize(("text", "name"), [("10.1234/abc", "doi"), ("geo:1.5,2", "geo-uri"), ("849VCWC8+R9", "plus-code"), ("9780306406157", "isbn"), ("1-56619-909-3", "isbn"), ("ISBN-13: 978-0-306-40615-7", "isbn"), ("1000", "none"), ("12345", "none"), ("1991ASSL..171...89H", "bibcode")])
def test_extended_formats(text, name):
    assert format_name(text, True) == name


def test_import_refuses_and_reads():
    for bad in ({"if": {}}, {"type": "array", "contains": {}}, {"type": "object", "dependentSchemas": {}}, {"type": "object", "additionalProperties": {"type": "null"}}, {"type": "date"}):
        with pytest.raises(Unsupported):
            load(bad)
    assert load(True).kind == "any" and load(False).kind == "zero" and detect({"minItems": 1}) == ["array"] and detect({"minLength": 1, "minimum": 2, "maximum": 3}) == ["string", "number"]
    n = load({"type": ["integer", "null"]})
    assert n.kind == "product" and not m.anomalies(n, 3) and not m.anomalies(n, None) and m.anomalies(n, "x")
    assert [bool(m.anomalies(load({"oneOf": [{"type": "integer"}, {"type": "integer", "minimum": 5}]}), v)) for v in (1, 9)] == [False, True]
    tree = load({"$ref": "#/$defs/t", "$defs": {"t": {"type": "object", "properties": {"next": {"$ref": "#/$defs/t"}}, "additionalProperties": False}}})
    assert not m.anomalies(tree, {"next": {"next": {}}}) and m.anomalies(tree, {"next": {"x": 1}})


def test_intersections():
    a, b = load({"type": "integer", "minimum": 1, "maximum": 9, "multipleOf": 2}), load({"type": "integer", "minimum": 3, "maximum": 12, "multipleOf": 3})
    x = m.merge(a, b, m.INTERSECT)
    assert (x.facts["minimum"], x.facts["maximum"], x.facts["multiple"]) == ((3, False), (9, False), 6)
    assert m.merge(m.ANY, a, m.INTERSECT) is a and m.merge(m.ZERO, a) is a and m.merge(m.ANY, a).kind == "any" and m.merge(a, m.of_value("x"), m.INTERSECT).kind == "zero"


def test_relations_split_objects():
    a, b = m.of_value({"a": 1}), m.of_value({"b": 1})
    assert m.merge(a, b).kind == "object"
    assert m.merge(a, b, relation="Label").kind == "product" and m.merge(a, b, relation="IntersectingLabel").kind == "product"
    assert m.merge(a, m.of_value({"a": "x"}), relation="TypeMatch").kind == "product"


def test_passes():
    maps = schema_of([{f"k{i}": i} for i in range(11)])
    assert passes.dynamic_objects(maps).kind == "dynamic"
    apart = schema_of([{"foo": 1, "bar": 2}, {"baz": 1, "quux": 2}])
    split = passes.disjoint_objects(apart, {"$": [{"bar", "foo"}, {"baz", "quux"}]})
    assert split.kind == "product" and [sorted(p.keys) for p in split.parts] == [["bar", "foo"], ["baz", "quux"]]
    shared = passes.shared_definitions(m.of_value({"foo": {"bar": 1, "baz": 2}, "quux": {"bar": 3, "baz": 4}}))
    assert list(shared.definitions) == ["defn0"] and shared.keys["foo"].target == "#/$defs/defn0"
    assert not m.anomalies(shared, {"foo": {"bar": 1, "baz": 2}, "quux": {"bar": 3, "baz": 4}})
    few = passes.enums(schema_of([{"x": v} for v in ["a", "b"] * 20]))
    assert few.keys["x"].kind == "enum" and few.keys["x"].facts["enum"] == {"a", "b"}
    with pytest.raises(ValueError):
        passes.apply(maps, Params().named("Min"), dynamic_=True)
    dates = passes.reset_format_lengths(schema_of([f"2020-01-{i:02}" for i in range(1, 13)]))
    assert "min_length" not in dates.facts


def test_places_and_writing():
    n = m.of_value({"a": [{"b~": 1}], "c/d": "x"})
    assert m.find(n, "/a/0/b~0").kind == "integer" and m.find_inexact(n, "/a/b~0").kind == "integer" and m.find(n, "/c~1d").kind == "string" and m.find(n, "/z") is None
    assert m.replace_at(n, "/c~1d", m.of_value(1)).keys["c/d"].kind == "integer"
    assert {p for p, _ in m.walk(n)} == {"$", "$.a", "$.a[0]", "$.a[0].b~", "$.c/d"}
    assert set(m.only_facts(n, {"required"}).keys["c/d"].facts) == set() and set(m.only_keys(n, {"a"}).keys) == {"a"}
    doc = m.document(schema_of([{"a": 3}, {"a": 5, "b": [1]}]))
    assert doc["required"] == ["a"] and doc["properties"]["a"]["minimum"] == 3 and doc["properties"]["b"]["prefixItems"][0]["type"] == "integer"
    json.dumps(doc)
    assert value_csv(schema_of([{"a": 2, "b": "x"}, {"a": 1}])) == "$.a,$.b\n1,x\n2,\n"
    assert m.entropy(schema_of([{"a": 1, "b": 2}, {"a": 1}])) == 2


def test_products_meet_products():
    one, any_, all_ = ({how: [{"type": "integer"}, {"type": "string"}]} for how in ("oneOf", "anyOf", "allOf"))
    both = {"allOf": [{"type": "integer", "minimum": 3}, {"type": "integer", "maximum": 8}]}
    assert [x.kind for x in m.merge(load(one), load(one), m.INTERSECT).parts] == ["integer", "string"]
    n = m.merge(load({"anyOf": [{"type": "integer", "maximum": 3}, {"type": "integer", "minimum": 8}]}), load({"type": "integer", "minimum": 2}), m.INTERSECT)
    assert [bool(m.anomalies(n, v)) for v in (1, 2, 5, 9)] == [True, False, True, False]
    narrow = m.merge(load(both), load({"type": "integer", "multipleOf": 2}), m.INTERSECT)
    assert narrow.how == "allOf" and [bool(m.anomalies(narrow, v)) for v in (2, 4, 9)] == [True, False, True]
    for a, b in ((both, {"oneOf": [{"type": "string"}, {"type": "null"}]}), ({"anyOf": [{"type": "string"}, {"type": "null"}]}, both)):
        n = m.merge(load(a), load(b))
        assert n.how != "allOf" and [bool(m.anomalies(n, v)) for v in (2, 4, "x", None)] == [True, False, False, False]
    assert m.merge(load(one), load(any_), m.INTERSECT).how == "allOf" and m.merge(load(one), load(any_)).how == "anyOf"
    assert len(m.merge(load(all_), load(both)).parts) == 4
    assert m.merge(load(one), m.of_value(True), m.INTERSECT).kind == "zero"


@given(st.lists(st.integers() | st.floats(allow_nan=False, allow_infinity=False), max_size=20), st.lists(st.text(), max_size=20))
def test_bloom_filters_miss_no_value_and_survive_writing(numbers, texts):
    for vs in (numbers, texts):
        n = schema_of(vs)
        for own in [n] if vs else []:
            read = load(m.write(own))
            assert read.facts["bloom"] == own.facts["bloom"] and not own.facts["bloom"] & ~m.merge(own, own).facts["bloom"]
            assert not [a for v in vs for a in m.anomalies(m.Node(own.kind, {"bloom": own.facts["bloom"]}), v)]
    seen = schema_of(range(50))
    assert sum("bloom" in a.message for v in range(1000, 2000) for a in m.anomalies(seen, v)) > 990
    with pytest.raises(Unsupported):
        load({"type": "string", "bloomFilter": "AAAA"})


def test_statistics_of_numbers_beyond_doubles():
    for vs in ([0, 1e300, -1e300], [0.0, 1e77], [10**400, 1], [1e-200, 3e-200]):
        json.dumps(m.write(schema_of(vs)), allow_nan=False)


def test_histograms_tell_of_extreme_values():
    own = m.write(schema_of([1, 2]))["histogram"]
    assert [n for _, n in own["bins"]] == [1, 1] and own["hasExtremeValues"] is False
    assert m.write(schema_of([1, 2**63]))["histogram"]["hasExtremeValues"] and not m.write(schema_of([-(2**63)]))["histogram"]["hasExtremeValues"]


def test_references_resets_and_state():
    n = m.of_value({"a": {"b": 1}, "c": ["x", 2.5]})
    edited = m.replace_with_reference(n, "/a/b", "#/$defs/t")
    assert m.write(edited.keys["a"].keys["b"]) == {"$ref": "#/$defs/t"} and n.keys["a"].keys["b"].kind == "integer"
    assert m.reset(n) == m.Node("object") and m.merge(m.reset(n.keys["c"].tuple[0]), m.of_value("y")).kind == "string"


@settings(max_examples=50, deadline=None)
@given(st.lists(values, min_size=1, max_size=4))
def test_state_keeps_every_fact(vs):
    n = schema_of(vs)
    assert state.from_text(state.to_text(n)) == n


@settings(max_examples=100, deadline=None)
@given(st.lists(values, min_size=1, max_size=5), st.lists(values, max_size=5))
def test_a_ready_tree_objects_to_the_same(known, others):
    s = schema_of(known)
    for v in known + others:
        assert m.anomalies(m.ready(s), v) == m.anomalies(s, v)


def test_a_ready_tree_asks_no_bins_for_a_value(monkeypatch):
    held = m.ready(schema_of([{"n": 1.01**k, "s": "x" * k} for k in range(200)]))
    monkeypatch.setattr(m, "edge", None)
    assert not m.anomalies(held, {"n": 1.01**3, "s": "xx"}) and m.anomalies(held, {"n": 100.0, "s": "xx"})
