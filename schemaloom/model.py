"""Schemas as small trees on the driver, and what can be done with them.

A node has a kind and facts. What a fact means when two schemas are united or intersected, when one schema covers another,
how it widens, what it objects to in a value and how it is written down stands in one row of FACTS; the operations below
walk the tree and look facts up there.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any, NamedTuple

from schemaloom.functions import membership
from schemaloom.functions.exprs import GAMMA
from schemaloom.functions.numbers import contract, factors, lcm, widen
from schemaloom.params import MAX_EXAMPLE_CHARS, MAX_EXPAND_ROUNDS, MIN_PATTERN_VALUES, Params

INFO, WARNING, FATAL = "info", "warning", "fatal"
LEVELS = {INFO: 1, WARNING: 2, FATAL: 3}
UNION, INTERSECT = "union", "intersect"


@dataclass
class Node:
    kind: str  #: any zero null boolean integer number string array object dynamic product enum reference
    facts: dict[str, Any] = field(default_factory=dict)
    keys: dict[str, Node] = field(default_factory=dict)  #: of an object
    patterns: dict[str, Node] = field(default_factory=dict)
    items: Node | None = None  #: of a list, or the values of a dynamic object
    tuple: list[Node] | None = None
    parts: list[Node] = field(default_factory=list)  #: of a product
    counts: list[int] = field(default_factory=list)
    how: str = "oneOf"
    target: str = ""  #: of a reference
    definitions: dict[str, Node] = field(default_factory=dict)

    def get(self, name: str, default=None):
        return self.facts.get(name, default)


ANY, ZERO = Node("any"), Node("zero")


# --- facts ---

Bound = tuple[Any, bool]  # value, exclusive


@dataclass(frozen=True)
class Fact:
    unite: Callable[[Any, Any], Any]
    intersect: Callable[[Any, Any], Any] | None = None  #: default: unite
    covers: Callable[[Any, Any], bool] | None = None  #: (own, other): does own accept all that other does? Default: informational
    widen: Callable[[Any, Any], Any] | None = None  #: (own, other or None): None drops the fact
    objects: Callable[[Any, Any], tuple[str, str] | None] | None = None  #: (own, value): message and level
    write: Callable[[Any], dict] = lambda v: {}
    absent: str = "weaker"  #: an absent fact accepts everything


def _lower(a: Bound, b: Bound) -> Bound:
    return min(a, b, key=lambda x: (x[0], x[1]))


def _stricter_low(a: Bound, b: Bound) -> Bound:
    return max(a, b, key=lambda x: (x[0], x[1]))


def _upper(a: Bound, b: Bound) -> Bound:
    return max(a, b, key=lambda x: (x[0], not x[1]))


def _stricter_high(a: Bound, b: Bound) -> Bound:
    return min(a, b, key=lambda x: (x[0], not x[1]))


def _low_covers(own: Bound, other: Bound | None) -> bool:
    return other is not None and (own[0] < other[0] or (own[0] == other[0] and (not own[1] or other[1])))


def _high_covers(own: Bound, other: Bound | None) -> bool:
    return other is not None and (own[0] > other[0] or (own[0] == other[0] and (not own[1] or other[1])))


def _widen_low(own: Bound, other: Bound | None) -> Bound | None:
    value, exclusive = contract(math.floor(own[0]), None if other is None else math.floor(other[0]), own[1], other is None)
    return None if value is None else (value, exclusive)


def _widen_high(own: Bound, other: Bound | None) -> Bound | None:
    value, exclusive = widen(math.ceil(own[0]), None if other is None else math.ceil(other[0]), own[1], other is None)
    return None if value is None else (value, exclusive)


def _write_bound(name: str, exclusive: str) -> Callable[[Bound], dict]:
    return lambda b: {exclusive if b[1] else name: b[0]}


def plain(v):
    """Decimals and sets as JSON has them."""
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() and abs(v) < 10**15 else float(v)
    return v


def _whole(a, b) -> tuple[int, int, int]:
    """|a| and |b| as whole numbers of a common power of ten, and its exponent; exact, whatever their sizes."""
    a, b = abs(Decimal(str(a))), abs(Decimal(str(b)))
    e = min(a.as_tuple().exponent, b.as_tuple().exponent)
    whole = lambda x: int("".join(map(str, x.as_tuple().digits))) * 10 ** (x.as_tuple().exponent - e)
    return whole(a), whole(b), e


def _decimal(n: int, e: int) -> Decimal:
    while n and n % 10 == 0:
        n, e = n // 10, e + 1
    return Decimal(f"{n}e{e}" if n else 0)


def divides(m, v) -> bool:
    a, b, _ = _whole(m, v)
    return a != 0 and b % a == 0


def _widen_multiple(own, other):
    if other is None:
        return None
    if isinstance(own, int) and isinstance(other, int):
        rest = factors(own)
        for _ in range(MAX_EXPAND_ROUNDS):
            if other % own == 0:
                return own
            own //= rest.pop(0) if rest else 1
        return own if other % own == 0 else None
    own = Decimal(str(own))
    for _ in range(MAX_EXPAND_ROUNDS):
        if divides(own, other):
            return own
        own /= 2
    return None


def shown(s: str) -> str:
    return s[:MAX_EXAMPLE_CHARS] + "…" if len(s) > MAX_EXAMPLE_CHARS else s


def _affix(a: dict, b: dict) -> dict:
    def common(x: str, y: str) -> str:
        n = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        return x[:n]

    return {"prefix": common(a["prefix"], b["prefix"]), "suffix": common(a["suffix"][::-1], b["suffix"][::-1])[::-1], "count": a["count"] + b["count"]}


def _affix_covers(own: dict, other: dict | None) -> bool:
    if own["count"] < MIN_PATTERN_VALUES:  # of few values nothing is claimed
        return True
    return other is not None and other["prefix"].startswith(own["prefix"]) and other["suffix"].endswith(own["suffix"])


def _affix_objects(own: dict, s: str) -> tuple[str, str] | None:
    if own["count"] < MIN_PATTERN_VALUES:
        return None
    level = WARNING if s.isdigit() else FATAL
    if not s.startswith(own["prefix"]):
        return f"value does not have the required prefix {own['prefix']}", level
    return (f"value does not have the required suffix {own['suffix']}", level) if not s.endswith(own["suffix"]) else None


def _affix_write(own: dict) -> dict:
    if own["count"] < MIN_PATTERN_VALUES or not (own["prefix"] or own["suffix"]):
        return {}
    escape = lambda s: re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)
    return {"pattern": (f"^{escape(own['prefix'])}" if own["prefix"] else "") + (".*" if own["prefix"] and own["suffix"] else "") + (f"{escape(own['suffix'])}$" if own["suffix"] else "")}


def _add(a: dict, b: dict) -> dict:
    return {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}


def _least(a: dict, b: dict) -> dict:
    return {k: min(a[k], b[k]) for k in a.keys() & b.keys()}


def top_format(counts: dict[str, int], threshold: float = 1.0) -> str | None:
    total = sum(counts.values())
    named = {k: c for k, c in counts.items() if k != "none"}
    name = max(named, key=lambda k: named[k]) if named else "none"
    return name if total >= 10 and name != "none" and counts[name] >= threshold * total else None


def moments(a: dict, b: dict) -> dict:
    """Union of statistics {n, mean, m2, m3, m4} (sums of powers of deviations)."""
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    n, d = a["n"] + b["n"], b["mean"] - a["mean"]
    p, q = a["n"], b["n"]
    d2 = d * d  # products become infinite where powers would raise
    return {
        "n": n, "mean": a["mean"] + d * q / n, "m2": a["m2"] + b["m2"] + d2 * p * q / n,
        "m3": a["m3"] + b["m3"] + d2 * d * p * q * (p - q) / n**2 + 3 * d * (p * b["m2"] - q * a["m2"]) / n,
        "m4": a["m4"] + b["m4"] + d2 * d2 * p * q * (p * p - p * q + q * q) / n**3 + 6 * d2 * (p * p * b["m2"] + q * q * a["m2"]) / n**2 + 4 * d * (p * b["m3"] - q * a["m3"]) / n,
    }


def _statistics(s: dict) -> dict:
    n, m2 = s["n"], s["m2"]
    out = {"total": n * s["mean"], "mean": s["mean"]}
    if n > 1:
        out |= {"variance": m2 / (n - 1), "stdev": math.sqrt(m2 / (n - 1))}
    if (cube := m2 * math.sqrt(m2)) > 0 and (square := m2 * m2) > 0:
        out |= {"skewness": math.sqrt(n) * s["m3"] / cube, "kurtosis": n * s["m4"] / square - 3}
    return {"statistics": {k: v for k, v in out.items() if math.isfinite(v)}}  # beyond doubles nothing is said


_TOP_BIN = math.floor(math.log(sys.float_info.max) / math.log(GAMMA)) - 1


def power(k: int) -> float:
    """Upper bound of a histogram's bin."""
    return GAMMA**k if k <= _TOP_BIN else math.inf


def edge(bins: dict[tuple[int, int | None], int], top: bool) -> float:
    """Outer bound of a histogram {(sign, bin): count}."""
    bounds = []
    for (sign, k) in bins:
        if sign == 0:
            bounds.append(0.0)
        else:
            low, high = power(k - 1), power(k)
            bounds.append((high if top else low) if sign > 0 else -(low if top else high))
    return max(bounds) if top else min(bounds)


class Bounds(NamedTuple):
    """All that a value is asked of a histogram."""

    low: float
    high: float


def bounds(bins: dict) -> Bounds:
    return Bounds(edge(bins, False) * (1 - 1e-9) - 1e-9, edge(bins, True) * (1 + 1e-9) + 1e-9) if bins else Bounds(-math.inf, math.inf)


def _histogram_objects(bins: dict | Bounds, v) -> tuple[str, str] | None:
    own = bins if isinstance(bins, Bounds) else bounds(bins)
    return None if own.low <= v <= own.high else (f"value {v} outside histogram bounds", INFO)


def _histogram_write(name: str) -> Callable[[dict], dict]:
    return lambda bins: {name: {"bins": sorted([0.0 if s == 0 else s * min(2 / (GAMMA + 1) * power(k), sys.float_info.max), n] for (s, k), n in bins.items()), "hasExtremeValues": False}}


def _dependencies_cover(own: dict, other: dict | None) -> bool:
    return all(own[k] <= (other or {}).get(k, set()) for k in own)


FACTS: dict[str, Fact] = {
    "minimum": Fact(_lower, _stricter_low, _low_covers, _widen_low, lambda b, v: (f"value {v} below minimum {b[0]}", WARNING) if v < b[0] or (b[1] and v == b[0]) else None, _write_bound("minimum", "exclusiveMinimum")),
    "maximum": Fact(_upper, _stricter_high, _high_covers, _widen_high, lambda b, v: (f"value {v} above maximum {b[0]}", WARNING) if v > b[0] or (b[1] and v == b[0]) else None, _write_bound("maximum", "exclusiveMaximum")),
    "multiple": Fact(
        lambda a, b: math.gcd(a, b) if isinstance(a, int) and isinstance(b, int) else decimal_gcd(a, b),
        lambda a, b: lcm(a, b) if isinstance(a, int) and isinstance(b, int) else decimal_lcm(a, b),
        lambda own, other: (isinstance(own, int) and own <= 1) or (other is not None and divides(own, other)), _widen_multiple, write=lambda m: {"multipleOf": plain(m)} if not isinstance(m, int) or m > 1 else {},
    ),
    "distinct": Fact(lambda a, b: a + b, write=lambda n: {"distinctValues": n}),
    "bloom": Fact(lambda a, b: a | b, objects=lambda own, v: (f"value {v} not found in bloom filter", INFO) if not membership.holds(own, v) else None, write=lambda own: {"bloomFilter": membership.to_text(own)}),
    "examples": Fact(lambda a, b: a | b, write=lambda xs: {"examples": sorted(map(plain, xs))} if xs else {}),
    "statistics": Fact(moments, write=_statistics),
    "histogram": Fact(_add, objects=_histogram_objects, write=_histogram_write("histogram")),
    "extreme": Fact(lambda a, b: a or b),  #: a histogram's: some whole number is beyond 64 bits
    "length_histogram": Fact(_add, objects=lambda own, v: _histogram_objects(own, len(v)), write=_histogram_write("lengthHistogram")),
    "min_length": Fact(min, max, lambda own, other: other is not None and own <= other, lambda a, b: contract(a, b, False, b is None)[0], lambda n, s: (f"value is shorter than minimum length {n}", WARNING) if len(s) < n else None, lambda n: {"minLength": n}),
    "max_length": Fact(max, min, lambda own, other: other is not None and own >= other, lambda a, b: widen(a, b, False, b is None)[0], lambda n, s: (f"value is longer than maximum length {n}", WARNING) if len(s) > n else None, lambda n: {"maxLength": n}),
    "formats": Fact(_add, _least, lambda own, other: top_format(own) is None or top_format(own) == top_format(other or {}), lambda a, b: a if b is not None and top_format(a) in (None, top_format(b)) else None, write=lambda c: {"format": f} if (f := top_format(c)) else {}),
    "affixes": Fact(_affix, lambda a, b: {"prefix": max(a["prefix"], b["prefix"], key=len), "suffix": max(a["suffix"], b["suffix"], key=len), "count": a["count"] + b["count"]}, _affix_covers, lambda a, b: _affix(a, b) if b else None, _affix_objects, _affix_write),
    "regex": Fact(lambda a, b: a if a == b else None, lambda a, b: a if a == b else f"(?=.*{a})(?=.*{b})", lambda own, other: own == other, lambda a, b: a if a == b else None, lambda p, s: ("value does not match the required pattern", FATAL) if not re.search(p, s.strip()) else None, lambda p: {"pattern": p}),
    "numeric": Fact(lambda a, b: a and b, None, lambda own, other: not own or bool(other), lambda a, b: a and bool(b), lambda own, s: ("value is not numeric", FATAL) if own and not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s) else None),
    "min_items": Fact(min, max, lambda own, other: other is not None and own <= other, lambda a, b: contract(a, b, False, b is None)[0], lambda n, a: (f"array smaller than minimum length {n}", WARNING) if len(a) < n else None, lambda n: {"minItems": n}),
    "max_items": Fact(max, min, lambda own, other: other is not None and own >= other, lambda a, b: widen(a, b, False, b is None)[0], lambda n, a: (f"array larger than maximum length {n}", WARNING) if len(a) > n else None, lambda n: {"maxItems": n}),
    "unique": Fact(lambda a, b: a and b, lambda a, b: a or b, lambda own, other: not own or bool(other), lambda a, b: a and bool(b), lambda own, a: ("array items are not unique", FATAL) if own and len({repr(x) for x in a}) < len(a) else None, lambda u: {"uniqueItems": True} if u else {}),
    "constant": Fact(lambda a, b: a if a == b else None, None, lambda own, other: own is None or own == other, lambda a, b: a if a == b else None, write=lambda c: {} if c is None else {"const": c}),
    "percent": Fact(lambda a, b: (a[0] + b[0], a[1] + b[1]), write=lambda p: {"pctTrue": p[0] / p[1]} if p[1] else {}),
    "required": Fact(lambda a, b: a & b, lambda a, b: a | b, lambda own, other: own <= (other or set()), lambda a, b: a & (b or set()), lambda own, o: (f"missing required field(s) {', '.join(sorted(own - o.keys()))}", FATAL) if own - o.keys() else None, lambda r: {"required": sorted(r)}),
    "dependencies": Fact(lambda a, b: {k: a[k] & b[k] for k in a.keys() & b.keys() if a[k] & b[k]}, lambda a, b: {k: a.get(k, set()) | b.get(k, set()) for k in {**a, **b}}, _dependencies_cover, lambda a, b: {k: a[k] & (b or {}).get(k, set()) for k in a if a[k] & (b or {}).get(k, set())}, lambda own, o: next(((f"dependency {d} of {k} not found", FATAL) for k in sorted(own.keys() & o.keys()) for d in sorted(own[k] - o.keys())), None), lambda d: {"dependentRequired": {k: sorted(v) for k, v in sorted(d.items())}} if d else {}),
    "additional": Fact(lambda a, b: a or b, lambda a, b: a and b, lambda own, other: own or not other, lambda a, b: a or bool(b), write=lambda a: {"additionalProperties": bool(a)}),
    "presence": Fact(_add, _least, write=lambda p: {}),
    "count": Fact(lambda a, b: a + b, min),
    "enum": Fact(lambda a, b: a | b, lambda a, b: a & b, lambda own, other: (other or set()) <= own, lambda a, b: a | (b or set()), lambda own, v: (f"enum value {v} not found", FATAL) if v not in own else None, lambda e: {"const": next(iter(e))} if len(e) == 1 else {"enum": sorted(e, key=lambda v: (str(type(v)), v is not None and v))}),
}


def decimal_gcd(a, b) -> Decimal:
    a, b, e = _whole(a, b)
    return _decimal(math.gcd(a, b), e)


def decimal_lcm(a, b) -> Decimal:
    a, b, e = _whole(a, b)
    return _decimal(math.lcm(a, b), e)


#: Facts of which a missing one means "anything": uniting with a schema that lacks it drops it.
LIMITS = frozenset("minimum maximum multiple min_length max_length affixes regex min_items max_items unique constant required numeric".split())


# --- merging ---


def _facts(a: Node, b: Node, how: str) -> dict[str, Any]:
    out = {}
    for k in {**a.facts, **b.facts}:
        rule = FACTS[k]
        if k in a.facts and k in b.facts:
            merge = rule.unite if how == UNION else rule.intersect or rule.unite
            value = merge(a.facts[k], b.facts[k])
            if value is not None:
                out[k] = value
        elif how == INTERSECT or k not in LIMITS:
            out[k] = a.facts.get(k, b.facts.get(k))
    return out


def as_number(n: Node) -> Node:
    """An integer schema as a number schema."""
    out = deepcopy(n)
    out.kind = "number"
    return out


def same_kind(a: Node, b: Node) -> bool:
    return a.kind == b.kind or {a.kind, b.kind} in ({"integer", "number"}, {"object", "dynamic"})


def fusable(a: Node, b: Node, relation: str) -> bool:
    """Whether two schemas may become one."""
    if not same_kind(a, b):
        return False
    if a.kind != "object" or b.kind != "object" or relation in ("Kind", "Always"):
        return True
    if relation == "Label":
        return a.keys.keys() == b.keys.keys()
    shared = a.keys.keys() & b.keys.keys()
    if relation == "IntersectingLabel":
        return bool(shared) or not (a.keys or b.keys)
    if relation == "TypeMatch":
        return all(same_kind(a.keys[k], b.keys[k]) for k in shared)
    return False


def merge(a: Node, b: Node, how: str = UNION, relation: str = "Kind") -> Node:
    definitions = {**b.definitions, **a.definitions}
    out = _merge(a, b, how, relation)
    if definitions and out is not a and out is not b:
        out.definitions = definitions
    return out


def _merge(a: Node, b: Node, how: str, relation: str) -> Node:
    for x, y in ((a, b), (b, a)):
        if x.kind == "any":
            return x if how == UNION else y
        if x.kind == "zero":
            return y if how == UNION else x
    if a.kind == "product" or b.kind == "product":
        return _merge_product(*((a, b) if a.kind == "product" else (b, a)), how, relation)
    if not fusable(a, b, relation):
        return Node("product", parts=[a, b], counts=[1, 1]) if how == UNION else Node("zero")
    if a.kind == "reference":
        return a if a.target == b.target else Node("product", parts=[a, b], counts=[1, 1])
    if a.kind != b.kind and "number" in (a.kind, b.kind):
        a, b = (as_number(x) if x.kind == "integer" else x for x in (a, b))
    if a.kind != b.kind:  # an object joins a dynamic one
        a, b = (dynamic(x, relation) if x.kind == "object" else x for x in (a, b))
    out = Node(a.kind, _facts(a, b, how))
    if a.kind == "object":
        shared = a.keys.keys() & b.keys.keys()
        names = {**a.keys, **b.keys} if how == UNION else shared
        out.keys = {k: merge(a.keys[k], b.keys[k], how, relation) if k in shared else a.keys.get(k) or b.keys[k] for k in names}
        both = a.patterns.keys() & b.patterns.keys()
        out.patterns = {k: merge(a.patterns[k], b.patterns[k], how, relation) if k in both else a.patterns.get(k) or b.patterns[k] for k in ({**a.patterns, **b.patterns} if how == UNION else both)}
    elif a.kind == "array":
        if a.tuple is not None and b.tuple is not None and len(a.tuple) == len(b.tuple):
            out.tuple = [merge(x, y, how, relation) for x, y in zip(a.tuple, b.tuple, strict=True)]
        else:
            out.items = merge(as_list(a, relation), as_list(b, relation), how, relation)
    elif a.kind == "dynamic":
        out.items = merge(a.items or ZERO, b.items or ZERO, how, relation)
    return out


def as_list(n: Node, relation: str = "Kind") -> Node:
    """What the items of an array have in common."""
    if n.tuple is None:
        return n.items or ZERO
    out: Node = ZERO
    for x in n.tuple:
        out = merge(out, x, UNION, relation)
    return out


def dynamic(n: Node, relation: str = "Kind") -> Node:
    values: Node = ZERO
    for x in [*n.keys.values(), *n.patterns.values()]:
        values = merge(values, x, UNION, relation)
    return Node("dynamic", items=values)


def _merge_product(p: Node, other: Node, how: str, relation: str) -> Node:
    if other.kind == "product":
        if p.how == "allOf" and other.how == "allOf":
            return Node("product", parts=[*p.parts, *other.parts], counts=[*p.counts, *other.counts], how="allOf")
        if how == INTERSECT and p.how != other.how:
            return Node("product", parts=[p, other], counts=[1, 1], how="allOf")
        if how == INTERSECT:  # a value that fits one of each
            return _alternatives([merge(x, y, how, relation) for x in p.parts for y in other.parts], p.how)
        if "allOf" in (p.how, other.how):  # conditions that hold together are one alternative
            whole, some = (p, other) if p.how == "allOf" else (other, p)
            return Node("product", dict(some.facts), parts=[*some.parts, whole], counts=[*(some.counts or [1] * len(some.parts)), 1], how=some.how)
        out = p
        for x in other.parts:
            out = _merge_product(out, x, how, relation) if out.kind == "product" else merge(out, x, how, relation)
        if out.kind == "product":
            out.how = "anyOf" if "anyOf" in (p.how, other.how) else out.how
        return out
    if how == INTERSECT:
        if p.how == "allOf":
            return Node("product", dict(p.facts), parts=[*p.parts, other], counts=[*(p.counts or [1] * len(p.parts)), 1], how="allOf")
        return _alternatives([merge(x, other, how, relation) for x in p.parts], p.how)
    counts = list(p.counts or [1] * len(p.parts))
    for k, x in enumerate(p.parts):
        if fusable(x, other, relation):
            parts = list(p.parts)
            parts[k] = merge(x, other, how, relation)
            counts[k] += 1
            return Node("product", dict(p.facts), parts=parts, counts=counts, how=p.how)
    return Node("product", dict(p.facts), parts=[*p.parts, other], counts=[*counts, 1], how=p.how)


def _alternatives(parts: list[Node], how: str) -> Node:
    """Those of the parts that allow anything."""
    parts = [x for x in parts if x.kind != "zero"]
    return Node("zero") if not parts else parts[0] if len(parts) == 1 else Node("product", parts=parts, counts=[1] * len(parts), how=how)


# --- values ---


def kind_of(v) -> str | None:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, (float, Decimal)):
        return "number" if math.isfinite(v) else None
    return {"str": "string", "list": "array", "dict": "object"}[type(v).__name__]


def of_value(v, params: Params = Params()) -> Node | None:
    """The schema of one value."""
    from schemaloom.functions.text import format_name

    kind = kind_of(v)
    if kind is None:
        return None
    has = lambda *names: any(params.has(kind, n) for n in names)
    f: dict[str, Any] = {}
    if kind in ("integer", "number"):
        if has("minimum"):
            f["minimum"] = (plain(v), False)
        if has("maximum"):
            f["maximum"] = (plain(v), False)
        if has("multiple") and (kind == "integer" or abs(v) >= 1e-10):
            f["multiple"] = abs(v) if kind == "integer" else abs(Decimal(str(v)))
        if has("statistics"):
            f["statistics"] = {"n": 1, "mean": membership.as_double(v), "m2": 0.0, "m3": 0.0, "m4": 0.0}
        if has("bloom"):
            f["bloom"] = membership.bits(v)
        if has("examples"):
            f["examples"] = {plain(v)}
        if has("histogram"):
            f["histogram"] = {(0, None) if v == 0 else ((1 if v > 0 else -1), math.ceil(math.log(abs(v)) / math.log(GAMMA))): 1}
            if kind == "integer" and not -(2**63) <= v < 2**63:
                f["extreme"] = True
    elif kind == "string":
        f |= {k: len(v) for k in ("min_length", "max_length") if has(k)}
        if has("bloom"):
            f["bloom"] = membership.bits(v)
        if has("examples"):
            f["examples"] = {shown(v)}
        if has("format"):
            f["formats"] = {format_name(v, params.extended_formats): 1}
        if has("pattern"):
            f["affixes"] = {"prefix": v, "suffix": v, "count": 1}
        if has("length_histogram"):
            f["length_histogram"] = {(0, None) if not v else (1, math.ceil(math.log(len(v)) / math.log(GAMMA))): 1}
        if params.numeric_strings:
            f["numeric"] = bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v))
    elif kind == "boolean":
        f = {"constant": v} if has("constant") else {}
        f |= {"percent": (int(v), 1)} if has("percent") else {}
    elif kind == "array":
        f |= {k: len(v) for k in ("min_items", "max_items") if has(k)}
        inner = [x for x in (of_value(i, params) for i in v) if x is not None]
        if has("unique"):
            kinds = {"number" if x.kind == "integer" else x.kind for x in inner}
            f["unique"] = (not v) or (kinds in ({"number"}, {"string"}) and len({repr(x) for x in v}) == len(v) <= params.max_examples)
        return Node("array", f, tuple=inner)
    elif kind == "object":
        keys = {k: x for k, x in ((k, of_value(i, params)) for k, i in v.items()) if x is not None}
        if has("required"):
            f["required"] = set(keys)
        if has("presence"):
            f |= {"presence": dict.fromkeys(keys, 1), "count": 1}
        if has("additional"):
            f["additional"] = params.additional_properties
        return Node("object", f, keys)
    return Node(kind, f)


# --- comparison ---


def gaps(own: Node, other: Node, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, fact) for every reason why own doesn't accept all that other accepts."""
    if own.kind == "any" or other.kind == "zero":
        return
    if other.kind == "product":
        for x in other.parts:
            if own.kind == "product" and any(not list(gaps(y, x, path)) for y in own.parts):
                continue
            yield from gaps(own, x, path)
        return
    if own.kind == "product":
        tried = [list(gaps(y, other, path)) for y in own.parts]
        if own.how == "allOf":
            for t in tried:
                yield from t
        elif all(tried):
            yield from min(tried, key=len) if any(same_kind(y, other) for y in own.parts) else [(path, "type")]
        return
    if own.kind == "enum" and other.kind != "enum" or own.kind == "reference" and (other.kind != "reference" or own.target != other.target):
        yield path, "type"
        return
    if own.kind != other.kind and not (own.kind == "number" and other.kind == "integer") and not (own.kind == "dynamic" and other.kind == "object"):
        yield path, "type"
        return
    for k, value in own.facts.items():
        rule = FACTS[k]
        if rule.covers and not rule.covers(value, other.facts.get(k)):
            yield path, k
    if own.kind == "object":
        closed = not own.get("additional", False)
        for k, x in other.keys.items():
            if k in own.keys:
                yield from gaps(own.keys[k], x, f"{path}.{k}")
            elif closed and not any(re.search(p, k) for p in own.patterns):
                yield f"{path}.{k}", "properties"
        for p, x in other.patterns.items():
            if p in own.patterns:
                yield from gaps(own.patterns[p], x, f"{path}.{p}")
            else:
                yield path, "patternProperties"
    elif own.kind == "dynamic":
        for k, x in other.keys.items():
            yield from gaps(own.items or ZERO, x, f"{path}.{k}")
        if other.kind == "dynamic":
            yield from gaps(own.items or ZERO, other.items or ZERO, f"{path}.*")
    elif own.kind == "array":
        if own.tuple is not None:
            if other.tuple is None or len(own.tuple) != len(other.tuple):
                yield path, "items"
            else:
                for k, (x, y) in enumerate(zip(own.tuple, other.tuple, strict=True)):
                    yield from gaps(x, y, f"{path}[{k}]")
        else:
            yield from gaps(own.items or ZERO, as_list(other), f"{path}[*]")


def covers(own: Node, other: Node) -> bool:
    return next(gaps(own, other), None) is None


# --- expansion ---


def expand(own: Node, other: Node | None, relation: str = "Kind") -> Node:
    """own, widened until it accepts what other accepts; without other, by what nobody objects to (bounds are dropped)."""
    if own.kind == "any" or (other and other.kind == "zero"):
        return own
    if own.kind == "zero" or (other and other.kind == "any"):
        return other or own
    if other and other.kind == "product":
        for x in other.parts:
            own = expand(own, x, relation)
        return own
    if own.kind == "product":
        out = deepcopy(own)
        if other is None:
            out.parts = [expand(x, None, relation) for x in own.parts]
            return out
        fit = [k for k, x in enumerate(own.parts) if fusable(x, other, relation)]
        if fit:
            best = min(fit, key=lambda k: len(list(gaps(own.parts[k], other))))
            out.parts[best] = expand(own.parts[best], other, relation)
            return out
        return merge(out, other, UNION, relation)
    if other and not same_kind(own, other):
        return Node("product", parts=[own, other], counts=[1, 1])
    if own.kind == "integer" and other and other.kind == "number":
        own = as_number(own)
    if own.kind == "object" and other and other.kind == "dynamic":
        own = dynamic(own, relation)
    out = deepcopy(own)
    for k, value in own.facts.items():
        rule = FACTS[k]
        theirs = other.facts.get(k) if other else None
        if rule.widen is None:
            if theirs is not None:
                out.facts[k] = rule.unite(value, theirs)
            continue
        if other is not None and rule.covers and rule.covers(value, theirs):
            continue
        wide = rule.widen(value, theirs)
        if wide is None:
            del out.facts[k]
        else:
            out.facts[k] = wide
    child = lambda x, y: expand(x, y, relation)
    if own.kind == "object":
        theirs = other.keys if other else {}
        out.keys = {k: child(x, theirs.get(k)) if k in theirs or other is None else x for k, x in own.keys.items()} | {k: x for k, x in theirs.items() if k not in own.keys}
    elif own.kind == "array":
        if other is None:
            out.items, out.tuple = own.items and child(own.items, None), own.tuple and [child(x, None) for x in own.tuple]
        elif own.tuple is not None and other.tuple is not None and len(own.tuple) == len(other.tuple):
            out.tuple = [child(x, y) for x, y in zip(own.tuple, other.tuple, strict=True)]
        else:
            out.tuple, out.items = None, child(as_list(own), as_list(other))
    elif own.kind == "dynamic":
        theirs = None if other is None else other.items if other.kind == "dynamic" else dynamic(other).items
        out.items = child(own.items or ZERO, theirs)
    return out


# --- validation of one value ---


@dataclass(frozen=True)
class Anomaly:
    path: str
    message: str
    level: str


READY: dict[str, Callable[[Any], Any]] = {"histogram": bounds, "length_histogram": bounds, "bloom": membership.to_bytes}


def ready(n: Node) -> Node:
    """The tree to hold many values against: what hangs on no value is worked out once. It objects to the same, in the same order."""

    def prepare(_: str, x: Node) -> Node:
        x.facts = {k: READY[k](v) if k in READY else v for k, v in x.facts.items()}
        return x

    return transform(n, prepare)


def anomalies(n: Node, v, path: str = "$", root: Node | None = None) -> list[Anomaly]:
    root = root or n
    kind = kind_of(v)
    if n.kind == "any":
        return []
    if n.kind == "zero":
        return [Anomaly(path, "no value is allowed", FATAL)]
    if n.kind == "reference":
        found = resolve(root, n.target)
        return anomalies(found, v, path, root) if found else [Anomaly(path, "unresolved reference", FATAL)]
    if n.kind == "product":
        return _product_anomalies(n, v, path, root)
    if n.kind == "enum":
        bad = FACTS["enum"].objects(n.facts["enum"], v if not isinstance(v, (list, dict)) else repr(v))
        return [Anomaly(path, *bad)] if bad else []
    wanted = "object" if n.kind == "dynamic" else n.kind
    if n.kind == "number" and kind == "integer":
        kind = "number"
    if n.kind == "integer" and kind == "number" and float(v).is_integer():
        kind = "integer"
    if kind != wanted:
        return [Anomaly(path, f"{v!r} has wrong type", INFO if n.kind == "null" else FATAL)]
    if isinstance(v, Decimal):
        v = float(v)  # bounds of numbers are doubles
    out = []
    for k, value in n.facts.items():
        if FACTS[k].objects and (bad := FACTS[k].objects(value, v)):
            out.append(Anomaly(path, *bad))
    if n.kind == "object":
        unknown = []
        for k, x in v.items():
            inner = [n.keys[k]] if k in n.keys else []
            inner += [y for p, y in n.patterns.items() if re.search(p, k)]
            if not inner and not n.get("additional", False):
                unknown.append(Anomaly(f"{path}.{k}", f"found unknown field {k}" if not n.patterns else f"field {k} matches no pattern", FATAL))
            for y in inner:
                out += anomalies(y, x, f"{path}.{k}", root)
        if unknown:
            out = [a for a in out if a.path == path] + unknown
    elif n.kind == "dynamic":
        for k, x in v.items():
            out += anomalies(n.items or ZERO, x, f"{path}.{k}", root)
    elif n.kind == "array":
        if n.tuple is not None:
            if len(n.tuple) != len(v):
                return [*out, Anomaly(path, "wrong length for tuple schema", FATAL)]
            for k, (x, y) in enumerate(zip(n.tuple, v, strict=True)):
                out += anomalies(x, y, f"{path}[{k}]", root)
        else:
            for k, y in enumerate(v):
                out += anomalies(n.items or ANY, y, f"{path}[{k}]", root)
    return out


def worst(found: list[Anomaly]) -> int:
    return max((LEVELS[a.level] for a in found), default=0)


def _product_anomalies(n: Node, v, path: str, root: Node) -> list[Anomaly]:
    tried = []
    for x in n.parts:
        t = anomalies(x, v, path, root)
        if x.kind == "null" and v is not None:
            t = [Anomaly(path, "value is not null", FATAL)]
        tried.append(t)
    good = [t for t in tried if worst(t) <= LEVELS[INFO]]
    if n.how == "allOf":
        return [] if len(good) == len(tried) else [a for t in tried for a in t]
    if n.how == "anyOf":
        return [] if good else min(tried, key=worst)
    if len(good) == 1:
        return good[0]
    if good:
        return [Anomaly(path, "multiple alternatives match", FATAL)]
    return min(tried, key=worst) if tried else []


# --- places ---


def escape(part: str) -> str:
    return part.replace("~", "~0").replace("/", "~1")


def pointer_parts(pointer: str) -> list[str]:
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer.lstrip("#").strip("/").split("/") if p]


def child(n: Node, part: str, exact: bool = True) -> Node | None:
    if part in ("$defs", "definitions"):
        return Node("definitions", keys=n.definitions)
    if n.kind in ("object", "definitions"):
        return n.keys.get(part)
    if n.kind == "dynamic":
        return n.items
    if n.kind == "array":
        if n.tuple is not None:
            return n.tuple[int(part)] if part.isdigit() and int(part) < len(n.tuple) else None
        return n.items if part == "*" or not exact else None
    if n.kind == "product":
        return n.parts[int(part)] if part.isdigit() and int(part) < len(n.parts) else None
    return None


def find(n: Node, pointer: str) -> Node | None:
    for part in pointer_parts(pointer):
        if n is None:
            return None
        n = child(n, part)
    return n


def find_inexact(n: Node, pointer: str) -> Node | None:
    """As find, but array places and product alternatives need not be named."""

    def look(n: Node, parts: list[str]) -> Node | None:
        if not parts:
            return n
        if n.kind == "product":
            return next((f for x in n.parts if (f := look(x, parts))), None)
        if n.kind == "array":
            inside = n.tuple if n.tuple is not None else [n.items or ZERO]
            rest = parts[1:] if parts[0] == "*" or parts[0].isdigit() else parts
            return next((f for x in inside if (f := look(x, rest))), None)
        x = child(n, parts[0])
        return look(x, parts[1:]) if x else None

    return look(n, pointer_parts(pointer))


def replace_at(n: Node, pointer: str, new: Node) -> Node:
    out = deepcopy(n)
    parts = pointer_parts(pointer)
    if not parts:
        return deepcopy(new)
    at = out
    for p in parts[:-1]:
        at = child(at, p)
        if at is None:
            return out
    last = parts[-1]
    if at.kind in ("object", "definitions"):
        at.keys[last] = deepcopy(new)
    elif at.kind == "dynamic" or (at.kind == "array" and at.tuple is None):
        at.items = deepcopy(new)
    elif at.kind == "array":
        at.tuple[int(last)] = deepcopy(new)
    elif at.kind == "product":
        at.parts[int(last)] = deepcopy(new)
    return out


def replace_with_reference(n: Node, pointer: str, target: str) -> Node:
    return replace_at(n, pointer, Node("reference", target=target))


def reset(n: Node) -> Node:
    """A schema of the same kind that has seen no value."""
    return Node(n.kind, how=n.how, target=n.target)


def resolve(root: Node, target: str) -> Node | None:
    seen = set()
    while True:
        if target in seen:
            return None
        seen.add(target)
        found = find(root, target)
        if found is None or found.kind != "reference":
            return found
        target = found.target


def walk(n: Node, path: str = "$", follow: bool = False, root: Node | None = None, seen: frozenset[str] = frozenset()) -> Iterator[tuple[str, Node]]:
    """Every node with its path: .key, [*], [i], .* and, for alternatives, [i]."""
    root = root or n
    if n.kind == "reference" and follow and n.target not in seen:
        found = resolve(root, n.target)
        if found:
            yield from walk(found, path, follow, root, seen | {n.target})
            return
    yield path, n
    for k, x in n.keys.items():
        yield from walk(x, f"{path}.{k}", follow, root, seen)
    for k, x in n.patterns.items():
        yield from walk(x, f"{path}.{k}", follow, root, seen)
    for k, x in enumerate(n.tuple or n.parts):
        yield from walk(x, f"{path}[{k}]", follow, root, seen)
    if n.items is not None:
        yield from walk(n.items, f"{path}.*" if n.kind == "dynamic" else f"{path}[*]", follow, root, seen)
    for k, x in n.definitions.items():
        yield from walk(x, f"{path}.$defs.{k}", follow, root, seen)


def transform(n: Node, change: Callable[[str, Node], Node], path: str = "$") -> Node:
    """The tree with change applied to every node, children first."""
    out = deepcopy(n)
    out.keys = {k: transform(x, change, f"{path}.{k}") for k, x in n.keys.items()}
    out.patterns = {k: transform(x, change, f"{path}.{k}") for k, x in n.patterns.items()}
    out.definitions = {k: transform(x, change, f"{path}.$defs.{k}") for k, x in n.definitions.items()}
    out.tuple = None if n.tuple is None else [transform(x, change, f"{path}[{k}]") for k, x in enumerate(n.tuple)]
    out.parts = [transform(x, change, f"{path}[{k}]") for k, x in enumerate(n.parts)]
    out.items = n.items and transform(n.items, change, f"{path}.*" if n.kind == "dynamic" else f"{path}[*]")
    return change(path, out)


def only_facts(n: Node, names: set[str]) -> Node:
    """The schema with some facts only."""

    def cut(_: str, x: Node) -> Node:
        x.facts = {k: v for k, v in x.facts.items() if k in names or k == "enum"}
        return x

    return transform(n, cut)


def only_keys(n: Node, keys: set[str]) -> Node:
    """An object schema restricted to some keys."""
    out = deepcopy(n)
    out.keys = {k: x for k, x in n.keys.items() if k in keys}
    if "required" in out.facts:
        out.facts["required"] = out.facts["required"] & keys
    if "presence" in out.facts:
        out.facts["presence"] = {k: c for k, c in out.facts["presence"].items() if k in keys}
    if "dependencies" in out.facts:
        out.facts["dependencies"] = {k: v & keys for k, v in out.facts["dependencies"].items() if k in keys and v & keys}
    return out


def entropy(n: Node) -> int | None:
    """How many choices of type the schema leaves; None if they aren't limited."""
    if n.kind == "any" or n.kind == "dynamic":
        return None
    if n.kind == "object":
        if n.get("additional", False) or n.patterns:
            return None
        total, required = 1, n.get("required", set())
        for k, x in n.keys.items():
            e = entropy(x)
            if e is None:
                return None
            total *= e + (k not in required)
        return total
    if n.kind == "array":
        if n.tuple is not None:
            inner = [entropy(x) for x in n.tuple]
            return None if None in inner else sum(inner)
        e = entropy(n.items or ZERO)
        return None if e is None or "max_items" not in n.facts else e * (n.facts["max_items"] - n.get("min_items", 0) + 1)
    if n.kind == "product":
        inner = [entropy(x) for x in n.parts]
        return None if None in inner else sum(inner)
    return 1


# --- writing ---

SCHEMA_URI = "https://json-schema.org/draft/2020-12/schema"


def write(n: Node) -> dict | bool:
    if n.kind == "any":
        return True
    if n.kind == "zero":
        return False
    if n.kind == "reference":
        return {"$ref": n.target}
    out: dict[str, Any] = {}
    if n.kind == "product":
        out[n.how] = [write(x) for x in n.parts]
        if n.how == "oneOf" and n.counts and len(n.counts) == len(n.parts):
            out["oneOfCounts"] = n.counts
    elif n.kind == "enum":
        out |= FACTS["enum"].write(n.facts["enum"])
    else:
        kind = "number" if n.kind == "string" and n.get("numeric") else "object" if n.kind == "dynamic" else n.kind
        constant = n.get("constant")
        if n.kind == "boolean" and constant is not None:
            out["const"] = constant
        else:
            out["type"] = kind
            for k, value in n.facts.items():
                if k != "numeric":
                    out |= FACTS[k].write(value)
            if n.get("extreme") and "histogram" in out:
                out["histogram"]["hasExtremeValues"] = True
        if n.kind == "object":
            out["properties"] = {k: write(x) for k, x in sorted(n.keys.items())}
            if n.patterns:
                out["patternProperties"] = {k: write(x) for k, x in n.patterns.items()}
            if n.get("count"):
                out["fieldPresence"] = {k: c / n.facts["count"] for k, c in sorted(n.get("presence", {}).items())}
        elif n.kind == "dynamic":
            out["additionalProperties"] = write(n.items or ZERO)
        elif n.kind == "array":
            if n.tuple:
                out |= {"prefixItems": [write(x) for x in n.tuple], "items": False}
            elif n.tuple is not None:
                out["items"] = []
            else:
                out["items"] = write(n.items or ANY)
    if n.definitions:
        out["$defs"] = {k: write(x) for k, x in n.definitions.items()}
    return out


def document(n: Node, description: str = "JSON Schema discovered by schemaloom") -> dict:
    body = write(n)
    return {"$schema": SCHEMA_URI, "description": description, **(body if isinstance(body, dict) else {} if body else {"not": {}})}
