"""JSON Schema documents read into schema trees. Keywords that the trees can't express are refused, not ignored."""

from __future__ import annotations

import json
from copy import deepcopy
from typing import Any

from schemaloom.functions import membership
from schemaloom.model import INTERSECT, Node, find, merge

REFUSED = ("if", "then", "else", "unevaluatedProperties", "unevaluatedItems", "dependencies", "dependentSchemas", "contains")
#: Keywords that tell the type of a schema without one.
TELLING = {
    "array": {"items", "prefixItems", "additionalItems", "minItems", "maxItems", "uniqueItems"},
    "number": {"multipleOf", "minimum", "exclusiveMinimum", "maximum", "exclusiveMaximum"},
    "object": {"properties", "patternProperties", "required", "dependentRequired", "additionalProperties", "minProperties", "maxProperties", "propertyNames"},
    "string": {"pattern", "format", "minLength", "maxLength", "contentEncoding"},
}
KINDS = ("null", "boolean", "integer", "number", "string", "array", "object")


class Unsupported(ValueError):
    """A keyword or value that schema trees can't express."""


def loads(text: str) -> Node:
    return load(json.loads(text))


def load(doc: Any) -> Node:
    if doc is True or doc == {}:
        return Node("any")
    if doc is False or doc == {"not": {}}:
        return Node("zero")
    if not isinstance(doc, dict):
        raise Unsupported(f"not a schema: {doc!r}")
    for k in (*REFUSED, "not"):
        if k in doc:
            raise Unsupported(k)
    out = _load(doc)
    definitions = {**doc.get("definitions", {}), **doc.get("$defs", {})}
    if definitions:
        out = deepcopy(out)
        out.definitions = {k: load(v) for k, v in definitions.items()}
    return out


def detect(doc: dict) -> list[str]:
    """Every type whose keywords a schema without a type has; those with fewer of them first."""
    scores = {k: len(words & doc.keys()) for k, words in TELLING.items()}
    return sorted((k for k in scores if scores[k]), key=lambda k: scores[k])


def _load(doc: dict) -> Node:
    if "$ref" in doc:
        return Node("reference", target=doc["$ref"] or "#")
    if "const" in doc or "enum" in doc:
        values = doc["enum"] if "enum" in doc else [doc["const"]]
        if all(isinstance(v, bool) for v in values) and len(set(values)) == 1:
            return Node("boolean", {"constant": values[0]})
        return Node("enum", {"enum": {v if not isinstance(v, (list, dict)) else repr(v) for v in values}})
    products = [k for k in ("allOf", "oneOf", "anyOf") if k in doc]
    kinds = doc.get("type", detect(doc))
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    for k in kinds:
        if k not in KINDS:
            raise Unsupported(f"type {k}")
    parts = [_typed(k, doc) for k in kinds]
    base = None if not parts else parts[0] if len(parts) == 1 else Node("product", parts=parts, counts=[1] * len(parts), how="anyOf")
    for k in products:
        inner = [load(x) for x in doc[k]]
        own = inner[0] if len(inner) == 1 else Node("product", parts=inner, counts=[1] * len(inner), how=k)
        if base is None:
            base = own
        elif len(inner) == 1:
            base = merge(base, own, INTERSECT, "Always")
        else:
            base = Node("product", parts=[base, own], counts=[1, 1], how="allOf")
    return base or Node("any")


def _typed(kind: str, doc: dict) -> Node:
    f: dict[str, Any] = {}
    if kind in ("integer", "number"):
        for name, exclusive in (("minimum", "exclusiveMinimum"), ("maximum", "exclusiveMaximum")):
            bounds = [(doc[k], k == exclusive) for k in (name, exclusive) if k in doc]
            if bounds:
                f[name] = (max if name == "minimum" else min)(bounds, key=lambda b: b[0])
        if "multipleOf" in doc:
            f["multiple"] = doc["multipleOf"]
        if "examples" in doc:
            f["examples"] = set(doc["examples"])
    elif kind == "string":
        for name, word in (("min_length", "minLength"), ("max_length", "maxLength"), ("regex", "pattern")):
            if word in doc:
                f[name] = doc[word]
        if "format" in doc:
            f["formats"] = {doc["format"]: 10}
        if "examples" in doc:
            f["examples"] = set(doc["examples"])
    elif kind == "array":
        return _array(doc)
    elif kind == "object":
        more = doc.get("additionalProperties", True)
        if not isinstance(more, bool) and more != {}:
            raise Unsupported("additionalProperties")
        f["additional"] = bool(more) if isinstance(more, bool) else True
        if "required" in doc:
            f["required"] = set(doc["required"])
        if "dependentRequired" in doc:
            f["dependencies"] = {k: set(v) for k, v in doc["dependentRequired"].items()}
        return Node("object", f, {k: load(v) for k, v in doc.get("properties", {}).items()}, {k: load(v) for k, v in doc.get("patternProperties", {}).items()})
    if kind in ("integer", "number", "string") and "bloomFilter" in doc:
        try:
            f["bloom"] = membership.from_text(doc["bloomFilter"])
        except (ValueError, TypeError) as e:
            raise Unsupported("bloomFilter") from e
    return Node(kind, f)


def _array(doc: dict) -> Node:
    f: dict[str, Any] = {}
    for name, word in (("min_items", "minItems"), ("max_items", "maxItems")):
        if word in doc:
            f[name] = doc[word]
    if doc.get("uniqueItems"):
        f["unique"] = True
    items, prefix = doc.get("items", {}), doc.get("prefixItems")
    if isinstance(items, list):
        if "prefixItems" in doc:
            raise Unsupported("items with prefixItems")
        prefix, items = items, doc.get("additionalItems", False)
    if prefix is not None:
        if items not in (False, {}, True):
            raise Unsupported("items with prefixItems")
        return Node("array", f, tuple=[load(x) for x in prefix])
    return Node("array", f, items=load(items))


def resolve_references(root: Node) -> dict[str, Node | None]:
    """Each reference of a schema with what it leads to (through other references, cycles ending in None)."""
    from schemaloom.model import resolve, walk

    targets = {n.target for _, n in walk(root) if n.kind == "reference"}
    return {t: resolve(root, t) for t in sorted(targets)}


def exists(root: Node, pointer: str) -> bool:
    return find(root, pointer) is not None
