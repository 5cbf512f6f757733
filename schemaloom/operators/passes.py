"""Post-passes over schema trees, in the order dynamic, disjoint, definitions, enums, lengths of formats; and allOf merging."""

from __future__ import annotations

import math
from copy import deepcopy

from schemaloom.model import INTERSECT, Node, dynamic, merge, only_keys, top_format, transform, walk
from schemaloom.operators.relations import connected
from schemaloom.params import CLUSTER_DISTANCE, ENUM_RATIO, MAX_ENUM_VALUES, Params


def dynamic_objects(n: Node, least_entropy: float = 1.0) -> Node:
    """Objects whose values are of one kind and whose keys come and go become maps."""

    def change(_: str, x: Node) -> Node:
        total = x.get("count")
        if x.kind != "object" or not x.keys or not total or len({y.kind for y in x.keys.values()}) != 1:
            return x
        shares = [c / total for c in x.get("presence", {}).values() if c]
        return dynamic(x) if -sum(p * math.log(p) for p in shares) > least_entropy else x

    return transform(n, change)


def disjoint_objects(n: Node, groups_of: dict[str, list[set[str]]]) -> Node:
    """Objects whose keys fall into groups that never meet become alternatives; groups_of is relations.disjoint_key_sets."""

    def change(path: str, x: Node) -> Node:
        if x.kind != "object" or len(x.keys) < 2:
            return x
        groups = groups_of.get(path, ())
        if len(groups) < 2:
            return x
        return Node("product", parts=[only_keys(x, g) for g in groups], counts=[1] * len(groups))

    return transform(n, change)


def presence_vector(n: Node) -> dict[str, float]:
    total = n.get("count") or 1
    return {k: c / total for k, c in n.get("presence", {}).items()}


def similarity(a: dict[str, float], b: dict[str, float]) -> float:
    """Fuzzy Jaccard: shares of keys in common."""
    keys = a.keys() | b.keys()
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / top if top else 0.0


def _pointer(path: str) -> str:
    return path.replace("[", ".").replace("]", "").removeprefix("$").replace(".", "/")


def shared_definitions(n: Node, distance: float = CLUSTER_DISTANCE) -> Node:
    """Objects of like keys become one definition that their places refer to; deepest places first."""
    objects = [(p, x) for p, x in walk(n) if x.kind == "object" and p != "$" and x.keys and "$defs" not in p]
    vectors = [presence_vector(x) or dict.fromkeys(x.keys, 1.0) for _, x in objects]
    near = [frozenset([str(i), str(j)]) for i in range(len(objects)) for j in range(i) if 1 - similarity(vectors[i], vectors[j]) <= distance]
    out, number = deepcopy(n), 0
    clusters = sorted((sorted(map(int, g)) for g in connected(near)), key=lambda g: -max(len(objects[k][0]) for k in g))
    definitions: dict[str, Node] = {}
    targets: dict[str, str] = {}
    for g in clusters:
        names = {objects[k][0].replace("[*]", "").split(".")[-1].split("[")[0] for k in g}
        name = names.pop() if len(names) == 1 else ""
        if not name or name in definitions:
            name, number = f"defn{number}", number + 1
        whole = objects[g[0]][1]
        for k in g[1:]:
            whole = merge(whole, objects[k][1])
        definitions[name] = whole
        targets |= {objects[k][0]: name for k in g}

    def change(path: str, x: Node) -> Node:
        return Node("reference", target=f"#/$defs/{targets[path]}") if path in targets else x

    out = transform(out, change)
    out.definitions = {**n.definitions, **definitions}
    return out


def enums(n: Node, other: Node | None = None) -> Node:
    """Few and often repeated values become an enumeration; a boolean always alike, a constant.

    The distinct values are the schema's examples, which are all of them where there are fewer than 50. With another
    schema (of a split), its examples must lie within ours.
    """
    theirs = dict(walk(other)) if other else {}

    def change(path: str, x: Node) -> Node:
        own = x.get("examples")
        total = x.get("total_values") or (x.get("statistics") or {}).get("n") or sum((x.get("formats") or {}).values())
        if x.kind in ("integer", "number", "string") and own and total > ENUM_RATIO * len(own) and len(own) < MAX_ENUM_VALUES:
            if other is None or (path in theirs and theirs[path].get("examples", set()) <= own):
                return Node("enum", {"enum": set(own)})
        if x.kind == "boolean" and x.get("constant") is not None and x.get("percent", (0, 0))[1] < 10:
            x.facts["constant"] = None
        return x

    return transform(n, change)


def merge_all_of(n: Node) -> Node:
    def change(_: str, x: Node) -> Node:
        if x.kind != "product" or x.how != "allOf":
            return x
        out = x.parts[0]
        for y in x.parts[1:]:
            out = merge(out, y, INTERSECT, "Always")
        return out

    return transform(n, change)


def reset_format_lengths(n: Node) -> Node:
    def change(_: str, x: Node) -> Node:
        if x.kind == "string" and top_format(x.get("formats", {})):
            x.facts.pop("min_length", None)
            x.facts.pop("max_length", None)
        return x

    return transform(n, change)


def apply(n: Node, params: Params, *, dynamic_: bool = False, disjoint: bool = False, definitions: bool = False, enum: bool = False, other: Node | None = None, key_groups: dict[str, list[set[str]]] | None = None) -> Node:
    if (dynamic_ or disjoint or definitions) and not params.has("object", "presence"):
        raise ValueError("these passes need the property set All")
    if disjoint and key_groups is None:
        raise ValueError("which keys meet isn't part of a schema: give the groups of relations.disjoint_key_sets")
    for wanted, step in ((dynamic_, dynamic_objects), (disjoint, lambda x: disjoint_objects(x, key_groups)), (definitions, shared_definitions), (enum, lambda x: enums(x, other)), (params.reset_format_length, reset_format_lengths)):
        n = step(n) if wanted else n
    return n
