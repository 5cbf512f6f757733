"""Schema trees as text and back, with every fact as it is, for state that outlives the driver."""

from __future__ import annotations

import json
from dataclasses import MISSING, fields
from decimal import Decimal

from schemaloom.model import Node


def _default(f):
    return f.default_factory() if f.default_factory is not MISSING else f.default


def _pack(x):
    if isinstance(x, Node):
        return {"node": {f.name: _pack(v) for f in fields(Node) if (v := getattr(x, f.name)) != _default(f)}}
    if isinstance(x, dict):
        return {"map": [[_pack(k), _pack(v)] for k, v in x.items()]}
    if isinstance(x, (set, frozenset)):
        return {"set": sorted((_pack(v) for v in x), key=json.dumps)}
    if isinstance(x, tuple):
        return {"tuple": [_pack(v) for v in x]}
    if isinstance(x, list):
        return [_pack(v) for v in x]
    return {"decimal": str(x)} if isinstance(x, Decimal) else x


def _unpack(x):
    if isinstance(x, list):
        return [_unpack(v) for v in x]
    if not isinstance(x, dict):
        return x
    ((what, inner),) = x.items()
    if what == "node":
        return Node(**{k: _unpack(v) for k, v in inner.items()})
    if what == "map":
        return {_unpack(k): _unpack(v) for k, v in inner}
    if what == "decimal":
        return Decimal(inner)
    return (set if what == "set" else tuple)(_unpack(v) for v in inner)


def to_text(n: Node) -> str:
    return json.dumps(_pack(n), ensure_ascii=True)


def from_text(text: str) -> Node:
    return _unpack(json.loads(text))
