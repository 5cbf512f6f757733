"""What a discovery run may be told, and the constants of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values of the data model.
MAX_EXPAND_ROUNDS = 10
MIN_FORMAT_VALUES = 10
MIN_PATTERN_VALUES = 10
MAX_DEPENDENCY_KEYS = 50
MAX_EXAMPLE_CHARS = 100
ENUM_RATIO = 10
MAX_ENUM_VALUES = 50
HISTOGRAM_ERROR = 0.01
KEY_LENGTH_PENALTY = 10
CLUSTER_DISTANCE = 0.1

NUMERIC = frozenset("minimum maximum distinct bloom statistics examples multiple histogram".split())
STRINGS = frozenset("min_length max_length distinct bloom examples format pattern length_histogram".split())
ARRAYS = frozenset("items min_items max_items unique length_histogram".split())
OBJECTS = frozenset("additional properties presence required dependencies".split())
BOOLEANS = frozenset("constant percent".split())

PROPERTY_SETS: dict[str, dict[str, frozenset[str]]] = {
    "All": {"array": ARRAYS, "boolean": BOOLEANS, "integer": NUMERIC, "number": NUMERIC, "object": OBJECTS, "string": STRINGS},
    "Simple": {
        "array": ARRAYS - {"length_histogram"},
        "boolean": frozenset(["constant"]),
        "integer": frozenset("minimum maximum multiple examples".split()),
        "number": frozenset("minimum maximum multiple examples".split()),
        "object": OBJECTS - {"presence"},
        "string": frozenset("min_length max_length format pattern examples".split()),
    },
    "Min": {"array": frozenset(["items"]), "boolean": frozenset(["constant"]), "integer": frozenset(), "number": frozenset(), "object": frozenset(["additional", "properties"]), "string": frozenset()},
}


@dataclass(frozen=True)
class Params:
    properties: dict[str, frozenset[str]] = field(default_factory=lambda: PROPERTY_SETS["All"])
    relation: str = "Kind"  #: when objects at one place are one schema: Kind, Label, IntersectingLabel, TypeMatch
    additional_properties: bool = False
    extended_formats: bool = False
    format_threshold: float = 1.0
    max_examples: int = 100
    numeric_strings: bool = False
    reset_format_length: bool = False
    max_depth: int = 64
    max_tuple: int = 256  #: arrays of one length above this are lists
    max_paths: int = 20_000  #: paths of a level, beyond which its widest objects become maps (path.*)
    max_keys: int = 1_000  #: keys of an object's path that stay keys then
    cache: bool = True  #: keep levels of nodes between passes (memory, then local disk); else they are shredded again
    seed: int = 42

    def named(self, name: str) -> Params:
        return replace(self, properties=PROPERTY_SETS[name])

    def only(self, *names: str) -> Params:
        return replace(self, properties={k: v & set(names) for k, v in self.properties.items()})

    def without(self, *names: str) -> Params:
        return replace(self, properties={k: v - set(names) for k, v in self.properties.items()})

    def has(self, kind: str, name: str) -> bool:
        return name in self.properties.get(kind, ())
