"""Bloom filters of the values at a path: bits are set in Spark, and asked for in Python by the same hash.

Strings are hashed by their UTF-8 bytes, numbers of any type as doubles, so that integers and other numbers agree. A filter
has a fixed size, which bounds what a path can send to the driver; the more distinct values, the less it excludes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS, HASHES = 1 << 13, 7
_LOW = 0xFFFFFFFF


def places_of(value: Column) -> Column:
    """The bits that stand for a string or double, as an array."""
    h = F.xxhash64(value)
    low, high = h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    return F.array(*(((low + high * k) % BITS).cast("int") for k in range(HASHES)))


def as_double(v) -> float:
    try:
        return float(v)
    except OverflowError:
        return float("inf") if v > 0 else float("-inf")


def places(v) -> Iterator[int]:
    """The bits that stand for a string or number."""
    if isinstance(v, str):
        data = v.encode("utf-8", "replace")
    else:
        data = struct.pack("<d", as_double(v) + 0.0)
    h = xxhash.xxh64_intdigest(data, 42)
    low, high = h & _LOW, h >> 32 | 1
    return ((low + high * k) % BITS for k in range(HASHES))


def bits(v) -> int:
    """The bits that stand for a string or number, as a whole number."""
    out = 0
    for p in places(v):
        out |= 1 << p
    return out


def to_bytes(own: int) -> bytes:
    return own.to_bytes(BITS // 8, "little")


def holds(own: int | bytes, v) -> bool:
    """Whether the filter knows v; bytes are asked bit by bit, which is faster than whole numbers of this size."""
    return all(own[p >> 3] >> (p & 7) & 1 for p in places(v)) if isinstance(own, bytes) else not bits(v) & ~own


def of_words(words) -> int:
    """The filter of (place, 64 bits) rows."""
    return sum((w & (1 << 64) - 1) << 64 * k for k, w in words)


def to_text(own: int) -> str:
    return base64.b64encode(to_bytes(own)).decode()


def from_text(text: str) -> int:
    """ValueError if it isn't a filter of this kind."""
    data = base64.b64decode(text, validate=True)
    if len(data) != BITS // 8:
        raise ValueError("a Bloom filter of another size")
    return int.from_bytes(data, "little")
