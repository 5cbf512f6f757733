"""Spark expressions that the discovery operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom.params import HISTOGRAM_ERROR, MAX_EXAMPLE_CHARS

GAMMA = (1 + HISTOGRAM_ERROR) / (1 - HISTOGRAM_ERROR)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
#: Formats in order of precedence; each is a pattern, found anywhere unless it is anchored. Published
#: patterns are spelled as published: doi in the Citation File Format's schema, isbn in the Regular Expressions Cookbook.
EXTENDED_FORMATS = (
    ("geo-uri", r"(?i)^geo:(-?\d+(\.\d+)?),(-?\d+(\.\d+)?)(,(-?\d+(\.\d+)?))?(;(.*))?$"),
    ("doi", r"10\.\d{4,9}(\.\d+)?/[A-Za-z0-9-\._;\(\)\[\]\\:/]+"),
    ("bibcode", r"\d{4}[A-Za-z\.&]{5}[\w\.]{4}[AELPQ-Z\.][\d\.]{4}[A-Z]"),
    ("isbn", r"^(?:ISBN(?:-1[03])?:? )?(?=[0-9X]{10}$|(?=(?:[0-9]+[- ]){3})[- 0-9X]{13}$|97[89][0-9]{10}$|(?=(?:[0-9]+[- ]){4})[- 0-9]{17}$)(?:97[89][- ]?)?[0-9]{1,5}[- ]?[0-9]+[- ]?[0-9]+[- ]?[0-9X]$"),
    ("plus-code", r"^(?:[23456789CFGHJMPQRVWX]{8}\+(?:[23456789CFGHJMPQRVWX]{2,7})?|[23456789CFGHJMPQRVWX]{2,6}0{2,6}\+|[23456789CFGHJMPQRVWX]{4,6}\+[23456789CFGHJMPQRVWX]{2,3})$"),
)
_DATE = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,9})?)?(?:Z|[+-](?:0[0-9]|1[0-8]):[0-5][0-9])"
FORMATS = (
    ("date", f"^{_DATE}$"),
    ("date-time", f"^{_DATE}T{_TIME}$"),
    ("time", f"^{_TIME}$"),
    ("uuid", r"^[0-9a-fA-F]{1,8}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,12}$"),
    ("ipv4", rf"(?:{_OCTET}\.){{3}}{_OCTET}"),
    ("ipv6", r"^(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}|:(?::[0-9a-fA-F]{1,4}){1,7}|::)$"),
    ("email", r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"),
    ("uri", r"^[A-Za-z][A-Za-z0-9+.-]*:[^ <>\"{}|\\^`]+$"),
)
_DATED = ("date", "date-time")


def formats(extended: bool) -> tuple[tuple[str, str], ...]:
    return (EXTENDED_FORMATS if extended else ()) + FORMATS


def format_of(s: Column, extended: bool = False) -> Column:
    """The first format that s has, else "none". Dates must exist."""
    t, out = F.trim(s), None
    for name, pattern in formats(extended):
        test = t.rlike(pattern)
        if name in _DATED:
            test = test & F.try_to_timestamp(F.left(t, F.lit(10)), F.lit("yyyy-MM-dd")).isNotNull()
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("none")


def shown(s: Column) -> Column:
    """s as an example: at most 100 characters."""
    return F.when(F.length(s) > MAX_EXAMPLE_CHARS, F.concat(F.left(s, F.lit(MAX_EXAMPLE_CHARS)), F.lit("…"))).otherwise(s)


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of all strings between the least and the greatest: that of those two."""
    n = F.least(F.length(low), F.length(high))
    flags = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when((i <= n) & (F.substring(low, i, F.lit(1)) == F.substring(high, i, F.lit(1))), 1).otherwise(0))
    first = F.array_position(flags, 0)
    return F.when(low.isNull() | high.isNull(), None).otherwise(F.left(low, F.when(first == 0, n).otherwise((first - 1).cast("int"))))


def bin_of(v: Column) -> Column:
    """Number of the logarithmic bin of |v| (relative error 1 %); zero has none."""
    return F.when(v == 0, None).otherwise(F.ceil(F.log(F.abs(v)) / math.log(GAMMA)).cast("long"))


def bin_value(b: Column) -> Column:
    return 2 * F.pow(F.lit(GAMMA), b) / (GAMMA + 1)


def gcd_of(values: Column) -> Column:
    """Greatest common divisor of an array of whole numbers (0 is neutral), by Euclid's steps over it."""

    def step(acc: Column, x: Column) -> Column:
        # 90 divisions do for 64-bit numbers; the remainder 0 ends it early.
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(acc.alias("a"), x.alias("b")), lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), (p["a"] % p["b"]).alias("b"))))
        return pair["a"]

    return F.aggregate(values, F.lit(0).cast("long"), step)
