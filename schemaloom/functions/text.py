"""The format patterns of functions.exprs for one string, on the driver or in a Python worker."""

from __future__ import annotations

import re
from datetime import date
from functools import lru_cache

from schemaloom.functions.exprs import formats


@lru_cache(maxsize=2)
def _compiled(extended: bool):
    return [(name, re.compile(p[:-1] + r"\Z" if p.endswith("$") else p)) for name, p in formats(extended)]


def format_name(s: str, extended: bool = False) -> str:
    t = s.strip(" ")
    for name, pattern in _compiled(extended):
        if pattern.search(t):
            if name in ("date", "date-time"):
                try:
                    date.fromisoformat(t[:10])
                except ValueError:
                    continue
            return name
    return "none"
