"""Whole-number helpers of schema expansion: steps to the next round bound, and divisors."""

from __future__ import annotations

import math
from collections.abc import Callable

from schemaloom.params import MAX_EXPAND_ROUNDS


def _wider(n: int) -> int:
    """The next bound above n that a person would choose."""
    if n < 0:
        return 0
    if n < 10:
        return n + 1
    power = 1 << n.bit_length()
    two = power - 1 if power - 1 > n else power
    unit = 10 ** (len(str(n)) - 2)
    ten = (n // unit + 1) * unit
    return min(two, ten)


def _narrower(n: int) -> int:
    if n < 0:
        return 0
    if n < 10:
        return n - 1
    two = n - 1 if n & (n - 1) == 0 else 1 << (n.bit_length() - 1)
    unit = 10 ** (len(str(n)) - 2)
    ten = n - unit if n % unit == 0 else n - n % unit
    return max(two, ten)


def _search(current: int | None, limit: int | None, exclusive: bool, step: Callable[[int], int], covers: Callable[[int, int, bool], bool], within: Callable[[int, int], bool], force: bool) -> tuple[int | None, bool]:
    if current is None or (limit is None and not force):
        return None, False
    for _ in range(MAX_EXPAND_ROUNDS):
        if current >= 0 and not force and covers(current, limit, exclusive):
            return current, exclusive
        if current >= 0 and exclusive and (force or within(current, limit)):
            exclusive = False
        else:
            current = step(current)
    return None, False


def widen(current: int | None, limit: int | None, exclusive: bool = False, force: bool = False) -> tuple[int | None, bool]:
    """A maximum that covers limit, by at most ten steps; none if that doesn't do (or always, if forced)."""
    return _search(current, limit, exclusive, _wider, lambda c, x, e: c > x if e else c >= x, lambda c, x: c < x, force)


def contract(current: int | None, limit: int | None, exclusive: bool = False, force: bool = False) -> tuple[int | None, bool]:
    """A minimum that covers limit, by at most ten steps."""
    return _search(current, limit, exclusive, _narrower, lambda c, x, e: c < x if e else c <= x, lambda c, x: c < x, force)


def factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return [*out, n] if n > 1 or not out else out


def lcm(a: int, b: int) -> int:
    return abs(a * b) // math.gcd(a, b) if a and b else 0
