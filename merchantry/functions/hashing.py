"""Portable hash draws.

Random streams (Mersenne, NumPy) are not portable across engines or partitions, so
every draw in this library is a pure function of a key: the same key gives the same
value on any executor, in any partition order, and in the SQL twins.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchantry.functions.text import bound

TWO_52 = float(2 ** 52)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hkey(*parts) -> Column:
    """Key built from parts separated by ':' (strings are literals, Columns columns)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *cols)


def hash52(key: Column) -> Column:
    """52-bit non-negative integer taken from the first 13 hex digits of md5(key)."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")


def uniform(key: Column) -> Column:
    """Uniform draw in [0, 1) from a key (exact double, identical in every engine)."""
    return hash52(key) / F.lit(TWO_52)


def pick(key: Column, n) -> Column:
    """Integer in [0, n) from a key: exact integer modulo, no float rounding."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.pmod(hash52(key), n.cast("bigint"))


def int_between(key: Column, lo: int, hi: int) -> Column:
    """Integer in [lo, hi] inclusive."""
    return F.lit(lo) + pick(key, hi - lo + 1)


def sha1_mod(key, m: int = 1000) -> Column:
    """int(sha1(key), 16) % m, folded over five 32-bit chunks so it stays in 64 bits."""
    def folded(h: Column) -> Column:
        r = F.lit(0).cast("bigint")
        for i in range(5):
            chunk = F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")
            r = F.pmod(r * F.lit(4294967296) + chunk, F.lit(m))
        return r
    return bound(F.sha1(_col(key)), folded)


def in_eval(key, frac: float) -> Column:
    """Stable hash assignment of a key to the held-out side."""
    return sha1_mod(key, 1000) < F.lit(frac * 1000)
