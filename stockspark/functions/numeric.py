"""Numeric expressions that must round like the desktop tool's Python code.

Python formats and rounds the exact binary value of a double, ties to even.
Spark's ``round`` / ``format_string`` round the shortest decimal text half
up, so ``9/4`` gives "2.3x" in Spark and "2.2x" in Python. For a ratio of two
integers the exact rational decides; only a true tie (10*r = q + 1/2) needs
the double: the error-free sum of 16*d + 4*d (TwoSum) tells whether the
double lies above or below the tie, without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _idiv(a: Column, b: Column) -> Column:
    """Floor division of non-negative longs (exact below 2**53)."""
    return ((a - a % b) / b).cast("long")


def ratio_tenths(num: Column, den: Column) -> Column:
    """round(num / den, 1) * 10 as Python rounds the double ``num / den``.

    ``num`` >= 0 and ``den`` > 0 are integers. Returns a long.
    """
    n = num.cast("long")
    m = den.cast("long")
    q = _idiv(n * 10, m)
    twice_rem = (n * 10 - q * m) * 2
    d = n.cast("double") / m.cast("double")
    a = d * 16.0
    b = d * 4.0
    s = a + b
    bb = s - a
    err = (a - (s - bb)) + (b - bb)
    above = (s - (q * 2 + 1).cast("double")) + err     # sign of 20 * fl(r) - (2q + 1)
    tie_up = F.when(above > 0, True).when(above < 0, False).otherwise(q % 2 == 1)
    return (F.when(twice_rem < m, q)
             .when(twice_rem > m, q + 1)
             .otherwise(F.when(tie_up, q + 1).otherwise(q)))


def ratio_text(num: Column, den: Column, suffix: str = "x") -> Column:
    """f"{num/den:.1f}{suffix}" with Python's rounding."""
    return tenths_text(ratio_tenths(num, den), suffix)


def tenths_text(t: Column, suffix: str = "x") -> Column:
    """A number of tenths as text with one decimal."""
    return F.concat(_idiv(t, F.lit(10)).cast("string"), F.lit("."),
                    (t % 10).cast("string"), F.lit(suffix))


_SPLITTER = 134217729.0  # 2**27 + 1 (Veltkamp split of a double)


def _split(a: Column):
    c = a * _SPLITTER
    hi = c - (c - a)
    return hi, a - hi


def py_round(x: Column, ndigits: int) -> Column:
    """Python's ``round(x, ndigits)`` for a double column, JVM-side.

    Python rounds the exact binary value of ``x`` half to even. The exact
    product ``x * 10**ndigits`` is ``p + err`` (Dekker's error-free product,
    no FMA needed); the fraction of ``p`` over its floor plus ``err`` decides
    the direction, and the result is the double nearest to ``q / 10**ndigits``
    as in Python. Valid for |x| * 10**ndigits < 2**52.
    """
    x = x.cast("double")
    s = float(10 ** ndigits)
    p = x * s
    xh, xl = _split(x)
    sh, sl = _split(F.lit(s))
    err = (((xh * sh - p) + xh * sl) + xl * sh) + xl * sl
    f = F.floor(p).cast("double")
    d = (p - f - 0.5) + err
    q = (F.when(d > 0, f + 1.0).when(d < 0, f)
          .otherwise(F.when(F.pmod(f, F.lit(2.0)) == 0, f).otherwise(f + 1.0)))
    return F.when(x.isNull() | F.isnan(x), x).otherwise(q / s)
