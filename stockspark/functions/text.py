"""Text expressions: barcode tails, truncation, currency, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockspark.schema import BARCODE_TAIL_LEN

ELLIPSIS = "…"


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def barcode_tail(c: Column, n: int = BARCODE_TAIL_LEN, prefer_digits: bool = False) -> Column:
    """Last ``n`` characters; with ``prefer_digits`` the last ``n`` digits when
    the value holds any digit. Null gives ''."""
    s = F.trim(_s(c))
    tail = F.right(s, F.lit(n))
    if not prefer_digits:
        return tail
    digits = F.regexp_replace(s, r"\D+", "")
    return F.when(F.length(digits) > 0, F.right(digits, F.lit(n))).otherwise(tail)


def ellipses(c: Column, n: int) -> Column:
    """ASCII form: keep ``n`` chars, else ``n-3`` chars and '...' (cut if n < 4)."""
    s = _s(c)
    if n < 4:
        return F.substring(s, 1, n)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 3), F.lit("...")))


def truncate_text(c: Column, max_len: int) -> Column:
    """Canonical form: keep ``max_len`` chars, else ``max_len-1`` and an ellipsis."""
    s = _s(c)
    return F.when(F.length(s) <= max_len, s).otherwise(
        F.concat(F.substring(s, 1, max(0, max_len - 1)), F.lit(ELLIPSIS)))


def truncate_plain(c: Column, n: int) -> Column:
    """Audit form: keep ``n`` chars and append an ellipsis when cut."""
    s = _s(c)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n), F.lit(ELLIPSIS)))


def format_currency(c: Column) -> Column:
    """'$1,234.56'; null, NaN and infinities give ''."""
    v = c.cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(finite, F.concat(F.lit("$"), F.format_number(v, 2))).otherwise(F.lit(""))


def item_label(brand: Column, product: Column, room: Column, qty: Column, barcode: Column) -> Column:
    """Search-list label: ``brand | product | room | Qty:n | …last6``."""
    return F.concat(_s(brand), F.lit(" | "), _s(product), F.lit(" | "), _s(room),
                    F.lit(" | Qty:"), _s(qty), F.lit(" | " + ELLIPSIS),
                    F.right(_s(barcode), F.lit(6)))


def search_haystack(*cols: Column, sep: str = " ") -> Column:
    """Lower-cased concatenation the token search runs over."""
    return F.lower(F.concat_ws(sep, *[_s(c) for c in cols]))


def all_tokens(haystack: Column, query: str) -> Column:
    """Every whitespace token of ``query`` (lower-cased) occurs in ``haystack``."""
    tokens = (query or "").strip().lower().split()
    cond = F.lit(True)
    for t in tokens:
        cond = cond & haystack.contains(F.lit(t))
    return cond
