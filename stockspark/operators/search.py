"""Search (F8, F9): multi-token AND search and substring / regex search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.functions.text import all_tokens, ellipses, search_haystack

CORE = ["type", "brand", "product_name", "package_barcode", "room", "qty_on_hand"]


def search_all_tokens(df: DataFrame, query: str, cols: Sequence[str] = CORE,
                      type_len: int = 7) -> DataFrame:
    """F8: every whitespace token occurs in the lower-cased row as displayed
    (type cut to ``type_len`` characters)."""
    shown = [ellipses(F.col(c), type_len) if c == "type" else F.col(c) for c in cols]
    return df.where(all_tokens(search_haystack(*shown), query))


def search_text(df: DataFrame, query: str, cols: Sequence[str], regex: bool = False) -> DataFrame:
    """text columns joined by " | ", lower-cased; a literal substring by
    default, a regular expression when ``regex`` is set."""
    q = (query or "").strip().lower()
    if not q:
        return df
    hay = search_haystack(*[F.col(c) for c in cols], sep=" | ")
    return df.where(hay.rlike(q) if regex else hay.contains(F.lit(q)))
