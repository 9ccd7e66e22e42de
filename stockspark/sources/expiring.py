"""Loader of expiring-item exports (S4, P4, P9, P10, P13; M10).

These exports have a header rule and a column detection of their own: the
header is the first of the first 20 lines with cells equal to "Product Name"
and "Expiration Date"; every role takes the first of its patterns, then the
first column, that matches, looking only at columns with any value. All files
are worked out in one job: header cells meet the pattern table, and the best
(pattern, column) per file and role is one small aggregate.

Defined cases: a file without such a header line, or whose only candidate for a
required role is an empty column, is rejected with the reason; roles without a
column are null; repeated column names are columns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.functions.parse import parse_expiry, parse_number
from stockspark.functions.text import barcode_tail
from stockspark.session import written_once
from stockspark.sources.ingest import Exports, Ingested, detect_header_row_exact

# ---- fixed values: per role its patterns, in order (any case, anywhere in the header)
PATTERNS = {
    "expiration": [r"expiration\s*date", r"\bexpir", r"\bexp\b", r"expires?", r"best\s*by", r"use\s*by"],
    "product": [r"product\s*name", r"\bproduct\b"],
    "category": [r"\bcategory\b"],
    "subcategory": [r"sub\s*category|subcategory"],
    "brand": [r"\bbrand\b"],
    "location": [r"\blocation\b"],
    "available_qty": [r"available\s*qty", r"\bavailable\b"],
    "qty": [r"^\s*qty\s*$", r"quantity", r"on\s*hand", r"count"],
    "metrc": [r"\bmetrc\b", r"\btag\b", r"rfid", r"package\s*tag", r"package\s*id", r"metrc\s*tag"],
}
REQUIRED_ROLES = ["expiration", "product"]


def pattern_table(patterns: dict[str, list[str]]) -> Column:
    """``array<struct<role, place, pattern>>``: the patterns as rows of a literal table."""
    return F.array(*[F.struct(F.lit(role).alias("role"), F.lit(i).alias("place"), F.lit(f"(?i){p}").alias("pattern"))
                     for role, some in patterns.items() for i, p in enumerate(some)])


def pick_columns(cells: DataFrame, patterns: dict[str, list[str]] = PATTERNS) -> DataFrame:
    """``cells(file, idx, name)`` -> ``file, roles`` (role -> column index), the first pattern, then the
    first column, that matches; roles without a match are absent."""
    tried = cells.select("file", "idx", "name", F.explode(pattern_table(patterns)).alias("p"))
    hit = tried.where(F.regexp_like(F.coalesce("name", F.lit("")), F.col("p.pattern")))
    best = hit.groupBy("file", F.col("p.role").alias("role")).agg(
        F.min_by("idx", F.struct(F.col("p.place").alias("place"), "idx")).alias("idx"))
    return best.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("role", "idx"))).alias("roles"))


def ingest_expiring(raw: DataFrame, patterns: dict[str, list[str]] = PATTERNS) -> Ingested:
    """Expiring-item exports of a text scan -> ``rows`` (``file, _ord, expiration_date, product, category,
    subcategory, brand, location, available_qty, metrc, metrc6``) and ``rejected`` (``file, reason``)."""
    files = Exports(raw)
    found = detect_header_row_exact(files.first, files.delims).join(files.delims, "file")
    found = written_once(found, "expiring-headers")
    names = found.select("file", F.posexplode("header").alias("idx", "name"))
    # columns without any value do not count; only those that some pattern would take are looked at
    any_pattern = F.exists(pattern_table(patterns), lambda p: F.regexp_like(F.coalesce("name", F.lit("")), p["pattern"]))
    wanted = names.where(any_pattern).groupBy("file").agg(F.collect_list("idx").alias("wanted"))
    data = files.data(found.select("file", "delim", "header_line").join(wanted, "file"))
    full = data.select("file", F.explode(F.filter(
        "wanted", lambda i: F.trim(F.coalesce(F.try_element_at("cells", i + 1), F.lit(""))) != "")).alias("idx")).distinct()
    roles = pick_columns(names.join(full, ["file", "idx"]), patterns)
    lacking = F.filter(F.array(*[F.lit(r) for r in REQUIRED_ROLES]), lambda r: F.try_element_at("roles", r).isNull())
    settings = written_once(files.delims.select("file").join(found.select("file", "delim", "header_line"), "file", "left")
                             .join(roles, "file", "left").withColumn("roles", F.coalesce(
                                 "roles", F.create_map().cast("map<string,int>"))), "expiring-settings")
    reason = F.when(F.col("header_line").isNull(), F.lit("no header line with Product Name and Expiration Date")).when(
        F.size(lacking) > 0, F.concat(F.lit("Missing required columns: "), F.array_join(lacking, ", ")))
    rejected = settings.select("file", reason.alias("reason")).where("reason is not null")
    data = files.data(settings.where(reason.isNull()).select("file", "delim", "header_line", "roles"))

    def cell(*some: str) -> Column:
        idx = F.coalesce(*[F.try_element_at("roles", F.lit(r)) for r in some])
        return F.try_element_at("cells", idx + 1)

    rows = data.select(
        "file", "_ord", parse_expiry(cell("expiration")).alias("expiration_date"), cell("product").alias("product"),
        cell("category").alias("category"), cell("subcategory").alias("subcategory"), cell("brand").alias("brand"),
        cell("location").alias("location"), parse_number(cell("available_qty", "qty")).alias("available_qty"),
        cell("metrc").alias("metrc"), barcode_tail(cell("metrc"), 6, True).alias("metrc6"))
    return Ingested(rows, rejected)
