"""Parsing expressions: quantities, money, dates (ANSI-safe via try_*)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockspark.schema import SPREADSHEET_EPOCH

# ---- fixed values: date text formats tried in order after the export format
RECEIVED_FORMATS = [
    "M/d/yyyy h:mm:ss a",
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "M/d/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yy",
    "MM-dd-yyyy",
    "yyyy/MM/dd",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMM d yyyy",
    "MMMM d, yyyy",
    "d-MMM-yyyy",
    "M/d/yyyy h:mm a",
    "M-d-yyyy",
    "yyyy/M/d",
    "yyyyMMdd",
]
# ---- fixed values: spreadsheet serial days from 1900-01-01 to 9999-12-31
SERIAL_DAYS = (2, 2958465)
_EMPTY_TEXT = ["", "nan", "none", "nat", "null"]


def to_qty(c: Column) -> Column:
    """Integer quantity: numeric text truncated toward zero, bad -> 0."""
    return F.coalesce(c.cast("string").try_cast("double").try_cast("int"), F.lit(0))


def to_money(c: Column) -> Column:
    """Double amount, missing ('nan') or unparseable -> 0.0."""
    return F.coalesce(F.nanvl(c.cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0))


def parse_number(c: Column) -> Column:
    """Thousands commas removed; '', 'nan' and bad values -> null."""
    return F.nanvl(F.regexp_replace(c.cast("string"), ",", "").try_cast("double"), F.lit(None).cast("double"))


def is_empty_text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(_EMPTY_TEXT)


def parse_received_date(c: Column) -> Column:
    """Leading apostrophes stripped; export format first, then common forms.

    Fractions of a second and a zone after the time do not change the day.
    """
    s = F.trim(F.ltrim(F.trim(c.cast("string")), F.lit("'")))
    cut = F.regexp_replace(s, r"(:\d{2})[.,]\d+", "$1")
    cut = F.regexp_replace(cut, r"(:\d{2}) ?(?:Z|UTC|[+-]\d{2}:?\d{2})$", "$1")
    s = F.when(s.contains(":"), cut).otherwise(s)

    def day(t: Column) -> Column:
        # a format that fails costs an exception: those the text cannot have are left out
        tries = [F.when(_may_have(t, f), F.to_date(F.try_to_timestamp(t, F.lit(f)))) for f in RECEIVED_FORMATS]
        return F.when(is_empty_text(t), F.lit(None).cast("date")).otherwise(F.coalesce(*tries))
    # as a lambda: the text is worked out once, not once a format
    return F.transform(F.array(s), day)[0]


def _may_have(t: Column, fmt: str) -> Column:
    """False only for texts that ``fmt`` cannot match: its signs all occur, and no field of any format takes "/" or ":"."""
    signs = sorted(set(re.sub(r"[A-Za-z']", "", fmt)))
    out = F.lit(True)
    for sign in sorted({*signs, "/", ":"}):
        out = out & (t.contains(sign) if sign in signs else ~t.contains(sign))
    return out


def parse_expiry(c: Column) -> Column:
    """Spreadsheet serial days (origin 1899-12-30) or date text; bad -> null.

    A number is a serial day only in the range of dates a spreadsheet has;
    'nan', 'inf' and larger numbers are read as text (20240131 is a date).
    """
    s = F.trim(c.cast("string"))
    serial = s.try_cast("double")
    serial = F.when(serial.between(*SERIAL_DAYS), serial)
    return F.when(is_empty_text(s), F.lit(None).cast("date")).when(serial.isNotNull(),
                  F.date_add(F.lit(SPREADSHEET_EPOCH).cast("date"), F.floor(serial).cast("int"))
                  ).otherwise(parse_received_date(s))
