"""Room expressions: alias lookup and floor / candidate predicates."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.schema import DEFAULT_ROOM_ALIASES, SALES_FLOOR_ALIASES


def _alias_map_literal(aliases: dict[str, str]) -> Column:
    # keys that are equal after trimming and lower-casing: the last one counts
    last = {str(k or "").strip().lower(): v for k, v in aliases.items()}
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(last.items())])


def alias_room(room: Column, aliases: dict[str, str] | None) -> Column:
    """Trimmed room, replaced by its alias when the lower-cased room has one.

    One step only (not transitive); unmatched rooms keep their case.
    """
    trimmed = F.trim(room)
    if not aliases:
        return trimmed
    return F.coalesce(F.element_at(_alias_map_literal(aliases), F.lower(trimmed)), trimmed)


def normalize_rooms_df(df: DataFrame, aliases: DataFrame | dict | None,
                       room_col: str = "room") -> DataFrame:
    """Apply a room alias table to ``df``.

    ``aliases``: a dict, or a DataFrame ``(from_room, to_room[, pos])`` of any
    size, joined on the lower-cased room. Of equal keys the last one counts
    (largest ``pos``; without ``pos`` the largest target).
    """
    if not isinstance(aliases, DataFrame):
        return df.withColumn(room_col, alias_room(F.col(room_col), aliases))
    order = "pos" if "pos" in aliases.columns else "to_room"
    amap = (aliases.select(F.lower(F.trim("from_room")).alias("_akey"), "to_room", F.col(order).alias("_pos"))
                   .groupBy("_akey").agg(F.max_by("to_room", "_pos").alias("_ato")))
    out = (df.withColumn(room_col, F.trim(room_col))
             .join(amap, F.lower(F.col(room_col)) == F.col("_akey"), "left")
             .withColumn(room_col, F.coalesce("_ato", F.col(room_col)))
             .drop("_akey", "_ato"))
    return out


def alias_room_with_defaults(room: Column, user_aliases: dict[str, str] | None) -> Column:
    """Older variant: built-in default aliases with the user's on top."""
    merged = {k.lower(): v for k, v in DEFAULT_ROOM_ALIASES.items()}
    merged.update({str(k or "").lower(): v for k, v in (user_aliases or {}).items()})
    return alias_room(room, merged)


def is_sales_floor(room: Column) -> Column:
    """Case-insensitive: trimmed lower-cased room is one of the floor aliases."""
    return F.lower(F.trim(room)).isin(SALES_FLOOR_ALIASES)


def in_rooms(room: Column, rooms: list[str]) -> Column:
    """Case-sensitive: trimmed room is one of ``rooms`` (trimmed)."""
    return F.trim(room).isin([str(r).strip() for r in rooms])
