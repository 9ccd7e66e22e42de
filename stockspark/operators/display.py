"""Display projection (P16): active columns, extras that exist, friendly
names for velocity columns (added beside the raw ones)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: friendly names of the velocity columns
FRIENDLY_NAMES = {
    "velocity_label": "Status",
    "sell_rate": "Sells/Day",
    "qty_delta": "Qty Change",
    "room_changes": "Room Moves",
    "stock_age_days": "Age (Days)",
    "qty_unchanged_streak": "Unchanged Imports",
    "velocity_score": "Score",
    "last_qty": "Last Qty",
    "last_seen": "Last Seen",
}


def display_columns(active: Sequence[str], df: DataFrame, extra: Sequence[str]) -> list[str]:
    """Active columns plus the extras that exist in ``df`` (schema only)."""
    out = list(active)
    out += [c for c in extra if c in df.columns and c not in out]
    return out


def display_projection(df: DataFrame, active: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return df.select(*display_columns(active, df, extra))


def with_friendly_names(df: DataFrame) -> DataFrame:
    """Copy each raw velocity column under its friendly name (raw kept)."""
    adds = {f: F.col(r) for r, f in FRIENDLY_NAMES.items() if r in df.columns and f not in df.columns}
    return df.withColumns(adds) if adds else df
