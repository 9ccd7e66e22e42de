"""The fixture views as DuckDB SQL (FIXTURES.md B), used by the oracle SQL.

``with_views(body, ...)`` prefixes a query with the CTEs it needs.
"""

from __future__ import annotations

from stockspark.fixtures import ROOM_ALIASES
from stockspark.schema import SALES_FLOOR_ALIASES

INVENTORY = """
select l_orderkey as ord_1, l_linenumber as ord_2, l_partkey as ord_3,
       l_suppkey as ord_4, l_shipdate as ord_5, l_extendedprice as ord_6,
       case when p_type = 'SMALL' then 'Accessories' else p_type end as type,
       p_brand as brand,
       concat(p_name, ' #', cast(l_partkey as string), '-', cast(l_orderkey % 10 as string)) as product_name,
       concat('1A4', lpad(cast(l_partkey as string), 13, '0'),
                     lpad(cast(l_suppkey as string), 8, '0')) as package_barcode,
       case l_linenumber when 1 then 'Sales Floor' when 2 then 'Backstock'
            when 3 then 'Vault 1' when 4 then 'Incoming Deliveries'
            when 5 then 'Overflow' when 6 then 'SF' else 'Sample Vault' end as room,
       cast(floor(l_quantity) as int) as qty_on_hand,
       s_name as distributor,
       case when l_suppkey % 2 = 0 then 'A' else 'B' end as store,
       cast(p_size as string) as size,
       cast(l_shipdate as date) as received_date,
       case when l_discount = 0 then 0.0 else p_retailprice * (1 - l_discount) end as wholesale_cost,
       p_retailprice as unit_price,
       case when l_partkey % 17 = 0 then null
            else date '2001-01-01' + cast((l_partkey * 3 + l_linenumber) % 140 - 20 as int)
       end as expiration_date
from lineitem join part on p_partkey = l_partkey
              join supplier on s_suppkey = l_suppkey
"""

SNAPSHOT_ENTRY = """
select cast(ts as date) as snapshot_date,
       event_id as entry_idx,
       concat('U', lpad(cast(user_id as string), 8, '0')) as barcode,
       event_type as room,
       cast(floor(value / 50) as int) as qty
from events
"""

IMPORT_ENTRY = """
select store, store || '-' || strftime(snapshot_ts, '%Y%m%d%H') as import_id, snapshot_ts,
       cast(snapshot_ts as date) as snapshot_date, event_id as entry_idx,
       concat('U', lpad(cast(user_id as string), 8, '0')) as barcode,
       event_type as room, cast(floor(value / 50) as int) as qty
from (select *, case when user_id % 2 = 0 then 'A' else 'B' end as store,
             date_trunc('day', ts)::timestamp + case when hour(ts) < 12 then interval 11 hours else interval 23 hours end
               as snapshot_ts
      from events) e
"""

CURRENT_ITEMS = """
select snapshot_date, entry_idx, barcode, room, qty
from (select *, row_number() over (partition by barcode order by entry_idx) as rn
      from snapshot_entry
      where snapshot_date = (select max(snapshot_date) from snapshot_entry)) t
where rn = 1
"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(_q(v) for v in values)


FLOOR_LIST = sql_list(SALES_FLOOR_ALIASES)


def room_alias_sql(col: str = "room", aliases: dict | None = None) -> str:
    aliases = ROOM_ALIASES if aliases is None else aliases
    whens = " ".join(f"when lower(trim({col})) = {_q(k.strip().lower())} then {_q(v)}"
                     for k, v in aliases.items())
    return f"(case {whens} else trim({col}) end)"


# inventory after F1, room aliasing and F3: the shared input of move-up
WORK = f"""
select * replace ({room_alias_sql()} as room) from inventory
where product_name is not null and brand is not null
  and package_barcode is not null and room is not null
  and not coalesce(lower(type) like '%accessor%', false)
"""

_DEFS = {
    "inventory": INVENTORY,
    "snapshot_entry": SNAPSHOT_ENTRY,
    "import_entry": IMPORT_ENTRY,
    "current_items": CURRENT_ITEMS,
    "work": WORK,
}
_DEPS = {"current_items": ["snapshot_entry"], "work": ["inventory"]}


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} as ({_DEFS[n]})" for n in order]
    ctes += [f"{n} as ({s})" for n, s in (extra or [])]
    return ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body


def py_round_sql(expr: str, ndigits: int) -> str:
    """Python's round(x, ndigits) in DuckDB SQL (same error-free product as
    functions.numeric.py_round); the split of the constant is done here."""
    s = float(10 ** ndigits)
    c = s * 134217729.0
    sh = c - (c - s)
    sl = s - sh
    x = f"cast(({expr}) as double)"
    p = f"({x} * {s!r})"
    cx = f"({x} * 134217729.0)"
    xh = f"({cx} - ({cx} - {x}))"
    xl = f"({x} - {xh})"
    err = f"(((({xh} * {sh!r}) - {p}) + ({xh} * {sl!r})) + ({xl} * {sh!r})) + ({xl} * {sl!r})"
    f = f"floor({p})"
    d = f"((({p} - {f}) - 0.5) + ({err}))"
    q = (f"(case when {d} > 0 then {f} + 1.0 when {d} < 0 then {f} "
         f"when {f} - 2.0 * floor({f} / 2.0) = 0 then {f} else {f} + 1.0 end)")
    return f"(case when {x} is null or isnan({x}) then {x} else {q} / {s!r} end)"
