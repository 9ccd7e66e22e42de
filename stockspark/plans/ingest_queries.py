"""Registered queries: raw-file ingest, column detection, parsing and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark import fixtures as fx
from stockspark.functions import parse as ps
from stockspark.plans.registry import register
from stockspark.plans.views import with_views
from stockspark.session import scratch_path
from stockspark.sources import expiring as ex
from stockspark.sources import ingest as ig
from stockspark.sources.raw_export import STYLES, TITLE_LINES, write_expiring_exports, write_raw_exports

_COLS = ["type", "brand", "product_name", "package_barcode", "room", "qty_on_hand", "distributor",
         "store", "size", "received_date", "wholesale_cost", "unit_price"]


def _exports(spark, sf_dir) -> str:
    path = scratch_path(spark, "raw-exports")
    write_raw_exports(fx.inventory(spark, sf_dir), path, compression="gzip")
    return path


@register("ingest_raw", with_views(f"select {', '.join(_COLS)} from inventory", "inventory"))
def q_ingest_raw(spark, sf_dir):
    """Inventory written as raw exports (renamed
    headers, title lines, TOTAL line) and ingested back."""
    return ig.ingest_raw(spark, _exports(spark, sf_dir)).select(*_COLS)


# the raw exports as SQL: style, lines and their numbers per file (raw_export.py)
def _line_sql(style: int) -> str:
    delim, quote, _ = STYLES[style]
    received = "strftime(received_date, '%m/%d/%Y %I:%M:%S %p')" if style == 1 else "strftime(received_date, '%Y-%m-%d')"
    cells = [f"coalesce(cast({received if c == 'received_date' else c} as varchar), '')" for c in _COLS]
    if quote:
        cells = [f"'\"' || replace({c}, '\"', '\"\"') || '\"'" for c in cells]
    return f" || '{delim}' || ".join(cells)


_TITLES = "list_value(" + ", ".join(f"'{t}'" for t in TITLE_LINES) + ")"
_HEADS = "case file_key % 3 " + " ".join(
    f"when {i} then '{d.join(chr(34) + n + chr(34) if q else n for n in names)}'" for i, (d, q, names) in enumerate(STYLES)) + " end"
_DELIM = "case file_key % 3 " + " ".join(f"when {i} then '{d}'" for i, (d, _, _) in enumerate(STYLES)) + " end"
_KEYS = "select distinct ord_1 // 5000 as file_key from inventory"
_LINES = f"""
select file_key, cast(file_key % 4 + row_number() over (
         partition by file_key order by ord_1, ord_2, ord_3, ord_4, ord_5, ord_6) as bigint) as line_no,
       case file_key % 3 {" ".join(f"when {i} then {_line_sql(i)}" for i in range(3))} end as value
from (select *, ord_1 // 5000 as file_key from inventory) i
union all
select file_key, p as line_no, case when p < file_key % 4 then {_TITLES}[p + 1] else {_HEADS} end as value
from (select file_key, unnest(range(file_key % 4 + 1)) as p from keys) h
union all
select file_key, cast(file_key % 4 + 1 + count(*) as bigint) as line_no,
       'TOTAL' || repeat({_DELIM}, 5) || cast(sum(qty_on_hand) as varchar) as value
from (select *, ord_1 // 5000 as file_key from inventory) t group by file_key"""


def _sql(body: str) -> str:
    return with_views(body, "inventory", extra=[("keys", _KEYS)])


def _file_key():
    return F.regexp_extract("file", r"file_key=(\d+)", 1).cast("long").alias("file_key")


@register("scan_text", _sql(f"select file_key, line_no, value from ({_LINES}) l"))
def q_scan_text(spark, sf_dir):
    """Every line of the raw exports with its file and number."""
    return ig.read_lines(spark, _exports(spark, sf_dir)).select(_file_key(), F.col("_ord").alias("line_no"), "value")


@register("header_row", _sql(f"select file_key, {_DELIM} as delim, file_key % 4 as header_line from keys"))
def q_header_row(spark, sf_dir):
    """S2 + S3: per file the delimiter and the header line."""
    files = ig.Exports(ig.scan_text(spark, _exports(spark, sf_dir)))
    return files.headers().select(_file_key(), "delim", "header_line")


@register("column_map", _sql(
    "select file_key, target, cast(idx as int) as idx from keys, (select unnest(["
    + ", ".join(f"'{c}'" for c in _COLS) + f"]) as target, unnest(range({len(_COLS)})) as idx) t"))
def q_column_map(spark, sf_dir):
    """Per file and target the mapped column index."""
    headers = ig.Exports(ig.scan_text(spark, _exports(spark, sf_dir))).headers()
    return ig.column_map(headers).select(_file_key(), F.explode("col_map").alias("target", "idx"))


# P5: every third file is mapped by hand with "unit_price" left out, every third wrongly
def _overrides(files):
    key = F.regexp_extract("file", r"file_key=(\d+)", 1).cast("long")
    names = F.element_at(F.array(*[F.array(*[F.lit(n) for n in names]) for _, _, names in STYLES]), (key % 3 + 1).cast("int"))
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in _COLS]).alias("target"), names.alias("source"))
    rows = files.where(key % 9 < 6).select("file", F.explode(pairs).alias("p")).select(
        "file", F.col("p.target").alias("target"), F.col("p.source").alias("source"))
    wrong = (F.when((key % 9 == 3) & (F.col("target") == "room"), F.lit(""))
              .when((key % 9 == 4) & (F.col("target") == "size"), F.lit("Room"))
              .when((key % 9 == 5) & (F.col("target") == "brand"), F.lit("Label")).otherwise(F.col("source")))
    return rows.withColumn("source", wrong).where(F.col("target") != "unit_price")


@register("manual_maps", _sql("""
select i.ord_1 // 5000 as file_key, product_name, package_barcode, room, qty_on_hand, wholesale_cost,
       case when (i.ord_1 // 5000) % 9 > 5 then unit_price else 0.0 end as unit_price,
       case when (i.ord_1 // 5000) % 9 > 5 then received_date end as received_date
from inventory i where (i.ord_1 // 5000) % 9 not in (3, 4, 5)
union all
select file_key, null, 'TOTAL'[1:0], null, total, 0.0, 0.0, null
from (select ord_1 // 5000 as file_key, cast(sum(qty_on_hand) as int) as total from inventory group by 1) t
where file_key % 9 < 3"""))
def q_manual_maps(spark, sf_dir):
    """P5: files with maps of their own; summary lines stay and dates stay text on that path."""
    path = _exports(spark, sf_dir)
    raw = ig.scan_text(spark, path)
    got = ig.ingest_files(raw, _overrides(raw.select("file").distinct()))
    return got.rows.select(_file_key(), "product_name", "package_barcode", "room", "qty_on_hand", "wholesale_cost",
                           "unit_price", "received_date")


@register("manual_maps_rejected", _sql("""
select file_key, case file_key % 9 when 3 then 'no source for: room'
         when 4 then case when file_key % 3 = 1 then 'source column used for more than one target: room'
                     else 'no such column: room' end
         else 'no such column: label' end as reason
from keys where file_key % 9 in (3, 4, 5)"""))
def q_manual_maps_rejected(spark, sf_dir):
    """P5: the files whose map is refused, with the reason."""
    raw = ig.scan_text(spark, _exports(spark, sf_dir))
    return ig.ingest_files(raw, _overrides(raw.select("file").distinct())).rejected.select(_file_key(), "reason")


@register("ingest_expiring", with_views("""
select product_name as product, expiration_date, type as category, brand, room as location,
       cast(qty_on_hand * 100 as double) as available_qty, package_barcode as metrc,
       right(regexp_replace(package_barcode, '[^0-9]', '', 'g'), 6) as metrc6
from inventory where ord_1 // 5000 % 4 <> 3""", "inventory"))
def q_ingest_expiring(spark, sf_dir):
    """Expiring-item exports with their own header rule and columns found by patterns."""
    path = scratch_path(spark, "expiring-exports")
    write_expiring_exports(fx.inventory(spark, sf_dir), path)
    got = ex.ingest_expiring(ig.scan_text(spark, path))
    return got.rows.select("product", "expiration_date", "category", "brand", "location", "available_qty", "metrc", "metrc6")


@register("ingest_expiring_rejected", _sql("""
select file_key, 'no header line with Product Name and Expiration Date' as reason from keys where file_key % 4 = 3"""))
def q_ingest_expiring_rejected(spark, sf_dir):
    """Files without the exact header line, named with the reason."""
    path = scratch_path(spark, "expiring-exports")
    write_expiring_exports(fx.inventory(spark, sf_dir), path)
    return ex.ingest_expiring(ig.scan_text(spark, path)).rejected.select(_file_key(), "reason")


_HIT = """
select '{c}' as column_name, avg(case when length(trim({c})) >= 16
       and regexp_matches(regexp_replace(trim({c}), '[\\s\\-]', '', 'g'), '^1[Aa][0-9][A-Za-z0-9]*$')
       then 1.0 else 0.0 end) as hit_rate
from inventory where {c} is not null"""
_HIT_COLS = ["package_barcode", "product_name", "distributor", "size"]


@register("barcode_hit_rate", with_views(" union all ".join(_HIT.format(c=c) for c in _HIT_COLS), "inventory"))
def q_barcode_hit_rate(spark, sf_dir):
    """Share of barcode-like values per column (all rows)."""
    inv = fx.inventory(spark, sf_dir)
    cells = inv.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string")
                                                    .alias("v")) for c in _HIT_COLS])).alias("x"))
    return (cells.where(F.col("x.v").isNotNull()).groupBy(F.col("x.column_name").alias("column_name"))
                 .agg(F.avg(ig.barcode_like(F.col("x.v")).cast("double")).alias("hit_rate")))


# text forms of dates derived from the data: three shapes by line number
_RECV_TEXT = ("case when ord_2 % 3 = 0 then '''' || strftime(received_date, '%m/%d/%Y %I:%M:%S %p') "
              "when ord_2 % 3 = 1 then strftime(received_date, '%Y-%m-%d') "
              "else strftime(received_date, '%-m/%-d/%Y') end")


def _recv_text():
    d = F.col("received_date")
    return (F.when(F.col("ord_2") % 3 == 0, F.concat(F.lit("'"), F.date_format(d.cast("timestamp"),
                                                                                "MM/dd/yyyy hh:mm:ss a")))
             .when(F.col("ord_2") % 3 == 1, F.date_format(d, "yyyy-MM-dd"))
             .otherwise(F.date_format(d, "M/d/yyyy")))


@register("parse_received_date", with_views(
    f"select package_barcode, {_RECV_TEXT} as received_text, received_date from inventory", "inventory"))
def q_parse_received_date(spark, sf_dir):
    inv = fx.inventory(spark, sf_dir).withColumn("received_text", _recv_text())
    return inv.select("package_barcode", "received_text",
                      ps.parse_received_date(F.col("received_text")).alias("received_date"))


@register("parse_expiry", with_views("""
select package_barcode, expiry_text, expiration_date from (
  select package_barcode, expiration_date,
         case when ord_2 % 2 = 0 then cast(date_diff('day', date '1899-12-30', expiration_date) as varchar)
              else strftime(expiration_date, '%Y-%m-%d') end as expiry_text
  from inventory) t""", "inventory"))
def q_parse_expiry(spark, sf_dir):
    inv = fx.inventory(spark, sf_dir)
    e = F.col("expiration_date")
    text = F.when(F.col("ord_2") % 2 == 0, F.datediff(e, F.lit("1899-12-30").cast("date")).cast("string")) \
            .otherwise(F.date_format(e, "yyyy-MM-dd"))
    return inv.select("package_barcode", text.alias("expiry_text"),
                      ps.parse_expiry(text).alias("expiration_date"))


@register("parse_number", with_views("""
select package_barcode, format('{:,}', qty_on_hand * 1000) as amount_text,
       cast(qty_on_hand * 1000 as double) as amount
from inventory""", "inventory"))
def q_parse_number(spark, sf_dir):
    inv = fx.inventory(spark, sf_dir)
    text = F.format_number((F.col("qty_on_hand") * 1000).cast("long"), 0)
    return inv.select("package_barcode", text.alias("amount_text"), ps.parse_number(text).alias("amount"))


@register("clean_types", with_views("""
select trim(package_barcode) as package_barcode,
       case when ord_2 = 7 then 0 else qty_on_hand end as qty_on_hand,
       wholesale_cost, unit_price, trim(distributor) as distributor, trim(store) as store, trim(size) as size
from inventory""", "inventory"))
def q_clean_types(spark, sf_dir):
    """P6 over text columns derived from the data: quantities as '12.5'
    (or 'n/a' on line 7), costs as text ('free' when zero), padded names."""
    inv = fx.inventory(spark, sf_dir)
    raw = inv.select(
        F.concat(F.lit(" "), F.col("package_barcode"), F.lit(" ")).alias("package_barcode"),
        F.when(F.col("ord_2") == 7, F.lit("n/a")).otherwise(
            F.concat(F.col("qty_on_hand").cast("string"), F.lit(".5"))).alias("qty_on_hand"),
        F.when(F.col("wholesale_cost") == 0, F.lit("free")).otherwise(
            F.col("wholesale_cost").cast("string")).alias("wholesale_cost"),
        F.col("unit_price").cast("string").alias("unit_price"),
        F.concat(F.lit("  "), F.col("distributor")).alias("distributor"),
        F.concat(F.col("store"), F.lit(" ")).alias("store"), F.col("size"))
    return ig.clean_types(raw)


@register("drop_junk_rows", with_views("""
select package_barcode, product_name from (
  select case when ord_2 = 7 and ord_3 % 2 = 0 then 'Total: ' || cast(qty_on_hand as varchar)
              else package_barcode end as package_barcode,
         case when ord_2 = 7 then '' else product_name end as product_name
  from inventory) t
where not (length(regexp_replace(lower(trim(package_barcode)), '[^0-9]', '', 'g')) < 6
           and lower(trim(product_name)) in ('', 'nan', 'none', 'nat', 'null'))""", "inventory"))
def q_drop_junk_rows(spark, sf_dir):
    """P7 over rows made junk-like from the data: line-7 rows lose their
    product name and half of them their barcode (a "Total: n" cell)."""
    inv = fx.inventory(spark, sf_dir)
    raw = inv.select(
        F.when((F.col("ord_2") == 7) & (F.col("ord_3") % 2 == 0),
               F.concat(F.lit("Total: "), F.col("qty_on_hand").cast("string")))
         .otherwise(F.col("package_barcode")).alias("package_barcode"),
        F.when(F.col("ord_2") == 7, F.lit("")).otherwise(F.col("product_name")).alias("product_name"))
    return ig.drop_junk_rows(raw)
