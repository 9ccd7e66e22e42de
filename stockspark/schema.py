"""Fixed values and schemas.

The lists below are fixed values: they must equal what the inventory tool
uses so that results agree (room aliases, column-name synonyms, thresholds).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: required and optional inventory columns (internal names)
REQUIRED = ["type", "brand", "product_name", "package_barcode", "room", "qty_on_hand"]
OPTIONAL = ["distributor", "store", "size", "received_date", "wholesale_cost", "unit_price"]

# ---- fixed values: display names of the columns, same order as above
DISPLAY_NAMES = {
    "type": "Type", "brand": "Brand", "product_name": "Product Name",
    "package_barcode": "Package Barcode", "room": "Room", "qty_on_hand": "Qty On Hand",
    "distributor": "Distributor", "store": "Store", "size": "Size",
    "received_date": "Received Date", "wholesale_cost": "Wholesale Cost",
    "unit_price": "Unit Price",
}

# ---- fixed values: header synonyms per internal column (lower case)
NAME_SYNONYMS = {
    "type": ["type", "product type", "category", "item type", "class"],
    "brand": ["brand", "brand name", "manufacturer", "mfr"],
    "product_name": ["product name", "product", "item name", "name", "title", "item"],
    "package_barcode": ["package barcode", "package id", "upc", "ean", "gtin",
                        "barcode", "package upc", "package ean"],
    "room": ["room", "location", "stock location", "bin", "area",
             "warehouse location", "site location"],
    "qty_on_hand": ["available qty", "qty on hand", "quantity on hand", "on hand",
                    "quantity", "qoh", "stock", "stock qty", "current quantity",
                    "current qty"],
    "distributor": ["distributor", "vendor", "supplier", "producer", "wholesaler"],
    "store": ["store", "store name", "storename", "location name", "site"],
    "size": ["size", "product size", "package size", "unit size", "net weight",
             "weight", "volume"],
    "received_date": ["received date", "receipt date", "date received", "reception date",
                      "receive date", "date of receipt", "received on", "arrival date",
                      "intake date", "package date", "packaged date", "harvest date"],
    "wholesale_cost": ["wholesale cost", "wholesale price", "wholesale", "cost",
                       "unit cost", "vendor cost", "supplier cost", "buy price"],
    "unit_price": ["unit price", "retail price", "price", "sell price",
                   "selling price", "retail", "msrp", "srp"],
}

# ---- fixed values: rooms that count as the sales floor (compared lower case)
SALES_FLOOR_ALIASES = ["sales floor", "floor", "salesfloor", "front of house",
                       "foh", "front", "front of shop", "retail"]

# ---- fixed values: built-in room aliases of the older single-file variant
# (lower-case key -> room); user aliases override them
DEFAULT_ROOM_ALIASES = {
    "back room": "Overstock",
    "backroom": "Overstock",
    "back stock": "Overstock",
    "backstock": "Overstock",
    "stockroom": "Overstock",
    "stock room": "Overstock",
    "back": "Overstock",
    "over stock": "Overstock",
    "incoming": "Incoming Deliveries",
    "receiving": "Incoming Deliveries",
    "receiving area": "Incoming Deliveries",
    "delivery": "Incoming Deliveries",
    "deliveries": "Incoming Deliveries",
    "safe": "Vault",
    "safe room": "Vault",
}

# ---- fixed values: velocity model
VELOCITY_SLOW_THRESHOLD = 3
VELOCITY_QTY_WEIGHT = 0.7
VELOCITY_ROOM_WEIGHT = 0.3
VELOCITY_FAST_THRESHOLD = 0.25
VELOCITY_LABELS = ["New", "Fast", "Moderate", "Slow", "Stale", "Sold Out"]

# ---- fixed values: display lengths
TYPE_TRUNC_LEN = 7
PRODUCT_TRUNC_LEN = 60
SUBCATEGORY_TRUNC_LEN = 18
PRODUCT_TRUNC_LEN_PDF = 75
BARCODE_TAIL_LEN = 6
METRC_TAIL_LEN_AUDIT = 8
MIN_JUNK_DIGITS = 6
AUDIT_ROWS_PER_PAGE = 35

# ---- fixed values: received-date text format tried first
RECEIVED_DATE_FORMAT = "M/d/yyyy h:mm:ss a"
SPREADSHEET_EPOCH = "1899-12-30"

INVENTORY_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("package_barcode", T.StringType()),
    T.StructField("room", T.StringType()),
    T.StructField("qty_on_hand", T.IntegerType()),
    T.StructField("distributor", T.StringType()),
    T.StructField("store", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("received_date", T.DateType()),
    T.StructField("wholesale_cost", T.DoubleType()),
    T.StructField("unit_price", T.DoubleType()),
])

SNAPSHOT_ENTRY_SCHEMA = T.StructType([
    T.StructField("snapshot_date", T.DateType()),
    T.StructField("entry_idx", T.LongType()),
    T.StructField("barcode", T.StringType()),
    T.StructField("room", T.StringType()),
    T.StructField("qty", T.IntegerType()),
])
