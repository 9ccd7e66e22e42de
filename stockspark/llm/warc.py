"""Merkle fixity audit of WARC archives (operator 1).

An archive is a table of records: file, offset and length in the file's index,
and the record's bytes. Every replica gets a tree of SHA-256 digests:

* leaf: one record, digest over its indexed offset, its length and its bytes;
* ordered offset ranges of a file (64 KB, then 1 MB), then the file;
* groups of 64 files, of 4,096 files and of 262,144 files, and the root.

A node's digest covers its children's keys and digests in order. The audit
compares the roots and goes down only where digests differ: the children of a
differing node are compared next, down to single records. Equal replicas are
settled by one comparison; damage to one record touches one path.

All levels are grouped aggregates over digests, so record bytes are read once,
hashed where they lie and never shuffled. No group holds more than one range.

Defined cases: a record that one replica lacks is ``missing`` (in the second) or
``extra``; another length is ``resized``; other bytes are ``altered``. Null
bytes count as empty. Rows that repeat a place are hashed together. Empty
archives are equal. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockspark.llm.common import id_side, table

RECORDS_A_FILE = 1024       # pages archived in one file
# bits of the offset that a range keeps out, then bits of the file number
OFFSET_BITS = (16, 20)
FILE_BITS = (0, 6, 12, 18)


def warc_record(url: Column, page_id: Column, html: Column) -> Column:
    """A WARC/1.0 response record as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
                    F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
                    F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame) -> DataFrame:
    """``page_id, file, length, record`` of ``pages(page_id, url, html)``."""
    record = warc_record(F.col("url"), F.col("page_id"), F.col("html"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.floor(F.coalesce(F.col("page_id"), F.lit(-1)) / RECORDS_A_FILE).alias("file"),
                        record.alias("record")).withColumn("length", F.octet_length("record").cast("long"))


def index(records: DataFrame) -> DataFrame:
    """``file, page_id, offset, length``: where each record of an archive starts.

    Records follow each other in order of page_id. Pages that repeat an id
    share a place, so a window holds at most one row an id.
    """
    place = records.groupBy("file", "page_id").agg(F.max("length").alias("length"))
    before = Window.partitionBy("file").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return place.select("file", "page_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
                        "length")


def digests(records: DataFrame) -> DataFrame:
    """``file, page_id, bytes, digest`` of the records of one replica; reads the bytes once."""
    body = F.coalesce(F.col("record").cast("binary"), F.lit(b""))
    one = records.select("file", "page_id", F.octet_length(body).cast("long").alias("bytes"),
                         F.sha2(body, 256).alias("digest"))
    # rows that repeat a place: sums of digest parts, whatever their number and order
    parts = [F.sum(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}")
             for i in range(4)]
    place = one.groupBy("file", "page_id").agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("digest").alias("digest"), *parts)
    several = F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]), 256)
    return place.select("file", "page_id", "bytes", F.when(F.col("n") == 1, F.col("digest")).otherwise(several)
                        .alias("digest"))


# levels from single records up: name, key columns
LEVELS = ([("record", lambda: [F.col("file"), F.col("offset")])]
          + [(f"range{b}", lambda b=b: [F.col("file"), F.shiftright("offset", b)]) for b in OFFSET_BITS]
          + [(f"files{b}", lambda b=b: [F.shiftright("file", b), F.lit(0).cast("long")]) for b in FILE_BITS]
          + [("root", lambda: [F.lit(0).cast("long"), F.lit(0).cast("long")])])


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Nodes of each level, from records to the root, of all replicas in ``leaves``.

    ``leaves``: ``replica, file, offset, bytes, digest``. Each level has ``replica,
    k1, k2`` (key), ``file, offset`` (of the node's first record, from which the
    key of every ancestor follows) and ``hash``.
    """
    own = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("bytes").cast("string"), "digest"), 256)
    level = leaves.select("replica", *[k.alias(n) for k, n in zip(LEVELS[0][1](), ("k1", "k2"))], "file", "offset",
                          own.alias("hash"))
    levels = [level]
    for name, key in LEVELS[1:]:
        k1, k2 = key()
        child = F.array_sort(F.collect_list(F.struct("file", "offset", "hash")))
        joined = F.array_join(F.transform("c", lambda x: F.concat_ws(
            ":", x["file"].cast("string"), x["offset"].cast("string"), x["hash"])), ",")
        grouped = level.withColumns({"k1": k1, "k2": k2}).groupBy("replica", "k1", "k2").agg(child.alias("c"))
        level = table(grouped.select(
            "replica", "k1", "k2", F.col("c")[0]["file"].alias("file"), F.col("c")[0]["offset"].alias("offset"),
            F.sha2(joined, 256).alias("hash")), f"warc-{name}")
        levels.append(level)
    return levels


def differing(levels: list[DataFrame]) -> DataFrame:
    """``file, offset`` of the records that differ between replicas 0 and 1, from the root down."""
    bad = None
    for n in range(len(LEVELS) - 1, -1, -1):
        nodes = levels[n]
        if bad is not None:
            p1, p2 = LEVELS[n + 1][1]()                # the node's parent, from its first record
            nodes = nodes.withColumns({"p1": p1, "p2": p2}).join(id_side(bad), ["p1", "p2"], "left_semi")
        sides = [F.max(F.when(F.col("replica") == r, F.col("hash"))).alias(f"h{r}") for r in (0, 1)]
        found = nodes.groupBy("k1", "k2").agg(*sides).where(~F.col("h0").eqNullSafe(F.col("h1")))
        found = table(found.select("k1", "k2"), "warc-differing")
        bad = found.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"))
        if not bad.limit(1).count():
            break
    return found.select(F.col("k1").alias("file"), F.col("k2").alias("offset"))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Differing records of two replicas, ``records(file, page_id, length, record)`` each.

    Returns ``file, offset, page_id, damage, length, digest, found_length,
    found_digest``: the record's place in the first replica's index (records
    outside the index stand behind it), and what each replica holds there.
    """
    place = table(index(first), "warc-index").select("file", F.coalesce("page_id", F.lit(-1)).alias("page_id"), "offset")
    both = [digests(x).withColumn("replica", F.lit(n)) for n, x in enumerate((first, second))]
    leaf = both[0].unionByName(both[1]).withColumn("page_id", F.coalesce("page_id", F.lit(-1)))
    leaf = leaf.join(place, ["file", "page_id"], "left").withColumn(
        "offset", F.coalesce("offset", F.lit(1 << 40) + F.col("page_id")))
    leaf = table(leaf.select("replica", "file", "offset", "page_id", "bytes", "digest"), "warc-leaves")
    held = leaf.join(id_side(differing(tree(leaf))), ["file", "offset"], "left_semi")

    def of(replica: int, column: str) -> Column:
        return F.max(F.when(F.col("replica") == replica, F.col(column)))
    both = held.groupBy("file", "offset").agg(
        F.max("page_id").alias("page_id"), of(0, "bytes").alias("length"), of(0, "digest").alias("digest"),
        of(1, "bytes").alias("found_length"), of(1, "digest").alias("found_digest"))
    damage = (F.when(F.col("found_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra")
               .when(F.col("length") != F.col("found_length"), "resized").otherwise("altered"))
    return both.select("file", "offset", F.when(F.col("page_id") >= 0, F.col("page_id")).alias("page_id"), damage.alias("damage"), "length",
                       "digest", "found_length", "found_digest")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with damage that follows from the page id: lost, cut and altered records."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 7),
               16, 10).cast("long")
    at = (F.lit(1) + h % F.length("record")).cast("int")
    swap = F.when(F.substr("record", at, F.lit(1)) == "#", "*").otherwise("#")
    rows = records.withColumn("_h", h % 97).where("_h <> 0")
    record = (F.when(F.col("_h") == 1, F.substr("record", F.lit(1), F.floor(F.length("record") / 2).cast("int")))
               .when(F.col("_h") == 2, F.concat(F.substr("record", F.lit(1), at - 1), swap,
                                                F.substr("record", at + 1, F.length("record"))))
               .otherwise(F.col("record")))
    return rows.withColumn("record", record).select(*records.columns)


ORACLE = r"""
with recs as (
  select page_id, page_id // 1024 as file,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
         || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
         || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) as rec,
         cast('0x' || substr(md5(cast(page_id as varchar)), 1, 7) as bigint) as h
  from pages),
places as (
  select *, coalesce(sum(strlen(rec)) over (partition by file order by page_id
                     rows between unbounded preceding and 1 preceding), 0)::bigint as "offset",
         (1 + h % length(rec))::int as pos
  from recs),
replica as (
  select *, case h % 97 when 0 then null when 1 then substr(rec, 1, length(rec) // 2)
            when 2 then substr(rec, 1, pos - 1) || (case when substr(rec, pos, 1) = '#' then '*' else '#' end)
                        || substr(rec, pos + 1) end as bad
  from places where h % 97 <= 2)
select file::bigint as file, "offset", page_id,
       case when bad is null then 'missing' when strlen(bad) <> strlen(rec) then 'resized' else 'altered' end as damage,
       strlen(rec)::bigint as length, sha256(rec) as digest, strlen(bad)::bigint as found_length,
       sha256(bad) as found_digest
from replica
"""
