"""Mixing sources to target weights by hash-threshold histograms (operator 9).

Each source gets a budget of words. Every document has a fixed hash; a mix
takes each document ``whole`` times, and once more if its hash is at or under
the source's threshold. The threshold comes from histograms, not from sorting
documents: words are summed by source and hash bucket, running sums find the
bucket where the budget runs out, and only that bucket is split further, until
a single hash value is the boundary. A smaller budget's extra documents are a
subset of a larger one's (nested thresholds). The document at the boundary is
taken if that brings the source nearer to its target (ties: not taken).

All state is one row per (source, bucket): sums are combined map-side, so a
source that holds most rows costs no more than another, and no document text
is moved. Nothing is random: reruns give the same mix.

Defined cases: null text has size 0; a null source is a source of its own,
after all others; null doc_ids are hashed like an empty id; rows that repeat a
doc_id are taken together; a source without words has target 0; an empty table
gives an empty mix. Other columns are passed through or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockspark.llm.common import BROADCAST_IDS, table

# ---- fixed values of the contract
WEIGHTS = (3.0, 1.0, 2.0)      # by source in code-point order, repeating
SHARE = 1.5                    # of all words
MOST = 2.0                     # times a source's own size

HASH_BITS = 60
LEVELS = (12, 12, 36)          # bits of the hash that each histogram resolves
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a whole text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(doc_id: Column) -> Column:
    """60-bit hash of a document id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, source_size)``, one row a source.

    The budget is shared by weight; no target exceeds ``most`` times the
    source's size, and what is cut off goes to the others by weight until none
    is above. Sources fill up in order of limit / weight, so running sums in
    that order find the level at which the rest is shared.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", w.alias("weight"),
                          (F.col("source_size") * F.lit(most)).alias("most"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    fills = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    after = fills.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    open_ = F.col("most") / F.col("weight") >= F.col("level")
    # the first source that does not fill up sets the level of all after it; levels fall from there
    ranked = ranked.withColumn("shared", F.max(F.when(open_, F.col("level"))).over(everything))
    return ranked.select("source", "source_size", F.least(
        F.col("most"), F.coalesce(F.col("shared") * F.col("weight"), F.col("most"))).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, key, hash, size`` of every document; reads the text once."""
    return docs.select("doc_id", "source", source_key(F.col("source")).alias("key"),
                       hashed(F.col("doc_id")).alias("hash"), words(F.col("text")).alias("size"))


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.limit(BROADCAST_IDS // 16 + 1).count() <= BROADCAST_IDS // 16 else side


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``key, source_size, target, whole, last_hash``, one row a source.

    ``sizes`` is the output of :func:`sized`. A document is taken ``whole``
    times, and once more if its hash is at most ``last_hash``.
    """
    rows = sizes.groupBy("key", "source", "hash").agg(F.sum("size").alias("size"))
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(total, weights, share, most).withColumn("key", source_key(F.col("source"))).drop("source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = table(goal.withColumn("whole", whole.cast("long")).select(
        "key", "source_size", "target", "whole",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"),
        F.lit(False).alias("all")), "mix-goal")

    used = 0
    for n, bits in enumerate(LEVELS):
        used += bits
        lower = HASH_BITS - used
        source_rows = (sizes if n == 0 else rows).withColumn("slot", F.shiftright("hash", lower))
        if n:
            inside = state.where(~F.col("all")).select("key", "prefix")
            source_rows = source_rows.withColumn("prefix", F.shiftright("hash", lower + bits))
            source_rows = source_rows.join(_small(inside), ["key", "prefix"])
        histogram = source_rows.groupBy("key", "slot").agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("key").orderBy("slot")
        running = histogram.join(_small(state.where(~F.col("all"))), "key").withColumn(
            "upto", F.col("below") + F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        over = F.col("upto") > F.col("rest")
        edge = running.groupBy("key").agg(
            F.min(F.when(over, F.struct("slot", F.col("upto").alias("above"), "size"))).alias("edge"))
        state = state.join(edge, "key", "left").select(
            "key", "source_size", "target", "whole", "rest",
            F.coalesce("edge.slot", "prefix").alias("prefix"),
            F.coalesce(F.col("edge.above") - F.col("edge.size"), "below").alias("below"),
            (F.col("all") | F.col("edge").isNull()).alias("all"),
            F.col("edge.above").alias("above"))
        state = table(state, "mix-level")
        if n + 1 < len(LEVELS):
            edges = state.where(~F.col("all")).select("key", "prefix")
            kept = (sizes if n == 0 else rows).withColumn("prefix", F.shiftright("hash", lower))
            kept = kept.join(_small(edges), ["key", "prefix"]).groupBy("key", "hash").agg(F.sum("size").alias("size"))
            rows = table(kept, "mix-boundary")
            state = state.drop("above")
    nearer = F.col("above") - F.col("rest") < F.col("rest") - F.col("below")
    last = (F.when(F.col("all"), F.lit((1 << HASH_BITS) - 1))
             .when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1))
    return table(state.select("key", "source_size", "target", "whole", last.alias("last_hash")), "mix-plan")


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    sizes = table(sized(docs), "mix-sizes")
    extra = (F.col("hash") <= F.col("last_hash")).cast("long")
    return sizes.join(_small(plan(sizes)), "key").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + extra)).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The mixed corpus: rows of ``docs`` repeated or left out, columns unchanged."""
    sizes = table(sized(docs).drop("doc_id"), "mix-sizes")
    chosen = plan(sizes).select(F.col("key").alias("_key"), F.col("whole").alias("_whole"),
                                F.col("last_hash").alias("_last"))
    keyed = docs.withColumn("_key", source_key(F.col("source")))
    times = F.col("_whole") + (hashed(F.col("doc_id")) <= F.col("_last")).cast("long")
    copies = F.array_repeat(F.lit(True), times.cast("int"))
    return (keyed.join(_small(chosen), "_key").withColumn("_copy", F.explode(copies))
                 .select(*[docs[c] for c in docs.columns]))


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce('s' || source, 'n') as key,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as hash,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
total as (select source, key, sum(size)::bigint as source_size from sized group by source, key),
ranked as (
  select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight,
         source_size * 2.0::double as most, sum(source_size) over () * 1.5::double as budget
  from total),
filling as (
  select *, (budget - coalesce(sum(most) over (order by most / weight, source nulls last
                                               rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by most / weight, source nulls last
                                rows between current row and unbounded following) as level
  from ranked),
goal as (
  select key, source_size, least(most, coalesce(
           max(case when most / weight >= level then level end) over () * weight, most))::double as target
  from filling),
split as (
  select *, (case when source_size > 0 then floor(target / source_size) else 0 end)::bigint as whole from goal),
rest as (select *, target - whole * source_size as rest from split),
running as (
  select key, hash, sum(sum(size)) over (partition by key order by hash) as upto from sized group by key, hash),
edge as (
  select r.key, min(hash) filter (upto > rest) as hash, min(upto) filter (upto > rest) as above,
         coalesce(max(upto) filter (upto <= rest), 0) as below, any_value(rest) as rest
  from running r join rest using (key) group by r.key),
chosen as (
  select key, case when hash is null then 1152921504606846975
                   when above - rest < rest - below then hash else hash - 1 end as last_hash from edge)
select doc_id, size, source_size::bigint as source_size, target,
       (size * (whole + (case when hash <= last_hash then 1 else 0 end)))::bigint as taken
from sized join rest using (key) join chosen using (key)
"""
