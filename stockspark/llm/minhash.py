"""Near-duplicate documents by one-permutation MinHash (operator 2).

Method: every text becomes its set of distinct word shingles (64-bit hashes).
One permutation hashing splits the hash range into ``BINS`` bins and keeps the
smallest hash of each; empty bins borrow a value from a non-empty bin picked
by a bin-and-attempt hash (optimal densification). ``ROWS`` consecutive bins
form a band; equal bands form a bucket. Inside a bucket candidate edges form a
star: one centre joined to the other members, so a bucket of n documents gives
n - 1 pairs, not n squared. The centre is the member with most company over
all its buckets (later rounds add a second centre, picked by hash). Every edge is confirmed on the full shingle sets, confirmed
links are contracted to components, and buckets that still hold documents of
different components get a further star around their next centre, until a
round finds no new link.

A last sweep makes this complete: every pair of documents that shares a bucket and is
still in different components is looked at, in blocks of ``BLOCK`` members (the block
pairs of a large bucket are tasks of their own; the bucket's largest component meets the
others, not itself). Each document has a bitmap of ``BITS`` parities of its set; the bits in which two
bitmaps differ are at most the elements in which the sets differ, so a pair whose bitmaps
differ in too many cannot be similar enough, and only the others become rows and are
confirmed on full sets. So no link between documents that share a bucket is lost.

Copies with equal shingle sets are merged first (grouped by set fingerprint
with map-side combining), so a group of any size takes part as one node.

Defined cases: null or empty text, or text without words: no shingles, linked
with nothing. Fewer words than a shingle: the whole sequence is the one
shingle. Null ``doc_id``: the row is kept and never linked. Rows that repeat a
``doc_id`` are one document: they share a component. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockspark.llm.common import id_side, small_batches, table
from stockspark.llm.flat import U64, RangeHash, lower_ascii, mix64, spans, text_slices

BINS = 126
ROWS = 3
BLOCK = 512                # members of a bucket that one block of the sweep holds
BITS = 2048                # of a set's parity bitmap
MAX_PASSES = 64            # label passes of one contraction; star edges need two or three

_NODE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_a", T.LongType()),
    T.StructField("set_b", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])


def shingle_sets(col: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch."""
    for first, end, data, offsets in text_slices(col):
        data = lower_ascii(data)
        starts, ends, doc = spans(data, offsets)
        words = RangeHash(data)(starts, ends)
        counts = np.bincount(doc, minlength=end - first)
        begin = np.concatenate([[0], np.cumsum(counts)])
        rolled = np.zeros(0, dtype=np.uint64)
        if len(words) >= width:
            m = len(words) - width + 1
            rolled = np.full(m, width, dtype=np.uint64)
            for k in range(width):
                rolled = mix64(rolled * U64(0x9E3779B97F4A7C15) + words[k:k + m])
        for i in range(end - first):
            n, b = counts[i], begin[i]
            if n >= width:
                yield np.unique(rolled[b:b + n - width + 1])
            elif n:
                h = np.full(1, n, dtype=np.uint64)
                for w in words[b:b + n]:
                    h = mix64(h * U64(0x9E3779B97F4A7C15) + w)
                yield h
            else:
                yield np.zeros(0, dtype=np.uint64)


def bin_of(hashes: np.ndarray) -> np.ndarray:
    """Bin of each hash: equal parts of the hash range, so order is kept."""
    return (((hashes >> U64(32)) * U64(BINS)) >> U64(32)).astype(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a non-empty sorted hash set."""
    bins = np.arange(BINS)
    at = np.searchsorted(bin_of(hashes), bins)
    full = at < len(hashes)
    full[full] = bin_of(hashes[at[full]]) == bins[full]
    sig = np.zeros(BINS, dtype=np.uint64)
    sig[full] = hashes[at[full]]
    empty, attempt = bins[~full], 0
    while len(empty):
        attempt += 1
        seed = np.uint64(attempt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        source = (mix64(empty.astype(np.uint64) * U64(0x10001) + seed) % U64(BINS)).astype(np.int64)
        found = full[source]
        sig[empty[found]] = sig[source[found]]
        empty = empty[~found]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def _nodes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()),
                        ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        size, fa, fb, bands = [], [], [], []
        for s in shingle_sets(batch.column("text"), width):
            size.append(len(s))
            if len(s):
                fa.append(int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)))
                fb.append(int(np.add.reduce(mix64(s ^ U64(0x5851F42D4C957F2D))).view(np.int64)))
                bands.append(band_keys(signature(s)).view(np.int64))
            else:
                fa.append(0)
                fb.append(0)
                bands.append(np.zeros(0, dtype=np.int64))
        off = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(fa, pa.int64()),
             pa.array(fb, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
            schema=schema)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), width)]
        off = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
            names=["doc_id", "hashes"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, component)``: smallest node reachable, for every node of ``edges(a, b)``.

    Min-label passes with pointer jumping as joins and grouped minima; labels
    stay distributed and each pass is written to the shared folder.
    """
    both = table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    n = both.count()
    label = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")),
                  f"{name}-label", n)
    for _ in range(MAX_PASSES):
        # a node takes its neighbours' smallest label, then that label's own label
        near = id_side(label.select(F.col("node").alias("b"), F.col("component").alias("near")))
        lowest = both.join(near, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("next"))
        jump = id_side(label.select(F.col("node").alias("next"), F.col("component").alias("root")))
        was = id_side(label.withColumnRenamed("component", "_was"))
        new = table(lowest.join(was, "node").withColumn("next", F.least("next", "_was")).join(jump, "next", "left")
                          .select("node", F.least("next", F.coalesce("root", "next")).alias("component"), "_was"),
                    f"{name}-label", n)
        moved = new.where(F.col("component") != F.col("_was")).limit(1).count()
        label = new.drop("_was")
        if not moved:
            return label
    raise RuntimeError("component labels did not settle")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Documents are linked when 100 * |A and B| >= percent * |A or B| on their
    shingle sets; ``component_id`` is the smallest doc_id reachable over links.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = table(text.mapInArrow(functools.partial(_nodes, width=width), _NODE), "near-nodes")
    fingerprint = ["set_a", "set_b", "n_shingles"]
    shaped = nodes.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = table(shaped.groupBy(*fingerprint)
                          .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "near-classes")

    rows = classes.select("rep", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    member = table(rows.join(shared, "bucket"), "near-buckets")
    n = member.count()
    hub = table(member.groupBy("rep").agg(F.sum("members").alias("hub")), "near-hubs", n)
    member = table(member.join(id_side(hub), "rep").select("bucket", "rep", "size", "hub"), "near-members", n)

    candidate = member.select(F.col("rep").alias("doc_id")).distinct()
    sets = table(text.join(id_side(candidate), "doc_id", "left_semi")
                     .mapInArrow(functools.partial(_sets, width=width), "doc_id long, hashes array<long>"), "near-sets")
    component = _contract(member, n, sets, percent)

    of_class = classes.select(*fingerprint, "rep").join(id_side(component), F.col("rep") == F.col("node"), "left")
    of_class = of_class.select(*fingerprint, F.coalesce("component", "rep").alias("component_id"))
    found = shaped.select("doc_id", *fingerprint).join(of_class, fingerprint).select(
        "doc_id", "n_shingles", "component_id")
    if nodes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        # rows that repeat a doc_id are one document
        low = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        found = found.drop("component_id").join(low, "doc_id")
    alone = nodes.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _contract(member: DataFrame, n: int, sets: DataFrame, percent: int) -> DataFrame:
    """Star rounds: propose, confirm on full sets, contract; ``(node, component)``.

    ``n``: rows of ``member``, a bound on the pairs of one star a bucket.
    """
    spark = member.sparkSession
    links, tested = None, None
    component = spark.createDataFrame([], "node long, component long")
    turn = 0
    while True:
        now = member.join(id_side(component), F.col("rep") == F.col("node"), "left").select(
            "bucket", "rep", "size", "hub", F.coalesce("component", "rep").alias("comp"))
        who = F.struct("rep", "size", "comp")
        centre = now.groupBy("bucket").agg(
            F.max(F.struct("hub", -F.col("rep"), who)).alias("c"),
            F.max(F.struct(F.xxhash64("bucket", "rep"), "rep", who)).alias("d"),
            F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        # the first turn has one star a bucket, later turns a second one around a hashed pick
        picks = [F.col("c.col3")] if turn == 0 else [F.col("c.col3"), F.col("d.col3")]
        centre = (centre.select("bucket", F.explode(F.array_distinct(F.array(*picks))).alias("c"))
                        .select("bucket", F.col("c.rep").alias("centre"), F.col("c.size").alias("centre_size"),
                                F.col("c.comp").alias("centre_comp")))
        centre = table(centre, "near-centres", n)
        near_size = 100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size")
        star = (now.join(id_side(centre), "bucket")
                   .where((F.col("comp") != F.col("centre_comp")) & near_size)
                   .groupBy(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
                   .agg(F.count("*").alias("met"), F.first("rep").alias("rep")))
        if tested is not None:
            star = star.join(id_side(tested), ["a", "b"], "left_anti")
        if turn == 0:
            # first only each document's most frequent centre: most links need one test
            best = star.groupBy("rep").agg(F.max(F.struct("met", "a", "b")).alias("m"))
            star = best.select("m.a", "m.b").distinct()
        star = table(star.select("a", "b"), "near-edges", 2 * n)
        if turn > 0 and not star.limit(1).count():
            break
        new = _confirmed(star, sets, percent, 2 * n)
        found = new.limit(1).count()
        if turn > 1 and not found:
            break
        if found:
            links = new if links is None else links.unionByName(new)
            component = components(links, "near-comp")
        tested = star if tested is None else tested.unionByName(star)
        if turn > 0:                       # the centres of this turn have met all their buckets
            used = centre.select("bucket", F.col("centre").alias("rep"))
            member = table(member.join(id_side(used), ["bucket", "rep"], "left_anti"), "near-members", n)
        turn += 1
    star = _swept(member, component, sets, percent)
    if tested is not None:
        star = star.join(id_side(tested), ["a", "b"], "left_anti")
    star = table(star, "near-swept")
    if star.limit(1).count():
        new = _confirmed(star, sets, percent)
        if new.limit(1).count():
            component = components(new if links is None else links.unionByName(new), "near-comp")
    return component


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, rows: int | None = None) -> DataFrame:
    """The ``pairs(a, b)`` that are similar enough on their full sets."""
    met = (sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hashes_b")).join(id_side(pairs), "b")
               .join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("hashes_a")), "a")
               .withColumn("both", F.size(F.array_intersect("hashes_a", "hashes_b"))))
    either = F.size("hashes_a") + F.size("hashes_b") - F.col("both")
    return table(met.where(100 * F.col("both") >= percent * either).select("a", "b"), "near-links", rows)


def parity_bits(hashes: np.ndarray) -> bytes:
    """Which of ``BITS`` parts of the hash range hold an odd number of the hashes."""
    part = (hashes >> U64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(part, minlength=BITS).astype(np.uint8) & 1).tobytes()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column("hashes")
        bits = [parity_bits(hashes[i].values.to_numpy().view(np.uint64)) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(bits, pa.binary())], names=["rep", "bits"])


def _block_pairs(rep: np.ndarray, size: np.ndarray, comp: np.ndarray, right: np.ndarray, bits: np.ndarray,
                 percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the left with the right rows (of all rows, if none is right) that may be similar enough."""
    left = np.flatnonzero(~right)
    other = np.flatnonzero(right)
    a, b = [], []
    for n, i in enumerate(left):
        j = other if len(other) else left[n + 1:]
        near = (comp[j] != comp[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))
        j = j[near]
        differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        j = j[differ * (100 + percent) <= (size[j] + size[i]) * (100 - percent)]
        a.append(np.minimum(rep[i], rep[j]))
        b.append(np.maximum(rep[i], rep[j]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _sweep(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell; a cell is a pair of blocks, or a block with itself."""
    held = None
    for batch in _then_none(batches):
        if batch is not None:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "cell", "rep", "size", "comp", "right")}
            flat = b"".join(batch.column("bits").to_pylist())
            new["bits"] = np.frombuffer(flat, dtype=np.uint64).reshape(batch.num_rows, -1)
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
        if held is None:
            return
        ends = np.flatnonzero((held["bucket"][1:] != held["bucket"][:-1]) | (held["cell"][1:] != held["cell"][:-1])) + 1
        cuts = [0, *ends.tolist()] + ([len(held["rep"])] if batch is None else [])
        found = [_block_pairs(*[held[c][lo:hi] for c in ("rep", "size", "comp", "right", "bits")], percent)
                 for lo, hi in zip(cuts, cuts[1:])]
        held = {c: held[c][cuts[-1]:] for c in held}          # the last cell may go on in the next batch
        if found:
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _swept(member: DataFrame, component: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of different components in a bucket of ``member`` whose bitmaps allow a link."""
    now = member.join(id_side(component), F.col("rep") == F.col("node"), "left").select(
        "bucket", "rep", "size", F.coalesce("component", "rep").alias("comp"))
    parts = now.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    live = parts.groupBy("bucket").agg(F.sum("n").alias("members"), F.max(F.struct("n", "comp")).alias("big"),
                                       F.count("*").alias("parts")).where("parts > 1")
    live = table(live.select("bucket", F.col("big.comp").alias("big"),
                             F.ceil((F.col("members") - F.col("big.n")) / BLOCK).alias("others"),
                             F.ceil(F.col("big.n") / BLOCK).alias("bigs")), "near-live")
    now = table(now.join(id_side(live), "bucket"), "near-open")
    bits = sets.select(F.col("doc_id").alias("rep"), "hashes").join(
        id_side(now.select("rep").distinct()), "rep", "left_semi").mapInArrow(_bitmaps, "rep long, bits binary")
    # blocks of the other components come first, then those of the largest
    place = F.when(F.col("comp") != F.col("big"), F.pmod(F.xxhash64("rep"), F.col("others"))).otherwise(
        F.col("others") + F.pmod(F.xxhash64("rep"), F.col("bigs")))
    now = now.withColumn("x", place).withColumn("blocks", F.col("others") + F.col("bigs"))
    last = F.when(F.col("x") < F.col("others"), F.col("blocks") - 1).otherwise(F.col("others") - 1)
    cells = now.join(bits, "rep").withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    cells = cells.select("bucket", (F.least("x", "y") * F.col("blocks") + F.greatest("x", "y")).alias("cell"),
                         "rep", "size", "comp", (F.col("x") > F.col("y")).alias("right"), "bits")
    return (cells.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
                 .mapInArrow(functools.partial(_sweep, percent=percent), "a long, b long").distinct())
