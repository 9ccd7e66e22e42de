"""Hard-negative mining with Fagin's threshold algorithm (operator 12).

Vectors become integers, ``floor(scale * x)``; scores are integer inner
products. An anchor's positives are its best rows of the same label. For each
positive, its hard negatives are the best rows of other labels whose score
lies in a window below the positive's.

Rows are sorted by label and id and cut into shards of ``SHARD_ROWS`` rows, so
a label, also one that holds a third of all rows, fills a few shards of its
own. A shard is one list of rows per dimension, sorted by that component. For an
anchor the lists are read from the top where its component is positive, from
the bottom where it is negative, ``DEPTH`` rows of every list at a time; rows met
for the first time get their whole integer score by random access. What no list
has shown yet scores at most the threshold, the sum over dimensions of the
anchor's component times the value reached. Reading ends once the threshold
falls strictly below the k-th score of every window (so a tie with a smaller id
is never missed) or below the window.

Two rounds: anchors go to the shards that hold their label and bring back
positives; then, with their windows, to every shard. The best of each shard
are merged. Rows and the anchors sent to a shard come sorted into one task:
memory is one shard and one batch of anchors. Anchors meet shards by a list of
shard numbers, never by a cross join.

Defined cases: rows with a null id, label or vector, an empty vector, or any
null or non-finite component take no part. An anchor meets only vectors of its
own length. A repeated anchor id asks once a label, with its smallest vector;
every repeated row is a candidate, except for an anchor of its own id. Fewer
rows than wanted: all are returned. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockspark.llm.balltree import matrix
from stockspark.llm.common import table
from stockspark.operators.listing import number_rows

SHARD_ROWS = 4_096        # at most; the shards of a vector length have equal sizes
DEPTH = 64                # rows read of every list before the threshold is looked at again

_SENT = "shard long, kind int, id long, label long, vec array<long>, windows array<struct<low:long,high:long>>"
_HIT = "anchor_id long, anchor_label long, window int, vec_id long, score long"


class Lists:
    """One shard: per-dimension sorted lists for sorted access, rows for random access."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels = ids, labels
        exact = float(np.abs(rows).max(initial=0)) ** 2 * max(1, rows.shape[1]) < 2.0 ** 50
        self.rows = rows.astype(np.float64) if exact else rows          # float64 sums are exact below 2^53
        self.order = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32, order="C")
        self.sorted = np.take_along_axis(rows.T, self.order, axis=1)

    def search(self, own: int, label: int, q: np.ndarray, k: int, same: bool, windows: list[tuple[int, int]]
               ) -> list[tuple[int, int, int]]:
        """``(window, id, score)``: the k best of each window; rows of the same or of other labels."""
        n = len(self.ids)
        big = float(np.abs(q).max(initial=0)) ** 2 * len(q) >= 2.0 ** 50
        rows, y = ((self.rows, q.astype(np.float64)) if self.rows.dtype == np.float64 and not big
                   else (self.rows.astype(np.int64), q))
        allowed = ((self.labels == label) == same) & (self.ids != own)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        unseen = np.ones(n, dtype=bool)
        best: list[list[tuple[int, int]]] = [[] for _ in windows]       # (-score, id), best first
        open_ = [w for w, (low, high) in enumerate(windows) if low <= high]
        depth = 0
        while open_ and depth < n:
            end = min(depth + DEPTH, n)
            met = np.zeros(n, dtype=bool)
            met[self.order[up, n - end:n - depth]] = True
            met[self.order[down, depth:end]] = True
            if not len(up) and not len(down):
                met[:] = True                                           # a zero anchor: all score 0
                end = n
            met &= unseen
            unseen &= ~met
            at = np.flatnonzero(met & allowed)
            scores = rows[at] @ y
            for w in open_:
                low, high = windows[w]
                floor = -best[w][-1][0] if len(best[w]) == k else low
                take = np.flatnonzero((scores >= max(low, floor)) & (scores <= high))
                if len(take):
                    s, i = scores[take].astype(np.int64), self.ids[at[take]]
                    top = np.lexsort((i, -s))[:k]
                    best[w] = sorted(best[w] + [(-int(s[t]), int(i[t])) for t in top])[:k]
            depth = end
            threshold = (int(q[up] @ self.sorted[up, n - depth]) + int(q[down] @ self.sorted[down, depth - 1]))
            open_ = [w for w in open_ if not threshold < windows[w][0]
                     and not (len(best[w]) == k and threshold < -best[w][-1][0])]
        return [(w, i, -s) for w, hits in enumerate(best) for s, i in hits]


def _search(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Sorted by shard, its rows (kind 0) before the anchors sent to it (kind 1)."""
    now, held, lists = None, [], None
    for batch in batches:
        shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
        found: list[tuple[int, int, int, int, int]] = []
        for a, b in zip([0, *cuts], [*cuts, len(shard)]):
            if a == b:
                continue
            if shard[a] != now:
                now, held, lists = shard[a], [], None
            part = batch.slice(a, b - a)
            ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
            vec = matrix(part.column("vec"))
            if kind[a] == 0:
                held.append((ids, labels, vec))
                continue
            if lists is None and held:
                lists, held = Lists(*(np.concatenate(x) for x in zip(*held))), []
            if lists is None:
                continue
            windows = part.column("windows").to_pylist()
            for i in range(len(ids)):
                w = [(x["low"], x["high"]) for x in windows[i]]
                hits = lists.search(int(ids[i]), int(labels[i]), vec[i], k, same, w)
                found += [(int(ids[i]), int(labels[i]), *h) for h in hits]
        columns = list(zip(*found)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32() if name == "window" else pa.int64())
             for c, name in zip(columns, ("anchor_id", "anchor_label", "window", "vec_id", "score"))],
            names=["anchor_id", "anchor_label", "window", "vec_id", "score"])


def labelled_vectors(df: DataFrame, scale: int) -> DataFrame:
    """``id, label, vec`` of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall("_x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (df.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("_x"))
              .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("_x") > 0) & finite)
              .select("id", "label", F.transform("_x", lambda e: F.floor(e * F.lit(float(scale)))).alias("vec")))


def _run(rows: DataFrame, sent: DataFrame, shards: int, k: int, same: bool) -> DataFrame:
    none = F.lit(None).cast("array<struct<low:long,high:long>>")
    both = rows.select("shard", F.lit(0).alias("kind"), "id", "label", "vec", none.alias("windows")).unionByName(
        sent.select("shard", F.lit(1).alias("kind"), "id", "label", "vec", "windows"))
    return (both.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "kind", "id")
                .mapInArrow(functools.partial(_search, k=k, same=same), _HIT))


def hard_negatives(embeddings: DataFrame, scale: int = 256, every: int = 50, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of every anchor (``vec_id`` divisible by ``every``) of ``embeddings(vec_id, label, embedding)``.

    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for
    each of an anchor's best ``positives`` rows of its label the best ``negatives`` rows of
    other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    vectors = labelled_vectors(embeddings, scale).withColumn("dim", F.size("vec"))
    placed = number_rows(vectors, ["dim", "label", "id", "vec"], "_place")
    # a shard holds vectors of one length: lengths are dealt to shard numbers of their own
    first = placed.groupBy("dim").agg(F.min("_place").alias("_first"), F.max("_place").alias("_last"))
    lengths = sorted((r.dim, r._first, r._last) for r in first.collect())      # one row a vector length
    spark, begin, parts = embeddings.sparkSession, 0, []
    for dim, a, b in lengths:
        n = (b - a) // SHARD_ROWS + 1
        parts.append((dim, a, -(-(b - a + 1) // n), begin, begin + n))
        begin += n
    parts = spark.createDataFrame(parts, "dim int, _first long, _size long, _from long, _to long")
    rows = placed.join(F.broadcast(parts), "dim").select(
        "dim", (F.col("_from") + F.floor((F.col("_place") - F.col("_first")) / F.col("_size"))).alias("shard"),
        "id", "label", "vec", "_from", "_to")
    rows = table(rows, "negative-shards")

    asks = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id", "label").agg(
        F.min(F.struct("vec", "dim", "_from", "_to")).alias("a")).select("id", "label", "a.*")
    anchors = table(asks, "negative-anchors")

    whole = F.array(F.struct(F.lit(-2 ** 62).alias("low"), F.lit(2 ** 62).alias("high")))
    home = rows.select("dim", "label", "shard").distinct()
    own = anchors.join(home, ["dim", "label"]).select("shard", "id", "label", "vec", whole.alias("windows"))
    near = _run(rows, own, begin, positives, same=True)
    best = Window.partitionBy("anchor_id", "anchor_label").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("window", F.row_number().over(best)).where(F.col("window") <= positives)
    near = table(near.select(F.col("anchor_id").alias("id"), F.col("anchor_label").alias("label"),
                             (F.col("window") - 1).alias("window"), F.col("vec_id").alias("positive_id"),
                             F.col("score").alias("positive_score")), "negative-positives")

    p = F.col("positive_score")
    window = F.struct(F.ceil(p * low / 100.0).alias("low"), F.floor(p * high / 100.0).alias("high"))
    asked = near.select("id", "label", "window", window.alias("w")).groupBy("id", "label").agg(
        F.sort_array(F.collect_list(F.struct("window", "w"))).alias("_w"))         # at most ``positives`` a row
    sent = anchors.join(asked, ["id", "label"]).select(
        F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("shard"), "id", "label", "vec",
        F.transform("_w", lambda x: x["w"]).alias("windows"))
    found = _run(rows, sent, begin, negatives, same=False)
    best = Window.partitionBy("anchor_id", "anchor_label", "window").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    found = found.select(F.col("anchor_id").alias("id"), F.col("anchor_label").alias("label"), "window", "rank",
                         F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["id", "label", "window"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score")


def relabelled(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` with the label shifted where the id is divisible by 7."""
    label = F.col("label").cast("long")
    return embeddings.select("vec_id", "embedding", F.when(F.pmod(F.col("vec_id").cast("long"), F.lit(7)) == 0,
                                                           (label + 1) % 10).otherwise(label).alias("label"))


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 50 = 0),
positive as (
  select anchor_id, vec_id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from scored where same) t
  where n <= 5),
ranked as (
  select p.anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
         row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank
  from positive p join scored s on s.anchor_id = p.anchor_id and not s.same
   and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 3
"""
