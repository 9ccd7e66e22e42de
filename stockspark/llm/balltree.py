"""Exact top-k inner-product search with ball trees (operator 4).

Vectors become integers, ``floor(1024 * x)`` for every component. They are
dealt into shards of at most about ``SHARD_ROWS`` rows by the nearest of a few
pivots, large pivots (say, one vector repeated many times) into several shards
by id hash. A shard is a ball tree: median splits along the widest dimension,
each node a ball with its centre, radius and smallest id.

Search is branch and bound: the inner product with anything in a ball is at
most ``q . centre + |q| * radius``; nodes are opened from the highest bound
down, and none is opened that cannot hold something better than the current
k-th hit. First every query searches its own shard; that k-th score is then
shared: it leaves out whole shards by the bound of their ball and is where the
search in the others starts. Results are exact, ties go to the smaller id.

A shard's rows and the queries sent to it come sorted into one task: the tree
is built from the rows, then queries are answered batch by batch, so memory is
one shard and one batch. Only the shards' balls are broadcast, at most
``MAX_SHARDS`` of them; with more rows shards grow instead.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component, and rows with a null id take no part. A query meets only vectors of
its own length. A repeated query id asks once, with its smallest vector; every
repeated row is a candidate. Fewer candidates than k: all are returned. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockspark.llm.common import table

SHARD_ROWS = 16_384
MAX_SHARDS = 16_384
PIVOTS = 64               # sampled vectors that deal rows into shards
LEAF = 96
SLACK = 1e-9              # relative, for rounding of centres and radii

_ROW = "dim int, shard int, kind int, id long, vec array<long>, floor_score long, floor_id long"
_HIT = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, scale: int = 1024) -> DataFrame:
    """``id, vec`` of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall("_x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (df.select(F.col("vec_id").cast("long").alias("id"), x.alias("_x"))
              .where(F.col("id").isNotNull() & (F.size("_x") > 0) & finite)
              .select("id", F.transform("_x", lambda e: F.floor(e * F.lit(float(scale)))).alias("vec")))


def matrix(col: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a two-dimensional array."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


class BallTree:
    """Nodes as arrays; children of a node are ``2 * i + 1`` and ``2 * i + 2``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        levels = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
        self.first_leaf = (1 << levels) - 1
        n = (1 << (levels + 1)) - 1
        exact = float(np.abs(rows).max(initial=0)) ** 2 * rows.shape[1] < 2.0 ** 50
        self.kind = np.float64 if exact else np.int64     # float64 sums are exact below 2^53
        as_float = rows.astype(np.float64)
        self.lo, self.hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.centre, self.radius = np.zeros((n, rows.shape[1])), np.zeros(n)
        self.min_id = np.full(n, np.iinfo(np.int64).max)
        self.hi[0] = len(ids)
        for i in range(n):
            lo, hi = self.lo[i], self.hi[i]
            part = order[lo:hi]
            if len(part):
                x = as_float[part]
                self.centre[i] = x.mean(axis=0)
                self.radius[i] = np.sqrt(((x - self.centre[i]) ** 2).sum(axis=1).max())
                self.min_id[i] = ids[part].min()
            if i < self.first_leaf:
                mid = (lo + hi) // 2
                if len(part) > 1:
                    axis = x.var(axis=0).argmax()
                    order[lo:hi] = part[np.argpartition(x[:, axis], mid - lo)]
                for child, a, b in ((2 * i + 1, lo, mid), (2 * i + 2, mid, hi)):
                    self.lo[child], self.hi[child] = a, b
        self.ids, self.rows = ids[order], rows[order].astype(self.kind)

    def search(self, query_id: int, q: np.ndarray, k: int, floor: tuple[int, int] | None
               ) -> list[tuple[int, int]]:
        """The k best ``(score, id)`` that are better than ``floor``, exact."""
        x = q.astype(np.float64)
        bounds = self.centre @ x + np.sqrt(x @ x) * self.radius
        bounds += SLACK * (1.0 + np.abs(bounds) + np.sqrt(x @ x))
        big = float(np.abs(x).max(initial=0)) ** 2 * len(x) >= 2.0 ** 50
        rows, y = (self.rows, x) if self.kind is np.float64 and not big else (self.rows.astype(np.int64), q)
        best: list[tuple[int, int]] = []                  # a heap of (score, -id), worst first
        worst = (floor[0], -floor[1]) if floor is not None else None
        heap = [(-bounds[0], 0)]
        while heap:
            bound, i = heapq.heappop(heap)
            if self.hi[i] == self.lo[i]:
                continue
            if worst is not None:
                if -bound < worst[0]:
                    break
                if -bound < worst[0] + 1 and self.min_id[i] > -worst[1]:
                    continue                              # could only tie, with larger ids
            if i < self.first_leaf:
                heapq.heappush(heap, (-bounds[2 * i + 1], 2 * i + 1))
                heapq.heappush(heap, (-bounds[2 * i + 2], 2 * i + 2))
                continue
            part = slice(self.lo[i], self.hi[i])
            scores, ids = rows[part] @ y, self.ids[part]
            keep = ids != query_id
            if worst is not None:
                keep &= scores >= worst[0]
            for s, d in zip(scores[keep].tolist(), ids[keep].tolist()):
                hit = (int(s), -d)
                if worst is not None and hit <= worst:
                    continue
                if len(best) < k:
                    heapq.heappush(best, hit)
                else:
                    heapq.heapreplace(best, hit)
                if len(best) == k and (worst is None or best[0] > worst):
                    worst = best[0]
        return [(s, -d) for s, d in best]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, candidates (kind 0) before queries (kind 1)."""
    now, ids, rows, tree = None, [], [], None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "kind")], axis=1)
        cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1 if len(key) else []
        found: list[tuple[int, int, int]] = []
        for a, b in zip([0, *cuts], [*cuts, len(key)]):
            if a == b:
                continue
            shard, part = tuple(key[a][:2]), batch.slice(a, b - a)
            if shard != now:
                now, ids, rows, tree = shard, [], [], None
            vec, id_ = matrix(part.column("vec")), part.column("id").to_numpy()
            if key[a][2] == 0:
                ids.append(id_)
                rows.append(vec)
                continue
            if tree is None and ids:
                tree = BallTree(np.concatenate(ids), np.concatenate(rows))
                ids, rows = [], []
            if tree is None:
                continue
            floor_score, floor_id = part.column("floor_score").to_pylist(), part.column("floor_id").to_pylist()
            for i in range(len(id_)):
                floor = None if floor_score[i] is None else (floor_score[i], floor_id[i])
                q = int(id_[i])
                found += [(q, d, s) for s, d in tree.search(q, vec[i], k, floor)]
        columns = list(zip(*found)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                         names=["query_id", "vec_id", "score"])


def _nearest_pivot(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        pivot = np.zeros(len(dims), dtype=np.int32)
        for d in np.unique(dims).tolist():
            if d in pivots:
                at = np.flatnonzero(dims == d)
                x = matrix(batch.column("vec").take(pa.array(at))).astype(np.float64)
                p = pivots[d]
                pivot[at] = ((p * p).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("id"), batch.column("vec"),
                                          pa.array(pivot)], names=["dim", "id", "vec", "pivot"])


def _reachable(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Send each query to the other shards whose ball may hold something better."""
    for batch in batches:
        out = {c: [] for c in ("dim", "shard", "row")}
        floor_score = batch.column("floor_score").to_pylist()
        dims, home = batch.column("dim").to_pylist(), batch.column("shard").to_pylist()
        for i in range(batch.num_rows):
            shards, centre, radius = shared.value[dims[i]]
            x = np.asarray(batch.column("vec")[i].as_py(), dtype=np.float64)
            bound = centre @ x + np.sqrt(x @ x) * radius
            bound += SLACK * (1.0 + np.abs(bound) + np.sqrt(x @ x))
            go = shards != home[i]
            if floor_score[i] is not None:
                go &= bound >= floor_score[i]
            out["shard"] += shards[go].tolist()
            out["row"] += [i] * int(go.sum())
        row = pa.array(out["row"], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("dim").take(row), pa.array(out["shard"], pa.int32()),
             pa.array(np.ones(len(row), dtype=np.int32)), batch.column("id").take(row), batch.column("vec").take(row),
             batch.column("floor_score").take(row), batch.column("floor_id").take(row)],
            names=["dim", "shard", "kind", "id", "vec", "floor_score", "floor_id"])


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per shard of a batch, for centres."""
    for batch in batches:
        dims, shards = batch.column("dim").to_numpy(), batch.column("shard").to_numpy()
        rows = []
        for d, s in sorted(set(zip(dims.tolist(), shards.tolist()))):
            at = pa.array(np.flatnonzero((dims == d) & (shards == s)))
            x = matrix(batch.column("vec").take(at)).astype(np.float64)
            rows.append((d, s, len(x), x.sum(axis=0)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.float64()))],
            names=["dim", "shard", "n", "total"])


def _radii(batches: Iterator[pa.RecordBatch], centres) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims, shards = batch.column("dim").to_pylist(), batch.column("shard").to_pylist()
        far: dict[tuple[int, int], float] = {}
        for i, key in enumerate(zip(dims, shards)):
            x = np.asarray(batch.column("vec")[i].values, dtype=np.float64)
            r = float(np.sqrt(((x - centres.value[key]) ** 2).sum()))
            far[key] = max(far.get(key, 0.0), r)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in far], pa.int32()), pa.array([k[1] for k in far], pa.int32()),
             pa.array(list(far.values()), pa.float64())], names=["dim", "shard", "radius"])


def _shards(vectors: DataFrame) -> DataFrame:
    """``dim, shard, id, vec``: rows dealt by nearest pivot, large pivots split by id hash."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("dim", F.size("vec"))
    size = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}
    per_shard = max(SHARD_ROWS, -(-sum(size.values()) // (MAX_SHARDS // 2)))
    pivots: dict[int, np.ndarray] = {}
    for d, n in size.items():
        want = min(PIVOTS, -(-n // per_shard))
        if want > 1:
            picked = rows.where(F.col("dim") == d).orderBy(F.xxhash64("id"), "id").limit(want).collect()
            pivots[d] = np.array([r.vec for r in picked], dtype=np.float64)
    dealt = table(rows.select("dim", "id", "vec").mapInArrow(
        functools.partial(_nearest_pivot, pivots=pivots), "dim int, id long, vec array<long>, pivot int"), "ball-dealt")
    first, parts = 0, []
    for r in dealt.groupBy("dim", "pivot").count().orderBy("dim", "pivot").collect():
        split = -(-r["count"] // per_shard)
        parts.append((r.dim, r.pivot, first, split))
        first += split
    parts = spark.createDataFrame(parts, "dim int, pivot int, first int, split int")
    shard = F.col("first") + F.pmod(F.xxhash64("id", "vec"), F.col("split")).cast("int")
    return table(dealt.join(F.broadcast(parts), ["dim", "pivot"]).select("dim", shard.alias("shard"), "id", "vec"),
                 "ball-shards")


def _run(candidates: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    none = F.lit(None).cast("long")
    rows = candidates.select("dim", "shard", F.lit(0).alias("kind"), "id", "vec",
                             none.alias("floor_score"), none.alias("floor_id"))
    both = rows.unionByName(queries.select(*rows.columns))
    return (both.repartition(max(1, shards), "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "id")
                .mapInArrow(functools.partial(_search, k=k), _HIT))


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vec_id divisible by ``every`` its k best others."""
    spark = embeddings.sparkSession
    candidates = _shards(integer_vectors(embeddings))
    query_rows = candidates.where(F.pmod("id", F.lit(every)) == 0)
    query_rows = query_rows.groupBy("id").agg(F.min(F.struct("vec", "dim", "shard")).alias("q"))
    queries = table(query_rows.select("q.dim", "q.shard", "id", "q.vec"), "ball-queries")

    sums = candidates.mapInArrow(_balls, "dim int, shard int, n long, total array<double>")
    # one row of a few hundred numbers a shard, at most MAX_SHARDS of them
    totals = sums.select("dim", "shard", "n", F.posexplode("total").alias("at", "x"))
    totals = totals.groupBy("dim", "shard", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    mean: dict[tuple[int, int], np.ndarray] = {}
    for r in totals.collect():
        mean.setdefault((r.dim, r.shard), np.zeros(r.dim))[r.at] = r.x
    shards = len(mean)
    shared_mean = spark.sparkContext.broadcast(mean)
    radius = candidates.mapInArrow(functools.partial(_radii, centres=shared_mean), "dim int, shard int, radius double")
    balls: dict[int, list] = {}
    for r in radius.groupBy("dim", "shard").agg(F.max("radius").alias("radius")).collect():
        balls.setdefault(r.dim, []).append((r.shard, mean[(r.dim, r.shard)], r.radius))
    balls = {d: (np.array([b[0] for b in x]), np.array([b[1] for b in x]), np.array([b[2] for b in x]))
             for d, x in balls.items()}
    shared = spark.sparkContext.broadcast(balls)

    none = F.lit(None).cast("long")
    own = queries.select("dim", "shard", F.lit(1).alias("kind"), "id", "vec",
                         none.alias("floor_score"), none.alias("floor_id"))
    near = table(_run(candidates, own, shards, k), "ball-near")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
               .select(F.col("query_id").alias("id"), F.col("score").alias("floor_score"),
                       F.col("vec_id").alias("floor_id")))
    sent = queries.join(kth, "id", "left").select("dim", "shard", F.lit(1).alias("kind"), "id", "vec",
                                                  "floor_score", "floor_id")
    sent = sent.mapInArrow(functools.partial(_reachable, shared=shared), _ROW)
    hits = near.unionByName(_run(candidates, sent, shards, k))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 100 = 0),
ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
  from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
