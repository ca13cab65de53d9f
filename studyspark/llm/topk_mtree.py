"""Exact top-k search by inner product over M-trees.

An M-tree needs a metric.  Integer vectors are lifted by one coordinate,
sqrt(M^2 - |x|^2) with M the largest norm in the tree; a lifted vector and a query
(lifted by 0) then lie at distance sqrt(|q|^2 + M^2 - 2 q.x), so the nearest are those
with the largest inner products, and ties stay ties.

Vectors are dealt to the buckets of their nearest pivots, as many as trees are needed
and ``most_pivots`` at most; a bucket with more rows than a tree holds is split into trees
by a hash.  Pages of a tree hold routing entries (pivot, covering radius, distance to the
parent's pivot, child) or objects (vector, id, distance to the page's pivot).  A search
keeps a queue of pages by their least possible distance and stops when that exceeds the
k-th best.  Within a page the stored parent distances skip entries before any distance is
computed: |d(q, parent) - d(entry, parent)| - radius is a lower bound.  Bounds are
compared with slack, final scores are exact integers.

Buckets are searched best-first as well, in two rounds: a query goes to one tree of the
bucket whose pivot suits it best; with the k-th score found there as a floor it goes on to
the other trees, of those buckets whose pivot and radius let them beat or tie it.  A tree
meets its queries in blocks, one task for each; tree and block sizes grow with the tables
to fixed bounds, so a tree is sent as often as its queries fill blocks.  A window whose
limit Spark applies before the shuffle merges what the trees found.

Where vectors lie evenly in many dimensions, as on a sphere, no bound beats the floor:
every query then reads every vector, and the cost is that of comparing all.

Edge cases: vectors null or with null or non-finite components, and rows with a null
id, take no part; vectors of another length than the query's are no candidates; a
query with fewer candidates than k returns them all; ties go to smaller ids; scores beyond 64 bits
saturate (their order stays exact); repeated rows of one id are each a candidate of other ids' queries, and an id's own query is
its smallest vector; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, written

#: Relative slack of distance bounds: far above rounding, far below the gap between integer scores that matter.
_SLACK = 1e-7


def _matrix(rows: list[list[int]]) -> np.ndarray:
    """float64 where every inner product is exact in it, else Python integers."""
    largest = max((abs(x) for r in rows for x in (min(r, default=0), max(r, default=0))), default=0)
    exact = largest * largest * max(len(rows[0]), 1) * 4 < 1 << 52 if rows else True
    return np.array(rows, np.float64 if exact else object).reshape(len(rows), -1)


class MTree:
    """Pages over lifted vectors; built top-down, so that a page's objects share its pivot's neighbourhood."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = 768, fanout: int = 24, seed: int = 3):
        self.ids, self.vectors = ids, vectors
        norms = (vectors * vectors).sum(axis=1)
        self.top = max(norms, default=0)
        self.lift = np.sqrt(np.maximum((self.top - norms).astype(np.float64), 0))
        self.flat = vectors.astype(np.float64)
        self.pages: list[tuple] = []
        self._rng = np.random.default_rng(seed)
        self.page, self.fanout = page, fanout
        self.computed = 0  # distances and scores that searches have computed
        self._laid: list[np.ndarray] = []
        self.root = self._build(np.arange(len(ids)), 0) if len(ids) else None
        if len(ids):  # objects in the order of the leaves: a whole page is a slice
            order = np.concatenate(self._laid)
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            self.first = int(place[0])  # the root's pivot
            self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
            self.pages = [p if p[0] == "leaf" else ("inner", place[p[1]], *p[2:]) for p in self.pages]
        del self._laid, self.flat, self.lift

    def between(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Distances of lifted object i to lifted objects."""
        d = self.flat[rows] - self.flat[i]
        return np.sqrt((d * d).sum(axis=1) + (self.lift[rows] - self.lift[i]) ** 2)

    def _build(self, rows: np.ndarray, pivot: int) -> int:
        """The number of the page that holds ``rows``, with distances to ``pivot``."""
        if len(rows) <= self.page:
            start = sum(map(len, self._laid))
            self._laid.append(rows)
            self.pages.append(("leaf", slice(start, start + len(rows)), self.between(pivot, rows)))
            return len(self.pages) - 1
        few = -(-2 * len(rows) // self.page)  # as many as half-full pages need
        pivots = self._rng.choice(rows, min(self.fanout, few), replace=False)
        near = np.stack([self.between(p, rows) for p in pivots])
        owner = near.argmin(axis=0)
        full = np.bincount(owner, minlength=len(pivots))
        if full.max() == len(rows):  # copies of one point: any even cut will do
            owner = np.arange(len(rows)) % len(pivots)
        entries = []
        for j, p in enumerate(pivots):
            mine = owner == j
            if mine.any():
                entries.append((p, near[j][mine].max(), self._build(rows[mine], p)))
        p, radius, child = (np.array(x) for x in zip(*entries, strict=True))
        self.pages.append(("inner", p, self.between(pivot, p), radius, child))
        return len(self.pages) - 1

    def search(self, query: np.ndarray, own_id: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), largest scores first, ties to smaller ids; with ``floor`` only those that reach it."""
        if self.root is None:
            return []
        qq = (query * query).sum()
        base = qq + self.top  # squared distance = base - 2 * score
        slack = _SLACK * (1 + float(base) ** 0.5)

        def far(score) -> float:
            return float(max(base - 2 * score, 0)) ** 0.5

        best_s, best_i = np.empty(0, query.dtype), np.empty(0, np.int64)
        limit = np.inf if floor is None else far(floor)
        at_root = far((self.vectors[self.first] * query).sum())
        queue = [(0.0, self.root, at_root)]
        while queue:
            low, number, to_pivot = heapq.heappop(queue)
            if low > limit + slack:
                break
            page = self.pages[number]
            rows, to_parent = page[1], page[2]
            reach = np.abs(to_pivot - to_parent)  # triangle inequality, without computing a distance
            if page[0] == "leaf":
                near = reach <= limit + slack
                if near.all():
                    scores, ids = self.vectors[rows] @ query, self.ids[rows]
                else:
                    chosen = rows.start + np.flatnonzero(near)
                    scores, ids = self.vectors[chosen] @ query, self.ids[chosen]
                self.computed += len(scores)
                least = best_s[-1] if len(best_s) == k else floor
                if least is not None:
                    better = np.flatnonzero(scores >= least)
                    if not len(better):
                        continue
                    scores, ids = scores[better], ids[better]
                other = ids != own_id
                scores, ids = np.concatenate([best_s, scores[other]]), np.concatenate([best_i, ids[other]])
                order = np.lexsort((ids, -scores))[:k]
                best_s, best_i = scores[order], ids[order]
                if len(best_s) == k:
                    limit = far(best_s[-1])
            else:
                radius, child = page[3], page[4]
                near = np.flatnonzero(reach - radius <= limit + slack)
                self.computed += len(near)
                d = np.sqrt(np.maximum(base - 2 * (self.vectors[rows[near]] @ query), 0).astype(np.float64))
                bounds = np.maximum(d - radius[near], low)
                for bound, c, e in zip(bounds.tolist(), child[near].tolist(), d.tolist(), strict=True):
                    if bound <= limit + slack:
                        heapq.heappush(queue, (max(bound, 0.0), c, e))
        top = (1 << 63) - 1  # products beyond 64 bits saturate
        return [(max(-top - 1, min(top, int(s))), int(i)) for s, i in zip(best_s, best_i, strict=True)]


def nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest pivot of each vector, and its distance."""
    squares = (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * (v @ pivots.T)
    best = squares.argmin(axis=1)
    d = v - pivots[best]
    return best, np.sqrt((d * d).sum(axis=1))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    k: int = 20,
    tree_rows: tuple[int, int] = (8192, 65_536),
    block_rows: tuple[int, int] = (1024, 16_384),
    most_pivots: int = 1024,
) -> DataFrame:
    """(query_id, rank from 1, id, score) by integer inner product.

    Both inputs hold an id and an array of longs; a query's own id is no candidate.
    ``tree_rows``, ``block_rows``: an eighth of a table, but within these bounds."""

    def sound(df):
        v = F.col(vector_col).cast("array<bigint>")
        return df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))

    spark = vectors.sparkSession
    rows = sound(vectors).withColumn("dim", F.size("v"))
    asked = sound(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    within = lambda n, bounds: F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), F.ceil(F.col(n) / 8)))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).join(asked.groupBy("dim").agg(F.count("*").alias("m")), "dim")
    sizes = sizes.select("dim", within("n", tree_rows).alias("tree_rows"), "n", F.ceil(F.col("m") / within("m", block_rows)).cast("int").alias("blocks"))
    # one row for each length of vectors that queries have
    plan = written(sizes.withColumn("pivots", F.least(F.ceil(F.col("n") / F.col("tree_rows")), F.lit(most_pivots)).cast("int")).drop("n"), "plan")
    rows = rows.join(F.broadcast(plan.select("dim", "tree_rows", "pivots")), "dim")
    asked = written(asked.join(F.broadcast(plan.select("dim", "blocks")), "dim").withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")).select("id", "v", "dim", "block"), "queries")

    # pivots: the vectors with the smallest hashes; at most ``most_pivots`` of each length
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "v")
    chosen = rows.withColumn("place", F.row_number().over(by_hash)).where((F.col("place") <= most_pivots) & (F.col("place") <= F.col("pivots"))).select("dim", "place", "v").collect()
    pivots: dict[int, list] = {}
    for r in sorted(chosen, key=lambda r: (r.dim, r.place)):
        pivots.setdefault(r.dim, []).append(np.array(r.v, np.float64))
    centres = spark.sparkContext.broadcast({dim: np.stack(p) for dim, p in pivots.items()})

    def bucketed(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            bucket, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            v = b.column(1)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                bucket[at], far[at] = nearest(np.array(v.take(pa.array(at)).to_pylist(), np.float64).reshape(len(at), dim), centres.value[dim])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(bucket), pa.array(far)], names=["id", "v", "dim", "tree_rows", "bucket", "far"])

    placed = written(in_arrow(rows.select("id", "v", "dim", "tree_rows"), bucketed, "id bigint, v array<bigint>, dim int, tree_rows bigint, bucket int, far double"), "buckets")
    # pivots altogether
    filled = placed.groupBy("dim", "bucket").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / F.first("tree_rows")).cast("int").alias("parts")).collect()
    routes: dict[int, tuple] = {}
    for dim, p in pivots.items():
        own = sorted((r.bucket, r.radius, r.parts) for r in filled if r.dim == dim)
        number = np.array([x[0] for x in own])
        routes[dim] = (number, np.stack(p)[number], np.array([x[1] for x in own]), np.array([x[2] for x in own]))
    parts = spark.createDataFrame([(r.dim, r.bucket, r.parts) for r in filled], "dim int, bucket int, parts int")
    dealt = placed.join(F.broadcast(parts), ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))

    def built(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending")])
        tree = MTree(t.column("id").to_numpy(), _matrix(t.column("v").to_pylist()))
        blob = pa.array([pickle.dumps(tree, protocol=5)], pa.large_binary()).cast(pa.binary())
        return pa.table({**{c: t.column(c)[:1] for c in ("dim", "bucket", "part")}, "blob": blob})

    trees = written(dealt.select("dim", "bucket", "part", "id", "v").groupBy("dim", "bucket", "part").applyInArrow(built, "dim int, bucket int, part int, blob binary"), "trees")
    table = spark.sparkContext.broadcast(routes)

    def first(batches):
        """One tree for each query, of the bucket whose pivot has the largest product with it."""
        for b in batches:
            bucket, part = [], []
            for i, v, dim in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                number, centre, _, count = table.value[dim]
                best = int((centre @ np.array(v, np.float64)).argmax())
                bucket.append(int(number[best]))
                part.append(i % int(count[best]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array(bucket, pa.int32()), pa.array(part, pa.int32()), pa.nulls(b.num_rows, pa.int64())], names=_ROUTED)

    def others(batches):
        """All other trees of buckets that may hold a score as high as the floor."""
        for b in batches:
            at, bucket, part = [], [], []
            cols = (b.column(c).to_pylist() for c in range(7))
            for row, (i, v, dim, _, tried, tried_part, floor) in enumerate(zip(*cols, strict=True)):
                number, centre, radius, count = table.value[dim]
                q = np.array(v, np.float64)
                norm = np.sqrt((q * q).sum())
                most = centre @ q + norm * radius
                slack = _SLACK * (1 + norm * (np.sqrt((centre * centre).sum(axis=1)) + radius))
                for n in np.flatnonzero(most + slack >= (-np.inf if floor is None else float(floor))).tolist():
                    for p in range(int(count[n])):
                        if (number[n], p) != (tried, tried_part):
                            at.append(row)
                            bucket.append(int(number[n]))
                            part.append(p)
                if len(at) > 4096:  # bounded whatever the number of trees
                    yield _routed(b, at, bucket, part)
                    at, bucket, part = [], [], []
            yield _routed(b, at, bucket, part)

    schema = "id bigint, v array<bigint>, dim int, block int, bucket int, part int, floor bigint"
    one = written(in_arrow(asked, first, schema), "first")
    found = written(_searched(trees, one, k), "found")
    kth = F.when(F.size("scores") >= k, F.get("scores", F.lit(k - 1)))
    floors = found.select("query_id", F.when(kth > -(1 << 63), kth).alias("kth"))
    again = one.drop("floor").join(floors, F.col("id") == F.col("query_id"), "left").select(*_ROUTED[:-1], F.col("kth").alias("floor"))
    more = _searched(trees, in_arrow(again, others, schema), k)
    flat = found.unionByName(more).select("query_id", F.inline(F.arrays_zip("ids", "scores"))).toDF("query_id", "id", "score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return flat.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


_ROUTED = ["id", "v", "dim", "block", "bucket", "part", "floor"]


def _routed(b: pa.RecordBatch, at: list[int], bucket: list[int], part: list[int]) -> pa.RecordBatch:
    rows = b.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(4)), pa.array(bucket, pa.int32()), pa.array(part, pa.int32()), rows.column(6)], names=_ROUTED)


def _searched(trees: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """(query_id, ids, scores): what the trees hold for the queries sent to them; a task has one tree and one block of queries."""
    keys = ["dim", "bucket", "part", "block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = right.column("id").to_numpy(), []
        if left.num_rows and right.num_rows:
            tree, qs = pickle.loads(left.column("blob")[0].as_py()), _matrix(right.column("v").to_pylist())
            if qs.dtype != tree.vectors.dtype:  # one side needs Python integers, so both take them
                whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
                tree.vectors, qs, tree.top = whole(tree.vectors), whole(qs), int(tree.top)
            found = [tree.search(q, i, k, f) for i, q, f in zip(ids.tolist(), qs, right.column("floor").to_pylist(), strict=True)]
        keep = [n for n, f in enumerate(found) if f]
        return pa.table({
            "query_id": pa.array(ids[keep], pa.int64()),
            "ids": pa.array([[i for _, i in found[n]] for n in keep], pa.list_(pa.int64())), "scores": pa.array([[s for s, _ in found[n]] for n in keep], pa.list_(pa.int64())),
        })

    needed = routed.select(*(F.col(c).alias(f"own_{c}") for c in keys)).distinct()
    same = [trees[c] == needed[f"own_{c}"] for c in keys[:3]]
    cells = trees.join(needed, same).select(*(f"own_{c}" for c in keys), "blob")
    return cells.groupBy(*(f"own_{c}" for c in keys)).cogroup(routed.groupBy(*keys)).applyInArrow(search, "query_id bigint, ids array<bigint>, scores array<bigint>")
