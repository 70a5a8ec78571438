"""Exact top-k search by inner product with dual-tree cover-tree search.

1. *Cells.*  Up to ``PIVOTS`` rows, drawn by a hash of their ids, are pivots; every
   row goes to the cell of its nearest pivot.  A cell's radius covers its rows.
2. *Seeds.*  Queries are searched against the data of their own cell first; the
   k-th score that each has by then is its worst.
3. *Pairs.*  With pivots q, c and covering radii r, s no inner product of two cells
   is above q.c + |q| s + |c| r + r s.  A query cell is only sent to data cells
   whose bound reaches the least worst score among its queries.
4. *Trees.*  Cells are cut into blocks; a pair of blocks is a task, with a cover
   tree over either side that prunes pairs of nodes by the same bound.  A node's
   children cover its points within half its radius; a node that takes more than
   ``SPLIT`` children for that stays a leaf, as nothing could be pruned below it.

What pruning saves depends on the data: on vectors without clusters in many
dimensions all bounds reach all seeds, and the search is a blocked exact scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import Scratch

PIVOTS, CELL_ROWS = 256, 4096
LEAF, SPLIT, QUERY_BLOCK, DATA_BLOCK = 256, 64, 8192, 16384
#: Rows of a leaf that are multiplied at a time: queries, data.
TILE = 512, 2048


class Node:
    """A cover-tree node: its points, their centre and covering radius, and its children."""

    __slots__ = ("rows", "center", "norm", "radius", "children")

    def __init__(self, rows: np.ndarray, center: np.ndarray, radius: float):
        self.rows, self.center, self.radius = rows, center, radius
        self.norm = float(np.sqrt(center @ center))
        self.children: list[Node] = []


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, center: int | None = None) -> Node:
    """Build a tree over ``points``; the children of a node have centres more than half its radius apart."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    c = own[0] if center is None else points[center]
    far = np.sqrt(((own - c) ** 2).sum(axis=1))
    node = Node(rows, c, float(far.max()))
    if len(rows) <= LEAF or node.radius == 0:
        return node
    owner = np.zeros(len(rows), np.int64)
    centers = [int(rows[int(far.argmin())])]
    near = np.sqrt(((own - points[centers[0]]) ** 2).sum(axis=1))
    # farthest first: when all are covered, centres are separated by more than half the radius
    while near.max() > node.radius / 2:
        if len(centers) == SPLIT:
            return node
        k = int(near.argmax())
        centers.append(int(rows[k]))
        d = np.sqrt(((own - own[k]) ** 2).sum(axis=1))
        closer = d < near
        owner[closer] = len(centers) - 1
        near = np.where(closer, d, near)
    for k, x in enumerate(centers):
        part = rows[owner == k]
        if len(part):
            node.children.append(cover_tree(points, part, x))
    return node


def bound(a: np.ndarray, b: np.ndarray, r: float, s: float) -> float:
    """The greatest inner product of points within r of a and within s of b; a little more for its rounding."""
    most = float(a @ b) + float(np.sqrt(a @ a)) * s + float(np.sqrt(b @ b)) * r + r * s
    return most + 1e-6 * (1 + abs(most))


#: Bits of a key that hold a row's place; scores of up to 62 - ROW_BITS bits fit beside it.
ROW_BITS = 20
LOW = np.iinfo(np.int64).min
#: Vectors shorter than this have products that fit a key and are exact in doubles.
SHORT = float(1 << ((62 - ROW_BITS) // 2))
LIMB = 1 << 20


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers below 2**62, exact as far as they fit 64 bits: limbs of 20 bits are multiplied in doubles."""
    limbs = lambda x: [(x >> (20 * k)) % LIMB if k < 3 else x >> 60 for k in range(4)]
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a.astype(np.int64))):
        for j, y in enumerate(limbs(b.astype(np.int64))):
            if i + j < 4 and x.any() and y.any():
                out += (x.astype(float) @ y.T.astype(float)).astype(np.int64) << np.int64(20 * (i + j))
    return out


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, score) of the k best of each query; equal scores go to the smaller id, own ids are left out.

    ``data`` is sorted by id and has less than 2**ROW_BITS rows.  Scores below a
    query's seed aren't wanted.  Vectors hold whole numbers.
    """
    if not len(queries) or not len(data):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    seeds = np.full(len(queries), LOW) if seeds is None else seeds
    long_q, long_d = (np.sqrt((x**2).sum(axis=1)) >= SHORT for x in (queries, data))
    if not long_q.any() and not long_d.any():
        return dual_tree(queries, query_ids, data, data_ids, k, seeds)
    found = []
    for q, d, short in ((~long_q, ~long_d, True), (~long_q, long_d, False), (long_q, np.ones(len(data), bool), False)):
        q, d = np.flatnonzero(q), np.flatnonzero(d)
        if len(q) and len(d):
            a, b, s = (dual_tree if short else scan)(queries[q], query_ids[q], data[d], data_ids[d], k, seeds[q])
            found.append((q[a], d[b], s))
    at, place, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, -score, at))  # data rows ascend with their ids
    at, place, score = at[order], place[order], score[order]
    first = np.searchsorted(at, at, side="left")
    best = np.arange(len(at)) - first < k
    return at[best], place[best], score[best]


def scan(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``search`` for long vectors: all pairs, exactly, without bounds in doubles."""
    at, place, score = [], [], []
    for i in range(0, len(queries), 64):
        s = products(queries[i : i + 64], data)
        for n, row in enumerate(s):
            use = np.flatnonzero((data_ids != query_ids[i + n]) & (row >= seeds[i + n]))
            use = use[np.lexsort((use, -row[use]))[:k]]
            at.append(np.full(len(use), i + n))
            place.append(use)
            score.append(row[use])
    return np.concatenate(at), np.concatenate(place), np.concatenate(score)


def dual_tree(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``search`` for short vectors.

    A candidate is one integer, its score above its place from the end, so that
    greater keys are better and ties need no second look.
    """
    keys = np.full((len(queries), k), LOW)
    last = (1 << ROW_BITS) - 1
    worst = np.where(seeds > -(1 << 42), (np.maximum(seeds, -(1 << 42)) << ROW_BITS) - 1, LOW)
    own_ids = np.isin(data_ids, query_ids)

    def leaf(q: Node, d: Node) -> None:
        for i in range(0, len(q.rows), TILE[0]):
            for j in range(0, len(d.rows), TILE[1]):
                tile(q.rows[i : i + TILE[0]], d.rows[j : j + TILE[1]])

    def tile(q: np.ndarray, d: np.ndarray) -> None:
        new = ((queries[q] @ data[d].T).astype(np.int64) << ROW_BITS) + (last - d)[None, :]
        if own_ids[d].any():
            new[query_ids[q][:, None] == data_ids[d][None, :]] = LOW
        better = np.flatnonzero(new.max(axis=1) > worst[q])
        if len(better):
            rows = q[better]
            both = np.concatenate((keys[rows], new[better]), axis=1)
            keys[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
            worst[rows] = np.maximum(worst[rows], keys[rows].min(axis=1))

    def visit(q: Node, d: Node, most: float) -> None:
        if most < int(worst[q.rows].min()) >> ROW_BITS:  # equal scores can still win by their ids
            return
        if not q.children and not d.children:
            leaf(q, d)
            return
        split_q = bool(q.children) and (not d.children or q.radius > d.radius)
        pairs = [(x, d) for x in q.children] if split_q else [(q, x) for x in d.children]
        for most, x, y in sorted(((bound(x.center, y.center, x.radius, y.radius), x, y) for x, y in pairs), key=lambda t: -t[0]):
            visit(x, y, most)

    q, d = cover_tree(queries), cover_tree(data)
    visit(q, d, bound(q.center, d.center, q.radius, d.radius))
    at, place = np.nonzero(keys > LOW)
    found = keys[at, place]
    wanted = (found >> ROW_BITS) >= seeds[at]
    at, found = at[wanted], found[wanted]
    return at, last - (found & last), found >> ROW_BITS


def top_k(vectors: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, scale: int = 64, report: list[tuple[int, int]] | None = None) -> DataFrame:
    """The ``k`` best other rows by integer inner product for each row whose id is divisible by ``every``.

    Components x count as floor(scale * x).  Returns query_id, rank (from 1),
    vec_id and score; ties go to the smaller id; all rows if fewer than k.
    Vectors that are null or hold null or non-finite components, and rows without
    an id, take no part; vectors of different lengths aren't comparable, and only
    those of the query's length are candidates.  Rows that share an id with the
    query are its own; an id that repeats among candidates counts once a row.
    Scores are exact where components are below 2**62 and scores fit 64 bits.
    Other columns take no part; an empty table gives an empty one.  ``report`` gets
    the pairs of cells, and how many of them were searched.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    good = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: v.cast("double") * scale).alias("v")).withColumn("dim", F.size("v"))
    drawn = F.xxhash64(F.lit("pivot"), "id")
    n = rows.count()
    pivots: dict[int, np.ndarray] = {}
    for r in rows.orderBy(drawn, "id").limit(min(PIVOTS, 1 + n // CELL_ROWS)).collect():
        pivots.setdefault(r["dim"], []).append(r["v"])
    pivots = {dim: np.floor(np.array(p, float)) for dim, p in pivots.items()}
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            dim, v = np.asarray(batch.column("dim")), batch.column("v")
            cell, far = np.full(len(dim), -1, np.int32), np.full(len(dim), np.inf)
            flat, offs = np.floor(np.asarray(v.values, float)), np.asarray(v.offsets)
            for size in set(dim.tolist()) & set(sent.value):
                at = np.flatnonzero(dim == size)
                p = sent.value[size]
                own = flat[(offs[at][:, None] + np.arange(size)[None, :]).ravel()].reshape(len(at), size)
                d = (own**2).sum(axis=1)[:, None] - 2 * own @ p.T + (p**2).sum(axis=1)[None, :]
                cell[at] = d.argmin(axis=1)
                far[at] = np.sqrt(((own - p[cell[at]]) ** 2).sum(axis=1))
            whole = pa.ListArray.from_arrays(pa.array(offs - offs[0], pa.int32()), pa.array(flat[offs[0] : offs[-1]] if len(dim) else flat))
            yield pa.record_batch({"id": batch.column("id"), "v": whole, "dim": batch.column("dim"), "cell": pa.array(cell), "far": pa.array(far)})

    scratch = Scratch(spark)
    rows = scratch.keep(rows.mapInArrow(assign, "id long, v array<double>, dim int, cell int, far double"))
    asks = F.col("id") % every == 0
    # a row for each cell, and for each vector length that no pivot has
    of_cell = rows.groupBy("dim", "cell").agg(F.count("id").alias("n"), F.count(F.when(asks, 1)).alias("asking"), F.max("far").alias("far"), F.max(F.when(asks, F.col("far"))).alias("asking_far"))
    cells = {(r["dim"], r["cell"]): r for r in of_cell.collect()}
    parts = lambda many, size: max(1, -(-many // size))
    pair = "dim int, qc int, dc int, qparts int, dparts int"

    def pairs_of(chosen: list[tuple[tuple[int, int], tuple[int, int]]]) -> DataFrame:
        return spark.createDataFrame([(a[0], a[1], b[1], parts(cells[a]["asking"], QUERY_BLOCK), parts(cells[b]["n"], DATA_BLOCK)) for a, b in chosen], pair)

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.asarray(t.column("id")).astype(np.int64)
        flat = np.asarray(t.column("v").combine_chunks().flatten() if len(t) else [], dtype=np.float64)
        order = np.argsort(ids, kind="stable")
        return order, ids[order], flat.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 0))

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        (qo, qi, qv), (_, di, dv) = matrix(q), matrix(d)
        if not len(qi) or not len(di):
            a, b, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
        else:
            seeds = np.asarray(q.column("seed").fill_null(int(LOW))).astype(np.int64)[qo]
            a, b, s = search(qv, qi, dv, di, k, seeds)
        return pa.table({"query_id": pa.array(qi[a] if len(qi) else a, pa.int64()), "vec_id": pa.array(di[b] if len(di) else b, pa.int64()), "score": pa.array(s, pa.int64())})

    def searched(queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """The best of each query in each block that it is sent to; ``pairs`` has a row for two cells, so PIVOTS**2 at most for a vector length."""
        part = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), m).cast("int")
        to = F.broadcast(pairs)
        q = queries.withColumnRenamed("cell", "qc").join(to, ["dim", "qc"]).withColumn("qp", part("query", F.col("qparts"))).withColumn("dp", F.explode(F.sequence(F.lit(0), F.col("dparts") - 1)))
        # new names for the same rows, as both sides of the cogroup read them
        d = rows.select(*[F.col(c).alias(a) for c, a in (("id", "id"), ("v", "v"), ("dim", "dim"), ("cell", "dc"))]).join(to, ["dim", "dc"]).withColumn("dp", part("data", F.col("dparts"))).withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))
        keys = ["dim", "qc", "dc", "qp", "dp"]
        return q.select(*keys, "id", "v", "seed").groupBy(*keys).cogroup(d.select(*keys, "id", "v").groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    asking = [c for c, r in cells.items() if r["asking"]]
    queries = rows.where(asks)
    own = scratch.keep(ranked(searched(queries.withColumn("seed", F.lit(None).cast("long")), pairs_of([(c, c) for c in asking]))).drop("rank"))
    seeds = own.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("least"), F.count("*").alias("found")).select("id", F.when(F.col("found") == k, F.col("least")).alias("seed"))
    queries = scratch.keep(queries.join(seeds, "id", "left"))
    least = {(r["dim"], r["cell"]): r["seed"] for r in queries.groupBy("dim", "cell").agg(F.min(F.coalesce("seed", F.lit(int(LOW)))).alias("seed")).collect()}
    chosen = []
    for a in asking:
        for b in cells:
            if a != b and a[0] == b[0]:
                p = pivots.get(a[0])
                if a[1] < 0 or b[1] < 0 or bound(p[a[1]], p[b[1]], cells[a]["asking_far"], cells[b]["far"]) >= least[a]:
                    chosen.append((a, b))
    if report is not None:
        report.append((sum(a[0] == b[0] for a in asking for b in cells), len(chosen) + len(asking)))
    found = own.union(searched(queries, pairs_of(chosen))) if chosen else own
    return ranked(found).select("query_id", "rank", "vec_id", "score")
