"""Exact top-k search by inner product with one KD-tree per shard.

A coarse tree, fitted on a bounded sample (SAMPLE_ROWS) by median splits, deals all vectors to cells of space; a cell of many vectors, as of equal
ones, is dealt on over shards of about SHARD_ROWS. Each shard's tree is built once and stored: it halves the vectors at the median of the dimension with
the widest spread (by position, so equal values do no harm) down to small leaves, and every node keeps the tight bounding box of its vectors. For a
query, a box bounds the inner product from above; nodes are visited best bound first, until the bound falls below the k-th best score.

Queries travel to the shards, in rounds: first to the cell with the best bound, then to a few more, then to all that are left; after each round the k-th
best score found so far is the threshold, and cells whose box cannot reach it are left out. What a cell holds and bounds comes from all its
vectors, so the sample steers cost only, and results are exact. A task holds one shard's tree and BLOCK_ROWS queries, whatever the numbers of both.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import stored

SHARD_ROWS = 8192
BLOCK_ROWS = 8192
LEAF_ROWS = 256
#: Vectors that the coarse tree is fitted on, and its cells, at most (for each length of vector).
SAMPLE_ROWS, MOST_CELLS = 1 << 14, 1024
#: Cells of a query in each round but the last.
ROUNDS = (1, 4)

RESULT = "query_id long, vec_id long, score long"


class Tree:
    """points: whole numbers in float64. Vectors of a leaf lie side by side, in order of id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        self.left: list[int] = []
        self.right: list[int] = []
        self.span: list[tuple[int, int]] = []
        low, high, leaves = [], [], []

        def build(rows: np.ndarray, begin: int) -> int:
            at, box = len(self.span), points[rows]
            low.append(box.min(0))
            high.append(box.max(0))
            self.left.append(-1)
            self.right.append(-1)
            self.span.append((begin, begin + len(rows)))
            if len(rows) <= LEAF_ROWS or not points.shape[1] or not (spread := high[at] - low[at]).max() > 0:
                leaves.append(np.sort(rows))
                return at
            half = len(rows) // 2
            cut = np.argpartition(box[:, int(np.argmax(spread))], half)
            self.left[at], self.right[at] = build(rows[cut[:half]], begin), build(rows[cut[half:]], begin + half)
            return at

        build(np.arange(len(ids)), 0)
        order = np.concatenate(leaves)
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(low), np.array(high)

    def packed(self) -> bytes:
        return pickle.dumps((self.ids, narrow(self.points), self.left, self.right, self.span, narrow(self.low), narrow(self.high)), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.ids, points, tree.left, tree.right, tree.span, low, high = pickle.loads(data)
        tree.points, tree.low, tree.high = (x.astype(np.float64) for x in (points, low, high))
        return tree

    def exact_for(self, queries: np.ndarray) -> np.ndarray:
        """The queries, and the tree's numbers, as float64 where products stay below 2**53, else as Python integers."""
        peak = max([0.0, *(np.abs(x).max() for x in (self.low, self.high, queries) if x.size)])
        if peak * peak * max(self.points.shape[1], 1) < 2**53:
            return queries
        whole = np.frompyfunc(int, 1, 1)
        self.points, self.low, self.high = (whole(x) for x in (self.points, self.low, self.high))
        return whole(queries)

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """At most k (score, id), best first and ties by smaller id; of scores below least none is needed."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        todo = [(-bound[0], 0)]
        while todo:
            above, at = heapq.heappop(todo)
            floor = best[0][0] if len(best) == k else least
            if floor is not None and -above < floor:
                break
            if self.left[at] >= 0:
                for child in (self.left[at], self.right[at]):
                    if floor is None or bound[child] >= floor:
                        heapq.heappush(todo, (-bound[child], child))
                continue
            a, b = self.span[at]
            ids, scores = self.ids[a:b], self.points[a:b].dot(query)
            near = np.arange(b - a) if floor is None else np.flatnonzero(scores >= floor)
            # Only the k best of a leaf can count; rows go by id, and the sort is stable. The query's own may be among them.
            for i in near[np.argsort(-scores[near], kind="stable")[: k + int((ids == own).sum())]] if len(near) else ():
                if (got := int(ids[i])) != own:
                    entry = (int(scores[i]), -got)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers as float32 where that is exact."""
    return x.astype(np.float32) if not x.size or np.abs(x).max() < 2**24 else x


def bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Queries x boxes: no vector in the box has a greater product."""
    plus = np.where(queries > 0, queries, 0 * queries)
    return plus.dot(high.T) + (queries - plus).dot(low.T)


def scaled(vectors: pa.Array) -> np.ndarray:
    """floor(256 * x) of each component, as float64, of vectors of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(256.0 * flat).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def coarse(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, cut, left, right) of a tree of about so many cells; a leaf is (-1, 0, number, 0). Vectors below or at the cut go left."""
    nodes: list[tuple[int, float, int, int]] = []
    number = iter(range(1 << 30))

    def build(rows: np.ndarray, wanted: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, 0))
        spread = points[rows].max(0) - points[rows].min(0) if len(rows) and points.shape[1] else np.zeros(1)
        if wanted > 1 and spread.max() > 0:
            d = int(np.argmax(spread))
            values = points[rows, d]
            cut = float(np.median(values))
            cut = cut if (values > cut).any() else float(values[values < cut].max())
            left = values <= cut
            nodes[at] = (d, cut, build(rows[left], wanted // 2), build(rows[~left], wanted - wanted // 2))
        else:
            nodes[at] = (-1, 0.0, next(number), 0)
        return at

    build(np.arange(len(points)), cells)
    return nodes


def dealt(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    dim, cut, left, right = (np.array(x) for x in zip(*nodes))
    at = np.zeros(len(points), np.int64)
    while (inner := np.flatnonzero(dim[at] >= 0)).size:
        node = at[inner]
        at[inner] = np.where(points[inner, dim[node]] <= cut[node], left[node], right[node])
    return left[at]


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, scaled vectors) for each length of vector in a batch."""
    lengths = np.asarray(batch.column(column).value_lengths(), np.int64)
    for n in np.unique(lengths):
        part = batch.take(pa.array(np.flatnonzero(lengths == n)))
        yield int(n), part, scaled(part.column(column))


def _build(group: pa.Table) -> pa.Table:
    dims = group.column("dims")[0].as_py()
    points = np.array([np.frombuffer(x, np.float32 if len(x) == 4 * dims else np.float64) for x in group.column("point").to_pylist()], np.float64).reshape(len(group), dims)
    tree = Tree(group.column("vec_id").to_numpy(), points)
    one = {c: [group.column(c)[0].as_py()] for c in ("dims", "cell", "salt")}
    return pa.table({**one, "low": [tree.low[0].tolist()], "high": [tree.high[0].tolist()], "tree": [tree.packed()]}, pa.schema(_TREE))


_TREE = [("dims", pa.int32()), ("cell", pa.int64()), ("salt", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("tree", pa.binary())]


def _box(group: pa.Table) -> pa.Table:
    low, high = (np.array(group.column(c).to_pylist(), np.float64).reshape(len(group), -1) for c in ("low", "high"))
    return pa.table({"dims": group.column("dims")[:1], "cell": group.column("cell")[:1], "low": [low.min(0).tolist()], "high": [high.max(0).tolist()], "salts": [len(group)]})


def _search_shard(k: int):
    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: dict[str, list[int]] = {"query_id": [], "vec_id": [], "score": []}
        if len(shard) and len(block):
            tree, most = Tree.unpacked(shard.column("tree")[0].as_py()), 2**63 - 1
            own, least = block.column("query_id").to_pylist(), block.column("least").to_pylist()
            asked = tree.exact_for(scaled(block.column("vec").combine_chunks()))
            for at in range(0, len(asked), 256):
                for i, bound in enumerate(bounds(tree.low, tree.high, asked[at : at + 256]), at):
                    for score, vec_id in tree.search(asked[i], own[i], bound, k, least[i]):
                        out["query_id"].append(own[i])
                        out["vec_id"].append(vec_id)
                        out["score"].append(min(max(score, -most - 1), most))
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row for which is_query holds, among all rows with another id.

    The score is the inner product of floor(256 * x); ties go to the smaller id. Fewer than k candidates: all of them. Rows with a null
    id, a null vector, or null or non-finite components take no part; a candidate must have as many components as the
    query. Repeated rows are candidates each; of query rows with one id, the smallest vector is asked. Scores outside
    64 bits are set to the nearest that fits. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(T.ArrayType(T.DoubleType())).alias("vec"), is_query.alias("asks"))
    whole = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))  # NaN compares above all numbers
    rows = rows.filter(F.col("vec_id").isNotNull() & whole)
    counts = {r.dims: r for r in rows.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()}  # a row per length of vector
    if not sum(r.q for r in counts.values()):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # The coarse trees, from a sample by hash of the id.
    step = max(1, -(-sum(r.n for r in counts.values()) // SAMPLE_ROWS))
    picked = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).select("vec").limit(2 * SAMPLE_ROWS).toArrow()
    samples = {n: p for b in picked.combine_chunks().to_batches() for n, _, p in _by_length(b, 0)}
    maps = spark.sparkContext.broadcast({d: coarse(samples.get(d, np.zeros((0, d))), min(MOST_CELLS, -(-r.n // SHARD_ROWS))) for d, r in counts.items()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part, points in _by_length(batch, 1):
                cells = dealt(maps.value[dims], points)
                packed = [narrow(p).tobytes() for p in points]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dims), pa.int32()), pa.array(cells), part.column(0), pa.array(packed, pa.binary())], names=["dims", "cell", "vec_id", "point"])

    points = stored(rows.select("vec_id", "vec").mapInArrow(deal, "dims int, cell long, vec_id long, point binary"), "points")
    # MOST_CELLS rows for each length of vector, at most.
    sizes = points.groupBy("dims", "cell").agg(F.count("*").alias("n")).select("dims", "cell", F.ceil(F.col("n") / SHARD_ROWS).alias("salts"))
    salted = points.join(F.broadcast(sizes), ["dims", "cell"]).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts")))
    trees = stored(salted.select("dims", "cell", "salt", "vec_id", "point").groupBy("dims", "cell", "salt").applyInArrow(_build, "dims int, cell long, salt long, low array<double>, high array<double>, tree binary"), "trees")
    boxes = trees.select("dims", "cell", "low", "high").groupBy("dims", "cell").applyInArrow(_box, "dims int, cell long, low array<double>, high array<double>, salts long").collect()  # as many again
    places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for d in {b.dims for b in boxes}:
        own = [b for b in boxes if b.dims == d]
        places[d] = np.array([b.cell for b in own]), np.array([b.low for b in own]).reshape(len(own), d), np.array([b.high for b in own]).reshape(len(own), d)
    shared = spark.sparkContext.broadcast(places)
    salts = spark.createDataFrame([(b.dims, b.cell, b.salts) for b in boxes], "dims int, cell long, salts long")
    asks = stored(rows.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")), "queries")

    def visits(begin: int, end: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dims, part, queries in _by_length(batch, 1):
                    if dims not in shared.value:
                        continue
                    cells, low, high = shared.value[dims]
                    least = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN, below which nothing is
                    for at in range(0, len(part), 1024):
                        bound = bounds(low, high, queries[at : at + 1024])
                        order = np.argsort(-bound, axis=1, kind="stable")[:, begin:end]
                        # Bounds of floats may be off in the last places.
                        near = ~(np.take_along_axis(bound, order, 1) * (1 + 1e-9 * np.sign(np.take_along_axis(bound, order, 1))) + 1 < least[at : at + 1024, None])
                        i, j = np.nonzero(near)
                        took = part.take(pa.array(i + at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dims), pa.int32()), pa.array(cells[order[i, j]]), *took.columns], names=["dims", "cell", "query_id", "vec", "least"])

        return run

    seen = spark.createDataFrame([], RESULT)
    edges = [0, *np.cumsum(ROUNDS).tolist()]
    cells = max(len(p[0]) for p in places.values())
    for begin, end in zip(edges, [*edges[1:], None]):
        if begin and begin >= cells:
            break
        least = seen.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        todo = stored(asks.join(least, "query_id", "left").select("query_id", "vec", "least").mapInArrow(visits(begin, end), "dims int, cell long, query_id long, vec array<double>, least long"), "visits")
        blocks = todo.groupBy("dims", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")).join(F.broadcast(salts), ["dims", "cell"])
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        queries = todo.join(F.broadcast(blocks), ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).withColumn("salt", upto("salts"))
        shards = trees.join(F.broadcast(blocks), ["dims", "cell"]).select("dims", "cell", "salt", "tree", upto("blocks").alias("block"))
        keys = ["dims", "cell", "salt", "block"]
        found = shards.groupBy(*keys).cogroup(queries.select(*keys, "query_id", "vec", "least").groupBy(*keys)).applyInArrow(_search_shard(k), RESULT)
        order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        seen = stored(seen.union(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "score"), "found")
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return seen.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
