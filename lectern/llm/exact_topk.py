"""Exact top-k by inner product: a KD-tree per shard, best-first traversal, a k-th score that is passed on.

A coarse tree over a sample cuts space into cells; a cell is one shard or, where it holds more rows than a shard may, several.
Each shard becomes one KD-tree with median splits and tight boxes, stored as one row of a table. A query first visits a shard
of its own cell, which gives it a k-th score to beat. Then the boxes of the cells tell which of them can hold a better one: it
visits first those that promise most, then, with the score it has by then, what is left. Inside a shard whole subtrees fall
below that score.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

K = 5
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 8192, 256, 512
SCALE = 256.0
#: Components of the vectors that the driver takes a sample of to cut space, and sampled vectors in a cell: so many cells there are at most.
SAMPLE_VALUES, SAMPLE_IN_CELL = 1 << 20, 16
#: Cells that a query visits before its k-th score is passed on once more.
NEAR_CELLS = 2


def scaled(vectors: DataFrame, id_col: str, vector_col: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, v array<long>, ``also``): floor(256 x) of every component; rows with null or non-finite vectors or ids leave, and empty vectors.

    A finite component of 2**55 or more has no such integer in a long: that is an error.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(x) > 0)
    whole = F.when(F.exists(x, lambda c: F.abs(c) >= 2.0**55), F.raise_error(F.lit("a component is too large to be scaled"))).otherwise(F.transform(x, lambda c: F.floor(c * SCALE).cast("long")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), *also)


class Cells:
    """A coarse KD-tree over a sample: children of node i are 2 i + 1 and 2 i + 2, the leaves are the cells."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.depth = max(0, min(int(np.ceil(np.log2(max(1, shards)))), int(np.log2(max(1, len(sample) / SAMPLE_IN_CELL)))))
        self.n = 2**self.depth
        self.axis, self.cut = [0] * (self.n - 1), [0] * (self.n - 1)
        parts = {0: sample}
        for node in range(self.n - 1):
            part = parts.pop(node)
            if len(part):
                self.axis[node] = int((part.max(axis=0) - part.min(axis=0)).argmax())
                self.cut[node] = int(np.partition(part[:, self.axis[node]], (len(part) - 1) // 2)[(len(part) - 1) // 2])
            above = part[:, self.axis[node]] > self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = part[~above], part[above]

    def of(self, v: str) -> Column:
        if not self.depth:
            return F.lit(0)
        axis, cut = F.array(*map(F.lit, self.axis)), F.array(*[F.lit(c).cast("long") for c in self.cut])
        down = lambda node, _: (2 * node + 1 + (F.get(F.col(v), F.get(axis, node)) > F.get(cut, node)).cast("int")).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), down) - (self.n - 1)


class KdTree:
    """Nodes in an array: children of i are 2 i + 1 and 2 i + 2; leaves hold slices of the rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS):
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        order = np.lexsort((ids,))
        self.depth, n_nodes = depth, 2 ** (depth + 1) - 1
        self.low, self.high = np.empty((n_nodes, x.shape[1]), x.dtype), np.empty((n_nodes, x.shape[1]), x.dtype)
        self.start, self.end, self.first = (np.zeros(n_nodes, np.int64) for _ in range(3))
        todo = [(0, 0, len(ids))]
        while todo:
            node, a, b = todo.pop()
            part = x[order[a:b]]
            self.low[node], self.high[node], self.start[node], self.end[node] = part.min(axis=0), part.max(axis=0), a, b
            self.first[node] = ids[order[a:b]].min()
            if 2 * node + 2 < n_nodes:
                axis = int((self.high[node] - self.low[node]).argmax())
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argsort(part[:, axis], kind="stable")]
                todo += [(2 * node + 1, a, a + mid), (2 * node + 2, a + mid, b)]
        self.ids, self.x = ids[order], x[order]

    def dump(self) -> bytes:
        out = io.BytesIO()
        small = np.int16 if max(int(self.x.max()), -int(self.x.min())) < 2**15 else np.int64
        np.savez(out, start=self.start, end=self.end, first=self.first, ids=self.ids, **{k: getattr(self, k).astype(small) for k in ("low", "high", "x")})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, kind: type) -> KdTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as f:
            for k in f.files:
                setattr(tree, k, f[k].astype(kind) if k in ("low", "high", "x") else f[k])
        return tree

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """Up to ``k`` (score, id), best first, ties to smaller ids; scores under ``floor`` need not be found."""
        up = np.maximum(query, 0)
        bounds = self.high @ up + self.low @ (query - up)  # the largest inner product that each box allows
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its top is what a newcomer has to beat
        heap = [(-int(bounds[0]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            full = len(best) == k
            limit, last = (best[0][0], -best[0][1]) if full else (floor, None)
            if limit is not None and -bound < limit:
                break
            if full and -bound == limit and self.first[node] >= last:
                continue  # nothing here beats the k-th, which has a smaller id
            left = 2 * node + 1
            if left < len(bounds):
                for child in (left, left + 1):
                    if limit is None or bounds[child] >= limit:
                        heapq.heappush(heap, (-int(bounds[child]), child))
                continue
            a, b = self.start[node], self.end[node]
            scores, ids = self.x[a:b] @ query, self.ids[a:b]
            worth = ids != own
            if limit is not None:
                worth &= (scores > limit) | ((scores == limit) & (ids < last)) if full else scores >= limit
            at = np.flatnonzero(worth)
            for i in at[np.lexsort((ids[at], -scores[at]))][:k]:
                item = (int(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.array(column.to_list(), dtype=kind)


def cell_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query (rows) that each cell's box (columns) allows."""
    up = np.maximum(queries, 0)
    return up @ high.T + (queries - up) @ low.T


def topk(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id_col, score): for each id of ``queries`` the ``k`` rows of ``vectors`` of highest score.

    The score is the integer inner product of the scaled vectors, which exists for vectors of one length: those of other
    lengths are no candidates. A row is none for a query of its own id. Ties go to the smaller id; with fewer than
    ``k`` candidates all are given. Rows that repeat an id count each; a query id that is stored several times asks once,
    with the smallest of its vectors. Sums are exact: float arithmetic where every possible sum stays below 2**53,
    long arithmetic below 2**63, else Python integers, where a score beyond a long is an error.
    """
    spark = vectors.sparkSession
    rows = durable(scaled(vectors, id_col, vector_col), "scaled-vectors")
    asked = durable(scaled(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "scaled-queries")
    size = F.max(F.array_max(F.transform("v", lambda x: F.abs(x).cast("double"))))
    wanted = {r["dim"]: r for r in asked.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), size.alias("top")).collect()}
    have = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), size.alias("top")).collect()
    found = [
        _search(rows.where(F.size("v") == r["dim"]), asked.where(F.size("v") == r["dim"]), r, wanted[r["dim"]], k, id_col, shard_rows)
        for r in sorted(have, key=lambda r: r["dim"]) if r["dim"] in wanted
    ]
    if not found:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def _search(rows: DataFrame, asked: DataFrame, have, wanted, k: int, id_col: str, shard_rows: int) -> DataFrame:
    """(query_id, id_col, score) of all that can be among the best ``k``, for vectors of one length."""
    spark, dim = rows.sparkSession, have["dim"]
    most = dim * max(have["top"], 1.0) * max(wanted["top"], 1.0)
    kind = np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object
    share = SAMPLE_VALUES / dim / have["n"]
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").toPandas()
    cells = Cells(matrix(sample["v"], np.int64).reshape(-1, dim), -(-have["n"] // shard_rows))
    placed = rows.withColumn("cell", cells.of("v"))
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row a cell
    slices = [-(-counts.get(c, 0) // shard_rows) for c in range(cells.n)]
    n_slices = F.get(F.array(*map(F.lit, slices)), F.col("cell"))

    def plant(part: pd.DataFrame) -> pd.DataFrame:
        tree = KdTree(part["id"].to_numpy(np.int64), matrix(part["v"], np.int64))
        return pd.DataFrame({"cell": [int(part["cell"].iloc[0])], "slice": [int(part["slice"].iloc[0])], "tree": [tree.dump()], "low": [tree.low[0]], "high": [tree.high[0]]})

    # dealt by the row, not by the id, so that rows that repeat an id spread; ``rows`` is a stored table, so a retry numbers them alike
    dealt = placed.withColumn("slice", F.pmod(F.xxhash64(F.monotonically_increasing_id()), n_slices).cast("int"))
    trees = durable(dealt.groupBy("cell", "slice").applyInPandas(plant, "cell int, slice int, tree binary, low array<long>, high array<long>"), "kd-trees")
    sides = trees.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("i", "b")).groupBy("cell", "i").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high")).toPandas()
    low, high = np.zeros((cells.n, dim), kind), np.zeros((cells.n, dim), kind)
    for box, column in ((low, "low"), (high, "high")):
        box[sides["cell"].to_numpy(), sides["i"].to_numpy()] = sides[column].to_numpy().astype(kind)
    filled = np.array([bool(s) for s in slices])

    # queries go in blocks of one cell, so that a shard goes out once for many that look alike
    asking = asked.withColumn("cell", cells.of("v"))
    held = {r["cell"]: r["count"] for r in asking.groupBy("cell").count().collect()}  # a row a cell
    blocks = F.get(F.array(*[F.lit(max(1, -(-held.get(c, 0) // BLOCK_QUERIES))) for c in range(cells.n)]), F.col("cell"))
    homes = asking.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), blocks)).withColumn("block", F.col("cell").cast("long") * (1 << 32) + F.col("part"))
    home_slices = F.get(F.array(*map(F.lit, slices)), F.col("cell"))
    homes = durable(homes.where(home_slices > 0).withColumn("slice", F.pmod(F.col("part"), home_slices).cast("int")).unionByName(homes.where(home_slices == 0).withColumn("slice", F.lit(-1))), "query-homes")

    def run(batches):
        for batch in batches:
            for asked_here, data in zip(batch["q"], batch["tree"]):
                tree, out = KdTree.load(data, kind), []
                for q in asked_here:
                    floor = None if q["floor"] is None or pd.isna(q["floor"]) else int(q["floor"])
                    out += [(q["id"], i, s) for s, i in tree.search(np.asarray(q["v"]).astype(kind), q["id"], k, floor)]
                yield pd.DataFrame(out, columns=["query_id", id_col, "score"]).astype("int64")

    def visit(at: DataFrame, name: str) -> DataFrame:
        """Blocks of queries (cell, slice, block, id, v, floor) against the trees of their shards, a few trees in memory at once."""
        packed = at.groupBy("cell", "slice", "block").agg(F.collect_list(F.struct("id", "v", "floor")).alias("q")).join(trees.select("cell", "slice", "tree"), ["cell", "slice"]).select("q", "tree")
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        try:
            return durable(packed.mapInPandas(run, f"query_id long, `{id_col}` long, score long"), name)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def floors(seen: DataFrame) -> DataFrame:
        """The k-th score of each query that has ``k`` by now."""
        ranked = seen.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)))
        return ranked.where(F.col("_n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))

    def promising(asking: DataFrame, near: bool) -> DataFrame:
        """Queries with each shard that may hold something as good as their floor, among the nearest cells or all others."""

        def choose(batches):
            for batch in batches:
                if not len(batch):
                    continue
                bounds = cell_bounds(matrix(batch["v"], kind), low, high)
                order = np.argsort(-np.where(filled, bounds, -np.inf).astype(np.float64), axis=1, kind="stable")[:, :NEAR_CELLS]
                chosen = np.zeros(bounds.shape, bool)
                np.put_along_axis(chosen, order, True, axis=1)
                floor = [None if pd.isna(f) else int(f) for f in batch["floor"]]
                worth = np.array([[f is None or b >= f for b in row] for f, row in zip(floor, bounds)]) & (chosen == near) & filled
                which, cell = np.nonzero(worth)
                yield pd.DataFrame({"id": batch["id"].to_numpy()[which], "cell": cell.astype(np.int32)})

        pairs = asking.select("id", "v", "floor").mapInPandas(choose, "id long, cell int")
        shards = pairs.withColumn("slice", F.explode(F.sequence(F.lit(0), n_slices - 1)))
        at = shards.join(asking.select("id", "v", "floor", "block", F.col("cell").alias("_cell"), F.col("slice").alias("_slice")), "id")
        return at.where((F.col("cell") != F.col("_cell")) | (F.col("slice") != F.col("_slice")))

    seen = visit(homes.withColumn("floor", F.lit(None).cast("long")), "home-results")
    for near, name in ((True, "near-results"), (False, "other-results")):
        seen = seen.unionByName(visit(promising(homes.join(floors(seen), "id", "left"), near), name))
    return seen
