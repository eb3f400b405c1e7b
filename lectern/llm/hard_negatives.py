"""Hard negatives by a vector-approximation file: bounds from a few bits a component, exact scores only where these leave it open.

The rows are packed into slices of bounded size, where they lie, without a shuffle. A slice holds, for each component, the
marks of sixteen cells of about equal share and each row's cell in four bits. For an anchor every component has a table
of the least and the largest product that each cell allows; two components share one byte and one table of 256 sums, so the
bounds of a row are a sum of lookups. Only rows whose upper bound reaches what the search still needs, and whose lower bound
is not beyond its window, are scored exactly.

Two searches use that: each anchor's best rows of its own label (positives), and for each positive the best rows of other labels
in the window below its score. Anchors go in blocks to every slice; a block and a slice leave a few rows an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .exact_topk import scaled

POSITIVES, NEGATIVES, CLASSES = 5, 5, 10
#: Components in a slice, anchors in a block, rows and anchors in a step, and pairs scored at once.
SLICE_VALUES, BLOCK_ANCHORS, STEP_ROWS, STEP_ANCHORS, STEP_PAIRS = 1 << 21, 512, 2048, 128, 1 << 16
#: Cells of a component: two of them share a byte.
CELLS = 16
SLICE = "dim int, lane int, ids binary, labels binary, x binary, codes binary, low binary, high binary"


def cells_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, low, high): two components' cells in a byte, and the least and largest value in each cell, exact for these rows.

    Cells are cut at quantiles of the rows; ``low`` and ``high`` have a row for each component (an even number, the last one
    all 0 if need be) and are 0 for cells without rows.
    """
    n, dim = x.shape
    even = dim + dim % 2
    codes, low, high = np.zeros((n, even), np.uint8), np.zeros((even, CELLS), np.int64), np.zeros((even, CELLS), np.int64)
    for d in range(dim):
        column = x[:, d]
        ordered = np.sort(column)
        cuts = ordered[[n * c // CELLS for c in range(1, CELLS)]]
        codes[:, d] = np.searchsorted(cuts, column, "right")
        bounds = np.searchsorted(ordered, cuts, "left")
        starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [n]])
        full = ends > starts
        low[d, full], high[d, full] = ordered[starts[full]], ordered[ends[full] - 1]
    return (codes[:, ::2] * CELLS + codes[:, 1::2]).astype(np.uint8), low, high


def lookup(q: np.ndarray, low: np.ndarray, high: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(least, most): for each pair of components, byte and anchor (rows of ``q``) what the product may be."""
    wide = np.zeros((len(low), len(q)), np.int64)
    wide[: q.shape[1]] = q.T
    a, b = low[:, :, None] * wide[:, None, :], high[:, :, None] * wide[:, None, :]

    def paired(t: np.ndarray) -> np.ndarray:
        return (t[::2, :, None, :] + t[1::2, None, :, :]).reshape(len(low) // 2, CELLS * CELLS, len(q)).astype(kind)

    return paired(np.minimum(a, b)), paired(np.maximum(a, b))


def summed(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The bound of each row (of ``codes``) for each anchor."""
    total = tables[0][codes[:, 0]]
    for j in range(1, codes.shape[1]):
        total += np.take(tables[j], codes[:, j], axis=0)
    return total


def scores(x: np.ndarray, q: np.ndarray, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    out = [np.einsum("ij,ij->i", x[rows[i : i + STEP_PAIRS]], q[anchors[i : i + STEP_PAIRS]]) for i in range(0, len(rows), STEP_PAIRS)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Best:
    """The ``k`` best (score, smaller id first) of each of ``n`` searches, filled step by step."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.at, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(n, np.iinfo(np.int64).min)  # what a newcomer has to reach

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        at, score, ids = np.concatenate([self.at, at]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k
        self.at, self.score, self.id = at[kept], score[kept], ids[kept]
        last = place == self.k - 1
        self.floor[at[last]] = score[last]


def kind_for(x: np.ndarray, q: np.ndarray) -> type:
    """A float that holds every possible sum of products exactly, if one does, else the long."""
    most = x.shape[1] * max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(q).max(initial=0)))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Slice:
    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        small = len(row["x"]) == 2 * len(self.ids) * row["dim"]
        self.x = np.frombuffer(row["x"], np.int16 if small else np.int64).reshape(len(self.ids), -1).astype(np.int64)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(len(self.ids), -1)
        self.low, self.high = (np.frombuffer(row[k], np.int64).reshape(-1, CELLS) for k in ("low", "high"))

    def positives(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, k: int) -> Best:
        """For each anchor the best rows here of its label and another id. Rows lie by label, so only these are looked at."""
        best, kind = Best(len(ids), k), kind_for(self.x, q)
        for label in np.unique(labels):
            lo, hi = np.searchsorted(self.labels, [label, label + 1])
            mine = np.flatnonzero(labels == label)
            for a in range(0, len(mine), STEP_ANCHORS):
                who = mine[a : a + STEP_ANCHORS]
                least, most = lookup(q[who], self.low, self.high, kind)
                for r in range(lo, hi, STEP_ROWS):
                    end = min(r + STEP_ROWS, hi)
                    other = self.ids[r:end, None] != ids[who]
                    under = np.where(other, summed(least, self.codes[r:end]), np.iinfo(np.int64).min if kind is np.int64 else -np.inf)
                    need = best.floor[who].astype(kind)
                    if end - r >= k:  # the k-th least bound is reached by k rows
                        need = np.maximum(need, np.partition(under, end - r - k, axis=0)[end - r - k])
                    row, col = np.nonzero(other & (summed(most, self.codes[r:end]) >= need))
                    best.add(who[col], scores(self.x, q, row + r, who[col]), self.ids[row + r])
        return best

    def negatives(self, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Best:
        """For each anchor and window [low, high] (anchors x windows; search ``anchor * windows + window``) the best rows of other labels in it."""
        n, w = low.shape
        best, kind = Best(n * w, k), kind_for(self.x, q)
        for a in range(0, n, STEP_ANCHORS):
            who = np.arange(a, min(a + STEP_ANCHORS, n))
            least, most = lookup(q[who], self.low, self.high, kind)
            for r in range(0, len(self.ids), STEP_ROWS):
                end = min(r + STEP_ROWS, len(self.ids))
                under, over = summed(least, self.codes[r:end]), summed(most, self.codes[r:end])
                floors = np.maximum(low[who], best.floor.reshape(n, w)[who])
                may = np.zeros(under.shape, bool)
                for j in range(w):
                    may |= (over >= floors[:, j].astype(kind)) & (under <= high[who, j].astype(kind))
                row, col = np.nonzero(may & (self.labels[r:end, None] != labels[who]))
                exact = scores(self.x, q, row + r, who[col])
                for j in range(w):
                    fits = (exact >= floors[col, j]) & (exact <= high[who[col], j])
                    best.add(who[col[fits]] * w + j, exact[fits], self.ids[row[fits] + r])
        return best


def slices(rows: DataFrame, lanes: int, slice_values: int = SLICE_VALUES) -> DataFrame:
    """Rows (id, label, v) of each partition packed as they come, one length of vector a slice; ``lane`` deals slices out."""

    def pack(dim: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lane: int) -> pa.RecordBatch:
        ids, labels, x = (np.concatenate(part) for part in zip(*held))
        order = np.argsort(labels, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        codes, low, high = cells_of(x)
        small = x.astype(np.int16) if np.abs(x).max() < 2**15 else x
        packed = [a.tobytes() for a in (ids, labels, small, codes, low, high)]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([lane], pa.int32()), *[pa.array([p], pa.binary()) for p in packed]], ["dim", "lane", "ids", "labels", "x", "codes", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        lane = TaskContext.get().partitionId()
        for batch in batches:
            v = batch.column("v")
            lengths = np.diff(v.offsets.to_numpy())
            flat, ids, labels = v.flatten().to_numpy(), batch.column("id").to_numpy(), batch.column("label").to_numpy()
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((ids[at], labels[at], x))
                if sum(len(p[0]) for p in held[dim]) * dim >= slice_values:
                    yield pack(dim, held.pop(dim), lane % lanes)
                    lane += 1
        for dim, parts in sorted(held.items()):
            yield pack(dim, parts, lane % lanes)
            lane += 1

    return rows.mapInArrow(run, SLICE)


def each_slice(blocks: DataFrame, parts: DataFrame, lanes: int, work, schema: str) -> DataFrame:
    """``work(slice, block)`` -> RecordBatch for each block of anchors (dim, a) and each slice of their length.

    Every block goes to every lane and meets the slices there: anchors are repeated, rows are not.
    """
    asked = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(lanes, "dim", "lane")
    met = asked.join(parts.repartition(lanes, "dim", "lane"), ["dim", "lane"]).select("dim", "a", "ids", "labels", "x", "codes", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part = Slice({k: row.column(k)[0].as_py() for k in ("dim", "ids", "labels", "x", "codes", "low", "high")})
                block = {f.name: row.column("a").flatten().field(f.name) for f in row.column("a").type.value_type}
                yield work(part, block)

    spark = blocks.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        return durable(met.mapInArrow(run, schema), "negative-search")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def ranked(found: DataFrame, keys: list[str], id_col: str, score: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def array_of(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def prepared(vectors: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, label) of the rows that take part."""
    named = vectors.select(F.col(id_col).alias("_id"), label.cast("long").alias("label"), F.col(vector_col).alias("_v"))
    return scaled(named.where("label is not null"), "_id", "_v", ("label",))


def mine(vectors: DataFrame, label: Column, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", slice_values: int = SLICE_VALUES, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``every`` divides. ``label`` is the label of a row; rows with a null id, label or vector,
    an empty vector, or a null or non-finite component take no part. Scores are integer inner products of components floor(256 x),
    which exist for vectors of one length. An anchor's positives are its best ``positives`` rows of its label and another id;
    a positive's negatives are the best ``negatives`` rows of other labels with ``low_percent`` to 100 per cent of its score.
    Ties go to the smaller id. Rows that repeat an id count each; an anchor id that is stored several times asks with its
    smallest (label, vector). Anchors without positives, and positives without negatives, give no row; an empty table gives
    none. Sums that might not fit a long are an error.
    """
    spark = vectors.sparkSession
    rows = durable(prepared(vectors, label, id_col, vector_col), "negative-rows")
    n, values, top = rows.agg(F.count("*"), F.sum(F.size("v").cast("long")), F.max(F.size("v") * F.pow(F.array_max(F.transform("v", lambda x: F.abs(x).cast("double"))), F.lit(2)))).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n:
        return empty
    if top >= 2.0**62:
        raise ValueError("a vector is so long that its inner products might not fit a long")
    anchors = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v", F.size("m.v").alias("dim"))
    asking = anchors.count()
    if not asking:
        return empty
    lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-values // slice_values))
    parts = durable(slices(rows, lanes, slice_values), "approximations")
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(-(-asking // block_anchors))).cast("int").alias("block")

    def packed(of: DataFrame, *more: str) -> DataFrame:
        return of.groupBy("dim", block).agg(F.collect_list(F.struct("id", "label", "v", *more)).alias("a"))

    def best_of(part: Slice, a: dict) -> pa.RecordBatch:
        ids = a["id"].to_numpy()
        best = part.positives(ids, a["label"].to_numpy(), array_of(a["v"], part.x.shape[1]), positives)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[best.at], best.id, best.score)], ["anchor_id", "positive_id", "positive_score"])

    found = each_slice(packed(anchors), parts, lanes, best_of, "anchor_id long, positive_id long, positive_score long")
    pairs = durable(ranked(found, ["anchor_id"], "positive_id", "positive_score", positives).drop("rank"), "positives")
    windows = pairs.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("s"))
    # padded to one width by windows that nothing enters
    least = F.transform("s", lambda x: F.ceil(x * F.lit(low_percent).cast("decimal(20,0)") / 100).cast("long"))
    pad = lambda c, value: F.concat(c, F.array_repeat(F.lit(value).cast("long"), positives - F.size(c)))
    wanted = anchors.join(windows.select("id", pad(least, 1 << 62).alias("low"), pad(F.col("s"), 0).alias("high")), "id")

    def within(part: Slice, a: dict) -> pa.RecordBatch:
        ids, low, high = a["id"].to_numpy(), array_of(a["low"], positives), array_of(a["high"], positives)
        best = part.negatives(a["label"].to_numpy(), array_of(a["v"], part.x.shape[1]), low, high, negatives)
        who = best.at // positives
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[who], high[who, best.at % positives], best.id, best.score)], ["anchor_id", "positive_score", "negative_id", "negative_score"])

    near = each_slice(packed(wanted, "low", "high"), parts, lanes, within, "anchor_id long, positive_score long, negative_id long, negative_score long")
    hard = ranked(near, ["anchor_id", "positive_score"], "negative_id", "negative_score", negatives)
    return pairs.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The labels that the query mines with: rows whose id 7 divides have the next one.
ORACLE = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id, m.lab, m.v from (select vec_id, min({'lab': lab, 'v': v}) m from e where vec_id % 100 = 0 group by vec_id)),
p as (select q.vec_id a, q.lab al, c.vec_id b, c.lab bl, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) score
  from q join e c on len(q.v) = len(c.v)),
pos as (select *, row_number() over (partition by a order by score desc, b) r from p where al = bl and a <> b qualify r <= 5),
f as (select pos.a, pos.b, pos.r, pos.score ps, n.b nb, n.score ns, cast(row_number() over (partition by pos.a, pos.r order by n.score desc, n.b) as integer) k
  from pos join p n on n.a = pos.a and n.al <> n.bl and 80 * pos.score <= 100 * n.score and n.score <= pos.score)
select a anchor_id, b positive_id, k as rank, nb negative_id, ps positive_score, ns negative_score from f where k <= 5"""
