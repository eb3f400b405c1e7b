"""Centroid clustering over weighted distinct vectors: Lloyd's rounds in exact integers.

Rows with one quantised vector are one point with a multiplicity, found by an aggregation before anything else. The rounds
read the points alone: each task sums weighted components by cluster, Spark adds the tasks' sums, and the driver holds no
more than the centroids. At the end the points' clusters go back to the rows; a point of over a thousandth of all rows is
broadcast there (at most a thousand of these exist), so no join key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .exact_topk import scaled

CLUSTERS, ROUNDS, DIM, SEED = 40, 5, 64, "2"
#: A point with more than this share of all rows goes back to its rows by broadcast.
HOT_SHARE = 1 / 1000
#: Components are below this, so that squared distances fit a long at up to ``2**12`` components.
MOST = 1 << 24


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of ``x``, the smaller cluster on ties; exact integers."""
    top = max(1, int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * x.shape[1] * top * top < 2**53:
        x, centres = x.astype(np.float64), centres.astype(np.float64)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    best = d.argmin(axis=1)
    return best.astype(np.int32), d[np.arange(len(d)), best].astype(np.int64)


def components(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def points(rows: DataFrame) -> DataFrame:
    """(v, n): the distinct vectors of ``rows`` (id, v) with their multiplicities."""
    return rows.groupBy("v").agg(F.count("*").alias("n"))


def first_centres(rows: DataFrame, k: int, seed: str = SEED) -> np.ndarray:
    """The vectors of the ``k`` rows whose id's hash comes first; equal hashes (repeated ids) by the vector."""
    found = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def weighted_sums(weighted: DataFrame, centres: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (rows, sum of each component) of the points nearest to each of ``centres``; the sums are Python integers."""
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centres), object), np.zeros((len(centres), dim), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = components(batch.column("v"), dim), batch.column("n").to_numpy()
            near, _ = nearest(x, centres)
            order = np.argsort(near, kind="stable")
            at, first = np.unique(near[order], return_index=True)
            fits = int(n.sum()) * MOST < 2**62
            w = (x if fits else x.astype(object))[order] * n[order][:, None]
            total[at] += np.add.reduceat(w, first, axis=0).astype(object)
            count[at] += np.add.reduceat(n[order], first).astype(object)
        used = np.flatnonzero(count)
        sums = [[Decimal(int(s)) for s in total[c]] for c in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([int(count[c]) for c in used], pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], ["cluster", "n", "sums"])

    parts = weighted.mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    by_component = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in by_component.collect():  # clusters x components
        out.setdefault(r["cluster"], (r["n"], [0] * dim))[1][r["i"]] = int(r["s"])
    return out


def lloyd(weighted: DataFrame, centres: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds``: exact floors of the means; a centroid without rows stays. Ends early once nothing moves."""
    for _ in range(rounds):
        moved = centres.copy()
        for c, (n, sums) in weighted_sums(weighted, centres).items():
            moved[c] = [s // n for s in sums]
        if (moved == centres).all():
            break
        centres = moved
    return centres


def assign(weighted: DataFrame, centres: np.ndarray) -> DataFrame:
    """``weighted`` with ``cluster`` and ``distance``."""
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, distance = nearest(components(batch.column("v"), dim), centres)
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("n"), pa.array(near), pa.array(distance)], ["v", "n", "cluster", "distance"])

    return weighted.mapInArrow(run, "v array<bigint>, n long, cluster int, distance long")


def back_to_rows(rows: DataFrame, assigned: DataFrame, total: int) -> DataFrame:
    """(id, cluster, distance) of each of ``rows``; points of over a thousandth of the ``total`` rows by broadcast, so no join key is hot."""
    is_hot = F.col("n") > F.lit(total * HOT_SHARE)
    known = assigned.select("v", "cluster", "distance")
    hot = F.broadcast(known.where(assigned["n"] > F.lit(total * HOT_SHARE)))
    few = rows.join(hot, "v")
    rest = rows.join(F.broadcast(assigned.where(is_hot).select("v")), "v", "left_anti").join(assigned.where(~is_hot).select("v", "cluster", "distance"), "v")
    return few.select("id", "cluster", "distance").unionByName(rest.select("id", "cluster", "distance"))


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``dim`` finite components.

    Components become floor(256 x). The first centroids are the vectors of the ``k`` rows with the smallest sha256 of
    ``seed:id`` (all, if there are fewer; rows that repeat an id count each, the smaller vector first). Rows with a null
    id or vector, another length, or a null or non-finite component take no part; repeated rows all do, each with its own
    row in the result; an empty table gives none. A scaled component of 2**24 or more is an error, as its distances
    might not fit a long. Other columns are never read.
    """
    spark = vectors.sparkSession
    kept = vectors.where(F.size(vectors[vector_col]) == dim)
    rows = durable(scaled(kept, id_col, vector_col), "cluster-rows")
    weighted = durable(points(rows), "cluster-points")
    total, top = weighted.agg(F.sum("n"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not total:
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if top >= MOST:
        raise ValueError(f"a scaled component of {top} is too large: squared distances might not fit a long")
    centres = lloyd(weighted, first_centres(rows, k, seed), rounds)
    assigned = durable(assign(weighted, centres), "cluster-assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(20,0)") * F.col("distance")).alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    info = spark.createDataFrame([(c, s, sum(inertia.values()), sha[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return back_to_rows(rows, assigned, total).withColumnRenamed("id", id_col).join(F.broadcast(info), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED) -> str:
    """The same in SQL: one pair of subqueries a round."""
    def assigned(r: int) -> str:
        d = "list_sum(list_transform(range(1, %d), lambda i: (e.v[i] - c.c[i]) * (e.v[i] - c.c[i])))::bigint" % (dim + 1)
        return f"a{r} as materialized (select rid, vec_id, v, (b).k k, (b).d d from (select rid, vec_id, v, min({{'d': {d}, 'k': k}}) b from e, c{r} c group by all))"

    def centred(r: int) -> str:
        mean = "(sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*)"
        return f"c{r + 1} as materialized (select k, coalesce(m.c, c.c) c from c{r} c left join (select k, list(f order by i) c from (select k, i, cast({mean} as bigint) f from a{r}, range(1, {dim + 1}) t(i) group by k, i) group by k) m using (k))"

    steps = ",\n".join(x for r in range(rounds) for x in (assigned(r), centred(r)))
    return f"""
with e as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where vec_id is not null and len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 k, v c from e qualify k < {k}),
{steps},
{assigned(rounds)}
select vec_id, cast(a.k as integer) cluster, d distance, cast(sum(d) over (partition by a.k) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia,
  sha256(array_to_string(c.c, ',')) centroid_sha256 from a{rounds} a join c{rounds} c on a.k = c.k"""
