"""Connected components over an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, sweep

MAX_ROUNDS = 60
#: Up to so many edges (1 MB) are one partition, whose rounds need no shuffle; more are dealt out.
FEW_EDGES = 1 << 16


def _star(edges: DataFrame, large: bool, fit: Callable) -> DataFrame:
    """Point neighbours at the smallest member of each neighbourhood: larger ones, or the node itself and smaller ones."""
    both = fit(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = fit(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))))
    return out.where("u <> v")


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v long); component is the smallest node reachable.

    Each round is written to the shared folder, so lineage stays short; rounds grow with the logarithm of the
    longest chain. Edges never leave the executors. Self-edges are ignored; no edges give no rows.
    """
    now = durable(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = _state(now)
    fit = lambda df: df.coalesce(1) if before[0] <= FEW_EDGES else df
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        new = durable(_star(_star(fit(now), True, fit), False, fit).distinct(), "edges")
        discard(now)
        sweep(edges.sparkSession)
        now, after = new, _state(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return fit(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")))).distinct()
