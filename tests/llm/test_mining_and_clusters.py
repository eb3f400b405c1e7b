"""Hard negatives and clusters against plain loops, on tables with ties, repeated rows, nulls and several lengths."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import clustering, hard_negatives

KINDS = "vec_id long, embedding array<float>, label int, id string, v string, n int, Cluster int, lane int, rank string"


def quantised(x):
    return [math.floor(256 * float(np.float32(c))) for c in x]


def usable(row):
    return row[0] is not None and row[1] is not None and len(row[1]) > 0 and all(c is not None and math.isfinite(c) for c in row[1])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, "z") for r in rows], KINDS)


def messy(n, dim, seed, coarse=4):
    """Vectors on a coarse grid, so that scores tie; some rows repeated, some unusable, some of another length."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-coarse, coarse + 1) / coarse for _ in range(dim)], rng.randrange(10)) for i in range(n)]
    rows += rows[: n // 5] + [(i, [1.0] * dim, 3) for i in range(n, n + n // 3)]
    rows += [(None, [0.5] * dim, 1), (7, None, 1), (9, [0.5] * (dim - 1) + [None], 2), (11, [float("nan")] + [0.1] * (dim - 1), 2), (13, [float("inf")] * dim, 3), (14, [0.5] * dim, None), (15, [], 1)]
    rows += [(200 + i, [rng.random() for _ in range(dim + 1)], i % 10) for i in range(40)]
    rng.shuffle(rows)
    return rows


def mined(rows, every=100, low=80):
    rows = [(i, quantised(v), (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows if usable((i, v)) and l is not None]
    first = {}
    for i, v, l in rows:
        if i % every == 0:
            first[i] = min(first.get(i, (l, v)), (l, v))
    out = []
    for a, (label, q) in first.items():
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), i, l) for i, v, l in rows if len(v) == len(q)), key=lambda s: s[:2])
        for s, p, _ in [s for s in scored if s[2] == label and s[1] != a][:5]:
            window = [(i, -n) for n, i, l in scored if l != label and low * -s <= 100 * -n <= 100 * -s][:5]
            out += [(a, p, r + 1, i, -s, n) for r, (i, n) in enumerate(window)]
    return sorted(out)


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("dim, every, slice_values, block", [(8, 10, 1 << 21, 512), (5, 7, 400, 3), (3, 1, 64, 16)])
def test_hard_negatives_are_those_of_a_plain_loop(spark, dim, every, slice_values, block):
    rows = messy(150, dim, dim)
    got = hard_negatives.mine(table(spark, rows).repartition(3), label(), every, slice_values=slice_values, block_anchors=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows, every)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_hard_negatives_of_large_components_and_of_nothing(spark):
    rows = [(i, [x * 3e6 for x in v] if v and all(c is not None for c in v) else v, l) for i, v, l in messy(60, 4, 1)]
    assert sorted(map(tuple, hard_negatives.mine(table(spark, rows), label(), 10).collect())) == mined(rows, 10)
    assert hard_negatives.mine(table(spark, rows).limit(0), label()).collect() == []
    assert hard_negatives.mine(table(spark, rows).where("vec_id % 100 <> 0"), label()).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.mine(table(spark, [(0, [1e8, 1e8], 1), (1, [1e8, 1e8], 1)]).withColumn("embedding", F.transform("embedding", lambda x: x * 100)), label())


def test_bounds_of_cells_hold_the_scores():
    rng = np.random.default_rng(3)
    for dim in (1, 6, 7):
        x, q = rng.integers(-150, 150, (500, dim)), rng.integers(-150, 150, (20, dim))
        codes, low, high = hard_negatives.cells_of(x)
        least, most = hard_negatives.lookup(q, low, high, np.float32)
        exact, under, over = x @ q.T, hard_negatives.summed(least, codes), hard_negatives.summed(most, codes)
        assert (under <= exact).all() and (exact <= over).all()
        assert (over - under).mean() < 0.3 * (exact.max() - exact.min())


def test_few_rows_are_scored_exactly(monkeypatch):
    rng = np.random.default_rng(4)
    x, labels = rng.normal(0, 32, (20000, 32)).astype(np.int64), np.zeros(20000, np.int64)
    codes, low, high = hard_negatives.cells_of(x)
    part = hard_negatives.Slice({"dim": 32, "ids": np.arange(20000).tobytes(), "labels": labels.tobytes(), "x": x.astype(np.int16).tobytes(), "codes": codes.tobytes(), "low": low.tobytes(), "high": high.tobytes()})
    scored, plain = [], hard_negatives.scores
    monkeypatch.setattr(hard_negatives, "scores", lambda a, b, rows, anchors: scored.append(len(rows)) or plain(a, b, rows, anchors))
    best = part.positives(np.arange(10), np.zeros(10, np.int64), x[:10], 5)
    want = [sorted((-int(x[i] @ x[a]), i) for i in range(20000) if i != a)[:5] for a in range(10)]
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist())] == [p for w in want for p in w]
    assert sum(scored) < 0.1 * 10 * 20000


def clustered(rows, k, rounds, dim, seed="2"):
    kept = [(i, quantised(v)) for i, v, _ in rows if usable((i, v)) and len(v) == dim]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centres = [[sum(c) // len(members[j]) for c in zip(*members[j])] if j in members else c for j, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in found)


@pytest.mark.parametrize("dim, k, rounds", [(6, 12, 5), (2, 40, 3), (3, 500, 2)])
def test_clusters_are_those_of_a_plain_loop(spark, dim, k, rounds):
    rows = messy(200, dim, k)
    rows += [(3000 + i, [0.25] * dim, 0) for i in range(200)]  # a third of all rows share one vector
    got = clustering.cluster(table(spark, rows).repartition(5), k, rounds, dim)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == clustered(rows, k, rounds, dim)


def test_points_have_multiplicities_and_centroids_without_rows_stay(spark):
    rows = [(i, [0.5, 0.5], 1) for i in range(50)] + [(60 + i, [-0.5, i / 4], 1) for i in range(4)]
    weighted = clustering.points(clustering.scaled(table(spark, rows), "vec_id", "embedding"))
    assert sorted(r["n"] for r in weighted.collect()) == [1, 1, 1, 1, 50]
    assert sorted(map(tuple, clustering.cluster(table(spark, rows), 20, 5, 2).collect())) == clustered(rows, 20, 5, 2)
    assert clustering.cluster(table(spark, rows).limit(0), 5, 5, 2).collect() == []
    assert clustering.cluster(table(spark, rows), dim=3).collect() == []
    with pytest.raises(ValueError):
        clustering.cluster(table(spark, [(1, [1e6, 1.0], 1)]), 2, 1, 2)
