"""Byte n-gram features in numpy, and bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Multiplier of the hash that maps three bytes to a bucket (odd, from the golden ratio).
MIX = np.uint32(2654435769)


def trigram_buckets(data: bytes, bits: int) -> np.ndarray:
    """Bucket of every three consecutive bytes of ``data``."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = b[:-2].astype(np.uint32)
    code <<= np.uint32(8)
    code |= b[1:-1]
    code <<= np.uint32(8)
    code |= b[2:]
    code *= MIX
    code >>= np.uint32(32 - bits)
    return code.astype(np.int64)


def sample_labelled(rows: DataFrame, id_col: str, label_col: str, per_label: int) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each label (all, where there are fewer), and the number of rows of each label.

    A row is taken if the hash of its id falls under its label's share, so the sample is the same on every run,
    needs no sort, and its size has a bound: ``per_label`` for each label, within a few standard deviations.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(label_col).isNotNull()).groupBy(label_col).count().collect()}
    if not counts:
        return rows.limit(0), {}
    share = F.lit(0)
    for label, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(label_col) == F.lit(label), F.lit(min(1 << 20, (per_label << 20) // n + 1))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share), counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam steps for a dict of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
