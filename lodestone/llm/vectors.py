"""What the vector operators share: cleaning, matrices, k-means on a bounded sample, and block keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(name: str) -> Column:
    """Whether the vector is there, has a component that is not zero, and none that is null, NaN or infinite."""
    v = F.col(name)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x.isNotNull() & (x != 0)), F.lit(False))


def length_of(name: str) -> Column:
    """The number of components."""
    return F.size(name)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length and without nulls, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        parts = [matrix(c) for c in column.chunks if len(c)]
        return np.concatenate(parts) if parts else np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sample(df: DataFrame, id_col: str, vector: str, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, those with the smallest hashes of their ids: the same for any partitioning."""
    return matrix(df.select(id_col, vector).orderBy(F.xxhash64(F.lit(11), id_col), id_col).limit(rows).toArrow().column(vector))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre and the squared distance to it, a few points at a time."""
    own, far = np.empty(len(points), np.int64), np.empty(len(points))
    step = max(1, (1 << 22) // len(centres))
    for at in range(0, len(points), step):
        d = squared_distances(points[at : at + step], centres)
        own[at : at + step] = d.argmin(1)
        far[at : at + step] = d[np.arange(len(d)), own[at : at + step]]
    return own, far


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds; empty centres move to the points that lie worst."""
    k = max(1, min(k, len(points)))
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own, far = nearest(points, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        worst = iter(np.argsort(-far))
        for c in range(k):
            centres[c] = sums[c] / counts[c] if counts[c] else points[next(worst)]
    return centres
