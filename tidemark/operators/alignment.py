"""Alignments of two channels: dynamic programming over antidiagonals, many pairs side by side.

A cell of the cost table needs its neighbours on the two antidiagonals before, so an antidiagonal of all pairs of a batch is
a few array operations, and the table is never held: three antidiagonals are. Pairs are rows, dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fourier import met

CONSTRAINTS = (None, "itakura", "sakoe_chiba")
#: Numbers of an antidiagonal of a batch: pairs times their length.
BATCH = 65_536


def band(n: int, m: int, k: int, constraint: str | None) -> tuple[int, int]:
    """First and last i of the cells (i, k - i) that a path may pass: all; a parallelogram of slopes 1/2 to 2; or a band of one step.

    Places count as shares of the series' lengths, brought to one denominator: whole numbers.
    """
    low, high = max(0, k - m + 1), min(k, n - 1)
    p, q = max(n - 1, 1), max(m - 1, 1)
    up = lambda a, b: -(-a // b)
    if constraint is None:
        return low, high
    if constraint == "sakoe_chiba":
        return max(low, up(k * p - min(p, q), p + q)), min(high, (k * p + min(p, q)) // (p + q))
    if constraint == "itakura":
        first = max(low, up(k * p, p + 2 * q), up(2 * k * p - p * q, q + 2 * p))
        return first, min(high, 2 * k * p // (q + 2 * p), (p * q + k * p) // (p + 2 * q))
    raise KeyError(constraint)


def _last(x: np.ndarray, y: np.ndarray, cell: Callable, outside: float, corner: float, constraint: str | None, whole: bool) -> np.ndarray:
    """The last cell of each pair's table over x (times, pairs) and y; cell(xi, yj, corner, up, left, allowed) makes cells of their neighbours.

    outside: what a cell beyond the table or the band counts as; corner: the one before the first. whole: also cells that the
    constraint doesn't allow are made.
    """
    n, m = len(x), len(y)
    back = y[::-1]
    # Place i + 1 of a diagonal is cell (i, k - i); place 0 lies outside.
    one, two = (np.full((n + 1, x.shape[1]), outside) for _ in range(2))
    two[0] = corner
    for k in range(n + m - 1):
        allowed = band(n, m, k, constraint)
        lo, hi = band(n, m, k, None) if whole else allowed
        now = np.full_like(one, outside)
        if lo <= hi:
            i = np.arange(lo, hi + 1)[:, None]
            inside = (i >= allowed[0]) & (i <= allowed[1])
            now[lo + 1 : hi + 2] = cell(x[lo : hi + 1], back[m - 1 - k + lo : m - k + hi], two[lo : hi + 1], one[lo : hi + 1], one[lo + 1 : hi + 2], inside)
        two, one = one, now
    return one[n]


def _aligned(mts: DataFrame, name: str, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Edges of value(x, y), arrays (times, pairs) of pairs of equal lengths; a missing value makes the pair's null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x"), b.column("y")
            n, m = (c.value_lengths().to_numpy(zero_copy_only=False) for c in (x, y))
            out = np.full(len(b), np.nan)
            for u, v in np.unique(np.stack([n, m], 1), axis=0):
                rows, size = np.flatnonzero((n == u) & (m == v)), max(1, BATCH // int(u))
                for start in range(0, len(rows), size):
                    at = rows[start : start + size]
                    side = lambda c, k: c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), k).T.copy()  # noqa: B023, E731
                    out[at] = value(side(x, u), side(y, v))
            cells = pa.array(out, mask=np.isnan(out))
            yield pa.RecordBatch.from_arrays([b.column("dataset_id"), pa.array([name] * len(b), pa.string()), b.column("i"), b.column("j"), cells], names=["dataset_id", "spi", "i", "j", "value"])

    # Pairs are few bytes and much work: all shuffle partitions get some.
    parts = int(mts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = met(mts).select("dataset_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "x", "y").repartition(parts, "dataset_id", "i", "j")
    return rows.mapInArrow(run, "dataset_id string, spi string, i int, j int, value double")


def _name(base: str, constraint: str | None) -> str:
    return f"{base}_{constraint}" if constraint else base


def dynamic_time_warping(mts: DataFrame, constraint: str | None = None) -> DataFrame:
    """Root of the least sum of squared differences along a path."""
    cell = lambda x, y, corner, up, left, _: (x - y) ** 2 + np.minimum(np.minimum(corner, up), left)
    return _aligned(mts, _name("dtw", constraint), lambda x, y: np.sqrt(_last(x, y, cell, np.inf, 0.0, constraint, False)))


def soft_dynamic_time_warping(mts: DataFrame, constraint: str | None = None, gamma: float = 1.0) -> DataFrame:
    """The same with a soft minimum: -gamma * ln(sum of exp(-cost / gamma)) over paths."""

    def cell(x, y, corner, up, left, _):
        low = np.minimum(np.minimum(corner, up), left)
        base = np.where(np.isinf(low), 0.0, low)
        soft = low - gamma * np.log(np.maximum(sum(np.exp((base - c) / gamma) for c in (corner, up, left)), 1e-300))
        return (x - y) ** 2 + np.where(np.isinf(low), low, soft)

    return _aligned(mts, _name("softdtw", constraint), lambda x, y: _last(x, y, cell, np.inf, 0.0, constraint, False))


def common_subsequence(mts: DataFrame, constraint: str | None = None, eps: float = 1.0) -> DataFrame:
    """Length of the longest common subsequence, values within eps being equal, over the shorter length; only allowed cells may match."""
    cell = lambda x, y, corner, up, left, inside: np.maximum(np.maximum(up, left), np.where(inside & (np.abs(x - y) <= eps), corner + 1, 0.0))
    return _aligned(mts, _name("lcss", constraint), lambda x, y: _last(x, y, cell, 0.0, 0.0, constraint, True) / min(len(x), len(y)))
