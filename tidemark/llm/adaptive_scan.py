"""Approximate nearest neighbours by cosine: inverted lists with adaptive dimension scanning.

Unit vectors are rotated by a random orthogonal matrix, so that any prefix of the coordinates is a
fair sample of the distance. Every vector goes to its nearest centroid's list; a query probes the
nearest lists. Within a list, candidates are scanned in column blocks: after d of D coordinates a
candidate is abandoned when the hypothesis that its whole distance is within the current k-th best
is rejected, that is when partial * D / d > threshold * (1 + eps / sqrt(d)) ** 2. Survivors get the
exact cosine of the original vectors in double precision.

Centroids are fitted on a bounded sample (`sample`), every vector is indexed. Lists are cut into
cells of about `cell` vectors by a hash of the id, and the queries that probe a list into groups, so
a hot list (a vector with very many copies) is many small tasks; its copies are all scanned.

There are about as many lists as the square root of the vectors (64 at least where there are enough, and
at most an eighth of the sample, which could not place more), and a query probes `probe_share` of them.

Edge cases: vectors that are null, zero, of another length than the most frequent one (of equally
frequent ones the longest), or hold null or non-finite components take no part; rows are told apart by place, so
other rows with a query's id are candidates, and each row of a repeated query id has its own ranks; with fewer than
k candidates all are returned; ties go to the smaller id; components of any size are safe, as vectors are scaled
by powers of two before they are squared; without vectors the result is empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written
from .workers import lean, lean_group


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def balanced(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means on distinct rows; at most k centroids."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]]
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1))
        c = np.where((norm > 1e-9)[:, None], sums / np.maximum(norm, 1e-9)[:, None], c)
    return c


def nearest(x: np.ndarray, centroids: np.ndarray, n: int, step: int = 4096) -> np.ndarray:
    """The n centroids of largest cosine for each row, nearest first."""
    n = min(n, len(centroids))
    out = np.empty((len(x), n), np.int64)
    for i in range(0, len(x), step):
        score = -(x[i : i + step] @ centroids.T)
        part = np.argpartition(score, n - 1, axis=1)[:, :n] if n < len(centroids) else np.broadcast_to(np.arange(n), score.shape)
        out[i : i + step] = np.take_along_axis(part, np.argsort(np.take_along_axis(score, part, 1), axis=1, kind="stable"), 1)
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def cosine(q: np.ndarray, x: np.ndarray, x_norms: np.ndarray) -> np.ndarray:
    """Exact cosines of one balanced vector with the balanced rows of x; equal rows give equal values."""
    return (x * q).sum(1) / (math.sqrt((q * q).sum()) * x_norms)


def scan(q: np.ndarray, qr: np.ndarray, q_row: int, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, x_norms: np.ndarray, columns: list[np.ndarray], k: int, eps: float) -> list[tuple[int, float]]:
    """The k best of a cell for one query. columns: the rotated unit vectors in column blocks; rows in order of id."""
    dim = len(qr)
    best_ids, best, threshold = np.zeros(0, np.int64), np.zeros(0), math.inf
    lo = 0
    while lo < len(ids):
        hi = min(len(ids), lo + (64 if lo == 0 else 1024))
        alive = np.arange(lo, hi)
        partial, d = np.zeros(hi - lo), 0
        for block in columns if threshold < math.inf else ():  # before there are k, none can be abandoned
            width = block.shape[1]
            gap = block[alive] - qr[d : d + width]
            partial = partial + (gap * gap).sum(1)
            d += width
            if d < dim:
                keep = partial * (dim / d) <= threshold * (1 + eps / math.sqrt(d)) ** 2 + 1e-12
                alive, partial = alive[keep], partial[keep]
                if not len(alive):
                    break
        alive = alive[rows[alive] != q_row]
        if len(alive):
            score = np.concatenate([best, cosine(q, x[alive], x_norms[alive])])
            found = np.concatenate([best_ids, ids[alive]])
            order = np.lexsort((found, -score))[:k]
            best_ids, best = found[order], score[order]
            if len(best) == k:
                threshold = max(0.0, 2 - 2 * best[-1])
        lo = hi
    return list(zip(best_ids.tolist(), best.tolist(), strict=True))


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, lists: int | None = None, probe_share: float = 0.62, sample: int = 20_000, cell: int = 4096, query_group: int = 512, eps: float = 2.1, block: int = 16, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query row.

    lists: inverted lists, if not by the number of vectors; probe_share: share of them that a query reads.
    """
    prepare(vectors.sparkSession)
    v = F.col(vec_col).cast("array<double>")
    sane = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf)) & F.exists(v, lambda e: e != 0)
    base = vectors.filter(sane).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("q"), F.monotonically_increasing_id().alias("row"))
    total = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if total is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim, n = total["dim"], total["count"]
    base = base.filter(F.size("v") == dim)
    lists = min(lists or max(round(math.sqrt(n)), min(64, n // 8), 1), max(1, sample // 8))
    probes = max(1, math.ceil(lists * probe_share))
    near = base.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, min(1 << 20, math.ceil((1 << 20) * 1.2 * sample / n))))
    picked = near.orderBy(F.xxhash64("id"), "id", "v").select("v").limit(sample).collect()  # a bounded sample, for the centroids alone
    turn = rotation(dim, seed)
    fit = unit(np.array([r["v"] for r in picked] or [base.first()["v"]])) @ turn
    centroids = kmeans(fit, lists, 8, seed)

    def assign(batches):
        for b in batches:
            x = unit(_matrix(b.column(1))) @ turn if b.num_rows else np.zeros((0, dim))
            q = np.array(b.column(2).to_pylist(), bool)
            near = nearest(x, centroids, probes) if len(x) else np.zeros((0, 1), np.int64)
            rows = np.arange(len(x))
            who = np.concatenate([rows, np.repeat(rows[q], near.shape[1])])
            home = np.concatenate([near[:, 0], near[q].ravel()])
            kind = np.concatenate([np.zeros(len(x), bool), np.ones(len(home) - len(x), bool)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), b.column(1).take(pa.array(who)), pa.array(home, pa.int64()), pa.array(kind), b.column(3).take(pa.array(who))], names=["id", "v", "list", "q", "row"])

    placed = written(base.mapInArrow(lean("ann", assign), "id long, v array<double>, list long, q boolean, row long"), "ann")
    sizes = {r["list"]: (r["n"], r["m"]) for r in placed.groupBy("list").agg(F.count(F.when(~F.col("q"), 1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("m")).collect()}  # at most `lists` rows
    cells = F.create_map(*[F.lit(x) for i, (a, _) in sizes.items() for x in (i, max(1, -(-a // cell)))])
    groups = F.create_map(*[F.lit(x) for i, (_, b) in sizes.items() for x in (i, max(1, -(-b // query_group)))])
    n_cells, n_groups = F.element_at(cells, F.col("list")), F.element_at(groups, F.col("list"))
    # A cell's vectors go to each group of queries and a group's queries to each cell of the list.
    home = F.when(F.col("q"), F.transform(F.sequence(F.lit(0), n_cells - 1), lambda c: F.struct(c.alias("c"), F.pmod(F.xxhash64("id"), n_groups).cast("int").alias("g")))).otherwise(
        F.transform(F.sequence(F.lit(0), n_groups - 1), lambda g: F.struct(F.pmod(F.xxhash64("id"), n_cells).cast("int").alias("c"), g.alias("g")))
    )
    dealt = placed.select("id", "v", "q", "list", "row", F.explode(home).alias("at")).select("id", "v", "q", "list", "row", "at.c", "at.g")

    def within(t: pa.Table) -> pa.Table:
        q = np.array(t["q"].to_pylist(), bool)
        ids, rows, x = t["id"].to_numpy(), t["row"].to_numpy(), balanced(_matrix(t["v"]))
        order = np.lexsort((rows, ids, q))
        ids, rows, x, q = ids[order], rows[order], x[order], q[order]
        n_rows = int((~q).sum())
        r = unit(x) @ turn if len(x) else x
        lengths = norms(x[:n_rows])
        own = [np.ascontiguousarray(r[:n_rows, d : d + block]) for d in range(0, dim, block)]
        out = [(int(ids[i]), int(rows[i]), j, s) for i in range(n_rows, len(ids)) for j, s in scan(x[i], r[i], rows[i], rows[:n_rows], ids[:n_rows], x[:n_rows], lengths, own, k, eps)]
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "row": pa.array(cols[1], pa.int64()), "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.float64())})

    found = dealt.groupBy("list", "c", "g").applyInArrow(lean_group("ann", within), "query_id long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
