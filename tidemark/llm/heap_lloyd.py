"""Vector codes by product quantisation: integer Lloyd rounds with heaps of bounds.

Components become integers, vectors are cut into equal parts, and each part position has a codebook. The first
assignment scans every part against all entries and keeps how much further its second-nearest entry is (lower
minus upper bound on the distances). From then on a part needs looking at only when the entries have moved by
more than that: in each block of vectors every entry has a heap of its parts, keyed by their slack plus the
entry's cumulative drift when they came in. Drift of an entry is its own movement plus the largest of any other
entry. A part whose key the cumulative drift has reached is popped, scanned exactly and pushed where it now
belongs; the first key that holds ends the heap, and all parts below stay where they are, unread. Distances and
sums are integers, so the result is that of plain Lloyd rounds.

Blocks (`block` vectors) are rows of a written table, one table a round, with the sums and counts of their
parts; Spark adds these up, and only the codebooks (entries x dimensions numbers) come to the driver and go
out to the tasks.

Edge cases: vectors that are null, empty, or hold null or non-finite components are dropped, and so are those
of another length than the most frequent one (of equally frequent ones the longest); that length must be a
multiple of the parts, and components must be below 2^17 in size, or ValueError says so. With fewer vectors
than entries the codebooks are that small. Equal ids are ordered by their vectors, null ids come last; each row
gets its row. No vectors, no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, prepare, release, written
from .workers import lean

OWNER = "codes"
_STEP = 2048


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest entry (ties to the lower index), and by how much the second-nearest is further."""
    near, slack = np.empty(len(x), np.int64), np.full(len(x), np.inf)
    for lo in range(0, len(x), _STEP):
        gap = x[lo : lo + _STEP, None, :] - book[None]
        d = np.einsum("nkw,nkw->nk", gap, gap)
        near[lo : lo + _STEP] = d.argmin(1)
        if len(book) > 1:
            two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(float))
            slack[lo : lo + _STEP] = two[:, 1] - two[:, 0]
    return near, slack


def reassign(x: np.ndarray, book: np.ndarray, code: np.ndarray, key: np.ndarray, drift: np.ndarray) -> int:
    """Bring one part position of a block up to date with its moved codebook; code and key change in place.

    Returns how many parts were scanned. A key within rounding of the drift counts as reached.
    """
    heaps: list[list[tuple[float, int]]] = [[] for _ in book]
    for i, (j, k) in enumerate(zip(code.tolist(), key.tolist(), strict=True)):
        heaps[j].append((k, i))
    popped = []
    for j, heap in enumerate(heaps):
        heapq.heapify(heap)
        reached = drift[j] + 1e-6 * (1 + drift[j])
        while heap and heap[0][0] <= reached:
            popped.append(heapq.heappop(heap)[1])
    if popped:
        at = np.array(popped)
        near, slack = scan(x[at], book)
        code[at], key[at] = near, slack + drift[near]
        for i, j, k in zip(popped, near.tolist(), key[at].tolist(), strict=True):
            heapq.heappush(heaps[j], (k, i))
    return len(popped)


def sums(x: np.ndarray, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and componentwise sums of the parts of each entry; doubles hold these sums of a block exactly."""
    n = np.bincount(code, minlength=entries)
    return n, np.stack([np.bincount(code, x[:, w].astype(float), entries) for w in range(x.shape[1])], 1).astype(np.int64)


def _lists(values, lengths, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def _block(ids: pa.Array, labels: pa.Array, x: np.ndarray, codes: np.ndarray, keys: np.ndarray, entries: int, scanned: int) -> pa.RecordBatch:
    parts = len(codes)
    width = x.shape[1] // parts
    found = [sums(x[:, p * width : (p + 1) * width], codes[p], entries) for p in range(parts)]
    tally = np.concatenate([a.ravel() for n, s in found for a in (n, s)])
    one = lambda v, kind=None: _lists(v, [len(v)], kind)
    # Keys are rounded down, so that a bound stays a bound.
    low = np.nextafter(keys.astype(np.float32), np.float32(-np.inf))
    cols = [one(ids), one(labels), one(x.ravel().astype(np.int32), pa.int32()), pa.array([codes.astype(np.uint8).tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary()), one(tally, pa.int64()), pa.array([scanned], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["ids", "labels", "x", "codes", "keys", "tally", "scanned"])


def _start(books: np.ndarray, block: int):
    """Vectors to blocks: components to integers, the first assignment by a scan of every part."""
    parts, entries, width = books.shape

    def emit(ids, labels, x):
        found = [scan(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
        return _block(ids, labels, x, np.stack([c for c, _ in found]), np.stack([s for _, s in found]), entries, len(x) * parts)

    def run(batches):
        held, n = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, block):
                held.append(b.slice(lo, block))
                n += held[-1].num_rows
                if n >= block:
                    yield whole(held)
                    held, n = [], 0
        if n:
            yield whole(held)

    def whole(held):
        t = pa.Table.from_batches(held).combine_chunks()
        x = integers(np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(t.num_rows, -1))
        return emit(t.column(0).combine_chunks(), t.column(1).combine_chunks(), x)

    return run


def _opened(row) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = row["ids"].values, row["labels"].values
    n = len(ids)
    x = row["x"].values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
    codes = np.frombuffer(row["codes"].as_py(), np.uint8).reshape(-1, n).astype(np.int64)
    return ids, labels, x, codes, np.frombuffer(row["keys"].as_py(), np.float32).reshape(-1, n).astype(float)


def _again(books: np.ndarray, drift: np.ndarray, last: bool):
    """Blocks to blocks after the codebooks moved; in the last round to rows (id, label, code, error)."""
    parts, entries, width = books.shape

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, labels, x, codes, keys = _opened({c: b.column(c)[k] for c in ("ids", "labels", "x", "codes", "keys")})
                cut = [x[:, p * width : (p + 1) * width] for p in range(parts)]
                scanned = sum(reassign(cut[p], books[p], codes[p], keys[p], drift[p]) for p in range(parts))
                if not last:
                    yield _block(ids, labels, x, codes, keys, entries, scanned)
                    continue
                error = sum(((cut[p] - books[p][codes[p]]) ** 2).sum(1) for p in range(parts))
                text = codes.T.astype(np.uint8).tobytes().hex()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x)."""
    y = np.floor(256 * x.astype(np.float64))
    if len(y) and np.abs(y).max() >= 2**25:
        raise ValueError("a component of 2^17 or more: squared distances would not fit")
    return y.astype(np.int64)


def moved(books: np.ndarray, tally: np.ndarray) -> np.ndarray:
    """Each entry the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.shape
    t = tally.reshape(parts, entries * (1 + width))
    n, s = t[:, :entries, None], t[:, entries:].reshape(parts, entries, width)
    return np.where(n > 0, s // np.maximum(n, 1), books)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What an entry's movement and the largest movement of any other take from its parts' slack."""
    d = np.sqrt(((new - old) ** 2).sum(2).astype(float))
    if d.shape[1] == 1:
        return d
    order = np.sort(d, axis=1)
    top = d == order[:, -1:]
    return d + np.where(top & (top.sum(1, keepdims=True) == 1), order[:, -2:-1], order[:, -1:])


def fit_encode(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, block: int = 4096) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(rows of vec_id, label, code, error; the codebooks; parts scanned in each assignment but the last)."""
    if entries > 256:
        raise ValueError("a code has a byte a part: 256 entries at most")
    spark = prepare(vectors.sparkSession)
    release(spark, OWNER)
    v = F.col(vec_col).cast("array<double>")
    sane = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf))
    base = vectors.filter(sane).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    kind = base.schema["label"].dataType.simpleString()
    rows = f"vec_id long, label {kind}, code string, error long"
    total = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if total is None:
        return spark.createDataFrame([], rows), np.zeros((parts, 0, 0), np.int64), []
    dim = total["dim"]
    if dim % parts:
        raise ValueError(f"{dim} components don't cut into {parts} equal parts")
    base = base.filter(F.size("v") == dim)
    first = base.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()  # `entries` vectors at most
    books = np.ascontiguousarray(integers(np.array([r["v"] for r in first])).reshape(len(first), parts, -1).transpose(1, 0, 2))
    state = f"ids array<long>, labels array<{kind}>, x array<int>, codes binary, keys binary, tally array<long>, scanned long"
    drift = np.zeros(books.shape[:2])
    now = written(base.mapInArrow(lean(OWNER, _start(books, block)), state), OWNER)
    scanned = []
    for k in range(rounds):
        # One number for each place of the tallies: as many as the codebooks have, whatever the rows.
        added = now.select(F.posexplode("tally").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
        tally = np.zeros(books.size + books.shape[0] * books.shape[1], np.int64)
        for r in added:
            tally[r["at"]] = r["n"]
        scanned.append(now.agg(F.sum("scanned")).first()[0])
        new = moved(books, tally)
        drift, books = drift + drifts(books, new), new
        last = k == rounds - 1
        now = written(now.mapInArrow(lean(OWNER, _again(books, drift, last)), rows if last else state), OWNER)
    return now, books, scanned


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each vector kept."""
    coded, books, _ = fit_encode(vectors, **options)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    other = by_label.select(F.col("label").alias("other"), "label_error")
    joined = coded.join(bounded(other, by_label.count()), F.col("label").eqNullSafe(F.col("other")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
