"""Short datasets as arrays: a row a dataset, and functions of many datasets of one shape at once.

A pair of channels of a short dataset is little work, and as rows of its own it is much to shuffle and sort. Here the rows of
a dataset are dealt once and gathered; pairs are made in the task, and only their values leave it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Times of a channel up to which a dataset is gathered by statistics that have a plan over rows for longer ones.
SHORT = 1024
#: Numbers of a batch of datasets, and of a block of their tables, at most (a dataset is never cut).
CELLS = 1 << 18

#: values(z, t): an array (datasets, channels, channels) by name, of z (datasets, channels, times); NaN: the pair has no value and no edge.
Values = Callable[[np.ndarray], dict[str, np.ndarray]]
#: pair(t, x, u, y): the same for one pair of channels with times and values of their own; None: no edge.
Pair = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, float | None]]


def parted(mts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Datasets whose channels are all short, and the others if there are any: a count decides, before the plan is made."""
    long = mts.groupBy("dataset_id", "proc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHORT).select("dataset_id").distinct()
    if long.isEmpty():
        return mts, None
    long = F.broadcast(long)  # a name for over SHORT rows
    return mts.join(long, "dataset_id", "left_anti"), mts.join(long, "dataset_id", "left_semi")


def _channels(t: np.ndarray, p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(channels, times, values, which cells there are: None if all) of a dataset's rows."""
    procs, times = np.unique(p), np.unique(t)
    z, there = np.zeros((len(procs), len(times))), np.zeros((len(procs), len(times)), bool)
    at = np.searchsorted(procs, p), np.searchsorted(times, t)
    z[at], there[at] = x, True
    return procs, times, z, None if there.all() else there


def edges_of(mts: DataFrame, names: dict[str, bool], values: Values, pair: Pair | None = None, even: bool = False) -> DataFrame:
    """Edges of the named statistics (name: directed). Cells that lack or are null count as 0, unless `pair` takes the dataset's pairs one by one.

    even: pair also takes datasets whose times have gaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like: dict[tuple[int, int], list] = defaultdict(list)
            ids, cells = b.column(0), b.column(1)
            flat, ends = cells.flatten(), np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))
            t, p = (flat.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            x = flat.field(2)
            known, x = x.is_valid().to_numpy(zero_copy_only=False), x.fill_null(0.0).to_numpy(zero_copy_only=False)
            for k, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                rows = np.flatnonzero(known[start:end]) + start if pair else np.arange(start, end)
                procs, times, z, there = _channels(t[rows], p[rows], x[rows])
                gaps = even and len(times) > 0 and int(times[-1]) - int(times[0]) >= len(times)
                if pair and (there is not None or gaps):
                    yield _one(ids[k].as_py(), procs, times, z, np.ones(z.shape, bool) if there is None else there, names, pair)
                elif z.size:
                    like[z.shape].append((k, procs, z))
            for (m, n), found in like.items():
                size = max(1, CELLS // (m * max(m, n)))
                for at in range(0, len(found), size):
                    some = found[at : at + size]
                    yield from _edges(ids, some, values(np.stack([z for _, _, z in some])), names)

    rows = mts.select("dataset_id", "t", "proc", "x")
    # Datasets are few bytes and much work: all shuffle partitions get some.
    dealt = rows.repartition(int(mts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dataset_id")
    return dealt.groupBy("dataset_id").agg(F.collect_list(F.struct(F.col("t").cast("long").alias("t"), F.col("proc").cast("int").alias("proc"), "x")).alias("cells")).mapInArrow(run, "dataset_id string, spi string, i int, j int, value double")


def _batch(ids, names, i, j, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, names, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value, pa.float64())], names=["dataset_id", "spi", "i", "j", "value"])


def _edges(ids: pa.Array, some: list, found: dict[str, np.ndarray], names: dict[str, bool]) -> Iterator[pa.RecordBatch]:
    procs = np.stack([p for _, p, _ in some])
    m = procs.shape[1]
    rows = np.array([k for k, _, _ in some])
    for name, directed in names.items():
        i, j = np.nonzero(~np.eye(m, dtype=bool)) if directed else np.triu_indices(m, 1)
        value = found[name][:, i, j].ravel()
        yield _batch(ids.take(pa.array(np.repeat(rows, len(i)))), pa.array([name] * len(value), pa.string()), procs[:, i].ravel(), procs[:, j].ravel(), value)


def _one(ident: str, procs: np.ndarray, times: np.ndarray, z: np.ndarray, there: np.ndarray, names: dict[str, bool], pair: Pair) -> pa.RecordBatch:
    out = []
    for i in range(len(procs)):
        for j in range(len(procs)):
            if i < j or i > j and any(names.values()):
                v = pair(times[there[i]], z[i, there[i]], times[there[j]], z[j, there[j]])
                out += [(n, procs[i], procs[j], v[n]) for n, directed in names.items() if v[n] is not None and (directed or i < j)]
    s, i, j, v = zip(*out, strict=True) if out else ((), (), (), ())
    return _batch(pa.array([ident] * len(s), pa.string()), pa.array(s, pa.string()), np.array(i, np.int32), np.array(j, np.int32), np.array(v, float))
