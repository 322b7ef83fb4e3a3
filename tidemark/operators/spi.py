"""The catalogue of pairwise statistics and its evaluation: mts to edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import KERNELS, evaluate
from .moments import zscores
from .planned import planned


def catalogue(spark: SparkSession) -> DataFrame:
    """spi, directed, family."""
    return spark.createDataFrame([(n, d, n.split("_")[0]) for n, (d, _) in KERNELS.items()], "spi string, directed boolean, family string")


def names_of(profile: str | list[str]) -> list[str]:
    """The names of a list, in order; 'all'; or a family prefix such as 'dtw'."""
    if isinstance(profile, list):
        missing = [n for n in profile if n not in KERNELS]
        if missing:
            raise KeyError(f"unknown statistics: {missing}")
        return list(dict.fromkeys(profile))
    return list(KERNELS) if profile == "all" else [n for n in KERNELS if n == profile or n.startswith(profile + "_")]


def compute(mts: DataFrame, profile: str | list[str], normalise: bool = False) -> DataFrame:
    """edges(dataset_id, spi, i, j, value): all i <> j of directed statistics, i < j of others.

    Statistics with a DataFrame plan take that. For the others a dataset is one group: its series are needed together.
    Groups are few bytes and much work, so they are dealt to all shuffle partitions and not to as few as their bytes fill.
    """
    names = names_of(profile)
    done, names = planned(zscores(mts) if normalise else mts, names)
    if not names:
        return done

    def run(t: pa.Table) -> pa.Table:
        ident = t["dataset_id"][0].as_py()
        tt, pp, x = (t[c].to_numpy() for c in ("t", "proc", "x"))
        rows, cols = np.unique(pp, return_inverse=True), np.unique(tt, return_inverse=True)
        z = np.full((len(rows[0]), len(cols[0])), np.nan)
        z[rows[1], cols[1]] = x
        z = np.nan_to_num(z)
        if normalise:
            sd = z.std(1, keepdims=True)
            z = (z - z.mean(1, keepdims=True)) / np.where(sd < 1e-12, 1, sd)
        out, m = [], len(z)
        for n, v in evaluate(z, names).items():
            i, j = np.nonzero(~np.eye(m, dtype=bool)) if KERNELS[n][0] else np.triu_indices(m, 1)
            out.append((np.full(len(i), n, object), rows[0][i], rows[0][j], v[i, j]))
        s, i, j, v = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
        return pa.table({"dataset_id": pa.array([ident] * len(s), pa.string()), "spi": pa.array(list(s), pa.string()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": pa.array(v, pa.float64())})

    parts = int(mts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = mts.select("dataset_id", "t", "proc", "x").repartition(parts, "dataset_id").groupBy("dataset_id").applyInArrow(run, "dataset_id string, spi string, i int, j int, value double")
    return rest if done is None else done.unionByName(rest)


def sizes(mts: DataFrame) -> DataFrame:
    return mts.groupBy("dataset_id").agg(F.count_distinct("proc").cast("int").alias("m"))
