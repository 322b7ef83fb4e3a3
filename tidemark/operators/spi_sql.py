"""Pairwise statistics that are closed expressions: edges(dataset_id, spi, i, j, value) by joins and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank, pearson
from . import fourier
from .meeting import together

_PAIR = ("dataset_id", "i", "j")


def pairs(mts: DataFrame, directed: bool = False, value: str = "x") -> DataFrame:
    """(dataset_id, t, i, j, x, y) for i < j, or all i <> j."""
    return together(mts, {value: "x"}, {value: "y"}, directed)


def _edges(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.groupBy(*_PAIR).agg(value.alias("value")).select("dataset_id", F.lit(name).alias("spi"), "i", "j", "value")


def covariance(mts: DataFrame, squared: bool = False) -> DataFrame:
    c = F.covar_pop("x", "y")
    return _edges(pairs(mts), "cov_sq" if squared else "cov", c * c if squared else c)


def correlation(mts: DataFrame) -> DataFrame:
    return _edges(pairs(mts), "pearson", F.coalesce(pearson("x", "y"), F.lit(0.0)))


def shrunk_covariance(mts: DataFrame, shrinkage: float = 0.1) -> DataFrame:
    """Off the diagonal, shrinkage towards a scaled identity only scales."""
    return _edges(pairs(mts), "cov_shrunk", (1 - shrinkage) * F.covar_pop("x", "y"))


def spearman(mts: DataFrame, squared: bool = False) -> DataFrame:
    ranked = mts.select("dataset_id", "t", "proc", average_rank("x", "dataset_id", "proc").alias("r"))
    r = F.coalesce(pearson("x", "y"), F.lit(0.0))
    return _edges(pairs(ranked, value="r"), "spearman_sq" if squared else "spearman", r * r if squared else r)


DISTANCES = {
    "euclidean": lambda x, y: F.sqrt(F.sum((x - y) * (x - y))),
    "cityblock": lambda x, y: F.sum(F.abs(x - y)),
    "cosine": lambda x, y: 1 - F.coalesce(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))), F.lit(0.0)),
    "chebyshev": lambda x, y: F.max(F.abs(x - y)),
    "canberra": lambda x, y: F.sum(F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))),
    "braycurtis": lambda x, y: F.coalesce(F.try_divide(F.sum(F.abs(x - y)), F.sum(F.abs(x + y))), F.lit(0.0)),
}


def distance(mts: DataFrame, metric: str) -> DataFrame:
    return _edges(pairs(mts), f"pdist_{metric}", DISTANCES[metric](F.col("x"), F.col("y")))


def barycenter_euclidean(mts: DataFrame, statistic: str = "mean", squared: bool = False) -> DataFrame:
    c = (F.col("x") + F.col("y")) / 2
    c = c * c if squared else c
    return _edges(pairs(mts), f"bary_euclidean_{statistic}", F.avg(c) if statistic == "mean" else F.max(c))


def _z(mts: DataFrame) -> DataFrame:
    w = Window.partitionBy("dataset_id", "proc")
    z = F.coalesce(F.try_divide(F.col("x") - F.avg("x").over(w), F.stddev_pop("x").over(w)), F.lit(0.0))
    return mts.select("dataset_id", "t", "proc", z.alias("x"), F.count(F.lit(1)).over(w).alias("n"))


def cross_correlation(mts: DataFrame, statistic: str = "max", squared: bool = False, max_lag: int | None = None, sig_only: bool = False) -> DataFrame:
    """Statistic over lags of the correlation of z-scores, each lag normalised by the whole length: over all lags, or up to max_lag.

    sig_only keeps lags beyond 1.96 / sqrt(n); a pair without any falls back to all lags. A few lags of long series are
    a join of shifted rows; all lags are sums over the arrays of a pair.
    """
    if max_lag is None:
        return fourier.cross_correlation(mts, statistic, squared, None, sig_only)
    z = _z(mts)
    a = z.select("dataset_id", F.col("proc").alias("i"), F.col("x"), "n", "t", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    b = z.select("dataset_id", F.col("proc").alias("j"), F.col("x").alias("y"), F.col("t").alias("t2"))
    at = a.withColumn("t2", F.col("t") + F.col("lag")).join(b, ["dataset_id", "t2"]).filter("i < j")
    by_lag = at.groupBy(*_PAIR, "lag").agg((F.sum(F.col("x") * F.col("y")) / F.first("n")).alias("c"), F.first("n").alias("n"))
    c = F.col("c") * F.col("c") if squared else F.col("c")
    agg = F.max if statistic == "max" else F.avg
    value = F.coalesce(agg(F.when(F.abs("c") > 1.96 / F.sqrt("n"), c)), agg(c)) if sig_only else agg(c)
    return _edges(by_lag, f"xcorr_{statistic}", value)


_LN2PIE = math.log(2 * math.pi * math.e)


def _det() -> Column:
    vx, vy, cxy = F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")
    return vx * vy - cxy * cxy


def joint_entropy(mts: DataFrame) -> DataFrame:
    return _edges(pairs(mts), "je_gaussian", _LN2PIE + 0.5 * F.ln(_det()))


def conditional_entropy(mts: DataFrame) -> DataFrame:
    """Of the second given the first, both ways averaged, as the label is undirected."""
    h = _LN2PIE + 0.5 * F.ln(_det())
    own = lambda c: 0.5 * (_LN2PIE + F.ln(F.var_pop(c)))
    return _edges(pairs(mts), "ce_gaussian", h - 0.5 * (own("x") + own("y")))


def mutual_information(mts: DataFrame) -> DataFrame:
    r = F.coalesce(pearson("x", "y"), F.lit(0.0))
    return _edges(pairs(mts), "mi_gaussian", -0.5 * F.ln(1 - r * r))


def lagged(mts: DataFrame, lag: int = 1) -> DataFrame:
    w = Window.partitionBy("dataset_id", "proc").orderBy("t")
    return mts.withColumn("x", F.lag("x", lag).over(w)).filter("x is not null")


def lagged_mutual_information(mts: DataFrame, lag: int = 1) -> DataFrame:
    """Directed: the past of i with the present of j."""
    w = Window.partitionBy("dataset_id", "proc").orderBy("t")
    both = together(mts.select("dataset_id", "t", "proc", "x", F.lag("x", lag).over(w).alias("past")), {"past": "x"}, {"x": "y"}, True)
    r = F.coalesce(pearson("x", "y"), F.lit(0.0))
    return _edges(both.filter("x is not null"), "tlmi_gaussian", -0.5 * F.ln(1 - r * r))


def symbolic_transfer_entropy(mts: DataFrame) -> DataFrame:
    """Directed, history 1, symbols: does the series rise. From i to j, in nats, by counts."""
    w = Window.partitionBy("dataset_id", "proc").orderBy("t")
    s = mts.select("dataset_id", "t", "proc", (F.col("x") > F.lag("x").over(w)).cast("int").alias("s")).filter("s is not null")
    s = s.select("dataset_id", "t", "proc", "s", F.lag("s").over(w).alias("p")).filter("p is not null")
    a = s.select("dataset_id", "t", F.col("proc").alias("i"), F.col("p").alias("xp"))
    b = s.select("dataset_id", "t", F.col("proc").alias("j"), F.col("s").alias("y"), F.col("p").alias("yp"))
    cells = a.join(b, ["dataset_id", "t"]).filter("i <> j").groupBy(*_PAIR, "y", "yp", "xp").agg(F.count(F.lit(1)).cast("double").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy(*_PAIR, *k))
    term = F.col("n") / over() * F.ln(F.col("n") * over("yp") / (over("yp", "xp") * over("y", "yp")))
    return _edges(cells.select(*_PAIR, term.alias("term")), "te_symbolic", F.sum("term"))
