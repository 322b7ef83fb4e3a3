"""Regressions of one channel on another from sums of powers and products; slopes and bins in order of value."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gathered import edges_of
from .kernels import gradient_descent
from .meeting import together
from .moments import eliminated, residuals, zscores

_PAIR = ("dataset_id", "i", "j")
#: On the unit interval: variances below this are rounding.
FLAT = 1e-12


def _edges(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("dataset_id", F.lit(name).alias("spi"), "i", "j", value.alias("value"))


def meet(channels: DataFrame, directed: bool = True, *more: str) -> DataFrame:
    """(dataset_id, t, i, j, x, y) of channels(dataset_id, t, proc, x); `more` columns come from i's side."""
    return together(channels, {c: c for c in ("x", *more)}, {"x": "y"}, directed)


def scaled(mts: DataFrame) -> DataFrame:
    """Channels on the unit interval; constant ones are 0."""
    w = Window.partitionBy("dataset_id", "proc")
    lo, hi = F.min("x").over(w), F.max("x").over(w)
    return mts.select("dataset_id", "t", "proc", F.when(hi > lo, (F.col("x") - lo) / (hi - lo)).otherwise(0.0).alias("x"))


def regression_error(mts: DataFrame) -> DataFrame:
    """Directed: mean squared error of a cubic in i that predicts j, both on the unit interval."""
    x, y = F.col("x"), F.col("y")
    powers = meet(scaled(mts)).select(*_PAIR, x.alias("a0"), (x * x).alias("a1"), (x * x * x).alias("a2"), y.alias("a3"))
    cov = powers.groupBy(*_PAIR).agg(*[F.covar_pop(f"a{q}", f"a{r}").alias(f"c{q}{r}") for q in range(4) for r in range(q, 4)])
    m = F.array(*[F.col(f"c{min(q, r)}{max(q, r)}") for q in range(4) for r in range(4)])
    return _edges(cov.withColumn("m", m), "reci", residuals(F.col("m"), 4, FLAT)[3])


def value_slopes(mts: DataFrame) -> DataFrame:
    """Directed: mean log slope of j between neighbours in order of i's values, both on the unit interval (igci)."""
    w = Window.partitionBy(*_PAIR).orderBy("x", "t")
    steps = meet(scaled(mts)).select(*_PAIR, (F.col("x") - F.lag("x").over(w)).alias("dx"), F.abs(F.col("y") - F.lag("y").over(w)).alias("dy"))
    log = F.when((F.col("dx") > 0) & (F.col("dy") > 0), F.ln(F.col("dy") / F.col("dx")))
    return steps.groupBy(*_PAIR).agg(F.coalesce(F.avg(log), F.lit(0.0)).alias("v")).select("dataset_id", F.lit("igci").alias("spi"), "i", "j", F.col("v").alias("value"))


def conditional_distributions(mts: DataFrame, bins: int = 8, reach: float = 2.5) -> DataFrame:
    """Directed: how much the standardised distributions of j differ between the quantile bins of i (cds)."""
    w = Window.partitionBy("dataset_id", "proc")
    edges = F.percentile("x", F.array(*[F.lit(k / bins) for k in range(bins + 1)])).over(w)
    placed = mts.select("dataset_id", "t", "proc", "x", edges.alias("edges"))
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.size(F.filter("edges", lambda e: e <= F.col("x"))) - 1))
    pairs = meet(placed.select("dataset_id", "t", "proc", "x", at.alias("k")), True, "k")
    b = Window.partitionBy(*_PAIR, "k")
    z = F.when(F.stddev_pop("y").over(b) > 1e-12, (F.col("y") - F.avg("y").over(b)) / F.stddev_pop("y").over(b)).otherwise(0.0)
    rows = pairs.select(*_PAIR, "k", z.alias("z"), F.count(F.lit(1)).over(b).alias("n")).filter("n > 1")
    cell = F.when(F.col("z").between(-reach, reach), F.least(F.lit(bins - 1), F.floor((F.col("z") + reach) / (2 * reach / bins))))
    heights = rows.groupBy(*_PAIR, "k", cell.alias("cell")).agg((F.count(F.lit(1)) / F.first("n")).alias("h"))
    # A bin without rows in a cell has height 0 there; all bins are counted once by the rows of any cell.
    used = heights.groupBy(*_PAIR).agg(F.count_distinct("k").alias("used"))
    spread = heights.filter("cell is not null").groupBy(*_PAIR, "cell").agg(F.sum("h").alias("h1"), F.sum(F.col("h") * F.col("h")).alias("h2")).join(used, [*_PAIR])
    sd = F.sqrt(F.greatest(F.col("h2") / F.col("used") - F.col("h1") * F.col("h1") / (F.col("used") * F.col("used")), F.lit(0.0)))
    found = spread.groupBy(*_PAIR).agg(F.sum(F.when(F.col("used") > 1, sd).otherwise(0.0)).alias("v"))
    every = mts.select("dataset_id", F.col("proc").alias("i")).distinct()
    grid = every.join(every.withColumnRenamed("i", "j"), "dataset_id").filter("i <> j")  # channels of a dataset: the edges themselves
    return _edges(grid.join(found, [*_PAIR], "left"), "cds", F.coalesce("v", F.lit(0.0)) / bins)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the weight after 50 rounds of evidence maximisation, of all pairs of a batch at each round."""
    for s in batches:
        n, c, xx, yy = (s.column(k).fill_null(np.nan).to_numpy(zero_copy_only=False) for k in ("n", "c", "xx", "yy"))
        size = np.where(xx == 0, 1.0, xx)
        a, l, b = np.ones(len(n)), np.ones(len(n)), np.zeros(len(n))
        for _ in range(50):  # the weight, then the precisions of noise and weight
            v = 1 / (l + a * size)
            b = a * v * c
            g = 1 - l * v
            a, l = (n - g) / np.maximum(yy - 2 * b * c + b * b * xx, 1e-12), g / np.maximum(b * b, 1e-12)
        yield pa.RecordBatch.from_arrays([*s.columns, pa.array(b, mask=np.isnan(b))], names=[*s.schema.names, "evidence"])


def linear_models(mts: DataFrame, models: list[str]) -> DataFrame:
    """Directed: mean squared error of j on i, both standardised, by Ridge, Lasso, ElasticNet or BayesianRidge: lmfit_<model>."""
    s = meet(zscores(mts)).groupBy(*_PAIR).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("x") * F.col("y")).alias("c"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    n, c, yy = F.col("n"), F.col("c"), F.col("yy")
    xx = F.when(F.col("xx") == 0, 1.0).otherwise(F.col("xx"))
    soft = lambda l1, l2: F.signum(c) * F.greatest(F.abs(c) / n - l1, F.lit(0.0)) / (xx / n + l2)
    weight = {
        "Ridge": c / (xx + 1), "Lasso": soft(1.0, 0.0), "ElasticNet": soft(0.5, 0.5),
        "BayesianRidge": F.col("evidence"),
    }
    if "BayesianRidge" in models:
        s = s.select("dataset_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "n", "c", "xx", "yy").mapInArrow(_evidence, "dataset_id string, i int, j int, n double, c double, xx double, yy double, evidence double")
    cells = F.explode(F.array(*[F.struct(F.lit(f"lmfit_{m}").alias("spi"), weight[m].alias("b")) for m in models]))
    b = F.col("w.b")
    return s.withColumn("w", cells).select("dataset_id", "w.spi", "i", "j", ((yy - 2 * b * c + b * b * F.col("xx")) / n).alias("value"))


def stochastic_descent(mts: DataFrame) -> DataFrame:
    """Directed: the same error after stochastic gradient descent, a step a time and all pairs of many datasets at each step."""
    return edges_of(mts, {"lmfit_SGDRegressor": True}, lambda z: {"lmfit_SGDRegressor": gradient_descent(np.nan_to_num(z))})


def engle_granger(mts: DataFrame, name: str, lags: int = 1, trend: bool = False, criterion: str | None = None) -> DataFrame:
    """Dickey-Fuller t of the residual of j on i (and time), with `lags` past differences, i < j.

    criterion (aic, bic): the best number of them up to `lags`, all judged on the rows that the largest one has.
    """
    w = Window.partitionBy("dataset_id", "proc")
    placed = mts.select("dataset_id", "t", "proc", "x", (F.row_number().over(w.orderBy("t")) - 1).cast("double").alias("u"))
    pairs = meet(placed, False, "u")
    p = Window.partitionBy(*_PAIR)
    c = lambda a, b: F.covar_pop(a, b).over(p)
    moments = pairs.select(*_PAIR, "u", "x", "y", *[F.avg(v).over(p).alias(f"m{v}") for v in ("x", "y", "u")], c("x", "x").alias("vx"), c("x", "y").alias("cxy"), c("x", "u").alias("cxu"), c("y", "u").alias("cyu"), c("u", "u").alias("vu"), F.count(F.lit(1)).over(p).alias("n"))
    det = F.col("vx") * F.col("vu") - F.col("cxu") * F.col("cxu")
    if trend:
        bx = F.coalesce(F.try_divide(F.col("cxy") * F.col("vu") - F.col("cyu") * F.col("cxu"), det), F.lit(0.0))
        bu = F.coalesce(F.try_divide(F.col("cyu") * F.col("vx") - F.col("cxy") * F.col("cxu"), det), F.lit(0.0))
    else:
        bx, bu = F.coalesce(F.try_divide(F.col("cxy"), F.col("vx")), F.lit(0.0)), F.lit(0.0)
    r = F.col("y") - F.col("my") - bx * (F.col("x") - F.col("mx")) - bu * (F.col("u") - F.col("mu"))
    o = Window.partitionBy(*_PAIR).orderBy("u")
    rest = moments.select(*_PAIR, "u", "n", r.alias("r")).withColumn("level", F.lag("r").over(o)).withColumn("d", F.col("r") - F.col("level"))
    rest = rest.withColumns({f"d{h}": F.lag("d", h).over(o) for h in range(1, lags + 1)})
    past = [f"d{h}" for h in range(1, lags + 1)]
    size = lags + 2

    def products(df: DataFrame, keep: Column, use: list[Column]) -> DataFrame:
        """Sums of products of the rows kept, as a matrix; n_rows them."""
        sums = df.groupBy(*_PAIR).agg(F.count_if(keep).alias("n_rows"), F.first("n").alias("n"), *[F.sum(F.when(keep, use[q] * use[s])).alias(f"s{q}_{s}") for q in range(size) for s in range(q, size)])
        m = F.array(*[F.coalesce(F.col(f"s{min(q, s)}_{max(q, s)}"), F.lit(0.0)) for q in range(size) for s in range(size)])
        return sums.select(*_PAIR, "n", "n_rows", m.alias("m"))

    masked = lambda cols, most: [F.when(F.lit(int(c[1:])) <= most, F.col(c)).otherwise(0.0) if c[1:].isdigit() else F.col(c) for c in cols]
    if criterion:
        most = F.least(F.lit(lags).cast("long"), F.greatest(F.floor((F.col("n") - 1) / 2) - 1, F.lit(0).cast("long")))
        judged = products(rest, F.col("u") >= most + 1, masked(["level", *past, "d"], most))
        left = judged.withColumn("left", residuals(F.col("m"), size)).withColumn("most", most.cast("int"))
        fee = F.lit(2.0) if criterion == "aic" else F.ln(F.col("n_rows").cast("double"))
        cost = F.transform(F.slice("left", F.lit(2), F.col("most") + 1), lambda e, k: F.struct((F.col("n_rows") * F.ln(F.greatest(e / F.col("n_rows"), F.lit(1e-300))) + (k + 1) * fee).alias("c"), k.alias("k")))
        rest = rest.join(left.select(*_PAIR, F.array_min(cost)["k"].alias("best")), [*_PAIR])
    else:
        rest = rest.withColumn("best", F.lit(lags))
    best = F.col("best")
    fit = products(rest.withColumn("n", best.cast("long")), F.col("u") >= best + 1, masked([*past, "level", "d"], best))
    done = fit.select(*_PAIR, "n", "n_rows", eliminated(F.col("m"), size, lags)["m"].alias("m"))
    own, both, now = F.col("m")[0], F.col("m")[1], F.col("m")[3]
    error = F.greatest(now - F.coalesce(F.try_divide(both * both, own), F.lit(0.0)), F.lit(0.0))
    se = F.sqrt(F.greatest(F.try_divide(error / F.greatest(F.col("n_rows") - F.col("n") - 1, F.lit(1)), own), F.lit(1e-300)))
    return _edges(done, name, F.try_divide(both, own) / se)


def cointegration(mts: DataFrame, names: list[str]) -> DataFrame:
    """Engle-Granger statistics by name: coint_aeg_lags-1, _lags-10, _trend, _tstat_trend-<c, ct>_autolag-<aic, bic>_maxlag-10."""
    out = []
    for name in names:
        given = dict(p.split("-", 1) for p in name.split("_") if "-" in p)
        if not name.startswith("coint_aeg"):
            raise KeyError(name)
        lags = int(given.get("maxlag", given.get("lags", 1)))
        out.append(engle_granger(mts, name, lags, name.endswith("_trend") or given.get("trend") == "ct", given.get("autolag")))
    return reduce(DataFrame.unionByName, out)
