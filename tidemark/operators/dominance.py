"""Statistics over all pairs of times in O(T log T): Kendall's tau and distance correlation.

Both need a sum over discordant pairs: earlier in x and higher in y. Such a pair's y ranks agree in their leading
bits and differ at one bit, where the earlier has a one and the later a zero. So for each bit the rows that share
the bits above it form a group, and a running sum over the group's rows with a one gives each row with a zero
what it is discordant with. A pair of channels is T rows times the bits of T, in one shuffle. That is for long series: datasets of up to gathered.SHORT times are gathered, and their
differences of all pairs of times are multiplied where they are (both give the same values).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gathered import CELLS, edges_of, parted

_PAIR = ("dataset_id", "i", "j")


def _ranks(z: np.ndarray) -> np.ndarray:
    """Places of values from 0 along the last axis, equal where values are; NaN is one value, the largest, as in Spark."""
    order = np.argsort(z, -1, kind="stable")
    v = np.take_along_axis(z, order, -1)
    new = (v[..., 1:] != v[..., :-1]) & ~(np.isnan(v[..., 1:]) & np.isnan(v[..., :-1]))
    out = np.zeros(z.shape, np.int64)
    np.put_along_axis(out, order, np.concatenate([np.zeros((*z.shape[:-1], 1), np.int64), np.cumsum(new, -1)], -1), -1)
    return out


def _products(a: np.ndarray, b: np.ndarray, gap: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of a and b (datasets, channels, times): sums over all pairs of times of the products of gaps of a's channels with b's; of squares; row sums."""
    n = a.shape[-1]
    step = max(1, CELLS // max(1, a.size))
    ab, aa, bb, ar, br = 0.0, 0.0, 0.0, [], []
    for s in range(0, n, step):
        da = gap(a[..., s : s + step, None], a[..., None, :])
        db = da if b is a else gap(b[..., s : s + step, None], b[..., None, :])
        ar.append(da.sum(-1))
        br.append(ar[-1] if b is a else db.sum(-1))
        da, db = (d.reshape(*d.shape[:2], -1) for d in (da, db))
        ab = ab + (da @ db.transpose(0, 2, 1)).astype(float)
        aa = aa + np.einsum("dmk,dmk->dm", da, da).astype(float)
        bb = aa if b is a else bb + np.einsum("dmk,dmk->dm", db, db).astype(float)
    return ab, aa, bb, np.concatenate(ar, -1), np.concatenate(br, -1)


def _taus(z: np.ndarray) -> np.ndarray:
    """Tau-b of all pairs of channels; counts are whole numbers, exact in single precision within a block of 2^24 products."""
    told, by, _, _, _ = _products(_ranks(z), _ranks(z), lambda p, q: np.sign(p - q).astype(np.float32))
    both = np.sqrt((by / 2)[:, :, None] * (by / 2)[:, None, :])
    return np.divide(told / 2, both, out=np.zeros_like(told), where=both > 0)


def _correlations(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance correlations of a's channels with b's, unbiased and plain (its root)."""
    n = a.shape[-1]
    ab, aa, bb, ar, br = _products(a, b, lambda p, q: np.abs(p - q))
    arb, ara, brb = ar @ br.transpose(0, 2, 1), (ar * ar).sum(-1), (br * br).sum(-1)
    sa, sb = ar.sum(-1), br.sum(-1)

    def ratio(cov: Callable) -> np.ndarray:
        top, one, two = cov(ab, arb, sa[:, :, None] * sb[:, None, :]), cov(aa, ara, sa * sa)[:, :, None], cov(bb, brb, sb * sb)[:, None, :]
        whole = one * two
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(whole <= 1e-18, 0.0, top / np.sqrt(whole))  # NaN stays

    plain = ratio(lambda d, rows, all_: d - 2 / n * rows + all_ / (n * n))
    unbiased = ratio(lambda d, rows, all_: d - 2 * rows / (n - 2) + all_ / ((n - 1) * (n - 2))) if n > 2 else np.zeros_like(ab)
    return unbiased, np.sqrt(np.maximum(plain, 0.0))


def discordant(pairs: DataFrame, keys: tuple[str, ...], sums: dict[str, Column], found: dict[str, Column]) -> DataFrame:
    """For each key, sums over discordant pairs. pairs has rx, ry: ranks from 0 of x (or x itself) and of y, equal where values are.

    sums: what is summed over a row's discordant partners; found: aggregates over rows of expressions in those and the row's own columns.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    bits = pairs.withColumn("__n", n).withColumn("__b", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2(F.col("__n"))).cast("int")))))
    bits = bits.withColumn("__above", F.expr("shiftright(ry, __b + 1)")).withColumn("__one", F.expr("shiftright(ry, __b) % 2 = 1"))
    before = Window.partitionBy(*keys, "__b", "__above").orderBy("rx", "ry").rowsBetween(Window.unboundedPreceding, -1)
    ran = bits.withColumns({k: F.when(~F.col("__one"), F.coalesce(F.sum(F.when(F.col("__one"), v)).over(before), F.lit(0))).otherwise(F.lit(0)) for k, v in sums.items()})
    return ran.groupBy(*keys).agg(*[v.alias(k) for k, v in found.items()])


def _ties(df: DataFrame, keys: tuple[str, ...], name: str, *by: str) -> DataFrame:
    """(keys, name): how many pairs of rows agree in `by`."""
    groups = df.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("c"))
    return groups.groupBy(*keys).agg(F.sum(F.expr("c * (c - 1) div 2")).alias(name))


def kendall(mts: DataFrame, squared: bool = False) -> DataFrame:
    """Tau-b: agreeing less disagreeing pairs of times, over the geometric mean of those that either channel tells apart."""
    name = "kendall_sq" if squared else "kendall"
    shaped = lambda z: {name: _taus(z) ** 2 if squared else _taus(z)}

    def pair(t: np.ndarray, x: np.ndarray, u: np.ndarray, y: np.ndarray) -> dict[str, float | None]:
        _, a, b = np.intersect1d(t, u, return_indices=True)
        return {name: shaped(np.stack([x[a], y[b]])[None])[name][0, 0, 1] if len(a) else None}

    short, long = parted(mts)
    edges = edges_of(short, {name: False}, shaped, pair)
    return edges if long is None else edges.unionByName(kendall_by_bits(long, squared))


def kendall_by_bits(mts: DataFrame, squared: bool = False) -> DataFrame:
    """The same in rows, for channels of any length that all have the same times."""
    w = Window.partitionBy("dataset_id", "proc")
    ranked = mts.select("dataset_id", "t", "proc", (F.dense_rank().over(w.orderBy("x")) - 1).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    own = _ties(ranked, ("dataset_id", "proc"), "ties", "r")
    a = ranked.select("dataset_id", "t", F.col("proc").alias("i"), F.col("r").alias("rx"), "n")
    pairs = a.join(ranked.select("dataset_id", "t", F.col("proc").alias("j"), F.col("r").alias("ry")), ["dataset_id", "t"]).filter("i < j")
    bad = discordant(pairs, _PAIR, {"d": F.lit(1)}, {"bad": F.sum("d"), "n": F.first("n")})
    side = lambda p, name: own.select("dataset_id", F.col("proc").alias(p), F.col("ties").alias(name))
    all_ = bad.join(_ties(pairs, _PAIR, "txy", "rx", "ry"), [*_PAIR]).join(side("i", "tx"), ["dataset_id", "i"]).join(side("j", "ty"), ["dataset_id", "j"])
    whole = F.expr("n * (n - 1) div 2")
    told = whole - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("bad")
    tau = F.coalesce(F.try_divide(told.cast("double"), F.sqrt((whole - F.col("tx")).cast("double") * (whole - F.col("ty")))), F.lit(0.0))
    return all_.select("dataset_id", F.lit("kendall_sq" if squared else "kendall").alias("spi"), "i", "j", (tau * tau if squared else tau).alias("value"))


def _spread(x: str, keys: tuple[str, ...]) -> Column:
    """A row's sum of distances to all rows of its group, from sorted running sums."""
    by = Window.partitionBy(*keys)
    place, run = F.row_number().over(by.orderBy(x)), F.sum(x).over(by.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (2 * place - F.count(F.lit(1)).over(by)) * F.col(x) - 2 * run + F.sum(x).over(by)


def distance_correlations(pairs: DataFrame, keys: tuple[str, ...], biased: bool = False) -> DataFrame:
    """(keys, value) of pairs(keys, x, y): distance correlation, unbiased or (biased) the root of the plain one.

    Sums of products of distances split into signed products, which sums of powers give, and twice the discordant part.
    """
    by = Window.partitionBy(*keys)
    centred = pairs.select(*keys, *[(F.col(c) - F.avg(c).over(by)).alias(c) for c in ("x", "y")])
    spread = centred.withColumn("a", _spread("x", keys)).withColumn("b", _spread("y", keys)).withColumn("ry", F.dense_rank().over(by.orderBy("y")) - 1).withColumn("rx", F.col("x"))
    first = F.col("__b") == 0  # the sums of the rows themselves, once
    s = lambda e: F.sum(F.when(first, e))
    x, y, a, b = (F.col(c) for c in "xyab")
    found = discordant(
        spread, keys, {"c": F.lit(1), "cx": x, "cy": y, "cxy": x * y},
        {"bad": F.sum(F.col("c") * x * y - F.col("cy") * x - F.col("cx") * y + F.col("cxy")), "n": F.count_if(first).cast("double"), "xy": s(x * y), "xx": s(x * x), "yy": s(y * y), "x1": s(x), "y1": s(y), "ab": s(a * b), "aa": s(a * a), "bb": s(b * b), "a1": s(a), "b1": s(b)},
    )
    n = F.col("n")
    both = 2 * ((n * F.col("xy") - F.col("x1") * F.col("y1")) - 2 * F.col("bad"))
    square = lambda q, o: 2 * (n * F.col(q) - F.col(o) * F.col(o))
    if biased:
        cov = lambda d, rows, one, two: d - 2 / n * F.col(rows) + F.col(one) * F.col(two) / (n * n)
    else:
        cov = lambda d, rows, one, two: d - F.try_divide(2 * F.col(rows), n - 2) + F.try_divide(F.col(one) * F.col(two), (n - 1) * (n - 2))
    top, one, two = cov(both, "ab", "a1", "b1"), cov(square("xx", "x1"), "aa", "a1", "a1"), cov(square("yy", "y1"), "bb", "b1", "b1")
    r = F.when(one * two > 1e-18, top / F.sqrt(one * two)).otherwise(0.0)
    return found.select(*keys, (F.sqrt(F.greatest(r, F.lit(0.0))) if biased else r).alias("value"))


def distance_statistics(mts: DataFrame, names: list[str]) -> DataFrame:
    """dcorr, dcorr_biased and dcorrx_maxlag-<n> (the largest over lags 0 to n of channel j behind channel i, i < j)."""
    lags = {n: int(n.rpartition("-")[2]) for n in names if n.startswith("dcorrx")}
    for n in names:
        if n not in ("dcorr", "dcorr_biased") and not re.fullmatch(r"dcorrx_maxlag-[0-9]+", n):
            raise KeyError(n)

    def named(found: list) -> dict:
        """found: unbiased and plain correlations by lag; none where no times meet."""
        out = {"dcorr": found[0] and found[0][0], "dcorr_biased": found[0] and found[0][1]}
        for n, most in lags.items():
            met = [f[0] for f in found[: most + 1] if f]
            out[n] = np.max(met, axis=0) if met else None
        return {n: out[n] for n in names}

    most = max(lags.values(), default=0)

    def shaped(z: np.ndarray) -> dict[str, np.ndarray]:
        n = z.shape[-1]
        return named([_correlations(z, z) if not k else _correlations(z[..., : n - k], z[..., k:]) for k in range(min(most, n - 1) + 1)])

    def pair(t: np.ndarray, x: np.ndarray, u: np.ndarray, y: np.ndarray) -> dict[str, float | None]:
        found = []
        for k in range(most + 1):
            _, a, b = np.intersect1d(t + k, u, return_indices=True)
            found.append(tuple(float(v[0, 0, 0]) for v in _correlations(x[a][None, None], y[b][None, None])) if len(a) else None)
        return named(found)

    short, long = parted(mts)
    out = [edges_of(short, dict.fromkeys(names, False), shaped, pair, bool(most))]
    if long is not None:
        out += [lagged_by_bits(long, lags[n]) if n in lags else correlation_by_bits(long, n.endswith("_biased")) for n in names]
    return reduce(DataFrame.unionByName, out)


def distance_correlation(mts: DataFrame, biased: bool = False) -> DataFrame:
    return distance_statistics(mts, ["dcorr" + "_biased" * biased])


def lagged_distance_correlation(mts: DataFrame, max_lag: int) -> DataFrame:
    return distance_statistics(mts, [f"dcorrx_maxlag-{max_lag}"])


def correlation_by_bits(mts: DataFrame, biased: bool = False) -> DataFrame:
    a = mts.select("dataset_id", "t", F.col("proc").alias("i"), "x")
    pairs = a.join(mts.select("dataset_id", "t", F.col("proc").alias("j"), F.col("x").alias("y")), ["dataset_id", "t"]).filter("i < j")
    return distance_correlations(pairs, _PAIR, biased).select("dataset_id", F.lit("dcorr" + "_biased" * biased).alias("spi"), "i", "j", "value")


def lagged_by_bits(mts: DataFrame, max_lag: int) -> DataFrame:
    """The largest over lags 0 to max_lag of channel j behind channel i, i < j."""
    a = mts.select("dataset_id", F.col("proc").alias("i"), "x", "t", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")).withColumn("t", F.col("t") + F.col("lag"))
    pairs = a.join(mts.select("dataset_id", "t", F.col("proc").alias("j"), F.col("x").alias("y")), ["dataset_id", "t"]).filter("i < j")
    best = distance_correlations(pairs, (*_PAIR, "lag")).groupBy(*_PAIR).agg(F.max("value").alias("value"))
    return best.select("dataset_id", F.lit(f"dcorrx_maxlag-{max_lag}").alias("spi"), "i", "j", "value")
