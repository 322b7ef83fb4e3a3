"""Gaussian information and precision from second moments: one aggregate a pair, then elimination in column arithmetic.

The moments of a pair's lagged values come from one pass; what is left of a variable's variance once others are
eliminated from the moment matrix is its conditional variance, and its logarithm the conditional entropy. The
matrices have a few numbers (twice the history, squared) and stay in their row: eliminating is a fold over an array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .meeting import together

_PAIR = ("dataset_id", "i", "j")
_LN2PIE = math.log(2 * math.pi * math.e)
#: Added to each variance, so that what is told exactly has a finite entropy.
RIDGE = 1e-12
TINY = 1e-300
HISTORY = 5


def zscores(mts: DataFrame) -> DataFrame:
    """(dataset_id, t, proc, x, u): standardised, 0 where constant; u is the place in time, from 0."""
    w = Window.partitionBy("dataset_id", "proc")
    z = F.when(F.stddev_pop("x").over(w) > 1e-12, (F.col("x") - F.avg("x").over(w)) / F.stddev_pop("x").over(w)).otherwise(0.0)
    return mts.select("dataset_id", "t", "proc", z.alias("x"), (F.row_number().over(w.orderBy("t")) - 1).alias("u"))


def lag_pairs(mts: DataFrame, lags: int, directed: bool = True) -> DataFrame:
    """(dataset_id, i, j, u, x0.., y0..): both channels now and up to `lags` steps ago (null before the start)."""
    w = Window.partitionBy("dataset_id", "proc").orderBy("u")
    v = zscores(mts).select("dataset_id", "t", "u", "proc", *[F.lag("x", k).over(w).alias(f"v{k}") for k in range(lags + 1)])
    side = lambda c: {f"v{k}": f"{c}{k}" for k in range(lags + 1)}
    return together(v, side("x") | {"u": "u"}, side("y"), directed)


def moments(pairs: DataFrame, sets: dict[str, tuple[int, list[str]]]) -> DataFrame:
    """For each pair, the covariance matrices of several sets of variables; a column a name, row-major arrays.

    sets: name to (steps left out at the start, variables). Rows that all sets have are summed once for all of them,
    a product a column; only the few rows at the start are summed set by set.
    """
    deepest = max(skip for skip, _ in sets.values())
    products = dict.fromkeys(tuple(sorted((a, b))) for _, cols in sets.values() for a in cols for b in cols)
    names = dict.fromkeys(c for _, cols in sets.values() for c in cols)
    # As SQL text: there are hundreds, and a column object is several calls to the JVM.
    sums = [f"sum({c}) AS s_{c}" for c in names] + [f"sum({a} * {b}) AS s_{a}_{b}" for a, b in products]
    found = pairs.filter(F.col("u") >= deepest).groupBy(*_PAIR).agg(*map(F.expr, ["count(1) AS n_rows", *sums]))
    more = {name: (skip, cols) for name, (skip, cols) in sets.items() if skip < deepest}
    if more:
        early = []
        for name, (skip, cols) in more.items():
            rows = f"FILTER (WHERE u >= {skip})"
            early += [f"count(1) {rows} AS {name}_n", *[f"sum({c}) {rows} AS {name}_{c}" for c in cols]]
            early += [f"sum({a} * {b}) {rows} AS {name}_{a}_{b}" for a, b in products if a in cols and b in cols]
        found = found.join(pairs.filter(F.col("u") < deepest).groupBy(*_PAIR).agg(*map(F.expr, early)), [*_PAIR], "full")

    def matrix(name: str, cols: list[str]) -> str:
        total = lambda late, own: f"(coalesce({late}, 0) + coalesce({name}_{own}, 0))" if name in more else late
        n = total("n_rows", "n")
        cell = lambda a, b: f"{total(f's_{a}_{b}', f'{a}_{b}')} / {n} - {total(f's_{a}', a)} * {total(f's_{b}', b)} / ({n} * {n})"
        cells = [cell(*sorted((a, b))) + (f" + {RIDGE}D" if a == b else "") for a in cols for b in cols]
        return f"CASE WHEN {n} > 0 THEN array({', '.join(cells)}) END AS {name}"

    return found.select(*_PAIR, *[F.expr(matrix(name, cols)) for name, (_, cols) in sets.items()])


def eliminated(m: Column, size: int, steps: int, tiny: float = TINY) -> Column:
    """Struct of m, what is left of a row-major matrix without its first `steps` variables, and p: the last variable's variance before and after each.

    A variable with no variance of its own left (at most tiny) is passed over. The matrix shrinks with every step.
    """
    kind = "struct<m:array<double>,p:array<double>>"

    def step(acc: Column, n: Column) -> Column:
        """n: the size of acc's matrix."""
        old, less = acc["m"], n - 1
        cell = lambda q: old[(F.floor(q / less).cast("int") + 1) * n + q % less + 1]
        gone = lambda q: old[(F.floor(q / less).cast("int") + 1) * n] * old[q % less + 1] / old[0]
        left = F.transform(F.sequence(F.lit(0), less * less - 1), lambda q: F.when(old[0] > tiny, cell(q) - gone(q)).otherwise(cell(q)))
        return F.struct(left.alias("m"), F.concat(acc["p"], F.array(F.element_at(old, -1))).alias("p")).cast(kind)

    start = F.struct(m.alias("m"), F.array().cast("array<double>").alias("p")).cast(kind)
    sizes = F.array(*[F.lit(size - k) for k in range(steps)]).cast("array<int>")
    return F.aggregate(sizes, start, step, lambda acc: F.struct(acc["m"].alias("m"), F.concat(acc["p"], F.array(F.element_at(acc["m"], -1))).alias("p")))


def residuals(m: Column, size: int, tiny: float = TINY) -> Column:
    """Array: the last variable's variance, then what is left of it after each of the others, in order, is eliminated too."""
    return eliminated(m, size, size - 1, tiny)["p"]


def _entropy(variance: Column) -> Column:
    return 0.5 * (_LN2PIE + F.ln(F.greatest(variance, F.lit(TINY))))


def _edges(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("dataset_id", F.lit(name).alias("spi"), "i", "j", value.alias("value"))


def _named(c: str, *lags: int) -> list[str]:
    return [f"{c}{k}" for k in lags]


def gaussian_information(mts: DataFrame, names: list[str]) -> DataFrame:
    """Edges of the named statistics; those of a direction share one aggregate.

    xme_gaussian_k<h>: entropy of j now given i's past of h steps. cce_gaussian, di_gaussian: sums over histories of 1 to 5
    steps of j's entropy given both pasts and i now, and of what i tells of j. te_gaussian_k<k>_l<l>: what i's past tells
    of j beyond j's own. si_gaussian (undirected): what is lost by telling each channel from its own past alone.
    """
    deep = [n for n in names if n.startswith("xme") and int(n.rpartition("_k")[2]) > HISTORY]
    if deep and len(deep) < len(names):  # long histories are few products apart from the others', and many with them
        return gaussian_information(mts, [n for n in names if n not in deep]).unionByName(gaussian_information(mts, deep))
    sets: dict[str, tuple[int, list[str]]] = {}
    values: dict[str, Column] = {}
    histories = range(1, HISTORY + 1)
    for name in names:
        kind, *rest = name.split("_")
        if kind in ("cce", "di"):
            left = []
            for k in histories:
                steps = list(range(1, k + 1))
                sets[f"h{k}"] = (k, [*_named("y", *steps), *_named("x", 0, *steps), "y0"])
                left.append(F.col(f"r{k}"))
            values[name] = sum(_entropy(r[2 * k + 1]) if kind == "cce" else _entropy(r[k]) - _entropy(r[2 * k + 1]) for k, r in zip(histories, left, strict=True))
        elif kind == "xme":
            h = int(rest[1][1:])
            sets[name] = (h, [*_named("x", *range(1, h + 1)), "y0"])
            values[name] = _entropy(F.col(f"r_{name}")[h])
        elif kind == "te":
            k, l = (int(c[1:]) for c in rest[1:3])  # noqa: E741
            sets[name] = (max(k, l), [*_named("y", *range(1, k + 1)), *_named("x", *range(1, l + 1)), "y0"])
            values[name] = _entropy(F.col(f"r_{name}")[k]) - _entropy(F.col(f"r_{name}")[k + l])
        elif kind != "si":
            raise KeyError(name)
    parts = []
    if values:
        deepest = max(skip for skip, _ in sets.values())
        m = moments(lag_pairs(mts, deepest), sets)
        size = {n: len(cols) for n, (_, cols) in sets.items()}
        left = m.select(*_PAIR, *[residuals(F.col(n), size[n]).alias(f"r{n[1:]}" if n[1:].isdigit() else f"r_{n}") for n in sets])
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("spi"), v.alias("value")) for n, v in values.items()]))
        parts.append(left.select(*_PAIR, cells.alias("c")).select("dataset_id", "c.spi", "i", "j", "c.value"))
    if "si_gaussian" in names:
        m = moments(lag_pairs(mts, 1, directed=False), {"a": (1, ["x1", "y1", "x0"]), "b": (1, ["y1", "x1", "x0", "y0"])})
        r = m.select(*_PAIR, residuals(F.col("a"), 3).alias("rx"), residuals(F.col("b"), 4).alias("ry"))
        loss = _entropy(F.col("rx")[1]) + _entropy(F.col("ry")[1]) - _entropy(F.col("rx")[2]) - _entropy(F.col("ry")[3])
        parts.append(_edges(r, "si_gaussian", loss))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def covariance_matrices(mts: DataFrame) -> DataFrame:
    """(dataset_id, n, m, procs, s, fourth): times, channels, the covariance matrix, row-major, and the mean of the squared norms' squares."""
    means = mts.select("dataset_id", "t", "proc", (F.col("x") - F.avg("x").over(Window.partitionBy("dataset_id", "proc"))).alias("x"))
    a = means.select("dataset_id", "t", F.col("proc").alias("i"), "x")
    c = a.join(means.select("dataset_id", "t", F.col("proc").alias("j"), F.col("x").alias("y")), ["dataset_id", "t"]).groupBy("dataset_id", "i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("c"), F.count(F.lit(1)).alias("n"))
    one = c.groupBy("dataset_id").agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "c"))), lambda r: r["c"]).alias("s"), F.array_sort(F.collect_set("i")).alias("procs"))
    norms = means.groupBy("dataset_id", "t").agg(F.sum(F.col("x") * F.col("x")).alias("q")).groupBy("dataset_id").agg(F.avg(F.col("q") * F.col("q")).alias("fourth"))
    return one.join(norms, "dataset_id").select("dataset_id", "n", F.size("procs").alias("m"), "procs", "s", "fourth")


def _diagonal(s: Column, m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), m - 1), lambda k: s[k * m + k])


def _add(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, v: x + v)


def shrinkage(estimator: str) -> Column:
    """The weight of the scaled identity in the estimate, of covariance_matrices' columns."""
    if estimator == "EmpiricalCovariance":
        return F.lit(0.0)
    if estimator == "ShrunkCovariance":
        return F.lit(0.1)
    if estimator == "OAS":
        mu = _add(_diagonal(F.col("s"), F.col("m"))) / F.col("m")
        alpha = _add(F.transform("s", lambda v: v * v)) / F.size("s")
        den = (F.col("n") + 1) * (alpha - mu * mu / F.col("m"))
        return F.when(den == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(alpha + mu * mu, den)))
    if estimator == "LedoitWolf":
        squares = _add(F.transform("s", lambda v: v * v))
        mu = _add(_diagonal(F.col("s"), F.col("m"))) / F.col("m")
        weight = F.try_divide((F.col("fourth") - squares) / F.col("n"), squares - F.col("m") * mu * mu)
        return F.least(F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    raise KeyError(estimator)


def inverse(s: Column, m: Column) -> Column:
    """Of a positive definite row-major matrix, by sweeping each variable; one without variance of its own left is skipped."""

    def sweep(a: Column, k: Column) -> Column:
        d = a[k * m + k]

        def cell(e: Column, q: Column) -> Column:
            r, c = F.floor(q / m).cast("int"), (q % m).cast("int")
            plain = e - a[r * m + k] * a[k * m + c] / d
            return F.when((r == k) & (c == k), -1 / d).when(r == k, e / d).when(c == k, e / d).otherwise(plain)

        return F.when(F.abs(d) > TINY, F.transform(a, cell)).otherwise(a)

    swept = F.aggregate(F.sequence(F.lit(0), m - 1), s, sweep)
    return F.transform(swept, lambda v: -v)


def precision(mts: DataFrame, estimators: list[str]) -> DataFrame:
    """Edges i < j of the inverse covariance by each estimator, prec_<estimator>; one row a dataset is inverted."""
    c = covariance_matrices(mts)
    mean = F.aggregate(_diagonal(F.col("s"), F.col("m")), F.lit(0.0), lambda x, v: x + v) / F.col("m")
    each = c.select("*", mean.alias("mu"), F.explode(F.array(*[F.struct(F.lit(f"prec_{e}").alias("spi"), shrinkage(e).alias("a")) for e in estimators])).alias("e")).select("*", "e.spi", "e.a")
    m = F.col("m")
    shrunk = F.transform("s", lambda v, q: (1 - F.col("a")) * v + F.when(F.floor(q / m) == q % m, F.col("a") * F.col("mu")).otherwise(0.0))
    done = each.withColumn("s", shrunk).withColumn("p", inverse(F.col("s"), m)).select("dataset_id", "spi", "m", "procs", F.posexplode("p").alias("q", "value"))
    at = lambda k: F.col("procs")[k.cast("int")]
    return done.select("dataset_id", "spi", at(F.floor(F.col("q") / m)).alias("i"), at(F.col("q") % m).alias("j"), "value").filter("i < j")
