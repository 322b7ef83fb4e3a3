"""Spectral statistics from one table of Fourier coefficients.

`coefficients` has a row a channel, segment and frequency, with the coefficients of all sine tapers side by side; pairs of
channels meet on the frequency once (`spectra`), and every coherence-family measure, the phase slope and the
group delay are column arithmetic and one aggregate over that table. A series is taken as a whole, or in
segments of a fixed number of points (Welch's averages), with which the work grows as the series' length.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAPERS = 5
#: Below this a denominator counts as zero.
TINY = 1e-300
SYMMETRIC = ("cohmag", "plv", "pli", "wpli", "dspli", "dswpli", "ppc")
ANTISYMMETRIC = ("phase", "icoh")
MEASURES = (*ANTISYMMETRIC, *SYMMETRIC)
_PAIR = ("dataset_id", "i", "j")


def _total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def coefficients(mts: DataFrame, segment: int | None = None, tapers: int = TAPERS) -> DataFrame:
    """(dataset_id, proc, seg, n, f, re0.., im0..): of the demeaned series by sine tapers, f / n from 0 to 0.5.

    Rows are points times frequencies of a segment, summed where they are made; only coefficients move.
    """
    w = Window.partitionBy("dataset_id", "proc")
    place = F.row_number().over(w.orderBy("t")) - 1
    s = mts.select("dataset_id", "proc", (F.col("x") - F.avg("x").over(w)).alias("x"), place.alias("u"), F.count(F.lit(1)).over(w).alias("n"))
    if segment:
        whole = F.floor(F.col("n") / segment) * segment
        s = s.filter(F.col("u") < whole).select("dataset_id", "proc", "x", F.floor(F.col("u") / segment).alias("seg"), (F.col("u") % segment).alias("u"), F.lit(segment).cast("long").alias("n"))
    else:
        s = s.withColumn("seg", F.lit(0).cast("long"))
    tapered = s.withColumns({f"w{k}": F.col("x") * F.sqrt(2 / (F.col("n") + 1)) * F.sin(math.pi * (k + 1) * (F.col("u") + 1) / (F.col("n") + 1)) for k in range(tapers)})
    at = tapered.withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 2)))).withColumn("m", F.col("f") * F.col("u") % F.col("n"))
    # Sines that are zero are exactly so, or signs of imaginary parts at the ends of the range would be noise.
    turn = 2 * math.pi * F.col("m") / F.col("n")
    at = at.withColumn("c", F.cos(turn)).withColumn("s", F.when(2 * F.col("m") % F.col("n") == 0, 0.0).otherwise(F.sin(turn)))
    sums = [F.sum(F.col(f"w{k}") * F.col("c")).alias(f"re{k}") for k in range(tapers)] + [(-F.sum(F.col(f"w{k}") * F.col("s"))).alias(f"im{k}") for k in range(tapers)]
    return at.groupBy("dataset_id", "proc", "seg", "n", "f").agg(*sums)


def spectra(mts: DataFrame, segment: int | None = None, tapers: int = TAPERS) -> DataFrame:
    """(dataset_id, i, j, f, freq, cr, ci, and the measures of MEASURES) for i < j: coherency cr + ci i, from i to j."""
    c = coefficients(mts, segment, tapers)
    side = lambda p, q: c.select("dataset_id", "seg", "n", "f", F.col("proc").alias(p), *[F.col(f"{v}{k}").alias(f"{q}{v}{k}") for v in ("re", "im") for k in range(tapers)])
    met = side("i", "a").join(side("j", "b"), ["dataset_id", "seg", "n", "f"]).filter("i < j")
    each = range(tapers)
    met = met.withColumns({f"r{k}": F.col(f"are{k}") * F.col(f"bre{k}") + F.col(f"aim{k}") * F.col(f"bim{k}") for k in each} | {f"q{k}": F.col(f"aim{k}") * F.col(f"bre{k}") - F.col(f"are{k}") * F.col(f"bim{k}") for k in each})
    met = met.withColumns({f"g{k}": F.greatest(F.sqrt(F.col(f"r{k}") * F.col(f"r{k}") + F.col(f"q{k}") * F.col(f"q{k}")), F.lit(TINY)) for k in each})
    power = lambda p: _total(F.col(f"{p}re{k}") * F.col(f"{p}re{k}") + F.col(f"{p}im{k}") * F.col(f"{p}im{k}") for k in each)
    terms = {
        "sr": _total(F.col(f"r{k}") for k in each), "sq": _total(F.col(f"q{k}") for k in each), "pa": power("a"), "pb": power("b"),
        "hr": _total(F.col(f"r{k}") / F.col(f"g{k}") for k in each), "hq": _total(F.col(f"q{k}") / F.col(f"g{k}") for k in each),
        "sg": _total(F.signum(f"q{k}") for k in each), "ab": _total(F.abs(f"q{k}") for k in each), "qq": _total(F.col(f"q{k}") * F.col(f"q{k}") for k in each),
    }
    if segment:
        sums = met.groupBy(*_PAIR, "n", "f").agg(*[F.sum(e).alias(c) for c, e in terms.items()], (F.count(F.lit(1)) * tapers).alias("k"))
    else:
        sums = met.select(*_PAIR, "n", "f", *[e.alias(c) for c, e in terms.items()], F.lit(tapers).alias("k"))
    k, h2, over = F.col("k"), F.col("hr") * F.col("hr") + F.col("hq") * F.col("hq"), F.col("ab") * F.col("ab") - F.col("qq")
    den = F.sqrt(F.greatest(F.col("pa") * F.col("pb"), F.lit(TINY)))
    coh = sums.withColumn("cr", F.col("sr") / den).withColumn("ci", F.col("sq") / den)
    return coh.select(
        *_PAIR, "f", (F.col("f") / F.col("n")).alias("freq"), "cr", "ci", F.atan2("ci", "cr").alias("phase"), F.sqrt(F.col("cr") * F.col("cr") + F.col("ci") * F.col("ci")).alias("cohmag"), F.col("ci").alias("icoh"),
        (F.sqrt(h2) / k).alias("plv"), (F.abs("sg") / k).alias("pli"), F.when(F.col("ab") > TINY, F.abs("sq") / F.col("ab")).otherwise(0.0).alias("wpli"), ((F.col("sg") * F.col("sg") / k - 1) / (k - 1)).alias("dspli"),
        F.when(F.abs(over) > TINY, (F.col("sq") * F.col("sq") - F.col("qq")) / over).otherwise(0.0).alias("dswpli"), ((h2 - k) / (k * (k - 1))).alias("ppc"),
    )


def band_of(label: str) -> tuple[str, str, float, float]:
    """measure, statistic, and band of a name such as cohmag_max_fmin-0_fmax-0.25."""
    parts = label.split("_")
    given = dict(p.split("-", 1) for p in parts if p.startswith(("fmin-", "fmax-")))
    statistic = next((p for p in parts[1:] if p in ("mean", "max")), "")
    return parts[0], statistic, float(given.get("fmin", 0.0)), float(given.get("fmax", 0.5))


def measures(table: DataFrame, names: list[str]) -> DataFrame:
    """Edges of the named coherence-family statistics, all from one pass over the pairs' spectra.

    Their labels are undirected, so both directions are averaged: a mean phase or imaginary part is 0 by that.
    """

    def value(name: str) -> Column:
        measure, statistic, lo, hi = band_of(name)
        if measure not in MEASURES or not statistic:
            raise KeyError(name)
        inside, agg = F.col("freq").between(lo, hi), F.max if statistic == "max" else F.avg
        there = agg(F.when(inside, F.col(measure)))
        if measure in SYMMETRIC:
            return there
        back = F.atan2(-F.col("ci"), F.col("cr")) if measure == "phase" else -F.col(measure)
        return (there + agg(F.when(inside, back))) / 2

    wide = table.groupBy(*_PAIR).agg(*[value(n).alias(f"v{k}") for k, n in enumerate(names)])
    return _long(wide, names)


def _long(wide: DataFrame, names: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("spi"), F.col(f"v{k}").alias("value")) for k, n in enumerate(names)]))
    return wide.select(*_PAIR, cells.alias("c")).select("dataset_id", "c.spi", "i", "j", "c.value")


def both_ways(edges: DataFrame) -> DataFrame:
    """Antisymmetric edges i < j, and their negatives from j to i."""
    return edges.unionByName(edges.select("dataset_id", "spi", F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("value")).alias("value")))


def phase_slopes(table: DataFrame, names: list[str]) -> DataFrame:
    """Directed: the imaginary part of neighbouring frequencies' coherencies, summed over the band (psi)."""
    w = Window.partitionBy(*_PAIR).orderBy("f")
    step = table.select(*_PAIR, F.lag("freq").over(w).alias("low"), "freq", (F.lag("cr").over(w) * F.col("ci") - F.lag("ci").over(w) * F.col("cr")).alias("v"))
    value = lambda lo, hi: F.coalesce(F.sum(F.when((F.col("low") >= lo) & (F.col("freq") <= hi), F.col("v"))), F.lit(0.0))
    wide = step.groupBy(*_PAIR).agg(*[value(*band_of(n)[2:]).alias(f"v{k}") for k, n in enumerate(names)])
    return both_ways(_long(wide, names))


def group_delays(table: DataFrame, names: list[str]) -> DataFrame:
    """Directed: the slope of the unwrapped phase over frequency, weighed by squared coherence, in cycles (gd)."""
    out = []
    for name in names:
        _, _, lo, hi = band_of(name)
        w = Window.partitionBy(*_PAIR).orderBy("f")
        inside = table.filter(F.col("freq").between(lo, hi))
        gap = F.col("phase") - F.lag("phase").over(w)
        turn = inside.withColumn("step", F.coalesce(gap - 2 * math.pi * F.ceil(gap / (2 * math.pi) - 0.5), F.lit(0.0)))
        un = turn.select(*_PAIR, "freq", (F.col("cohmag") * F.col("cohmag")).alias("w"), F.sum("step").over(w).alias("p"))
        wf, wp, ws = F.sum(F.col("w") * F.col("freq")), F.sum(F.col("w") * F.col("p")), F.sum("w")
        cov = F.sum(F.col("w") * F.col("freq") * F.col("p")) - F.try_divide(wf * wp, ws)
        var = F.sum(F.col("w") * F.col("freq") * F.col("freq")) - F.try_divide(wf * wf, ws)
        out.append(un.groupBy(*_PAIR).agg((F.coalesce(F.try_divide(cov, var), F.lit(0.0)) / (2 * math.pi)).alias("value")).select("dataset_id", F.lit(name).alias("spi"), "i", "j", "value"))
    return both_ways(reduce(DataFrame.unionByName, out))


def channels(mts: DataFrame, standard: bool = False) -> DataFrame:
    """(dataset_id, proc, n, v): a channel's values in order of time, as one array; standard: z-scores, 0 where constant."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda r: r["x"])
    one = mts.groupBy("dataset_id", "proc").agg(rows.alias("v"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    if not standard:
        return one.select("dataset_id", "proc", "n", "v")
    return one.select("dataset_id", "proc", "n", F.transform("v", lambda x: F.when(F.col("sd") < 1e-12, 0.0).otherwise(F.try_divide(x - F.col("mean"), F.col("sd")))).alias("v"))


def met(mts: DataFrame, standard: bool = False, directed: bool = False) -> DataFrame:
    """(dataset_id, i, j, n, x, y): every two channels as arrays."""
    c = channels(mts, standard)
    a = c.select("dataset_id", "n", F.col("proc").alias("i"), F.col("v").alias("x"))
    return a.join(c.select("dataset_id", F.col("proc").alias("j"), F.col("v").alias("y")), "dataset_id").filter("i <> j" if directed else "i < j")


def cross_correlation(mts: DataFrame, statistic: str = "max", squared: bool = False, max_lag: int | None = None, sig_only: bool = False) -> DataFrame:
    """Statistic over lags, all of them or up to max_lag, of the correlation of z-scores, each lag normalised by the whole length.

    sig_only keeps lags beyond 1.96 / sqrt(n); a pair without any falls back to all lags.
    """
    most = F.col("n") - 1 if max_lag is None else F.least(F.lit(max_lag).cast("long"), F.col("n") - 1)
    whole = F.col("n").cast("int")

    def at(lag: Column) -> Column:
        far = F.abs(lag).cast("int")
        x, y = F.slice("x", F.when(lag < 0, far + 1).otherwise(1), whole - far), F.slice("y", F.when(lag > 0, far + 1).otherwise(1), whole - far)
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / F.col("n")

    c = F.transform(F.sequence(-most, most), at)
    c = F.transform(c, lambda v: v * v) if squared else c
    rows = met(mts, standard=True).select(*_PAIR, "n", c.alias("c"))
    if sig_only:
        limit = F.lit(1.96) / F.sqrt("n")
        big = F.filter("c", lambda v: (F.sqrt(v) if squared else F.abs(v)) > limit)
        rows = rows.withColumn("c", F.when(F.size(big) > 0, big).otherwise(F.col("c")))
    value = F.array_max("c") if statistic == "max" else F.aggregate("c", F.lit(0.0), lambda s, v: s + v) / F.size("c")
    return rows.select("dataset_id", F.lit(f"xcorr_{statistic}").alias("spi"), "i", "j", value.alias("value"))
