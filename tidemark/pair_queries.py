"""Queries of the pairwise statistics that have DataFrame plans, each with SQL that counts in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.stats import digits
from .operators import edges as E
from .operators import fourier, spi, views
from .operators.moments import zscores
from .registry import EMB, PAIRS, R, emb, ev, query, rounded
from .registry import EVENTS as EVENT_SERIES

_KEYS = "dataset_id, i, j"


def statistics(key: str, names: list[str], sql: str | None, base: Callable = emb, f: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register the named statistics, rounded, as one query."""
    query(key, sql)(lambda s, d: rounded((f or (lambda m: spi.compute(m, names)))(base(s, d)), "value"))


def named(values: dict[str, str], of: str, group: str = f"GROUP BY {_KEYS}") -> str:
    """One SELECT a statistic over the same relation."""
    return " UNION ALL ".join(f"SELECT dataset_id, '{n}' AS spi, i, j, {R.format(v)} AS value FROM {of} {group}" for n, v in values.items())


# ---- spectra ----------------------------------------------------------------------


def spectra_sql(segment: int | None = None, base: str = EMB) -> str:
    seg = f"SELECT dataset_id, proc, x, u // {segment} AS seg, u % {segment} AS u, {segment} AS n FROM f0 WHERE u < n // {segment} * {segment}" if segment else "SELECT dataset_id, proc, x, 0 AS seg, u, n FROM f0"
    return f"""{base},
f0 AS (SELECT dataset_id, proc, x - avg(x) OVER (PARTITION BY dataset_id, proc) AS x, row_number() OVER (PARTITION BY dataset_id, proc ORDER BY t) - 1 AS u, count(*) OVER (PARTITION BY dataset_id, proc) AS n FROM mts),
f1 AS ({seg}),
f2 AS (SELECT f1.*, unnest(range(n // 2 + 1)) AS f FROM f1),
f3 AS (SELECT dataset_id, proc, seg, n, f, k, x * sqrt(2.0 / (n + 1)) * sin(pi() * (k + 1) * (u + 1) / (n + 1)) AS x, f * u % n AS m FROM f2, range(5) r(k)),
fc AS (SELECT dataset_id, proc, seg, n, f, k, sum(x * cos(2 * pi() * m / n)) AS re, -sum(x * CASE WHEN 2 * m % n = 0 THEN 0 ELSE sin(2 * pi() * m / n) END) AS im FROM f3 GROUP BY ALL),
f4 AS (SELECT a.dataset_id, a.proc AS i, b.proc AS j, a.n, a.f, a.re * b.re + a.im * b.im AS r, a.im * b.re - a.re * b.im AS q, a.re ** 2 + a.im ** 2 AS pa, b.re ** 2 + b.im ** 2 AS pb
  FROM fc a JOIN fc b ON a.dataset_id = b.dataset_id AND a.seg = b.seg AND a.f = b.f AND a.k = b.k AND a.proc < b.proc),
f5 AS (SELECT dataset_id, i, j, n, f, sum(r) AS sr, sum(q) AS sq, sqrt(sum(pa) * sum(pb)) AS den, sum(r / sqrt(r * r + q * q)) ** 2 + sum(q / sqrt(r * r + q * q)) ** 2 AS h2, sum(sign(q)) AS sg, sum(abs(q)) AS ab, sum(q * q) AS qq, count(*) AS k FROM f4 GROUP BY ALL),
sp AS (SELECT dataset_id, i, j, f, f / n AS freq, sr / den AS cr, sq / den + 0.0 AS ci, atan2(sq / den + 0.0, sr / den) AS phase, atan2(-sq / den + 0.0, sr / den) AS back, sqrt(sr * sr + sq * sq) / den AS cohmag, sq / den + 0.0 AS icoh, sqrt(h2) / k AS plv, abs(sg) / k AS pli,
  CASE WHEN ab > 1e-300 THEN abs(sq) / ab ELSE 0 END AS wpli, (sg * sg / k - 1) / (k - 1) AS dspli, CASE WHEN abs(ab * ab - qq) > 1e-300 THEN (sq * sq - qq) / (ab * ab - qq) ELSE 0 END AS dswpli, (h2 - k) / (k * (k - 1)) AS ppc FROM f5)"""


def measure_sql(names: list[str]) -> dict[str, str]:
    out = {}
    for n in names:
        m, st, lo, hi = fourier.band_of(n)
        agg = {"mean": "avg", "max": "max"}[st]
        one = lambda c: f"{agg}({c}) FILTER (freq BETWEEN {lo} AND {hi})"  # noqa: B023, E731
        out[n] = one(m) if m in fourier.SYMMETRIC else f"({one(m)} + {one('back' if m == 'phase' else '-' + m)}) / 2"
    return out


def spectral(key: str, names: list[str]) -> None:
    statistics(key, names, f"WITH {spectra_sql()} {named(measure_sql(names), 'sp')}")


spectral("spi_coherence", ["cohmag_mean", "phase_mean", "icoh_mean"])
spectral("spi_plv", ["plv_mean", "pli_mean", "wpli_mean", "dspli_mean", "dswpli_mean", "ppc_mean"])
spectral("spi_spectral_bands", [f"{m}_{st}_{b}" for m in fourier.MEASURES for st, b in (("max", "fmin-0_fmax-0.25"), ("mean", "fmin-0.25_fmax-0.5"))])
SPECTRUM = ["cr", "ci", "phase", *fourier.SYMMETRIC]


def _spectrum_sql(segment: int | None, base: str = EMB) -> str:
    return f"WITH {spectra_sql(segment, base)} SELECT {_KEYS}, f, {', '.join(f'{R.format(c)} AS {c}' for c in SPECTRUM)} FROM sp"


query("spectra_pairs", _spectrum_sql(None))(lambda s, d: rounded(fourier.spectra(emb(s, d)).select("dataset_id", "i", "j", "f", *SPECTRUM), *SPECTRUM))
query("spectra_segments", _spectrum_sql(48, EVENT_SERIES))(lambda s, d: rounded(fourier.spectra(ev(s, d), segment=48).select("dataset_id", "i", "j", "f", *SPECTRUM), *SPECTRUM))
PSI = """, st AS (SELECT dataset_id, i, j, freq, lag(freq) OVER w AS low, lag(cr) OVER w * ci - lag(ci) OVER w * cr AS v FROM sp WINDOW w AS (PARTITION BY dataset_id, i, j ORDER BY f)),
up AS (SELECT dataset_id, i, j, phase - lag(phase) OVER (PARTITION BY dataset_id, i, j ORDER BY f) AS g, freq, f, cohmag ** 2 AS w FROM sp),
un AS (SELECT dataset_id, i, j, freq, w, sum(coalesce(g - 2 * pi() * ceil(g / (2 * pi()) - 0.5), 0)) OVER (PARTITION BY dataset_id, i, j ORDER BY f) AS p FROM up),
dl AS (SELECT dataset_id, 'psi' AS spi, i, j, sum(v) AS value FROM st GROUP BY ALL
  UNION ALL SELECT dataset_id, 'gd', i, j, (sum(w * freq * p) - sum(w * freq) * sum(w * p) / sum(w)) / (sum(w * freq * freq) - sum(w * freq) ** 2 / sum(w)) / (2 * pi()) FROM un GROUP BY ALL)"""
statistics("spi_phase_slope", ["psi", "gd"], f"WITH {spectra_sql()}{PSI} SELECT dataset_id, spi, i, j, {R.format('value')} AS value FROM dl UNION ALL SELECT dataset_id, spi, j, i, {R.format('-value')} FROM dl")

# ---- second moments -----------------------------------------------------------------

ZED = EMB.replace("mts AS (", "m0 AS (") + ", mts AS (SELECT dataset_id, t, proc, CASE WHEN stddev_pop(x) OVER w > 1e-12 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END AS x FROM m0 WINDOW w AS (PARTITION BY dataset_id, proc))"
H = "0.5 * (ln(2 * pi() * exp(1)) + ln(v))"


def elimination_sql(sets: dict[str, tuple[int, list[str]]]) -> str:
    """el(s, dataset_id, i, j, o, v): in each set of variables the last one's variance when the first o are eliminated.

    A matrix is a relation of its cells here, and a step of elimination a join of it with itself.
    """
    cells = ", ".join(f"('{s}', {skip}, {k}, '{c[0]}', {int(c[1:])})" for s, (skip, cols) in sets.items() for k, c in enumerate(cols))
    return f"""{ZED},
vars(s, skip, k, side, lag) AS (VALUES {cells}),
w0 AS (SELECT dataset_id, proc, x, row_number() OVER (PARTITION BY dataset_id, proc ORDER BY t) - 1 AS u, count(*) OVER (PARTITION BY dataset_id, proc) AS n FROM mts),
pq AS (SELECT DISTINCT a.dataset_id, a.proc AS i, b.proc AS j FROM mts a JOIN mts b ON a.dataset_id = b.dataset_id AND a.proc <> b.proc),
va AS (SELECT s, k, p.dataset_id, p.i, p.j, w0.u + lag AS u, w0.x FROM vars JOIN pq p ON true JOIN w0 ON w0.dataset_id = p.dataset_id AND w0.proc = CASE side WHEN 'x' THEN p.i ELSE p.j END WHERE w0.u + lag >= skip AND w0.u + lag < n),
ma AS (SELECT a.s, a.dataset_id, a.i, a.j, a.k AS r, b.k AS c, covar_pop(a.x, b.x) + 1e-12 * any_value(CAST(a.k = b.k AS INTEGER)) AS v FROM va a JOIN va b ON a.s = b.s AND a.dataset_id = b.dataset_id AND a.i = b.i AND a.j = b.j AND a.u = b.u GROUP BY ALL),
ex AS (SELECT s, dataset_id, i, j, 0 AS o, r, c, v FROM ma UNION ALL
  SELECT e.s, e.dataset_id, e.i, e.j, e.o + 1, e.r, e.c, e.v - p.v * q.v / d.v FROM ex e JOIN ex p USING (s, dataset_id, i, j) JOIN ex q USING (s, dataset_id, i, j) JOIN ex d USING (s, dataset_id, i, j)
  WHERE e.r > e.o AND e.c > e.o AND p.r = e.r AND p.c = e.o AND q.r = e.o AND q.c = e.c AND d.r = e.o AND d.c = e.o),
el AS (SELECT e.s, dataset_id, i, j, o, v FROM ex e JOIN (SELECT s, max(k) AS k FROM vars GROUP BY s) m ON e.s = m.s AND r = m.k AND c = m.k)"""


def _past(c: str, n: int) -> list[str]:
    return [f"{c}{k}" for k in range(1, n + 1)]


SETS = {f"h{k}": (k, [*_past("y", k), "x0", *_past("x", k), "y0"]) for k in range(1, 6)} | {
    "m1": (1, ["x1", "y0"]), "m10": (10, [*_past("x", 10), "y0"]), "t2": (2, ["y1", "y2", "x1", "x2", "y0"]), "t1": (1, ["y1", "x1", "y0"]), "sx": (1, ["x1", "y1", "x0"]), "sy": (1, ["y1", "x1", "x0", "y0"]),
}
AT = "CASE s " + " ".join(f"WHEN 'h{k}' THEN {k}" for k in range(1, 6)) + " END"
TERMS = f"""SELECT dataset_id, 'cce_gaussian' AS spi, i, j, sum({H}) AS value FROM el WHERE s[1] = 'h' AND o = 2 * {AT} + 1 GROUP BY dataset_id, i, j
UNION ALL SELECT dataset_id, 'di_gaussian', i, j, sum(CASE WHEN o = {AT} THEN {H} ELSE -({H}) END) FROM el WHERE s[1] = 'h' AND o IN ({AT}, 2 * {AT} + 1) GROUP BY dataset_id, i, j
UNION ALL SELECT dataset_id, 'xme_gaussian_k' || s[2:], i, j, {H} FROM el WHERE s = 'm1' AND o = 1 OR s = 'm10' AND o = 10
UNION ALL SELECT dataset_id, 'te_gaussian_k' || s[2:] || '_l' || s[2:], i, j, sum(CASE WHEN o = TRY_CAST(s[2:] AS INTEGER) THEN {H} ELSE -({H}) END) FROM el WHERE s[1] = 't' AND o IN (TRY_CAST(s[2:] AS INTEGER), 2 * TRY_CAST(s[2:] AS INTEGER)) GROUP BY dataset_id, i, j, s
UNION ALL SELECT dataset_id, 'si_gaussian', i, j, sum(CASE WHEN o = 1 THEN {H} ELSE -({H}) END) FROM el WHERE i < j AND (s = 'sx' AND o IN (1, 2) OR s = 'sy' AND o IN (1, 3)) GROUP BY dataset_id, i, j"""
INFORMATION = ["cce_gaussian", "di_gaussian", "xme_gaussian_k1", "xme_gaussian_k10", "te_gaussian_k1_l1", "te_gaussian_k2_l2", "si_gaussian"]
statistics("spi_gauss_information", INFORMATION, f"WITH RECURSIVE {elimination_sql(SETS)} SELECT dataset_id, spi, i, j, {R.format('value')} AS value FROM ({TERMS})")
PREC = f"""WITH RECURSIVE {EMB},
cn AS (SELECT dataset_id, t, proc, x - avg(x) OVER (PARTITION BY dataset_id, proc) AS x FROM mts),
cv AS (SELECT a.dataset_id, a.proc AS r, b.proc AS c, sum(a.x * b.x) / count(*) AS v, count(*) AS n FROM cn a JOIN cn b ON a.dataset_id = b.dataset_id AND a.t = b.t GROUP BY ALL),
nm AS (SELECT dataset_id, avg(q * q) AS fourth FROM (SELECT dataset_id, t, sum(x * x) AS q FROM cn GROUP BY ALL) GROUP BY dataset_id),
st AS (SELECT dataset_id, any_value(n) AS n, max(r) + 1 AS m, sum(v) FILTER (r = c) / (max(r) + 1) AS mu, sum(v * v) AS sq FROM cv GROUP BY dataset_id),
wt AS (SELECT dataset_id, mu, unnest([0, 0.1, least(greatest((fourth - sq) / n / (sq - m * mu * mu), 0), 1), least(1, (sq / (m * m) + mu * mu) / ((n + 1) * (sq / (m * m) - mu * mu / m)))]) AS a, unnest(['EmpiricalCovariance', 'ShrunkCovariance', 'LedoitWolf', 'OAS']) AS e FROM st JOIN nm USING (dataset_id)),
sw AS (SELECT e, dataset_id, 0 AS o, r, c, (1 - a) * v + CASE WHEN r = c THEN a * mu ELSE 0 END AS v FROM cv JOIN wt USING (dataset_id) UNION ALL
  SELECT e.e, e.dataset_id, e.o + 1, e.r, e.c, CASE WHEN e.r = e.o AND e.c = e.o THEN -1 / d.v WHEN e.r = e.o OR e.c = e.o THEN e.v / d.v ELSE e.v - p.v * q.v / d.v END
  FROM sw e JOIN sw p USING (e, dataset_id) JOIN sw q USING (e, dataset_id) JOIN sw d USING (e, dataset_id) WHERE e.o < 8 AND p.r = e.r AND p.c = e.o AND q.r = e.o AND q.c = e.c AND d.r = e.o AND d.c = e.o)
SELECT dataset_id, 'prec_' || e AS spi, r AS i, c AS j, {R.format('-v')} AS value FROM sw WHERE o = 8 AND r < c"""
statistics("spi_precision", ["prec_EmpiricalCovariance", "prec_LedoitWolf", "prec_OAS", "prec_ShrunkCovariance"], PREC)

# ---- all pairs of times --------------------------------------------------------------

DCOR = f"""WITH {EMB}, {PAIRS},
lp AS (SELECT dataset_id, i, j, 0 AS lag, t, x, y FROM pr UNION ALL SELECT a.dataset_id, a.proc, b.proc, 1, b.t, a.x, b.x FROM mts a JOIN mts b ON a.dataset_id = b.dataset_id AND b.t = a.t + 1 AND a.proc < b.proc),
dd AS (SELECT dataset_id, i, j, a.lag, a.t, b.t AS s, abs(a.x - b.x) AS a, abs(a.y - b.y) AS b, count(*) OVER (PARTITION BY dataset_id, i, j, a.lag) AS nn FROM lp a JOIN lp b USING (dataset_id, i, j) WHERE a.lag = b.lag),
dr AS (SELECT dataset_id, i, j, lag, t, sum(a) AS ar, sum(b) AS br FROM dd GROUP BY ALL),
d1 AS (SELECT dataset_id, i, j, lag, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb FROM dd GROUP BY ALL),
d2 AS (SELECT dataset_id, i, j, lag, count(*)::DOUBLE AS n, sum(ar * br) AS arb, sum(ar * ar) AS ara, sum(br * br) AS brb, sum(ar) AS sa, sum(br) AS sb FROM dr GROUP BY ALL),
dv AS (SELECT dataset_id, i, j, lag, (ab - 2 * arb / (n - 2) + sa * sb / ((n - 1) * (n - 2))) / sqrt((aa - 2 * ara / (n - 2) + sa * sa / ((n - 1) * (n - 2))) * (bb - 2 * brb / (n - 2) + sb * sb / ((n - 1) * (n - 2)))) AS u,
  sqrt(greatest(0, (ab - 2 * arb / n + sa * sb / (n * n)) / sqrt((aa - 2 * ara / n + sa * sa / (n * n)) * (bb - 2 * brb / n + sb * sb / (n * n))))) AS v FROM d1 JOIN d2 USING (dataset_id, i, j, lag))
{named({"dcorr": "max(u) FILTER (lag = 0)", "dcorr_biased": "max(v) FILTER (lag = 0)", "dcorrx_maxlag-1": "max(u)"}, "dv")}"""
statistics("spi_dcor", ["dcorr", "dcorr_biased", "dcorrx_maxlag-1"], DCOR)

# ---- regressions, slopes and bins ----------------------------------------------------

UNIT = EMB.replace("mts AS (", "m0 AS (") + ", mts AS (SELECT dataset_id, t, proc, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS x FROM m0 WINDOW w AS (PARTITION BY dataset_id, proc))"
ORDERED = PAIRS.replace("a.proc < b.proc", "a.proc <> b.proc")
CUBIC = ["x", "x * x", "x * x * x", "y"]
RECI = f"""WITH RECURSIVE {UNIT}, {ORDERED},
cv AS (SELECT {_KEYS}, {', '.join(f'covar_pop({a}, {b}) AS c{q}{r}' for q, a in enumerate(CUBIC) for r, b in enumerate(CUBIC))} FROM pr GROUP BY ALL),
e0 AS ({' UNION ALL '.join(f'SELECT {_KEYS}, {q} AS r, {r} AS c, c{q}{r} AS v FROM cv' for q in range(4) for r in range(4))}),
ex AS (SELECT {_KEYS}, 0 AS o, r, c, v FROM e0 UNION ALL SELECT e.dataset_id, e.i, e.j, e.o + 1, e.r, e.c, e.v - p.v * q.v / d.v FROM ex e JOIN ex p USING (dataset_id, i, j) JOIN ex q USING (dataset_id, i, j) JOIN ex d USING (dataset_id, i, j)
  WHERE e.r > e.o AND e.c > e.o AND p.r = e.r AND p.c = e.o AND q.r = e.o AND q.c = e.c AND d.r = e.o AND d.c = e.o)
SELECT dataset_id, 'reci' AS spi, i, j, {R.format('v')} AS value FROM ex WHERE o = 3 AND r = 3 AND c = 3"""
statistics("spi_reci", ["reci"], RECI)
IGCI = f"""WITH {UNIT}, {ORDERED}, sl AS (SELECT {_KEYS}, x - lag(x) OVER w AS dx, abs(y - lag(y) OVER w) AS dy FROM pr WINDOW w AS (PARTITION BY dataset_id, i, j ORDER BY x, t))
SELECT dataset_id, 'igci' AS spi, i, j, {R.format('coalesce(avg(ln(dy / dx)) FILTER (dx > 0 AND dy > 0), 0)')} AS value FROM sl GROUP BY {_KEYS}"""
statistics("spi_igci", ["igci"], IGCI)
CDS = f"""WITH {EMB}, qs AS (SELECT dataset_id, proc, quantile_cont(x, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) AS q FROM mts GROUP BY ALL),
{ORDERED}, bn AS (SELECT pr.*, greatest(0, least(7, len(list_filter(q, lambda e: e <= x)) - 1)) AS k FROM pr JOIN qs ON pr.dataset_id = qs.dataset_id AND pr.i = qs.proc),
bz AS (SELECT {_KEYS}, k, count(*) OVER w AS n, CASE WHEN stddev_pop(y) OVER w > 1e-12 THEN (y - avg(y) OVER w) / stddev_pop(y) OVER w ELSE 0 END AS z FROM bn WINDOW w AS (PARTITION BY dataset_id, i, j, k)),
bu AS (SELECT {_KEYS}, count(DISTINCT k) AS used FROM bz WHERE n > 1 GROUP BY ALL),
bh AS (SELECT {_KEYS}, k, c.c, count(*) FILTER (CASE WHEN z = 2.5 THEN 7 ELSE floor((z + 2.5) / 0.625) END = c.c) / any_value(n) AS h FROM bz, range(8) c(c) WHERE n > 1 GROUP BY ALL),
bs AS (SELECT {_KEYS}, c, stddev_pop(h) AS sd FROM bh GROUP BY ALL)
SELECT bs.dataset_id, 'cds' AS spi, bs.i, bs.j, {R.format('sum(CASE WHEN used > 1 THEN sd ELSE 0 END) / 8')} AS value FROM bs JOIN bu USING (dataset_id, i, j) GROUP BY ALL"""
statistics("spi_cds", ["cds"], CDS)
LINEAR = f"""WITH {ZED}, {ORDERED}, ls AS (SELECT {_KEYS}, count(*)::DOUBLE AS n, sum(x * y) AS c, sum(x * x) AS xx, sum(y * y) AS yy FROM pr GROUP BY ALL),
lb AS (SELECT *, unnest(['lmfit_Ridge', 'lmfit_Lasso', 'lmfit_ElasticNet']) AS spi, unnest([c / (xx + 1), sign(c) * greatest(abs(c) / n - 1, 0) / (xx / n), sign(c) * greatest(abs(c) / n - 0.5, 0) / (xx / n + 0.5)]) AS b FROM ls)
SELECT dataset_id, spi, i, j, {R.format('(yy - 2 * b * c + b * b * xx) / n')} AS value FROM lb"""
statistics("spi_ridge", ["lmfit_Ridge", "lmfit_Lasso", "lmfit_ElasticNet"], LINEAR)
AEG = f"""WITH {EMB}, {PAIRS}, rg AS (SELECT {_KEYS}, t, y - avg(y) OVER w - covar_pop(x, y) OVER w / var_pop(x) OVER w * (x - avg(x) OVER w) AS r FROM pr WINDOW w AS (PARTITION BY dataset_id, i, j)),
g1 AS (SELECT {_KEYS}, t, lag(r) OVER w AS l, r - lag(r) OVER w AS d, lag(r) OVER w - lag(r, 2) OVER w AS p FROM rg WINDOW w AS (PARTITION BY dataset_id, i, j ORDER BY t)),
g2 AS (SELECT {_KEYS}, count(*) AS n, sum(p * p) AS pp, sum(p * l) AS pl, sum(p * d) AS pd, sum(l * l) AS ll, sum(l * d) AS ld, sum(d * d) AS dd FROM g1 WHERE p IS NOT NULL GROUP BY ALL),
g3 AS (SELECT {_KEYS}, n, ll - pl * pl / pp AS a, ld - pl * pd / pp AS b, dd - pd * pd / pp AS c FROM g2)
SELECT dataset_id, 'coint_aeg_lags-1' AS spi, i, j, {R.format('b / a / sqrt((c - b * b / a) / (n - 2) / a)')} AS value FROM g3"""
statistics("spi_engle_granger", ["coint_aeg_lags-1"], AEG)
statistics("spi_engle_granger_auto", [f"coint_aeg_tstat_trend-{t}_autolag-{c}_maxlag-10" for t in ("c", "ct") for c in ("aic", "bic")], None)

# ---- alignments -----------------------------------------------------------------------

BANDS = {None: "true", "sakoe_chiba": "abs(i0 - (k - i0)) <= 1", "itakura": "(k - i0) / 63 <= 2 * i0 / 63 + 1e-9 AND (k - i0) / 63 >= i0 / 126 - 1e-9 AND 1 - (k - i0) / 63 <= 2 * (1 - i0 / 63) + 1e-9 AND 1 - (k - i0) / 63 >= (1 - i0 / 63) / 2 - 1e-9"}


def alignment_sql(cells: dict[str, str], outside: str, final: str, base: str = EMB) -> str:
    """Antidiagonals as lists, one recursion step each, for series of 64 points: cell (i0, k - i0) from corner, up and left."""
    one = {n: f"CASE WHEN k - i0 BETWEEN 0 AND 63 THEN {c} ELSE {outside} END" for n, c in cells.items()}
    for n, c in one.items():
        for name, at in (("corner", "b[i0]"), ("up", "a[i0]"), ("left", "a[i0 + 1]")):
            c = c.replace(f"@{name}", f"coalesce({at}, {outside})")
        one[n] = c.replace("@x", "x[i0 + 1]").replace("@y", "y[k - i0 + 1]")
    cases = " ".join(f"WHEN '{n}' THEN list_transform(range(64), lambda i0: {c})" for n, c in one.items())
    names = ", ".join(f"('{n}')" for n in cells)
    return f"""WITH RECURSIVE {base}, ch AS (SELECT dataset_id, proc, list(x ORDER BY t) AS v FROM mts GROUP BY ALL),
nm(spi) AS (VALUES {names}),
al AS (SELECT p.dataset_id, spi, p.proc AS i, q.proc AS j, p.v AS x, q.v AS y, 0 AS k, list_transform(range(64), lambda e: {outside}) AS a, list_transform(range(64), lambda e: {outside}) AS b FROM ch p JOIN ch q ON p.dataset_id = q.dataset_id AND p.proc < q.proc JOIN nm ON true
  UNION ALL SELECT dataset_id, spi, i, j, x, y, k + 1, CASE spi {cases} END, a FROM al WHERE k < 127)
SELECT dataset_id, spi, i, j, {R.format(final)} AS value FROM al WHERE k = 127"""


INF = "'inf'::DOUBLE"
COST = "CASE WHEN {} THEN (@x - @y) ** 2 + CASE WHEN k = 0 THEN 0 ELSE {} END ELSE " + INF + " END"
NAMES = {c: f"_{c}" if c else "" for c in BANDS}
statistics("spi_dtw", [f"dtw{NAMES[c]}" for c in BANDS], alignment_sql({f"dtw{NAMES[c]}": COST.format(b, "least(@corner, @up, @left)") for c, b in BANDS.items()}, INF, "sqrt(a[64])"))
SAME = "greatest(@up, @left, CASE WHEN abs(@x - @y) <= 1 AND {} THEN @corner + 1 ELSE 0 END)"
statistics("spi_lcss", [f"lcss{NAMES[c]}" for c in BANDS], alignment_sql({f"lcss{NAMES[c]}": SAME.format(b) for c, b in BANDS.items()}, "0.0::DOUBLE", "a[64] / 64", ZED), f=lambda m: spi.compute(zscores(m), [f"lcss{NAMES[c]}" for c in BANDS]))
SOFT = "(CASE WHEN isinf(least(@corner, @up, @left)) THEN least(@corner, @up, @left) ELSE least(@corner, @up, @left) - ln(exp(least(@corner, @up, @left) - @corner) + exp(least(@corner, @up, @left) - @up) + exp(least(@corner, @up, @left) - @left)) END)"
statistics("spi_soft_dtw", ["softdtw_sakoe_chiba"], alignment_sql({"softdtw_sakoe_chiba": COST.format(BANDS["sakoe_chiba"], SOFT)}, INF, "a[64]"))

# ---- matrices and vectors --------------------------------------------------------------

from .queries import FEAT, THREE, three  # noqa: E402  the statistics that the edge queries share

DIAGONAL = "SELECT DISTINCT dataset_id, spi, i, i AS j, 0.0 AS value FROM ed"
CELLS = f"SELECT dataset_id, spi, i, j, {R.format('value')} AS value"
query("matrix_from_wide", f"WITH {THREE} {CELLS} FROM (SELECT * FROM ed UNION ALL {DIAGONAL})")(lambda s, d: rounded(E.from_wide(E.wide(three(s, d)[0], 8), 8), "value"))


def laid_out(s, d) -> tuple[DataFrame, DataFrame]:
    """The three statistics in the three layouts: covariance as a triangle, the lagged one without, the distance with its diagonal."""
    edges, sizes = three(s, d)
    square = E.with_diagonal(edges.filter("spi = 'pdist_euclidean'"), sizes)
    v = E.to_vectors(edges.filter("spi = 'lag1'"), sizes, "directed").unionByName(E.to_vectors(edges.filter("spi = 'cov'"), sizes, "upper")).unionByName(E.to_vectors(square, sizes, "square"))
    return v, sizes


query("matrix_from_vectors", f"WITH {THREE} {CELLS} FROM (SELECT dataset_id, spi, i, j, CASE WHEN spi = 'cov' AND i > j THEN 0 ELSE value END AS value FROM ed UNION ALL {DIAGONAL} WHERE spi = 'pdist_euclidean')")(lambda s, d: rounded(E.rebuild(*laid_out(s, d)), "value"))
SYM = "SELECT dataset_id, spi, i, j, avg(value) OVER (PARTITION BY dataset_id, spi, least(i, j), greatest(i, j)) AS value FROM ed"
query("matrix_symmetric", f"WITH {THREE} {CELLS} FROM ({SYM} UNION ALL {DIAGONAL} WHERE spi = 'pdist_euclidean')")(lambda s, d: rounded(E.rebuild(*laid_out(s, d), ["cov", "lag1", "pdist_euclidean"]), "value"))

# ---- features in single precision, plot data ---------------------------------------------

SINGLE = FEAT.replace("ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z", "ELSE CAST((value - avg(value) OVER w) / stddev_pop(value) OVER w AS FLOAT) END AS z")
query("feat_spi_spi_single", f"WITH {SINGLE} SELECT dataset_id, spi_a, spi_b, {R.format('rho')} AS rho FROM ft")(lambda s, d: rounded(E.spi_features(E.edge_vectors(*three(s, d), ["lag1"], single=True)), "rho"))
LABELS = [("cov", ["undirected", "signed"]), ("pdist_euclidean", ["undirected", "unsigned"]), ("lag1", ["directed", "signed"])]
COLORS = f"""WITH {THREE}, sp AS (SELECT dataset_id, spi, min(value) AS a, max(value) AS b FROM ed GROUP BY ALL)
SELECT dataset_id, spi, {R.format("CASE spi WHEN 'pdist_euclidean' THEN 0 ELSE -greatest(abs(a), abs(b)) END")} AS vmin, {R.format("CASE spi WHEN 'pdist_euclidean' THEN b ELSE greatest(abs(a), abs(b)) END")} AS vmax,
  CASE spi WHEN 'pdist_euclidean' THEN NULL ELSE 0.0::DOUBLE END AS center, CASE spi WHEN 'pdist_euclidean' THEN 'sequential' ELSE 'diverging' END AS scale FROM sp"""
query("color_ranges", COLORS)(lambda s, d: rounded(views.color_ranges(three(s, d)[0], s.createDataFrame(LABELS, "spi string, labels array<string>")), "vmin", "vmax"))
ROBUST = f"""WITH {EVENT_SERIES}, q AS (SELECT proc, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM mts GROUP BY proc), z AS (SELECT t, mts.proc, coalesce((x - q[2]) / nullif(q[3] - q[1], 0), 0) AS x FROM mts JOIN q ON q.proc = mts.proc)
SELECT t, proc, {R.format('x')} AS x, {R.format('(SELECT greatest(abs(quantile_cont(x, 0.001)), abs(quantile_cont(x, 0.999))) FROM z)')} AS bound FROM z"""
query("mts_scaled_view", ROBUST)(lambda s, d: rounded(views.scaled_series(ev(s, d), robust=True).select("t", "proc", "x", "bound"), "x", "bound"))
RAW = f"""WITH {THREE}, rv AS (SELECT dataset_id, spi, CAST(i * 8 - i * (i + 1) / 2 + j - i - 1 AS INTEGER) AS k, value FROM ed WHERE spi <> 'lag1' AND i < j UNION ALL SELECT dataset_id, spi, i * 8 + j, value FROM ed WHERE spi = 'lag1' UNION ALL SELECT DISTINCT dataset_id, spi, i * 9, 0.0 FROM ed WHERE spi = 'lag1')
SELECT dataset_id, spi, k, {R.format('CAST(CAST((value - avg(value) OVER w) / stddev_pop(value) OVER w AS FLOAT) AS DOUBLE)')} AS z FROM rv WINDOW w AS (PARTITION BY dataset_id, spi)"""
query("feat_raw_whole", RAW)(lambda s, d: E.raw_features(*three(s, d), ["lag1"]).withColumn("z", digits(F.col("z").cast("double"))))
