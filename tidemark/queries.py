"""Registered queries of the time-series engine and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import names as study_names
from .functions import stats
from .functions.stats import digits
from .operators import dominance, learn, spi, spi_sql, views
from .operators import edges as E
from .operators.meeting import together
from .plans import grid
from .registry import EMB, EVENTS, ORACLES, PAIRS, QUERIES, R, emb, ev, pair_sql, query, rounded
from .sources import files, generators, series
from .sources.series import table
from .streaming import windows

# ---- sources -------------------------------------------------------------------

query("mts_from_embeddings", f"WITH {EMB} SELECT * FROM mts")(emb)
query("mts_from_events_dense", f"WITH {EVENTS} SELECT dataset_id, mts_class, instance, t, proc, {R.format('x')} AS x FROM mts")(lambda s, d: rounded(ev(s, d), "x"))
query(
    "mts_from_orders",
    """WITH c AS (SELECT CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS INTEGER) AS t, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS proc, sum(o_totalprice) AS x FROM orders GROUP BY ALL)
SELECT 'orders' AS dataset_id, 'orders' AS mts_class, 0 AS instance, CAST(t - (SELECT min(t) FROM c) AS INTEGER) AS t, proc, round(x, 2) AS x FROM c""",
)(lambda s, d: series.from_orders(table(s, d, "orders")).withColumn("x", F.round("x", 2)))
query("mts_decimate", f"WITH {EVENTS} SELECT t, proc, {R.format('x')} AS x FROM mts WHERE t % 12 = 0")(lambda s, d: rounded(series.decimate(ev(s, d), 12).select("t", "proc", "x"), "x"))
query("mts_crop", f"WITH {EMB} SELECT * FROM mts WHERE t >= 16 AND proc BETWEEN 2 AND 5")(lambda s, d: series.crop(emb(s, d), 16, 2, 5))


@query("mts_zscore", f"WITH {EMB} SELECT dataset_id, proc, t, CASE WHEN stddev_pop(x) OVER w < 1e-12 THEN CASE t WHEN 0 THEN 1e-6 WHEN 1 THEN -1e-6 ELSE 0 END ELSE {R.format('(x - avg(x) OVER w) / stddev_pop(x) OVER w')} END AS z FROM mts WINDOW w AS (PARTITION BY dataset_id, proc)")
def mts_zscore(s: SparkSession, d: str) -> DataFrame:
    z = stats.zscore("x", "dataset_id", "proc", when_flat=stats.first_impulses("t"))
    return rounded(emb(s, d).select("dataset_id", "proc", "t", z.alias("z")), "z")


@query("mts_robust_scale", f"WITH {EMB}, q AS (SELECT dataset_id, proc, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS w FROM mts GROUP BY ALL) SELECT dataset_id, proc, t, {R.format('coalesce((x - m) / nullif(w, 0), 0)')} AS z FROM mts JOIN q USING (dataset_id, proc)")
def mts_robust_scale(s: SparkSession, d: str) -> DataFrame:
    m = emb(s, d)
    q = m.groupBy("dataset_id", "proc").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    z = F.coalesce(F.try_divide(F.col("x") - F.col("q")[1], F.col("q")[2] - F.col("q")[0]), F.lit(0.0))
    return rounded(m.join(q, ["dataset_id", "proc"]).select("dataset_id", "proc", "t", z.alias("z")), "z")


# ---- closed statistics -----------------------------------------------------------


def spi_query(name: str, sql: str, f: Callable[[DataFrame], DataFrame], base=emb) -> None:
    query(name, sql)(lambda s, d: rounded(f(base(s, d)), "value"))


NR = "coalesce(covar_pop({0}x, {0}y) / nullif(stddev_pop({0}x) * stddev_pop({0}y), 0), 0)"
spi_query("spi_cov", pair_sql("covar_pop(x, y)", "cov"), spi_sql.covariance)
spi_query("spi_cov_sq", pair_sql("covar_pop(x, y) ** 2", "cov_sq"), lambda m: spi_sql.covariance(m, True))
spi_query("spi_pearson", pair_sql(NR.format(""), "pearson"), spi_sql.correlation)
spi_query("spi_cov_shrunk", pair_sql("0.9 * covar_pop(x, y)", "cov_shrunk"), spi_sql.shrunk_covariance)
RANKED = EMB.replace("mts AS (", "m0 AS (") + ", mts AS (SELECT dataset_id, t, proc, rank() OVER (PARTITION BY dataset_id, proc ORDER BY x) + (count(*) OVER (PARTITION BY dataset_id, proc, x) - 1) / 2.0 AS x FROM m0)"
spi_query("spi_spearman", pair_sql(NR.format(""), "spearman", RANKED), spi_sql.spearman)
spi_query("spi_spearman_sq", pair_sql(f"({NR.format('')}) ** 2", "spearman_sq", RANKED), lambda m: spi_sql.spearman(m, True))
KEND = ", kp AS (SELECT a.dataset_id, a.i, a.j, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM pr a JOIN pr b ON a.dataset_id = b.dataset_id AND a.i = b.i AND a.j = b.j AND a.t < b.t)"
spi_query("spi_kendall", pair_sql("coalesce(sum(sx * sy) / nullif(sqrt(sum(abs(sx)) * sum(abs(sy))), 0), 0)", "kendall", more=KEND, of="kp"), dominance.kendall)
ZS = EMB.replace("mts AS (", "m0 AS (") + ", mts AS (SELECT dataset_id, t, proc, coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0) AS x, count(*) OVER w AS n FROM m0 WINDOW w AS (PARTITION BY dataset_id, proc))"
XC = f"WITH {ZS}, lg AS (SELECT a.dataset_id, a.proc AS i, b.proc AS j, b.t - a.t AS lag, sum(a.x * b.x) / any_value(a.n) AS c, any_value(a.n) AS n FROM mts a JOIN mts b ON a.dataset_id = b.dataset_id AND a.proc < b.proc GROUP BY ALL)"
spi_query("spi_xcorr_max", f"{XC} SELECT dataset_id, 'xcorr_max' AS spi, i, j, {R.format('max(c)')} AS value FROM lg GROUP BY dataset_id, i, j", spi_sql.cross_correlation)
spi_query("spi_xcorr_mean", f"{XC} SELECT dataset_id, 'xcorr_mean' AS spi, i, j, {R.format('avg(c)')} AS value FROM lg GROUP BY dataset_id, i, j", lambda m: spi_sql.cross_correlation(m, "mean"))
spi_query("spi_xcorr_sigonly", f"{XC} SELECT dataset_id, 'xcorr_mean' AS spi, i, j, {R.format('coalesce(avg(c) FILTER (abs(c) > 1.96 / sqrt(n)), avg(c))')} AS value FROM lg GROUP BY dataset_id, i, j", lambda m: spi_sql.cross_correlation(m, "mean", sig_only=True))
DIST = {
    "euclidean": "sqrt(sum((x - y) * (x - y)))", "cityblock": "sum(abs(x - y))", "cosine": "1 - coalesce(sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 0)", "chebyshev": "max(abs(x - y))",
    "canberra": "sum(coalesce(abs(x - y) / nullif(abs(x) + abs(y), 0), 0))", "braycurtis": "coalesce(sum(abs(x - y)) / nullif(sum(abs(x + y)), 0), 0)",
}
for metric, sql in DIST.items():
    spi_query(f"spi_dist_{metric}", pair_sql(sql, f"pdist_{metric}"), lambda m, k=metric: spi_sql.distance(m, k))
spi_query("spi_barycenter_euclid_mean", pair_sql("avg((x + y) / 2)", "bary_euclidean_mean"), spi_sql.barycenter_euclidean)
spi_query("spi_barycenter_euclid_max", pair_sql("max((x + y) / 2)", "bary_euclidean_max"), lambda m: spi_sql.barycenter_euclidean(m, "max"))
DET = "(var_pop(x) * var_pop(y) - covar_pop(x, y) ** 2)"
L2 = "ln(2 * pi() * exp(1))"
spi_query("spi_gauss_mi", pair_sql(f"-0.5 * ln(1 - ({NR.format('')}) ** 2)", "mi_gaussian"), spi_sql.mutual_information)
spi_query("spi_gauss_joint_entropy", pair_sql(f"{L2} + 0.5 * ln{DET}", "je_gaussian"), spi_sql.joint_entropy)
spi_query("spi_gauss_cond_entropy", pair_sql(f"{L2} + 0.5 * ln{DET} - 0.25 * (2 * {L2} + ln(var_pop(x)) + ln(var_pop(y)))", "ce_gaussian"), spi_sql.conditional_entropy)
LAG = f"WITH {EVENTS}, lx AS (SELECT *, lag(x) OVER (PARTITION BY dataset_id, proc ORDER BY t) AS p FROM mts), pr AS (SELECT a.dataset_id, a.proc AS i, b.proc AS j, a.p AS x, b.x AS y FROM lx a JOIN mts b ON a.dataset_id = b.dataset_id AND a.t = b.t AND a.proc <> b.proc WHERE a.p IS NOT NULL)"
spi_query("spi_gauss_tlmi", f"{LAG} SELECT dataset_id, 'tlmi_gaussian' AS spi, i, j, {R.format(f'-0.5 * ln(1 - ({NR.format("")}) ** 2)')} AS value FROM pr GROUP BY dataset_id, i, j", spi_sql.lagged_mutual_information, ev)
STE = f"""WITH {EVENTS}, s0 AS (SELECT dataset_id, proc, t, CAST(x > lag(x) OVER w AS INTEGER) AS s FROM mts WINDOW w AS (PARTITION BY dataset_id, proc ORDER BY t)),
s1 AS (SELECT *, lag(s) OVER (PARTITION BY dataset_id, proc ORDER BY t) AS p FROM s0 WHERE s IS NOT NULL),
c AS (SELECT a.dataset_id, a.proc AS i, b.proc AS j, b.s AS y, b.p AS yp, a.p AS xp, CAST(count(*) AS DOUBLE) AS n FROM s1 a JOIN s1 b ON a.dataset_id = b.dataset_id AND a.t = b.t AND a.proc <> b.proc WHERE a.p IS NOT NULL AND b.p IS NOT NULL GROUP BY ALL),
k AS (SELECT dataset_id, i, j, n / sum(n) OVER (PARTITION BY dataset_id, i, j) * ln(n * sum(n) OVER (PARTITION BY dataset_id, i, j, yp) / (sum(n) OVER (PARTITION BY dataset_id, i, j, yp, xp) * sum(n) OVER (PARTITION BY dataset_id, i, j, y, yp))) AS term FROM c)
SELECT dataset_id, 'te_symbolic' AS spi, i, j, {R.format('sum(term)')} AS value FROM k GROUP BY dataset_id, i, j"""
spi_query("spi_symbolic_te_k1", STE, spi_sql.symbolic_transfer_entropy, ev)

# ---- numerical statistics (checked against numpy in the tests) ------------------------

FAMILIES = {
    "spi_precision": ["prec_EmpiricalCovariance", "prec_LedoitWolf", "prec_OAS", "prec_ShrunkCovariance"], "spi_cov_robust": ["cov_MinCovDet", "cov_EllipticEnvelope", "cov_GraphicalLasso", "cov_GraphicalLassoCV"],
    "spi_dcor": ["dcorr", "dcorr_biased", "dcorrx_maxlag-1"], "spi_hsic": ["hsic", "hsic_biased"], "spi_mgc": ["mgc"], "spi_hhg": ["hhg"], "spi_dtw": ["dtw", "dtw_itakura", "dtw_sakoe_chiba"], "spi_soft_dtw": ["softdtw_sakoe_chiba"], "spi_lcss": ["lcss"],
    "spi_barycenter_dtw": ["bary_sgddtw_mean"], "spi_gromov_wasserstein": ["gwtau"], "spi_causal": ["anm", "cds", "reci", "igci"], "spi_ccm": ["ccm_mean_E-1"], "spi_entropies": ["je_kozachenko", "je_kernel", "ce_kernel", "cce_gaussian", "xme_gaussian_k1", "di_gaussian", "si_gaussian"],
    "spi_mutual_information": ["mi_kraskov_NN-4", "mi_kernel_W-0.25", "tlmi_kraskov_NN-4"], "spi_transfer_entropy": ["te_kraskov_k1_l1", "te_kernel_k1", "te_symbolic_k10", "te_gaussian_k1_l1"], "spi_integrated_information": ["phi_star", "phi_Geo"],
    "spi_coherence": ["cohmag_mean", "phase_mean", "icoh_mean"], "spi_plv": ["plv_mean", "pli_mean", "wpli_mean", "dspli_mean", "dswpli_mean", "ppc_mean"], "spi_directed_spectral": ["dtf_mean", "dcoh_mean", "pdc_mean", "gpdc_mean", "ddtf_mean"], "spi_phase_slope": ["psi", "gd"], "spi_wavelet": ["wpsi_mean"],
    "spi_granger": ["sgc_nonparametric_mean", "sgc_parametric_order-1_mean"], "spi_linear_model": ["lmfit_Ridge", "lmfit_Lasso", "lmfit_ElasticNet", "lmfit_BayesianRidge", "lmfit_SGDRegressor"], "spi_gp_model": ["gpfit_RBF", "gpfit_DotProduct"],
    "spi_cointegration": ["coint_johansen_trace_stat_order-0_ardiff-1", "coint_aeg_lags-1"], "spi_envelope": ["pec", "pec_orth", "pec_log"],
}
for key, names in FAMILIES.items():
    query(key)(lambda s, d, n=names: spi.compute(emb(s, d), n))
query("spi_catalogue")(lambda s, d: spi.catalogue(s))

# ---- edges and features -------------------------------------------------------------


def three(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Covariance, Euclidean distance, and a directed lag-1 covariance."""
    m = emb(s, d)
    past = F.lag("x").over(Window.partitionBy("dataset_id", "proc").orderBy("t")).alias("past")
    met = together(m.select("dataset_id", "t", "proc", "x", past), {"x": "x", "past": "past"}, {"x": "y"}, True)
    # A null past drops out of the lagged covariance; the other two are taken of i < j, once.
    x, y, up = F.col("x"), F.col("y"), F.col("i") < F.col("j")
    made = met.groupBy("dataset_id", "i", "j").agg(F.covar_pop("past", "y").alias("lag1"), F.covar_pop(F.when(up, x), F.when(up, y)).alias("cov"), F.sqrt(F.sum(F.when(up, (x - y) * (x - y)))).alias("pdist_euclidean"))
    cell = lambda n, i, j: F.struct(F.lit(n).alias("spi"), F.col(i).alias("i"), F.col(j).alias("j"), F.col(n).alias("value"))
    both = [cell(n, *way) for n in ("cov", "pdist_euclidean") for way in (("i", "j"), ("j", "i"))]
    cells = F.explode(F.when(up, F.array(*both, cell("lag1", "i", "j"))).otherwise(F.array(cell("lag1", "i", "j"))))
    return made.select("dataset_id", cells.alias("c")).select("dataset_id", "c.*"), spi.sizes(m)


THREE = f"""{EMB}, {PAIRS}, lg AS (SELECT dataset_id, t, proc, lag(x) OVER (PARTITION BY dataset_id, proc ORDER BY t) AS x FROM mts),
und AS (SELECT dataset_id, 'cov' AS spi, i, j, covar_pop(x, y) AS value FROM pr GROUP BY ALL UNION ALL SELECT dataset_id, 'pdist_euclidean', i, j, sqrt(sum((x - y) * (x - y))) FROM pr GROUP BY ALL),
ed AS (SELECT * FROM und UNION ALL SELECT dataset_id, spi, j, i, value FROM und UNION ALL SELECT a.dataset_id, 'lag1', a.proc, b.proc, covar_pop(a.x, b.x) FROM lg a JOIN mts b ON a.dataset_id = b.dataset_id AND a.t = b.t AND a.proc <> b.proc WHERE a.x IS NOT NULL GROUP BY a.dataset_id, a.proc, b.proc)"""
UP, LOW = "CAST(i * 8 - i * (i + 1) / 2 + j - i - 1 AS INTEGER)", "CAST(i * (i - 1) / 2 + j AS INTEGER)"
MEAN = "avg(value) OVER (PARTITION BY dataset_id, spi, least(i, j), greatest(i, j))"
query("mpi_symmetrise", f"WITH {THREE} SELECT dataset_id, spi, i, j, {R.format(MEAN)} AS value FROM ed")(lambda s, d: rounded(E.symmetrise(three(s, d)[0]), "value"))
query("mpi_zero_diag", f"WITH {THREE} SELECT dataset_id, spi, i, j, {R.format('value')} AS value FROM ed UNION ALL SELECT DISTINCT dataset_id, spi, i, i, 0.0 FROM ed")(lambda s, d: rounded(E.with_diagonal(*three(s, d)), "value"))
query("mpi_wide", f"WITH {THREE} SELECT dataset_id, spi, i, " + ", ".join(f"{R.format(f'max(value) FILTER (j = {j})')} AS \"proc-{j}\"" for j in range(8)) + " FROM ed GROUP BY dataset_id, spi, i")(lambda s, d: rounded(E.wide(three(s, d)[0], 8), *[f"proc-{j}" for j in range(8)]))
query("edges_upper", f"WITH {THREE} SELECT dataset_id, spi, i, j, {R.format('value')} AS value, {UP} AS k FROM ed WHERE i < j")(lambda s, d: rounded(E.upper(*three(s, d)), "value"))
query("edges_lower", f"WITH {THREE} SELECT dataset_id, spi, i, j, {R.format('value')} AS value, {LOW} AS k FROM ed WHERE i > j")(lambda s, d: rounded(E.lower(three(s, d)[0]), "value"))
query("edges_full", f"WITH {THREE} SELECT dataset_id, spi, i, j, {R.format('value')} AS value, i * 8 + j AS k FROM ed")(lambda s, d: rounded(E.full(*three(s, d)), "value"))
VEC = f"""{THREE}, v0 AS (SELECT dataset_id, CASE spi WHEN 'lag1' THEN 'lag1__ij' ELSE spi END AS spi, {UP} AS k, value FROM ed WHERE i < j UNION ALL SELECT dataset_id, 'lag1__ji', {LOW}, value FROM ed WHERE i > j AND spi = 'lag1'),
vec AS (SELECT dataset_id, spi, k, CASE WHEN stddev_pop(value) OVER w < 1e-12 THEN 0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM v0 WINDOW w AS (PARTITION BY dataset_id, spi))"""
FEAT = f"""{VEC}, rk AS (SELECT dataset_id, spi, k, rank() OVER (PARTITION BY dataset_id, spi ORDER BY z) + (count(*) OVER (PARTITION BY dataset_id, spi, z) - 1) / 2.0 AS r FROM vec),
ft AS (SELECT a.dataset_id, a.spi AS spi_a, b.spi AS spi_b, coalesce(covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0), 0) AS rho FROM rk a JOIN rk b ON a.dataset_id = b.dataset_id AND a.k = b.k AND a.spi < b.spi GROUP BY a.dataset_id, a.spi, b.spi)"""
query("edge_vec_safe_zscore", f"WITH {VEC} SELECT dataset_id, spi, k, {R.format('z')} AS z FROM vec")(lambda s, d: rounded(E.edge_vectors(*three(s, d), ["lag1"]), "z"))


def split_features(s: SparkSession, d: str) -> DataFrame:
    return E.spi_features(E.edge_vectors(*three(s, d), ["lag1"]))


def classed(s: SparkSession, d: str) -> DataFrame:
    f = split_features(s, d)
    return f.select("dataset_id", F.substring_index("dataset_id", "_", 1).alias("mts_class"), F.concat_ws("|", "spi_a", "spi_b").alias("feature"), digits(F.col("rho"), 4).alias("value"))


query("feat_spi_spi_split", f"WITH {FEAT} SELECT dataset_id, spi_a, spi_b, {R.format('rho')} AS rho FROM ft")(lambda s, d: rounded(split_features(s, d), "rho"))
query("feat_raw", f"WITH {VEC} SELECT dataset_id, spi || ':' || k AS edge, {R.format('z')} AS z FROM vec")(lambda s, d: rounded(E.edge_vectors(*three(s, d), ["lag1"]).select("dataset_id", F.concat_ws(":", "spi", "k").alias("edge"), "z"), "z"))
MIXED = f"""WITH {THREE},
up AS (SELECT dataset_id, spi, {UP} AS k, value FROM ed WHERE i < j AND spi <> 'lag1'),
fu AS (SELECT dataset_id, spi, i * 8 + j AS k, value FROM ed UNION ALL SELECT DISTINCT dataset_id, spi, i * 9, 0.0 FROM ed),
ru AS (SELECT dataset_id, spi, k, rank() OVER (PARTITION BY dataset_id, spi ORDER BY value) + (count(*) OVER (PARTITION BY dataset_id, spi, value) - 1) / 2.0 AS r FROM up),
rf AS (SELECT dataset_id, spi, k, rank() OVER (PARTITION BY dataset_id, spi ORDER BY value) + (count(*) OVER (PARTITION BY dataset_id, spi, value) - 1) / 2.0 AS r FROM fu),
pp AS (SELECT a.dataset_id, a.spi AS spi_a, b.spi AS spi_b, a.r AS x, b.r AS y FROM ru a JOIN ru b ON a.dataset_id = b.dataset_id AND a.k = b.k AND a.spi < b.spi
UNION ALL SELECT a.dataset_id, a.spi, b.spi, a.r, b.r FROM rf a JOIN rf b ON a.dataset_id = b.dataset_id AND a.k = b.k AND a.spi < b.spi WHERE a.spi = 'lag1' OR b.spi = 'lag1')
SELECT dataset_id, spi_a, spi_b, {R.format("coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0)")} AS rho FROM pp GROUP BY dataset_id, spi_a, spi_b"""
query("feat_spi_spi_mixed", MIXED)(lambda s, d: rounded(E.mixed_features(*three(s, d), ["lag1"]), "rho"))
CL = f"""WITH {FEAT}, cl AS (SELECT split_part(dataset_id, '_', 1) AS mts_class, spi_a || '|' || spi_b AS feature, round(rho, 4) + 0.0 AS value FROM ft),
pc AS (SELECT a.mts_class AS class_a, b.mts_class AS class_b FROM (SELECT DISTINCT mts_class FROM cl) a JOIN (SELECT DISTINCT mts_class FROM cl) b ON a.mts_class < b.mts_class),
mn AS (SELECT class_a, class_b, feature, value, mts_class = class_a AS in_a FROM cl JOIN pc ON mts_class IN (class_a, class_b)),
cdf AS (SELECT *, sum(CAST(in_a AS INTEGER)) OVER r / sum(CAST(in_a AS INTEGER)) OVER w AS fa, sum(CAST(NOT in_a AS INTEGER)) OVER r / sum(CAST(NOT in_a AS INTEGER)) OVER w AS fb FROM mn WINDOW r AS (PARTITION BY class_a, class_b, feature ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w AS (PARTITION BY class_a, class_b, feature))"""
for alt, gap in (("two-sided", "abs(fa - fb)"), ("greater", "fa - fb"), ("less", "fb - fa")):
    query(f"ks_{alt.replace('-', '_')}", f"{CL} SELECT class_a, class_b, feature, {R.format(f'max({gap})')} AS ks, count(*) FILTER (in_a) AS n_a, count(*) FILTER (NOT in_a) AS n_b FROM cdf GROUP BY class_a, class_b, feature")(lambda s, d, a=alt: rounded(every_class(s, d, lambda f, classes: E.ks_between(f, classes, a)), "ks"))
query("ks_topk", f"{CL} SELECT class_a, class_b, feature, {R.format('max(abs(fa - fb))')} AS ks FROM cdf GROUP BY class_a, class_b, feature ORDER BY ks DESC, class_a, class_b, feature LIMIT 25")(lambda s, d: rounded(every_class(s, d, E.ks_between), "ks").orderBy(F.desc("ks"), "class_a", "class_b", "feature").limit(25).select("class_a", "class_b", "feature", "ks"))


def every_class(s: SparkSession, d: str, ks: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """A statistic between each two of the classes that the data have, in order of name."""
    f = classed(s, d)
    return ks(f, [r[0] for r in f.select("mts_class").distinct().orderBy("mts_class").collect()])  # class names only


KDE = f"""{CL},
st AS (SELECT feature, mts_class, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, count(*) AS n FROM cl GROUP BY ALL),
tw AS (SELECT a.feature, a.mts_class AS class_a, b.mts_class AS class_b, a.sd AS sa, b.sd AS sb, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi, a.n AS n_a, b.n AS n_b FROM st a JOIN st b ON a.feature = b.feature AND a.mts_class < b.mts_class),
gr AS (SELECT *, lo + (hi - lo) * k / 511 AS g FROM tw CROSS JOIN (SELECT unnest(range(512)) AS k) WHERE sa > 1e-12 AND sb > 1e-12),
de AS (SELECT class_a, class_b, gr.feature, k, sum(CASE WHEN mts_class = class_a THEN exp(-0.5 * power((g - value) / (0.5 * sa), 2)) ELSE 0 END) AS da, sum(CASE WHEN mts_class = class_b THEN exp(-0.5 * power((g - value) / (0.5 * sb), 2)) ELSE 0 END) AS db
FROM gr JOIN cl ON cl.feature = gr.feature AND mts_class IN (class_a, class_b) GROUP BY ALL),
cu AS (SELECT class_a, class_b, feature, abs(sum(da) OVER r / sum(da) OVER w - sum(db) OVER r / sum(db) OVER w) AS gap FROM de WINDOW r AS (PARTITION BY class_a, class_b, feature ORDER BY k ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY class_a, class_b, feature)),
sm AS (SELECT class_a, class_b, feature, max(gap) AS ks FROM cu GROUP BY ALL), pl AS (SELECT class_a, class_b, feature, max(abs(fa - fb)) AS ks FROM cdf GROUP BY ALL)
SELECT class_a, class_b, feature, {R.format("coalesce(sm.ks, pl.ks)")} AS ks, n_a, n_b FROM tw JOIN pl USING (class_a, class_b, feature) LEFT JOIN sm USING (class_a, class_b, feature)"""
WIDTHS = [0.1, 0.2, 0.5]
SWEEP = KDE.replace("FROM gr JOIN cl ON", ", bw FROM (SELECT *, unnest([0.1, 0.2, 0.5]) AS bw FROM gr) gr JOIN cl ON").replace("0.5 * sa", "bw * sa").replace("0.5 * sb", "bw * sb").replace("SELECT class_a, class_b, feature, abs(", "SELECT class_a, class_b, feature, bw, abs(").replace("PARTITION BY class_a, class_b, feature ORDER BY k ROWS", "PARTITION BY class_a, class_b, feature, bw ORDER BY k ROWS").replace("w AS (PARTITION BY class_a, class_b, feature)),\nsm AS (SELECT class_a, class_b, feature, max(gap)", "w AS (PARTITION BY class_a, class_b, feature, bw)),\nsm AS (SELECT class_a, class_b, feature, bw, max(gap)")
SWEEP = SWEEP[: SWEEP.rindex("SELECT class_a")] + f"""SELECT class_a, class_b, feature, b.bw AS bandwidth, {R.format("coalesce(sm.ks, pl.ks)")} AS ks, n_a, n_b FROM (SELECT *, unnest([0.1, 0.2, 0.5]) AS bw FROM tw) b JOIN pl USING (class_a, class_b, feature) LEFT JOIN sm USING (class_a, class_b, feature, bw)"""
query("ks_sweep", SWEEP)(lambda s, d: rounded(every_class(s, d, lambda f, classes: E.ks_sweep(f, classes, WIDTHS)), "ks"))
query("ks_kde", KDE)(lambda s, d: rounded(every_class(s, d, lambda f, classes: E.ks_kde(f, classes, 0.5)), "ks"))
query("class_densities", f"{CL.split(',' + chr(10) + 'pc AS')[0]} SELECT mts_class, feature, CAST(greatest(0, least(19, floor((value + 1.0) / 0.1))) AS INTEGER) AS bin, count(*) AS n FROM cl GROUP BY ALL")(lambda s, d: views.densities(classed(s, d)).drop("share"))
SCATTER = f"""WITH {THREE}, xy AS (SELECT u.dataset_id, 'ij' AS way, u.i, u.j, u.value AS x, v.value AS y FROM ed u JOIN ed v ON u.dataset_id = v.dataset_id AND u.i = v.i AND u.j = v.j WHERE u.spi = 'cov' AND v.spi = 'lag1' AND u.i < u.j
UNION ALL SELECT u.dataset_id, 'ji', u.i, u.j, u.value, v.value FROM (SELECT *, {UP} AS k FROM ed WHERE spi = 'cov' AND i < j) u JOIN (SELECT *, {LOW} AS k FROM ed WHERE spi = 'lag1' AND i > j) v ON u.dataset_id = v.dataset_id AND u.k = v.k),
rk AS (SELECT *, rank() OVER (PARTITION BY dataset_id, way ORDER BY x) + (count(*) OVER (PARTITION BY dataset_id, way, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY dataset_id, way ORDER BY y) + (count(*) OVER (PARTITION BY dataset_id, way, y) - 1) / 2.0 AS ry FROM xy)
SELECT dataset_id, way, count(*) AS n, {R.format("coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0)")} AS rho FROM rk GROUP BY dataset_id, way"""
query("two_spi_scatter", SCATTER)(lambda s, d: rounded(views.scatter(*three(s, d), "cov", "lag1", ["lag1"]).groupBy("dataset_id", "way").agg(F.count("*").alias("n"), F.max("rho").alias("rho")), "rho"))
query("heat_map_ranges", f"WITH {THREE} SELECT dataset_id, spi, {R.format('min(value)')} AS low, {R.format('max(value)')} AS high, CASE WHEN spi LIKE 'cov%' THEN 'diverging' WHEN spi LIKE '%dist%' THEN 'sequential' WHEN min(value) < 0 AND max(value) > 0 THEN 'diverging' ELSE 'sequential' END AS scale FROM ed GROUP BY dataset_id, spi")(lambda s, d: rounded(views.heat_maps(three(s, d)[0]).select("dataset_id", "spi", "low", "high", "scale").distinct(), "low", "high"))
AXES = f"""{CL.replace("WITH ", "WITH RECURSIVE ", 1)},
zz AS (SELECT dataset_id, split_part(dataset_id, '_', 1) AS mts_class, spi_a || '|' || spi_b AS feature, round(rho, 4) + 0.0 AS v FROM ft),
zs AS (SELECT dataset_id, mts_class, feature, CASE WHEN stddev_pop(v) OVER w < 1e-12 THEN 0 ELSE (v - avg(v) OVER w) / stddev_pop(v) OVER w END AS z FROM zz WINDOW w AS (PARTITION BY feature)),
co AS (SELECT a.feature AS fa, b.feature AS fb, sum(a.z * b.z) AS c FROM zs a JOIN zs b USING (dataset_id) GROUP BY ALL),
cr AS (SELECT fa, list(c ORDER BY fb) AS r FROM co GROUP BY fa), cm AS (SELECT list(r ORDER BY fa) AS m, list(fa ORDER BY fa) AS f FROM cr),
p1 AS (SELECT 0 AS k, m, list_transform(range(len(f)), lambda i: 1.0::DOUBLE + 0.3 * i) AS v, 0.0::DOUBLE AS l FROM cm UNION ALL SELECT k + 1, m, list_transform(m, lambda r: list_dot_product(r, v) / sqrt(list_sum(list_transform(m, lambda q: list_dot_product(q, v) ** 2)))), sqrt(list_sum(list_transform(m, lambda q: list_dot_product(q, v) ** 2))) FROM p1 WHERE k < 3000),
a1 AS (SELECT m, v, l FROM p1 WHERE k = 3000),
p2 AS (SELECT 0 AS k, list_transform(range(len(v)), lambda i: list_transform(range(len(v)), lambda j: m[i + 1][j + 1] - l * v[i + 1] * v[j + 1])) AS m, list_transform(range(len(v)), lambda i: 1.0::DOUBLE + 0.3 * i) AS v, 0.0::DOUBLE AS l FROM a1 UNION ALL SELECT k + 1, m, list_transform(m, lambda r: list_dot_product(r, v) / sqrt(list_sum(list_transform(m, lambda q: list_dot_product(q, v) ** 2)))), sqrt(list_sum(list_transform(m, lambda q: list_dot_product(q, v) ** 2))) FROM p2 WHERE k < 3000),
ax AS (SELECT 1 AS c, v, l FROM a1 UNION ALL SELECT 2, v, l FROM p2 WHERE k = 3000),
lo AS (SELECT c, l, unnest(f) AS feature, unnest(list_transform(v, lambda e: e * sign(CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END))) AS w FROM ax, cm)"""
query("pca_scores", f"{AXES} SELECT dataset_id, mts_class, {R.format('sum(z * w) FILTER (c = 1)')} AS pc1, {R.format('sum(z * w) FILTER (c = 2)')} AS pc2 FROM zs JOIN lo USING (feature) GROUP BY dataset_id, mts_class")(lambda s, d: rounded(learn.pca(classed(s, d))[0], "pc1", "pc2"))
query("pca_shares", f"{AXES} SELECT c AS component, {R.format('max(l) / (SELECT sum(z * z) FROM zs)')} AS share FROM lo GROUP BY c")(lambda s, d: rounded(s.createDataFrame(list(enumerate(learn.pca(classed(s, d))[1], 1)), "component int, share double"), "share"))
query("tsne_scores")(lambda s, d: learn.embedding(classed(s, d)))
query("feature_select_forward")(lambda s, d: s.createDataFrame([(k, *x) for k, x in enumerate(learn.forward_selection(classed(s, d)))], "step int, feature string, accuracy double"))

def market_closes(s: SparkSession, d: str) -> DataFrame:
    """Daily sums by event type, as the closes of as many names."""
    e = table(s, d, "events").filter("value is not null")
    prices = e.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("ticker")).agg(F.round(F.sum("value"), 4).alias("close"))
    names = files.universe(s, [r[0] for r in e.select("event_type").distinct().collect()])  # the few types
    return files.market_sample(prices, names, len(names)).select("t", "proc", "x")


# ---- generators, grids, strings ---------------------------------------------------------


def specs_of(s: SparkSession, names: list[str], m: int, t: int) -> DataFrame:
    return s.createDataFrame([(f"{g}_{k}", g, k, g, m, t, grid.dataset_seed(g, k), "{}") for g in names for k in range(2)], "slug string, mts_class string, instance int, generator string, m int, t int, seed long, params string")


for key, names in {"gen_varma": ["varma", "varma_shuffled"], "gen_noise": ["gaussian_noise", "cauchy_noise", "exponential_noise"], "gen_cml": ["cml_logistic"], "gen_wave_2d": ["wave_2d"], "gen_kuramoto": ["kuramoto", "kuramoto_all_to_all", "kuramoto_bidirectional_list", "kuramoto_grid_four"], "gen_mackey_glass": ["mackey_glass"]}.items():
    query(key)(lambda s, d, n=names: generators.series(specs_of(s, n, 9, 100)))
WAVE = f"""WITH RECURSIVE u0 AS (SELECT [exp(-power(x - 4.5, 2) / 0.405) / exp(-0.25 / 0.405) FOR x IN range(9)] AS u),
w AS (SELECT 0 AS t, u, u AS p FROM u0 UNION ALL SELECT t + 1, [CASE WHEN t = 0 THEN u[x] + 0.02 * (u[x % 9 + 1] + u[(x + 7) % 9 + 1] - 2 * u[x]) ELSE 2 * u[x] - p[x] + 0.04 * (u[x % 9 + 1] + u[(x + 7) % 9 + 1] - 2 * u[x]) END FOR x IN range(1, 10)], u FROM w WHERE t < 99),
l AS (SELECT CAST(t AS INTEGER) AS t, CAST(unnest(range(9)) AS INTEGER) AS proc, unnest(u) AS x FROM w)
SELECT 'wave_1d_' || k AS dataset_id, CAST(k AS INTEGER) AS instance, t, proc, {R.format("(x - avg(x) OVER (PARTITION BY proc, k)) / stddev_pop(x) OVER (PARTITION BY proc, k)")} AS x FROM l CROSS JOIN (VALUES (0), (1)) i(k)"""
query("gen_wave_1d", WAVE)(lambda s, d: rounded(generators.series(specs_of(s, ["wave_1d"], 9, 100)).drop("mts_class"), "x"))
GRID = {"defaults": {"M_values": [8, 16], "T_values": [500, 1000, 2000], "instances": 16, "single_instance_M_values": []}, "mts_classes": [{"name": "GaussianNoise", "generator": "gaussian_noise"}, {"name": "VAR(1)", "generator": "varma", "variants": [{"name": "phi 0.6", "params": {"phi": 0.6}}, {"name": "phi 0.9", "params": {"phi": 0.9}}], "include_base_variant": False}]}
GRID_SQL = "WITH m AS (SELECT * FROM (VALUES (0, 8), (1, 16)) v(mp, m)), t AS (SELECT * FROM (VALUES (0, 500), (1, 1000), (2, 2000)) v(tp, t)), i AS (SELECT unnest(range(16)) AS instance), c AS (SELECT * FROM (VALUES (0, 'GaussianNoise', 0, NULL), (1, 'VAR(1)', 1, 'phi 0.6'), (1, 'VAR(1)', 2, 'phi 0.9')) v(cp, mts_class, vp, variant))"
query("grid_expand", f"{GRID_SQL} SELECT CAST(row_number() OVER (ORDER BY cp, mp, tp, instance, vp) AS INTEGER) AS index, mts_class, m, t, CAST(instance AS INTEGER) AS instance, variant FROM c CROSS JOIN m CROSS JOIN t CROSS JOIN i")(lambda s, d: grid.expand(s, GRID).select("index", "mts_class", "m", "t", "instance", "variant"))
query("grid_counts", f"{GRID_SQL} SELECT mts_class, count(*) AS n FROM c CROSS JOIN m CROSS JOIN t CROSS JOIN i GROUP BY mts_class")(lambda s, d: grid.expand(s, GRID).groupBy("mts_class").agg(F.count(F.lit(1)).alias("n")))
SINGLE = {"rng_seed": 1, "defaults": {"M_values": [4, 8, 16, 32], "T_values": [100, 200], "instances": [0, 1, 2], "single_instance_M_values": [32, 64], "single_instance_T_values": [1000], "single_instance_instances": [7]}, "mts_classes": [{"name": "A", "generator": "gaussian_noise", "variants": [{"name": "raw", "params": {"zscore": False}}]}]}
query("grid_anti_single_instance", """WITH c AS (SELECT m, t, i AS instance FROM (VALUES (4), (8), (16), (32)) a(m) CROSS JOIN (VALUES (100), (200)) b(t) CROSS JOIN (VALUES (0), (1), (2)) d(i) WHERE m NOT IN (32, 64) UNION ALL SELECT m, 1000, 7 FROM (VALUES (32), (64)) a(m))
SELECT m, t, instance, variant, 'A_M' || m || '_T' || t || '_I' || instance || coalesce('_' || variant, '') AS slug FROM c CROSS JOIN (VALUES (NULL), ('raw')) v(variant)""")(lambda s, d: grid.expand(s, SINGLE).select("m", "t", "instance", "variant", "slug"))
query("delta_parse", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '1' ELSE greatest(1, n_nationkey - 3) || ',' || greatest(1, n_regionkey) || ',12' END AS deltas FROM nation")(lambda s, d: table(s, d, "nation").select("n_nationkey", F.array_join(stats.delta_list(F.when(F.col("n_nationkey") % 5 != 0, F.concat((F.col("n_nationkey") - 3).cast("string"), F.lit(" ,"), F.col("n_regionkey").cast("string"), F.lit(",, 12")))), ",").alias("deltas")))
query("market_keys", "SELECT n_name, replace(replace(replace(replace(lower(n_name || ' & Co-x_y'), '-', ''), '_', ''), ' ', ''), '&', 'and') AS k FROM nation")(lambda s, d: table(s, d, "nation").select("n_name", study_names.market_key(F.concat("n_name", F.lit(" & Co-x_y"))).alias("k")))
query("market_closes", """WITH p AS (SELECT CAST(ts AS DATE) AS day, upper(event_type) AS ticker, round(sum(value), 4) AS x FROM events WHERE value IS NOT NULL GROUP BY ALL), w AS (SELECT day FROM p GROUP BY day HAVING count(*) = (SELECT count(DISTINCT ticker) FROM p))
SELECT CAST(row_number() OVER (PARTITION BY ticker ORDER BY day) - 1 AS INTEGER) AS t, CAST(dense_rank() OVER (ORDER BY ticker) - 1 AS INTEGER) AS proc, x FROM p JOIN w USING (day)""")(market_closes)
NAMES = "(SELECT DISTINCT p_type || ' (' || p_brand || ')' AS s FROM part)"
query("slugify", f"SELECT s, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(s)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'variant') AS slug FROM {NAMES}")(lambda s, d: table(s, d, "part").select(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")")).alias("s")).distinct().select("s", stats.slugify(F.col("s")).alias("slug")))
query("class_dir_name", f"SELECT s, regexp_replace(regexp_replace(s, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS dir FROM {NAMES}")(lambda s, d: table(s, d, "part").select(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")")).alias("s")).distinct().select("s", stats.class_dir_name(F.col("s")).alias("dir")))
query("class_counts_min", "SELECT min(n) AS least FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")(lambda s, d: table(s, d, "embeddings").groupBy("label").count().agg(F.min("count").alias("least")))
query("color_scale")(lambda s, d: spi.catalogue(s).select("spi", learn.color_scale(F.col("spi"), F.array(), F.lit(-1.0), F.lit(1.0)).alias("scale")))

# ---- relational means ------------------------------------------------------------------

query("filter_project", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")(lambda s, d: table(s, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_totalprice"))
query("join_lookup", "SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")(lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n")))
query("anti_join_resume", "SELECT c_custkey AS slug FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")(lambda s, d: series.remaining(table(s, d, "customer").select(F.col("c_custkey").alias("slug")), table(s, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("slug"))))
query("union_specs", "SELECT s_nationkey AS k, 's' AS side FROM supplier UNION ALL SELECT c_nationkey, 'c' FROM customer")(lambda s, d: table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")).unionByName(table(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side"))))
query("distinct_sorted", "SELECT DISTINCT upper(p_brand) AS brand FROM part ORDER BY 1")(lambda s, d: table(s, d, "part").select(F.upper("p_brand").alias("brand")).distinct().orderBy("brand"))
query("percentiles", "SELECT l_returnflag, quantile_cont(l_quantity, 0.001) AS lo, quantile_cont(l_quantity, 0.999) AS hi FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.001).alias("lo"), F.percentile("l_quantity", 0.999).alias("hi")))
query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(lambda s, d: windows.tumbling(table(s, d, "events")).withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))

from . import pair_queries  # noqa: E402, F401  registers its queries beside these
