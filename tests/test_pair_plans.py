"""DataFrame plans of pairwise statistics against plain numpy on small series with ties and a constant channel."""

import math

import numpy as np
import pytest

from tidemark.operators import alignment, dominance, fourier, moments, regression, spi_sql
from tidemark.operators import kernels as K

M, T = 5, 40


def walk(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((M, T)).cumsum(1)
    z[1] += 0.8 * np.roll(z[0], 2)
    z[3] = np.round(z[3])  # ties
    return z


@pytest.fixture(scope="module")
def series(spark):
    """Two datasets; in the second the last channel is constant, times begin at 7 and rows are shuffled."""
    z = {"a": walk(1), "b": walk(2)}
    z["b"][4] = 1.5
    rows = [(d, t + 7 * (d == "b"), p, float(v)) for d, m in z.items() for p, row in enumerate(m) for t, v in enumerate(row)]
    rows = [rows[k] for k in np.random.default_rng(0).permutation(len(rows))]
    return z, spark.createDataFrame(rows, "dataset_id string, t int, proc int, x double").repartition(3).cache()


def matrices(edges) -> dict:
    out = {}
    for r in edges.collect():
        m = out.setdefault((r.dataset_id, r.spi), np.full((M, M), np.nan))
        assert np.isnan(m[r.i, r.j]), "an edge twice"
        m[r.i, r.j] = np.nan if r.value is None else r.value
    return out


def same(z, edges, names, skip=lambda name, d, i, j: False, **tol):
    found = matrices(edges)
    assert set(found) == {(d, n) for d in z for n in names}
    for (d, n), got in found.items():
        directed = K.KERNELS[n][0] if n in K.KERNELS else False
        want = K.evaluate(z[d], [n])[n]
        for i in range(M):
            for j in range(M):
                if i == j or not directed and i > j:
                    assert np.isnan(got[i, j])
                elif not skip(n, d, i, j):
                    assert got[i, j] == pytest.approx(want[i, j], **({"rel": 1e-6, "abs": 1e-8} | tol)), (d, n, i, j)


def constant(_, d, i, j):
    return d == "b" and 4 in (i, j)


@pytest.mark.parametrize("statistic", ["mean", "max"])
def test_spectral_measures(series, statistic):
    z, mts = series
    names = [f"{m}_{statistic}{band}" for m in fourier.MEASURES for band in ("", "_fmin-0_fmax-0.25", "_fmin-0.25_fmax-0.5")]
    # At frequency 0 a negative real coherency has the phase pi both ways here, +-pi by the sign of a zero there.
    turned = lambda n, d, i, j: constant(n, d, i, j) or n.startswith("phase") and "fmin-0.25" not in n
    same(z, fourier.measures(fourier.spectra(mts), names), names, turned)


def test_a_phase_is_averaged_both_ways(series):
    z, mts = series
    table = fourier.spectra(mts)
    low = table.filter("freq > 0 and freq < 0.5").collect()
    c, _ = K.cross_spectra(z["a"])
    s = (c[:, :, :, None] * c[:, :, None, :].conj()).mean(0)
    for r in low:
        if r.dataset_id == "a":
            assert r.phase == pytest.approx(np.angle(s[r.f, r.i, r.j]), abs=1e-8)
    mean = matrices(fourier.measures(table, ["phase_mean_fmin-0.1_fmax-0.4"]))
    assert all(abs(v) < 1e-12 for m in mean.values() for v in m[np.triu_indices(M, 1)])


def test_segments_average_spectra(series):
    z, mts = series
    got = {(r.i, r.j, r.f): r for r in fourier.spectra(mts.filter("dataset_id = 'a'"), segment=16).collect()}
    parts = [K.cross_spectra(z["a"][:, k : k + 16] - z["a"].mean(1, keepdims=True) + 0)[0] for k in (0, 16)]
    assert len(got) == M * (M - 1) // 2 * 9
    rng = np.arange(1, 17)
    w = np.stack([math.sqrt(2 / 17) * np.sin(math.pi * (k + 1) * rng / 17) for k in range(5)])
    x = z["a"] - z["a"].mean(1, keepdims=True)
    parts = np.concatenate([np.fft.rfft(w[:, None] * x[None, :, k : k + 16], axis=2) for k in (0, 16)])
    for (i, j, f), r in got.items():
        s = (parts[:, i, f] * parts[:, j, f].conj()).mean()
        p = [(abs(parts[:, k, f]) ** 2).mean() for k in (i, j)]
        assert r.cr + 1j * r.ci == pytest.approx(s / math.sqrt(p[0] * p[1]), abs=1e-9)


def test_phase_slopes_and_group_delays(series):
    z, mts = series
    table = fourier.spectra(mts)
    for names, f in ((["psi", "psi_fmin-0_fmax-0.25"], fourier.phase_slopes), (["gd", "gd_fmin-0.25_fmax-0.5"], fourier.group_delays)):
        same(z, f(table, names), names, constant)


def test_cross_correlation_over_all_lags(series):
    z, mts = series
    for d, zz in z.items():
        u = np.stack([K.unit(x) for x in zz])
        for statistic, sig, pick in (("max", False, np.max), ("mean", False, np.mean), ("mean", True, np.mean)):
            got = matrices(fourier.cross_correlation(mts, statistic, sig_only=sig))[d, f"xcorr_{statistic}"]
            for i in range(M):
                for j in range(i + 1, M):
                    c = np.correlate(u[j], u[i], "full") / T
                    big = c[np.abs(c) > 1.96 / math.sqrt(T)]
                    assert got[i, j] == pytest.approx(pick(big if sig and len(big) else c), abs=1e-9)
    near = matrices(fourier.cross_correlation(mts, "max", max_lag=5))
    old = matrices(spi_sql.cross_correlation(mts, "max", max_lag=5))
    assert all(np.allclose(near[k], old[k], equal_nan=True) for k in old)
    sq = matrices(fourier.cross_correlation(mts, "max", squared=True))
    assert all(np.nanmin(m) >= 0 for m in sq.values())


def test_kendall_by_bits(series):
    z, mts = series
    got = matrices(dominance.kendall(mts))
    for d, zz in z.items():
        for i in range(M):
            for j in range(i + 1, M):
                a, b = (np.sign(zz[k][:, None] - zz[k][None]) for k in (i, j))
                v = math.sqrt(np.abs(a).sum() * np.abs(b).sum())
                assert got[d, "kendall"][i, j] == pytest.approx((a * b).sum() / v if v else 0, abs=1e-12)


def test_distance_correlation_without_matrices(series):
    z, mts = series
    same(z, dominance.distance_correlation(mts), ["dcorr"])
    same(z, dominance.distance_correlation(mts, True), ["dcorr_biased"], abs=1e-6)
    same(z, dominance.lagged_distance_correlation(mts, 1), ["dcorrx_maxlag-1"])


def test_gaussian_information(series):
    z, mts = series
    names = ["xme_gaussian_k1", "xme_gaussian_k10", "cce_gaussian", "di_gaussian", "te_gaussian_k1_l1", "te_gaussian_k2_l2", "si_gaussian"]
    same(z, moments.gaussian_information(mts, names), names, constant, abs=1e-6)
    with pytest.raises(KeyError):
        moments.gaussian_information(mts, ["nothing"])


def test_precision(series):
    z, mts = series
    names = [f"prec_{e}" for e in ("EmpiricalCovariance", "ShrunkCovariance", "OAS", "LedoitWolf")]
    same({"a": z["a"]}, moments.precision(mts.filter("dataset_id = 'a'"), [n[5:] for n in names]), names)
    flat = matrices(moments.precision(mts.filter("dataset_id = 'b'"), ["EmpiricalCovariance"]))["b", "prec_EmpiricalCovariance"]
    want = np.linalg.pinv(K.empirical(z["b"]))
    assert np.allclose(flat[np.triu_indices(M, 1)], want[np.triu_indices(M, 1)], atol=1e-8)


def test_regressions(series):
    z, mts = series
    same(z, regression.regression_error(mts), ["reci"], abs=1e-7)
    same(z, regression.value_slopes(mts), ["igci"])
    same(z, regression.conditional_distributions(mts), ["cds"])
    models = ["Ridge", "Lasso", "ElasticNet", "BayesianRidge"]
    same(z, regression.linear_models(mts, models), [f"lmfit_{m}" for m in models])


def test_cointegration(series):
    z, mts = series
    names = ["coint_aeg_lags-1", "coint_aeg_lags-10", "coint_aeg_trend", *[f"coint_aeg_tstat_trend-{t}_autolag-{c}_maxlag-10" for t in ("c", "ct") for c in ("aic", "bic")]]
    same(z, regression.cointegration(mts, names), names, constant)


@pytest.mark.parametrize("constraint", alignment.CONSTRAINTS)
def test_alignments(series, constraint):
    z, mts = series
    tail = f"_{constraint}" if constraint else ""
    for f, base in ((alignment.dynamic_time_warping, "dtw"), (alignment.soft_dynamic_time_warping, "softdtw"), (alignment.common_subsequence, "lcss")):
        same(z, f(mts, constraint), [base + tail])


def test_matrices_are_rebuilt_from_any_layout(spark):
    from tidemark.operators import edges as E

    rng = np.random.default_rng(4)
    sizes = spark.createDataFrame([(f"m{m}", m) for m in (2, 3, 5)], "dataset_id string, m int")
    rows = [(f"m{m}", s, i, j, float(rng.integers(1, 99))) for m in (2, 3, 5) for s in ("a", "b") for i in range(m) for j in range(m)]
    edges = spark.createDataFrame(rows, "dataset_id string, spi string, i int, j int, value double")
    value = {r[:4]: r[4] for r in rows}
    for shape in ("directed", "upper", "square"):
        v = E.to_vectors(edges, sizes, shape)
        got = {(r.dataset_id, r.spi, r.i, r.j): r.value for r in E.rebuild(v, sizes).collect()}
        for (d, s, i, j), x in value.items():
            want = None if i == j and shape != "square" else 0.0 if shape == "upper" and i > j else x
            assert got.get((d, s, i, j)) == want, (shape, d, i, j)
        sym = {(r.dataset_id, r.spi, r.i, r.j): r.value for r in E.rebuild(v, sizes, ["a"]).collect()}
        for d, s, i, j in (k for k in value if k[2] < k[3]):
            both = (value[d, s, i, j] + value[d, s, j, i]) / 2
            want = got[d, s, i, j] if s == "b" or shape != "directed" else both
            assert sym[d, s, i, j] == want and (s == "b" or shape == "square" or sym[d, s, j, i] == want)
    with pytest.raises(Exception, match="no matrix"):
        E.rebuild(E.to_vectors(edges, sizes, "square").filter("k > 0"), sizes).collect()


def test_colour_ranges(spark):
    from tidemark.operators.views import color_ranges

    rows = [("d", s, 0, 1, v) for s, vs in {"spearman": (-0.2, 0.1), "spearman_sq_x": (0.0, 0.1), "cov_x": (-2.0, 1.0), "u": (0.5, 3.0), "s": (-1.0, 4.0), "plv_mean": (0.1, 0.9), "free": (-5.0, 2.0), "below": (-3.0, -1.0), "above": (1.0, 2.0), "gone": (math.nan, math.nan)}.items() for v in vs]
    edges = spark.createDataFrame(rows, "dataset_id string, spi string, i int, j int, value double")
    labels = spark.createDataFrame([("u", ["Unsigned"]), ("s", ["signed"])], "spi string, labels array<string>")
    got = {r.spi: (r.vmin, r.vmax, r.center, r.scale) for r in color_ranges(edges, labels).collect()}
    up = lambda b: (0.0, b, None, "sequential")
    even = lambda b: (-b, b, 0.0, "diverging")
    assert got == {"spearman": even(1.0), "spearman_sq_x": up(0.1), "cov_x": even(2.0), "u": up(3.0), "s": even(4.0), "plv_mean": up(0.9), "free": even(5.0), "below": (-3.0, 0.0, None, "sequential"), "above": up(2.0), "gone": (0.0, 0.0, None, "sequential")}


def test_single_precision_makes_ties(spark):
    from tidemark.operators import edges as E

    near = [1.0, 1.0 + 1e-12, 2.0]
    rows = [("d", s, i, j, v) for s, vs in (("a", near), ("b", [1.0, 0.5, 3.0])) for (i, j), v in zip(((0, 1), (0, 2), (1, 2)), vs, strict=True)]
    edges = spark.createDataFrame(rows, "dataset_id string, spi string, i int, j int, value double")
    sizes = spark.createDataFrame([("d", 3)], "dataset_id string, m int")
    rho = lambda single: E.spi_features(E.edge_vectors(edges, sizes, [], single)).first().rho
    assert rho(False) == pytest.approx(0.5) and rho(True) == pytest.approx(math.sqrt(3) / 2)


def test_principal_axes_without_wide_rows(spark):
    from tidemark.operators import learn

    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 30)) @ rng.standard_normal((30, 30)) + 3 * rng.standard_normal((40, 1)) * np.linspace(1, 2, 30)
    x[:, 7] = 2.0  # constant
    rows = [(f"d{i}", "c", f"f{j:02}", float(x[i, j])) for i in range(40) for j in range(30)]
    scores, shares = learn.pca(spark.createDataFrame(rows, "dataset_id string, mts_class string, feature string, value double"), 2)
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))
    values, axes = np.linalg.eigh(z.T @ z)
    assert shares == pytest.approx((values[::-1][:2] / values.sum()).tolist(), rel=1e-8)
    got = {r.dataset_id: (r.pc1, r.pc2) for r in scores.collect()}
    for c in range(2):
        a = axes[:, -1 - c] * np.sign(axes[np.abs(axes[:, -1 - c]).argmax(), -1 - c])
        assert np.allclose([got[f"d{i}"][c] for i in range(40)], z @ a, atol=1e-4)
    assert learn.pca(spark.createDataFrame(rows[:0], "dataset_id string, mts_class string, feature string, value double"))[1] == []
