"""Profiles of statistics, the run command, and the kernels that they choose."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels, spi_sql
from tidemark.plans import profiles
from tidemark.sources import generators

PROFILE = {
    ".statistics.basic": {
        "SpearmanR": {"labels": ["undirected", "signed"], "configs": [{"squared": False}, {"squared": True}]},
        "Covariance": {"labels": ["undirected"], "configs": [{"estimator": "EmpiricalCovariance"}]},
    },
    ".statistics.distance": {"PairwiseDistance": {"labels": ["undirected"], "configs": [{"metric": "cityblock"}]}, "GromovWasserstainTau": {"labels": ["undirected"]}},
    ".statistics.causal": {"InformationGeometricConditionalIndependence": {"labels": ["directed"], "configs": None}},
    ".statistics.spectral": {"PhaseSlopeIndex": {"labels": ["undirected"], "configs": [{"fmin": 0, "fmax": 0.5}]}},
    ".statistics.wavelet": {"PhaseSlopeIndex": {"labels": ["directed"], "configs": [{"fs": 1}]}},
}


@pytest.fixture(scope="module")
def mts(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(48, 3)).cumsum(0)
    rows = [("d", "c", 0, t, p, float(z[t, p])) for t in range(48) for p in range(3)]
    return z, spark.createDataFrame(rows, "dataset_id string, mts_class string, instance int, t int, proc int, x double").cache()


def test_names_and_labels():
    chosen = profiles.read_profile(PROFILE)
    assert [s.name for s in chosen] == ["spearmanr", "spearmanr-sq", "cov_EmpiricalCovariance", "pdist_cityblock", "gwtau", "igci", "psi", "wpsi_mean"]
    assert [s.name for s in chosen if s.directed] == ["igci", "wpsi_mean"] and chosen[0].labels == ("undirected", "signed")
    assert profiles.read_profile({}) == [] and profiles.read_profile({".a": None}) == []


@pytest.mark.parametrize("module,cls,config,name", [
    ("statistics.infotheory", "TransferEntropy", {"estimator": "kraskov", "k_history": 1, "l_history": 1, "prop_k": 4, "dyn_corr_excl": "AUTO"}, "te_kraskov_k1_l1_DCE"),
    ("statistics.infotheory", "MutualInfo", {"estimator": "kernel", "kernel_width": 0.25}, "mi_kernel_W-0.25"),
    ("statistics.spectral", "SpectralGrangerCausality", {"method": "parametric", "order": 20, "fmin": 0.25, "fmax": 0.5, "statistic": "max"}, "sgc_parametric_order-20_max_fmin-0.25_fmax-0.5"),
    ("statistics.misc", "Cointegration", {"method": "aeg", "statistic": "tstat", "autolag": "bic", "maxlag": 10, "trend": "ct"}, "coint_aeg_tstat_trend-ct_autolag-bic_maxlag-10"),
    ("statistics.basic", "CovarianceSonnet", {"estimator": "OAS"}, "cov_OAS"),
])
def test_one_config_is_one_statistic(module, cls, config, name):
    assert profiles.statistic(module, cls, config).name == name


@pytest.mark.parametrize("cls,config", [("Covariance", {"estimator": "none"}), ("NoSuch", None), ("PairwiseDistance", {"metric": "none"})])
def test_what_the_catalogue_lacks_is_an_error(cls, config):
    with pytest.raises(KeyError):
        profiles.statistic("statistics.basic", cls, config)


def test_profile_from_a_file(tmp_path):
    import yaml

    (tmp_path / "p.yaml").write_text(yaml.safe_dump(PROFILE, sort_keys=False))
    assert [(s.name, s.labels) for s in profiles.read_profile(str(tmp_path / "p.yaml"))] == [(s.name, s.labels) for s in profiles.read_profile(PROFILE)]


def test_edges_follow_the_labels(spark, mts):
    z, frame = mts
    chosen = profiles.read_profile(PROFILE)
    got = {(r["spi"], r["i"], r["j"]): r["value"] for r in profiles.compute_profile(frame, chosen).collect()}
    sizes = {s.name: sum(k[0] == s.name for k in got) for s in chosen}
    assert sizes == {s.name: 6 if s.directed else 3 for s in chosen}
    assert got["pdist_cityblock", 0, 2] == pytest.approx(np.abs(z[:, 0] - z[:, 2]).sum())
    assert got["cov_EmpiricalCovariance", 0, 1] == pytest.approx(np.cov(z.T, ddof=0)[0, 1])
    ranks = z.argsort(0).argsort(0).astype(float)
    assert got["spearmanr", 1, 2] == pytest.approx(np.corrcoef(ranks.T)[1, 2])
    both = kernels.evaluate(z.T, ["psi"])["psi"]
    assert got["psi", 0, 1] == pytest.approx((both[0, 1] + both[1, 0]) / 2, abs=1e-12)  # its label is undirected here
    assert got["wpsi_mean", 0, 1] == got["wpsi_mean", 1, 0]  # its measure is
    labels = {r["spi"]: r["directed"] for r in profiles.labels_of(spark, chosen).collect()}
    assert labels["igci"] and not labels["psi"]
    with pytest.raises(ValueError):
        profiles.compute_profile(frame, [])


def test_lags_by_criterion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300).cumsum()
    e = np.zeros(300)
    for t in range(2, 300):  # residuals with one lag of differences
        e[t] = e[t - 1] + 0.6 * (e[t - 1] - e[t - 2]) - 0.2 * e[t - 1] + rng.normal()
    y = 2 * x + e
    fixed = [kernels.engle_granger(x, y, lags=k) for k in range(11)]
    chosen = kernels.engle_granger(x, y, lags=10, criterion="bic")
    assert chosen in fixed and fixed.index(chosen) in (1, 2) and chosen < -4
    assert np.isfinite(kernels.engle_granger(x[:8], y[:8], lags=10, criterion="aic"))
