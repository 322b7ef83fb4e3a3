"""Registered queries against DuckDB, kernels against invariants and plain numpy, grids against counts."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.operators import kernels as K
from tidemark.plans import grid
from tidemark.queries import ORACLES, QUERIES
from tidemark.sources import generators

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    return sorted([tuple(None if pd.isna(v) else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", ["mts_from_events_dense", "mts_zscore", "mts_robust_scale", "spi_pearson", "spi_spearman", "spi_xcorr_sigonly", "spi_gauss_tlmi", "spi_symbolic_te_k1", "mpi_symmetrise", "mpi_wide", "feat_spi_spi_split", "feat_spi_spi_mixed", "ks_two_sided", "ks_topk", "ks_kde", "class_densities", "two_spi_scatter", "heat_map_ranges", "grid_anti_single_instance", "delta_parse", "market_keys", "market_closes", "gen_wave_1d", "anti_join_resume", "spi_kendall", "grid_expand", "slugify", "events_tumbling"])
def test_query_equals_sql(spark, duck, name):
    a, b = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_kernels_are_finite_and_symmetric():
    rng = np.random.default_rng(0)
    z = rng.standard_normal((3, 40)).cumsum(1)
    z[2] = 1.0  # a constant channel
    for name in K.KERNELS:
        if name.startswith(("bary", "ccm", "cov_Graph", "prec_Graph")):
            continue
        v = K.evaluate(z, [name])[name]
        assert v.shape == (3, 3) and (np.diag(v) == 0).all(), name
        if not K.KERNELS[name][0]:
            assert np.allclose(np.nan_to_num(v), np.nan_to_num(v.T)), name


def test_kernels_know_simple_cases():
    x = np.random.default_rng(1).standard_normal(200)
    assert K.dtw(x, x) == 0 and K.lcss(x, x) == 1
    assert K.distance_correlation(x, 2 * x + 1, True) == pytest.approx(1)
    assert K.entropy(x, "gaussian") == pytest.approx(0.5 * math.log(2 * math.pi * math.e * x.var()), abs=1e-6)
    y = np.roll(x, 1)
    assert K.transfer_entropy(x, y) > 10 * abs(K.transfer_entropy(y, x))
    assert K.lagged_mutual(x, y, "kraskov") > 1
    assert K.oas(np.stack([x, y])).shape == (2, 2)


def test_granger_sees_the_direction():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal(500), np.zeros(500)
    for t in range(1, 500):
        y[t] = 0.5 * y[t - 1] + 0.8 * x[t - 1] + 0.3 * rng.standard_normal()
    for order in (None, 1):
        assert K.spectral_granger(x, y, 0, 0.5, "mean", order) > 5 * abs(K.spectral_granger(y, x, 0, 0.5, "mean", order))


def test_every_generator_gives_its_shape_again():
    for name in generators.GENERATORS:
        a, b = generators.generate(name, 9, 30, 5), generators.generate(name, 9, 30, 5)
        assert a.shape == (30, 9) and np.array_equal(a, b), name
    with pytest.raises(KeyError):
        generators.generate("nothing", 2, 2)
    with pytest.raises(ValueError):
        generators.generate("wave_2d", 8, 5)


def test_generators_take_the_parameters_of_experiment_files():
    g = generators.generate
    x = g("varma", 4, 300, 1, phi=0.5, coupling=0.0, ma_phi=0.0, ma_coupling=0.0, noise_std=0.1, topology="ring-unidirectional", zscore=False)
    assert x.std() == pytest.approx(0.1 / math.sqrt(0.75), rel=0.1)
    e = np.random.default_rng(1).normal(0.0, 0.1, (400, 4))
    want = e + 0.3 * np.vstack([np.zeros((1, 4)), e[:-1]])
    assert np.allclose(g("varma", 4, 300, 1, phi=0.0, coupling=0.0, ma_phi=0.3, ma_coupling=0.0, zscore=False), want[100:])
    plain, later = g("cml_logistic", 5, 40, 2, zscore=False), g("cml_logistic", 5, 30, 2, respect_transients=True, transients=10, zscore=False)
    assert np.array_equal(plain[10:], later) and (plain[0] >= 0).all()
    assert g("exponential_noise", 3, 50, 1).min() >= 0 and abs(g("gaussian_noise", 3, 50, 1).mean()) < 1e-9
    for kw in ({"K": 1.5}, {"k": 1.5}, {"K": 9.0, "k": 1.5}):
        assert np.array_equal(g("kuramoto", 5, 20, 3, topology="ring-symmetric", transients=5, **kw), g("kuramoto", 5, 20, 3, coupling_scheme="list", K=1.5, transients=5))
    for kw in ({"connectivity": "splay"}, {"connectivity": "full"}, {"connectivity": "ring", "k_ring": 2}, {"output": "cos"}, {"output": "phase", "noise_std": 0.2}):
        assert g("kuramoto", 9, 20, 3, transients=5, **kw).shape == (20, 9)
    with pytest.raises(ValueError):
        g("kuramoto", 5, 5, 1, connectivity="star")
    wave = g("wave_2d", 9, 2, zscore=False)
    assert wave[0].max() == 1 and np.allclose(wave[1].sum(), wave[0].sum())
    assert np.allclose(g("mackey_glass", 3, 5, 4, transients=0, zscore=False)[0], np.random.default_rng(4).uniform(0.5, 1.5, (171, 3))[170])


def test_grid(spark):
    two = {"defaults": {"M_values": [8, 16], "T_values": [1, 2, 3], "instances": 16}, "mts_classes": [{"name": "A", "generator": "gaussian_noise"}, {"name": "B", "generator": "varma", "base_params": {"phi": 0.1, "x": 2}, "variants": [{"name": "v", "params": {"phi": 0.6}}], "include_base_variant": False}]}
    specs = grid.expand(spark, two)
    assert specs.count() == 192
    assert specs.filter("mts_class = 'B'").first()["params"] == {"phi": "0.6", "x": "2"}
    single = {"defaults": {"M_values": [4, 64], "T_values": [1], "instances": 3, "single_instance_M_values": [64]}, "mts_classes": [{"name": "A", "generator": "gaussian_noise"}]}
    assert grid.expand(spark, single).count() == 4
    for bad in ({"name": ""}, {"name": "x"}, {"name": "x", "package": "other"}, {"name": "x", "package": "aeon"}):
        with pytest.raises(ValueError):
            grid.parse({"mts_classes": [bad]})
    with pytest.raises(IndexError):
        grid.spec_at(specs, 193)


def test_files_come_back(spark, tmp_path):
    from tidemark.sources import series

    a = np.arange(6.0).reshape(3, 2)
    (tmp_path / "d").mkdir()
    np.save(tmp_path / "d" / "timeseries.npy", a)
    np.savez(tmp_path / "d" / "mpis.npz", cov=np.eye(2))
    (tmp_path / "names.txt").write_text("b\n# no\n\na\nb\n")
    assert {(r.t, r.proc): r.x for r in series.read_npy(spark, str(tmp_path)).collect()} == {(t, p): a[t, p] for t in range(3) for p in range(2)}
    assert series.read_npz_edges(spark, str(tmp_path)).count() == 4
    assert [r[0] for r in series.read_subset(spark, str(tmp_path / "names.txt")).collect()] == ["b", "a"]


def test_forward_selection_goes_on_to_all_features(spark):
    out = QUERIES["feature_select_forward"](spark, SF).orderBy("step").collect()
    pairs = {r.spi_a + "|" + r.spi_b for r in QUERIES["feat_spi_spi_split"](spark, SF).select("spi_a", "spi_b").distinct().collect()}
    assert [r.step for r in out] == list(range(min(12, len(pairs)))) and {r.feature for r in out} == pairs


def test_ks_compares_every_two_classes(spark, duck):
    a, b = QUERIES["ks_sweep"](spark, SF).toPandas(), duck.sql(ORACLES["ks_sweep"]).df()
    assert rows(a) == rows(b) and len(a.groupby(["class_a", "class_b"])) == 45
    kde = QUERIES["ks_kde"](spark, SF)
    assert kde.select("class_a", "class_b").distinct().count() == 45
