"""Short datasets gathered as arrays: the same values as plans over rows, little shuffled, uneven datasets too."""

import numpy as np
import pytest
from tidemark.operators import dominance, gathered, spi
from tidemark.operators import kernels as K

SCHEMA = "dataset_id string, t int, proc int, x double"


@pytest.fixture(scope="module")
def whole(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{d}", t + d, p, float(np.round(rng.standard_normal(), 1))) for d, n in enumerate((1, 2, 3, 30, 30, 47)) for p in range(4) for t in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def values(edges):
    out = {(r.dataset_id, r.spi, r.i, r.j): r.value for r in edges.collect()}
    assert all(i < j for _, _, i, j in out)
    return out


def test_short_datasets_have_the_values_of_the_plans_over_rows(whole):
    for got, want in (
        (dominance.kendall(whole), dominance.kendall_by_bits(whole)), (dominance.kendall(whole, True), dominance.kendall_by_bits(whole, True)),
        (dominance.distance_correlation(whole), dominance.correlation_by_bits(whole)), (dominance.distance_correlation(whole, True), dominance.correlation_by_bits(whole, True)),
        (dominance.lagged_distance_correlation(whole, 2), dominance.lagged_by_bits(whole, 2)),
    ):
        a, b = values(got), values(want)
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=2e-6) for k in a)


def test_kendall_shuffles_rows_and_not_pairs(whole):
    plan = dominance.kendall(whole)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    names = ["dcorr", "dcorr_biased", "dcorrx_maxlag-1"]
    plan = dominance.distance_statistics(whole, names)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("MapInArrow") == 1


def test_long_datasets_go_by_rows(whole, monkeypatch):
    want = values(dominance.kendall(whole)) | values(dominance.distance_statistics(whole, ["dcorr", "dcorrx_maxlag-1"]))
    monkeypatch.setattr(gathered, "SHORT", 30)
    got = values(dominance.kendall(whole)) | values(dominance.distance_statistics(whole, ["dcorr", "dcorrx_maxlag-1"]))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_uneven_datasets_take_the_times_that_both_channels_have(spark):
    rng = np.random.default_rng(4)
    z = {(p, t): float(np.round(rng.standard_normal(), 1)) for p in range(3) for t in (*range(12), *range(20, 30)) if (p, t) not in ((1, 2), (2, 9))}
    rows = [("u", t, p, x) for (p, t), x in z.items()] + [("u", 2, 1, None), ("gap", 0, 0, 1.0), ("gap", 5, 0, 2.0), ("gap", 1, 1, 2.0), ("gap", 6, 1, 1.0)]
    mts = spark.createDataFrame(rows, SCHEMA)

    def pairs(i, j, lag):
        at = [t for p, t in z if p == i and (j, t + lag) in z]
        return np.array([z[i, t] for t in at]), np.array([z[j, t + lag] for t in at])

    def unbiased(x, y):
        n, (a, b) = len(x), (np.abs(v[:, None] - v[None]) for v in (x, y))
        c = lambda p, q: (p * q).sum() - 2 * (p.sum(0) * q.sum(0)).sum() / (n - 2) + p.sum() * q.sum() / ((n - 1) * (n - 2))
        return c(a, b) / np.sqrt(c(a, a) * c(b, b))

    kendall, lagged = values(dominance.kendall(mts)), values(dominance.lagged_distance_correlation(mts, 1))
    assert {k[0] for k in kendall} == {"u"} and ("gap", "dcorrx_maxlag-1", 0, 1) in lagged
    for i in range(3):
        for j in range(i + 1, 3):
            a, b = (np.sign(v[:, None] - v[None]) for v in pairs(i, j, 0))
            assert kendall["u", "kendall", i, j] == pytest.approx((a * b).sum() / np.sqrt(np.abs(a).sum() * np.abs(b).sum()), abs=1e-12)
            assert lagged["u", "dcorrx_maxlag-1", i, j] == pytest.approx(max(unbiased(*pairs(i, j, k)) for k in (0, 1)), abs=1e-9)


def test_descent_takes_many_datasets_at_each_step(whole, spark):
    z = np.random.default_rng(6).standard_normal((7, 4, 30)).cumsum(-1)
    z[2, 1] = 5.0
    assert np.allclose(K.gradient_descent(z), [K.gradient_descent(one) for one in z], rtol=0, atol=1e-12)
    mts = whole.unionByName(spark.createDataFrame([("u", 0, 0, 1.0), ("u", 1, 0, None), ("u", 0, 1, 3.0), ("u", 2, 1, 4.0)], SCHEMA))
    got = spi.compute(mts, ["lmfit_SGDRegressor"])
    assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().executedPlan().toString()  # a call a dataset
    got = {(r.dataset_id, r.i, r.j): r.value for r in got.collect()}
    for d, rows in mts.toPandas().groupby("dataset_id"):
        wide = rows.pivot(index="proc", columns="t", values="x").fillna(0.0).to_numpy()
        want = K.gradient_descent(wide)
        for i, j in zip(*np.nonzero(~np.eye(len(wide), dtype=bool)), strict=True):
            assert got.pop((d, int(i), int(j))) == pytest.approx(want[i, j], abs=1e-12)
    assert not got


def test_evidence_is_maximised_for_many_pairs_at_each_round(whole):
    plan = spi.compute(whole, ["lmfit_BayesianRidge"])
    assert "lambdafunction" not in plan._jdf.queryExecution().optimizedPlan().toString()  # 50 rounds a row
    got = {(r.dataset_id, r.i, r.j): r.value for r in plan.collect()}
    for d, rows in whole.toPandas().groupby("dataset_id"):
        z = rows.pivot(index="proc", columns="t", values="x").to_numpy()
        for i, j in zip(*np.nonzero(~np.eye(len(z), dtype=bool)), strict=True):
            assert got.pop((d, int(i), int(j))) == pytest.approx(K.linear_model(z[i], z[j], "BayesianRidge"), abs=1e-9)
    assert not got
