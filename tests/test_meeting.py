"""Channels meet without a join, and one deal of rows is enough for an aggregate by pair."""

import numpy as np
from tidemark.operators import edges as E
from tidemark.operators import meeting, spi_sql


def test_channels_meet_at_equal_times_only(spark):
    rows = [("a", t, p, 10.0 * p + t) for p in range(3) for t in range(4) if (p, t) != (1, 2)] + [("b", 5, 0, 1.0), ("b", 70_000, 0, 2.0), ("b", 70_000, 4, None)]
    mts = spark.createDataFrame(rows, "dataset_id string, t int, proc int, x double")
    for directed in (False, True):
        got = sorted((r.dataset_id, r.t, r.i, r.j, r.x, str(r.y)) for r in spi_sql.pairs(mts, directed).collect())
        assert got == sorted((d, t, p, q, x, str(y)) for d, t, p, x in rows for e, u, q, y in rows if d == e and t == u and (p != q if directed else p < q))


def test_pairs_are_summed_where_they_are_made(spark):
    mts = spark.createDataFrame([(f"d{d}", t, p, float(t * p % 5)) for d in range(6) for t in range(50) for p in range(4)], "dataset_id string, t int, proc int, x double").repartition(4)
    plan = spi_sql.covariance(mts)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    part = meeting.together(mts, {"x": "x"}, {"x": "y"}).selectExpr("dataset_id", "spark_partition_id() as at").distinct()
    assert part.count() == 6  # each dataset in one task


def test_mixed_features_rank_values_as_they_are(spark):
    v = np.array([[0, 1e6, 3e-12, 5], [1e6, 0, 2e-12, 7], [3e-12, 2e-12, 0, 9], [5, 7, 9, 0]], float)
    w = np.arange(16.0).reshape(4, 4) * (1 - np.eye(4))
    rows = [("a", s, i, j, float(m[i, j])) for s, m in (("u", v), ("lag", w)) for i in range(4) for j in range(4) if i != j]
    edges = spark.createDataFrame(rows, "dataset_id string, spi string, i int, j int, value double")
    rho = E.mixed_features(edges, spark.createDataFrame([("a", 4)], "dataset_id string, m int"), ["lag"]).first().rho
    rank = lambda m: np.array([(m < x).sum() + ((m == x).sum() + 1) / 2 for x in m.ravel()])
    assert abs(rho - np.corrcoef(rank(v), rank(w))[0, 1]) < 1e-12


def test_smoothed_gaps_count_equal_values_once_and_deal_the_work(spark):
    rows = [(c, "f", float(v)) for c, vs in (("a", [0, 0, 0, 1, 2]), ("b", [0, 2, 2, 3])) for v in vs]
    out = E.ks_sweep(spark.createDataFrame(rows, "mts_class string, feature string, value double"), ["a", "b"], [0.5])
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    a, b = (np.array([v for c, _, v in rows if c == k]) for k in "ab")
    g = np.linspace(0, 3, 512)[:, None]
    da, db = (np.exp(-0.5 * ((g - v) / (0.5 * v.std(ddof=1))) ** 2).sum(1).cumsum() for v in (a, b))
    got = out.first()
    assert abs(got.ks - np.abs(da / da[-1] - db / db[-1]).max()) < 1e-9 and (got.n_a, got.n_b) == (5, 4)
