"""Kernels that take all pairs of a dataset at once, against the same statistics pair by pair; work dealt to all tasks."""

import math

import numpy as np
import pytest
from tidemark.operators import kernels as K
from tidemark.operators import spi

Z = np.random.default_rng(5).standard_normal((4, 40)).cumsum(1).round(2)


def pairwise(f, directed):
    return K.by_pair(f, directed)(Z)


def off_diagonal(a):
    return np.where(np.eye(len(a), dtype=bool), 0, a)


def _ball_sum(x, y):
    n, total = len(x), 0.0
    for i in range(n):
        for j in range(n):
            if i != j:
                k = np.setdiff1d(np.arange(n), [i, j])
                a, b = np.abs(x[k] - x[i]) <= abs(x[j] - x[i]), np.abs(y[k] - y[i]) <= abs(y[j] - y[i])
                t = [[(p & q).sum() for q in (b, ~b)] for p in (a, ~a)]
                den = sum(t[0]) * sum(t[1]) * (t[0][0] + t[1][0]) * (t[0][1] + t[1][1])
                total += (n - 2) * (t[0][1] * t[1][0] - t[0][0] * t[1][1]) ** 2 / den if den else 0
    return total


def test_barycentres_of_all_pairs_follow_each_pairs_path():
    def one(x, y):
        c = (x + y) / 2
        for turn in range(5):
            total, count = np.zeros_like(c), np.zeros_like(c)
            for s in (x, y):
                d = K._alignment(c, s, None, K._hard)
                i, j = len(c), len(s)
                while i and j:
                    total[i - 1] += s[j - 1]
                    count[i - 1] += 1
                    i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: d[p])
            c = c + (total / np.maximum(count, 1) - c) * (0.5 / (turn + 1))
        return c.mean()

    assert np.allclose(K.barycenter(Z, "sgddtw"), pairwise(one, False), rtol=0, atol=1e-12)


@pytest.mark.parametrize("how", [{"estimator": "kraskov"}, {"estimator": "kernel", "width": 0.25}, {"estimator": "symbolic", "k": 10}, {"estimator": "kraskov", "k": 3}])
def test_transfer_entropies_of_all_pairs(how):
    single = {"kernel_width" if k == "width" else k: v for k, v in how.items()}
    assert np.allclose(off_diagonal(K.transfer_entropies(Z, **how)), pairwise(lambda x, y: K.transfer_entropy(x, y, **single), True), rtol=0, atol=1e-12)


def test_entropies_of_all_pairs():
    for e in ("kernel", "kozachenko"):
        assert np.allclose(off_diagonal(K.joint_entropies(Z, e)), pairwise(lambda x, y: K.joint_entropy(x, y, e), False), rtol=0, atol=1e-12)  # noqa: B023
    both = pairwise(lambda x, y: K.conditional_entropy(x, y, "kernel"), True)
    assert np.allclose(off_diagonal(K.conditional_entropies(Z)), (both + both.T) / 2, rtol=0, atol=1e-12)


def test_additive_noise_of_all_pairs():
    one = lambda x, y: K.hsic(K.unit(y) - K._gp_fit(K.unit(x), K.unit(y)), K.unit(x), True) * len(x)
    z = np.random.default_rng(6).standard_normal((4, 40))
    assert np.allclose(off_diagonal(K.additive_noise(z)), K.by_pair(one, True)(z), rtol=1e-9)


def test_balls_of_all_pairs():
    assert np.allclose(off_diagonal(K.hhg(Z)), pairwise(_ball_sum, False), rtol=1e-9)


def test_gradient_descent_of_all_pairs():
    def one(x, y):
        x, y, b, rng = K.unit(x), K.unit(y), 0.0, np.random.default_rng(0)
        for t, k in enumerate(np.concatenate([rng.permutation(len(x)) for _ in range(20)])):
            b -= 0.01 / (t + 1) ** 0.25 * ((b * x[k] - y[k]) * x[k] + 1e-4 * b)
        return ((y - b * x) ** 2).mean()

    assert np.allclose(off_diagonal(K.gradient_descent(Z)), pairwise(one, True), rtol=0, atol=1e-12)


def test_robust_covariance_is_that_of_one_start_after_the_other_and_made_once(monkeypatch):
    z = np.random.default_rng(7).standard_normal((3, 60))
    (m, n), rng, found = z.shape, np.random.default_rng(0), []
    for _ in range(30):
        pick = rng.choice(n, m + 1, replace=False)
        for _ in range(10):
            x = z[:, pick]
            mu = x.mean(1, keepdims=True)
            new = np.argsort(np.einsum("ij,ij->j", z - mu, np.linalg.pinv(np.cov(x, bias=True)) @ (z - mu)), kind="stable")[: (n + m + 1) // 2]
            if set(new) == set(pick):
                break
            pick = new
        found.append(np.cov(z[:, pick], bias=True))
    best, got = min(found, key=np.linalg.det), K.min_cov_det(z)
    assert np.allclose(got / got[0, 0], best / best[0, 0], rtol=1e-9)
    calls = []
    monkeypatch.setitem(K.KERNELS, "cov_MinCovDet", (False, lambda v: calls.append(1) or K.min_cov_det(v)))
    monkeypatch.setitem(K.KERNELS, "cov_EllipticEnvelope", (False, lambda v: calls.append(1) or K.min_cov_det(v)))
    K.evaluate(z, ["cov_MinCovDet", "cov_EllipticEnvelope"])
    assert len(calls) == 1


def test_datasets_are_dealt_to_all_partitions(spark):
    mts = spark.createDataFrame([(f"d{k}", t, p, math.sin(k + t * (p + 1))) for k in range(40) for t in range(12) for p in range(2)], "dataset_id string, t int, proc int, x double")
    assert spi.compute(mts, ["hhg"]).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_alignments_are_dealt_to_all_partitions(spark):
    from tidemark.operators import alignment

    mts = spark.createDataFrame([(f"d{k}", t, p, math.sin(k + t * (p + 1))) for k in range(20) for t in range(9) for p in range(3)], "dataset_id string, t int, proc int, x double")
    edges = alignment.dynamic_time_warping(mts)
    assert edges.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r.dataset_id, r.i, r.j): r.value for r in edges.collect()}
    z = [[[math.sin(k + t * (p + 1)) for t in range(9)] for p in range(3)] for k in range(20)]
    assert len(got) == 60 and all(abs(got[f"d{k}", i, j] - K.dtw(np.array(z[k][i]), np.array(z[k][j]))) < 1e-12 for k in range(20) for i in range(3) for j in range(i + 1, 3))
