"""Forests by levels, and t-SNE in blocks against the dense form."""

import numpy as np
from tidemark.operators import learn


def test_a_forest_grows_by_levels(monkeypatch):
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((2500, 2)), rng.integers(0, 5, 2500)
    calls, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or sort(*a, **k))
    learn.forest_accuracy(x[:2000], y[:2000], x[2000:], y[2000:], trees=1)
    assert len(calls) < 200  # a sort a node would be over a thousand


def test_a_forest_tells_what_can_be_told():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 3))
    y = (x[:, 0] > 0) * 1 + (x[:, 2] > 0.1) * 2
    assert learn.forest_accuracy(x[:600], y[:600], x[600:], y[600:], trees=30) > 0.97
    assert abs(learn.forest_accuracy(x[:600], rng.integers(0, 4, 600), x[600:], y[600:], trees=30) - 0.25) < 0.12
    same = np.zeros((40, 1))
    assert learn.forest_accuracy(same, np.r_[np.zeros(30, int), np.ones(10, int)], same[:4], np.array([0, 0, 1, 0]), trees=20) == 0.75


def test_tsne_in_blocks_is_the_dense_one(spark):
    rng, rounds = np.random.default_rng(2), 30
    x = rng.standard_normal((23, 3))
    x[:11] += 4
    got = learn.embedding(spark.createDataFrame([(f"d{k:02d}", "c", f"f{f}", float(v)) for k, r in enumerate(x) for f, v in enumerate(r)], "dataset_id string, mts_class string, feature string, value double"), rounds=rounds, block=7)
    x = (x - x.mean(0)) / x.std(0)
    d, n = ((x[:, None] - x[None]) ** 2).sum(2), len(x)
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi, b = 0.0, np.inf, 1.0
        for _ in range(50):
            q = np.exp(-d[i] * b)
            q[i] = 0
            q /= q.sum()
            h = -(q * np.log(np.maximum(q, 1e-300))).sum()
            lo, hi = (b, hi) if h > np.log(min(10.0, (n - 1) / 3)) else (lo, b)
            b = b * 2 if hi == np.inf else (lo + hi) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y, v = np.random.default_rng(0).standard_normal((n, 2)) * 1e-2, np.zeros((n, 2))
    for _ in range(rounds):
        k = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(k, 0)
        g = (p * 4 - k / k.sum()) * k
        v = 0.5 * v - 50 * (g.sum(1)[:, None] * y - g @ y)
        y = y + v
    out = {r.dataset_id: (r.x, r.y) for r in got.collect()}
    assert np.allclose([out[f"d{k:02d}"] for k in range(n)], y, rtol=1e-6, atol=1e-9)


def test_tsne_takes_no_pair_of_all_in_a_round(spark, monkeypatch):
    """Near pairs and nodes give what blocks against all others give, in the driver and over tasks."""
    rng, calls, real = np.random.default_rng(3), [], learn.kernel_sums
    x = rng.standard_normal((700, 3)) + 9 * rng.integers(0, 3, (700, 1))
    x[600:640] = x[600]
    df = spark.createDataFrame([(f"d{k:03d}", "c", f"f{f}", float(v)) for k, r in enumerate(x) for f, v in enumerate(r)], "dataset_id string, mts_class string, feature string, value double").persist()
    monkeypatch.setattr(learn, "kernel_sums", lambda at, points, charges, columns=4096: calls.append(len(points)) or real(at, points, charges, columns))
    places = lambda: np.array([(r.x, r.y) for r in learn.embedding(df, rounds=12).orderBy("dataset_id").collect()])
    near = places()
    assert len(calls) == 12 and max(calls) < 350
    monkeypatch.setattr(learn, "SMALL", 0)
    assert np.allclose(places(), near, rtol=1e-9, atol=1e-13)
    monkeypatch.setattr(learn, "KEPT", 0)  # all pairs in every round
    assert np.allclose(places(), near, rtol=1e-9, atol=1e-13)


def test_nodes_give_the_sums_over_all_points():
    rng = np.random.default_rng(4)
    for width in (1e-3, 1.0, 4.0):
        y = rng.standard_normal((400, 2)) * [width, width / 3]
        c = np.c_[np.ones(400), y]
        exact = learn.kernel_sums(y, y, c)
        assert np.abs(learn.smooth_sums(y, c, lambda p, q: learn.kernel_sums(p, p, q), chunk=150) - exact).max() < 1e-12 * np.abs(exact).max()


def test_neighbourhoods_of_near_ones_are_those_of_all():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 4)) * rng.choice([0.01, 1, 30], (900, 1))
    x[:40] = x[0]
    some, every = learn.neighbourhoods(x, np.arange(900), 10.0, nearest=16), learn.neighbourhoods(x, np.arange(900), 10.0, nearest=899)
    assert np.allclose(some, every, rtol=1e-9)
    assert (some[0][:40] == 2.0**49).all() and np.allclose(some[1][:40], np.log(39))  # equal ones alone, not rounding
    d = ((x[40:, None] - x[None]) ** 2).sum(2)
    d[np.arange(860), np.arange(40, 900)] = np.inf
    p = np.exp(-d * some[0][40:, None] - some[1][40:, None])
    assert np.allclose(p.sum(1), 1, rtol=1e-8)
    ties = (p > 0.02).sum(1) >= 40  # those whose nearest are the 40 equal ones
    assert 0 < ties.sum() < 430 and np.allclose(-(p * np.log(np.maximum(p, 1e-300))).sum(1)[~ties], np.log(10), atol=1e-9)


def plain_tree(x, y, weight, classes):
    """A function from a value to class shares: splits at the first largest gain until rows are pure or equal."""
    count = np.bincount(y, weight, classes)
    best = (-1.0, 0.0)
    for a, b in zip(np.unique(x)[:-1], np.unique(x)[1:], strict=True) if count.max() < count.sum() else ():
        left = np.bincount(y[x <= a], weight[x <= a], classes)
        gain = (left**2).sum() / left.sum() + ((count - left) ** 2).sum() / (count - left).sum()
        best = max(best, (gain, -(a + b) / 2))  # of equal ones the least cut
    if best[0] < 0:
        return lambda v: count / count.sum()
    low = x <= -best[1]
    below, above = plain_tree(x[low], y[low], weight[low], classes), plain_tree(x[~low], y[~low], weight[~low], classes)
    return lambda v: below(v) if v <= -best[1] else above(v)


def test_a_forest_is_that_of_plain_trees_and_grows_side_by_side(monkeypatch):
    rng = np.random.default_rng(6)
    x, test_x = (rng.standard_normal((m, 1)).round(1) for m in (240, 60))  # many equal rows
    y, test_y = (((v[:, 0] > 0) + rng.integers(0, 2, len(v))).astype(int) for v in (x, test_x))
    votes = np.zeros((60, 3))
    for tree in range(25):
        weight = np.bincount(np.random.default_rng([0, tree]).integers(0, 240, 240), minlength=240)
        of = plain_tree(x[weight > 0, 0], y[weight > 0], weight[weight > 0], 3)
        votes += [of(v) for v in test_x[:, 0]]
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    assert learn.forest_accuracy(x, y, test_x, test_y, trees=25) == (votes.argmax(1) == test_y).mean()
    assert len(calls) < 100  # one or two a level, not a level and tree
    two, many = rng.integers(0, 9, (300, 5)) / 7, rng.integers(0, 4, 300)
    both = learn.forest_accuracy(two[:200], many[:200], two[200:], many[200:], trees=30)
    monkeypatch.setattr(learn, "TOGETHER", 1)
    assert learn.forest_accuracy(two[:200], many[:200], two[200:], many[200:], trees=30) == both
