"""Learning on feature tables: projection, selection, and what plots of statistics need."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import zscore


def vectors(features: DataFrame) -> tuple[DataFrame, list[str]]:
    """(dataset_id, mts_class, x vector) of long standardised features(dataset_id, mts_class, feature, value), names in order."""
    from pyspark.ml.feature import VectorAssembler

    z = features.select("dataset_id", "mts_class", "feature", zscore("value", "feature").alias("z"))
    names = [r["feature"] for r in z.select("feature").distinct().orderBy("feature").collect()]  # a catalogue's pairs
    wide = z.groupBy("dataset_id", "mts_class").pivot("feature", names).agg(F.first("z"))
    wide = wide.select("dataset_id", "mts_class", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(f"f{k}") for k, n in enumerate(names)])
    return VectorAssembler(inputCols=[f"f{k}" for k in range(len(names))], outputCol="x").transform(wide).select("dataset_id", "mts_class", "x"), names


def standardised(features: DataFrame) -> DataFrame:
    """(dataset_id, mts_class, feature, z) of long features; a dataset without a feature has its mean, 0, and no row."""
    return features.select("dataset_id", "mts_class", "feature", zscore("value", "feature").alias("z"))


def principal_axes(z: DataFrame, k: int, extra: int = 8, rounds: int = 60, tolerance: float = 1e-12):
    """(feature names, loadings (features, k), shares of variance) of standardised long rows, by subspace iteration.

    No wide row and no feature-by-feature table is made: a round sends each row's share of its dataset's scores
    through a window over the dataset, and sums the rows by feature. Only loadings (features times k + extra numbers)
    come to the driver; they are broadcast while they are few, and joined otherwise.
    """
    import numpy as np

    spark = z.sparkSession
    names = [r["feature"] for r in z.select("feature").distinct().orderBy("feature").collect()]  # a catalogue's pairs
    if not names:
        return [], np.zeros((0, 0)), []
    total = z.agg(F.sum(F.col("z") * F.col("z"))).first()[0] or 0.0
    width = min(len(names), k + extra)
    rows = z.repartition("dataset_id").persist()
    w = np.linalg.qr(np.random.default_rng(0).standard_normal((len(names), width)))[0]
    at, values = {n: i for i, n in enumerate(names)}, np.zeros(width)
    for _ in range(rounds):
        load = spark.createDataFrame([(n, *map(float, w[i])) for n, i in at.items()], "feature string, " + ", ".join(f"w{c} double" for c in range(width)))
        load = F.broadcast(load) if len(names) * width <= 1_000_000 else load
        by = Window.partitionBy("dataset_id")
        moved = rows.join(load, "feature").select("feature", "z", *[F.sum(F.col("z") * F.col(f"w{c}")).over(by).alias(f"t{c}") for c in range(width)])
        got = moved.groupBy("feature").agg(*[F.sum(F.col("z") * F.col(f"t{c}")).alias(f"v{c}") for c in range(width)]).collect()
        v = np.zeros_like(w)
        for r in got:
            v[at[r["feature"]]] = [r[f"v{c}"] for c in range(width)]
        new, turn = np.linalg.eigh((w.T @ v + v.T @ w) / 2)
        new, turn = new[::-1], turn[:, ::-1]
        done = np.abs(new[:k] - values[:k]).max() <= tolerance * max(new[0], 1e-300)
        values, best = new, w @ turn
        if done or width == len(names):
            break
        w = np.linalg.qr(v @ turn)[0]
    rows.unpersist()
    best = best[:, :k] * np.sign(best[np.abs(best[:, :k]).argmax(0), np.arange(min(k, width))])
    return names, best, [float(e / total) if total else 0.0 for e in values[:k]]


def pca(features: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Scores (dataset_id, mts_class, pc1..), signs fixed by the largest loading, and the explained shares of variance."""
    z = standardised(features)
    names, loads, shares = principal_axes(z, k)
    k = loads.shape[1]
    load = z.sparkSession.createDataFrame([(n, *map(float, row)) for n, row in zip(names, loads, strict=True)], "feature string" + "".join(f", w{c} double" for c in range(k)))
    load = F.broadcast(load) if len(names) * k <= 1_000_000 else load
    scores = z.join(load, "feature").groupBy("dataset_id", "mts_class").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("z") * F.col(f"w{c}")).alias(f"pc{c + 1}") for c in range(k)])
    return scores.drop("n"), shares


def estimator(kind: str, classes: int):
    from pyspark.ml import classification as C

    if kind == "logistic":
        return C.LogisticRegression(featuresCol="v", labelCol="y", maxIter=2000)
    if kind == "svc":
        svc = C.LinearSVC(featuresCol="v", labelCol="y", maxIter=5000)
        return svc if classes <= 2 else C.OneVsRest(classifier=svc, featuresCol="v", labelCol="y")
    raise ValueError(f"unknown estimator {kind}")


#: Rows of bootstraps that grow side by side: as many trees as make so many, at least one.
TOGETHER = 100_000


def sorted_with(key, limit: int):
    """The keys (below limit) in order, and the place each came from: one sort of numbers that hold both."""
    import numpy as np

    bits = len(key).bit_length()
    if limit >> (62 - bits):
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = key << bits | np.arange(len(key))
    both.sort()
    return both >> bits, both & (1 << bits) - 1


def grown(x, ranks, y, of_row, test_x, classes: int, rngs):
    """Class shares of the leaves (tree, test row, class) that the test rows reach in trees of these generators' bootstraps.

    x, ranks and y hold different rows; of_row is the place in them of every row that bootstraps draw from.
    """
    import numpy as np

    n, width = len(of_row), x.shape[1]
    tests, tries, distinct = len(test_x), max(1, int(math.sqrt(width))), int(ranks.max()) + 1
    out = np.zeros((len(rngs) * tests, classes))
    weights = [np.bincount(of_row[g.integers(0, n, n)], minlength=len(x)) for g in rngs]
    rows = [np.flatnonzero(w) for w in weights]
    weight = np.concatenate([w[r] for w, r in zip(weights, rows, strict=True)])
    node, rows = np.repeat(np.arange(len(rngs)), [len(r) for r in rows]), np.concatenate(rows)
    test, test_node, tree = np.arange(len(out)), np.repeat(np.arange(len(rngs)), tests), np.arange(len(rngs))
    if width == 1:  # in the order of the only feature, which splits keep
        order = sorted_with(node * distinct + ranks[rows, 0], len(rngs) * distinct)[1]
        node, rows, weight = node[order], rows[order], weight[order]
    while len(test):
        nodes = len(tree)
        label = y[rows]
        count = np.bincount(node * classes + label, weight, nodes * classes).astype(np.int64)
        shares = count.reshape(nodes, classes)
        size, square = shares.sum(1), (shares * shares).sum(1)
        each = np.bincount(tree, minlength=len(rngs))
        turn = np.concatenate([g.random((m, width)) for g, m in zip(rngs, each, strict=True)]).argsort(1) if width > 1 else np.zeros((nodes, 1), int)
        best, feature, cut = np.full(nodes, -1.0), np.full(nodes, -1), np.zeros(nodes)
        mixed = shares.max(1) < size
        for k in range(width):
            seek = mixed if k < tries else mixed & (feature < 0)
            at = np.flatnonzero(seek[node])
            if not len(at):
                break
            key = node[at] * distinct + ranks.ravel()[rows[at] * width + turn[node[at], k]]
            if width > 1:
                key, order = sorted_with(key, nodes * distinct)
                at = at[order]
            of, r, w = node[at], rows[at], weight[at]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            ends = np.flatnonzero((of[1:] == of[:-1]) & (key[1:] != key[:-1]))
            if not len(ends):
                continue
            # Of each row its class's weight in the node so far; so squares of counts are sums over rows.
            group = of * classes + label[at]
            by, place = sorted_with(group, nodes * classes)
            own = w[place]
            run = own.cumsum()
            start = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
            so_far = np.empty(len(w), np.int64)
            so_far[place] = run - np.repeat((run - own)[start], np.diff(np.r_[start, len(by)]))
            sums = []
            for step in (w, w * (2 * so_far - w), w * count[group]):
                total = step.cumsum()
                base = np.zeros(nodes, np.int64)
                base[of[first]] = total[first] - step[first]
                sums.append(total[ends] - base[of[ends]])
            at_node, (total, left, both) = of[ends], sums
            gain = left / total + (square[at_node] - 2 * both + left) / (size[at_node] - total)
            start = np.flatnonzero(np.r_[True, at_node[1:] != at_node[:-1]])
            top = np.maximum.reduceat(gain, start)
            here = at_node[start]
            where = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[start, len(gain)])))
            where = where[np.r_[True, at_node[where][1:] != at_node[where][:-1]]]
            better = top > best[here]
            here, e, top = here[better], ends[where[better]], top[better]
            f = turn[here, k]
            best[here], feature[here] = top, f
            cut[here] = (x[r[e], f] + x[r[e + 1], f]) / 2
        done = feature[test_node] < 0
        out[test[done]] = (shares / size[:, None])[test_node[done]]
        test, test_node = test[~done], test_node[~done]
        test_node = 2 * test_node + (test_x.ravel()[test % tests * width + feature[test_node]] > cut[test_node])
        on = feature[node] >= 0
        rows, node, weight = rows[on], node[on], weight[on]
        node = 2 * node + (x.ravel()[rows * width + feature[node]] > cut[node])
        number = np.zeros(2 * nodes, int)
        number[test_node] = 1
        reached = np.flatnonzero(number)
        number = np.full(2 * nodes, -1)
        number[reached] = np.arange(len(reached))
        node, test_node, tree = number[node], number[test_node], tree[reached // 2]
        rows, node, weight = rows[node >= 0], node[node >= 0], weight[node >= 0]
    return out.reshape(len(rngs), tests, classes)


def forest_accuracy(x, y, test_x, test_y, trees: int = 300, seed: int = 0) -> float:
    """Accuracy on the test rows of a random forest: bootstraps, Gini, square root of the features a split, leaves pure or inseparable.

    Trees grow level by level, all nodes of a level in the same few array operations, and several trees at once where
    rows are few. Equal rows of a class are one with their weights' sum. Test rows go down with the trees, equal ones
    together; branches that none of them reaches are not grown.
    """
    import numpy as np

    classes = int(max(y.max(), test_y.max())) + 1
    ranks = np.stack([np.unique(x[:, f], return_inverse=True)[1].ravel() for f in range(x.shape[1])], 1)
    of_row = y
    for f in range(x.shape[1]):
        of_row = np.unique(of_row * (int(ranks.max()) + 1) + ranks[:, f], return_inverse=True)[1].ravel()
    one = np.unique(of_row, return_index=True)[1]
    tests, of_test = np.unique(test_x, axis=0, return_inverse=True)
    x, ranks, votes, step = np.ascontiguousarray(x[one]), np.ascontiguousarray(ranks[one]), np.zeros((len(tests), classes)), max(1, TOGETHER // len(y))
    for first in range(0, trees, step):
        for shares in grown(x, ranks, y[one], of_row, tests, classes, [np.random.default_rng([seed, t]) for t in range(first, min(first + step, trees))]):
            votes += shares
    return float((votes.argmax(1)[of_test.ravel()] == test_y).mean())


def folds(x: DataFrame, splits: int) -> tuple[DataFrame, int]:
    """Stratified fold numbers; as many folds as the smallest class has rows, at least 2, at most splits."""
    least = x.groupBy("y").count().agg(F.min("count")).first()[0]
    k = max(2, min(splits, least))
    return x.withColumn("fold", (F.row_number().over(Window.partitionBy("y").orderBy("dataset_id")) - 1) % k), k


def forward_selection(features: DataFrame, target: int = 12, splits: int = 5, kind: str = "rf", candidates: list[str] | None = None) -> list[tuple[str, float]]:
    """Feature after feature, the one that raises cross-validated accuracy most (ties: first by name), with that accuracy.

    At most target features, or all there are. Forests: every candidate's every fold is a task, and gets
    the study's matrix (a row a dataset) by broadcast; the other estimators are Spark's.
    """
    import numpy as np
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer, VectorSlicer

    x, names = vectors(features)
    x = StringIndexer(inputCol="mts_class", outputCol="y", stringOrderType="alphabetAsc").fit(x).transform(x)
    x, k = folds(x, splits)
    x = x.persist()
    n_classes = x.select("y").distinct().count()
    score = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    chosen: list[tuple[str, float]] = []
    spark = x.sparkSession
    if kind == "rf":
        got = x.orderBy("dataset_id").select("x", "y", "fold").collect()
        held = spark.sparkContext.broadcast((np.array([r["x"].toArray() for r in got]), np.array([int(r["y"]) for r in got]), np.array([r["fold"] for r in got])))

    def forests(jobs: list[list[int]]) -> list[list[float]]:
        """Accuracies by fold for each list of columns."""

        def run(frames):
            m, y, fold = held.value
            for pdf in frames:
                pdf["accuracy"] = [forest_accuracy(m[fold != f][:, list(at)], y[fold != f], m[fold == f][:, list(at)], y[fold == f]) for at, f in zip(pdf["at"], pdf["fold"], strict=True)]
                yield pdf[["job", "fold", "accuracy"]]

        todo = spark.createDataFrame([(n * k + f, n, f, at) for n, at in enumerate(jobs) for f in range(k)], "id int, job int, fold int, at array<int>")
        done = {(r["job"], r["fold"]): r["accuracy"] for r in todo.repartitionByRange(len(jobs) * k, "id").mapInPandas(run, "job int, fold int, accuracy double").collect()}
        return [[done[n, f] for f in range(k)] for n in range(len(jobs))]

    left = [n for n in names if candidates is None or n in candidates]
    while left and len(chosen) < target:
        best = ("", -1.0)
        sets = [[names.index(n) for n, _ in chosen] + [names.index(name)] for name in left]
        by_forest = forests(sets) if kind == "rf" else None
        for c, name in enumerate(left):
            if by_forest:
                acc = by_forest[c]
            else:
                v = VectorSlicer(inputCol="x", outputCol="v", indices=sets[c]).transform(x)
                acc = [score.evaluate(estimator(kind, n_classes).fit(v.filter(F.col("fold") != f)).transform(v.filter(F.col("fold") == f))) for f in range(k)]
            if sum(acc) / k > best[1] + 1e-12:
                best = (name, sum(acc) / k)
        chosen.append(best)
        left.remove(best[0])
    x.unpersist()
    return chosen


#: Least probability of a pair in t-SNE; the most pairs above it, a dataset, that are kept between rounds; the most datasets
#: whose rounds are no jobs.
FLOOR, KEPT, SMALL = 1e-12, 4096, 2048


def distances(x, rows):
    """Squared distances of the rows to all of x, to rounding of the squared norms."""
    return ((x[rows] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[rows] @ x.T).clip(0)


def bandwidths(d, goal: float, b):
    """(precision, logarithm of the sum of kernels) at which the rows' kernels over distances d have entropy goal, from a guess b.

    Newton steps within a bracket. A row whose nearest are too many equal ones for that goal ends at 2^49, or a million
    to the nearest one's distance, where the sum still tells its terms.
    """
    import numpy as np

    b, total = b.copy(), np.ones(len(b))
    lo, hi, left = np.zeros(len(b)), np.full(len(b), np.inf), np.arange(len(b))
    base = d.min(1)
    most = np.minimum(2.0**49, 1e6 / np.maximum(base, 1e-300))
    for _ in range(100):
        e = d[left] - base[left, None]
        q = np.exp(-e * b[left, None])
        sums = q.sum(1)
        mean = np.einsum("ij,ij->i", q, e) / sums
        spread = np.einsum("ij,ij,ij->i", q, e, e) / sums - mean**2
        off = np.log(sums) + b[left] * mean - goal
        total[left] = np.log(sums) - base[left] * b[left]
        on = (np.abs(off) > 1e-14 * max(1.0, goal)) & (b[left] < most[left])
        left, off, spread = left[on], off[on], spread[on]
        if not len(left):
            break
        now = b[left]
        lo[left], hi[left] = np.where(off > 0, now, lo[left]), np.where(off > 0, hi[left], now)
        new = now + off / np.maximum(now * spread, 1e-300)
        low, high = lo[left], np.minimum(hi[left], 4 * now)
        b[left] = np.minimum(np.where((new > low) & (new < high), new, np.where(np.isinf(hi[left]), 2 * now, (low + high) / 2)), most[left])
    return b, total


def neighbourhoods(x, rows, perplexity: float, nearest: int = 512):
    """(precision, logarithm of the sum of kernels) of the rows' Gaussian neighbourhoods of that perplexity among all of x.

    Taken over a row's nearest ones alone, exactly measured; over 16 times as many, up to all, while the others' kernels
    together could come to 1e-13 of the sum. Farther ones only raise the entropy, and so the precision.
    """
    import numpy as np

    n = len(x)
    goal, width, total = np.log(min(perplexity, max((n - 1) / 3, 1.01))), np.ones(len(rows)), np.zeros(len(rows))
    step = max(1, 4_000_000 // n)
    for start in range(0, len(rows) if n > 1 else 0, step):
        own = rows[start : start + step]
        d = distances(x, own)
        d[np.arange(len(own)), own] = np.inf
        left, m = np.arange(len(own)), min(nearest, n - 1)
        while len(left):
            at = np.argpartition(d[left], m - 1, axis=1)[:, :m]
            farthest = d[left, at[:, m - 1]]
            few = max(1, 4_000_000 // (m * x.shape[1] + 1))
            for k in range(0, len(left), few):
                part, to = left[k : k + few], at[k : k + few]
                e = sum((x[own[part], f][:, None] - x[to, f]) ** 2 for f in range(x.shape[1]))
                width[start + part], total[start + part] = bandwidths(e, goal, width[start + part])
            rest = (n - 1 - m) * np.exp(-farthest * width[start + left] - total[start + left]) > 1e-13
            rest |= (farthest < 1e-9) & (m < n - 1)  # equal ones, to the rounding of distances
            left, m = left[rest & (m < n - 1)], min(16 * m, n - 1)
    return width, total


def near_pairs(x, width, total, rows):
    """(pairs of each of the rows; other rows, probabilities above the floor) of the pairs that are above it, row after row."""
    import numpy as np

    n, found = len(x), []
    # Within the reach of either end: farther ones' halves are both under the floor.
    reach = np.maximum(-np.log(FLOOR * n) - total, 0) / width
    step = max(1, 4_000_000 // n)
    for start in range(0, len(rows), step):
        own = rows[start : start + step]
        i, j = np.nonzero(distances(x, own) <= np.maximum(reach[own, None], reach) * (1 + 1e-12) + 1e-9)
        i, j = i[own[i] != j], j[own[i] != j]
        e = sum((x[own[i], f] - x[j, f]) ** 2 for f in range(x.shape[1]))
        p = (np.exp(-e * width[own[i]] - total[own[i]]) + np.exp(-e * width[j] - total[j])) / (2 * n) - FLOOR
        found.append((np.bincount(i[p > 0], minlength=len(own)), j[p > 0].astype(np.int32), p[p > 0]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def pulls(pairs, y, rows):
    """Attraction of the rows by their near pairs: sums of probability above the floor times kernel times difference of places."""
    import numpy as np

    counts, j, p = pairs
    i = np.repeat(np.arange(len(rows)), counts)
    dx, dy = y[rows, 0][i] - y[j, 0], y[rows, 1][i] - y[j, 1]
    w = p / (1 + dx * dx + dy * dy)
    return np.stack([np.bincount(i, w * dx, len(rows)), np.bincount(i, w * dy, len(rows))], 1)


def kernel_sums(at, points, charges, columns: int = 4096):
    """At the places: sums over all points of kernel times charges, then of squared kernel times charges."""
    import numpy as np

    out = np.zeros((len(at), 2 * charges.shape[1]))
    for start in range(0, len(points), columns):
        of, c = points[start : start + columns], charges[start : start + columns]
        k = 1 / (1 + (at[:, :1] - of[:, 0]) ** 2 + (at[:, 1:] - of[:, 1]) ** 2)
        out[:, : c.shape[1]] += k @ c
        k *= k
        out[:, c.shape[1] :] += k @ c
    return out


def nodes_per_axis(half) -> list[int]:
    """Chebyshev nodes for 1 / (1 + r^2), and its square, over that half of a width to 1e-16: the poles are at a distance of 1."""
    return [math.ceil(37 / math.asinh(1 / h)) + 3 for h in half]


def lagrange(u, p: int):
    """Values at u (within -1 to 1) of the p Lagrange polynomials on the Chebyshev nodes."""
    import numpy as np

    k = np.arange(p)
    c = np.cos(np.outer((k + 0.5) * np.pi / p, k)) * 2 / p
    c[:, 0] /= 2
    return np.cos(np.arccos(u.clip(-1, 1))[:, None] * k) @ c.T


def smooth_sums(y, charges, between, chunk: int = 65536):
    """kernel_sums of the points at themselves through Chebyshev nodes of their box; between(nodes, charges) sums among nodes."""
    import numpy as np

    middle = (y.max(0) + y.min(0)) / 2
    half = np.maximum((y.max(0) - y.min(0)) / 2, 1e-9)
    p, q = nodes_per_axis(half)
    chunks = [slice(s, s + chunk) for s in range(0, len(y), chunk)]
    bases = lambda c: (lagrange((y[c, 0] - middle[0]) / half[0], p), lagrange((y[c, 1] - middle[1]) / half[1], q))
    held = np.zeros((p, q, charges.shape[1]))
    for c in chunks:
        a, b = bases(c)
        for k in range(charges.shape[1]):
            held[:, :, k] += a.T @ (b * charges[c, k : k + 1])
    one, two = (np.cos((np.arange(m) + 0.5) * np.pi / m) * h for m, h in zip((p, q), half, strict=True))
    s = between(np.stack([np.repeat(one, q), np.tile(two, p)], 1), held.reshape(p * q, -1)).reshape(p, q, -1)
    out = np.empty((len(y), s.shape[2]))
    for c in chunks:
        a, b = bases(c)
        for k in range(s.shape[2]):
            out[c, k] = np.einsum("ij,ij->i", a @ s[:, :, k], b)
    return out


def forces(x, y, width, total, rows, columns: int = 4096):
    """Of the rows, summed over all others: attraction (2 columns), repulsion before scaling (2), and kernels (1)."""
    import numpy as np

    n, out = len(x), np.zeros((len(rows), 5))
    xr, yr = x[rows], y[rows]
    for start in range(0, n, columns):
        at = np.arange(start, min(start + columns, n))
        xc, yc = x[at], y[at]
        d = sum((xr[:, f : f + 1] - xc[:, f]) ** 2 for f in range(x.shape[1]))
        d[rows[:, None] == at] = np.inf
        p = np.exp(-d * width[rows][:, None] - total[rows][:, None]) + np.exp(-d * width[at] - total[at])
        p = np.maximum(p / (2 * n), FLOOR)
        k = 1 / (1 + (yr[:, :1] - yc[:, 0]) ** 2 + (yr[:, 1:] - yc[:, 1]) ** 2)
        k[rows[:, None] == at] = 0
        p *= k
        out[:, 4] += k.sum(1)
        k *= k
        out[:, :2] += p.sum(1)[:, None] * yr - p @ yc
        out[:, 2:4] += k.sum(1)[:, None] * yr - k @ yc
    return out


def embedding(features: DataFrame, seed: int = 0, rounds: int = 300, perplexity: float = 10.0, block: int = 128) -> DataFrame:
    """Two-dimensional t-SNE of datasets, exact to rounding: every round is a job in which a task takes blocks of rows (up to SMALL datasets: none).

    Neighbourhoods and the pairs above the least probability come from one pass each over all pairs, in blocks. What is left
    of a round's sums over all pairs has the smooth kernel of the places alone: it goes through Chebyshev nodes of their box,
    to 1e-16 of the kernel, where these are fewer than the datasets, and else block by block over all. Where more pairs than
    KEPT a dataset are above the least probability (many equal datasets), every round takes all pairs anew.
    Each task has the study's matrix (a row a dataset, a column a feature) and the places.
    """
    import numpy as np
    from pyspark import StorageLevel

    spark = features.sparkSession
    means = features.groupBy("dataset_id", "mts_class", "feature").agg(F.avg("value").alias("value"))
    names = [r[0] for r in means.select("feature").distinct().orderBy("feature").collect()]  # a catalogue's pairs
    wide = means.groupBy("dataset_id", "mts_class").pivot("feature", names).agg(F.first("value")).toPandas().sort_values(["dataset_id", "mts_class"])
    x = wide[names].fillna(0).to_numpy(float)
    n = len(x)
    if not n:
        return spark.createDataFrame([], "dataset_id string, mts_class string, x double, y double")
    x = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))

    def deal(size: int):
        """First rows of blocks; a task has 64 at most, as its pairs are one cached block."""
        blocks, cores = -(-size // block), spark.sparkContext.defaultParallelism
        return spark.sparkContext.parallelize(range(0, size, block), min(blocks, cores * -(-blocks // (64 * cores))))

    todo, held = deal(n), spark.sparkContext.broadcast(x)
    rows = lambda s, size=n: np.arange(s, min(s + block, size))
    width, total = (np.concatenate(c) for c in zip(*todo.map(lambda s: neighbourhoods(held.value, rows(s), perplexity)).collect(), strict=True))
    around = spark.sparkContext.broadcast((width, total))
    near = todo.map(lambda s: (s, near_pairs(held.value, *around.value, rows(s)))).persist(StorageLevel.MEMORY_AND_DISK)
    few = n <= KEPT or near.map(lambda t: len(t[1][1])).sum() <= KEPT * n
    own = near.collect() if few and n <= SMALL else None
    if not few:
        near.unpersist()

    def between(points, charges):
        """Kernel sums among the points, over tasks where they are many."""
        if len(points) <= SMALL:
            return kernel_sums(points, points, charges)
        sent = spark.sparkContext.broadcast((points, charges))
        got = deal(len(points)).map(lambda s: kernel_sums(sent.value[0][s : s + block], *sent.value)).collect()
        sent.destroy()
        return np.concatenate(got)

    def shares(y):
        """Attraction (2 columns) and repulsion before scaling (2) of all rows, and the sum of all kernels."""
        places = spark.sparkContext.broadcast(y) if own is None else None
        if not few:
            f = np.concatenate(todo.map(lambda s, at=places: forces(held.value, at.value, *around.value, rows(s))).collect())
            places.destroy()
            return f[:, :2], f[:, 2:4], f[:, 4].sum()
        if own is None:
            pull = np.concatenate(near.map(lambda t, at=places: pulls(t[1], at.value, rows(t[0]))).collect())
            places.destroy()
        else:
            pull = np.concatenate([pulls(t, y, rows(s)) for s, t in own])
        c = np.c_[np.ones(n), y - (y.max(0) + y.min(0)) / 2]
        narrow = 2 * math.prod(nodes_per_axis(np.maximum(np.ptp(y, axis=0) / 2, 1e-9))) < n
        s = smooth_sums(c[:, 1:], c, between) if narrow else between(c[:, 1:], c)
        return pull + FLOOR * (s[:, :1] * c[:, 1:] - s[:, 1:3]), s[:, 3:4] * c[:, 1:] - s[:, 4:6], s[:, 0].sum() - n

    y, v = np.random.default_rng(seed).standard_normal((n, 2)) * 1e-2, np.zeros((n, 2))
    for r in range(rounds if n > 1 else 0):
        attraction, repulsion, kernels = shares(y)
        v = (0.5 if r < 100 else 0.8) * v - 50 * ((4 if r < 100 else 1) * attraction - repulsion / max(kernels, 1e-300))
        y = y + v
    near.unpersist()
    held.destroy()
    around.destroy()
    found = wide[["dataset_id", "mts_class"]].assign(x=y[:, 0], y=y[:, 1])
    return spark.createDataFrame(found, "dataset_id string, mts_class string, x double, y double")


def color_scale(name: Column, labels: Column, low: Column, high: Column) -> Column:
    """Kind of colour scale for a statistic: by its name first, then its labels, then its range."""
    n = F.lower(name)
    return (
        F.when(n.rlike("pearson|spearman|kendall|corr|icoh"), F.lit("diverging_unit"))
        .when(n.rlike("^cov|^prec"), F.lit("diverging"))
        .when(F.array_contains(labels, "unsigned"), F.lit("sequential"))
        .when(F.array_contains(labels, "signed"), F.lit("diverging"))
        .when(n.rlike("dist|dtw|mi_|entropy|te_|coh"), F.lit("sequential"))
        .when((low < 0) & (high > 0), F.lit("diverging"))
        .otherwise(F.lit("sequential"))
    )


# Parts of names by which plots know correlations and statistics that are never negative.
CORRELATIONS = ("corr", "spearman", "kendall")
NEVER_NEGATIVE = ("-sq", "sq_", "pdist", "dcorr", "hsic", "gwtau", "mi_", "mi-", "tlmi", "te_", "te-", "di_", "cce_", "ce_", "je_", "si_", "xcorr-sq", "dcorrx", "bary", "coh", "plv", "pli", "wpli", "dtf", "dcoh", "pdcoh", "gpdcoh", "sgc", "gd", "pec")


def color_range(name: Column, labels: Column, low: Column, high: Column) -> Column:
    """Struct of vmin, vmax, center, scale for a statistic's plot, from its name, its labels (array) and its range.

    Correlations run from -1 to 1; covariances and what is labelled signed lie evenly about 0; what is labelled
    unsigned, or known by its name never to be negative, starts at 0; others go by the signs that they have.
    """
    n, tags = F.lower(name), F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.lower)
    real = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    a, b = real(low), real(high)
    has = lambda words: n.rlike("|".join(w.replace("-", "[-]") for w in words))
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    scale = lambda lo, hi, middle, kind: F.struct(lo.alias("vmin"), hi.alias("vmax"), middle.alias("center"), F.lit(kind).alias("scale"))
    widest = F.greatest(F.abs(a), F.abs(b))
    even = lambda m: scale(-m, m, zero, "diverging")
    upward = scale(zero, F.when(b > 0, b).otherwise(1.0), none, "sequential")
    signed, unsigned = F.array_contains(tags, "signed"), F.array_contains(tags, "unsigned") | has(NEVER_NEGATIVE)
    return (
        F.when(has(CORRELATIONS) & ~n.contains("-sq") & ~n.contains("sq_"), even(F.lit(1.0)))
        .when(n.startswith("cov") | n.startswith("prec"), even(F.greatest(widest, F.lit(1e-6))))
        .when(unsigned & ~signed, upward)
        .when(signed, even(widest))
        .when(unsigned, upward)
        .when((a < 0) & (b > 0), even(widest))
        .when(b <= 0, scale(a, zero, none, "sequential"))
        .otherwise(scale(zero, b, none, "sequential"))
    )
