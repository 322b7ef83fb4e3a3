"""Matrix and edge algebra, edge vectors, and features of statistics against statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank, pearson, zscore


def mirrored(edges: DataFrame) -> DataFrame:
    """Undirected i < j edges, both ways."""
    return edges.unionByName(edges.select("dataset_id", "spi", F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Half the sum of both directions, for both."""
    mean = F.avg("value").over(Window.partitionBy("dataset_id", "spi", F.least("i", "j"), F.greatest("i", "j")))
    return edges.withColumn("value", mean)


def with_diagonal(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """All (i, j) of each dataset of `m` processes; a zero diagonal."""
    names = edges.select("dataset_id", "spi").distinct().join(sizes, "dataset_id")
    diagonal = names.select("dataset_id", "spi", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i")).select("dataset_id", "spi", "i", F.col("i").alias("j"), F.lit(0.0).alias("value"))
    return edges.filter("i <> j").unionByName(diagonal)


def wide(edges: DataFrame, m: int) -> DataFrame:
    """One row per (dataset, statistic, i), a column proc-j for each j."""
    return edges.groupBy("dataset_id", "spi", "i").pivot("j", list(range(m))).agg(F.first("value")).select("dataset_id", "spi", "i", *[F.col(str(j)).alias(f"proc-{j}") for j in range(m)])


def from_wide(df: DataFrame, m: int) -> DataFrame:
    """The edges of a wide table, diagonal zero."""
    cells = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"`proc-{j}`").alias("value")) for j in range(m)]))
    long = df.select("dataset_id", "spi", "i", cells.alias("c")).select("dataset_id", "spi", "i", "c.j", "c.value")
    return long.withColumn("value", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("value")))


def to_vectors(edges: DataFrame, sizes: DataFrame, shape: str) -> DataFrame:
    """(dataset_id, spi, k, value): matrices laid out row by row, as 'directed' (no diagonal), 'upper' (triangle) or 'square'."""
    if shape == "upper":
        return upper(edges, sizes).select("dataset_id", "spi", "k", "value")
    if shape == "square":
        return full(edges, sizes).select("dataset_id", "spi", "k", "value")
    i, j = F.col("i"), F.col("j")
    k = i * (F.col("m") - 1) + j - (j > i).cast("int")
    return edges.filter("i <> j").join(sizes, "dataset_id").select("dataset_id", "spi", k.cast("int").alias("k"), "value")


def rebuild(values: DataFrame, sizes: DataFrame, symmetric: list[str] | None = None) -> DataFrame:
    """Edges of matrices laid out as vectors(dataset_id, spi, k, value); how, is told by how many values there are.

    Of m processes: m (m - 1) values are all off the diagonal, half as many the upper triangle, m * m the whole matrix,
    which keeps its diagonal. `symmetric` statistics: the mean of both directions, and a triangle counts both ways;
    without that its lower half is zero. Any other number of values is an error.
    """
    m, k, n = F.col("m").cast("long"), F.col("k").cast("long"), F.count(F.lit(1)).over(Window.partitionBy("dataset_id", "spi"))
    shape = F.when(n == m * (m - 1), "directed").when(2 * n == m * (m - 1), "upper").when(n == m * m, "square")
    wrong = F.raise_error(F.concat(F.lit("no matrix can be made of "), "spi", F.lit(" of "), "dataset_id", F.lit(": values "), n.cast("string")))
    at = values.join(sizes, "dataset_id").withColumn("shape", F.coalesce(shape, wrong.cast("string"))).withColumns({"m": m, "k": k})
    row, rest = F.floor(k / (m - 1)), k % (m - 1)
    # The row of the triangle's k-th value: the root of a quadratic, put right where rounding has missed it.
    root = F.floor((2 * m - 1 - F.sqrt(F.greatest(((2 * m - 1) * (2 * m - 1) - 8 * k).cast("double"), F.lit(0.0)))) / 2)
    start = lambda i: i * m - i * (i + 1) / 2
    up = F.when(start(root + 1) <= k, root + 1).when(start(root) > k, root - 1).otherwise(root)
    i = F.when(F.col("shape") == "directed", row).when(F.col("shape") == "upper", up).otherwise(F.floor(k / m))
    at = at.withColumn("i", i.cast("int"))
    j = F.when(F.col("shape") == "directed", rest + (rest >= F.col("i")).cast("int")).when(F.col("shape") == "upper", k - start(F.col("i")) + F.col("i") + 1).otherwise(k % m)
    at = at.withColumn("j", j.cast("int"))
    both = F.col("spi").isin(symmetric or [])
    one = F.struct("i", "j", "value")
    back = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.when(both, F.col("value")).otherwise(0.0).alias("value"))
    cells = at.select("dataset_id", "spi", "shape", F.explode(F.when(F.col("shape") == "upper", F.array(one, back)).otherwise(F.array(one))).alias("c")).select("dataset_id", "spi", "shape", "c.*")
    mean = F.avg("value").over(Window.partitionBy("dataset_id", "spi", F.least("i", "j"), F.greatest("i", "j")))
    return cells.withColumn("value", F.when(both & (F.col("shape") == "directed"), mean).otherwise(F.col("value"))).drop("shape")


def upper(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The upper triangle, k its ordinal, row-major."""
    i, j = F.col("i"), F.col("j")
    return edges.join(sizes, "dataset_id").filter("i < j").withColumn("k", (i * F.col("m") - i * (i + 1) / 2 + j - i - 1).cast("int")).drop("m")


def lower(edges: DataFrame) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    return edges.filter("i > j").withColumn("k", (i * (i - 1) / 2 + j).cast("int"))


def full(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    return edges.join(sizes, "dataset_id").withColumn("k", (F.col("i") * F.col("m") + F.col("j")).cast("int")).drop("m")


def edge_vectors(edges: DataFrame, sizes: DataFrame, directed: list[str], single: bool = False) -> DataFrame:
    """(dataset_id, spi, k, z): undirected statistics by their upper triangle; directed ones as spi__ij and spi__ji.

    The two triangles pair by ordinal. A constant vector, or one with a value that isn't finite, is all 0.
    single: z in single precision, so that values closer than that become ties.
    """
    isdir = F.col("spi").isin(directed)
    up = upper(edges, sizes).withColumn("spi", F.when(isdir, F.concat("spi", F.lit("__ij"))).otherwise(F.col("spi")))
    low = lower(edges.filter(isdir)).withColumn("spi", F.concat("spi", F.lit("__ji")))
    v = up.unionByName(low).select("dataset_id", "spi", "k", F.coalesce("value", F.lit(float("nan"))).alias("value"))
    z = zscore("value", "dataset_id", "spi")
    return v.select("dataset_id", "spi", "k", (z.cast("float") if single else z).alias("z"))


def spi_features(vectors: DataFrame) -> DataFrame:
    """Spearman of each pair of statistics of a dataset over their edges: (dataset_id, spi_a, spi_b, rho), a before b by name."""
    r = vectors.select("dataset_id", "spi", "k", average_rank("z", "dataset_id", "spi").alias("r"))
    a = r.select("dataset_id", "k", F.col("spi").alias("spi_a"), F.col("r").alias("x"))
    b = r.select("dataset_id", "k", F.col("spi").alias("spi_b"), F.col("r").alias("y"))
    return a.join(b, ["dataset_id", "k"]).filter("spi_a < spi_b").groupBy("dataset_id", "spi_a", "spi_b").agg(F.coalesce(pearson("x", "y"), F.lit(0.0)).alias("rho"))


def mixed_features(edges: DataFrame, sizes: DataFrame, directed: list[str]) -> DataFrame:
    """Upper triangles where both statistics are undirected, else both full matrices with their diagonal.

    A vector with a value that isn't finite is all 0.
    """
    isdir = lambda c: F.col(c).isin(directed)
    tri = upper(edges, sizes).select("dataset_id", "spi", "k", F.coalesce("value", F.lit(float("nan"))).alias("value"))
    all_ = full(with_diagonal(edges, sizes), sizes).select("dataset_id", "spi", "k", F.coalesce("value", F.lit(float("nan"))).alias("value"))
    # Values themselves are ranked: standardised, some that differ by little would become ties.
    by = Window.partitionBy("dataset_id", "spi")
    bad = F.max(F.isnan("value") | (F.abs("value") == float("inf"))).over(by)
    z = lambda v: v.select("dataset_id", "spi", "k", F.when(bad, 0.0).otherwise(F.col("value")).alias("z"))
    both = spi_features(z(tri)).filter(~isdir("spi_a") & ~isdir("spi_b"))
    return both.unionByName(spi_features(z(all_)).filter(isdir("spi_a") | isdir("spi_b")))


def raw_features(edges: DataFrame, sizes: DataFrame, directed: list[str]) -> DataFrame:
    """(dataset_id, spi, k, z): the edges themselves as features, standardised in single precision.

    Undirected statistics give their upper triangle, directed ones the whole matrix row by row with its zero diagonal.
    """
    isdir = F.col("spi").isin(directed)
    tri = upper(edges.filter(~isdir), sizes).select("dataset_id", "spi", "k", "value")
    all_ = full(with_diagonal(edges.filter(isdir), sizes), sizes).select("dataset_id", "spi", "k", "value")
    v = tri.unionByName(all_).withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    return v.select("dataset_id", "spi", "k", zscore("value", "dataset_id", "spi").cast("float").alias("z"))


def ks_between(features: DataFrame, classes: list[str], alternative: str = "two-sided") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of each feature between each two classes, in the order given.

    features(mts_class, feature, value) to (class_a, class_b, feature, ks, n_a, n_b). A feature's values are counted
    by class and cumulated once, in one shuffle; every two classes compare these counts.
    """
    pairs = [(a, b) for a in range(len(classes)) for b in range(a + 1, len(classes))]
    by = features.filter(F.col("mts_class").isin(classes)).select("mts_class", "feature", "value").repartition("feature")
    counts = by.groupBy("feature", "value").agg(*[F.count_if(F.col("mts_class") == c).alias(f"n{k}") for k, c in enumerate(classes)])
    run, whole = Window.partitionBy("feature").orderBy("value"), Window.partitionBy("feature")
    cdf = counts.select("feature", *[F.try_divide(F.sum(f"n{k}").over(run), F.sum(f"n{k}").over(whole)).alias(f"f{k}") for k in range(len(classes))], *[f"n{k}" for k in range(len(classes))])

    def gap(a: int, b: int) -> Column:
        d = F.col(f"f{a}") - F.col(f"f{b}")
        return F.max({"two-sided": F.abs(d), "greater": d, "less": -d}[alternative]).alias(f"k{a}_{b}")

    found = cdf.groupBy("feature").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(classes))], *[gap(a, b) for a, b in pairs])
    one = [F.struct(F.lit(classes[a]).alias("class_a"), F.lit(classes[b]).alias("class_b"), F.col(f"k{a}_{b}").alias("ks"), F.col(f"n{a}").alias("n_a"), F.col(f"n{b}").alias("n_b")) for a, b in pairs]
    return found.select("feature", F.explode(F.array(*one)).alias("p")).select("p.class_a", "p.class_b", "feature", "p.ks", "p.n_a", "p.n_b").filter("n_a + n_b > 0")


def ks_kde(features: DataFrame, classes: list[str], bandwidth: float, points: int = 512) -> DataFrame:
    """ks_sweep at one bandwidth."""
    return ks_sweep(features, classes, [bandwidth], points).drop("bandwidth")


def ks_sweep(features: DataFrame, classes: list[str], bandwidths: list[float], points: int = 512) -> DataFrame:
    """The same between smoothed distributions: Gaussian kernels (bandwidth times the class's standard deviation) on a grid, cumulated and scaled to 1.

    A row a bandwidth, for every two classes and each feature. Where a class is constant or alone the plain statistic stands in.
    """
    pos = {c: k for k, c in enumerate(classes)}
    by = features.filter(F.col("mts_class").isin(classes))
    # Equal values are one, with their number: of rounded values there are only so many.
    told = by.groupBy("feature", "mts_class", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("feature", "mts_class").agg(F.collect_list(F.struct("value", "n")).alias("v"))
    sums = told.join(by.groupBy("feature", "mts_class").agg(F.stddev_samp("value").alias("sd")), ["feature", "mts_class"])
    a = sums.select("feature", F.col("mts_class").alias("class_a"), F.col("v").alias("va"), F.col("sd").alias("sa"))
    b = sums.select("feature", F.col("mts_class").alias("class_b"), F.col("v").alias("vb"), F.col("sd").alias("sb"))
    order = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in pos.items() for x in kv]), F.col(c))
    widths = F.explode(F.array(*[F.lit(float(w)) for w in bandwidths]))
    both = a.join(b, "feature").filter(order("class_a") < order("class_b")).withColumn("bandwidth", widths)
    keys = ["class_a", "class_b", "feature", "bandwidth"]
    both = both.repartition(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)  # few rows and much work
    lo, hi = F.least(F.array_min("va")["value"], F.array_min("vb")["value"]), F.greatest(F.array_max("va")["value"], F.array_max("vb")["value"])
    grid = both.filter((F.col("sa") > 1e-12) & (F.col("sb") > 1e-12)).withColumn("g", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: lo + (hi - lo) * k / (points - 1))))
    kernel = lambda v, sd: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x["n"] * F.exp(-0.5 * F.pow((F.col("g") - x["value"]) / (F.col("bandwidth") * F.col(sd)), 2)))
    d = grid.select(*keys, "g", kernel("va", "sa").alias("da"), kernel("vb", "sb").alias("db"))
    run, whole = Window.partitionBy(*keys).orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*keys)
    gap = F.abs(F.try_divide(F.sum("da").over(run), F.sum("da").over(whole)) - F.try_divide(F.sum("db").over(run), F.sum("db").over(whole)))
    smooth = d.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.max("gap").alias("smooth"))
    plain = ks_between(features, classes).withColumn("bandwidth", widths)
    return plain.join(smooth, keys, "left").select(*keys, F.coalesce("smooth", "ks").alias("ks"), "n_a", "n_b")
