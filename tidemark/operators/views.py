"""Plot data: heat maps, scaled series, scatters of two statistics, densities by class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank, pearson, zscore
from .edges import lower, upper
from .learn import color_range, color_scale


def finite_only(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose columns are all numbers: not null, NaN or infinite."""
    out = df
    for c in cols:
        out = out.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out


def heat_maps(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """edges with each matrix's range (values that aren't finite left out) and the kind of its colour scale. labels(spi, labels)."""
    by = Window.partitionBy("dataset_id", "spi")
    real = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    out = edges.withColumn("low", F.min(real).over(by)).withColumn("high", F.max(real).over(by))
    out = out.join(F.broadcast(labels.select("spi", "labels")), "spi", "left") if labels is not None else out.withColumn("labels", F.array().cast("array<string>"))
    return out.withColumn("scale", color_scale(F.col("spi"), F.coalesce("labels", F.array().cast("array<string>")), F.col("low"), F.col("high"))).drop("labels")


def color_ranges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(dataset_id, spi, vmin, vmax, center, scale) of each matrix; labels(spi, labels) of a profile, a row a statistic."""
    real = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    spans = edges.groupBy("dataset_id", "spi").agg(F.min(real).alias("low"), F.max(real).alias("high")).join(labels.select("spi", "labels"), "spi", "left")
    return spans.select("dataset_id", "spi", color_range(F.col("spi"), F.col("labels"), F.col("low"), F.col("high")).alias("c")).select("dataset_id", "spi", "c.*")


def scaled_series(mts: DataFrame, robust: bool = False) -> DataFrame:
    """z-scores with bounds -2 and 2; or, for heavy tails, values about the median by the interquartile range, with symmetric bounds from the 0.1 and 99.9 percentiles."""
    if not robust:
        return mts.withColumn("x", zscore("x", "dataset_id", "proc")).withColumn("bound", F.lit(2.0))
    by = Window.partitionBy("dataset_id", "proc")
    middle, spread = F.percentile("x", 0.5).over(by), F.percentile("x", 0.75).over(by) - F.percentile("x", 0.25).over(by)
    out = mts.withColumn("x", F.coalesce(F.try_divide(F.col("x") - middle, F.nullif(spread, F.lit(0.0))), F.lit(0.0)))
    bound = out.groupBy("dataset_id").agg(F.greatest(F.abs(F.percentile("x", 0.001)), F.abs(F.percentile("x", 0.999))).alias("bound"))
    return out.join(bound, "dataset_id")


def scatter(edges: DataFrame, sizes: DataFrame, a: str, b: str, directed: list[str]) -> DataFrame:
    """Points of two statistics, and their Spearman correlation, for each direction: (dataset_id, way, k, x, y, rho).

    Without a directed one the upper triangles alone (way 'both'); else also the lower triangles, where an undirected
    statistic gives its upper ones. Points with a value that isn't finite are left out before ranks are taken.
    """
    up, low = (t.select("dataset_id", "spi", "k", "value") for t in (upper(edges, sizes), lower(edges)))
    one = lambda t, spi, name: t.filter(F.col("spi") == spi).select("dataset_id", "k", F.col("value").alias(name))
    way = "ij" if a in directed or b in directed else "both"
    out = one(up, a, "x").join(one(up, b, "y"), ["dataset_id", "k"]).withColumn("way", F.lit(way))
    if way == "ij":
        other = one(low if a in directed else up, a, "x").join(one(low if b in directed else up, b, "y"), ["dataset_id", "k"])
        out = out.unionByName(other.withColumn("way", F.lit("ji")))
    keys = ["dataset_id", "way"]
    kept = finite_only(out, "x", "y").withColumn("rx", average_rank("x", *keys)).withColumn("ry", average_rank("y", *keys))
    rho = kept.groupBy(*keys).agg(F.coalesce(pearson("rx", "ry"), F.lit(0.0)).alias("rho"))
    return kept.join(rho, keys).select(*keys, "k", "x", "y", "rho")


def densities(features: DataFrame, bins: int = 20, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """(mts_class, feature, bin, n, share) of feature values by class, bins from low to high; values beyond count in the last ones."""
    width = (high - low) / bins
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("value") - low) / width)))
    n = finite_only(features, "value").groupBy("mts_class", "feature", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("mts_class", "feature")))
