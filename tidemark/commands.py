"""The steps of a study as commands: python -m tidemark.commands run | features | select | ks.

run: the datasets of an experiment file to folders; features: folders to a feature file; select: forward selection;
ks: Kolmogorov-Smirnov tables of every two classes. Folders and files lie under paths that all executors share.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import edges as E
from .operators import learn
from .plans import grid, profiles
from .sources import files, generators, series


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description="Steps of a time-series study")
    commands = p.add_subparsers(dest="command", required=True)
    add = lambda to, *names, **kw: to.add_argument(*names, **kw)

    run = commands.add_parser("run", help="generate datasets and their statistics")
    add(run, "--experiment-config", required=True)
    add(run, "--profile", help="YAML of statistics; not needed with --mts-only")
    add(run, "--base", default=".", help="folder that the file's output folders are under")
    add(run, "--job-index", type=int, help="number of one dataset, from 1; all without it")
    add(run, "--normalise", type=int, choices=[0, 1], default=0)
    for flag in ("--list", "--count-only", "--dry-run", "--mts-only", "--skip-existing", "--parquet"):
        add(run, flag, action="store_true")

    made = commands.add_parser("features", help="matrices of dataset folders to a feature file")
    add(made, "--base", required=True)
    add(made, "--output", required=True)
    add(made, "--space", choices=["split", "mixed", "spi"], default="split", help="directed statistics as two triangles, or as whole matrices; or the edges themselves, without comparing statistics")
    add(made, "--mts-classes", help="folders, by commas; all without it")
    add(made, "--spi-subset", help="text file of statistics, one a line")
    add(made, "--skip-missing", action="store_true", help="leave out statistics that a dataset lacks")
    add(made, "--limit", type=int)
    add(made, "--recompute", action="store_true")

    select = commands.add_parser("select", help="forward selection of features")
    add(select, "--features", required=True)
    add(select, "--output", required=True)
    add(select, "--target-dim", type=int, default=12)
    add(select, "--cv-splits", type=int, default=5)
    add(select, "--estimator", choices=["rf", "logistic", "svc"], default="rf")
    add(select, "--mts-classes")

    ks = commands.add_parser("ks", help="Kolmogorov-Smirnov tables")
    add(ks, "--features", required=True)
    add(ks, "--output-dir", required=True)
    add(ks, "--mts-classes", help="by commas; all without it")
    add(ks, "--alternative", choices=["two-sided", "less", "greater"], default="two-sided")
    add(ks, "--kde", action="store_true")
    add(ks, "--kde-bandwidth", default="0.05", help="one or more, by commas")
    return p


def _listed(text: str | None) -> list[str]:
    return [x for x in (s.strip() for s in (text or "").split(",")) if x]


def _run(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    specs = grid.expand(spark, grid.read_config(a.experiment_config)).withColumn("class_dir", F.element_at(F.split("dataset_dir", "/"), -2))
    if a.count_only:
        return [str(specs.count())]
    if a.job_index is not None:
        specs = grid.spec_at(specs, a.job_index)
    root = F.concat(F.lit(a.base.rstrip("/") + "/"), F.regexp_replace("dataset_dir", "/[^/]+/[^/]+$", ""))
    specs = specs.withColumn("root", root)
    if a.skip_existing:
        for r in specs.select("root").distinct().collect():  # an output folder a config
            if os.path.isdir(r["root"]) and any(os.scandir(r["root"])):
                done = files.finished(spark, r["root"]).withColumn("root", F.lit(r["root"]))
                specs = specs.join(done, ["root", "class_dir", "dataset_slug"], "left_anti")
    rows = specs.orderBy("index").collect()  # a study's specs, as many as its config lists
    shown = [f"{r['index']}\t{r['mts_class']}\t{r['dataset_slug']}\t{r['root']}/{r['class_dir']}/{r['dataset_slug']}" for r in rows]
    if a.list or a.dry_run or not rows:
        return shown
    foreign = sorted({r["generator"] for r in rows if r["generator"] not in generators.GENERATORS})
    if foreign:
        raise ValueError(f"{', '.join(foreign)}: archives and markets are read from tables, not by this command")
    if not (a.mts_only or a.profile):
        raise ValueError("a profile is needed, or --mts-only")
    specs = spark.createDataFrame(rows, specs.schema)  # fixed before anything is written
    mts = generators.of_grid(specs)
    chosen = profiles.read_profile(a.profile) if a.profile and not a.mts_only else []
    none = spark.createDataFrame([], "dataset_id string, spi string, i int, j int, value double")
    edges = profiles.compute_profile(mts, chosen, bool(a.normalise)) if chosen else none
    about = F.struct("mts_class", F.col("instance").alias("instance_index"), "labels", "variant", "seed", "generator", "params")
    meta = specs.select(F.col("slug").alias("dataset_id"), "root", "class_dir", "dataset_slug", F.to_json(about).alias("meta"))
    for r in meta.select("root").distinct().collect():
        own = meta.filter(F.col("root") == r["root"]).drop("root")
        mine = mts.join(own.select("dataset_id"), "dataset_id", "left_semi")
        files.write_datasets(mine, edges, own, r["root"], [s.name for s in chosen if s.directed]).collect()
        if a.parquet and chosen:
            edges.join(own.select("dataset_id"), "dataset_id", "left_semi").write.mode("overwrite").partitionBy("dataset_id").parquet(f"{r['root']}/calc.parquet")
    return shown


def features_of(edges: DataFrame, space: str) -> DataFrame:
    """(dataset_id, mts_class, spi_a, spi_b, rho) of samples' edges; in the space 'spi' spi_b is a place in spi_a's vector and rho its value."""
    sizes = edges.groupBy("dataset_id").agg((F.max("i") + 1).alias("m"))
    off = edges.filter("i <> j").select("dataset_id", "spi", "i", "j", "value")
    directed = [r["spi"] for r in edges.filter("directed").select("spi").distinct().collect()]  # of the catalogue
    if space == "spi":
        if sizes.select("m").distinct().limit(2).count() > 1:
            raise ValueError("datasets of different sizes have no edges in common")
        f = E.raw_features(off, sizes, directed).select("dataset_id", F.col("spi").alias("spi_a"), F.format_string("%06d", "k").alias("spi_b"), F.col("z").cast("double").alias("rho"))
    else:
        f = E.spi_features(E.edge_vectors(off, sizes, directed)) if space == "split" else E.mixed_features(off, sizes, directed)
    return f.join(edges.select("dataset_id", "mts_class").distinct(), "dataset_id")


def _features(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    path = files.cache_path(a.output, a.space, a.spi_subset)
    if os.path.exists(path) and not a.recompute:
        return [path]
    subset = [r["name"] for r in series.read_subset(spark, a.spi_subset).collect()] if a.spi_subset else None  # a short list of names
    _, edges = files.samples(spark, a.base, classes=_listed(a.mts_classes) or None, subset=subset, silent=a.skip_missing, limit=a.limit)
    files.write_features(features_of(edges, a.space), path)
    return [path]


def _labelled(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    """Features of the classes asked for, and these in order; one that the file lacks is an error."""
    f = files.read_features(spark, a.features)
    if f is None:
        raise FileNotFoundError(a.features)
    there = [r["mts_class"] for r in f.select("mts_class").distinct().orderBy("mts_class").collect()]
    wanted = _listed(a.mts_classes) or there
    if missing := [c for c in wanted if c not in there]:
        raise ValueError(f"no datasets of {', '.join(missing)}")
    return f.filter(F.col("mts_class").isin(wanted)), wanted


def _select(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    f, _ = _labelled(spark, a)
    chosen = learn.forward_selection(f, a.target_dim, a.cv_splits, a.estimator)
    files.write_selection(chosen, a.output, estimator=a.estimator, mode="forward", target=a.target_dim, folds=a.cv_splits)
    return [f"{name}\t{score:.6f}" for name, score in chosen]


def _ks(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    f, classes = _labelled(spark, a)
    if len(classes) < 2:
        raise ValueError("two classes at least")
    widths = [float(x) for x in _listed(a.kde_bandwidth)]
    if a.kde and a.alternative != "two-sided":
        raise ValueError("smoothed distributions are compared two-sided")
    if a.kde:
        parts = [E.ks_kde(f, classes, w).withColumn("bw", F.lit(w)) for w in widths]
        table = parts[0]
        for p in parts[1:]:
            table = table.unionByName(p)
    else:
        table = E.ks_between(f, classes, a.alternative)
    files.write_ks(table, a.output_dir)
    return [f"{x} and {y}" for x, y in combinations(classes, 2)]


COMMANDS = {"run": _run, "features": _features, "select": _select, "ks": _ks}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command and returns the lines that it printed."""
    args = parser().parse_args(argv)
    lines = COMMANDS[args.command](spark or SparkSession.builder.appName("tidemark").getOrCreate(), args)
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
