"""A study's files: dataset folders with series, matrices and metadata; features; results; archives and markets.

A dataset's folder is <base>/<class>/<dataset> with timeseries.npy, spi_mpis.npz, calc.csv and meta.json. Folders are written
by the tasks that hold the datasets, so the base must be a path that all executors share. For large studies the
Parquet sinks of `series` are the better form; this is the exchange format of small tools.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import time
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import market_key
from ..functions.stats import process_number, slugify

PARTS = ("timeseries.npy", "spi_mpis.npz", "calc.csv", "meta.json")


# ---- dataset folders ----------------------------------------------------------------


def write_datasets(mts: DataFrame, edges: DataFrame, meta: DataFrame, base: str, directed: Sequence[str] = ()) -> DataFrame:
    """One folder a dataset; returns (dataset_id, path). meta(dataset_id, class_dir, dataset_slug, meta json).

    timeseries.npy holds float32 (time, process); spi_mpis.npz one matrix a statistic, undirected ones mirrored, the
    diagonal zero; calc.csv the same as a table. meta.json is written last, so a folder that has one is complete.
    """
    both = list(directed)

    def run(t: pa.Table, e: pa.Table, m: pa.Table) -> tuple[str, str]:
        row = m.to_pylist()[0]
        folder = os.path.join(base, row["class_dir"], row["dataset_slug"])
        os.makedirs(folder, exist_ok=True)
        (times, at), (procs, who) = (np.unique(t[c].to_numpy(), return_inverse=True) for c in ("t", "proc"))
        x = np.full((len(times), len(procs)), np.nan, np.float32)
        x[at, who] = t["x"].to_numpy()
        _save(os.path.join(folder, PARTS[0]), lambda f: np.save(f, x))
        n, mats = len(procs), {}
        for r in e.to_pylist():
            a = mats.setdefault(r["spi"], np.zeros((n, n)))
            a[r["i"], r["j"]] = r["value"]
            if r["spi"] not in both:
                a[r["j"], r["i"]] = r["value"]
        _save(os.path.join(folder, PARTS[1]), lambda f: np.savez_compressed(f, **mats))
        names = sorted(mats)
        head = ",".join(["", *(f"{s}:proc-{j}" for s in names for j in range(n))])
        lines = [",".join([f"proc-{i}", *(repr(float(mats[s][i, j])) for s in names for j in range(n))]) for i in range(n)]
        _save(os.path.join(folder, PARTS[2]), lambda f: f.write("\n".join([head, *lines, ""]).encode()))
        info = json.loads(row["meta"]) | {"M": n, "T": len(times), "pyspi": {"spis": [{"name": s, "directed": s in both} for s in names]}}
        _save(os.path.join(folder, PARTS[3]), lambda f: f.write(json.dumps(info, indent=2).encode()))
        return row["ident"], folder

    def group(t: pa.Table, other: pa.Table) -> pa.Table:
        e, m = other.filter(pc.is_valid(other["spi"])), other.filter(pc.is_valid(other["meta"]))
        if not t.num_rows or not m.num_rows:
            return pa.table({"dataset_id": pa.array([], pa.string()), "path": pa.array([], pa.string())})
        ident, folder = run(t, e, m)
        return pa.table({"dataset_id": [ident], "path": [folder]})

    ident = F.col("dataset_id").alias("_id")
    side = edges.select(ident, "spi", "i", "j", "value").unionByName(meta.select(ident, F.col("dataset_id").alias("ident"), "class_dir", "dataset_slug", "meta"), allowMissingColumns=True)
    return mts.select("dataset_id", "t", "proc", "x").groupBy("dataset_id").cogroup(side.groupBy("_id")).applyInArrow(group, "dataset_id string, path string")


def _plain(path: Column) -> Column:
    """One form for a local path; Spark's readers give two."""
    return F.regexp_replace(path, "^file:/+", "/")


def _save(path: str, write) -> None:
    """Under another name first, so that a lost task leaves no half file."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        write(f)
    os.replace(part, path)


def dataset_dirs(spark: SparkSession, base: str) -> DataFrame:
    """(class_dir, dataset_slug, path, meta json) of folders that have a meta.json, in order of class and dataset."""
    found = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").load(base).select(_plain(F.regexp_replace("_metadata.file_path", "/meta[.]json$", "")).alias("path"), F.col("value").alias("meta"))
    part = lambda k: F.element_at(F.split("path", "/"), F.lit(k))
    return found.select(part(-2).alias("class_dir"), part(-1).alias("dataset_slug"), "path", "meta").orderBy("class_dir", "dataset_slug")


def finished(spark: SparkSession, base: str) -> DataFrame:
    """(class_dir, dataset_slug) of folders in which all four parts are there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
    part = lambda k: F.element_at(F.split("path", "/"), F.lit(k))
    return files.filter(part(-1).isin(*PARTS)).groupBy(part(-3).alias("class_dir"), part(-2).alias("dataset_slug")).agg(F.count_distinct(part(-1)).alias("n")).filter(F.col("n") == len(PARTS)).drop("n")


def index_of(spark: SparkSession, base: str, classes: Sequence[str] | None = None, subset: Sequence[str] | None = None, silent: bool = False, limit: int | None = None) -> DataFrame:
    """Datasets with their statistics: (class_dir, dataset_slug, path, label, M, T, variant, instance, spis).

    classes: folders to read. subset: statistics, in that order; one that a dataset lacks is an error, or with
    `silent` is left out (the dataset's own order is kept, and a dataset without any goes). limit: 0 or None is none.
    """
    d = dataset_dirs(spark, base)
    if classes:
        d = d.filter(F.col("class_dir").isin(list(classes)))
    field = lambda name: F.get_json_object("meta", f"$.{name}")
    spis = F.from_json(field("pyspi.spis"), "array<struct<name:string,directed:boolean>>")
    spis = F.transform(spis, lambda s: F.struct(s["name"].alias("name"), F.coalesce(s["directed"], F.lit(False)).alias("directed")))
    variant = F.coalesce(F.when(field("variant").startswith("{"), field("variant.name")).otherwise(field("variant")), F.lit(""))
    d = d.select("class_dir", "dataset_slug", "path", field("mts_class").alias("label"), field("M").cast("int").alias("M"), field("T").cast("int").alias("T"), variant.alias("variant"), field("instance_index").cast("int").alias("instance"), spis.alias("spis"))
    if subset and silent:
        d = d.withColumn("spis", F.filter("spis", lambda s: s["name"].isin(list(subset)))).filter(F.size("spis") > 0)
    elif subset:
        first = lambda n: F.get(F.filter("spis", lambda s: s["name"] == n), F.lit(0))
        picked = F.array(*map(first, subset))
        missing = F.filter(F.array(*map(F.lit, subset)), lambda n: ~F.exists("spis", lambda s: s["name"] == n))
        fail = F.raise_error(F.concat(F.lit("missing in "), "path", F.lit(": "), F.concat_ws(", ", missing)))
        d = d.withColumn("spis", F.when(F.size(missing) > 0, fail.cast("array<struct<name:string,directed:boolean>>")).otherwise(picked))
    return d.orderBy("class_dir", "dataset_slug").limit(limit) if limit else d


def samples(spark: SparkSession, base: str, **options) -> tuple[DataFrame, DataFrame]:
    """(index, edges) of datasets that all have the same statistics in one order, with the same directions; else an error."""
    index = index_of(spark, base, **options)
    kinds = index.select(F.to_json("spis").alias("s")).distinct().limit(2).collect()
    if not kinds:
        raise RuntimeError(f"no datasets in {base}")
    if len(kinds) > 1:
        raise ValueError("datasets differ in the order or the directions of their statistics")
    wanted = index.select("path", F.col("label").alias("mts_class"), F.concat_ws("_", "class_dir", "dataset_slug").alias("dataset_id"), F.posexplode("spis").alias("pos", "s")).select("path", "mts_class", "dataset_id", "pos", F.col("s.name").alias("spi"), F.col("s.directed").alias("directed"))
    # With a limit the archives of the few datasets picked are all that is opened.
    picked = [r["path"] for r in index.select("path").collect()] if options.get("limit") else None
    return index, read_matrices(spark, base, paths=picked).join(wanted, ["path", "spi"]).select("dataset_id", "mts_class", "spi", "directed", "pos", "i", "j", "value")


def read_matrices(spark: SparkSession, base: str, square: str = "raise", paths: list[str] | None = None) -> DataFrame:
    """(path, spi, i, j, value) of all archives; a matrix that isn't square is an error, or with square='skip' left out.

    paths: folders under base; only their archives are listed and read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(base if paths is None else paths).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content)) as z:
                    for name in z.files:
                        a = z[name].astype(float)
                        if a.ndim != 2 or a.shape[0] != a.shape[1]:
                            if square == "skip":
                                continue
                            raise ValueError(f"{p}: {name} is no square matrix")
                        m = len(a)
                        cols = [pa.array([p.rsplit("/", 1)[0]] * m * m), pa.array([name] * m * m), pa.array(np.repeat(np.arange(m), m), pa.int32()), pa.array(np.tile(np.arange(m), m), pa.int32()), pa.array(a.ravel())]
                        yield pa.RecordBatch.from_arrays(cols, names=["path", "spi", "i", "j", "value"])

    return files.mapInArrow(run, "path string, spi string, i int, j int, value double").withColumn("path", _plain(F.col("path")))


def only_dataset(spark: SparkSession, pattern: str) -> str:
    """The one dataset folder that a glob fits; none or several are an error."""
    found = [r["path"] for r in dataset_dirs(spark, pattern).select("path").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{pattern} fits {'no' if not found else 'several'} datasets")
    return found[0]


# ---- features and results -----------------------------------------------------------


def write_features(features: DataFrame, path: str) -> None:
    """Feature cache: X, pairs and mts_class in one npz, datasets and features in order of name. For studies, not corpora: the driver holds X."""
    rows = features.select("dataset_id", "mts_class", "spi_a", "spi_b", "rho").toPandas()
    x = rows.pivot_table(index=["dataset_id", "mts_class"], columns=["spi_a", "spi_b"], values="rho").sort_index().sort_index(axis=1)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    _save(path, lambda f: np.savez_compressed(f, X=x.to_numpy(), pairs=np.array([list(c) for c in x.columns], dtype=str), mts_class=np.array([c for _, c in x.index], dtype=str), dataset=np.array([d for d, _ in x.index], dtype=str)))


def read_features(spark: SparkSession, path: str, recompute: bool = False) -> DataFrame | None:
    """(dataset_id, mts_class, feature, value) of a feature file; None where it isn't there or is to be made again.

    Labels are mts_class, else y; features are named by pairs, else f0, f1 and so on.
    """
    if recompute or not os.path.exists(path):
        return None
    with np.load(path, allow_pickle=False) as z:
        if "X" not in z:
            raise KeyError(f"{path} has no X")
        labels = z["mts_class"] if "mts_class" in z else z["y"] if "y" in z else None
        if labels is None:
            raise KeyError(f"{path} has neither mts_class nor y")
        x = z["X"].astype(float)
        ids = z["dataset"].tolist() if "dataset" in z else [str(k) for k in range(len(x))]
        names = ["|".join(map(str, p)) if isinstance(p, list) else str(p) for p in z["pairs"].tolist()] if "pairs" in z else [f"f{k}" for k in range(x.shape[1])]
    n, m = x.shape
    table = pa.table({"dataset_id": np.repeat(ids, m).tolist(), "mts_class": np.repeat(labels.astype(str), m).tolist(), "feature": names * n, "value": x.ravel()})
    return spark.createDataFrame(table)


def cache_path(path: str, space: str, subset: str | None) -> str:
    """Where a feature space of a subset is kept, beside the plain file."""
    stem, end = os.path.splitext(path)
    label = os.path.splitext(os.path.basename(subset))[0] if subset else None
    return "_".join([stem, space, *([label] if label else [])]) + (end or ".npz")


def write_ks(ks: DataFrame, base: str) -> None:
    """A CSV folder for each two classes, and for each bandwidth if there is a bw column; rows by statistic, largest first."""
    by = [c for c in ("bw", "class_pair") if c in [*ks.columns, "class_pair"]]
    named = ks.withColumn("class_pair", F.concat_ws("_vs_", F.array_sort(F.array("class_a", "class_b"))))
    named.repartition(*by).sortWithinPartitions(*by, F.desc("ks"), "feature").write.mode("overwrite").partitionBy(*by).option("header", "true").csv(base)


def read_ks(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.option("header", "true").option("inferSchema", "true").csv(base)


def write_selection(chosen: Sequence[tuple[str, float]], path: str, *, estimator: str, mode: str, target: int, folds: int) -> None:
    """Tab-separated selected features under a commented head."""
    head = {"timestamp": time.strftime("%Y-%m-%d %H:%M:%S"), "mode": mode, "estimator": estimator, "target_dim": target, "cv_splits": folds, "selected_features": len(chosen)}
    lines = [f"# {k}: {v}" for k, v in head.items()] + ["# index\tspi_a\tspi_b"]
    lines += ["\t".join([str(k), *feature.split("|", 1)]) for k, (feature, _) in enumerate(chosen)]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    _save(path, lambda f: f.write("\n".join([*lines, ""]).encode()))


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("comment", "#").schema("index int, spi_a string, spi_b string").csv(path)


# ---- archives and markets -----------------------------------------------------------


def sample_seed(name: str, label: str, instance: int, base_seed: int) -> int:
    """A seed for the pick of a sample: eight bytes of BLAKE2s of the parts joined by bars, reduced."""
    n = int.from_bytes(hashlib.blake2s(f"{name}|{label}|{instance}|{base_seed}".encode(), digest_size=8).digest(), "big") % (2**32 - 1)
    return n or 1


def archive_sample(archive: DataFrame, name: str, label: str, instance: int = 0, base_seed: int = 0, standardise: bool = False) -> DataFrame:
    """mts of one sample of a class, picked by seed from archive(sample, class_label, t, proc, x); values that aren't finite become 0."""
    ids = [r["sample"] for r in archive.filter(F.col("class_label").cast("string") == str(label)).select("sample").distinct().orderBy("sample").collect()]  # samples of one class
    if not ids:
        raise ValueError(f"{name} has no sample of class {label}")
    pick = ids[int(np.random.default_rng(sample_seed(name, str(label), instance, base_seed)).choice(len(ids)))]
    one = archive.filter(F.col("sample") == pick).select("t", "proc", F.col("x").cast("double").alias("x"))
    ident = F.concat(F.lit(f"{name}_I{instance}_class"), slugify(F.lit(str(label))))
    return one.select(ident.alias("dataset_id"), F.lit(str(label)).alias("mts_class"), F.lit(instance).alias("instance"), "t", "proc", finite_zscore("x", "proc") if standardise else finite(F.col("x")).alias("x"))


def finite(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def finite_zscore(x: str, *keys: str) -> Column:
    """z-score over the values that are numbers; the others, and constant channels, become 0."""
    w = Window.partitionBy(*keys)
    real = F.when(~F.isnan(x), F.col(x))
    return finite(F.try_divide(real - F.avg(real).over(w), F.stddev_pop(real).over(w))).alias("x")


def universe(spark: SparkSession, tickers: Sequence[str] = (), market: str | None = None, markets: DataFrame | None = None) -> list[str]:
    """Upper-case names of both sources, each once, in order. markets(market, ticker) is a small table of constituents."""
    out = {t.upper() for t in tickers if t}
    if market:
        key = spark.range(1).select(market_key(F.lit(market)).alias("k")).first()["k"]
        rows = markets.filter(market_key(F.col("market")) == key).select(F.upper("ticker")).collect() if markets is not None else []
        if not rows:
            raise ValueError(f"unknown market {market}")
        out |= {r[0] for r in rows}
    if not out:
        raise ValueError("no tickers")
    return sorted(out)


def market_sample(prices: DataFrame, names: list[str], m: int, instance: int = 0, base_seed: int = 0, market: str | None = None, standardise: bool = False) -> DataFrame:
    """mts of the closes of m names drawn by seed without replacement, from prices(day, ticker, close); days on which one is missing go."""
    rng = np.random.default_rng(sample_seed(market or "yfinance", "tickers", instance, base_seed))
    chosen = [str(x) for x in rng.choice(names, size=min(m, len(names)), replace=False)]
    kept = prices.filter(F.upper("ticker").isin(chosen) & F.col("close").isNotNull() & ~F.isnan(F.col("close").cast("double")))
    cells = kept.groupBy("day", F.upper("ticker").alias("ticker")).agg(F.first("close").cast("double").alias("x"))
    whole = cells.groupBy("day").agg(F.count("*").alias("n")).filter(F.col("n") == len(chosen)).select("day")
    if whole.isEmpty():
        raise ValueError("no day has closes of all names")
    number = F.element_at(F.create_map(*[F.lit(x) for kv in ((c, k) for k, c in enumerate(sorted(chosen))) for x in kv]), F.col("ticker"))
    days = whole.select("day", (F.row_number().over(Window.orderBy("day")) - 1).alias("t"))  # one row a trading day
    out = cells.join(days, "day").select(F.lit("_".join(sorted(chosen)) + f"_I{instance}").alias("dataset_id"), F.lit(market or "tickers").alias("mts_class"), F.lit(instance).alias("instance"), "t", number.alias("proc"), "x")
    return out.withColumn("x", finite_zscore("x", "proc")) if standardise else out


def in_process_order(df: DataFrame) -> DataFrame:
    """Columns proc-0, proc-1 .. by number, malformed ones first; others before them."""
    kinds = df.sparkSession.createDataFrame([(c,) for c in df.columns], "c string").select("c", process_number(F.col("c")).alias("n"), F.col("c").startswith("proc-").alias("p")).collect()
    return df.select(*[F.col(f"`{r['c']}`") for r in sorted(kinds, key=lambda r: (r["p"], r["n"]))])

