"""Sources and sinks of multivariate time series: mts(dataset_id, mts_class, instance, t, proc, x)."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MTS = "dataset_id string, mts_class string, instance int, t int, proc int, x double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_embeddings(emb: DataFrame, channels: int = 8) -> DataFrame:
    """Vectors of a label, by id, in groups of `channels`: a group is an instance, an element's place is its time. Full groups only."""
    by = Window.partitionBy("label")
    k = F.row_number().over(by.orderBy("vec_id")) - 1
    placed = emb.select("label", "embedding", k.alias("k"), F.count(F.lit(1)).over(by).alias("n"))
    inst = F.floor(F.col("k") / channels).cast("int")
    full = placed.select(F.col("label").cast("string").alias("mts_class"), inst.alias("instance"), (F.col("k") % channels).cast("int").alias("proc"), "embedding", "n").filter((F.col("instance") + 1) * channels <= F.col("n"))
    return full.select(F.concat_ws("_", "mts_class", F.col("instance").cast("string")).alias("dataset_id"), "mts_class", "instance", "proc", F.posexplode("embedding").alias("t", "e")).select("dataset_id", "mts_class", "instance", "t", "proc", F.col("e").cast("double").alias("x"))


def dense_cells(cells: DataFrame, t: str, proc: str, x: str) -> DataFrame:
    """(t, proc, x) with every hour and process between the first and last; missing cells are 0."""
    summed = cells.groupBy(t, proc).agg(F.sum(x).alias("x"))
    span = summed.agg(F.min(t).alias("a"), F.max(t).alias("b")).select(F.explode(F.sequence("a", "b")).alias(t))
    procs = summed.select(proc).distinct()
    grid = span.join(F.broadcast(procs))  # the axes of the series: its hours by its few processes
    return grid.join(summed, [t, proc], "left").select(F.col(t).cast("int").alias("t"), proc, F.coalesce("x", F.lit(0.0)).alias("x"))


def from_events(events: DataFrame) -> DataFrame:
    """Hourly sums of value by event type, types numbered in order of name."""
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600).cast("int")
    dense = dense_cells(events.select(hour.alias("h"), "event_type", "value"), "h", "event_type", "value")
    names = events.select("event_type").distinct()
    number = names.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).alias("proc"))
    return dense.join(F.broadcast(number), "event_type").select(F.lit("events").alias("dataset_id"), F.lit("events").alias("mts_class"), F.lit(0).alias("instance"), "t", "proc", "x")


def from_orders(orders: DataFrame) -> DataFrame:
    """Monthly order totals by priority."""
    d = F.col("o_orderdate")
    month = ((F.year(d) - 1970) * 12 + F.month(d) - 1).cast("int")
    cells = orders.groupBy(month.alias("t"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p")).agg(F.sum("o_totalprice").alias("x"))
    return cells.select(F.lit("orders").alias("dataset_id"), F.lit("orders").alias("mts_class"), F.lit(0).alias("instance"), (F.col("t") - F.min("t").over(Window.partitionBy(F.lit(0)))).cast("int").alias("t"), (F.col("p") - 1).alias("proc"), "x")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of (time, process) under path, as mts; the file's folder is the dataset."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(content)).astype(float)
                if a.ndim != 2:
                    raise ValueError(f"{p}: a series has two dimensions")
                n, m = a.shape
                yield pa.RecordBatch.from_arrays([pa.array([p.rsplit("/", 2)[-2]] * (n * m)), pa.array(np.repeat(np.arange(n), m), pa.int32()), pa.array(np.tile(np.arange(m), n), pa.int32()), pa.array(a.ravel())], names=["dataset_id", "t", "proc", "x"])

    return files.mapInArrow(run, "dataset_id string, t int, proc int, x double")


def read_npz_edges(spark: SparkSession, path: str) -> DataFrame:
    """Archives of one matrix per statistic, as edges."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content)) as z:
                    for name in z.files:
                        a = z[name].astype(float)
                        m = len(a)
                        yield pa.RecordBatch.from_arrays([pa.array([p.rsplit("/", 2)[-2]] * m * m), pa.array([name] * m * m), pa.array(np.repeat(np.arange(m), m), pa.int32()), pa.array(np.tile(np.arange(m), m), pa.int32()), pa.array(a.ravel())], names=["dataset_id", "spi", "i", "j", "value"])

    return files.mapInArrow(run, "dataset_id string, spi string, i int, j int, value double")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of datasets, with the folder each came from, in order of folder."""
    df = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").json(path)
    return df.withColumn("dataset_path", F.regexp_replace(F.col("_metadata.file_path"), "/meta\\.json$", "")).orderBy("dataset_path")


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """Names of a text file, first occurrences in order; blank lines and # comments are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return lines.select("pos", F.trim("line").alias("name")).filter("name <> '' and not startswith(name, '#')").groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos").select("name")


def write_series(mts: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet by class, so that class filters prune folders."""
    mts.write.mode(mode).partitionBy("mts_class").parquet(path)


def write_edges(edges: DataFrame, path: str, mode: str = "error") -> None:
    edges.write.mode(mode).partitionBy("spi").parquet(path)


def write_csv(df: DataFrame, path: str, *by: str, sep: str = ",") -> None:
    df.write.mode("overwrite").partitionBy(*by).option("header", "true").option("sep", sep).csv(path)


def decimate(mts: DataFrame, step: int) -> DataFrame:
    return mts.filter(F.col("t") % step == 0)


def crop(mts: DataFrame, first_t: int, first_proc: int, last_proc: int) -> DataFrame:
    """Burn-in and border channels dropped; what stays keeps its numbers."""
    return mts.filter((F.col("t") >= first_t) & F.col("proc").between(first_proc, last_proc))


def remaining(specs: DataFrame, finished: DataFrame, key: str = "slug") -> DataFrame:
    """Specs without a finished output."""
    return specs.join(finished.select(key).distinct(), key, "left_anti")
