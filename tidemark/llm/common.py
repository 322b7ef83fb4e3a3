"""What the corpus operators share: table reading, scratch tables, worker paths."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of an Arrow batch at most: a worker holds some copies of one.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
#: Written tables by owner, so that an owner can remove what it no longer reads.
_SCRATCH: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they share the driver's file system, and bound their batches.

    On a cluster ship the package with --py-files; the extra path does no harm there.
    """
    for name, most in _BATCH.items():
        now = re.fullmatch(r"([0-9]+)b?", spark.conf.get(name))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and Spark is local too (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or f"/tmp/tidemark-scratch-{os.getuid()}"


def written(df: DataFrame, owner: str = "op") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark/{owner}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.setdefault(owner, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, owner: str) -> None:
    """Remove the owner's written tables; call it when nothing reads them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _SCRATCH.pop(owner, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def blocks_for(df: DataFrame, c: str, target_bytes: int, least: int = 1) -> int:
    """How many blocks of about target_bytes the text column c needs; one native pass."""
    total = df.agg(F.sum(F.octet_length(F.coalesce(F.col(c), F.lit("")))).alias("b")).first()["b"] or 0
    return max(least, -(-int(total) // target_bytes))


def keep_owners(docs: DataFrame, groups: DataFrame, key: Column, id_col: str, owner: str) -> DataFrame:
    """The rows of docs in no group, and one of each group: a row with its __tm_low as id.

    groups: __tm_key (matches `key`), __tm_root (the group), __tm_low, __tm_ties (rows of the group with that id).
    """
    groups = written(groups, owner)
    found = groups.agg(F.count("*").alias("n"), F.max("__tm_ties").alias("ties")).first()
    joined = docs.withColumn("__tm_at", key).join(bounded(groups, found["n"]), F.col("__tm_at") == F.col("__tm_key"), "left")
    alone, owns = F.col("__tm_root").isNull(), F.col("__tm_low").eqNullSafe(F.col(id_col).cast("long"))
    kept = joined.filter(alone | owns & (F.col("__tm_ties") == 1)).select(*docs.columns)
    if (found["ties"] or 0) > 1:
        tied = joined.filter(~alone & owns & (F.col("__tm_ties") > 1)).dropDuplicates(["__tm_root"])
        kept = kept.unionByName(tied.select(*docs.columns))
    return kept


def even_keys(spark: SparkSession, n: int, h: Column, most: int = 4096) -> Column:
    """A block number for a 64-bit hash; up to `most` blocks, numbers that a hash partitioning into n deals out one each."""
    if not 1 < n <= most:
        return F.pmod(h, F.lit(n))
    found = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("k")).orderBy("p").collect()  # at most n rows
    keys = [r["k"] for r in found]
    keys += [k for k in range(40 * n, 41 * n) if len(keys) < n][: n - len(keys)]
    return F.element_at(F.array(*map(F.lit, keys)), (F.pmod(h, F.lit(n)) + 1).cast("int")).cast("long")


def bounded(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast where its counted rows (of a few numbers each) are few enough; else a join shuffles it."""
    return F.broadcast(df) if rows <= most else df
