"""Sinks that partition, metadata, and the tumbling window as a stream."""

import json

from pyspark.sql import functions as F

from tidemark.sources import series
from tidemark.streaming import windows


def test_series_edges_and_tables_are_written_by_partition(spark, tmp_path):
    mts = spark.createDataFrame([("a_0", "a", 0, t, p, float(t + p)) for t in range(3) for p in range(2)] + [("b_0", "b", 0, 0, 0, 1.0)], series.MTS)
    series.write_series(mts, f"{tmp_path}/mts")
    back = spark.read.parquet(f"{tmp_path}/mts")
    assert sorted(map(tuple, back.select(*mts.columns).collect())) == sorted(map(tuple, mts.collect()))
    plan = back.filter("mts_class = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mts_class" in plan
    edges = spark.createDataFrame([("a_0", s, 0, 1, v) for s, v in (("cov", 1.5), ("dtw", 2.5))], "dataset_id string, spi string, i int, j int, value double")
    series.write_edges(edges, f"{tmp_path}/edges")
    assert {p.name for p in (tmp_path / "edges").iterdir() if p.is_dir()} == {"spi=cov", "spi=dtw"}
    series.write_csv(edges, f"{tmp_path}/csv", "spi", sep="\t")
    text = spark.read.option("header", "true").option("sep", "\t").option("inferSchema", "true").csv(f"{tmp_path}/csv")
    assert sorted(map(tuple, text.select("spi", "value").collect())) == [("cov", 1.5), ("dtw", 2.5)]


def test_metadata_come_with_their_folders(spark, tmp_path):
    for name in ("z", "a"):
        (tmp_path / "C" / name).mkdir(parents=True)
        (tmp_path / "C" / name / "meta.json").write_text(json.dumps({"name": name, "M": 4}, indent=1))
    got = series.read_meta(spark, str(tmp_path)).select("name", "M", "dataset_path").collect()
    assert [(r.name, r.M) for r in got] == [("a", 4), ("z", 4)] and got[0].dataset_path.endswith("/C/a")


def test_tumbling_sums_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    fixed = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert fixed(spark.table("tumbled")) == fixed(windows.tumbling(events))
