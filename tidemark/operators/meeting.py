"""How a dataset's channels meet: rows of pairs of channels at equal times, without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Times that stay together: a shorter series is in one task, a longer one is dealt in such runs.
RUN = 65_536


def together(mts: DataFrame, left: dict[str, str], right: dict[str, str], directed: bool = False) -> DataFrame:
    """(dataset_id, t, i, j, columns of left and right by their new names) for channels i < j, or all i <> j, at equal times.

    All channels of a time are gathered in a row, which then gives its pairs. Rows are dealt once, by dataset and run of
    times, so an aggregate by pair sums in the task where pairs are made and sends a row a pair and run.
    """
    columns = list(dict.fromkeys([*left, *right]))
    dealt = mts.select("dataset_id", F.floor(F.col("t") / RUN).alias("run"), "t", "proc", *columns).repartition("dataset_id", "run")
    # Structs one by one in a list: a row a time.
    rows = dealt.groupBy("dataset_id", "run", "t").agg(F.collect_list(F.struct("proc", *columns)).alias("all"))
    made = rows.select("dataset_id", "t", "all", F.explode("all").alias("a")).select("dataset_id", "t", "a", F.explode("all").alias("b"))
    made = made.filter(F.col("a.proc") != F.col("b.proc") if directed else F.col("a.proc") < F.col("b.proc"))
    return made.select("dataset_id", "t", F.col("a.proc").alias("i"), F.col("b.proc").alias("j"), *[F.col(f"a.`{c}`").alias(n) for c, n in left.items()], *[F.col(f"b.`{c}`").alias(n) for c, n in right.items()])
