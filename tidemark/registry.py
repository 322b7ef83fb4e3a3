"""How queries are registered, and what their plans and SQL share: series from the given tables, pairs of channels, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.stats import digits
from .sources import series
from .sources.series import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def emb(spark: SparkSession, d: str) -> DataFrame:
    return series.from_embeddings(table(spark, d, "embeddings"))


def ev(spark: SparkSession, d: str) -> DataFrame:
    return series.from_events(table(spark, d, "events"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: digits(F.col(c)) for c in cols})


EMB = """
r0 AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
r1 AS (SELECT CAST(label AS VARCHAR) AS mts_class, CAST(k // 8 AS INTEGER) AS instance, CAST(k % 8 AS INTEGER) AS proc, embedding FROM r0 WHERE (k // 8 + 1) * 8 <= n),
mts AS (SELECT mts_class || '_' || instance AS dataset_id, mts_class, instance, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS t, proc, CAST(unnest(embedding) AS DOUBLE) AS x FROM r1)"""
EVENTS = """
c0 AS (SELECT CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INTEGER) AS t, event_type, sum(value) AS x FROM events GROUP BY ALL),
ty AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS proc FROM (SELECT DISTINCT event_type FROM events)),
ax AS (SELECT CAST(unnest(range((SELECT min(t) FROM c0), (SELECT max(t) + 1 FROM c0))) AS INTEGER) AS t),
mts AS (SELECT 'events' AS dataset_id, 'events' AS mts_class, 0 AS instance, ax.t, ty.proc, coalesce(c0.x, 0.0) AS x FROM ax CROSS JOIN ty LEFT JOIN c0 ON c0.t = ax.t AND c0.event_type = ty.event_type)"""
PAIRS = "pr AS (SELECT a.dataset_id, a.t, a.proc AS i, b.proc AS j, a.x, b.x AS y FROM mts a JOIN mts b ON a.dataset_id = b.dataset_id AND a.t = b.t AND a.proc < b.proc)"
R = "round({}, 6) + 0.0"


def pair_sql(value: str, name: str, base: str = EMB, more: str = "", of: str = "pr") -> str:
    return f"WITH {base}, {PAIRS}{more} SELECT dataset_id, '{name}' AS spi, i, j, {R.format(value)} AS value FROM {of} GROUP BY dataset_id, i, j"
