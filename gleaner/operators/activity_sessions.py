"""Sessions of the command history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.columns import epoch_ms
from gleaner.sources.tables import table
from gleaner.streaming.sessions import sessionize

GAP_MS = 1_800_000


def history_events(history: DataFrame) -> DataFrame:
    """History commands, each (actor, cmd_id, op) once, at its earliest valid time.

    Null actors are the actor ''. Rows without a valid time are left out; rows
    with a null cmd_id or op share the key of their nulls. n_instances is that
    of the earliest row (the largest, if several have that time).
    """
    return (
        history.select(
            F.coalesce("actor", F.lit("")).alias("actor"), "cmd_id", "op",
            F.coalesce("n_instances", F.lit(0)).cast("long").alias("n_instances"), epoch_ms("ts").alias("ts_ms"),
        )
        .filter(F.col("ts_ms").isNotNull())
        .groupBy("actor", "cmd_id", "op")
        .agg(F.min(F.struct(F.col("ts_ms"), (-F.col("n_instances")).alias("minus"))).alias("first"))
        .select("actor", "op", F.col("first.ts_ms").alias("ts_ms"), (-F.col("first.minus")).alias("n_instances"))
    )


def history_sessions(spark: SparkSession, root: str) -> DataFrame:
    return sessionize(history_events(table(spark, root, "history")), GAP_MS)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return history_sessions(spark, root).select("actor", "start_ms", "end_ms", "n_ops")


def p1_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Every session with its duration, its instances and its operations as text (op:count, by name)."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries("ops")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return history_sessions(spark, root).withColumn("ops", text)


_RUNS = """
WITH v AS (
  SELECT coalesce(actor, '') AS actor, cmd_id, op, coalesce(n_instances, 0) AS n,
    CASE WHEN ts IS NULL OR isnan(ts) OR isinf(ts) OR ts <= 0 THEN NULL
         WHEN ts < 1e11 THEN CAST(round(ts * 1000) AS BIGINT) WHEN ts < 1e14 THEN CAST(round(ts) AS BIGINT)
         WHEN ts < 1e17 THEN CAST(round(ts / 1e3) AS BIGINT) ELSE CAST(round(ts / 1e6) AS BIGINT) END AS ms
  FROM history),
k AS (SELECT * FROM v WHERE ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY actor, cmd_id, op ORDER BY ms, n DESC) = 1),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 1800000 THEN 0 ELSE 1 END AS opens FROM k WINDOW w AS (PARTITION BY actor ORDER BY ms)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY actor ORDER BY ms ROWS UNBOUNDED PRECEDING) AS run FROM g)
"""
P1_FOUND_SQL = f"{_RUNS}SELECT actor, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_ops FROM s GROUP BY actor, run"
P1_SESSIONS_SQL = f"""{_RUNS}, o AS (SELECT actor, run, coalesce(op, '') AS op, min(ms) AS lo, max(ms) AS hi, count(*) AS c, sum(n) AS n FROM s GROUP BY ALL)
SELECT actor, min(lo) AS start_ms, max(hi) AS end_ms, max(hi) - min(lo) AS duration_ms, CAST(sum(c) AS BIGINT) AS n_ops, CAST(sum(n) AS BIGINT) AS n_instances,
 string_agg(op || ':' || CAST(c AS VARCHAR), ',' ORDER BY op) AS ops FROM o GROUP BY actor, run"""
