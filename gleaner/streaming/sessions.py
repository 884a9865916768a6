"""Activity sessions by keyed event-time timers.

A key's open sessions are its state. Ordered events extend them and reset the
inactivity timer; when it expires, behind the watermark, the final start, end
and counts are emitted. The same state function serves an unbounded stream and,
through a staged stream that ends with a flush mark, a bounded table.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from gleaner.session import drop_path, scratch_dir

SPAN = ["start_ms", "end_ms", "n_ops", "n_instances", "ops"]
SESSION = "actor string, bucket long, start_ms long, end_ms long, n_ops long, n_instances long, ops string"
STATE = "starts array<long>, ends array<long>, n_ops array<long>, n_instances array<long>, ops array<string>"
DAY_MS = 86_400_000


def _add(a: str, b: str) -> str:
    """The sum of two JSON objects of counts."""
    return json.dumps(Counter(json.loads(a)) + Counter(json.loads(b)), sort_keys=True)


def _merge(spans: list[list], gap_ms: int) -> list[list]:
    """Join spans [start, end, n_ops, n_instances, ops] that lie no further than gap_ms apart, in order of time."""
    out: list[list] = []
    for s in sorted(spans, key=lambda s: (s[0], s[1])):
        if out and s[0] - out[-1][1] <= gap_ms:
            last = out[-1]
            last[1] = max(last[1], s[1])
            last[2] += s[2]
            last[3] += s[3]
            last[4] = _add(last[4], s[4])
        else:
            out.append(s)
    return out


def _timer(gap_ms: int):
    def update(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spans = [list(s) for s in zip(*state.get)] if state.exists else []
        if not state.hasTimedOut:
            for pdf in chunks:
                pdf = pdf[~pdf["flush"]]
                spans += [list(s) for s in zip(*(pdf[c].tolist() for c in SPAN))]
        spans, passed = _merge(spans, gap_ms), state.getCurrentWatermarkMs()
        # an event may still come at the watermark, so a session is final when its timer lies before it
        n = sum(s[1] + gap_ms < passed for s in spans)
        done, held = spans[:n], spans[n:]
        if held:
            state.update(tuple(list(c) for c in zip(*held)))
            state.setTimeoutTimestamp(held[0][1] + gap_ms + 1)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame([(*key, *s) for s in done], columns=["actor", "bucket", *SPAN])

    return update


def sessionize_stream(spans: DataFrame, gap_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Sessions of a stream of (actor, bucket, start_ms, end_ms, n_ops, n_instances, ops, flush), each emitted once and final.

    An event is a span with start = end, n_ops 1 and ops {"its op": 1}. Sessions
    are per (actor, bucket); a constant bucket gives them per actor. Events more
    than `delay` behind the latest may be dropped, as event-time timers require;
    within it, order doesn't matter. The bounded form below drops none.
    """
    timed = spans.withColumn("event_time", F.timestamp_millis("start_ms")).withWatermark("event_time", delay)
    return timed.groupBy("actor", "bucket").applyInPandasWithState(_timer(gap_ms), SESSION, STATE, "append", "EventTimeTimeout")


def spans_of(events: DataFrame, gap_ms: int, bucket_ms: int) -> DataFrame:
    """Events folded to one span per actor and stretch of gap_ms, all of which any session holds whole.

    At most bucket_ms / gap_ms + 1 spans of an actor share a bucket, however many
    events it has; counts are summed map-side.
    """
    rows = events.filter(F.col("ts_ms").isNotNull()).select(
        F.coalesce("actor", F.lit("")).alias("actor"), "ts_ms", F.coalesce("op", F.lit("")).alias("op"), F.coalesce(F.col("n_instances").cast("long"), F.lit(0)).alias("n_instances"),
        F.floor(F.col("ts_ms") / bucket_ms).alias("bucket"), F.floor(F.pmod("ts_ms", F.lit(bucket_ms)) / max(gap_ms, 1)).alias("slot"),
    )
    per_op = rows.groupBy("actor", "bucket", "slot", "op").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n"), F.sum("n_instances").alias("n_instances")
    )
    return per_op.groupBy("actor", "bucket", "slot").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n").alias("n_ops"), F.sum("n_instances").alias("n_instances"),
        F.to_json(F.map_from_entries(F.collect_list(F.struct("op", "n")))).alias("ops"),
    ).select("actor", "bucket", *SPAN, F.lit(False).alias("flush"))


def _stitch(parts: DataFrame, gap_ms: int, bucket_ms: int) -> DataFrame:
    """Join an actor's sessions across the borders of its time buckets.

    Only sessions that reach within gap_ms of a border take part: at most two a
    bucket, so a hot actor's window holds few rows.
    """
    low = F.col("bucket") * bucket_ms
    near = (F.col("start_ms") - low <= gap_ms) | (low + bucket_ms - F.col("end_ms") <= gap_ms)
    w = W.partitionBy("actor").orderBy("start_ms", "end_ms")
    counts = F.from_json("ops", "map<string,long>")
    edge = (
        parts.filter(near)
        .withColumn("opens", (F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms).cast("int"))
        .withColumn("run", F.sum(F.coalesce("opens", F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("actor", "run")
        .agg(
            F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_ops").alias("n_ops"),
            F.sum("n_instances").alias("n_instances"), F.collect_list(counts).alias("maps"),
        )
        .withColumn(
            "ops",
            F.aggregate("maps", F.expr("cast(map() as map<string,bigint>)"), lambda acc, m: F.map_zip_with(acc, m, lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))),
        )
    )
    cols = ["actor", "start_ms", "end_ms", "n_ops", "n_instances", "ops"]
    return parts.filter(~near).withColumn("ops", counts).select(cols).unionByName(edge.select(cols))


def sessionize(events: DataFrame, gap_ms: int = 1_800_000, bucket_ms: int = DAY_MS) -> DataFrame:
    """Sessions of a bounded table of (actor, ts_ms, op, n_instances); further columns are ignored.

    Rows: actor, start_ms, end_ms, duration_ms, n_ops, n_instances, ops
    (MAP op -> count). A gap of more than gap_ms splits; a gap of just gap_ms
    doesn't. A null actor is one actor, ''. Rows without ts_ms are skipped, a
    null op counts as '', null n_instances as 0, ties in time are one instant,
    an empty table gives no sessions.

    Events fold to spans first, which are staged in the shared folder keyed by
    (actor, time bucket), so that an actor with a third of all rows spreads over
    tasks, and stream through the timers with a closing flush mark that expires
    every timer.
    """
    spark = events.sparkSession
    staged, sink, log = (scratch_dir(spark, f"sessions-{x}") for x in ("in", "out", "log"))
    rows = spans_of(events, gap_ms, bucket_ms)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    rows.write.parquet(staged)
    first, last = (t or 0 for t in spark.read.schema(schema).parquet(staged).agg(F.min("start_ms"), F.max("end_ms")).first())
    shift = max(0, DAY_MS - first)  # times at and before 1970 would be late from the start
    mark = last + 2 * gap_ms + 60_000
    spark.createDataFrame([("", -1, mark, mark, 0, 0, "{}", True)], schema).coalesce(1).write.mode("append").parquet(staged)
    moved = lambda d, by: d.withColumn("start_ms", F.col("start_ms") + by).withColumn("end_ms", F.col("end_ms") + by)
    query = (
        sessionize_stream(moved(spark.readStream.schema(schema).parquet(staged), shift), gap_ms)
        .writeStream.format("parquet").option("path", sink).option("checkpointLocation", log)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    for path in (staged, log):
        drop_path(spark, path)
    parts = moved(spark.read.schema(SESSION).parquet(sink), -shift)
    return _stitch(parts, gap_ms, bucket_ms).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
