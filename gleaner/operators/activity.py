"""Analytics over the command log. Rows: seq, ts_us, op, actor, n_instances, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The coarse category of each operation; any other is its own.
CATEGORIES = {
    "assign": "assign", "import": "assign", "new_class": "class", "remove": "unassign", "background": "reject", "unreject": "unreject",
    "merge": "merge", "merge_classes": "merge", "dedup": "dedup", "split": "split",
    "refine": "refine", "refine_partition": "refine", "refine_many": "refine", "auto_refine": "refine", "revert_refine": "refine",
    "undo": "undo/redo", "redo": "undo/redo",
}


def category(op: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, op), op)


def op_mix(log: DataFrame) -> DataFrame:
    return log.groupBy("op", category(F.col("op")).alias("category")).agg(F.count("*").alias("n"), F.coalesce(F.sum("n_instances"), F.lit(0)).alias("n_instances"))


def totals(log: DataFrame) -> DataFrame:
    is_undo = F.col("op").isin("undo", "redo")
    return log.agg(
        F.count_if(~is_undo).alias("n_commands"), F.count_if(F.col("op") == "undo").alias("n_undo"), F.coalesce(F.sum(F.when(~is_undo, F.col("n_instances"))), F.lit(0)).alias("n_instances"),
        F.countDistinct("actor").alias("n_actors"), F.coalesce(F.max("ts_us") - F.min("ts_us"), F.lit(0)).alias("span_us"),
    )


def timeline(log: DataFrame, bins: int = 24, others: DataFrame | None = None) -> DataFrame:
    """(bin, n, n_instances) over equal stretches of the whole span; undo, redo and the times ts_us of `others` widen the span but aren't counted."""
    times = log.select("ts_us") if others is None else log.select("ts_us").unionByName(others.select("ts_us"))
    span = times.filter("ts_us > 0").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))  # one row
    at = F.least(F.lit(bins - 1), F.floor((F.col("ts_us") - F.col("t0")) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1)) * bins)).alias("bin")
    counts = log.filter("ts_us > 0 and op not in ('undo', 'redo')").crossJoin(F.broadcast(span)).groupBy(at).agg(F.count("*").alias("n"), F.sum("n_instances").alias("n_instances"))
    return log.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").na.fill(0)


def running(log: DataFrame, buckets_us: int = 86_400_000_000) -> DataFrame:
    """(seq, cumulative): the number of commands up to each, by time.

    Counts per time bucket are summed first, so the ordered window over single
    commands never leaves its bucket.
    """
    at = F.floor(F.col("ts_us") / buckets_us)
    rows = log.filter("op not in ('undo', 'redo')").withColumn("bucket", at)
    per = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(W.orderBy("bucket")) - F.col("n")).drop("n")  # one row per bucket
    own = F.row_number().over(W.partitionBy("bucket").orderBy("ts_us", "seq"))
    return rows.withColumn("own", own).join(before, "bucket").select("seq", (F.col("before") + F.col("own")).alias("cumulative"))


def accept_rate(log: DataFrame, accepts: Column, decides: Column) -> DataFrame:
    """(actor, seq, running_rate): each actor's share of accepted decisions so far."""
    w = W.partitionBy("actor").orderBy("ts_us", "seq").rowsBetween(W.unboundedPreceding, 0)
    rows = log.filter(decides)
    return rows.select("actor", "seq", F.round(F.avg(accepts.cast("double")).over(w), 6).alias("running_rate"))


def regressions(runs: DataFrame, metric: str, by: str) -> DataFrame:
    """Rows plus `regressed`: the metric lies below the best of the earlier rows of its `by`."""
    w = W.partitionBy(by).orderBy("ts_us", "seq").rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("regressed", F.coalesce(F.col(metric) < F.max(metric).over(w), F.lit(False)))


def conflicts(log: DataFrame, target: str) -> DataFrame:
    """Commands on a target that another actor touched later, so that undoing them is refused.

    The later actors are read off the target's ordered rows: a command conflicts
    unless all rows after it are its actor's.
    """
    w = W.partitionBy(target).orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    later = (F.min("actor").over(w), F.max("actor").over(w))
    return log.withColumn("refused", F.coalesce((later[0] != F.col("actor")) | (later[1] != F.col("actor")), F.lit(False)))


def actor_sessions(log: DataFrame, gap_us: int) -> DataFrame:
    """Sessions by lag and running sum, for logs already keyed and clean: actor, start_us, end_us, n_ops."""
    w = W.partitionBy("actor").orderBy("ts_us", "seq")
    opens = F.coalesce((F.col("ts_us") - F.lag("ts_us").over(w) > gap_us).cast("int"), F.lit(1))
    runs = log.filter("ts_us > 0").withColumn("opens", opens).withColumn("run", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("actor", "run").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n_ops")).drop("run")


def tail(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("ts_us"), F.desc("seq")).limit(n)
