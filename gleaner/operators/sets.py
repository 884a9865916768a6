"""Unions, subsets and reconciliation of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.operators.skew import keyed_join


def append(known: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables' rows; their columns must have the same names and types, in any order."""
    if dict(known.dtypes) != dict(more.dtypes):
        raise ValueError(f"columns differ: {sorted(set(known.dtypes) ^ set(more.dtypes))}")
    return known.unionByName(more)


def subset(rows: DataFrame, chosen: DataFrame, key: str = "iuid") -> DataFrame:
    """Rows whose key is among the chosen ones; rows keep their repeats."""
    return rows.join(chosen.select(key).distinct(), key, "left_semi")


def align(ids: DataFrame, features: DataFrame, dims: dict[str, int]) -> DataFrame:
    """(iuid, method, vec) for every id and method of dims; a missing vector, or one of another length, is zeros, other methods are dropped.

    features(iuid, method, vec) with one row per id and method, or the least of several.
    """
    wanted = F.map_from_arrays(F.array(*[F.lit(m) for m in dims]), F.array(*[F.lit(d) for d in dims.values()]))
    every = ids.select("iuid").distinct().select("iuid", F.explode(wanted).alias("method", "dim"))
    good = features.filter(F.col("method").isin(*dims) & (F.size("vec") == F.try_element_at(wanted, F.col("method")))).groupBy("iuid", "method").agg(F.min("vec").alias("vec"))
    return every.join(good, ["iuid", "method"], "left").select("iuid", "method", F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), F.col("dim"))).alias("vec"))


def reconcile(state: DataFrame, records: DataFrame) -> DataFrame:
    """(iuid, status, merged_into) of state(iuid, merged_into) against records(iuid): kept, added (a record without state) or dropped (state without a record).

    A merged_into that points at no kept or added row becomes null.
    """
    there = records.select("iuid").distinct().withColumn("has", F.lit(True))
    both = state.select("iuid", "merged_into", F.lit(True).alias("known")).join(there, "iuid", "full_outer")
    out = both.select("iuid", F.when(F.col("known") & F.col("has"), "kept").when(F.col("has"), "added").otherwise("dropped").alias("status"), "merged_into")
    target = there.select(F.col("iuid").alias("merged_into"), F.col("iuid").alias("real"))
    return keyed_join(out, target, "merged_into", "left").select("iuid", "status", F.when(F.col("status") == "kept", F.col("real")).alias("merged_into"))


def fold_features(ids: DataFrame, held: DataFrame, late: DataFrame) -> DataFrame:
    """(iuid, vec) of every id that has one: the held vector, else the late one; vectors of other ids are dropped."""
    one = lambda d, name: d.groupBy("iuid").agg(F.min("vec").alias(name))
    out = ids.select("iuid").distinct().join(one(held, "a"), "iuid", "left").join(one(late, "b"), "iuid", "left")
    return out.select("iuid", F.coalesce("a", "b").alias("vec")).filter("vec is not null")


def minus_pairs(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a, b) that aren't among the taken ones, whichever way round."""
    way = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
    return way(pairs).join(way(taken), ["a", "b"], "left_anti")


def prunable(classes: DataFrame, seeded: DataFrame, rows: DataFrame) -> DataFrame:
    """Classes (class_id) that no seed names, no row has and that aren't temporary."""
    used = rows.filter("assigned_class is not null").select(F.col("assigned_class").alias("class_id")).distinct()
    return classes.filter(~F.coalesce("is_temp", F.lit(False))).select("class_id").join(seeded.select("class_id"), "class_id", "left_anti").join(used, "class_id", "left_anti")
