"""Which images may be released, and what their rules find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.operators.stats import n_if
from gleaner.operators.views import in_pool, is_live, is_member


def composition(rows: DataFrame) -> DataFrame:
    """Per image over live rows: assigned, unassigned, rejected."""
    live = rows.filter(is_live())
    return live.groupBy("image_id").agg(n_if(is_member()).alias("assigned"), n_if(in_pool()).alias("unassigned"), n_if(F.col("is_background")).alias("rejected"))


def candidates(rows: DataFrame) -> DataFrame:
    """Images with nothing unassigned and more than one assigned."""
    return composition(rows).filter("unassigned = 0 and assigned > 1")


def held(rows: DataFrame, gate: Column, policy: str) -> DataFrame:
    """Images that a policy (off, exclude_rejected, accepted_only) holds back, among those with a live row that isn't rejected."""
    images = composition(rows).filter("assigned + unassigned > 0").select("image_id", F.coalesce(gate, F.lit("pending")).alias("gate"))
    rule = {"exclude_rejected": F.col("gate") == "rejected", "accepted_only": F.col("gate") != "accepted"}.get(policy, F.lit(False))
    return images.filter(rule)


def part_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(image_id, if_class, missing) where an image has a rule's class but lacks one that it demands."""
    has = rows.filter(is_live() & is_member()).select("image_id", F.col("assigned_class").alias("c")).distinct()
    wants = has.join(F.broadcast(rules), has["c"] == rules["if_class"]).select("image_id", "if_class", F.col("then_class").alias("missing"))
    return wants.join(has.select("image_id", F.col("c").alias("missing")), ["image_id", "missing"], "left_anti").select("image_id", "if_class", "missing").distinct()
