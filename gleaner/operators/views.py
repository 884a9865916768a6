"""Row predicates and the view that composes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def is_live() -> Column:
    return F.col("merged_into").isNull()


def in_pool() -> Column:
    """Unassigned: no class, not rejected, not merged away."""
    return F.col("assigned_class").isNull() & ~F.col("is_background") & is_live()


def is_member() -> Column:
    """Class member; merged rows count."""
    return F.col("assigned_class").isNotNull() & ~F.col("is_background")


def class_reviewed() -> Column:
    return F.col("assigned_class").isNotNull() & (F.coalesce("assign_source", F.lit("?")) != "classifier")


def mask_reviewed(provenance: str = "provenance") -> Column:
    """Samples always; else reviewed by provenance, or refined by a drawing."""
    accepted = F.coalesce(F.get_json_object(provenance, "$.mask_reviewed") == "true", F.lit(False))
    drawn = F.col("refined") & F.coalesce(F.array_contains(F.json_object_keys(provenance), "draw"), F.lit(False))
    return F.coalesce(F.col("granularity") == "sample", F.lit(False)) | accepted | F.coalesce(drawn, F.lit(False))


@dataclass(frozen=True)
class View:
    """Which rows are looked at: each part that is None is open."""

    batches: tuple[str, ...] | None = None
    sources: tuple[str, ...] | None = None
    methods: tuple[str, ...] | None = None
    granularities: tuple[str, ...] | None = None
    modalities: tuple[str, ...] | None = None

    def predicate(self) -> Column:
        p = F.lit(True)
        for column, values in (("batch_id", self.batches), ("source", self.sources), ("method", self.methods), ("granularity", self.granularities), ("modality", self.modalities)):
            if values is not None:
                p = p & F.col(column).isin(*values)
        return p


def with_source(rows: DataFrame, ingests: DataFrame, default: str = "unregistered") -> DataFrame:
    """rows plus the source of their batch; `default` where the batch isn't registered. ingests holds one row per batch."""
    return rows.join(ingests.select("batch_id", "source"), "batch_id", "left").withColumn("source", F.coalesce("source", F.lit(default)))
