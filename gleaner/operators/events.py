"""Event-sourced curation state: commands fold to the current state, by batch or by stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleaner.operators.skew import keyed_join

#: What each command sets; a field that a command doesn't name keeps its value.
SETS = {
    "assign": ("assigned_class", "is_background", "assign_source"), "unassign": ("assigned_class", "assign_source"),
    "background": ("assigned_class", "is_background"), "unreject": ("assigned_class", "is_background"), "dedup": ("is_background",), "accept_masks": ("mask_reviewed",),
}
#: Fixed value: commands that an actor can take back.
DEPTH = 200


def effective(commands: DataFrame) -> DataFrame:
    """Commands that no undo cancels: an undo cancels its actor's latest command before it that isn't cancelled yet.

    Undos pair with commands like closing with opening brackets: a command
    stands if the running balance after it never falls below its own level.
    """
    w = W.partitionBy("actor").orderBy("seq")
    level = F.sum(F.when(F.col("op") == "undo", -1).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    lowest = F.min("level").over(w.rowsBetween(1, W.unboundedFollowing))
    marked = commands.withColumn("level", level).withColumn("lowest", lowest)
    return marked.filter((F.col("op") != "undo") & (F.col("lowest").isNull() | (F.col("lowest") >= F.col("level")))).drop("level", "lowest")


def replay(commands: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(seq) of the commands(seq, actor, op) in force after all undos and redos.

    Each actor has a stack of its last `depth` commands: undo takes back the
    latest in force, redo brings back the latest taken back, a new command
    forgets what was taken back, and a barrier (of anyone) empties all stacks.
    An undo or redo of nothing does nothing. An actor's commands stream in order
    through one task that holds its stacks only.
    """
    barriers = sorted(r["seq"] for r in commands.filter("op = 'barrier'").select("seq").collect())  # irreversible steps, few
    epoch = F.size(F.filter(F.array(*[F.lit(b) for b in barriers]).cast("array<long>"), lambda b: b < F.col("seq"))) if barriers else F.lit(0)
    rows = commands.filter("op != 'barrier'").select(F.coalesce(F.col("actor").cast("string"), F.lit("")).alias("actor"), epoch.alias("epoch"), F.col("seq").cast("long").alias("seq"), "op")

    def run(frames):
        at, done, taken = None, [], []
        for pdf in frames:
            out = []
            for actor, stage, seq, op in zip(pdf["actor"], pdf["epoch"], pdf["seq"], pdf["op"]):
                if (actor, stage) != at:
                    out += done
                    at, done, taken = (actor, stage), [], []
                if op == "undo":
                    taken += [done.pop()] if done else []
                elif op == "redo":
                    done += [taken.pop()] if taken else []
                else:
                    done.append(seq)
                    taken = []
                if len(done) > depth:
                    out.append(done.pop(0))
            yield pd.DataFrame({"seq": out}, dtype="int64")
        yield pd.DataFrame({"seq": done}, dtype="int64")

    keys = ["actor", "epoch"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInPandas(run, "seq long")


def fold(commands: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(iuid, assigned_class, is_background, assign_source, assign_score, mask_reviewed): each field by the last command that sets it.

    commands(seq, op, iuid, class, source, and score, if any). Fields fold one by
    one, for background clears the class and leaves the source, and dedup rejects
    without clearing. An unreject counts only on a rejected row. renames(seq,
    old, new), a class merged into another, moves the rows that have the class by then.
    """
    score = F.col("score").cast("double") if "score" in commands.columns else F.lit(None).cast("double")
    touches_bg = F.when(F.col("op").isin("background", "dedup"), True).when(F.col("op").isin("assign", "unreject"), False)
    before = W.partitionBy("iuid").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = commands.withColumn("score", score).withColumn("was", F.coalesce(F.last(touches_bg, ignorenulls=True).over(before), F.lit(False))).filter("op != 'unreject' or was")

    def last(field: str, value: Column) -> Column:
        touches = F.col("op").isin(*[op for op, fields in SETS.items() if (field if field != "assign_score" else "assign_source") in fields])
        return F.max(F.when(touches, F.struct("seq", value.alias("v")))).alias(field)

    is_assign = F.col("op") == "assign"
    out = rows.groupBy("iuid").agg(
        last("assigned_class", F.when(is_assign, F.col("class"))), last("is_background", F.col("op").isin("background", "dedup")), last("assign_source", F.when(is_assign, F.col("source"))),
        last("assign_score", F.when(is_assign, F.col("score"))), last("mask_reviewed", F.lit(True)),
    )
    name = F.col("assigned_class.v")
    if renames is not None:
        moves = renames.agg(F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("moves"))  # one row; a taxonomy's edits are few
        out = out.crossJoin(F.broadcast(moves))
        later = F.filter("moves", lambda m: m["seq"] > F.col("assigned_class.seq"))
        name = F.aggregate(later, name, lambda c, m: F.when(c == m["old"], m["new"]).otherwise(c))
    flag = lambda c: F.coalesce(F.col(f"{c}.v"), F.lit(False)).alias(c)
    return out.select("iuid", name.alias("assigned_class"), flag("is_background"), F.col("assign_source.v").alias("assign_source"), F.col("assign_score.v").alias("assign_score"), flag("mask_reviewed"))


def from_categories(rows: DataFrame, categories: DataFrame, classes: DataFrame, seq: int = 1) -> tuple[DataFrame, DataFrame]:
    """(commands, new classes) that give rows(iuid, src_category_id) without a class that of their source category, by name.

    categories(category_id, name), classes(class_id, name, coco_cat_id) are lists.
    A name that no class has becomes a class, which keeps the category's number if it is free.
    """
    used = classes.select(F.col("coco_cat_id").alias("category_id"))
    fresh = categories.join(classes.select("name"), "name", "left_anti").groupBy("name").agg(F.min("category_id").alias("category_id"))
    pins = fresh.join(used, "category_id", "left_semi").select("name", F.lit(None).cast("int").alias("coco_cat_id")).unionByName(fresh.join(used, "category_id", "left_anti").select("name", F.col("category_id").cast("int").alias("coco_cat_id")))
    made = pins.select(F.concat(F.lit("c_"), F.substring(F.md5(F.col("name").cast("binary")), 1, 12)).alias("class_id"), "name", "coco_cat_id")
    known = classes.select("class_id", "name").unionByName(made.select("class_id", "name")).groupBy("name").agg(F.min("class_id").alias("class"))
    by_id = F.broadcast(categories.join(known, "name").groupBy(F.col("category_id").alias("src_category_id")).agg(F.min("class").alias("class")))
    free = rows.filter(F.col("assigned_class").isNull() & ~F.col("is_background")).join(by_id, "src_category_id")
    return free.select(F.lit(seq).alias("seq"), F.lit("assign").alias("op"), "iuid", "class", F.lit("import").alias("source"), F.lit(None).cast("double").alias("score")), made


def gates(commands: DataFrame) -> DataFrame:
    """(image_id, gate) by the last release_set of each image; commands(seq, op, image_id, gate). An unknown gate is pending."""
    known = F.when(F.col("gate").isin("accepted", "rejected", "pending"), F.col("gate")).otherwise("pending")
    return commands.filter("op = 'release_set' and image_id is not null").groupBy("image_id").agg(F.max_by(known, "seq").alias("gate"))


def ingest(known: DataFrame, incoming: DataFrame, mode: str) -> DataFrame:
    """known with the incoming rows (same columns) that it lacks by iuid; all of them in mode `new`.

    In mode `replace` the known rows on the incoming images that nobody curated
    (no class, not rejected, not merged) are rejected. A null mode appends.
    """
    if mode == "new":
        return incoming
    fresh = new_rows(incoming, known).select(*known.columns)
    if mode == "replace":
        images = incoming.select("image_id").filter("image_id is not null").distinct().withColumn("again", F.lit(True))
        stale = F.coalesce("again", F.lit(False)) & F.col("assigned_class").isNull() & F.col("merged_into").isNull()
        known = keyed_join(known, images, "image_id", "left").withColumn("is_background", F.col("is_background") | stale).select(*known.columns)
    return known.unionByName(fresh)


def reset(rows: DataFrame) -> DataFrame:
    """rows without any curation; other columns stay."""
    empty = {"assigned_class": "string", "assign_source": "string", "assign_score": "double", "merged_into": dict(rows.dtypes).get("merged_into", "string")}
    return rows.select(*[F.lit(None).cast(empty[c]).alias(c) if c in empty else F.lit(False).alias(c) if c in ("is_background", "refined", "mask_reviewed") else F.col(c) for c in rows.columns])


def apply_delta(index: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Live counts by key after some rows changed: index(key, n) plus the changed rows' new and minus their old states."""
    signed = after.select(key, F.lit(1).alias("d")).unionByName(before.select(key, F.lit(-1).alias("d"))).filter(F.col(key).isNotNull())
    delta = signed.groupBy(key).agg(F.sum("d").alias("n"))
    return index.unionByName(delta).groupBy(key).agg(F.sum("n").alias("n")).filter("n != 0")


def new_rows(batch: DataFrame, known: DataFrame, key: str = "iuid") -> DataFrame:
    """Rows of a batch not seen before, each key once (its first by row order of the other columns)."""
    cols = [c for c in batch.columns if c != key]
    once = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*cols)).alias("r")).select(key, "r.*")
    return once.join(known.select(key), key, "left_anti")
