"""Counts and rollups over instances. Rows: iuid, image_id, score, assigned_class, is_background, assign_source, merged_into, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleaner.operators.views import class_reviewed, in_pool, is_live, is_member


def n_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def mean6(c: str) -> Column:
    return F.round(F.avg(c), 6)


def header(rows: DataFrame) -> DataFrame:
    """Counts of all rows; children of merges count like any other."""
    bg = F.col("is_background")
    return rows.agg(
        F.count("*").alias("n_instances"), n_if(is_member()).alias("n_assigned"), n_if(F.col("assigned_class").isNull() & ~bg).alias("n_unassigned"),
        n_if(bg).alias("n_rejected"), F.countDistinct("image_id").alias("n_images"),
    )


def overview(rows: DataFrame) -> DataFrame:
    """Counts of live rows and the share that is reviewed or rejected, in percent."""
    bg, live = F.col("is_background"), is_live()
    out = rows.agg(
        F.count("*").alias("total"), n_if(~live).alias("merged_children"), n_if(live & is_member()).alias("assigned"), n_if(in_pool()).alias("unassigned"),
        n_if(live & bg).alias("rejected"), F.countDistinct(F.when(live, F.col("image_id"))).alias("images"),
        F.countDistinct(F.when(live & is_member(), F.col("image_id"))).alias("images_with_assignment"),
        n_if(live & is_member() & ~F.col("mask_reviewed")).alias("mask_unreviewed"), n_if(live & ~bg & class_reviewed()).alias("reviewed"), n_if(live).alias("live"),
    )
    return out.withColumn("pct_curated", F.when(F.col("live") > 0, F.round(100.0 * (F.col("reviewed") + F.col("rejected")) / F.col("live"), 6)).otherwise(0.0)).drop("live")


def by_class(rows: DataFrame) -> DataFrame:
    """Per class: live members, images, mean score and a map of its assignment sources to their counts."""
    src = F.coalesce("assign_source", F.lit("?"))
    total = rows.filter(is_live() & is_member()).groupBy("assigned_class").agg(
        F.count("*").alias("n"), F.countDistinct("image_id").alias("n_images"), mean6("score").alias("mean_score"),
    )
    per = rows.filter(is_live() & is_member()).groupBy("assigned_class", src.alias("src")).agg(F.count("*").alias("k")).groupBy("assigned_class").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", "k")))).alias("sources")
    )
    return total.join(per, "assigned_class")


def histogram(rows: DataFrame, column: str, low: Column, high: Column, bins: int) -> DataFrame:
    """(bin, n) of values in [low, high]; bins are half-open but the last, values outside are dropped, empty bins appear with 0."""
    spark, x = rows.sparkSession, F.col(column)
    at = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).alias("bin")
    counts = rows.filter((x >= low) & (x <= high) & (high > low)).groupBy(at).agg(F.count("*").alias("n"))
    return spark.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def count_of_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n_instances")).groupBy("n_instances").agg(F.count("*").alias("n_images"))


def cooccurrence(rows: DataFrame, top: int = 12) -> DataFrame:
    """Images that hold both classes, over the `top` largest classes; the diagonal counts a class's images.

    Pairs arise per image among at most `top` classes, never among rows.
    """
    members = rows.filter(is_live() & is_member())
    big = members.groupBy("assigned_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "assigned_class").limit(top).select("assigned_class")
    has = members.join(F.broadcast(big), "assigned_class").groupBy("image_id").agg(F.sort_array(F.collect_set("assigned_class")).alias("cs"))
    return has.select(F.explode("cs").alias("class_a"), "cs").select("class_a", F.explode("cs").alias("class_b")).groupBy("class_a", "class_b").agg(F.count("*").alias("n_images"))


def partition_summary(rows: DataFrame) -> DataFrame:
    """Per pid over live rows that aren't rejected: size, mean score, purity and entropy of its classes, the majority class (the first seen wins ties)."""
    live = rows.filter(is_live() & ~F.col("is_background"))
    per = live.groupBy("pid", "assigned_class").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.min("iuid").alias("first"))
    named = F.col("assigned_class").isNotNull()
    total = per.groupBy("pid").agg(
        F.sum("n").alias("size"), F.sum("s").alias("sum_score"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("n_assigned"),
        F.max(F.when(named, F.struct("n", -F.col("first"), "assigned_class"))).alias("top"), F.collect_list(F.when(named, F.col("n"))).alias("ns"),
    )
    share = lambda x: x / F.col("n_assigned")
    entropy = F.aggregate("ns", F.lit(0.0), lambda a, x: a - share(x) * F.log(share(x) + 1e-12))
    return total.select(
        "pid", "size", F.round(F.col("sum_score") / F.col("size"), 6).alias("mean_score"), "n_assigned", F.col("top.assigned_class").alias("majority_class"),
        F.round(F.when(F.col("n_assigned") > 0, F.col("top.n") / F.col("n_assigned")).otherwise(0.0), 6).alias("purity"),
        F.round(F.when(F.col("n_assigned") > 0, entropy).otherwise(0.0), 6).alias("entropy"),
        F.round((F.col("size") - F.col("n_assigned")) / F.col("size"), 6).alias("frac_unassigned"),
    )


def partition_view(rows: DataFrame) -> DataFrame:
    """One row per class, then one per pid of the pool, with size and mean score."""
    agg = (F.count("*").alias("size"), mean6("score").alias("mean_score"))
    classes = rows.filter(is_live() & is_member()).groupBy(F.concat(F.lit("class:"), "assigned_class").alias("pid")).agg(*agg).withColumn("kind", F.lit("class"))
    return classes.unionByName(rows.filter(in_pool()).groupBy(F.col("pid").cast("string").alias("pid")).agg(*agg).withColumn("kind", F.lit("part")))


def image_counts(rows: DataFrame, pid: int | None = None, top: int | None = None) -> DataFrame:
    """Per image: members (of a partition, if given), all rows, and whether every live row is finished; the `top` largest, or all."""
    member = is_live() & (F.col("pid") == pid if pid is not None else F.lit(True))
    done = ~is_live() | F.col("is_background") | (class_reviewed() & F.col("mask_reviewed"))
    out = rows.groupBy("image_id").agg(n_if(member).alias("n"), F.count("*").alias("n_all"), F.every(F.coalesce(done, F.lit(False))).alias("final")).filter("n > 0")
    return out.orderBy(F.desc("n"), "image_id").limit(top) if top else out


def final_marks(rows: DataFrame) -> DataFrame:
    """Per class: finished when every live member is class- and mask-reviewed."""
    return rows.filter(is_live() & is_member()).groupBy("assigned_class").agg(
        F.every(class_reviewed() & F.col("mask_reviewed")).alias("final"), n_if(class_reviewed() & F.col("mask_reviewed")).alias("n_ok"), F.count("*").alias("n")
    )


def taxonomy_rollup(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Live members by concept and class with subtotals (null class) and the grand total (both null); classes without members appear with 0."""
    n = rows.filter(is_live() & is_member()).groupBy(F.col("assigned_class").alias("class_id")).agg(F.count("*").alias("n"))
    return classes.filter("not temp").join(n, "class_id", "left").rollup("concept", "class_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def taxonomy_tree(rows: DataFrame, classes: DataFrame, concepts: DataFrame) -> DataFrame:
    """Live members by superclass, concept and class, with subtotals (null below) and the total; temporary classes form a branch of their own.

    classes(class_id, concept, is_temp), concepts(concept_id, superclass) are the taxonomy's lists.
    """
    n = rows.filter(is_live() & is_member()).groupBy(F.col("assigned_class").alias("class_id")).agg(F.count("*").alias("n"))
    temp = F.coalesce("is_temp", F.lit(False))
    level = lambda c: F.when(temp, "temp").otherwise(F.coalesce(c, F.lit("?"))).alias(c)
    leaves = classes.join(concepts.select(F.col("concept_id").alias("concept"), "superclass"), "concept", "left").join(n, "class_id", "left")
    return leaves.select(level("superclass"), level("concept"), "class_id", F.coalesce("n", F.lit(0)).alias("n")).rollup("superclass", "concept", "class_id").agg(F.sum("n").alias("n"))


def project_card(rows: DataFrame, classes: DataFrame) -> DataFrame:
    live, bg = is_live(), F.col("is_background")
    card = rows.agg(n_if(live).alias("n_instances"), F.countDistinct("image_id").alias("n_images"), n_if(live & (bg | class_reviewed())).alias("n_done"))
    return card.withColumn("pct_curated", F.when(F.col("n_instances") > 0, F.round(100.0 * F.col("n_done") / F.col("n_instances"), 6)).otherwise(0.0)).crossJoin(
        classes.filter("not temp").agg(F.count("*").alias("n_classes"))  # one row each
    )


def busiest_images(rows: DataFrame, top: int) -> DataFrame:
    """The `top` images with most rows, with their rank."""
    few = rows.groupBy("image_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "image_id").limit(top)
    return few.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "image_id")))  # of `top` rows


def method_of(provenance: str, refined: Column, source: Column) -> Column:
    """How an instance's mask came about: drawn by hand, added by hand, picked, made by a model, else its batch's source; from the provenance JSON."""
    get = lambda path: F.get_json_object(provenance, path)
    has = lambda path: get(path).isNotNull() & ~get(path).isin("", "false", "0", "null")
    drawn = F.coalesce(F.array_contains(F.json_object_keys(provenance), "draw"), F.lit(False)) & F.coalesce(refined, F.lit(False))
    return F.coalesce(F.when(drawn, "hand-drawn"), F.when(has("$.manual"), "manual"), get("$.box_pick.by[0]"), F.when(has("$.remask.backend"), get("$.remask.backend")), source)


def batch_live(rows: DataFrame, ingests: DataFrame) -> DataFrame:
    """Per registered ingest (repeats count once): its batches' rows that are still in the pool; ingests(ingest_id, ts, batch_ids)."""
    once = ingests.dropDuplicates(["ingest_id"]).select("ingest_id", F.explode_outer(F.array_distinct("batch_ids")).alias("batch_id"))
    pool = rows.filter(in_pool()).groupBy("batch_id").agg(F.count("*").alias("n"))
    return once.join(pool, "batch_id", "left").groupBy("ingest_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pool"))
