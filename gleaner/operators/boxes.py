"""Box geometry, overlap joins and duplicate suppression. Boxes: iuid, image_id, x0, y0, x1, y1, area, score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleaner.operators.components import connected_components
from gleaner.operators.skew import keyed_join
from gleaner.session import drop_scratch, materialize

#: Images of more boxes aren't compared box by box, but meet in tiles.
CROWDED = 256


def intersection() -> Column:
    """Common area of boxes a and b."""
    side = lambda d: F.greatest(F.least(f"a.{d}1", f"b.{d}1") - F.greatest(f"a.{d}0", f"b.{d}0"), F.lit(0))
    return (side("x") * side("y")).cast("double")


def iou() -> Column:
    i = intersection()
    return i / (F.col("a.area") + F.col("b.area") - i + 1e-6)


def overlapping_pairs(boxes: DataFrame, reach: float = 0.0) -> DataFrame:
    """Pairs (structs a, b; a.iuid < b.iuid) of one image's boxes that share some area, or lie within `reach` of it on both axes.

    Each box is at home on the grid whose tiles are as wide as it is, and visits
    the coarser grids on which other boxes are at home: a few tiles each, whatever
    its size. A pair meets on the coarser box's grid and counts in the one tile
    that holds the corner of its intersection, so no image, however crowded, is
    joined with itself whole. Empty boxes meet nothing.
    """
    cols, pad = [c for c in boxes.columns if c != "image_id"], reach / 2
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * pad
    some = boxes.filter("x1 > x0 and y1 > y0").withColumn("__level", F.greatest(F.ceil(F.log2(side.cast("double"))), F.lit(0)).cast("int"))
    levels = sorted(r[0] for r in some.select("__level").distinct().collect())  # at most one for each power of two
    tile = F.pow(F.lit(2.0), F.col("level"))
    tiles = lambda d: F.sequence(F.floor((F.col(f"{d}0") - pad) / tile), F.floor((F.col(f"{d}1") + pad) / tile))
    at = some.select("image_id", F.struct(*cols).alias("r"), "__level", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]).cast("array<int>"), lambda v: v >= F.col("__level"))).alias("level"), "x0", "x1", "y0", "y1")
    at = at.select("image_id", "r", "level", (F.col("level") == F.col("__level")).alias("home"), F.explode(tiles("x")).alias("tx"), tiles("y").alias("tys")).select("image_id", "r", "level", "home", "tx", F.explode("tys").alias("ty"))
    a, b = at.select("*").withColumnRenamed("r", "a").withColumnRenamed("home", "ha"), at.filter("home").withColumnRenamed("r", "b").drop("home")
    low = lambda d: F.greatest(f"a.{d}0", f"b.{d}0") - pad
    corner = lambda d: F.floor(low(d) / tile)
    high = lambda d: F.least(f"a.{d}1", f"b.{d}1") + pad
    # two boxes at home on one grid meet twice; one of the meetings counts
    once = ~F.col("ha") | (F.col("a.iuid") < F.col("b.iuid"))
    near = (high("x") > low("x")) & (high("y") > low("y"))
    met = a.join(b, ["image_id", "level", "tx", "ty"]).filter((F.col("a.iuid") != F.col("b.iuid")) & once & near & (corner("x") == F.col("tx")) & (corner("y") == F.col("ty")))
    first = F.col("a.iuid") < F.col("b.iuid")
    return met.select("image_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """Number of pairs within each image, without making them."""
    return rows.groupBy("image_id").agg(F.count("*").alias("n")).select("image_id", F.expr("n * (n - 1) div 2").alias("n_pairs")).filter("n_pairs > 0")


def gap(width: float, height: float) -> Column:
    """Distance between boxes a and b, as a share of the mean side of the image."""
    off = lambda d: F.greatest(F.lit(0), F.col(f"b.{d}0") - F.col(f"a.{d}1"), F.col(f"a.{d}0") - F.col(f"b.{d}1")).cast("double")
    return F.sqrt(off("x") * off("x") + off("y") * off("y")) / ((width + height) / 2)


def pair_features(boxes: DataFrame, width: float = 128.0, height: float = 128.0, reach: float = 16.0) -> DataFrame:
    """Geometry of pairs that overlap or lie within `reach`: IoU, gap, centre distance, class agreement, score and area statistics."""
    centre = lambda s, d, n: (F.col(f"{s}.{d}0") + F.col(f"{s}.{d}1")) / 2 / n
    dx, dy = centre("a", "x", width) - centre("b", "x", width), centre("a", "y", height) - centre("b", "y", height)
    r6 = lambda c, n: F.round(c, 6).alias(n)
    ratio = F.least(F.greatest(F.greatest("a.area", "b.area") / (F.least("a.area", "b.area") + 1e-6), F.lit(1.0)), F.lit(50.0))
    same = F.coalesce((F.col("a.assigned_class") == F.col("b.assigned_class")).cast("int"), F.lit(0))
    return overlapping_pairs(boxes, reach).select(
        "image_id", F.col("a.iuid").alias("iuid_a"), F.col("b.iuid").alias("iuid_b"), r6(iou(), "box_iou"), r6(gap(width, height), "gap"), r6(F.sqrt(dx * dx + dy * dy), "centroid_dist"),
        same.alias("class_agree"), r6(F.least("a.score", "b.score"), "score_min"), r6((F.col("a.score") + F.col("b.score")) / 2, "score_mean"), r6(ratio, "area_ratio"),
        r6(iou() + F.exp(-F.sqrt(dx * dx + dy * dy) / 0.05), "confusability"),
    )


def hard_negatives(pairs: DataFrame, positive: Column, most: int = 4_000, hard: float = 0.8) -> DataFrame:
    """(iuid_a, iuid_b) of pairs(iuid_a, iuid_b, confusability) that aren't positive: at most `most` and ten for each positive, the `hard` share of them by confusability, the rest by hash."""
    n_pos = pairs.filter(positive).count()
    take = min(most, 10 * n_pos)
    n_hard = int(hard * take)
    rest = pairs.filter(~positive).select("iuid_a", "iuid_b", "confusability")
    top = rest.orderBy(F.desc("confusability"), "iuid_a", "iuid_b").limit(n_hard)
    key = F.md5(F.concat_ws("#", F.col("iuid_a").cast("string"), F.col("iuid_b").cast("string")).cast("binary"))
    more = rest.join(top.select("iuid_a", "iuid_b"), ["iuid_a", "iuid_b"], "left_anti").orderBy(key, "iuid_a", "iuid_b").limit(take - n_hard)
    return top.unionByName(more).select("iuid_a", "iuid_b")


def greedy_match(links: DataFrame) -> DataFrame:
    """(entry, target) one to one: entries in order of their key each take their best target that is left; links(entry, key, target, score).

    Equal scores go to the smaller target. An entry that is the first at all its
    targets is settled, so rounds are as many as entries wait for each other.
    """
    left = materialize(links.select("entry", "key", "target", "score"), "matching")
    out: DataFrame | None = None
    while not left.isEmpty():
        first = left.groupBy("target").agg(F.min(F.struct("key", "entry")).alias("first"))
        marked = left.join(first, "target").withColumn("mine", F.col("first.entry") == F.col("entry"))
        done = marked.groupBy("entry").agg(F.every("mine").alias("free"), F.min(F.struct((-F.col("score")).alias("far"), "target")).alias("best")).filter("free")
        pairs = materialize(done.select("entry", F.col("best.target").alias("target")), "matched")
        out = pairs if out is None else out.unionByName(pairs)
        now = materialize(left.join(pairs.select("entry"), "entry", "left_anti").join(pairs.select("target"), "target", "left_anti"), "matching")
        drop_scratch(left.sparkSession, left)
        left = now
    return links.select("entry", "target").limit(0) if out is None else out


def best_match(links: DataFrame) -> DataFrame:
    """(entry, target) one to one by falling score of links(entry, target, score): each round takes the pairs that are best on both sides."""
    left = materialize(links.select("entry", "target", "score"), "matching")
    out: DataFrame | None = None
    while not left.isEmpty():
        rank = F.struct((-F.col("score")).alias("far"), "entry", "target")
        by_entry = left.groupBy("entry").agg(F.min(rank).alias("e"))
        by_target = left.groupBy("target").agg(F.min(rank).alias("t"))
        pairs = materialize(by_entry.join(by_target, by_entry["e"] == by_target["t"]).select("entry", "target"), "matched")
        out = pairs if out is None else out.unionByName(pairs)
        now = materialize(left.join(pairs.select("entry"), "entry", "left_anti").join(pairs.select("target"), "target", "left_anti"), "matching")
        drop_scratch(left.sparkSession, left)
        left = now
    return links.select("entry", "target").limit(0) if out is None else out


def overlap_groups(boxes: DataFrame, least: float) -> DataFrame:
    """(iuid, group_iuid, prob): components of boxes with IoU >= least; prob is the group's largest IoU."""
    links = materialize(overlapping_pairs(boxes).select(F.col("a.iuid").alias("a"), F.col("b.iuid").alias("b"), iou().alias("iou")).filter(F.col("iou") >= least), "overlaps")
    member = connected_components(links, "a", "b")
    best = links.join(member, links["a"] == member["node"]).groupBy("component").agg(F.round(F.max("iou"), 6).alias("prob"))
    return member.join(best, "component").select(F.col("node").alias("iuid"), F.col("component").alias("group_iuid"), "prob")


def suppress(boxes: DataFrame, links: DataFrame, order: list[Column]) -> DataFrame:
    """Ids dropped by greedy suppression over links(a, b): in `order`, a box is kept unless linked to a kept one.

    Each round keeps every box that precedes all its undecided neighbours and
    drops their neighbours, which gives the greedy result without walking any
    image in one task. Returns (iuid, keep_iuid), the first box that drops it.
    """
    rank = F.struct(*order)
    key = boxes.select("iuid", rank.alias("key"))
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = materialize(
        both.join(key.select(F.col("iuid").alias("u"), F.col("key").alias("ku")), "u").join(key.select(F.col("iuid").alias("v"), F.col("key").alias("kv")), "v"), "edges"
    )
    dropped: DataFrame | None = None
    everything = edges
    while not edges.isEmpty():
        kept = edges.groupBy("u").agg(F.min("kv").alias("near"), F.first("ku").alias("ku")).filter("ku < near").select(F.col("u").alias("k"))
        gone = materialize(edges.join(kept, edges["v"] == kept["k"]).select(F.col("u").alias("gone")).distinct(), "gone")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        done = gone.withColumnRenamed("gone", "x").unionByName(kept.withColumnRenamed("k", "x"))
        edges = materialize(
            edges.join(done.withColumnRenamed("x", "u"), "u", "left_anti").join(done.withColumnRenamed("x", "v"), "v", "left_anti").select("u", "v", "ku", "kv"), "edges"
        )
    if dropped is None:
        return everything.select(F.col("u").alias("iuid"), F.col("v").alias("keep_iuid"))
    by = everything.join(dropped.withColumnRenamed("gone", "u"), "u").join(dropped.withColumnRenamed("gone", "v"), "v", "left_anti").filter("kv < ku")
    return by.groupBy(F.col("u").alias("iuid")).agg(F.min_by("v", "kv").alias("keep_iuid"))


def nms(boxes: DataFrame, least: float) -> DataFrame:
    """The boxes kept when, by falling score (then area, then id), a box is dropped if its IoU with a kept one is >= least."""
    links = overlapping_pairs(boxes).filter(iou() >= least).select(F.col("a.iuid").alias("a"), F.col("b.iuid").alias("b"))
    return boxes.join(suppress(boxes, links, by_score()), "iuid", "left_anti")


def by_score() -> list[Column]:
    return [(-F.col("score")).alias("s"), (-F.col("area")).alias("r"), F.col("iuid").alias("i")]


def scope_duplicates(boxes: DataFrame, least: float, in_scope: Column, same_class: bool = False) -> DataFrame:
    """(iuid, keep_iuid) of in-scope duplicates by overlap: the common area's share of the smaller box, if that is at least a quarter of the larger.

    Reviewed boxes out of scope go first and only suppress, then reviewed boxes,
    then falling score and area; other boxes out of scope take no part.
    """
    takes = boxes.withColumn("in_scope", F.coalesce(in_scope, F.lit(False))).filter(F.col("in_scope") | F.col("mask_reviewed"))
    small, large = F.least("a.area", "b.area"), F.greatest("a.area", "b.area")
    share = F.when(small >= 0.25 * large, intersection() / F.greatest(small, F.lit(1.0))).otherwise(0.0)
    agree = F.coalesce(F.col("a.assigned_class") == F.col("b.assigned_class"), F.lit(False)) if same_class else F.lit(True)
    links = overlapping_pairs(takes).filter((share >= least) & agree & (F.col("a.in_scope") | F.col("b.in_scope"))).select(F.col("a.iuid").alias("a"), F.col("b.iuid").alias("b"))
    out = suppress(takes, links, [F.col("in_scope").cast("int").alias("o"), (~F.col("mask_reviewed")).cast("int").alias("m"), *by_score()])
    return out.join(takes.filter("in_scope").select("iuid"), "iuid", "left_semi")


def merge_representatives(boxes: DataFrame, groups: DataFrame) -> DataFrame:
    """(iuid, merged_into): each group(iuid, group_iuid) collapses into its best-scored box (smaller id wins ties), whose merged_into is null."""
    rows = boxes.select("iuid", "score").join(groups.select("iuid", "group_iuid"), "iuid")
    rep = rows.groupBy("group_iuid").agg(F.min_by("iuid", F.struct(-F.col("score"), F.col("iuid"))).alias("rep"))
    return rows.join(rep, "group_iuid").select("iuid", F.when(F.col("iuid") != F.col("rep"), F.col("rep")).alias("merged_into"))


def agreement(boxes: DataFrame, least: float = 0.8) -> DataFrame:
    """Per box: the number of distinct sources, its own included, whose boxes agree with it by IoU >= least."""
    p = overlapping_pairs(boxes).filter(iou() >= least)
    return support(boxes, p.select(F.col("a.iuid").alias("a"), F.col("b.iuid").alias("b"), F.col("a.assign_source").alias("sa"), F.col("b.assign_source").alias("sb")))


def support(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(iuid, agree): each box's number of distinct sources over itself and its partners in pairs(a, b, sa, sb)."""
    votes = pairs.select(F.col("a").alias("iuid"), F.col("sb").alias("by")).unionByName(pairs.select(F.col("b").alias("iuid"), F.col("sa").alias("by")))
    own = boxes.select("iuid", F.col("assign_source").alias("by"))
    return own.unionByName(votes).groupBy("iuid").agg(F.countDistinct("by").alias("agree"))


def padded(d: str, pad: float, size: float) -> tuple[Column, Column]:
    """Both ends of a box on an axis, moved out by `pad`, within the image."""
    return F.greatest(F.col(f"{d}0") - pad, F.lit(0.0)), F.least(F.col(f"{d}1") + pad, F.lit(float(size)))


def box_groups(rows: DataFrame, *key: str) -> DataFrame:
    """Live rows, not rejected, by their source box: (key, n_members, n_agree, todo_class, done); done is one reviewed member left, n_agree its distinct sources."""
    some = rows.filter(F.col("merged_into").isNull() & ~F.col("is_background"))
    return some.groupBy(*key).agg(
        F.count("*").alias("n_members"), F.countDistinct("assign_source").alias("n_agree"), F.min("assigned_class").alias("todo_class"), ((F.count("*") == 1) & F.every("mask_reviewed")).alias("done")
    )


def box_choices(rows: DataFrame, *key: str, same: float = 0.95, agree: float = 0.8) -> DataFrame:
    """(key, iuid, agree, fit, rank): the distinct members on offer for each source box, the best guess first.

    A member is as good as the number of distinct sources with a member that
    agrees with it (IoU >= agree), then as its IoU with the group's box (its first
    member's), then its id. Members nearly the same (IoU >= same) as a better one are left out.
    """
    some = rows.filter(F.col("merged_into").isNull() & ~F.col("is_background"))
    named = some.withColumn("__key", F.to_json(F.struct(*key)))
    pairs = materialize(overlapping_pairs(named).filter((F.col("a.__key") == F.col("b.__key"))).select(F.col("a.iuid").alias("a"), F.col("b.iuid").alias("b"), F.col("a.assign_source").alias("sa"), F.col("b.assign_source").alias("sb"), iou().alias("iou")), "choices")
    close = pairs.filter(F.col("iou") >= agree)
    votes = close.select(F.col("a").alias("iuid"), F.col("sb").alias("by")).unionByName(close.select(F.col("b").alias("iuid"), F.col("sa").alias("by"))).unionByName(some.select("iuid", F.col("assign_source").alias("by")))
    support = votes.groupBy("iuid").agg(F.countDistinct("by").alias("agree"))
    first = some.groupBy(*key).agg(F.min("iuid").alias("head"))
    fit = pairs.select(F.col("a").alias("head"), F.col("b").alias("iuid"), "iou")
    scored = some.select(*key, "iuid").join(support, "iuid").join(first, list(key)).join(fit, ["head", "iuid"], "left")
    scored = scored.withColumn("fit", F.round(F.when(F.col("iuid") == F.col("head"), 1.0).otherwise(F.coalesce("iou", F.lit(0.0))), 6))
    order = [(-F.col("agree")).alias("g"), (-F.col("fit")).alias("f"), F.col("iuid").alias("i")]
    gone = suppress(scored, pairs.filter(F.col("iou") >= same).select("a", "b"), order)
    kept = scored.join(gone.select("iuid"), "iuid", "left_anti")
    return kept.select(*key, "iuid", "agree", "fit", F.expr(f"row_number() over (partition by {', '.join(key)} order by agree desc, fit desc, iuid)").alias("rank"))


def dedup_current(rows: DataFrame, least: float) -> DataFrame:
    """rows with the live ones that suppression drops rejected; their class stays."""
    dropped = suppress(rows, overlapping_pairs(rows.filter("merged_into is null")).filter(iou() >= least).select(F.col("a.iuid").alias("a"), F.col("b.iuid").alias("b")), by_score())
    out = rows.join(dropped.select("iuid", F.lit(True).alias("__gone")).distinct(), "iuid", "left")
    return out.withColumn("is_background", F.col("is_background") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def merge_by_image(rows: DataFrame) -> DataFrame:
    """(iuid, merged_into) of a partition's rows merged into the best-scored one of their image; images with one row stay."""
    rep = rows.groupBy("image_id").agg(F.min_by("iuid", F.struct(-F.col("score"), F.col("iuid"))).alias("rep"), F.count("*").alias("n")).filter("n > 1")
    return keyed_join(rows.select("image_id", "iuid"), rep.drop("n"), "image_id").select("iuid", F.when(F.col("iuid") != F.col("rep"), F.col("rep")).alias("merged_into"))


def met_by(least: float):
    """Batches of boxes in runs of one image (hash `image`, its number of boxes `crowd`) with `met`: whether a box of the run has IoU >= least.

    A row of a crowded image counts as met, one with crowd 0 as alone. It errs to
    the side of met only: equal hashes of two images, not-a-number and null.
    """

    def meets(t: pa.RecordBatch) -> pa.RecordBatch:
        image, crowd, x0, y0, x1, y1 = (t.column(c).to_numpy(zero_copy_only=False) for c in ("image", "crowd", "x0", "y0", "x1", "y1"))
        area = t.column("area").to_numpy(zero_copy_only=False).astype(np.float64)
        met, i = crowd > CROWDED, np.flatnonzero((crowd > 0) & (crowd <= CROWDED))
        lag = 1
        while len(i := i[i + lag < len(image)]) and len(i := i[image[i] == image[i + lag]]):
            j = i + lag
            w = (np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j])).astype(np.float64)
            h = (np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j])).astype(np.float64)
            both = ~(w <= 0) & ~(h <= 0)
            common = w * h
            with np.errstate(all="ignore"):
                both &= ~(common / (area[i] + area[j] - common + 1e-6) < least - 1e-9)
            met[i[both]] = met[j[both]] = True
            lag += 1
        return pa.RecordBatch.from_arrays([*t.columns, pa.array(met)], names=[*t.schema.names, "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last image, if that isn't crowded
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.concat_batches([*held, b])
            image, ends = b.column("image").to_numpy(), b.num_rows
            if 0 < b.column("crowd")[ends - 1].as_py() <= CROWDED:
                ends = int(np.flatnonzero(np.r_[True, image[1:] != image[:-1]])[-1])
            yield meets(b.slice(0, ends))
            held = [b.slice(ends)] if ends < b.num_rows else []
        for b in held:
            yield meets(b)

    return run


def pooled_candidates(boxes: DataFrame, same: float = 0.9) -> DataFrame:
    """(image_id, iuid, agree): the candidates of several generators (assign_source), by their ranks in turn, without near copies of earlier ones, most agreed first.

    The rows go by image once, and each image's boxes are compared where they
    are; only boxes with a near copy, and those of images of more than CROWDED
    boxes, travel on to tiles and suppression.
    """
    cols = ["image_id", "iuid", "assign_source", "x0", "y0", "x1", "y1", "area"]
    # windows by image leave its rows in one run of one partition
    ranked = boxes.select(*cols, "score").withColumn("crowd", F.expr("count(*) over (partition by image_id)")).withColumn("turn", F.expr("row_number() over (partition by image_id, assign_source order by score desc, iuid)"))
    ranked = ranked.select(*cols, "turn", F.xxhash64("image_id").alias("image"), F.when(F.col("image_id").isNotNull(), F.col("crowd")).otherwise(0).alias("crowd"))
    met = F.col("met")
    screened = ranked.mapInArrow(met_by(same), T.StructType([*ranked.schema.fields]).add("met", "boolean"))
    # what only met boxes need is null for the others, so they take little space
    screened = materialize(screened.select("image_id", "iuid", "met", F.when(~met, F.col("assign_source").isNotNull().cast("long")).alias("agree"), F.when(met, F.struct(*cols[2:], "turn")).alias("box")), "screened")
    alone = screened.filter(~met & F.col("iuid").isNotNull()).select("image_id", "iuid", "agree")
    some = screened.filter(met).select("image_id", "iuid", "box.*")
    pairs = overlapping_pairs(some.drop("turn")).filter(iou() >= same)
    pairs = materialize(pairs.select(F.col("a.iuid").alias("a"), F.col("b.iuid").alias("b"), F.col("a.assign_source").alias("sa"), F.col("b.assign_source").alias("sb")), "copies")
    gone = suppress(some, pairs.select("a", "b"), [F.col("turn").alias("t"), F.col("assign_source").alias("s"), F.col("iuid").alias("i")])
    return alone.unionByName(some.select("image_id", "iuid").join(support(some, pairs), "iuid").join(gone.select("iuid"), "iuid", "left_anti").select("image_id", "iuid", "agree"))


def capped_groups(links: DataFrame, most: int | None) -> DataFrame:
    """(iuid, group): nodes of links(image_id, a, b, d) joined in order of d unless a group would exceed `most`; group is its smallest id.

    An image's links stream in order through one task, which holds the image's
    groups only; without a cap, use connected_components.
    """
    kind = dict(links.dtypes)["a"]

    def run(frames):
        image, parent, size = object(), {}, {}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def flush():
            least: dict = {}
            for x in parent:
                r = find(x)
                least[r] = min(least.get(r, x), x)
            return pd.DataFrame({"iuid": list(parent), "group": [least[find(x)] for x in parent]})

        for pdf in frames:
            for i, a, b in zip(pdf["image_id"], pdf["a"], pdf["b"]):
                if i != image:
                    if parent:
                        yield flush()
                    image, parent, size = i, {}, {}
                for x in (a, b):
                    parent.setdefault(x, x)
                    size.setdefault(x, 1)
                ra, rb = find(a), find(b)
                if ra != rb and not (most and size[ra] + size[rb] > most):
                    parent[ra] = rb
                    size[rb] += size[ra]
        if parent:
            yield flush()

    rows = links.select("image_id", "a", "b", "d").repartition("image_id").sortWithinPartitions("image_id", "d", "a", "b")
    return rows.mapInPandas(run, f"iuid {kind}, group {kind}")


def merge_candidates(pairs: DataFrame, least: float, most_size: int = 10, top: int = 20) -> DataFrame:
    """(group_iuid, size, score): components of pairs(iuid_a, iuid_b, p) with p >= least of two to `most_size` rows, scored by their weakest link; the `top` best."""
    links = materialize(pairs.filter(F.col("p") >= least).select("iuid_a", "iuid_b", "p"), "candidates")
    member = connected_components(links, "iuid_a", "iuid_b")
    weakest = links.join(member, links["iuid_a"] == member["node"]).groupBy("component").agg(F.min("p").alias("score"))
    sizes = member.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") <= most_size)
    return sizes.join(weakest, "component").orderBy(F.desc("score"), "component").limit(top).select(F.col("component").alias("group_iuid"), "size", "score")
