"""Lists that a user pages through: filters, orders, partitions and their members. Rows: as for stats, plus pid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.operators.views import in_pool, is_live, is_member


def filter_instances(
    rows: DataFrame, classes: list[str] | None = None, only_unassigned: bool = False, only_background: bool = False, score: tuple[float | None, float | None] = (None, None),
    image_id: int | None = None, refined: bool | None = None, is_merge_child: bool | None = None,
) -> DataFrame:
    """Rows that meet every given condition; only_unassigned ignores merges, and a null score meets no bound."""
    p: list[Column] = []
    if classes is not None:
        p.append(F.col("assigned_class").isin(*classes) & ~F.col("is_background"))
    if only_unassigned:
        p.append(F.col("assigned_class").isNull() & ~F.col("is_background"))
    if only_background:
        p.append(F.col("is_background"))
    if score[0] is not None:
        p.append(F.col("score") >= score[0])
    if score[1] is not None:
        p.append(F.col("score") <= score[1])
    if image_id is not None:
        p.append(F.col("image_id") == image_id)
    if refined is not None:
        p.append(F.col("refined") == refined)
    if is_merge_child is not None:
        p.append(F.col("merged_into").isNotNull() == is_merge_child)
    for cond in p:
        rows = rows.filter(cond)
    return rows


def order_of(by: str, desc: bool = True) -> list[Column]:
    """The order by score, area, assign_score, class or image; rows without a class go as '~', without a number as lowest, ties by id."""
    key = {"class": F.coalesce("assigned_class", F.lit("~")), "image": F.col("image_id")}.get(by, F.coalesce(by, F.lit(float("-inf"))))
    return [key.desc() if desc else key.asc(), F.asc("iuid")]


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of an ordered list; Spark keeps offset + limit rows a partition."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def partition_page(view: DataFrame, kind: str = "all", text: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of stats.partition_view, classes first, largest first; kind is all, part or class, text a part of the pid."""
    rows = view if kind == "all" else view.filter(F.col("kind") == kind)
    if text:
        rows = rows.filter(F.lower("pid").contains(text.lower()))
    return page(rows, [F.asc("kind"), F.desc("size"), F.asc("pid")], offset, limit)


def partition_of(rows: DataFrame) -> DataFrame:
    """(iuid, pid): class:<class> of members, else the number of the pool's partition, else null (rejected, merged or without one)."""
    pid = F.when(is_live() & is_member(), F.concat(F.lit("class:"), "assigned_class")).when(in_pool(), F.col("pid").cast("string"))
    return rows.select("iuid", pid.alias("pid"))


def members(rows: DataFrame, pid: str) -> DataFrame:
    """The rows of a partition: class:<class> (live members), a number (the pool's partition), else the row of that iuid."""
    if pid.startswith("class:"):
        return rows.filter(is_live() & is_member() & (F.col("assigned_class") == pid[6:]))
    if pid.isdigit():
        return rows.filter(in_pool() & (F.col("pid") == int(pid)))
    return rows.filter(F.col("iuid").cast("string") == pid.removeprefix("iuid:"))


def pool(rows: DataFrame, batches: list[str] | None, facets: Column | None = None) -> DataFrame:
    """The pool of the ingested batches; with `facets`, of the rows that meet them too (views use them, clustering doesn't)."""
    out = rows.filter(in_pool())
    if batches is not None:
        out = out.filter(F.col("batch_id").isin(*batches))
    return out if facets is None else out.filter(facets)


def rejected(rows: DataFrame) -> DataFrame:
    """Rejected rows, merged ones too."""
    return rows.filter("is_background")


def at_pixel(boxes: DataFrame, x: int, y: int) -> DataFrame:
    """(image_id, iuid) of the best-scored live box over a pixel in each image; the smaller id wins ties."""
    over = boxes.filter(is_live() & (F.col("x0") <= x) & (F.col("x1") > x) & (F.col("y0") <= y) & (F.col("y1") > y))
    return over.groupBy("image_id").agg(F.min_by("iuid", F.struct(-F.col("score"), F.col("iuid"))).alias("iuid"))


def default_methods(health: DataFrame, preferred: str = "decoder", geometry: tuple[str, ...] = ("shape", "shapecoord", "coords")) -> DataFrame:
    """The methods that a clustering takes by default, of health(method, usable): the preferred one, else all but geometry, else all; usable ones only."""
    usable = health.filter("usable")
    tier = F.when(F.col("method") == preferred, 0).when(~F.col("method").isin(*geometry), 1).otherwise(2)
    best = usable.agg(F.min(tier).alias("best"))  # one row
    return usable.crossJoin(F.broadcast(best)).filter(tier == F.col("best")).select("method")
