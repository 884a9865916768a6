"""Export documents: category ids, annotations, partial labels, manifests and their merging and re-import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.operators.boxes import overlapping_pairs
from gleaner.operators.stats import n_if
from gleaner.operators.views import class_reviewed, in_pool, is_live, is_member
from gleaner.session import materialize

IGNORE = 0


def category_ids(classes: DataFrame) -> DataFrame:
    """(class_id, category_id) of classes(class_id, place, pin): a pin is kept by the first that asks for it, all others fill the smallest unused ids from 1, in order of place.

    Classes are a list of names, so the windows run over few rows.
    """
    pinned = classes.filter("pin is not null and pin >= 1").selectExpr("class_id", "pin as category_id", "row_number() over (partition by pin order by place) as nth").filter("nth = 1").drop("nth")
    rest = classes.join(pinned, "class_id", "left_anti").selectExpr("class_id", "row_number() over (order by place) as k")
    ids = classes.agg(F.explode(F.sequence(F.lit(1), F.count("*").cast("int") * 2 + 1)).alias("category_id"))
    free = ids.join(pinned, "category_id", "left_anti").selectExpr("category_id", "row_number() over (order by category_id) as k")
    return pinned.select("class_id", F.col("category_id").cast("int")).unionByName(rest.join(free, "k").select("class_id", F.col("category_id").cast("int")))


def exportable(rows: DataFrame, held: DataFrame | None = None, temporary: DataFrame | None = None) -> DataFrame:
    """Live class members, without held images and temporary classes."""
    out = rows.filter(is_live() & is_member())
    if held is not None:
        out = out.join(held.select("image_id"), "image_id", "left_anti")
    return out if temporary is None else out.join(F.broadcast(temporary.select(F.col("class_id").alias("assigned_class"))), "assigned_class", "left_anti")


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows plus consecutive numbers from 1 in the given order, counted per range partition first."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33))
    parts = materialize(parts, "numbered")
    counts = sorted((r["__part"], r["n"]) for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect())  # one row per partition
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    offset = rows.sparkSession.createDataFrame(starts, "__part int, __start long")
    return parts.join(F.broadcast(offset), "__part").withColumn(name, F.col("__at") + F.col("__start") + 1).drop("__part", "__at", "__start")


def annotations(rows: DataFrame, categories: DataFrame, held: DataFrame | None = None, temporary: DataFrame | None = None) -> DataFrame:
    """(id, image_id, category_id, iuid, bbox fields, area, class_reviewed, mask_reviewed) of the exportable rows, numbered by iuid."""
    out = exportable(rows, held, temporary).join(F.broadcast(categories.select(F.col("class_id").alias("assigned_class"), "category_id")), "assigned_class")
    out = out.select("iuid", "image_id", "category_id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("bw").alias("w"), F.col("bh").alias("h"), "area", class_reviewed().alias("class_reviewed"), "mask_reviewed")
    return numbered(out, "id", "iuid")


def partial_labels(rows: DataFrame) -> DataFrame:
    """Per image: positives, ignored (unassigned) and rejected rows, and whether its review is exhaustive."""
    live = rows.filter(is_live())
    out = live.groupBy("image_id").agg(n_if(is_member()).alias("n_pos"), n_if(in_pool()).alias("n_ign"), n_if(F.col("is_background")).alias("n_neg"))
    return out.withColumn("reviewed_exhaustive", (F.col("n_ign") == 0) & (F.col("n_pos") + F.col("n_neg") > 0))


def manifest(rows: DataFrame, rejected: bool = True) -> DataFrame:
    """(file, class, iuid) of live rows with a class, and of rejected rows as __rejected__."""
    name = F.when(F.col("is_background"), F.lit("__rejected__") if rejected else F.lit(None)).otherwise(F.col("assigned_class"))
    return rows.filter(is_live()).select(F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file"), name.alias("class"), "iuid").filter("class is not null")


def write_manifest(rows: DataFrame, path: str, form: str = "json") -> None:
    """Write a manifest, sorted by class and file within range partitions, as json or csv; image ids stay text."""
    out = rows.repartitionByRange("class", "file").sortWithinPartitions("class", "file")
    out.write.mode("overwrite").format(form).options(header="true").save(path)


def merge_documents(parts: dict[str, DataFrame]) -> DataFrame:
    """One annotation table of several (image_id, category, iuid), with categories joined by name and images kept apart by document.

    Images get the document's name; category ids follow the order of names.
    """
    union: DataFrame | None = None
    for name, part in parts.items():
        part = part.select(F.concat(F.lit(name + "/"), F.col("image_id").cast("string")).alias("image"), "category", "iuid")
        union = part if union is None else union.unionByName(part)
    names = union.select("category").distinct().selectExpr("category", "dense_rank() over (order by category) as category_id")  # one row per name
    return union.join(F.broadcast(names), "category")


def document(images: DataFrame, categories: DataFrame, marks: DataFrame) -> DataFrame:
    """(part, id, json): the lines of a COCO document in three parts; image ids are text, for numbers above 2^53 don't survive JSON.

    images(image_id, file_name), categories(category_id, name), marks(id, image_id, category_id, x, y, w, h, area, iuid, iscrowd).
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    line = lambda part, id_, rows, *cols: rows.select(F.lit(part).alias("part"), F.col(id_).cast("long").alias("id"), F.to_json(F.struct(*cols)).alias("json"))
    image = line("images", "image_id", images, F.col("image_id").cast("string").alias("id"), "file_name")
    category = line("categories", "category_id", categories, F.col("category_id").alias("id"), "name")
    mark = line("annotations", "id", marks, "id", text("image_id"), "category_id", F.array("x", "y", "w", "h").alias("bbox"), F.col("area").cast("long").alias("area"), text("iuid"), "iscrowd")
    return image.unionByName(category).unionByName(mark)


def with_ignored(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, iuid, image_id, category_id, iscrowd) of live rows: members in their category, unassigned rows as crowds of category IGNORE; rejected rows are left out."""
    live = rows.filter(is_live() & ~F.col("is_background"))
    named = live.join(F.broadcast(categories.select(F.col("class_id").alias("assigned_class"), "category_id")), "assigned_class", "left")
    out = named.filter(F.col("assigned_class").isNull() | F.col("category_id").isNotNull()).select("iuid", "image_id", F.coalesce("category_id", F.lit(IGNORE)).alias("category_id"), F.col("assigned_class").isNull().cast("int").alias("iscrowd"))
    return numbered(out, "id", "iuid")


def agnostic(marks: DataFrame, name: str = "object") -> tuple[DataFrame, DataFrame]:
    """(marks, categories) with every mark in one category."""
    return marks.withColumn("category_id", F.lit(1)), marks.sparkSession.createDataFrame([(1, name)], "category_id int, name string")


def labelled_batch(rows: DataFrame, batch_id: str) -> DataFrame:
    """(id, iuid, image_id, label, category_id) of a batch's live rows with a class, categories in order of their names."""
    out = rows.filter(is_live() & is_member() & (F.col("batch_id") == batch_id)).select("iuid", "image_id", F.col("assigned_class").alias("label"))
    names = out.select("label").distinct().selectExpr("label", "dense_rank() over (order by label) as category_id")  # one row per class
    return numbered(out.join(F.broadcast(names), "label"), "id", "iuid")


def unreviewed(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """(category_id, n, n_class_unreviewed, n_mask_unreviewed) of the exportable rows."""
    out = exportable(rows).join(F.broadcast(categories.select(F.col("class_id").alias("assigned_class"), "category_id")), "assigned_class")
    return out.groupBy("category_id").agg(F.count("*").alias("n"), n_if(~class_reviewed()).alias("n_class_unreviewed"), n_if(~F.col("mask_reviewed")).alias("n_mask_unreviewed"))


def patched(marks: DataFrame, patches: DataFrame, key: str = "iuid", fields: tuple[str, ...] = ("x", "y", "w", "h", "area")) -> DataFrame:
    """marks with the given fields of patches(key, *fields) where there is one; all other columns and rows stay."""
    new = patches.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__patched"))
    out = marks.join(new, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col("__patched"), F.col(f"__{f}")).otherwise(F.col(f)))
    return out.select(*marks.columns)


def full_manifest(rows: DataFrame, classes: DataFrame, rejected: bool = True) -> DataFrame:
    """(file, class, iuid, source_id, granularity, modality) of live rows with a class, by its name, and of rejected rows; rows(..., source)."""
    names = F.broadcast(classes.select(F.col("class_id").alias("assigned_class"), F.col("name").alias("__name")))
    named = rows.filter(is_live()).join(names, "assigned_class", "left")
    kind = F.when(F.col("is_background"), F.lit("__rejected__") if rejected else F.lit(None)).otherwise(F.coalesce("__name", "assigned_class"))
    file = F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".jpg"))
    return named.select(file.alias("file"), kind.alias("class"), "iuid", F.col("source").alias("source_id"), "granularity", "modality").filter("class is not null")


def report(rows: DataFrame, log: DataFrame) -> DataFrame:
    """(metric, value) of a project: its live rows, members, rejected rows, images and commands by operation."""
    live = is_live()
    one = rows.agg(n_if(live).alias("instances"), n_if(live & is_member()).alias("assigned"), n_if(live & F.col("is_background")).alias("rejected"), F.countDistinct("image_id").alias("images"))
    names = one.columns
    flat = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*names))).alias("metric", "value"))
    return flat.unionByName(log.groupBy(F.concat(F.lit("op:"), "op").alias("metric")).agg(F.count("*").alias("value")))


def match_imports(incoming: DataFrame, known: DataFrame, iou: Column, least: float = 0.3) -> DataFrame:
    """(iuid, match, how) of incoming boxes: the known box of the same iuid, else the image's box of largest IoU above `least`, else none.

    `iou` is over structs a (incoming) and b (known).
    """
    exact = incoming.join(known.select("iuid"), "iuid", "left_semi").select("iuid", F.col("iuid").alias("match"), F.lit("iuid").alias("how"))
    rest = incoming.join(known.select("iuid"), "iuid", "left_anti")
    # overlaps of either table's boxes meet in tiles; an incoming box has the key (iuid, 0), a known one (iuid, 1)
    side = lambda d, k: d.select(F.struct("iuid", F.lit(k).alias("known")).alias("iuid"), "image_id", "x0", "y0", "x1", "y1", "area")
    met = overlapping_pairs(side(rest, 0).unionByName(side(known, 1))).filter(F.col("a.iuid.known") != F.col("b.iuid.known")).withColumn("iou", iou).filter(F.col("iou") > least)
    mine = F.col("a.iuid.known") == 0
    pair = met.select(F.when(mine, F.col("a.iuid.iuid")).otherwise(F.col("b.iuid.iuid")).alias("iuid"), F.when(mine, F.col("b.iuid.iuid")).otherwise(F.col("a.iuid.iuid")).alias("id"), "iou")
    best = pair.groupBy("iuid").agg(F.min(F.struct((-F.col("iou")).alias("far"), "id")).alias("m"))
    near = rest.select("iuid").join(best, "iuid", "left").select("iuid", F.col("m.id").alias("match"), F.when(F.col("m.id").isNotNull(), "iou").otherwise("none").alias("how"))
    return exact.unionByName(near)
