"""Readers of annotation documents, logs and folders."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions import masks, refine

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
_COCO = (
    "images array<struct<id: long, file_name: string, height: int, width: int>>, categories array<struct<id: int, name: string, supercategory: string>>, "
    "annotations array<struct<id: long, image_id: long, category_id: int, bbox: array<double>, area: double, iscrowd: int, score: double, segmentation: string>>"
)


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of COCO documents; unknown fields are dropped, missing ones null."""
    doc = spark.read.schema(_COCO).option("multiLine", True).json(path)
    return tuple(doc.select(F.explode(part).alias("r")).select("r.*") for part in ("images", "annotations", "categories"))


def annotated_images(images: DataFrame, annotations: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Annotations with their image's file; images without any are left out.

    With files(file_name, image_id, row), an image's file is the one of its name,
    else the first of its basename; `found` is that file, null without one.
    """
    named = images.select(F.col("id").alias("image_id"), "file_name", "height", "width")
    if files is not None:
        exact = files.groupBy("file_name").agg(F.min("file_name").alias("__exact"))
        first = files.groupBy(basename("file_name").alias("__base")).agg(F.min_by("file_name", "row").alias("__first"))
        named = named.join(exact, "file_name", "left").withColumn("__base", basename("file_name")).join(first, "__base", "left")
        named = named.withColumn("found", F.coalesce("__exact", "__first")).drop("__exact", "__base", "__first")
    return annotations.join(named, "image_id")


def mask_of(segmentation, bbox, height, width):
    """Column: the run-length code of a COCO segmentation (code, run lengths or polygons as JSON), else of the box; null without either or with a bad size."""
    def one(seg: str | None, box, h, w) -> str | None:
        if h is None or w is None or not (h > 0 and w > 0):
            return None
        h, w = int(h), int(w)
        try:
            value = json.loads(seg) if seg else None
        except ValueError:
            value = None
        if isinstance(value, dict):
            counts = value.get("counts")
            if list(value.get("size", [h, w])) != [h, w]:
                return None
            if isinstance(counts, list):
                flat = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
                return masks.encode(flat.reshape((h, w), order="F")) if len(flat) == h * w else None
            return counts
        if isinstance(value, list) and value:
            return masks.encode(refine.from_polygons([p for p in value if len(p) >= 6], h, w))
        if box is not None and len(box) == 4:
            x, y, bw, bh = box
            return masks.encode(refine.from_polygons([[x, y, x + bw, y, x + bw, y + bh, x, y + bh]], h, w))
        return None

    return F.pandas_udf(lambda s, b, h, w: pd.Series([one(*r) for r in zip(s, b, h, w)], dtype=object), "string")(segmentation, bbox, height, width)


def basename(path):
    return F.element_at(F.split(path, r"[/\\]"), -1)


def match_basename(incoming: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) rows of incoming(file_name, ...) by the file's basename; of several known files the first row number wins.

    known(file_name, image_id, row).
    """
    first = known.groupBy(basename("file_name").alias("base")).agg(F.min_by("image_id", "row").alias("image_id"))
    keyed = incoming.withColumn("base", basename("file_name"))
    return keyed.join(first, "base").drop("base"), keyed.join(first, "base", "left_anti").drop("base")


#: The fields of the four logs.
LOGS = {
    "history": "cmd_id string, ts double, op string, label string, n_instances int, iuids array<string>, user string, of string",
    "ingests": "ingest_id string, ts double, n_instances int, n_images int, batch_ids array<string>, mode string, score_thresh double, source string",
    "merges": "kind string, iuids array<string>, mode string, image_id long, source string, ts double",
    "lineage": "ts double, coll_version int, n_assigned int, config_name string, ckpt string, metric_name string, metric double, regressed boolean",
}


def read_log(spark: SparkSession, path: str, schema: str, last: int | None = None) -> DataFrame:
    """A JSON-lines log, by its schema or its name in LOGS; corrupt lines are dropped. `last` keeps the latest rows by ts only."""
    rows = spark.read.schema(LOGS.get(schema, schema)).option("mode", "DROPMALFORMED").json(path)
    return rows if last is None else rows.orderBy(F.desc("ts")).limit(last)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of image files under a folder, by suffix and in order of their paths, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGE_SUFFIXES)).orderBy("path")


def count_images(spark: SparkSession, root: str, cap: int = 2_000) -> tuple[int, bool]:
    """(number, whether there are more) of the image files under a folder, counted up to `cap`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    n = files.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGE_SUFFIXES)).limit(cap + 1).count()
    return min(n, cap), n > cap


def import_proposals(annotations: DataFrame, categories: DataFrame, known: DataFrame, features: dict[str, int], source: str) -> tuple[DataFrame, DataFrame]:
    """(records, unmatched file names) of another model's annotations(file_name, bbox, score, category_id, ...).

    Files match by basename, the first known row wins; every record has zeros for each of the features.
    """
    named = annotations.join(F.broadcast(categories.select(F.col("id").alias("category_id"), F.col("name").alias("pred_class"))), "category_id", "left")
    matched, unmatched = match_basename(named, known)
    zeros = F.map_from_arrays(F.array(*[F.lit(m) for m in features]), F.array(*[F.array_repeat(F.lit(0.0).cast("float"), d) for d in features.values()]))
    rows = matched.select("image_id", "file_name", "bbox", F.coalesce("score", F.lit(1.0)).alias("score"), "pred_class", F.lit(source).alias("source"), zeros.alias("features"))
    return rows, unmatched.select("file_name").distinct()


def seed_taxonomy(classes: DataFrame, seed: DataFrame) -> DataFrame:
    """classes(class_id, name, coco_cat_id, concept) plus the leaves of seed(superclass, concept, leaf) that it lacks by name.

    A leaf's name is `concept — leaf`; new leaves take the numbers after the largest, in order of name. Both are lists of names.
    """
    wanted = seed.select(F.concat_ws(" — ", "concept", "leaf").alias("name"), "concept").filter("name != ''").groupBy("name").agg(F.min("concept").alias("concept"))
    new = wanted.join(classes.select("name"), "name", "left_anti")
    top = F.broadcast(classes.agg(F.coalesce(F.max("coco_cat_id"), F.lit(0)).alias("top")))  # one row
    made = new.crossJoin(top).selectExpr("concat('c_', substr(md5(name), 1, 12)) as class_id", "name", "cast(top + row_number() over (order by name) as int) as coco_cat_id", "concept")
    return classes.select("class_id", "name", F.col("coco_cat_id").cast("int").alias("coco_cat_id"), "concept").unionByName(made)


def bundle_plan(records: DataFrame, present: DataFrame, prefix: str, new_prefix: str) -> DataFrame:
    """(path, target, missing, length) of every file that records(abs_path) need; present(path, length) are the files there are."""
    files = records.select(F.col("abs_path").alias("path")).filter("path is not null").distinct().join(present, "path", "left")
    target = F.when(F.col("path").startswith(prefix), F.concat(F.lit(new_prefix), F.expr(f"substr(path, {len(prefix) + 1})"))).otherwise(F.concat(F.lit(new_prefix.rstrip("/") + "/"), basename("path")))
    return files.select("path", target.alias("target"), F.col("length").isNull().alias("missing"), "length")
