"""What makes proposals from images: named makers, of which those that need a model are added by the user."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions import masks
from gleaner.sources.documents import annotated_images, mask_of, read_coco

PROPOSAL = "path string, height int, width int, rle string, score double"


@dataclass(frozen=True)
class Maker:
    """make(images, **options) gives rows of PROPOSAL; needs names the modules without which it can't run."""

    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()

    def missing(self) -> list[str]:
        return [m for m in self.needs if importlib.util.find_spec(m) is None]


def whole_image(images: DataFrame) -> DataFrame:
    """One proposal per row of images(path, height, width): all of it."""
    full = masks.rle_of_sizes("height", "width")
    return images.select("path", "height", "width", full.alias("rle"), F.lit(1.0).alias("score"))


def coco(images: DataFrame, document: str) -> DataFrame:
    """The masks of a COCO document for images(path), by name or else by basename; images that it doesn't know have none."""
    pictures, marks, _ = read_coco(images.sparkSession, document)
    files = images.select(F.col("path").alias("file_name"), F.lit(0).alias("image_id"), F.col("path").alias("row"))
    rows = annotated_images(pictures, marks, files).filter("found is not null")
    return rows.select(F.col("found").alias("path"), "height", "width", mask_of("segmentation", "bbox", "height", "width").alias("rle"), F.coalesce("score", F.lit(1.0)).alias("score"))


def on_batches(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """A maker from a function over batches of images (path, content), as a model's would be."""
    return lambda images, **_: images.mapInPandas(run, PROPOSAL)


MAKERS: dict[str, Maker] = {"whole_image": Maker(whole_image), "coco": Maker(coco)}


def status(spark: SparkSession) -> DataFrame:
    """(name, ready, missing) of every maker."""
    return spark.createDataFrame([(n, not m.missing(), ",".join(m.missing())) for n, m in sorted(MAKERS.items())], "name string, ready boolean, missing string")


def collection(proposals: DataFrame, least_score: float = 0.0, least_share: float = 0.0) -> DataFrame:
    """Records of proposals: without those of no or a wrong mask, low scores and masks below a share of their image.

    Rows: path, height, width, rle, score, cx, cy, bw, bh (as shares of the image), box_area, mask_area_frac.
    """
    size = F.col("height") * F.col("width")
    box = masks.rle_box("rle", "height", "width")
    rows = proposals.filter((F.col("score") >= least_score) & F.col("rle").isNotNull()).withColumn("b", box).filter("b is not null").withColumn("mask_area_frac", masks.rle_area("rle") / size)
    rows = rows.filter((F.col("mask_area_frac") > 0) & (F.col("mask_area_frac") >= least_share))
    part = lambda i, n, half=None: ((F.col("b")[i] + (F.col("b")[half] / 2 if half is not None else 0)) / F.col(n))
    return rows.select(
        "path", "height", "width", "rle", "score", part(0, "width", 2).alias("cx"), part(1, "height", 3).alias("cy"), part(2, "width").alias("bw"), part(3, "height").alias("bh"),
        (F.col("b")[2] * F.col("b")[3]).cast("double").alias("box_area"), "mask_area_frac",
    )
