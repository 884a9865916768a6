"""Choosing a varied subset (problem 5) by systematic selection along a Hilbert curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.columns import hex_id
from gleaner.llm.neighbours import DIM, vectors
from gleaner.llm.vector_index import matrix
from gleaner.operators.skew import keyed_join
from gleaner.session import drop_scratch, materialize
from gleaner.sources.tables import table

DIMS, BITS = 9, 7
#: Steps to a unit for exact sums, and the rows of which products add up below 2**53.
STEPS, BLOCK = 1 << 20, 1 << 13


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer coordinates below 2**bits; columns x bits <= 63."""
    x, n = grid.astype(np.int64).T.copy(), grid.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[n - 1] & level) != 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, total): the rows' number, sum and upper triangle of summed products in whole steps, so that no order of adding changes them."""
    upper = np.triu_indices(DIM)

    def out(n: int, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
        total = np.concatenate([[n], one, two[upper]]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["pos", "total"])

    n, one, two = 0, np.zeros(DIM, np.int64), np.zeros((DIM, DIM), np.int64)
    for b in batches:
        every = matrix(b.column("vec"))
        for start in range(0, len(every), BLOCK):
            x = np.rint(every[start : start + BLOCK].astype(np.float64) * STEPS)
            n, one, two = n + len(x), one + x.sum(0).astype(np.int64), two + (x.T @ x).astype(np.int64)
            if n >= 1 << 22:  # far from the end of 64 bits
                yield out(n, one, two)
                n, one, two = 0, np.zeros_like(one), np.zeros_like(two)
    if n:
        yield out(n, one, two)


def fit_grid(units: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, DIMS leading directions and the 2**BITS - 1 evenly spaced cuts of each, from all unit vectors (vec BINARY).

    Copies count once, and cuts lie by distance, not by mass, so that a crowd gets the cells that it covers.
    """
    parts = units.select("vec").distinct().mapInArrow(sums, "pos int, total long")
    total = [int(r["total"]) for r in parts.groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("pos").collect()]  # a matrix, however many rows
    if not total:
        return np.zeros(DIM), np.eye(DIM)[:DIMS], np.zeros((DIMS, (1 << BITS) - 1))
    n, one = total[0], np.array(total[1 : DIM + 1], object)
    two = np.zeros((DIM, DIM), object)
    two[np.triu_indices(DIM)] = total[DIM + 1 :]
    two = two + np.triu(two, 1).T
    centre = one.astype(np.float64) / n / STEPS
    _, _, axes = np.linalg.svd((two * n - np.outer(one, one)).astype(np.float64) / n / STEPS**2)
    axes = axes[:DIMS] * np.sign(axes[:DIMS, np.abs(axes[:DIMS]).argmax(1)].diagonal())[:, None]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = (matrix(b.column("vec")) - centre) @ axes.T
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(flat.min(0)), pa.array(flat.max(0))], names=["axis", "lo", "hi"])

    reach = units.select("vec").mapInArrow(ends, "axis int, lo double, hi double").groupBy("axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("axis").collect()  # DIMS rows
    return centre, axes, np.linspace([r["lo"] for r in reach], [r["hi"] for r in reach], (1 << BITS) + 1, axis=1)[:, 1:-1]


def varied_subset(features: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """`size` rows (iuid, image_id, cell) of the usable vectors that vary in vec and image_id; all of them, if fewer.

    images(iuid BINARY, image_id) gives each id's image; an id without one, or
    with a null one, has the null image, which is as large as it is. Unit vectors are quantised along their
    leading directions and placed on a Hilbert curve; the curve's coarsest level
    with at least `size` distinct cells is cut into `size` equal stretches of
    distinct cells, so a group of similar records counts by the cells it covers,
    not by its rows. From a chosen cell comes its record of the rarest image,
    then nearest to the other records' centre, then with the smallest iuid. If
    even the finest level has too few cells, further records follow in the order
    of their id's hash. Repeated rows of an id count once.
    """
    spark = features.sparkSession
    packed = vectors(features, as_unit=True)
    shared = spark.sparkContext.broadcast(fit_grid(packed))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, axes, cuts = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float32).reshape(b.num_rows, -1) - centre
            flat = x @ axes.T
            grid = np.stack([np.searchsorted(c, f) for c, f in zip(cuts, flat.T)], 1)
            off = np.round(np.sqrt(np.maximum((x * x).sum(1) - (flat * flat).sum(1), 0)), 9)
            yield pa.RecordBatch.from_arrays([b.column("iuid"), pa.array(hilbert_keys(grid, BITS)), pa.array(off)], names=["iuid", "key", "off"])

    placed = packed.mapInArrow(encode, "iuid binary, key long, off double").groupBy("iuid").agg(F.min(F.struct("key", "off")).alias("p")).select("iuid", "p.*")
    image_of = images.filter("iuid is not null").groupBy("iuid").agg(F.min("image_id").alias("image_id"))
    pictured = materialize(placed.join(image_of, "iuid", "left").select("iuid", "image_id", "key", "off"), "pictured")
    crowd = pictured.groupBy("image_id").agg(F.count("*").alias("crowd"))
    nowhere = pictured.filter("image_id is null").count()
    known = keyed_join(pictured, crowd, "image_id", "left").withColumn("crowd", F.coalesce("crowd", F.lit(nowhere)))
    known = materialize(known.select("iuid", "image_id", "key", "off", "crowd"), "placed")
    drop_scratch(spark, pictured)
    levels = known.agg(*[F.approx_count_distinct(F.shiftright("key", DIMS * (BITS - b)), 0.02).alias(str(b)) for b in range(1, BITS + 1)]).first()
    level = next((b for b in range(1, BITS + 1) if levels[str(b)] >= 1.05 * size), BITS)
    best = F.min(F.struct("crowd", "off", "iuid", "image_id"))
    cells = known.groupBy(F.shiftright("key", DIMS * (BITS - level)).alias("cell")).agg(best.alias("best"))
    ordered = materialize(
        cells.repartitionByRange("cell").sortWithinPartitions("cell").withColumn("part", F.spark_partition_id())
        .select("cell", "best.iuid", "best.image_id", "part", (F.monotonically_increasing_id() % (1 << 33)).alias("at")), "cells"
    )
    counts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    total, before, starts = sum(counts.values()), 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    if not total:
        return ordered.select(F.lower(F.hex("iuid")).alias("iuid"), "image_id", "cell")
    offset = spark.createDataFrame(starts, "part int, start long")
    rank = F.col("at") + F.col("start")
    take = min(size, total)
    nth = lambda r: F.floor(r * F.lit(take) / F.lit(total))
    chosen = ordered.join(F.broadcast(offset), "part").filter(nth((rank + 1).cast("decimal(38,0)")) > nth(rank.cast("decimal(38,0)"))).select("iuid", "image_id", "cell")
    if total < size:
        rest = known.join(ordered.select("iuid"), "iuid", "left_anti").orderBy(F.xxhash64("iuid"), "iuid").limit(size - total)
        chosen = chosen.unionByName(rest.select("iuid", "image_id", F.shiftright("key", DIMS * (BITS - level)).alias("cell")))
    return chosen.select(F.lower(F.hex("iuid")).alias("iuid"), "image_id", "cell")


def p5_subset(spark: SparkSession, root: str, share: int = 20) -> DataFrame:
    """A varied one in `share` of the records with features."""
    features = table(spark, root, "features")
    images = table(spark, root, "meta").select(F.unhex(hex_id("iuid")).alias("iuid"), "image_id")
    return varied_subset(features, images, features.filter(F.col("method") == "dinov2").count() // share)
