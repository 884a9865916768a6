"""Splits that keep related records together (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.columns import hex_id
from gleaner.operators.components import connected_components
from gleaner.operators.skew import keyed_join
from gleaner.sources.tables import table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def entity_links(records: DataFrame, unit: str, entity: str) -> DataFrame:
    """Star of links (unit, first) for each entity that several units share.

    Every unit of an entity is linked to the entity's smallest unit: as many
    links as (unit, entity) pairs, never all pairs. Null units or entities link nothing.
    """
    pairs = records.select(F.col(unit).alias("unit"), F.col(entity).alias("entity")).dropna().distinct()
    least = pairs.groupBy("entity").agg(F.min("unit").alias("first"), F.max("unit").alias("last")).filter("first < last")
    return keyed_join(pairs, least.drop("last"), "entity").filter("unit != first").select("unit", "first").distinct()


def group_units(records: DataFrame, unit: str, entity: str) -> DataFrame:
    """(unit, group) of the units that share an entity with another, directly or by chain."""
    return connected_components(entity_links(records, unit, entity), "unit", "first").select(
        F.col("node").alias("unit"), F.col("component").alias("group")
    )


def split_of(key: str, shares: dict[str, float], seed: int = 0):
    """The split whose range of [0, 1) holds the key's hash; shares are normalised."""
    total, low, out = sum(shares.values()), 0.0, None
    x = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    for name, share in shares.items():
        low += share / total
        out = F.when(x < low, name) if out is None else out.when(x < low, name)
    return out.otherwise(list(shares)[-1])


def assign_splits(records: DataFrame, unit: str, entity: str, shares: dict[str, float] = SHARES, seed: int = 0) -> DataFrame:
    """records plus group_id and split, so that units that share an entity get one split.

    A null unit goes by its entity (its group is looked up through a unit with
    that entity, else the entity is its own group); a row with neither is its
    own group by its whole content. Repeated rows get the same split. Other
    columns pass through, and may have any names but group_id and split.
    Proportions hold up to the size of the largest group, which cannot be cut.
    """
    groups = group_units(records, unit, entity).select(F.col("unit").alias(unit), F.col("group").alias("__group"))
    by_unit = keyed_join(records, groups, unit, "left").select(*[F.col(f"`{c}`") for c in records.columns], "__group")
    home = by_unit.filter(F.col(unit).isNotNull() & F.col(entity).isNotNull()).groupBy(entity).agg(F.min(F.coalesce("__group", F.col(unit))).alias("__home"))
    cols = [*by_unit.columns, "__home"]
    orphan = keyed_join(by_unit.filter(F.col(unit).isNull()), home, entity, "left").select(*[F.col(f"`{c}`") for c in cols])
    kept = by_unit.filter(F.col(unit).isNotNull()).withColumn("__home", F.col("__group"))
    own = F.coalesce(
        F.col("__home").cast("string"), F.col(unit).cast("string"), F.col(entity).cast("string"),
        F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])), 256),
    )
    return kept.unionByName(orphan).withColumn("group_id", own).withColumn("split", split_of("group_id", shares, seed)).drop("__group", "__home")


def _records(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "meta").select(hex_id("iuid").alias("iuid"), "image_id")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return group_units(_records(spark, root), "image_id", "iuid").select(
        F.col("unit").alias("image_id"), F.col("group").alias("group_image_id")
    )


def p3_splits(spark: SparkSession, root: str) -> DataFrame:
    """Every meta record with its split."""
    return assign_splits(_records(spark, root), "image_id", "iuid")


P3_FOUND_SQL = """
WITH RECURSIVE m AS (
  SELECT DISTINCT regexp_replace(lower(iuid), '[\\s{}-]', '', 'g') AS iuid, image_id FROM meta WHERE image_id IS NOT NULL),
v AS (SELECT * FROM m WHERE regexp_matches(iuid, '^[0-9a-f]{32}$')),
e AS (SELECT DISTINCT a.image_id AS a, b.image_id AS b FROM v a JOIN v b USING (iuid) WHERE a.image_id <> b.image_id),
r AS (SELECT a AS node, a AS least FROM e UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node WHERE r.least < e.b)
SELECT node AS image_id, min(least) AS group_image_id FROM r GROUP BY node
"""

P3_SPLITS_SQL = P3_FOUND_SQL.replace("SELECT node AS image_id, min(least) AS group_image_id FROM r GROUP BY node", """, g AS (SELECT node, min(least) AS grp FROM r GROUP BY node),
x AS (SELECT CASE WHEN regexp_matches(i, '^[0-9a-f]{32}$') THEN i END AS iuid, image_id FROM (SELECT regexp_replace(lower(iuid), '[\\s{}-]', '', 'g') AS i, image_id FROM meta)),
h AS (SELECT iuid, min(coalesce(grp, image_id)) AS home FROM x LEFT JOIN g ON node = image_id WHERE image_id IS NOT NULL AND iuid IS NOT NULL GROUP BY iuid),
o AS (SELECT x.iuid, image_id, coalesce(CAST(CASE WHEN image_id IS NULL THEN home ELSE grp END AS VARCHAR), CAST(image_id AS VARCHAR), x.iuid, sha256('{}')) AS group_id
 FROM x LEFT JOIN g ON node = image_id LEFT JOIN h ON h.iuid = x.iuid),
d AS (SELECT *, CAST('0x' || substr(md5('0:' || group_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM o)
SELECT iuid, image_id, group_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM d""")
