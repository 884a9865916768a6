"""Joins that no hot key can pull into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot when more rows than HOT_ROWS and more than a HOT_SHARE-th of all rows have it:
#: fewer than HOT_SHARE keys can be, which bounds what is broadcast.
HOT_ROWS, HOT_SHARE = 100_000, 2_000


def hot_keys(rows: DataFrame, key: str) -> list:
    """The hot keys of rows, fewer than HOT_SHARE; nulls aside."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).count()
    total, most = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if most <= HOT_ROWS:
        return []
    return [r[0] for r in counts.filter((F.col("count") > HOT_ROWS) & (F.col("count") > total / HOT_SHARE)).select(key).collect()]


def keyed_join(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """rows joined (inner or left) with per_key, which holds one row per key.

    Rows of hot keys meet a broadcast of those keys' rows, all others shuffle;
    rows with a null key match nothing and, in a left join, don't travel.
    `hot` spares the count where the caller knows the hot keys.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    missing = F.col(key).isNull()
    some = rows.filter(~missing)
    if hot:
        is_hot = F.col(key).isin(hot)
        out = some.filter(is_hot).join(F.broadcast(per_key.filter(is_hot)), key, how).unionByName(some.filter(~is_hot).join(per_key.filter(~is_hot), key, how))
    else:
        out = some.join(per_key, key, how)
    if how == "inner":
        return out
    return out.unionByName(rows.filter(missing).select("*", *[F.lit(None).cast(t).alias(c) for c, t in per_key.dtypes if c != key]))
