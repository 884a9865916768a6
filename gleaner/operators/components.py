"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.session import drop_scratch, materialize

#: A node is hot when it has more neighbours than this and more than a HOT_SHARE-th of all
#: links; fewer than 2 * HOT_SHARE nodes can be, so their minima are a broadcast of proven size.
HOT_DEGREE, HOT_SHARE = 200_000, 2_000


def _with_least(links: DataFrame, own: bool, total: int) -> DataFrame:
    """links(u, v), at most `total`, with `least`, the smallest neighbour of u (and u itself, if `own`).

    Hot nodes are joined by broadcast, so that no task gets all links of one node.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    least = least.select("u", F.least("u", "m").alias("least") if own else F.col("m").alias("least"), "degree")
    if total <= HOT_DEGREE:
        return links.join(least.drop("degree"), "u")
    hot = least.filter((F.col("degree") > HOT_DEGREE) & (F.col("degree") > total / HOT_SHARE)).drop("degree")
    few = [r["u"] for r in hot.select("u").collect()]
    if not few:
        return links.join(least.drop("degree"), "u")
    is_hot = F.col("u").isin(few)
    return links.filter(is_hot).join(F.broadcast(hot), "u").unionByName(links.filter(~is_hot).join(least.drop("degree"), "u"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an undirected edge list; component is its smallest node.

    Loops and repeated edges are harmless, edges with a null end are ignored, an
    empty list gives an empty result. Nodes of any one ordered type. Each round
    is written to the shared folder; a graph of diameter d takes O(log d) rounds
    on the usual inputs, and the loop ends when nothing changes.
    """
    ends: tuple[Column, Column] = (F.col(a), F.col(b))
    nodes = edges.select(F.explode(F.array(*ends)).alias("node")).filter("node is not null").distinct()
    links = edges.filter(ends[0].isNotNull() & ends[1].isNotNull() & (ends[0] != ends[1]))
    links = materialize(links.select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).distinct(), "components")
    previous, total = None, links.count()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, True, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        stars = _with_least(large, False, 2 * total)
        small = stars.filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            stars.select("u", F.col("least").alias("v"))
        )
        after = materialize(small.filter("u != v").distinct(), "components")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(links.sparkSession, links)
        links, total = after, mark[0]
        if mark == previous:
            break
        previous = mark
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
