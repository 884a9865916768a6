"""Consolidating pairwise matches into groups (problem 7) by low-diameter decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.columns import hex_id
from gleaner.operators.skew import hot_keys, keyed_join
from gleaner.session import drop_scratch, materialize
from gleaner.sources.tables import table


#: Links that one task takes on at most.
RESIDUE = 20_000


def _start(node: str, beta: float, seed: int):
    """Start time of a node's own cluster: minus an exponential shift, from the node's hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(node)), F.lit((1 << 40) - 1)) + 1) / float(1 << 40)
    return F.log(u) / beta


def decompose(links: DataFrame, beta: float, steps: int, seed: int) -> DataFrame:
    """One decomposition: (node, center) of every node of symmetric links(u, v).

    A node joins the cluster that reaches it first: clusters start at shifted
    times and grow one link per unit of time. Growth stops after `steps` links;
    what is not reached by then stays with the cluster it is in. The claims of
    hot nodes are broadcast, so that no task gets all links of one node.
    """
    claims = links.select(F.col("u").alias("node")).distinct().withColumn("best", F.struct(_start("node", beta, seed).alias("time"), F.col("node").alias("center")))
    hot = hot_keys(links, "v")
    for _ in range(steps):
        reached = keyed_join(links, claims.withColumnRenamed("node", "v"), "v", hot=hot).groupBy(F.col("u").alias("node")).agg(
            F.min(F.struct((F.col("best.time") + 1.0).alias("time"), F.col("best.center").alias("center"))).alias("offer")
        )
        claims = claims.join(reached, "node").select("node", F.least("best", "offer").alias("best"))
    return claims.select("node", F.col("best.center").alias("center"))


def settle(u: np.ndarray, v: np.ndarray, n: int, beta: float, steps: int, seed: int) -> np.ndarray:
    """Super-node of each node 0..n-1 after decomposing the symmetric links u-v and contracting until none is left."""
    rng, at = np.random.default_rng(seed), np.arange(n)
    while len(u):
        time, center = np.log(1 - rng.random(n)) / beta, np.arange(n)
        for _ in range(steps):
            order = np.lexsort((center[v], time[v], u))
            first = order[np.r_[True, u[order][1:] != u[order][:-1]]]
            node, by = u[first], v[first]
            late = (time[by] + 1 < time[node]) | ((time[by] + 1 == time[node]) & (center[by] < center[node]))
            when, who = time.copy(), center.copy()
            when[node[late]], who[node[late]] = time[by[late]] + 1, center[by[late]]
            time, center = when, who
        at = center[at]
        pair = np.unique(np.stack([center[u], center[v]], 1)[center[u] != center[v]], axis=0)
        u, v = pair[:, 0], pair[:, 1]
    return at


def _finish(beta: float, steps: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
        u, v = codes[: len(pdf)], codes[len(pdf) :]
        return pd.DataFrame({"node": names, "center": names[settle(u, v, len(names), beta, steps, len(pdf))]})

    return run


def group_links(pairs: DataFrame, a: str, b: str, beta: float = 0.4, steps: int = 4, residue: int = RESIDUE) -> DataFrame:
    """(node, group) of every node of an undirected list of pairs; group is the smallest node.

    Each round decomposes the graph into clusters, contracts them to
    super-nodes, keeps the distinct links between clusters and composes the
    assignments; it ends when no link is left. Once `residue` links or fewer are
    left, one task runs the same rounds on them. Loops, repeated and reversed
    pairs are harmless, pairs with a null end are ignored, nodes with only a
    loop are not reported, and an empty list gives an empty result.
    """
    x, y = F.col(a), F.col(b)
    once = pairs.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(x.alias("u"), y.alias("v"))
    links = materialize(once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    spark, kind = links.sparkSession, dict(links.dtypes)["u"]
    nodes, seed, left = links.select(F.col("u").alias("node"), F.col("u").alias("at")).distinct(), 0, links.count()
    old: list[DataFrame] = [links]
    while left:
        few = left <= residue
        found = links.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_finish(beta, steps), f"node {kind}, center {kind}") if few else decompose(links, beta, steps, seed)
        centers = materialize(found, "centers")
        hub = hot_keys(nodes, "at")
        nodes = materialize(keyed_join(nodes, centers.withColumnRenamed("node", "at"), "at", "left", hub).select("node", F.coalesce("center", "at").alias("at")), "nodes")
        if few:
            links, left = None, 0
        else:
            hot = hot_keys(links, "u")
            to = lambda side: centers.select(F.col("node").alias(side), F.col("center").alias("c" + side))  # noqa: E731, B023
            met = keyed_join(keyed_join(links, to("u"), "u", hot=hot), to("v"), "v", hot=hot)
            links = materialize(met.filter("cu != cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), "links")
            left, seed = links.count(), seed + 1
        for done in old:
            drop_scratch(spark, done)
        old = [centers, nodes, *([links] if links is not None else [])]
    least = nodes.groupBy("at").agg(F.min("node").alias("group"))
    return keyed_join(nodes, least, "at").select("node", "group")


def merge_links(meta: DataFrame) -> DataFrame:
    """Valid merged_into links (iuid, target): both ends are records of the row's image, and differ.

    Ids compare by their 32 hex digits; rows with a null image or an unusable id
    link nothing; stale targets, found in no row of the image, are dropped.
    """
    rows = meta.select(hex_id("iuid").alias("iuid"), "image_id", hex_id("merged_into").alias("target")).filter("iuid is not null and image_id is not null")
    want = rows.filter("target is not null and target != iuid").distinct()
    there = rows.select(F.col("iuid").alias("target"), "image_id").distinct()
    return want.join(there, ["target", "image_id"], "left_semi").select("iuid", "target").distinct()


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return group_links(merge_links(table(spark, root, "meta")), "iuid", "target").select(
        F.col("node").alias("iuid"), F.col("group").alias("group_iuid")
    )


P7_FOUND_SQL = """
WITH RECURSIVE m AS (
  SELECT regexp_replace(lower(iuid), '[\\s{}-]', '', 'g') AS iuid, image_id, regexp_replace(lower(merged_into), '[\\s{}-]', '', 'g') AS target
  FROM meta WHERE image_id IS NOT NULL),
v AS (SELECT * FROM m WHERE regexp_matches(iuid, '^[0-9a-f]{32}$')),
l AS (SELECT DISTINCT a.iuid AS a, b.iuid AS b FROM v a JOIN v b ON b.iuid = a.target AND b.image_id = a.image_id WHERE a.iuid <> b.iuid),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS least FROM e UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node WHERE r.least < e.b)
SELECT node AS iuid, min(least) AS group_iuid FROM r GROUP BY node
"""
