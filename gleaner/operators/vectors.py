"""Vector algebra and exact blocked nearest-neighbour search. Rows: iuid, vec, and what else a caller carries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.operators.components import connected_components
from gleaner.session import materialize

BLOCK_ROWS, EPS = 4_096, 1e-9


def norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(vec: str) -> Column:
    n = norm(vec) + EPS
    return F.transform(vec, lambda x: x.cast("double") / n)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def column_stats(rows: DataFrame, vec: str) -> DataFrame:
    """(pos, mean, std) of each dimension over all rows, with the population deviation; null vectors are skipped."""
    return rows.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def fuse(rows: DataFrame, blocks: dict[str, float]) -> DataFrame:
    """rows plus `fused`: each block scaled to unit length, standardised by all rows, weighted and joined in order.

    The statistics (one number per dimension) are joined as one row.
    """
    out, parts = rows, []
    for k, (vec, weight) in enumerate(blocks.items()):
        out = out.withColumn(f"__u{k}", unit(vec))
        s = column_stats(out, f"__u{k}").agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias(f"__s{k}"))  # one row of `dim` entries
        out = out.crossJoin(F.broadcast(s))
        parts.append(F.zip_with(f"__u{k}", f"__s{k}", lambda x, m: (x - m["mean"]) / (m["std"] + EPS) * F.lit(weight)))
    return out.withColumn("fused", F.concat(*parts)).drop(*[f"__{c}{k}" for c in "us" for k in range(len(blocks))])


def nearest(queries: DataFrame, refs: DataFrame, k: int, other_label: bool = False, per_label: bool = False, bias: bool = False, same_label: bool = False) -> DataFrame:
    """(q, r, label, score, cos, rank): each query's k best rows of refs by cosine, never itself; ties go to the smaller id.

    queries(iuid, vec, label), refs(iuid, vec, label, bias). other_label admits
    only refs of another label, same_label only those of its own; per_label gives the k best of every label; bias
    ranks by 2 cos - the ref's bias. Both sides are dealt into blocks of about
    BLOCK_ROWS and every pair of blocks is one matrix product, so a task's work is
    bounded and nothing is broadcast. Null vectors are skipped.
    """
    nq, nr = (max(1, -(-d.count() // BLOCK_ROWS)) for d in (queries, refs))
    side = lambda d, mine, n, other, m, b, is_ref: d.filter("vec is not null").select(
        "iuid", F.col("vec").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"), b.alias("bias"), F.lit(is_ref).alias("is_ref"),
        F.pmod(F.xxhash64("iuid"), F.lit(n)).alias(mine), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other),
    )
    zero = F.lit(0.0)
    rows = side(queries, "qb", nq, "rb", nr, zero, False).unionByName(side(refs, "rb", nr, "qb", nq, F.col("bias").cast("double") if bias else zero, True))
    id_type = dict(queries.dtypes)["iuid"]

    def product(t: pa.Table) -> pa.Table:
        is_ref = t.column("is_ref").to_numpy()
        x = np.asarray(t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(is_ref), -1)
        x = x / (np.sqrt((x * x).sum(1))[:, None] + EPS)
        ids, labels, biases = np.array(t.column("iuid").to_pylist(), object), np.array(t.column("label").to_pylist(), object), t.column("bias").to_numpy()
        r = np.flatnonzero(is_ref)
        r = r[np.argsort(ids[r], kind="stable")]
        q = np.flatnonzero(~is_ref)
        out: list[tuple[np.ndarray, ...]] = []
        kinds = sorted({l for l in labels[r] if l is not None}) if per_label else [None]
        for lo in range(0, len(q), 512):
            part = q[lo : lo + 512]
            cos = x[part] @ x[r].T
            score = 2 * cos - biases[r] if bias else cos.copy()
            score[ids[part][:, None] == ids[r][None, :]] = -np.inf
            if other_label:
                score[labels[part][:, None] == labels[r][None, :]] = -np.inf
            if same_label:
                score[labels[part][:, None] != labels[r][None, :]] = -np.inf
            for kind in kinds:
                s = np.where(labels[r] == kind, score, -np.inf) if per_label else score
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                i, j = np.repeat(np.arange(len(part)), top.shape[1]), top.ravel()
                good = s[i, j] > -np.inf
                i, j = i[good], j[good]
                out.append((part[i], r[j], s[i, j], cos[i, j]))
        qi, ri, best, near = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
        take = lambda c, at: t.column(c).take(pa.array(at))
        return pa.table({"q": take("iuid", qi), "r": take("iuid", ri), "label": take("label", ri), "score": pa.array(best), "cos": pa.array(near)})

    found = rows.groupBy("qb", "rb").applyInArrow(product, f"q {id_type}, r {id_type}, label string, score double, cos double")
    keys = "q, label" if per_label else "q"
    return found.withColumn("rank", F.expr(f"row_number() over (partition by {keys} order by score desc, r)")).filter(F.col("rank") <= k)


def finch_level(rows: DataFrame) -> DataFrame:
    """(iuid, cluster): components of the graph that links each row with its nearest neighbour; a lone row is its own cluster."""
    links = nearest(rows, rows, 1).select("q", "r")
    parts = connected_components(materialize(links, "links"), "q", "r")
    return rows.select("iuid").join(parts.withColumnRenamed("node", "iuid"), "iuid", "left").select("iuid", F.coalesce("component", "iuid").alias("cluster"))


def cluster_means(rows: DataFrame, member: DataFrame) -> DataFrame:
    """(iuid = cluster, vec = its mean, label = null)."""
    cells = rows.select("iuid", F.posexplode("vec").alias("pos", "x")).join(member, "iuid").groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = cells.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
    return packed.select(F.col("cluster").alias("iuid"), "vec", F.lit(None).cast("string").alias("label"))


def finch(rows: DataFrame, max_levels: int = 20) -> DataFrame:
    """(iuid, level, cluster) of the hierarchy: nearest-neighbour components of rows, then of their clusters' means, until one or no change is left."""
    at = finch_level(rows)
    member, count, levels = at, rows.count(), []
    for level in range(max_levels):
        member = materialize(member, "level")
        now = member.select("cluster").distinct().count()
        if now == count and level:
            break
        levels.append(member.select("iuid", F.lit(level).alias("level"), "cluster"))
        if now <= 1:
            break
        count = now
        up = finch_level(materialize(cluster_means(rows, member), "means")).select(F.col("iuid").alias("cluster"), F.col("cluster").alias("above"))
        member = member.join(up, "cluster").select("iuid", F.col("above").alias("cluster"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def default_level(counts: DataFrame, rows: int) -> DataFrame:
    """The level of counts(level, n_clusters) whose count is nearest to the root of `rows`, in logarithm; the first wins ties."""
    return counts.agg(F.min_by("level", F.struct(F.abs(F.log(F.col("n_clusters").cast("double")) - F.log(F.sqrt(F.lit(float(rows))))), "level")).alias("level"))


def level_counts(levels: DataFrame) -> DataFrame:
    return levels.groupBy("level").agg(F.countDistinct("cluster").alias("n_clusters"))


def labels_at(levels: DataFrame, level: int | None = None) -> DataFrame:
    """(iuid, pid) at a level of finch(), clamped to those there are; by default at the default level. pid counts clusters from 0 by falling size."""
    counts = level_counts(levels)
    rows = levels.filter("level = 0").count()
    last = counts.agg(F.max("level")).first()[0] or 0
    at = default_level(counts, rows).first()[0] if level is None else min(max(level, 0), last)
    here = levels.filter(F.col("level") == at)
    sizes = here.groupBy("cluster").agg(F.count("*").alias("size"))
    number = sizes.selectExpr("cluster", "row_number() over (order by size desc, cluster) - 1 as pid")  # one row per cluster of the level
    return here.join(number, "cluster").select("iuid", F.col("pid").cast("int").alias("pid"))


def exact_count(rows: DataFrame, levels: DataFrame, k: int) -> DataFrame:
    """(iuid, cluster): just k clusters, from the coarsest level of finch() with k or more, by joining the two nearest means again and again.

    The level's means are the input of the joining; its size is checked against BLOCK_ROWS.
    """
    fit = level_counts(levels).filter(F.col("n_clusters") >= k).agg(F.max("level").alias("level")).first()["level"]
    member = levels.filter(F.col("level") == (0 if fit is None else fit)).select("iuid", "cluster")
    sizes = {r["cluster"]: r["count"] for r in member.groupBy("cluster").count().limit(BLOCK_ROWS + 1).collect()}
    if len(sizes) > BLOCK_ROWS:
        raise ValueError(f"no level has {k} to {BLOCK_ROWS} clusters")
    means = sorted((r["iuid"], r["vec"]) for r in cluster_means(rows, member).collect())
    names, x = [m[0] for m in means], np.array([m[1] for m in means], float)
    n, head, alive = np.array([sizes[c] for c in names], float), list(range(len(names))), np.ones(len(names), bool)
    u = x / np.maximum(np.linalg.norm(x, axis=1), EPS)[:, None]
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    while alive.sum() > max(k, 1):
        i, j = sorted(np.unravel_index(sim.argmax(), sim.shape))
        x[i], n[i] = (x[i] * n[i] + x[j] * n[j]) / (n[i] + n[j]), n[i] + n[j]
        head = [i if h == j else h for h in head]
        alive[j] = False
        sim[j] = sim[:, j] = -2
        row = np.where(alive, (x @ x[i]) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]), EPS), -2)
        row[i] = -2
        sim[i] = sim[:, i] = row
    to = rows.sparkSession.createDataFrame([(c, names[h]) for c, h in zip(names, head)], f"cluster {dict(member.dtypes)['cluster']}, joined {dict(member.dtypes)['cluster']}")
    return member.join(F.broadcast(to), "cluster").select("iuid", F.col("joined").alias("cluster"))


def clusters_within(rows: DataFrame, group: str) -> DataFrame:
    """(iuid, group, k): first-level clusters among the rows of each group, numbered from 0 by falling size; a lone row is a cluster."""
    some = rows.select("iuid", "vec", F.col(group).cast("string").alias("label"))
    near = nearest(some, some, 1, same_label=True)
    parts = connected_components(materialize(near.select("q", "r"), "links"), "q", "r").withColumnRenamed("node", "iuid")
    named = rows.select("iuid", group).join(parts, "iuid", "left").withColumn("component", F.coalesce("component", "iuid"))
    sizes = named.groupBy(group, "component").agg(F.count("*").alias("size")).withColumn("k", F.expr(f"row_number() over (partition by {group} order by size desc, component) - 1"))
    return named.join(sizes.drop("size"), [group, "component"]).select("iuid", group, "k")


def cluster_key(**spec) -> str:
    """The name under which the result of a clustering with these settings is kept."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()


def kmeans(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(iuid, cluster) by k-means over unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.filter("vec is not null").select("iuid", array_to_vector(unit("vec")).alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("iuid", F.col("prediction").alias("cluster"))


def biased(rows: DataFrame, coords: str, weight: float) -> DataFrame:
    """rows plus `matrix`: the unit vector followed by the place, weighted."""
    return rows.withColumn("matrix", F.concat(unit("vec"), F.transform(coords, lambda x: x.cast("double") * weight)))


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))
