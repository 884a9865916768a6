"""Similarity clusters by reciprocal-nearest-neighbour average linkage (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gleaner.llm.merge_groups import group_links
from gleaner.llm.neighbours import DIM, MIN_COS, hashes, vectors
from gleaner.llm.vector_index import binaries, census, distinct_vectors, fit_cells, ids_of, matrix, per_cell, ranked, rotation, route, search, unit
from gleaner.operators.skew import keyed_join
from gleaner.session import drop_scratch, materialize
from gleaner.sources.tables import table

GRAPH_K, MIN_SIZE = 6, 4
#: Rows of a crowded cell that the first pass links at once; later passes link what becomes of them.
LINK_ROWS = 4_096
#: Rows of small cells that take their rounds together.
TOGETHER = 8_192


def link_rounds(means: np.ndarray, weight: np.ndarray, floor: float, turn: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cluster number (a row number) of each row, and the means at those numbers, by average linkage of at least `floor`.

    Rows of one cell follow each other from each of `starts` and are linked among
    themselves only; all cells take their rounds together. A cluster is the
    weighted mean of its unit vectors, so the inner product of two means is their
    average linkage. Candidates form a sparse graph: links between clusters that
    are among each other's GRAPH_K best. Every round merges all mutual best pairs
    of the graph; when it holds no more, it is made anew from the means. The best
    pair of all is always linked, so the end is reached only when no two clusters
    of a cell link with `floor`.
    """
    n = len(means)
    of, means, weight = np.arange(n), means.copy(), weight.astype(np.float64).copy()
    ends = np.r_[starts[1:], n] if starts is not None else np.array([n])
    pending = [np.arange(lo, hi) for lo, hi in zip(starts if starts is not None else [0], ends)]
    while pending:
        graph = [_links(means, alive, floor, turn) for alive in pending if len(alive) > 1]
        i, j, sim = (np.concatenate(c) for c in zip(*graph)) if graph else (np.zeros(0, int),) * 3
        grown = np.zeros(n, bool)
        while len(i):
            top, best = np.full(n, -1.0), np.full(n, n)
            np.maximum.at(top, i, sim)
            hit = sim == top[i]
            a, b = i[hit], j[hit]
            np.minimum.at(best, a, b)
            pair = (a < b) & (best[a] == b) & (best[b] == a)
            low, gone = a[pair], b[pair]
            total = weight[low] + weight[gone]
            means[low] = (means[low] * weight[low, None] + means[gone] * weight[gone, None]) / total[:, None]
            weight[low] = total
            grown[low] = True
            to, touched = np.arange(n), np.zeros(n, bool)
            to[gone] = low
            of = to[of]
            touched[low] = touched[gone] = True
            old = touched[i] | touched[j]
            a, b = np.divmod(np.unique(to[i[old]] * n + to[j[old]]), n)
            a, b = a[a != b], b[a != b]
            s = np.einsum("ij,ij->i", means[a], means[b])
            ok = s >= floor
            i, j, sim = np.r_[i[~old], a[ok]], np.r_[j[~old], b[ok]], np.r_[sim[~old], s[ok]]
        pending = [np.unique(of[alive]) for alive in pending if grown[alive].any()]
    return of, means


def _links(means: np.ndarray, alive: np.ndarray, floor: float, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both directions of the links between clusters among each other's GRAPH_K best, with their linkage of at least `floor`."""
    m, x = len(alive), unit(means[alive])
    q, r, _ = search(x, x, GRAPH_K + 1, floor, turn)
    key, back = q * m + r, r * m + q
    i, j = np.divmod(np.intersect1d(key[q != r], back, assume_unique=True), m)
    i, j = alive[i], alive[j]
    sim = np.einsum("ij,ij->i", means[i], means[j])
    ok = sim >= floor
    return i[ok], j[ok], sim[ok]


LINKED = "kind int, iuid binary, cluster binary, vec binary, weight double, h long"


def _link(floor: float):
    turn = rotation(DIM)

    def run(cells: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        """(iuid, cluster) of rows (kind 0), (cluster, mean, weight) of clusters (1), (h, cluster) of vectors (2), of some cells."""
        t = pa.concat_tables(cells)
        cell = np.repeat(np.arange(len(cells)), [c.num_rows for c in cells])
        ids, sizes = ids_of(t.column("ids"))
        names, rank = ranked(ids)
        row = np.repeat(np.arange(len(cell)), sizes)
        # distinct vectors of each cell, in the order of their smallest ids
        order, first, counts = distinct_vectors(t, cell)
        least_of_row = np.full(len(order), len(names))
        np.minimum.at(least_of_row, row, rank)
        least = np.minimum.reduceat(least_of_row[order], first)
        by = np.lexsort((least, cell[order[first]]))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        vec_of = np.empty(len(order), np.int64)
        vec_of[order] = np.repeat(place, counts)
        least, lead = least[by], order[first[by]]
        weight = np.add.reduceat(t.column("weight").to_numpy()[order], first)[by]
        starts = np.flatnonzero(np.r_[True, cell[lead][1:] != cell[lead][:-1]])
        of, centre = link_rounds(matrix(t.column("vec"))[lead].astype(np.float64), weight, floor, turn, starts)
        head = np.full(len(by), len(names))
        np.minimum.at(head, of, least)
        total = np.zeros(len(by))
        np.add.at(total, of, weight)
        none = pa.nulls(len(row), pa.binary())
        cluster = names[head[of[vec_of[row]]]]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(row), np.int32)), binaries(ids), binaries(cluster), none, pa.nulls(len(row), pa.float64()), pa.nulls(len(row), pa.int64())], names=NAMES)
        own = np.flatnonzero(of == np.arange(len(by)))
        none = pa.nulls(len(own), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(own), np.int32)), none, binaries(names[head[own]]), binaries(centre[own].astype(np.float32)), pa.array(total[own]), pa.nulls(len(own), pa.int64())], names=NAMES
        )
        marked = np.flatnonzero(t.column("hot").to_numpy())
        none = pa.nulls(len(marked), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(marked), 2, np.int32)), none, binaries(names[head[of[vec_of[marked]]]]), none, pa.nulls(len(marked), pa.float64()), pa.array(t.column("h").to_numpy()[marked])], names=NAMES
        )

    return run


NAMES = ["kind", "iuid", "cluster", "vec", "weight", "h"]


def _first_level(features: DataFrame, packed: DataFrame, rows: int, hot: list[int], floor: float) -> DataFrame:
    """Clusters within the cells of the index; each row is linked where it is at home."""
    cells = fit_cells(lambda share, seed: vectors(features, as_unit=True, share=share, seed=seed), rows)
    cells.cut(LINK_ROWS)
    at_home = route(packed, cells, hot, probes=False).filter("home").withColumn("hot", F.col("h").isin(hot) if hot else F.lit(False))
    return per_cell(at_home, rows, _link(floor), LINKED, TOGETHER)


def _graph(floor: float):
    turn = rotation(DIM)

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Pairs of a searching cluster and one of its GRAPH_K best in the cell whose linkage reaches the floor."""
        home, asks = (np.flatnonzero(t.column(c).to_numpy()) for c in ("home", "asks"))
        if not len(home) or not len(asks):
            return
        ids, _ = ids_of(t.column("ids"))
        means = matrix(t.column("vec")).astype(np.float64)
        x = unit(means)
        qi, xi, _ = search(x[asks], x[home], GRAPH_K + 1, floor, turn)
        qi, xi = asks[qi], home[xi]
        keep = (np.einsum("ij,ij->i", means[qi], means[xi]) >= floor) & (ids[qi].view("V16") != ids[xi].view("V16"))
        yield pa.RecordBatch.from_arrays([binaries(ids[qi[keep]]), binaries(ids[xi[keep]])], names=["a", "b"])

    return run


def _next_level(nodes: DataFrame, count: int, floor: float, level: int) -> DataFrame:
    """One pass over the clusters of the last: a sparse graph across cells, of the index's coarse cells anew, and its components linked.

    Every cluster is indexed in one cell and searches several. Clusters without a link stay as they are.
    """
    pick = lambda share, seed: nodes.filter(F.pmod(F.xxhash64(F.lit(seed), "iuid"), F.lit(1 << 30)) < int(share * (1 << 30)))
    cells = fit_cells(pick, count, seed=11 + level, leaders=False)
    found = per_cell(route(nodes, cells, [], kept=1), 4 * count, _graph(floor), "a binary, b binary")
    pairs = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "closest")
    parts = materialize(group_links(pairs, "a", "b").select(F.col("node").alias("iuid"), F.col("group").alias("component")), "parts")
    drop_scratch(nodes.sparkSession, pairs)
    one = F.lit(0)
    met = nodes.join(parts, "iuid").select(F.xxhash64("component").alias("cell"), one.alias("ib"), one.alias("qb"), "vec", "weight", "h", F.array("iuid").alias("ids"), F.lit(False).alias("hot"))
    rest = nodes.join(parts, "iuid", "left_anti").select(F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("iuid"), F.col("iuid").alias("cluster"), "vec", "weight", F.lit(None).cast("long").alias("h"))
    return per_cell(met, count // 8, _link(floor), LINKED, TOGETHER).unionByName(rest)


def similarity_clusters(features: DataFrame, floor: float = MIN_COS) -> tuple[DataFrame, DataFrame]:
    """(iuid, cluster) of every usable vector's id, and (cluster, vec, weight) of every cluster's mean.

    All ids are 16 bytes; a cluster's name is its smallest iuid. Clusters merge
    while the mean cosine between their members is at least `floor`. The first
    pass links rows within cells; further passes link the means across cells, each
    with other cells, until one merges nothing. Copies count as many members; an
    id with several vectors goes to its smallest cluster. An empty table gives two
    empty results.
    """
    spark = features.sparkSession
    packed = vectors(features, as_unit=True)
    rows, hot = census(hashes(features))
    first = materialize(_first_level(features, packed, rows, hot, floor), "clusters")
    assign = first.filter("kind = 0").select("iuid", "cluster")
    if hot:
        names = first.filter("kind = 2").groupBy("h").agg(F.min("cluster").alias("cluster"))
        assign = assign.unionByName(packed.filter(F.col("h").isin(hot)).join(F.broadcast(names), "h").select("iuid", "cluster"))
    assign = assign.groupBy("iuid").agg(F.min("cluster").alias("cluster"))
    means, last, moved, level = first.filter("kind = 1"), None, None, 0
    count, before = means.count(), None
    while count > 1 and count != before:
        level += 1
        nodes = means.select(F.col("cluster").alias("iuid"), "vec", "weight", F.xxhash64("cluster").alias("h"))
        made = materialize(_next_level(nodes, count, floor, level).filter("kind = 1 or (kind = 0 and iuid != cluster)"), "clusters")
        if last is not None:
            drop_scratch(spark, last)
        means, last, before = made.filter("kind = 1"), made, count
        count = means.count()
        if count < before:
            step = made.filter("kind = 0").select(F.col("iuid").alias("name"), F.col("cluster").alias("next"))
            now = step
            if moved is not None:
                onward = step.select(F.col("name").alias("next"), F.col("next").alias("to"))
                now = moved.join(onward, "next", "left").select("name", F.coalesce("to", "next").alias("next")).unionByName(step)
            now = materialize(now, "moved")
            if moved is not None:
                drop_scratch(spark, moved)
            moved = now
    if moved is not None:
        assign = keyed_join(assign, moved.withColumnRenamed("name", "cluster"), "cluster", "left").select("iuid", F.coalesce("next", "cluster").alias("cluster"))
    return assign, means.select("cluster", "vec", "weight")


def cluster_sizes(assign: DataFrame, least: int = MIN_SIZE) -> DataFrame:
    return assign.groupBy("cluster").agg(F.count("*").alias("size")).filter(F.col("size") >= least)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    assign, _ = similarity_clusters(table(spark, root, "features"))
    return keyed_join(assign, cluster_sizes(assign).select("cluster"), "cluster").select(
        F.lower(F.hex("iuid")).alias("iuid"), F.lower(F.hex("cluster")).alias("cluster_iuid")
    )


def p2_clusters(spark: SparkSession, root: str, typical: int = 3, salts: int = 32) -> DataFrame:
    """Every cluster of MIN_SIZE ids or more with its size and its most typical members, nearest to the mean first.

    The best of a cluster are picked in `salts` parts first, so a cluster with a
    third of all rows is ranked by many tasks.
    """
    features = table(spark, root, "features")
    assign, means = similarity_clusters(features)
    sizes = cluster_sizes(assign)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(b.num_rows, -1).astype(np.float64) for c in ("vec", "mean"))
            far = 1 - np.einsum("ij,ij->i", x, m) / np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("cluster"), b.column("iuid"), pa.array(np.round(far, 9))], names=["cluster", "iuid", "far"])

    named = means.join(sizes.select("cluster"), "cluster").select("cluster", F.col("vec").alias("mean"))
    members = assign.join(vectors(features, as_unit=True).select("iuid", "vec"), "iuid").select("cluster", "iuid", "vec")
    members = keyed_join(members, named, "cluster")
    scored = members.select("cluster", "iuid", "vec", "mean").mapInArrow(score, "cluster binary, iuid binary, far double")
    part = W.partitionBy("cluster", "salt").orderBy("far", "iuid")
    few = scored.distinct().withColumn("salt", F.pmod(F.xxhash64("iuid"), F.lit(salts))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= typical)
    top = few.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "iuid"))), 1, typical).alias("top"))
    return sizes.join(top, "cluster").select(
        F.lower(F.hex("cluster")).alias("cluster_iuid"), "size", F.transform("top", lambda t: F.lower(F.hex(t["iuid"]))).alias("typical_iuids")
    )
