"""Most similar vectors for every vector (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.columns import hex_id
from gleaner.llm.vector_index import binaries, census, distinct_vectors, fit_cells, ids_of, lists, matrix, per_cell, ranked, rotation, route, search, unit, usable, within
from gleaner.session import materialize
from gleaner.sources.tables import table

K, MIN_COS, DIM = 5, 0.82, 64
FOUND = "kind int, h long, a binary, b binary, ids array<binary>, items array<struct<far:double,id:binary>>"


def vectors(features: DataFrame, method: str = "dinov2", dim: int = DIM, as_unit: bool = False, share: float = 1.0, seed: int = 0) -> DataFrame:
    """(iuid BINARY, vec BINARY, weight, h) of the usable vectors of a method.

    Unusable vectors (null, of another length, with null, NaN or infinite
    numbers, or all zero) and rows without a usable id are left out. `as_unit`
    scales each to length 1. Below 1, `share` takes a sample of the ids, before
    anything is unpacked.
    """
    if share < 1:
        features = features.filter(F.pmod(F.xxhash64(F.lit(seed), "iuid"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = features.filter((F.col("method") == method) & (F.size("vec") == dim)).select(F.unhex(hex_id("iuid")).alias("iuid"), "vec", F.xxhash64("vec").alias("h")).filter("iuid is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) + np.float32(0)
            good = usable(x)
            if not good.all():
                x, b = x[good], b.filter(pa.array(good))
            if as_unit:
                x = unit(x.astype(np.float64)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("iuid"), binaries(x), pa.array(np.ones(b.num_rows)), b.column("h")], names=["iuid", "vec", "weight", "h"])

    return rows.mapInArrow(pack, "iuid binary, vec binary, weight double, h long")


def hashes(features: DataFrame, method: str = "dinov2", dim: int = DIM) -> DataFrame:
    """The hash h of every vector of the method and length, usable or not, for a census without Python."""
    return features.filter((F.col("method") == method) & (F.size("vec") == dim)).select(F.xxhash64("vec").alias("h"))


def _nearest(k: int, min_cos: float, hot: list[int]):
    turn = rotation(DIM)

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Final pairs (kind 0), pairs that another cell may repeat (1), partial lists (2), lists of hot vectors (3)."""
        home, asks, parts, h = (t.column(c).to_numpy() for c in ("home", "asks", "parts", "h"))
        if not home.any() or not asks.any():
            return
        order, first, counts = distinct_vectors(t)
        vec_of = np.empty(len(h), np.int64)
        vec_of[order] = np.repeat(np.arange(len(first)), counts)
        x = unit(matrix(t.column("vec"))[order[first]].astype(np.float64))
        ids, sizes = ids_of(t.column("ids"))
        names, rank = ranked(ids)
        row = np.repeat(np.arange(len(h)), sizes)

        def held(rows: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """The vectors of some rows, where their distinct ids begin, how many they are, and the ids; the `most` smallest."""
            some = rows[row]
            vec, id_ = np.divmod(np.unique(vec_of[row[some]] * len(names) + rank[some]), max(len(names), 1))
            start = np.flatnonzero(np.r_[True, vec[1:] != vec[:-1]])
            n = np.diff(np.r_[start, len(vec)])
            vec = vec[start]
            if most is not None and n.max() > most:
                id_ = id_[within(n) < most]
                n = np.minimum(n, most)
                start = np.cumsum(n) - n
            return vec, start, n, id_

        refs, at, n_ids, ref_ids = held(home, k + 1)
        queries, q_at, q_n, q_ids = held(asks, None)
        qi, xi, cos = search(x[queries], x[refs], k + 1, min_cos, turn)
        cos = np.round(cos, 9)
        qi, xi, cos = (c[cos >= min_cos] for c in (qi, xi, cos))
        # each match stands for the ids of its vector; a query keeps its k + 1 nearest ids
        n = n_ids[xi]
        other = ref_ids[np.repeat(at[xi], n) + within(n)]
        qi, cos = np.repeat(qi, n), np.repeat(cos, n)
        by = np.lexsort((other, -cos, qi))
        qi, cos, other = qi[by], cos[by], other[by]
        again = np.zeros(len(qi), bool)
        seen = np.lexsort((np.arange(len(qi)), other, qi))
        again[seen[1:]] = (qi[seen][1:] == qi[seen][:-1]) & (other[seen][1:] == other[seen][:-1])
        qi, cos, other = qi[~again], cos[~again], other[~again]
        found = np.bincount(qi, minlength=len(queries))
        keep = within(found) <= k
        qi, cos, other = qi[keep], cos[keep], other[keep]
        found = np.minimum(found, k + 1)
        starts = np.cumsum(found) - found
        lead = order[first[queries]]
        most_parts = np.zeros(len(first), np.int64)
        np.maximum.at(most_parts, vec_of[asks], parts[asks])
        is_hot = np.isin(h[lead], np.array(hot, np.int64))
        alone = (most_parts[queries] == 1) & ~is_hot
        # lone searches are over: every id of theirs takes its k nearest others
        q = np.flatnonzero(alone & (found > 0))
        me = q_ids[np.repeat(q_at[q], q_n[q]) + within(q_n[q])]
        q = np.repeat(q, q_n[q])
        n = found[q]
        near = np.repeat(starts[q], n) + within(n)
        mine, theirs, place = np.repeat(me, n), other[near], within(n)
        self_ = theirs == mine
        before = np.cumsum(self_) - self_
        place = place - (before - np.repeat(before[np.cumsum(n) - n], n)) if len(n) else place
        good = ~self_ & (place < k)
        low, high = np.divmod(np.unique((np.minimum(mine, theirs) * len(names) + np.maximum(mine, theirs))[good]), max(len(names), 1))
        whole = np.zeros(len(names), bool)
        lone = np.flatnonzero(alone)
        whole[q_ids[np.repeat(q_at[lone], q_n[lone]) + within(q_n[lone])]] = True
        open_ = np.flatnonzero(~alone)
        whole[q_ids[np.repeat(q_at[open_], q_n[open_]) + within(q_n[open_])]] = False
        kind = np.where(whole[low] & whole[high], 0, 1)
        for lo in range(0, len(low), 50_000):
            a, b, some = (c[lo : lo + 50_000] for c in (low, high, kind))
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), none, binaries(names[a]), binaries(names[b]), pa.nulls(len(a), IDS), pa.nulls(len(a), ITEMS)], names=COLUMNS)
        for lo in range(0, len(open_), 10_000):
            q = open_[lo : lo + 10_000]
            q = q[found[q] > 0]
            n, own = found[q], np.where(is_hot[q], 0, q_n[q])
            near, me = np.repeat(starts[q], n) + within(n), np.repeat(q_at[q], own) + within(own)
            items = pa.StructArray.from_arrays([pa.array(-cos[near]), binaries(names[other[near]])], names=["far", "id"])
            none = pa.nulls(len(q), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(is_hot[q], 3, 2).astype(np.int32)), pa.array(h[lead[q]]), none, none, lists(np.r_[0, np.cumsum(own)], binaries(names[q_ids[me]])), lists(np.r_[0, np.cumsum(n)], items)], names=COLUMNS
            )

    return run


IDS, ITEMS = pa.list_(pa.binary()), pa.list_(pa.struct([("far", pa.float64()), ("id", pa.binary())]))
COLUMNS = ["kind", "h", "a", "b", "ids", "items"]


def nearest_pairs(features: DataFrame, k: int = K, min_cos: float = MIN_COS) -> DataFrame:
    """Distinct (iuid_a, iuid_b), iuid_a < iuid_b, where one is among the other's k most similar.

    Similarity is the cosine in double, rounded to 9 decimals, of at least
    min_cos; ties go to the smaller iuid. Copies of a vector are searched once
    and each keeps its own k neighbours; an id with several vectors is a
    neighbour by any of them, and never of itself. An empty table gives no pairs.
    """
    packed = vectors(features)
    rows, hot = census(hashes(features))
    found = materialize(per_cell(route(packed, fit_cells(lambda share, seed: vectors(features, share=share, seed=seed), rows), hot, kept=k + 1).drop("weight"), 2 * rows, _nearest(k, min_cos, hot), FOUND), "neighbours")
    # an id that several cells name keeps its nearest mention
    merged = F.array_distinct(F.transform(F.array_sort(F.flatten(F.collect_list("items"))), lambda x: x["id"])).alias("near")
    lists_ = found.filter("kind = 2").groupBy("h").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"), merged).select("near", F.explode("ids").alias("me"))
    if hot:
        best = found.filter("kind = 3").groupBy("h").agg(merged)
        lists_ = lists_.unionByName(packed.filter(F.col("h").isin(hot)).join(F.broadcast(best), "h").select("near", F.col("iuid").alias("me")))
    lists_ = lists_.select("me", F.explode(F.slice(F.array_remove("near", F.col("me")), 1, k)).alias("other")).select(
        F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b")
    )
    rest = found.filter("kind = 1").select("a", "b").unionByName(lists_).distinct()
    pairs = found.filter("kind = 0").select("a", "b").unionByName(rest)
    return pairs.select(F.lower(F.hex("a")).alias("iuid_a"), F.lower(F.hex("b")).alias("iuid_b"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return nearest_pairs(table(spark, root, "features"))
