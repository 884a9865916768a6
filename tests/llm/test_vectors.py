import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import clusters, neighbours, subset, vector_index
from gleaner.llm.registry import QUERIES
from tests.conftest import DATA

SCHEMA = "iuid string, method string, vec array<float>, h string, cell string"


def usable_vectors(spark, root):
    pdf = spark.read.parquet(f"{root}/features.parquet").filter("method = 'dinov2' and size(vec) = 64").toPandas().drop_duplicates("iuid")
    x = np.array([[np.nan if v is None else v for v in r] for r in pdf["vec"]], float)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    ids, x = pdf["iuid"].to_numpy()[good], x[good]
    order = np.argsort(ids)
    return ids[order], vector_index.unit(x[order])


def brute_pairs(ids, x, k=5, least=0.82):
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    out = set()
    for i, row in enumerate(s):
        for j in np.lexsort((np.arange(len(row)), -row))[:k]:
            if row[j] >= least:
                out.add(tuple(sorted((ids[i], ids[j]))))
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(i, "dinov2", [float(v) for v in r], "c", "d") for i, r in zip(ids, x)], SCHEMA)


def test_recall_against_brute_force(spark):
    got = {tuple(r) for r in QUERIES["p4_found"](spark, DATA).collect()}
    want = brute_pairs(*usable_vectors(spark, DATA))
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_clusters_are_the_planted_groups(spark):
    ids, x = usable_vectors(spark, DATA)
    near, first = x @ x.T >= 0.82, {}
    for i in range(len(ids)):
        for j in np.flatnonzero(near[i]):
            first.setdefault(ids[j], ids[i])
    size = {}
    for c in first.values():
        size[c] = size.get(c, 0) + 1
    want = {(i, c) for i, c in first.items() if size[c] >= 4}
    assert {tuple(r) for r in QUERIES["p2_found"](spark, DATA).collect()} == want


def test_search_equals_brute_force_at_wide_bounds():
    rng = np.random.default_rng(0)
    x = vector_index.unit(rng.standard_normal((700, 64)) + 2 * rng.standard_normal(64))
    q, r, s = vector_index.search(x[:50], x, 6, 0.0, vector_index.rotation(64), epsilon=6.0)
    for i in range(50):
        assert set(np.argsort(-(x @ x[i]), kind="stable")[:6]) <= set(r[q == i])


@pytest.mark.parametrize("n", [150, 3_000, 20_000])
def test_codes_keep_the_neighbours_at_every_size(n):
    """Recall with production bounds in one tight cell, where neighbours hardly differ."""
    rng = np.random.default_rng(n)
    x = vector_index.unit(rng.standard_normal(64) + 0.4 * rng.standard_normal((n, 64)))
    pick = rng.choice(n, 100, replace=False)
    q, r, _ = vector_index.search(x[pick], x, 6, 0.0, vector_index.rotation(64))
    hit = sum(len(set(np.argsort(-(x @ x[j]), kind="stable")[:6]) & set(r[q == i])) for i, j in enumerate(pick))
    assert hit >= 0.99 * 600


def test_mutual_pairs_end_where_no_two_clusters_link():
    """Crowd with a hub: many rows whose best is one row; rounds stay few and the result is one cluster."""
    rng = np.random.default_rng(12)
    x = vector_index.unit(rng.standard_normal(64) + 0.38 * rng.standard_normal((900, 64)))
    of, means = clusters.link_rounds(x, np.ones(900), 0.82, vector_index.rotation(64))
    left = np.unique(of)
    assert (means[left] @ means[left].T - 2 * np.eye(len(left)) < 0.82).all() and np.bincount(of).max() > 600


def test_neighbours_beyond_the_kept_ids(spark, monkeypatch):
    """More neighbours than any default, with hot copies."""
    monkeypatch.setattr(vector_index, "HOT_ROWS", 10)
    monkeypatch.setattr(vector_index, "HOT_SHARE", 10)
    rng = np.random.default_rng(11)
    base = rng.standard_normal(64)
    x = np.concatenate([np.repeat(base[None], 40, 0), base + 0.1 * rng.standard_normal((10, 64))]).astype(np.float32)
    ids = hexes(len(x))
    got = {tuple(r) for r in neighbours.nearest_pairs(table(spark, ids, x), k=12).collect()}
    assert got == brute_pairs(np.array(ids), vector_index.unit(x.astype(float)), k=12)


def hexes(n, start=0):
    return [f"{i + start:032x}" for i in range(n)]


def test_copies_link_to_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "HOT_ROWS", 10)
    monkeypatch.setattr(vector_index, "HOT_SHARE", 10)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((2, 64)).astype(np.float32)
    x = np.concatenate([np.repeat(base[:1], 40, 0), base[1:], rng.standard_normal((20, 64)).astype(np.float32)])
    ids = hexes(len(x))
    got = {tuple(r) for r in neighbours.nearest_pairs(table(spark, ids, x)).collect()}
    want = brute_pairs(np.array(ids), vector_index.unit(x.astype(float)))
    assert got == want
    assign, _ = clusters.similarity_clusters(table(spark, ids, x))
    names = {bytes(r["iuid"]).hex(): bytes(r["cluster"]).hex() for r in assign.collect()}
    assert len(names) == len(ids) and {names[i] for i in ids[:40]} == {ids[0]}


def test_blocks_of_a_crowded_cell_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal(64) + 0.1 * rng.standard_normal((150, 64)), rng.standard_normal((30, 64))]).astype(np.float32)
    ids = hexes(len(x))
    want = brute_pairs(np.array(ids), vector_index.unit(x.astype(float)))
    got = {tuple(r) for r in neighbours.nearest_pairs(table(spark, ids, x)).collect()}
    assert len(got & want) >= 0.97 * len(want)
    assign, means = clusters.similarity_clusters(table(spark, ids, x))
    names = {bytes(r["iuid"]).hex(): bytes(r["cluster"]).hex() for r in assign.collect()}
    assert len(names) == 180 and {names[i] for i in ids[:150]} == {ids[0]} and means.agg({"weight": "sum"}).first()[0] == 180


@pytest.mark.parametrize("vec", [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63])
def test_unusable_vectors_are_left_out(spark, vec):
    d = spark.createDataFrame([(hexes(1)[0], "dinov2", vec, None, None), (None, "dinov2", [1.0] * 64, None, None), (None, None, None, None, None)], SCHEMA)
    assert neighbours.vectors(d).count() == 0


def test_nothing_gives_nothing(spark):
    d = spark.createDataFrame([], SCHEMA)
    images = spark.createDataFrame([], "iuid binary, image_id long")
    assert neighbours.nearest_pairs(d).count() == 0 and clusters.similarity_clusters(d)[0].count() == 0 and subset.varied_subset(d, images, 5).count() == 0


def test_unlike_rows_stay_alone(spark):
    x = np.random.default_rng(8).standard_normal((30, 64))
    assign, means = clusters.similarity_clusters(table(spark, hexes(30), x))
    assert assign.filter("iuid = cluster").count() == assign.count() == means.count() == 30


def test_groups_beyond_the_leaders_are_found(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "SAMPLE_ROWS", 64)
    rng = np.random.default_rng(4)
    centres = np.repeat(vector_index.unit(rng.standard_normal((150, 64))), 8, 0)
    x = np.concatenate([centres + 0.045 * rng.standard_normal(centres.shape), rng.standard_normal((400, 64))])
    ids = hexes(len(x))
    assign, means = clusters.similarity_clusters(table(spark, ids, x))
    names = {bytes(r["iuid"]).hex(): bytes(r["cluster"]).hex() for r in assign.collect()}
    assert names == {i: ids[k - k % 8] if k < 1200 else i for k, i in enumerate(ids)} and means.count() == 550


def test_average_linkage_stops_at_the_floor():
    rng = np.random.default_rng(2)
    centres = vector_index.unit(rng.standard_normal((6, 64)))
    x = vector_index.unit(np.repeat(centres, 30, 0) + 0.03 * rng.standard_normal((180, 64)))
    of, _ = clusters.link_rounds(x, np.ones(180), 0.82, vector_index.rotation(64))
    assert len({tuple(of[i * 30 : i * 30 + 30]) for i in range(6)}) == 6 and all(len(set(of[i * 30 : i * 30 + 30])) == 1 for i in range(6))


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2)])
def test_hilbert_neighbours_touch(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = subset.hilbert_keys(grid, bits)
    walk = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(len(grid))) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_subset_grid_is_fitted_on_every_vector(spark, monkeypatch):
    """Two vectors far from 3,000 others move the centre and widen the cuts; copies, also of another length, count once."""
    monkeypatch.setattr(subset, "SAMPLE_ROWS", 100, raising=False)
    fit, got = subset.fit_grid, []
    monkeypatch.setattr(subset, "fit_grid", lambda *a: got.append(fit(*a)) or got[-1])
    rng = np.random.default_rng(5)
    x = (np.eye(64)[0] + 0.02 * rng.standard_normal((3_000, 64))).astype(np.float32)
    x = np.concatenate([x, -np.eye(64, dtype=np.float32)[:2], np.repeat(x[:1], 500, 0), 2 * x[1:2]])
    images = spark.createDataFrame([], "iuid binary, image_id long")
    assert subset.varied_subset(table(spark, hexes(len(x)), x), images, 40).count() == 40
    (centre, axes, cuts), u = got[0], vector_index.unit(x[:3_002].astype(float))
    flat = (u - u.mean(0)) @ axes.T
    assert np.abs(centre - u.mean(0)).max() < 1e-6
    assert np.abs(axes @ axes.T - np.eye(subset.DIMS)).max() < 1e-9 and np.allclose((flat**2).sum(0), np.linalg.svd(u - u.mean(0))[1][: subset.DIMS] ** 2, rtol=1e-4)
    assert np.allclose(cuts, np.linspace(flat.min(0), flat.max(0), 129, axis=1)[:, 1:-1], atol=1e-5)


def test_subset_has_its_size_and_spreads(spark):
    rng = np.random.default_rng(3)
    crowd = rng.standard_normal(64) + 0.01 * rng.standard_normal((300, 64))
    x = np.concatenate([crowd, rng.standard_normal((100, 64))])
    ids = hexes(len(x))
    d = table(spark, ids, x)
    images = d.select(F.unhex("iuid").alias("iuid"), F.lit(None).cast("long").alias("image_id")).limit(10)
    got = [r["iuid"] for r in subset.varied_subset(d.unionByName(d), images, 40).collect()]
    assert len(set(got)) == len(got) == 40 and sum(i in set(ids[:300]) for i in got) < 25
    for n, rest in ((300, 300), (40, 360)):  # half and a tenth of the rows
        y = np.concatenate([x[:n], rng.standard_normal((rest, 64))])
        some = [r["iuid"] for r in subset.varied_subset(table(spark, hexes(len(y)), y), images, 40).collect()]
        assert sum(i in set(ids[:n]) for i in some) / 40 <= n / len(y)
    assert subset.varied_subset(d, images, 1000).count() == 400
