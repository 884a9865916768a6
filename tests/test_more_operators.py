import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import masks, refine
from gleaner.operators import boxes, events, sets, stats, suggest, vectors
from gleaner.sources import documents, plugins
from gleaner.sources.store import Store


def links(seed, n=40):
    r = random.Random(seed)
    return sorted({(r.randrange(12), r.randrange(100, 112)): round(r.random(), 2) for _ in range(n)}.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_a_walk(spark, seed):
    data = [(e, e, t, s) for (e, t), s in links(seed)]
    d = spark.createDataFrame(data, "entry long, key long, target long, score double")
    want, used = set(), set()
    for e in sorted({r[0] for r in data}):
        free = [(-s, t) for x, _, t, s in data if x == e and t not in used]
        if free:
            want.add((e, min(free)[1]))
            used.add(min(free)[1])
    assert {tuple(r) for r in boxes.greedy_match(d).collect()} == want
    want, es, ts = set(), set(), set()
    for _, e, t in sorted((-s, e, t) for e, _, t, s in data):
        if e not in es and t not in ts:
            want.add((e, t))
            es.add(e)
            ts.add(t)
    assert {tuple(r) for r in boxes.best_match(d.drop("key")).collect()} == want
    assert boxes.greedy_match(d.limit(0)).count() == 0 and boxes.best_match(d.limit(0)).count() == 0


def test_capped_groups_join_in_order(spark):
    d = spark.createDataFrame([(1, 1, 2, 0.1), (1, 2, 3, 0.2), (1, 3, 4, 0.3), (1, 5, 6, 0.05), (2, 7, 8, 0.1)], "image_id long, a long, b long, d double")
    assert {r["iuid"]: r["group"] for r in boxes.capped_groups(d, 2).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7}
    assert {r["iuid"]: r["group"] for r in boxes.capped_groups(d, None).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 7}


@pytest.mark.parametrize("depth", [3, 200])
def test_replay_equals_stacks(spark, depth):
    r = random.Random(depth)
    rows = [(i, r.choice("ab"), r.choice(["assign"] * 4 + ["undo"] * 3 + ["redo"] * 2)) for i in range(200)] + [(120, "a", "barrier")]
    rows = [x for x in rows if x != (120, "a", "assign")]
    rows = [x for x in rows if x[0] != 120 or x[2] == "barrier"]
    want = set()
    for who in "ab":
        done, taken = [], []
        for seq, actor, op in sorted(rows):
            if op == "barrier":
                want |= set(done)
                done, taken = [], []
            elif actor != who:
                continue
            elif op == "undo":
                taken += [done.pop()] if done else []
            elif op == "redo":
                done += [taken.pop()] if taken else []
            else:
                done.append(seq)
                taken = []
            if len(done) > depth:
                want.add(done.pop(0))
        want |= set(done)
    d = spark.createDataFrame(rows, "seq long, actor string, op string")
    assert {x["seq"] for x in events.replay(d, depth).collect()} == want
    assert events.replay(d.limit(0)).count() == 0


def test_fold_of_odd_commands(spark):
    rows = [(1, "assign", 1, "a", "m", 0.5), (2, "unreject", 1, None, None, None), (3, "dedup", 2, None, None, None), (4, "unreject", 2, None, None, None), (5, "assign", 3, "a", "m", None), (6, "dedup", 3, None, None, None), (7, "accept_masks", 3, None, None, None), (8, "assign", 4, "b", "m", 0.1), (9, "background", 4, None, None, None)]
    got = {r["iuid"]: tuple(r)[1:] for r in events.fold(spark.createDataFrame(rows, "seq long, op string, iuid long, class string, source string, score double")).collect()}
    assert got == {1: ("a", False, "m", 0.5, False), 2: (None, False, None, None, False), 3: ("a", True, "m", None, True), 4: (None, True, "m", 0.1, False)}


def test_sources_keep_their_own_names(spark):
    d = spark.createDataFrame([('{"draw": {}}', True), ('{"draw": {}}', False), ('{"manual": true}', False), ('{"box_pick": {"by": ["sam", "x"]}}', True), ('{"remask": {"backend": "m"}, "ckpt": "c"}', False), ("{}", False), (None, None)], "provenance string, refined boolean")
    got = [r[0] for r in d.select(stats.method_of("provenance", F.col("refined"), F.lit("src"))).collect()]
    assert got == ["hand-drawn", "src", "manual", "sam", "m", "src", "src"]


def test_tiles_find_pairs_of_any_size(spark):
    r = random.Random(4)
    rows = [(i, 1, x := r.randrange(0, 4000), y := r.randrange(0, 4000), x + (w := r.choice([3, 40, 900, 4000])), y + (h := r.choice([5, 60, 700])), float(w * h)) for i in range(150)]
    got = {(p["a"]["iuid"], p["b"]["iuid"]) for p in boxes.overlapping_pairs(spark.createDataFrame(rows, "iuid long, image_id long, x0 long, y0 long, x1 long, y1 long, area double")).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3])}
    assert got == want


def test_pooled_candidates_take_turns(spark):
    rows = [(1, 1, 0, 0, 10, 10, 100.0, 0.9, "s"), (2, 1, 0, 0, 10, 10, 100.0, 0.5, "t"), (3, 1, 50, 50, 60, 60, 100.0, 0.8, "s"), (4, 1, 80, 80, 90, 90, 100.0, 0.1, "t")]
    got = {r["iuid"]: r["agree"] for r in boxes.pooled_candidates(spark.createDataFrame(rows, "iuid long, image_id long, x0 int, y0 int, x1 int, y1 int, area double, score double, assign_source string")).collect()}
    assert got == {1: 2, 3: 1, 4: 1}


def pooled_by_walk(rows, same):
    """The definition, box by box; rows(iuid, image, x0, y0, x1, y1, area, score, source)."""
    def near(a, b):
        i = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return None not in (a[1], b[1]) and a[1] == b[1] and i > 0 and i / (a[6] + b[6] - i + 1e-6) >= same

    turn, seen = {}, {}
    for r in sorted(rows, key=lambda r: (-r[7], r[0])):
        turn[r[0]] = seen[r[1], r[8]] = seen.get((r[1], r[8]), 0) + 1
    kept = []
    for r in sorted(rows, key=lambda r: (turn[r[0]], r[8] is not None, r[8] or "", r[0])):
        if not any(near(r, k) for k in kept):
            kept.append(r)
    return {(r[1], r[0], len({b[8] for b in rows if b is r or near(b, r)} - {None})) for r in kept}


BOXES = "iuid long, image_id long, x0 int, y0 int, x1 int, y1 int, area double, score double, assign_source string"


@pytest.mark.parametrize("crowded", [256, 12])
def test_pooled_candidates_equal_a_walk(spark, monkeypatch, crowded):
    monkeypatch.setattr(boxes, "CROWDED", crowded)
    r = random.Random(crowded)
    rows = []
    for i in range(400):
        x, y, w, h = r.randrange(3), r.randrange(3), r.choice([0, 30, 31, 32]), r.choice([30, 31, 32])
        rows.append((i, r.choice([None, 1, 2, 2, 2, *range(3, 60)]), x, y, x + w, y + h, float(w * h), r.randrange(4) / 4, r.choice([None, "s", "t", "u"])))
    d = spark.createDataFrame(rows, BOXES)
    assert {tuple(x) for x in boxes.pooled_candidates(d, 0.85).collect()} == pooled_by_walk(rows, 0.85)
    assert boxes.pooled_candidates(d.limit(0)).count() == 0


def test_pooled_candidates_move_lone_boxes_once(spark, monkeypatch):
    """Boxes without a near copy go to no tiles: only the others reach the overlap join."""
    reached, pairs = [], boxes.overlapping_pairs
    monkeypatch.setattr(boxes, "overlapping_pairs", lambda d, *a: reached.append(d.count()) or pairs(d, *a))
    rows = [(i, i // 4, x := 40 * (i % 4), 0, x + 30, 30, 900.0, 0.5, "s") for i in range(30_000)]
    rows += [(30_000 + i, i, 1, 0, 31, 30, 900.0, 0.4, "t") for i in range(5)]
    got = {r["iuid"]: r["agree"] for r in boxes.pooled_candidates(spark.createDataFrame(rows, BOXES)).collect()}
    assert reached == [10] and got == {i: 2 if i % 4 == 0 and i < 20 else 1 for i in range(30_000)}


def test_diversify_picks_one_by_one(spark):
    work = spark.createDataFrame([(i, float(i % 3), i + 1) for i in range(6)], "image_id long, work_est double, rank int")
    shares = spark.createDataFrame([(i, "common" if i < 4 else "rare", 1.0) for i in range(6)], "image_id long, label string, share double")
    given = spark.createDataFrame([("common", 10), ("rare", 1)], "label string, n long")
    order = [r["image_id"] for r in suggest.diversify(work, shares, given, 3).orderBy("rank").collect()]
    cover, free, want = {"common": 1.0, "rare": 0.1}, list(range(6)), []
    for _ in range(3):
        best = max(free, key=lambda i: (1 - (i % 3) / 2 - 1.2 * cover["common" if i < 4 else "rare"], -i))
        want.append(best)
        free.remove(best)
        cover["common" if best < 4 else "rare"] += 1
    assert order == want + free
    assert [r["image_id"] for r in suggest.diversify(work, shares, given, 3, diversity=0).orderBy("rank").collect()] == list(range(6))


def test_exact_number_of_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.standard_normal((6, 8)), 5, 0) + 0.01 * rng.standard_normal((30, 8))
    d = spark.createDataFrame([(i, [float(v) for v in r], i // 5) for i, r in enumerate(x)], "iuid long, vec array<double>, image_id long")
    levels = vectors.finch(d.withColumn("label", F.lit(None).cast("string")))
    for k in (6, 4):
        got = vectors.exact_count(d, levels, k).collect()
        assert len({r["cluster"] for r in got}) == k and all(len({r["cluster"] for r in got if r["iuid"] // 5 == g}) == 1 for g in range(6))
    assert vectors.labels_at(levels, 99).count() == 30 and vectors.cluster_key(a=1, b=2) == vectors.cluster_key(b=2, a=1)
    sizes = {r["k"] for r in vectors.clusters_within(d, "image_id").collect()}
    assert 0 in sizes


def test_sets(spark):
    a = spark.createDataFrame([("x", 1)], "iuid string, n int")
    assert sets.append(a, a.select("n", "iuid")).count() == 2
    with pytest.raises(ValueError):
        sets.append(a, a.withColumn("n", F.lit("s")))
    p = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 5)], "a long, b long")
    assert [tuple(r) for r in sets.minus_pairs(p, spark.createDataFrame([(5, 4)], "a long, b long")).collect()] == [(1, 2)]
    got = sets.reconcile(spark.createDataFrame([("a", "b"), ("b", "zz"), ("c", None)], "iuid string, merged_into string"), spark.createDataFrame([("a",), ("b",), ("n",)], "iuid string"))
    assert {tuple(r) for r in got.collect()} == {("a", "kept", "b"), ("b", "kept", None), ("c", "dropped", None), ("n", "added", None)}


def disc(size=40, r=10, at=(20, 20)):
    yy, xx = np.mgrid[:size, :size]
    return (yy - at[0]) ** 2 + (xx - at[1]) ** 2 <= r * r


def test_mask_steps():
    m = disc()
    assert (refine.erode(refine.dilate(m)) >= m).all() and refine.dilate(m).sum() > m.sum() > refine.erode(m).sum()
    noisy = m.copy()
    noisy[4, 4] = True
    assert not refine.smooth(noisy)[4, 4] and not refine.median(noisy)[4, 4] and refine.count_parts(noisy) == 2
    left, right = refine.left_right(disc(at=(20, 28), r=5) | disc(at=(20, 8), r=6))
    assert left[20, 8] and right[20, 28]
    gray = np.where(disc(r=12), 200, 30).astype(np.uint8)
    for method in ("otsu", "ght"):
        assert (refine.threshold(gray, m, method, region="any") == disc(r=12)).all()
    assert (refine.threshold(gray, m, "manual", 100, "in_mask") == m).all() and (refine.threshold(gray, ~m & m) == 0).all()
    assert (refine.wand(gray, disc(r=4)) == disc(r=12)).all()
    assert (refine.gated_dilate(gray, disc(r=12)) == disc(r=12)).all() and refine.gated_erode(gray, refine.dilate(disc(r=12))).sum() < refine.dilate(disc(r=12)).sum()
    assert refine.enhance(gray).max() == 255 and (refine.enhance(gray, "gamma", 1.0) == gray).all()
    assert (refine.apply_steps(np.stack([gray] * 3, -1), m, [{"name": "contrast"}, {"name": "otsu", "region": "any"}, {"name": "fill"}, {"name": "largest"}]) == disc(r=12)).all()
    assert (refine.combine([m, ~m]).all() and not refine.combine([m, ~m], "intersection").any() and (refine.combine([m, ~m], "pick:1") == ~m).all())
    assert [p.sum() for p in refine.split_parts(noisy, 0.01)] == [m.sum()]
    s = refine.shape_of(m)
    assert s["area"] == m.sum() and s["parts"] == 1 and abs(s["major"] - 20) < 1 and s["elongation"] < 1.05 and refine.shape_of(m & ~m)["area"] == 0
    assert refine.change_summary([1.0, 0.3, 0.9]) == {"n": 3, "unchanged": 1, "large": 1, "median": 0.9}
    assert refine.from_polygons([[1, 1, 5, 1, 5, 3, 1, 3]], 6, 8).sum() == 8


def test_coco_source_and_proposals(spark, tmp_path):
    whole = masks.encode(np.ones((4, 6), bool))
    doc = {
        "images": [{"id": 1, "file_name": "a/one.jpg", "height": 4, "width": 6}, {"id": 2, "file_name": "two.jpg", "height": 4, "width": 6}],
        "categories": [{"id": 1, "name": "k"}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 1, 2, 2], "segmentation": [[1, 1, 3, 1, 3, 3, 1, 3]]}, {"id": 2, "image_id": 1, "category_id": 1, "segmentation": {"size": [4, 6], "counts": whole}},
            {"id": 3, "image_id": 1, "category_id": 1, "segmentation": {"size": [4, 6], "counts": [0, 24]}, "score": 0.1}, {"id": 4, "image_id": 2, "category_id": 1, "bbox": [0, 0, 1, 1]}, {"id": 5, "image_id": 1, "category_id": 1, "segmentation": {"size": [9, 9], "counts": whole}},
        ],
    }
    (tmp_path / "d.json").write_text(json.dumps(doc))
    images = spark.createDataFrame([("/data/one.jpg",), ("/data/none.jpg",)], "path string")
    got = plugins.MAKERS["coco"].make(images, document=str(tmp_path / "d.json"))
    rows = sorted((r["score"], r["bw"] * 6, r["bh"] * 4, round(r["mask_area_frac"] * 24)) for r in plugins.collection(got, least_score=0.2).collect())
    assert rows == [(1.0, 2.0, 2.0, 4), (1.0, 6.0, 4.0, 24)]
    full = plugins.whole_image(spark.createDataFrame([("p", 3, 5)], "path string, height int, width int"))
    assert plugins.collection(full).first()["mask_area_frac"] == 1.0
    assert {r["name"]: r["ready"] for r in plugins.status(spark).collect()} == {"coco": True, "whole_image": True}
    ann = spark.createDataFrame([("x/one.jpg", 1, [0.0], 0.5), ("gone.jpg", 9, None, None)], "file_name string, category_id int, bbox array<double>, score double")
    known = spark.createDataFrame([("/data/one.jpg", 7, 1), ("/other/one.jpg", 8, 0)], "file_name string, image_id long, row int")
    rec, lost = documents.import_proposals(ann, spark.createDataFrame([(1, "k")], "id int, name string"), known, {"dinov2": 3}, "ext")
    r = rec.first()
    assert (r["image_id"], r["pred_class"], r["features"]) == (8, "k", {"dinov2": [0.0, 0.0, 0.0]}) and [x[0] for x in lost.collect()] == ["gone.jpg"]


def test_files_seeds_bundles_and_logs(spark, tmp_path):
    for n in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / n).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in documents.list_images(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG"]
    assert documents.count_images(spark, str(tmp_path)) == (2, False) and documents.count_images(spark, str(tmp_path), 1) == (1, True)
    classes = spark.createDataFrame([("c1", "Lamp — foot", 3, "Lamp")], "class_id string, name string, coco_cat_id int, concept string")
    seed = spark.createDataFrame([("s", "Lamp", "foot"), ("s", "Lamp", "arm"), ("s", "Box", "lid"), ("s", "Box", "lid")], "superclass string, concept string, leaf string")
    assert [(r["name"], r["coco_cat_id"]) for r in documents.seed_taxonomy(classes, seed).orderBy("coco_cat_id").collect()] == [("Lamp — foot", 3), ("Box — lid", 4), ("Lamp — arm", 5)]
    plan = documents.bundle_plan(spark.createDataFrame([("/d/a.png",), ("/d/a.png",), ("/e/z.png",), (None,)], "abs_path string"), spark.createDataFrame([("/d/a.png", 5)], "path string, length long"), "/d/", "new/")
    assert sorted(tuple(r) for r in plan.collect()) == [("/d/a.png", "new/a.png", False, 5), ("/e/z.png", "new/z.png", True, None)]
    (tmp_path / "h.jsonl").write_text('{"cmd_id": "1", "ts": 2.0}\nbroken\n{"cmd_id": "2", "ts": 3.0}\n')
    assert [r["cmd_id"] for r in documents.read_log(spark, str(tmp_path / "h.jsonl"), "history", last=1).collect()] == ["2"]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "p"))
    s.save("t", spark.range(3))
    s.snapshot("one")
    s.save("t", s.load("t").filter("id > 0"))
    s.append("t", spark.range(10, 11))
    assert sorted(r[0] for r in s.load("t").collect()) == [1, 2, 10] and s.names() == ["t"] and s.has("t")
    s.restore("one")
    assert s.load("t").count() == 3
    made = []
    for _ in range(2):
        assert s.cached("bank", lambda: made.append(1) or spark.range(2), source="x", mtime=1).count() == 2
    assert len(made) == 1
    s.clear("t")
    assert not s.has("t")


def test_ingest_modes(spark):
    cols = "iuid long, image_id long, assigned_class string, is_background boolean, merged_into long"
    known = spark.createDataFrame([(1, 1, None, False, None), (2, 1, "a", False, None), (3, 2, None, False, None), (4, None, None, False, None)], cols)
    more = spark.createDataFrame([(1, 1, None, False, None), (9, 1, None, False, None), (9, 1, None, False, None)], cols)
    state = lambda mode: {r["iuid"]: r["is_background"] for r in events.ingest(known, more, mode).collect()}
    assert state("append") == {1: False, 2: False, 3: False, 4: False, 9: False} and state("replace") == {1: True, 2: False, 3: False, 4: False, 9: False} and set(state("new")) == {1, 9}
