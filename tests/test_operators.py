import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import masks
from gleaner.functions.columns import epoch_ms, hex_id
from gleaner.operators import boxes, events, skew, stats, vectors
from gleaner.operators.activity_sessions import history_events
from gleaner.operators.components import connected_components
from gleaner.plans import similarity
from gleaner.sources import documents
from gleaner.streaming.ingest import append_new
from gleaner.streaming.sessions import sessionize, sessionize_stream
from tests.conftest import DATA


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ids_and_times(spark):
    a = "0123456789abcdef0123456789abcdef"
    df = spark.createDataFrame([(a.upper(),), (f"{{{a[:8]}-{a[8:12]}-{a[12:16]}-{a[16:20]}-{a[20:]}}} ",), ("None",), ("",), (None,)], "i string")
    assert [r[0] for r in df.select(hex_id("i")).collect()] == [a, a, None, None, None]
    t = spark.createDataFrame([(1.5e9,), (1.5e12,), (1.5e15,), (1.5e18,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "t double")
    assert [r[0] for r in t.select(epoch_ms("t")).collect()] == [1_500_000_000_000] * 4 + [None] * 5


EVENTS = "actor string, ts_ms long, op string, n_instances int, bucket string"


def test_sessions_split_at_gaps_and_join_across_buckets(spark):
    day = 86_400_000
    data = [("a", day - 1000, "x", 1, "z"), ("a", day + 500, "y", 2, "z"), ("a", day + 500 + 1_800_000, "x", None, "z"), ("a", day + 501 + 3_600_000, None, 1, "z"), (None, 5, "x", 1, "z"), ("", 5, "x", 1, "z"), ("b", None, "x", 1, "z")]
    got = {(r["actor"], r["start_ms"], r["end_ms"], r["n_ops"], r["n_instances"], tuple(sorted(r["ops"].items()))) for r in sessionize(spark.createDataFrame(data, EVENTS)).collect()}
    assert got == {
        ("a", day - 1000, day + 500 + 1_800_000, 3, 3, (("x", 2), ("y", 1))), ("a", day + 501 + 3_600_000, day + 501 + 3_600_000, 1, 1, (("", 1),)), ("", 5, 5, 2, 2, (("x", 2),)),
    }


def test_streamed_sessions_wait_for_late_events(spark, tmp_path):
    """Out-of-order batches give what one batch gives: a span waits until the watermark passes its timer."""
    import os

    import pandas as pd

    minute, base = 60_000, 26_000_000
    batches = [[("a", 0), ("a", 31)], [("a", 15), ("b", 40)], [("b", 10), ("b", 60)], [("z", 6000)], [("z", 9000)]]
    schema = "actor string, bucket long, start_ms long, end_ms long, n_ops long, n_instances long, ops string, flush boolean"
    for i, batch in enumerate(batches):
        rows = pd.DataFrame([(k, 0, (base + t) * minute, (base + t) * minute, 1, 0, '{"x": 1}', False) for k, t in batch], columns=[c.split()[0] for c in schema.split(", ")])
        rows.to_parquet(tmp_path / f"in{i}.parquet")
        os.utime(tmp_path / f"in{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*.parquet"))
    q = sessionize_stream(stream, 30 * minute, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["actor"], r["start_ms"] // minute - base, r["end_ms"] // minute - base, r["n_ops"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, 31, 3), ("b", 10, 60, 3), ("z", 6000, 6000, 1)]


def test_a_hot_actor_day_is_few_spans(spark):
    from gleaner.streaming.sessions import spans_of

    many = spark.range(5000).selectExpr("cast(null as string) as actor", "id * 7000 as ts_ms", "'o' as op", "id as n_instances")
    assert spans_of(many, 1_800_000, 86_400_000).count() <= 49
    got = sessionize(many).collect()
    assert len(got) == 1 and got[0]["n_ops"] == 5000 and got[0]["end_ms"] == 4999 * 7000 and got[0]["ops"] == {"o": 5000}


def test_keyed_join_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(None, 1)] * 3 + [("h", i) for i in range(50)] + [("c", 5)], "k string, x int")
    per = spark.createDataFrame([("h", 1.0), ("c", 2.0), ("d", 3.0)], "k string, y double")
    assert skew.hot_keys(rows, "k") == ["h"]
    for how, n in (("inner", 51), ("left", 54)):
        got = skew.keyed_join(rows, per, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(per, "k", how).collect())) and got.count() == n


def test_sessions_of_nothing(spark):
    assert sessionize(spark.createDataFrame([], EVENTS)).count() == 0


def test_resent_commands_count_once_at_their_earliest_time(spark):
    h = spark.createDataFrame([("c", 100.0, "op", 1, None), ("c", 99_000.0 * 1e6, "op", 1, None), ("c", 50.0, "op", 7, None), ("c", -1.0, "op", 1, None), ("c", 50.0, "undo", None, "u")], "cmd_id string, ts double, op string, n_instances int, actor string")
    assert rows(history_events(h)) == [("", "op", 50_000, 7), ("u", "undo", 50_000, 0)]


def test_components_chain_star_loop_null(spark):
    chain = [(i, i + 1) for i in range(10, 40)]
    star = [(100, k) for k in range(101, 130)]
    e = spark.createDataFrame([*chain, *star, *star, (7, 7), (None, 3), (5, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(e, "a", "b").collect()}
    assert {got[i] for i in range(10, 41)} == {10} and {got[i] for i in range(100, 130)} == {100} and got[7] == 7
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_histogram_closes_its_last_bin(spark):
    d = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.1,), (None,)], "x double")
    assert rows(stats.histogram(d, "x", F.lit(0.0), F.lit(1.0), 2)) == [(0, 1), (1, 2)]


BOX = "iuid long, image_id long, x0 int, y0 int, x1 int, y1 int, area double, score double, assigned_class string, mask_reviewed boolean, assign_source string"


def test_suppression_is_greedy(spark):
    b = [(1, 1, 0, 0, 10, 10, 100.0, 0.9), (2, 1, 0, 2, 10, 12, 100.0, 0.8), (3, 1, 0, 4, 10, 14, 100.0, 0.7), (4, 2, 0, 0, 10, 10, 100.0, 0.1), (5, 1, 40, 40, 40, 50, 0.0, 0.5)]
    d = spark.createDataFrame([(*x, None, False, "m") for x in b], BOX)
    assert [r["iuid"] for r in boxes.nms(d, 0.5).orderBy("iuid").collect()] == [1, 3, 4, 5]
    assert boxes.nms(d.limit(0), 0.5).count() == 0


def test_overlaps_meet_once_over_tiles(spark):
    d = spark.createDataFrame([(i, 1, 0, 0, 100, 100, 1e4, 0.5, None, False, "m") for i in range(6)], BOX)
    assert boxes.overlapping_pairs(d).count() == 15


def test_scope_duplicates_equal_a_walk(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(40):
        x, y, w, h = (int(v) for v in (*rng.integers(0, 30, 2), *rng.integers(10, 40, 2)))
        data.append((i, i % 2, x, y, x + w, y + h, float(w * h), float(rng.integers(0, 5)) / 5, None, bool(rng.random() < 0.3), "m"))
    inside = {i for i in range(40) if i % 3}
    d = spark.createDataFrame(data, BOX)
    got = {r["iuid"]: r["keep_iuid"] for r in boxes.scope_duplicates(d, 0.7, F.col("iuid").isin(*inside)).collect()}
    order = sorted((b for b in data if b[0] in inside or b[9]), key=lambda b: (b[0] in inside, not b[9], -b[7], -b[6], b[0]))

    def share(a, b):
        side = lambda k: max(0, min(a[k + 2], b[k + 2]) - max(a[k], b[k]))
        small, large = sorted((a[6], b[6]))
        return side(2) * side(3) / max(small, 1) if small >= 0.25 * large else 0.0

    kept, want = [], {}
    for b in order:
        by = [k for k in kept if k[1] == b[1] and (k[0] in inside or b[0] in inside) and share(k, b) >= 0.7]
        if by:
            want[b[0]] = by[0][0]
        else:
            kept.append(b)
    assert got == {k: v for k, v in want.items() if k in inside} and got


def test_fold_by_field_and_undo(spark):
    c = spark.createDataFrame([(1, "a", "assign", 1, "x", "m"), (2, "a", "background", 1, None, None), (3, "a", "undo", None, None, None), (4, "b", "unassign", 2, None, None)], "seq long, actor string, op string, iuid long, class string, source string")
    assert rows(events.fold(c.filter("op != 'undo'")).select("iuid", "assigned_class", "is_background", "assign_source")) == [(1, None, True, "m"), (2, None, False, None)]
    assert rows(events.effective(c).select("seq")) == [(1,), (4,)]


def test_delta_equals_recount(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "iuid long, c string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "iuid long, c string")
    count = lambda d: d.groupBy("c").agg(F.count("*").alias("n"))
    changed = lambda d: d.filter("iuid = 2")
    assert rows(events.apply_delta(count(a), changed(a), changed(b), "c")) == rows(count(b))


def test_nearest_matches_numpy(spark):
    x = np.random.default_rng(0).standard_normal((60, 8))
    d = spark.createDataFrame([(i, v.tolist(), "a" if i % 2 else "b") for i, v in enumerate(x)], "iuid long, vec array<double>, label string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {r["q"]: r["r"] for r in vectors.nearest(d, d, 1).collect()}
    assert got == dict(enumerate(s.argmax(1).tolist()))
    assert vectors.finch(d.withColumn("label", F.lit(None).cast("string"))).filter("level = 0").count() == 60


def test_run_lengths_round_trip():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (5, 7), (64, 64)):
        for p in (0.0, 0.3, 1.0):
            m = rng.random(shape) < p
            code = masks.encode(m)
            assert (masks.decode(code, *shape) == m).all() and masks.area(code) == m.sum()


def test_mask_parts():
    m = np.zeros((8, 8), bool)
    m[1:4, 1:4] = True
    m[2, 2] = False
    m[6, 6] = True
    assert masks.components(m).max() == 2 and masks.largest(m).sum() == 8 and masks.fill(m).sum() == 10 and masks.box(m) == (1, 1, 6, 6)
    assert masks.box(np.zeros((2, 2), bool)) is None and 10 <= masks.otsu(np.r_[np.full(50, 10), np.full(50, 200)]) < 200


def test_streamed_append_adds_each_key_once(spark, tmp_path):
    schema = "iuid string, n int"
    for k, part in enumerate(([("a", 1), ("a", 2), (None, 1)], [("a", 3), ("b", 4)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        append_new(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a", 1), ("b", 4)]


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"images": [{"id": 1, "file_name": "d/x.jpg"}], "annotations": [{"id": 5, "image_id": 1, "bbox": [0, 0, 2, 2], "odd": 1}], "categories": [{"id": 1, "name": "n"}]}')
    images, notes, cats = documents.read_coco(spark, str(tmp_path / "a.json"))
    assert documents.annotated_images(images, notes).first()["file_name"] == "d/x.jpg" and cats.count() == 1
    known = spark.createDataFrame([("e/x.jpg", 9, 2), ("f/x.jpg", 8, 1)], "file_name string, image_id long, row long")
    hit, miss = documents.match_basename(spark.createDataFrame([("q/x.jpg",), ("q/y.jpg",)], "file_name string"), known)
    assert hit.first()["image_id"] == 8 and miss.count() == 1
    (tmp_path / "l.jsonl").write_text('{"seq": 1}\nbroken\n{"seq": 2}\n')
    assert documents.read_log(spark, str(tmp_path / "l.jsonl"), "seq long").filter("seq is not null").count() == 2
    (tmp_path / "p.JPG").write_bytes(b"1")
    assert documents.list_images(spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize("n", [0, 1])
def test_rollups_of_little(spark, n):
    d = spark.createDataFrame([(1, 1, 0.5, None, False, None, None, False, 0)] * n, "iuid long, image_id long, score double, assigned_class string, is_background boolean, assign_source string, merged_into long, mask_reviewed boolean, pid long")
    assert stats.header(d).first()["n_instances"] == n and stats.overview(d).first()["pct_curated"] == 0.0 and stats.partition_summary(d).count() == n


def test_factored_scores_reject_rows_like_no_class(spark):
    r = np.random.default_rng(5)
    at = np.eye(8) * 4
    rows = [(100 * k + i, [float(v) for v in at[k] + 0.3 * r.standard_normal(8)], label) for k, label in enumerate(["c0", "c1", "__reject__", None]) for i in range(40)]
    rows += [(900 + i, [float(v) for v in at[0] + 0.3 * r.standard_normal(8)], None) for i in range(5)] + [(990, [9.0] * 8, "single")]
    got = {(x["iuid"], x["label"]): x["p"] for x in similarity.factored(spark.createDataFrame(rows, "iuid long, vec array<double>, label string")).collect()}
    assert len(got) == 90 and {label for _, label in got} == {"c0", "c1"}
    assert all(got[900 + i, "c0"] > 0.5 > got[900 + i, "c1"] for i in range(5))
    assert all(got[300 + i, "c0"] + got[300 + i, "c1"] < 0.5 for i in range(40))
    scores = similarity.QUERIES["factored_lr"](spark, DATA)
    assert scores.filter("label = '__reject__'").count() == 0 and scores.groupBy("iuid").sum("p").filter("`sum(p)` >= 1").count() == 0
