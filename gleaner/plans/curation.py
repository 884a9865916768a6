"""Queries over instances, boxes, releases and logs, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions import masks
from gleaner.operators import activity, boxes, browse, events, models, release, stats
from gleaner.operators.views import View, class_reviewed, in_pool, is_live, is_member, with_source
from gleaner.plans.adapters import DIMS, INST, LOG, dim, gate, instances, log
from gleaner.session import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, prelude: str = INST):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {prelude}\n{sql}" if prelude else sql
        return f

    return add



def on_instances(name: str, sql: str | None, f) -> None:
    query(name, sql)(lambda spark, root: f(instances(spark, root)))


def on_log(name: str, sql: str | None, f) -> None:
    query(name, sql, LOG)(lambda spark, root: f(log(spark, root)))


BOTH = f"{INST},\n{DIMS}"
MEMBER = "assigned_class IS NOT NULL AND NOT is_background"
POOL = "assigned_class IS NULL AND NOT is_background AND merged_into IS NULL"
REVIEWED = "(assigned_class IS NOT NULL AND coalesce(assign_source, '?') <> 'classifier')"

on_instances("stats_header", f"""SELECT count(*) AS n_instances, count(*) FILTER ({MEMBER}) AS n_assigned, count(*) FILTER (assigned_class IS NULL AND NOT is_background) AS n_unassigned,
 count(*) FILTER (is_background) AS n_rejected, count(DISTINCT image_id) AS n_images FROM inst""", stats.header)
on_instances("overview", f"""SELECT count(*) AS total, count(*) FILTER (merged_into IS NOT NULL) AS merged_children, count(*) FILTER (merged_into IS NULL AND {MEMBER}) AS assigned,
 count(*) FILTER ({POOL}) AS unassigned, count(*) FILTER (merged_into IS NULL AND is_background) AS rejected, count(DISTINCT image_id) FILTER (merged_into IS NULL) AS images,
 count(DISTINCT image_id) FILTER (merged_into IS NULL AND {MEMBER}) AS images_with_assignment, count(*) FILTER (merged_into IS NULL AND {MEMBER} AND NOT mask_reviewed) AS mask_unreviewed,
 count(*) FILTER (merged_into IS NULL AND NOT is_background AND {REVIEWED}) AS reviewed,
 round(100.0 * (count(*) FILTER (merged_into IS NULL AND NOT is_background AND {REVIEWED}) + count(*) FILTER (merged_into IS NULL AND is_background)) / count(*) FILTER (merged_into IS NULL), 6) AS pct_curated
 FROM inst""", stats.overview)
on_instances("class_rollup", f"""SELECT assigned_class, count(*) AS n, count(DISTINCT image_id) AS n_images, round(avg(score), 6) AS mean_score,
 (SELECT string_agg(s || ':' || CAST(k AS VARCHAR), ',' ORDER BY s) FROM (SELECT assigned_class AS c, coalesce(assign_source, '?') AS s, count(*) AS k FROM live WHERE {MEMBER} GROUP BY 1, 2) WHERE c = o.assigned_class) AS sources
 FROM live o WHERE {MEMBER} GROUP BY 1""", lambda d: stats.by_class(d).withColumn("sources", F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")))
on_instances("source_hist", f"SELECT coalesce(assign_source, '?') AS source, count(*) AS n FROM live WHERE {MEMBER} GROUP BY 1",
             lambda d: d.filter(is_live() & is_member()).groupBy(F.coalesce("assign_source", F.lit("?")).alias("source")).agg(F.count("*").alias("n")))
on_instances("inst_per_image", "SELECT n_instances, count(*) AS n_images FROM (SELECT image_id, count(*) AS n_instances FROM live GROUP BY 1) GROUP BY 1",
             lambda d: stats.count_of_counts(d.filter(is_live()), "image_id"))
on_instances("score_hist", """SELECT b AS bin, count(score) AS n FROM range(20) r(b) LEFT JOIN (SELECT score FROM live WHERE score BETWEEN 0 AND 1) l ON least(floor(score * 20), 19) = b GROUP BY 1""",
             lambda d: stats.histogram(d.filter(is_live()), "score", F.lit(0.0), F.lit(1.0), 20))


@query("area_hist", """, s AS (SELECT min(area) AS lo, max(area) AS hi FROM live)
SELECT b AS bin, count(l.iuid) AS n FROM range(20) r(b) LEFT JOIN (SELECT live.iuid, least(floor((area - lo) / (hi - lo) * 20), 19) AS k FROM live, s) l ON l.k = b GROUP BY 1""")
def area_hist(spark: SparkSession, root: str) -> DataFrame:
    live = instances(spark, root).filter(is_live())
    low, high = live.agg(F.min("area"), F.max("area")).first()
    return stats.histogram(live, "area", F.lit(low), F.lit(high), 20)


on_instances("class_cooccur", f""", m AS (SELECT DISTINCT image_id, assigned_class AS c FROM live WHERE {MEMBER})
SELECT a.c AS class_a, b.c AS class_b, count(*) AS n_images FROM m a JOIN m b USING (image_id) GROUP BY 1, 2""", stats.cooccurrence)
on_instances("partition_summary", f""", p AS (SELECT * FROM live WHERE NOT is_background),
g AS (SELECT pid, assigned_class, count(*) AS n, min(iuid) AS first FROM p WHERE assigned_class IS NOT NULL GROUP BY 1, 2),
t AS (SELECT pid, sum(n) AS na FROM g GROUP BY 1),
top AS (SELECT pid, assigned_class, n FROM g QUALIFY row_number() OVER (PARTITION BY pid ORDER BY n DESC, first) = 1),
e AS (SELECT g.pid, -sum(n / na * ln(n / na + 1e-12)) AS ent FROM g JOIN t USING (pid) GROUP BY 1)
SELECT p.pid, count(*) AS size, round(avg(score), 6) AS mean_score, CAST(coalesce(any_value(na), 0) AS BIGINT) AS n_assigned, any_value(top.assigned_class) AS majority_class,
 round(coalesce(any_value(top.n / na), 0.0), 6) AS purity, round(coalesce(any_value(ent), 0.0), 6) AS entropy, round((count(*) - coalesce(any_value(na), 0)) / count(*), 6) AS frac_unassigned
FROM p LEFT JOIN t USING (pid) LEFT JOIN top USING (pid) LEFT JOIN e USING (pid) GROUP BY p.pid""", stats.partition_summary)
on_instances("partition_view", f"""SELECT 'class:' || assigned_class AS pid, count(*) AS size, round(avg(score), 6) AS mean_score, 'class' AS kind FROM live WHERE {MEMBER} GROUP BY 1
UNION ALL SELECT CAST(pid AS VARCHAR), count(*), round(avg(score), 6), 'part' FROM inst WHERE {POOL} GROUP BY 1""", stats.partition_view)
query("facet_sources", f"SELECT coalesce(source, 'unregistered') AS source, count(*) AS n FROM live LEFT JOIN ing USING (batch_id) GROUP BY 1", BOTH)(
    lambda s, r: with_source(instances(s, r).filter(is_live()), dim(s, "ing")).groupBy("source").agg(F.count("*").alias("n")))
on_instances("facet_methods", "SELECT coalesce(assign_source, '?') AS method, count(*) AS n FROM live WHERE NOT is_background GROUP BY 1",
             lambda d: d.filter(is_live() & ~F.col("is_background")).groupBy(F.coalesce("assign_source", F.lit("?")).alias("method")).agg(F.count("*").alias("n")))
on_instances("image_counts", f"""SELECT image_id, count(*) FILTER (merged_into IS NULL) AS n, count(*) AS n_all, bool_and(merged_into IS NOT NULL OR is_background OR ({REVIEWED} AND mask_reviewed)) AS final
 FROM inst GROUP BY 1 HAVING count(*) FILTER (merged_into IS NULL) > 0""", stats.image_counts)
on_instances("final_marks", f"""SELECT assigned_class, bool_and({REVIEWED} AND mask_reviewed) AS final, count(*) FILTER ({REVIEWED} AND mask_reviewed) AS n_ok, count(*) AS n FROM live WHERE {MEMBER} GROUP BY 1""", stats.final_marks)
query("taxonomy_rollup", f""", n AS (SELECT assigned_class AS class_id, count(*) AS n FROM live WHERE {MEMBER} GROUP BY 1)
SELECT concept, class_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n FROM cls LEFT JOIN n USING (class_id) WHERE NOT temp GROUP BY ROLLUP (concept, class_id)""", BOTH)(
    lambda s, r: stats.taxonomy_rollup(instances(s, r), dim(s, "cls")))
on_instances("image_class_counts", f"SELECT image_id, assigned_class, count(*) AS n FROM live WHERE {MEMBER} GROUP BY 1, 2",
             lambda d: d.filter(is_live() & is_member()).groupBy("image_id", "assigned_class").agg(F.count("*").alias("n")))
on_instances("method_counts", f"SELECT assigned_class, coalesce(assign_source, '?') AS method, count(*) AS n FROM live WHERE {MEMBER} GROUP BY 1, 2",
             lambda d: d.filter(is_live() & is_member()).groupBy("assigned_class", F.coalesce("assign_source", F.lit("?")).alias("method")).agg(F.count("*").alias("n")))
on_instances("busiest_images", "SELECT image_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, image_id) AS rank FROM inst GROUP BY 1 QUALIFY rank <= 20", lambda d: stats.busiest_images(d, 20))
COMP = f"comp AS (SELECT image_id, count(*) FILTER ({MEMBER}) AS assigned, count(*) FILTER ({POOL}) AS unassigned, count(*) FILTER (is_background) AS rejected FROM live GROUP BY 1)"
on_instances("release_stats", f", {COMP} SELECT * FROM comp", release.composition)
on_instances("release_candidates", f", {COMP} SELECT * FROM comp WHERE unassigned = 0 AND assigned > 1", release.candidates)
for _policy, _rule in (("exclude_rejected", "image_id % 3 = 1"), ("accepted_only", "image_id % 3 <> 0")):
    on_instances(f"release_held_{_policy}", f", {COMP} SELECT image_id, CASE image_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS gate FROM comp WHERE assigned + unassigned > 0 AND {_rule}",
                 lambda d, p=_policy: release.held(d, gate(F.col("image_id")), p))
query("release_qc", f""", has AS (SELECT DISTINCT image_id, assigned_class AS c FROM live WHERE {MEMBER})
SELECT h.image_id, if_class, then_class AS missing FROM has h JOIN rules ON h.c = if_class WHERE NOT EXISTS (SELECT 1 FROM has x WHERE x.image_id = h.image_id AND x.c = then_class)""", BOTH)(
    lambda s, r: release.part_rules(instances(s, r), dim(s, "rules")))
query("project_card", f"""SELECT count(*) FILTER (merged_into IS NULL) AS n_instances, count(DISTINCT image_id) AS n_images, count(*) FILTER (merged_into IS NULL AND (is_background OR {REVIEWED})) AS n_done,
 round(100.0 * count(*) FILTER (merged_into IS NULL AND (is_background OR {REVIEWED})) / count(*) FILTER (merged_into IS NULL), 6) AS pct_curated, (SELECT count(*) FROM cls WHERE NOT temp) AS n_classes FROM inst""", BOTH)(
    lambda s, r: stats.project_card(instances(s, r), dim(s, "cls")))
on_instances("filter_instances", "SELECT iuid, image_id, score FROM inst WHERE assigned_class IN ('A', 'R') AND NOT is_background AND score BETWEEN 0.2 AND 0.8 AND merged_into IS NULL",
             lambda d: d.filter(F.col("assigned_class").isin("A", "R") & ~F.col("is_background") & F.col("score").between(0.2, 0.8) & is_live()).select("iuid", "image_id", "score"))
on_instances("sort_instances", "SELECT iuid, coalesce(assigned_class, '~') AS class_key, row_number() OVER (ORDER BY coalesce(assigned_class, '~'), score DESC, iuid) AS rank FROM live QUALIFY rank <= 100",
             lambda d: d.filter(is_live()).select("iuid", F.coalesce("assigned_class", F.lit("~")).alias("class_key"), "score").orderBy("class_key", F.desc("score"), "iuid").limit(100)
             .select("iuid", "class_key", F.expr("row_number() over (order by class_key, score desc, iuid)").alias("rank")))
on_instances("find_instances", """SELECT iuid, image_id FROM inst WHERE CASE WHEN EXISTS (SELECT 1 FROM inst WHERE image_id = 7) THEN image_id = 7
 ELSE CAST(iuid AS VARCHAR) LIKE '7%' OR lower(assigned_class) LIKE '%7%' END""", lambda d: find_instances(d, "7"))
on_instances("low_conf_pick", f"SELECT iuid, score FROM inst WHERE {POOL} ORDER BY score, iuid LIMIT 200", lambda d: d.filter(in_pool()).select("iuid", "score").orderBy("score", "iuid").limit(200))
on_instances("sample_hash", "SELECT image_id FROM (SELECT DISTINCT image_id FROM inst WHERE image_id NOT IN (SELECT image_id FROM inst WHERE is_background)) ORDER BY md5(CAST(image_id AS VARCHAR) || '#7'), image_id LIMIT 100",
             lambda d: d.select("image_id").distinct().join(d.filter("is_background").select("image_id"), "image_id", "left_anti").orderBy(F.md5(F.concat(F.col("image_id").cast("string"), F.lit("#7")).cast("binary")), "image_id").limit(100))
on_instances("class_samples", f"SELECT assigned_class, iuid, score FROM live WHERE {MEMBER} QUALIFY row_number() OVER (PARTITION BY assigned_class ORDER BY score DESC, iuid) <= 10", lambda d: class_samples(d, 10))
on_instances("overfit_subset", f"SELECT iuid FROM live WHERE {MEMBER} AND assign_source IN ('manual', 'partition') ORDER BY iuid LIMIT 500",
             lambda d: d.filter(is_live() & is_member() & F.col("assign_source").isin("manual", "partition")).select("iuid").orderBy("iuid").limit(500))
query("scope_pool", f"SELECT iuid, source FROM (SELECT * FROM inst WHERE {POOL}) JOIN ing USING (batch_id) WHERE batch_id IN ('b0', 'b2') AND source = 'detA'", BOTH)(
    lambda s, r: with_source(instances(s, r).filter(in_pool()), dim(s, "ing")).filter(View(batches=("b0", "b2"), sources=("detA",)).predicate()).select("iuid", "source"))
on_instances("same_image_pairs", "SELECT image_id, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_pairs FROM live GROUP BY 1 HAVING count(*) > 1", lambda d: boxes.pair_counts(d.filter(is_live())))

PAIRS = """, o AS (SELECT a.image_id, a.iuid AS ia, b.iuid AS ib, a.assigned_class AS ca, b.assigned_class AS cb, a.score AS sa, b.score AS sb, a.area AS aa, b.area AS ab, a.assign_source AS wa, b.assign_source AS wb,
  a.mask_reviewed AS ra, b.mask_reviewed AS rb, a.batch_id AS ba, b.batch_id AS bb,
  greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i,
  greatest(b.x0 - a.x1, a.x0 - b.x1, 0) AS gx, greatest(b.y0 - a.y1, a.y0 - b.y1, 0) AS gy,
  sqrt(pow((a.x0 + a.x1 - b.x0 - b.x1) / 256, 2) + pow((a.y0 + a.y1 - b.y0 - b.y1) / 256, 2)) AS d
 FROM live a JOIN live b ON a.image_id = b.image_id AND a.iuid < b.iuid),
p AS (SELECT *, i / (aa + ab - i + 1e-6) AS iou FROM o WHERE i > 0),
near AS (SELECT *, i / (aa + ab - i + 1e-6) AS iou FROM o WHERE gx < 16 AND gy < 16)"""
on_instances("pair_features", f"""{PAIRS} SELECT image_id, ia AS iuid_a, ib AS iuid_b, round(iou, 6) AS box_iou, round(sqrt(gx * gx + gy * gy) / 128, 6) AS gap, round(d, 6) AS centroid_dist, CAST(coalesce(ca = cb, false) AS INT) AS class_agree,
 round(least(sa, sb), 6) AS score_min, round((sa + sb) / 2, 6) AS score_mean, round(least(greatest(greatest(aa, ab) / (least(aa, ab) + 1e-6), 1.0), 50.0), 6) AS area_ratio, round(iou + exp(-d / 0.05), 6) AS confusability FROM near""",
             lambda d: boxes.pair_features(d.filter(is_live())))
on_instances("overlap_groups", f"""{PAIRS}, e AS (SELECT ia AS a, ib AS b, iou FROM p WHERE iou >= 0.5), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS least FROM s UNION SELECT s.b, r.least FROM r JOIN s ON s.a = r.node WHERE r.least < s.b), m AS (SELECT node, min(least) AS g FROM r GROUP BY 1)
SELECT node AS iuid, g AS group_iuid, round(max(iou) OVER (PARTITION BY g), 6) AS prob FROM m JOIN (SELECT x, max(iou) AS iou FROM (SELECT a AS x, iou FROM e UNION ALL SELECT b, iou FROM e) GROUP BY 1) ON x = node""",
             lambda d: boxes.overlap_groups(d.filter(is_live()), 0.5))
GREEDY = """k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, area DESC, iuid) AS rk FROM live),
x AS (SELECT a.image_id, a.iuid, a.rk, list(b.rk) AS by FROM k a JOIN p ON a.iuid IN (p.ia, p.ib) AND a.image_id = p.image_id JOIN k b ON b.image_id = a.image_id AND b.iuid = CASE WHEN p.ia = a.iuid THEN p.ib ELSE p.ia END
  WHERE iou >= 0.3 AND b.rk < a.rk GROUP BY ALL),
c AS (SELECT k.image_id, k.iuid, k.rk, coalesce(x.by, []) AS by FROM k LEFT JOIN x USING (image_id, iuid, rk)),
g AS (SELECT image_id, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image_id FROM k)
  UNION ALL SELECT g.image_id, c.rk, CASE WHEN list_has_any(c.by, g.kept) THEN g.kept ELSE list_append(g.kept, c.rk) END FROM g JOIN c ON c.image_id = g.image_id AND c.rk = g.rk + 1)"""
on_instances("nms_boxes", f"""{PAIRS}, {GREEDY}, f AS (SELECT image_id, unnest(kept) AS rk FROM g QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY g.rk DESC) = 1)
SELECT k.iuid, k.image_id FROM k JOIN f USING (image_id, rk)""".replace("SELECT image_id, unnest(kept) AS rk FROM g QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY g.rk DESC) = 1",
             "SELECT image_id, unnest(kept) AS rk FROM (SELECT image_id, arg_max(kept, rk) AS kept FROM g GROUP BY 1)"), lambda d: boxes.nms(d.filter(is_live()), 0.3).select("iuid", "image_id"))
on_instances("dedupe_scope", None, lambda d: boxes.scope_duplicates(d.filter(is_live()), 0.7, F.col("batch_id").isin("b0", "b1")))
on_instances("box_agree", f"""{PAIRS}, v AS (SELECT iuid, assign_source AS src FROM live UNION ALL SELECT ia, wb FROM p WHERE iou >= 0.6 UNION ALL SELECT ib, wa FROM p WHERE iou >= 0.6)
SELECT iuid, count(DISTINCT src) AS agree FROM v GROUP BY 1""", lambda d: boxes.agreement(d.filter(is_live()), 0.6))
on_instances("merge_reps", f"""{PAIRS}, e AS (SELECT ia AS a, ib AS b FROM p WHERE iou >= 0.5), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS least FROM s UNION SELECT s.b, r.least FROM r JOIN s ON s.a = r.node WHERE r.least < s.b), m AS (SELECT node, min(least) AS g FROM r GROUP BY 1),
w AS (SELECT node AS iuid, first_value(node) OVER (PARTITION BY g ORDER BY score DESC, node) AS rep FROM m JOIN live ON live.iuid = node) SELECT iuid, CASE WHEN iuid <> rep THEN rep END AS merged_into FROM w""",
             lambda d: boxes.merge_representatives(d, boxes.overlap_groups(d.filter(is_live()), 0.5)))

on_log("op_mix", """SELECT op, CASE op WHEN 'new_class' THEN 'class' WHEN 'background' THEN 'reject' WHEN 'undo' THEN 'undo/redo' ELSE op END AS category, count(*) AS n, CAST(coalesce(sum(n_instances), 0) AS BIGINT) AS n_instances FROM log GROUP BY 1, 2""", activity.op_mix)
on_log("activity_totals", """SELECT count(*) FILTER (op <> 'undo') AS n_commands, count(*) FILTER (op = 'undo') AS n_undo, CAST(coalesce(sum(n_instances) FILTER (op <> 'undo'), 0) AS BIGINT) AS n_instances,
 count(DISTINCT actor) AS n_actors, max(ts_us) - min(ts_us) AS span_us FROM log""", activity.totals)
on_log("timeline", """, t AS (SELECT min(ts_us) AS t0, max(ts_us) AS t1 FROM log), b AS (SELECT least(23, floor((ts_us - t0) / greatest(t1 - t0, 1) * 24)) AS bin, n_instances FROM log, t WHERE op <> 'undo')
SELECT r.b AS bin, count(b.bin) AS n, CAST(coalesce(sum(n_instances), 0) AS BIGINT) AS n_instances FROM range(24) r(b) LEFT JOIN b ON b.bin = r.b GROUP BY 1""", activity.timeline)
on_log("sessions", """, g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS o FROM log WINDOW w AS (PARTITION BY actor ORDER BY ts_us, seq)),
s AS (SELECT *, sum(o) OVER (PARTITION BY actor ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT actor, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_ops FROM s GROUP BY actor, run""",
       lambda d: activity.actor_sessions(d, 1_800_000_000))
on_log("merge_split", "SELECT actor % 3 AS source, count(*) AS n, CAST(sum(n_instances) AS BIGINT) AS n_instances FROM log WHERE op = 'merge' GROUP BY 1",
       lambda d: d.filter("op = 'merge'").groupBy((F.col("actor") % 3).alias("source")).agg(F.count("*").alias("n"), F.sum("n_instances").alias("n_instances")))
on_log("action_timeline", "SELECT seq, row_number() OVER (ORDER BY ts_us, seq) AS cumulative FROM log WHERE op <> 'undo'", activity.running)
on_log("accept_rate", "SELECT actor, seq, round(avg(CAST(n_instances >= 5 AS INT)) OVER (PARTITION BY actor ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING), 6) AS running_rate FROM log WHERE op IN ('merge', 'background')",
       lambda d: activity.accept_rate(d, F.col("n_instances") >= 5, F.col("op").isin("merge", "background")))
on_log("lineage_gate", "SELECT actor, seq, coalesce(value < max(value) OVER (PARTITION BY actor ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS regressed FROM log WHERE op = 'new_class'",
       lambda d: activity.regressions(d.filter("op = 'new_class'"), "value", "actor").select("actor", "seq", "regressed"))
on_log("undo_conflict", """, t AS (SELECT *, n_instances % 10 * 1000 + seq % 100 AS target FROM log)
SELECT a.seq, EXISTS (SELECT 1 FROM t b WHERE b.target = a.target AND b.seq > a.seq AND b.actor <> a.actor) AS refused FROM t a""",
       lambda d: activity.conflicts(d.withColumn("target", F.col("n_instances") % 10 * 1000 + F.col("seq") % 100), "target").select("seq", "refused"))
on_log("audit_tail", "SELECT seq, op, actor FROM log ORDER BY ts_us DESC, seq DESC LIMIT 50", lambda d: activity.tail(d, 50).select("seq", "op", "actor"))


KEYED = f"""{PAIRS}, g AS (SELECT image_id, pid, count(*) AS n_members, count(DISTINCT assign_source) AS n_agree, min(assigned_class) AS todo_class, count(*) = 1 AND bool_and(mask_reviewed) AS done FROM live WHERE NOT is_background GROUP BY 1, 2)"""
on_instances("box_groups", f"{KEYED} SELECT * FROM g", lambda d: boxes.box_groups(d, "image_id", "pid"))
on_instances("box_todo", f"{KEYED} SELECT todo_class, count(*) AS n_boxes, count(*) FILTER (NOT done) AS n_todo, count(*) FILTER (n_members > 1) AS n_multi, count(*) FILTER (n_agree > 1) AS n_agree FROM g GROUP BY 1",
             lambda d: boxes.box_groups(d, "image_id", "pid").groupBy("todo_class").agg(F.count("*").alias("n_boxes"), F.count_if(~F.col("done")).alias("n_todo"), F.count_if(F.col("n_members") > 1).alias("n_multi"), F.count_if(F.col("n_agree") > 1).alias("n_agree")))
CHOICES = f"""{PAIRS}, m AS (SELECT image_id, pid, iuid, assign_source FROM live WHERE NOT is_background), q AS (SELECT p.*, ma.pid FROM p JOIN m ma ON ma.iuid = ia JOIN m mb ON mb.iuid = ib AND ma.pid = mb.pid),
v AS (SELECT iuid, assign_source AS src FROM m UNION ALL SELECT ia, wb FROM q WHERE iou >= 0.8 UNION ALL SELECT ib, wa FROM q WHERE iou >= 0.8), s AS (SELECT iuid, count(DISTINCT src) AS agree FROM v GROUP BY 1),
h AS (SELECT image_id, pid, min(iuid) AS head FROM m GROUP BY 1, 2), c AS (SELECT m.image_id, m.pid, m.iuid, agree, round(CASE WHEN m.iuid = head THEN 1.0 ELSE coalesce(q.iou, 0.0) END, 6) AS fit FROM m JOIN s USING (iuid) JOIN h ON h.image_id = m.image_id AND h.pid = m.pid LEFT JOIN q ON q.ia = head AND q.ib = m.iuid)"""
on_instances("box_choices", f"""{CHOICES}, d AS (SELECT ia, ib FROM q WHERE iou >= 0.95 UNION SELECT ib, ia FROM q WHERE iou >= 0.95)
SELECT *, row_number() OVER (PARTITION BY image_id, pid ORDER BY agree DESC, fit DESC, iuid) AS rank FROM c WHERE NOT EXISTS (SELECT 1 FROM d JOIN c b ON b.iuid = d.ib WHERE d.ia = c.iuid AND (b.agree, b.fit, -b.iuid) > (c.agree, c.fit, -c.iuid))""",
             lambda d: boxes.box_choices(d, "image_id", "pid"))
on_instances("box_wins", f"""{CHOICES}, r AS (SELECT iuid, row_number() OVER (PARTITION BY image_id, pid ORDER BY agree DESC, fit DESC, iuid) AS rank FROM c) SELECT assign_source AS method, count(*) AS n FROM r JOIN m USING (iuid) WHERE rank = 1 GROUP BY 1""",
             lambda d: boxes.box_choices(d, "image_id", "pid").filter("rank = 1").select("iuid").join(d.select("iuid", F.col("assign_source").alias("method")), "iuid").groupBy("method").agg(F.count("*").alias("n")))
on_instances("collapsed_boxes", f"""{CHOICES}, r AS (SELECT iuid, row_number() OVER (PARTITION BY image_id, pid ORDER BY agree DESC, fit DESC, iuid) AS rank FROM c) SELECT iuid FROM r WHERE rank > 1""",
             lambda d: d.filter(is_live() & ~F.col("is_background")).select("iuid").join(boxes.box_choices(d, "image_id", "pid").filter("rank = 1").select("iuid"), "iuid", "left_anti"))
KEPT = f"f AS (SELECT image_id, unnest(kept) AS rk FROM (SELECT image_id, arg_max(kept, rk) AS kept FROM g GROUP BY 1))"
on_instances("dedup_current", f"{PAIRS}, {GREEDY}, {KEPT} SELECT inst.iuid, assigned_class, is_background OR (merged_into IS NULL AND inst.iuid NOT IN (SELECT k.iuid FROM k JOIN f USING (image_id, rk))) AS is_background FROM inst".replace("JOIN f USING (image_id, rk)", "JOIN f ON f.image_id = k.image_id AND f.rk = k.rk"),
             lambda d: boxes.dedup_current(d, 0.3).select("iuid", "assigned_class", "is_background"))
on_instances("merged_partition", "SELECT iuid, CASE WHEN iuid <> rep THEN rep END AS merged_into FROM (SELECT iuid, first_value(iuid) OVER (PARTITION BY image_id ORDER BY score DESC, iuid) AS rep, count(*) OVER (PARTITION BY image_id) AS n FROM live WHERE pid = 3) WHERE n > 1",
             lambda d: boxes.merge_by_image(d.filter(is_live() & (F.col("pid") == 3))))
on_instances("pooled_candidates", None, lambda d: boxes.pooled_candidates(d.filter(is_live())))
on_instances("padded_boxes", "SELECT iuid, greatest(x0 - 4.0, 0.0) AS x0, least(x1 + 4.0, 128.0) AS x1, greatest(y0 - 4.0, 0.0) AS y0, least(y1 + 4.0, 128.0) AS y1 FROM live",
             lambda d: d.filter(is_live()).select("iuid", *[c.cast("double").alias(f"{a}{i}") for a in "xy" for i, c in enumerate(boxes.padded(a, 4.0, 128.0))]))
on_instances("at_pixel", "SELECT image_id, arg_min(iuid, (-score, iuid)) AS iuid FROM live WHERE x0 <= 40 AND x1 > 40 AND y0 <= 20 AND y1 > 20 GROUP BY 1", lambda d: browse.at_pixel(d, 40, 20))
on_instances("capped_groups", None, lambda d: boxes.capped_groups(boxes.pair_features(d.filter(is_live())).filter("centroid_dist < 0.1").select("image_id", F.col("iuid_a").alias("a"), F.col("iuid_b").alias("b"), F.col("centroid_dist").alias("d")), 3))
on_instances("pair_labels", f"{PAIRS} SELECT n.ia AS iuid_a, n.ib AS iuid_b, coalesce(n.ca = n.cb, false) AS same_class, a.pid = b.pid AS merge FROM near n JOIN live a ON a.iuid = n.ia JOIN live b ON b.iuid = n.ib",
             lambda d: boxes.overlapping_pairs(d.filter(is_live()), 16.0).select(F.col("a.iuid").alias("iuid_a"), F.col("b.iuid").alias("iuid_b"), F.coalesce(F.col("a.assigned_class") == F.col("b.assigned_class"), F.lit(False)).alias("same_class"), (F.col("a.pid") == F.col("b.pid")).alias("merge")))
CONFUSED = "f AS (SELECT ia AS iuid_a, ib AS iuid_b, round(iou + exp(-d / 0.05), 6) AS c, coalesce(ca = cb, false) AND box_ > 0.6 AS pos FROM (SELECT *, round(iou, 6) AS box_ FROM near))"
on_instances("hard_negatives", f"""{PAIRS}, {CONFUSED}, k AS (SELECT least(4000, 10 * count(*) FILTER (pos)) AS take FROM f), t AS (SELECT *, row_number() OVER (ORDER BY c DESC, iuid_a, iuid_b) AS r FROM f WHERE NOT pos),
u AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(iuid_a AS VARCHAR) || '#' || CAST(iuid_b AS VARCHAR)), iuid_a, iuid_b) AS h FROM t, k WHERE r > floor(0.8 * take))
SELECT iuid_a, iuid_b FROM t, k WHERE r <= floor(0.8 * take) UNION ALL SELECT iuid_a, iuid_b FROM u WHERE h <= take - floor(0.8 * take)""",
             lambda d: boxes.hard_negatives(boxes.pair_features(d.filter(is_live())), (F.col("class_agree") == 1) & (F.col("box_iou") > 0.6)))
on_instances("merge_candidates", f"""{PAIRS}, e AS (SELECT ia AS a, ib AS b, round(iou, 6) AS p FROM p WHERE round(iou, 6) >= 0.5), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS least FROM s UNION SELECT s.b, r.least FROM r JOIN s ON s.a = r.node WHERE r.least < s.b), m AS (SELECT node, min(least) AS g FROM r GROUP BY 1),
z AS (SELECT g, count(*) AS size FROM m GROUP BY 1 HAVING count(*) <= 10), w AS (SELECT g, min(p) AS score FROM e JOIN m ON m.node = e.a GROUP BY 1) SELECT g AS group_iuid, size, score FROM z JOIN w USING (g) ORDER BY score DESC, g LIMIT 20""",
             lambda d: boxes.merge_candidates(boxes.pair_features(d.filter(is_live()), reach=0.0).select("iuid_a", "iuid_b", F.col("box_iou").alias("p")), 0.5))


def categorised(d: DataFrame) -> DataFrame:
    """Unassigned rows by their source category: the partition's number by threes, of which the first two are known classes."""
    names = d.sparkSession.createDataFrame([(0, "A"), (1, "R"), (2, "X")], "category_id int, name string")
    known = d.sparkSession.createDataFrame([("A", "A", 0), ("R", "R", 2)], "class_id string, name string, coco_cat_id int")
    commands, made = events.from_categories(d.withColumn("src_category_id", (F.col("pid") % 3).cast("int")), names, known)
    pins = F.broadcast(made.select(F.col("class_id").alias("class"), F.lit(True).alias("is_new"), "coco_cat_id"))
    return commands.join(pins, "class", "left").select("iuid", F.when(F.col("is_new"), "new").otherwise(F.col("class")).alias("class"), "coco_cat_id")


on_instances("assign_categories", "SELECT iuid, CASE pid % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'R' ELSE 'new' END AS class, CAST(NULL AS INT) AS coco_cat_id FROM inst WHERE assigned_class IS NULL AND NOT is_background", categorised)


def recommended(d: DataFrame) -> DataFrame:
    """Pairs with their probability of being one object, learned from pairs that share a class and lie well over each other."""
    pairs = materialize(boxes.pair_features(d.filter(is_live())), "features")
    merged = (F.col("class_agree") == 1) & (F.col("box_iou") > 0.6)
    return models.merge_probability(pairs, merged, boxes.hard_negatives(pairs, merged))


on_instances("merge_recommender", None, recommended)
on_instances("recommended_groups", None, lambda d: boxes.merge_candidates(recommended(d), 0.5))


def coded(d: DataFrame) -> DataFrame:
    """Live boxes of the manual source with their masks as run-length codes on the 128 x 128 canvas."""
    return d.filter(is_live() & (F.col("assign_source") == "manual")).withColumn("rle", masks.rle_of_box("x0", "y0", "bw", "bh", 128, 128))


on_instances("mask_areas", "SELECT iuid, CAST(area AS BIGINT) AS area FROM live WHERE assign_source = 'manual'", lambda d: coded(d).select("iuid", masks.rle_area("rle").alias("area")))
on_instances("mask_pixels", "SELECT iuid, x0 <= 40 AND x1 > 40 AND y0 <= 20 AND y1 > 20 AS covers FROM live WHERE assign_source = 'manual'", lambda d: coded(d).select("iuid", masks.rle_covers("rle", 40, 20, 128, 128).alias("covers")))
on_instances("mask_ious", f"{PAIRS} SELECT ia AS iuid_a, ib AS iuid_b, round(i / (aa + ab - i), 6) AS iou FROM p WHERE wa = 'manual' AND wb = 'manual'",
             lambda d: boxes.overlapping_pairs(coded(d)).select(F.col("a.iuid").alias("iuid_a"), F.col("b.iuid").alias("iuid_b"), F.round(masks.rle_iou(F.col("a.rle"), F.col("b.rle"), 128, 128), 6).alias("iou")))


def source_links(d: DataFrame) -> DataFrame:
    """Links of the boxes of one source (entries, in order of their ids) with all others of their image at IoU >= 0.2."""
    p = boxes.overlapping_pairs(d.filter(is_live()).select("iuid", "image_id", "x0", "y0", "x1", "y1", "area", (F.col("pid") < 4).alias("entry"))).withColumn("score", boxes.iou()).filter("score >= 0.2")
    way = lambda e, t: p.filter(f"{e}.entry and not {t}.entry").select(F.col(f"{e}.iuid").alias("entry"), F.col(f"{e}.iuid").alias("key"), F.col(f"{t}.iuid").alias("target"), "score")
    return way("a", "b").unionByName(way("b", "a"))


on_instances("source_matches", None, lambda d: boxes.greedy_match(source_links(d)))
on_instances("box_matches", None, lambda d: boxes.best_match(source_links(d)))


def find_instances(rows: DataFrame, text: str) -> DataFrame:
    """(iuid, image_id) found by text: the image of that number, if there is one; else ids that start with it or classes that hold it."""
    cond = F.col("iuid").cast("string").startswith(text) | F.coalesce(F.lower("assigned_class").contains(text.lower()), F.lit(False))
    if text.isdigit() and not rows.filter(F.col("image_id") == int(text)).isEmpty():
        cond = F.col("image_id") == int(text)
    return rows.filter(cond).select("iuid", "image_id")


def class_samples(rows: DataFrame, n: int, salts: int = 32) -> DataFrame:
    """The n best-scored live members of each class; a hot class is ranked in parts first."""
    live = rows.filter(is_live() & is_member()).select("assigned_class", "iuid", "score").withColumn("salt", F.pmod(F.xxhash64("iuid"), F.lit(salts)))
    rank = lambda d, *by: d.withColumn("rank", F.expr(f"row_number() over (partition by {', '.join(by)} order by score desc, iuid)")).filter(F.col("rank") <= n)
    return rank(rank(live, "assigned_class", "salt"), "assigned_class").select("assigned_class", "iuid", "score")
