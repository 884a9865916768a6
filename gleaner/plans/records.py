"""Queries over the project's own tables (meta, history, ingests, classes, concepts, features), each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.columns import epoch_ms, hex_id
from gleaner.operators import activity, browse, events, exports, sets, stats
from gleaner.operators.skew import keyed_join
from gleaner.operators.views import View, class_reviewed, in_pool, is_live, is_member, mask_reviewed, with_source
from gleaner.plans.exchange import batches
from gleaner.plans.similarity import feature_health, ORACLES as VECTOR_SQL
from gleaner.sources.tables import table
from gleaner.streaming.sessions import sessionize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ORDER = ["row_no", "image_id", "batch_id", "granularity", "modality", "assigned_class", "is_background", "assign_source", "assign_score", "refined", "provenance"]
HEX = "regexp_matches(regexp_replace(lower({0}), '[\\s{{}}-]', '', 'g'), '^[0-9a-f]{{32}}$')"
BARE = "CASE WHEN " + HEX + " THEN regexp_replace(lower({0}), '[\\s{{}}-]', '', 'g') END"


def records(spark: SparkSession, root: str) -> DataFrame:
    """meta with usable ids, each once (its least row); pid numbers the pool by the id's first digit."""
    m = table(spark, root, "meta").withColumn("id", hex_id("iuid")).filter("id is not null")
    once = m.groupBy("id").agg(F.min(F.struct(*ORDER, hex_id("merged_into").alias("merged_into"))).alias("r"))
    rows = once.select(F.col("id").alias("iuid"), "r.*").withColumn("is_background", F.coalesce("is_background", F.lit(False))).withColumn("refined", F.coalesce("refined", F.lit(False)))
    return rows.withColumn("score", F.col("assign_score")).withColumn("pid", F.conv(F.substring("iuid", 1, 1), 16, 10).cast("long"))


REC = f"""rec AS (SELECT * REPLACE (coalesce(is_background, false) AS is_background, coalesce(refined, false) AS refined), assign_score AS score, CAST('0x' || substr(iuid, 1, 1) AS BIGINT) AS pid FROM (
 SELECT {BARE.format('iuid')} AS iuid, {', '.join(ORDER)}, {BARE.format('merged_into')} AS merged_into FROM meta) WHERE iuid IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY iuid ORDER BY {', '.join(f'{c} NULLS FIRST' for c in ORDER)}, merged_into NULLS FIRST) = 1),
bat AS (SELECT batch_id, min(source) AS source FROM (SELECT unnest(batch_ids) AS batch_id, source FROM ingests) WHERE batch_id IS NOT NULL GROUP BY 1)"""
MEMBER, POOL, LIVE = "assigned_class IS NOT NULL AND NOT is_background", "assigned_class IS NULL AND NOT is_background AND merged_into IS NULL", "merged_into IS NULL"
SEEN = "(coalesce(granularity = 'sample', false) OR coalesce(json_extract_string(provenance, '$.mask_reviewed') = 'true', false) OR (refined AND coalesce(list_contains(json_keys(provenance), 'draw'), false)))"


def commands(spark: SparkSession, root: str) -> DataFrame:
    """history commands, each (actor, cmd_id, op) once at its earliest valid time: actor, cmd_id, op, ts_us, ts_ms, n_instances, of."""
    rows = table(spark, root, "history").select(F.coalesce("actor", F.lit("")).alias("actor"), "cmd_id", "op", epoch_ms("ts").alias("ms"), F.coalesce("n_instances", F.lit(0)).cast("long").alias("n"), "undo_of")
    once = rows.filter("ms is not null").groupBy("actor", "cmd_id", "op").agg(F.min(F.struct("ms", (-F.col("n")).alias("minus"), "undo_of")).alias("r"))
    return once.select("actor", "cmd_id", F.coalesce("op", F.lit("?")).alias("op"), (F.col("r.ms") * 1000).alias("ts_us"), F.col("r.ms").alias("ts_ms"), (-F.col("r.minus")).alias("n_instances"), F.col("r.undo_of").alias("of"))


MS = "CASE WHEN {0} IS NULL OR isnan({0}) OR isinf({0}) OR {0} <= 0 THEN NULL WHEN {0} < 1e11 THEN CAST(round({0} * 1000) AS BIGINT) WHEN {0} < 1e14 THEN CAST(round({0}) AS BIGINT) WHEN {0} < 1e17 THEN CAST(round({0} / 1e3) AS BIGINT) ELSE CAST(round({0} / 1e6) AS BIGINT) END"
CMD = f"""cmd AS (SELECT actor, cmd_id, coalesce(op, '?') AS op, ms, n, undo_of FROM (SELECT coalesce(actor, '') AS actor, cmd_id, op, {MS.format('ts')} AS ms, coalesce(n_instances, 0) AS n, undo_of FROM history) WHERE ms IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY actor, cmd_id, op ORDER BY ms, n DESC, undo_of NULLS FIRST) = 1),
ing AS (SELECT ingest_id, {MS.format('ts')} AS ms, n_instances, n_images, ingest_mode, score_thresh, source FROM ingests
 QUALIFY row_number() OVER (PARTITION BY ingest_id ORDER BY {MS.format('ts')} NULLS LAST, n_instances NULLS FIRST, n_images NULLS FIRST, ingest_mode NULLS FIRST, score_thresh NULLS FIRST, source NULLS FIRST) = 1)"""


def ingests(spark: SparkSession, root: str) -> DataFrame:
    """The registered ingests, each id once (its earliest valid row)."""
    cols = ["n_instances", "n_images", "ingest_mode", "score_thresh", "source"]
    rows = table(spark, root, "ingests").withColumn("ms", epoch_ms("ts"))
    return rows.groupBy("ingest_id").agg(F.min(F.struct(F.col("ms").isNull().alias("late"), "ms", *cols)).alias("r")).select("ingest_id", F.col("r.ms").alias("ts_ms"), (F.col("r.ms") * 1000).alias("ts_us"), *[f"r.{c}" for c in cols])


def add(name: str, sql: str | None, f, prelude: str = REC) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLES[name] = f"WITH RECURSIVE {prelude} {sql}"


def on_records(name: str, sql: str | None, f) -> None:
    add(name, sql, lambda spark, root: f(records(spark, root)))


def on_log(name: str, sql: str, f) -> None:
    add(name, sql, lambda spark, root: f(commands(spark, root)), CMD)


n = lambda name: F.count("*").alias(name)
# logs
CAT = "CASE " + " ".join(f"WHEN op = '{k}' THEN '{v}'" for k, v in activity.CATEGORIES.items()) + " ELSE op END"
on_log("log_mix", f"SELECT op, {CAT} AS category, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_instances FROM cmd GROUP BY 1, 2", activity.op_mix)
on_log("log_totals", """SELECT count(*) FILTER (op NOT IN ('undo', 'redo')) AS n_commands, count(*) FILTER (op = 'undo') AS n_undo, CAST(coalesce(sum(n) FILTER (op NOT IN ('undo', 'redo')), 0) AS BIGINT) AS n_instances,
 count(DISTINCT actor) AS n_actors, (max(ms) - min(ms)) * 1000 AS span_us FROM cmd""", activity.totals)
add("log_timeline", """, t AS (SELECT min(ms) AS t0, max(ms) AS t1 FROM (SELECT ms FROM cmd UNION ALL SELECT ms FROM ing) WHERE ms > 0),
b AS (SELECT least(23, floor((ms - t0) / (t1 - t0) * 24)) AS bin, n FROM cmd, t WHERE op NOT IN ('undo', 'redo'))
SELECT r.b AS bin, count(b.bin) AS n, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_instances FROM range(24) r(b) LEFT JOIN b ON b.bin = r.b GROUP BY 1""",
    lambda s, r: activity.timeline(commands(s, r), 24, ingests(s, r).filter("ts_us is not null")), CMD)


def log_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of all logs together: (start_ms, end_ms, n_ops), split by gaps above an hour."""
    both = commands(spark, root).select("ts_ms", "op").unionByName(ingests(spark, root).select("ts_ms", F.lit("ingest").alias("op")))
    return sessionize(both.select(F.lit("").alias("actor"), "ts_ms", "op", F.lit(0).alias("n_instances")), 3_600_000).select("start_ms", "end_ms", "n_ops")


add("log_sessions", """, a AS (SELECT ms FROM cmd UNION ALL SELECT ms FROM ing WHERE ms IS NOT NULL), g AS (SELECT ms, CASE WHEN ms - lag(ms) OVER (ORDER BY ms) <= 3600000 THEN 0 ELSE 1 END AS o FROM a),
s AS (SELECT ms, sum(o) OVER (ORDER BY ms ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_ops FROM s GROUP BY run""", log_sessions, CMD)
add("ingest_rows", "SELECT ingest_id, ms AS ts_ms, n_images, n_instances, ingest_mode AS mode, score_thresh FROM ing", lambda s, r: ingests(s, r).select("ingest_id", "ts_ms", "n_images", "n_instances", F.col("ingest_mode").alias("mode"), "score_thresh"), CMD)
on_log("action_stats", """SELECT op, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_instances, CASE WHEN count(*) < 2 THEN 0 ELSE max(ms) - min(ms) END AS duration_ms FROM cmd GROUP BY 1""",
       lambda d: d.groupBy("op").agg(n("n"), F.sum("n_instances").alias("n_instances"), F.when(F.count("*") < 2, 0).otherwise(F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms")))
on_log("log_cumulative", "SELECT cmd_id, actor, op, row_number() OVER (ORDER BY ms, actor, cmd_id NULLS FIRST, op) AS cumulative FROM cmd WHERE op NOT IN ('undo', 'redo')",
       lambda d: activity.running(d.withColumn("seq", F.struct("actor", "cmd_id", "op"))).select("seq.*", "cumulative"))
on_log("undone_ops", "SELECT undo_of AS op, count(*) FILTER (op = 'undo') AS n_undo, count(*) FILTER (op = 'redo') AS n_redo FROM cmd WHERE op IN ('undo', 'redo') GROUP BY 1",
       lambda d: d.filter("op in ('undo', 'redo')").groupBy(F.col("of").alias("op")).agg(F.count_if(F.col("op") == "undo").alias("n_undo"), F.count_if(F.col("op") == "redo").alias("n_redo")))
add("actions_per_verified", f""", v AS (SELECT count(*) AS v FROM rec WHERE {LIVE} AND {MEMBER} AND coalesce(assign_source, '?') <> 'classifier'), a AS (SELECT count(*) AS a FROM cmd WHERE op NOT IN ('undo', 'redo'))
SELECT a AS n_actions, v AS n_verified, CASE WHEN v > 0 THEN round(a / v, 6) END AS ratio FROM a, v""",
    lambda s, r: commands(s, r).filter("op not in ('undo', 'redo')").agg(n("n_actions")).crossJoin(records(s, r).filter(is_live() & is_member() & class_reviewed()).agg(n("n_verified")))  # one row each
    .withColumn("ratio", F.when(F.col("n_verified") > 0, F.round(F.col("n_actions") / F.col("n_verified"), 6))), f"{REC}, {CMD}")
# facets, lists and pages
SCOPE = View(granularities=("instance",), modalities=("image", "video"))
on_records("kind_scope", f"SELECT iuid FROM rec WHERE {LIVE} AND granularity = 'instance' AND modality IN ('image', 'video')", lambda d: d.filter(is_live() & SCOPE.predicate()).select("iuid"))
on_records("mask_reviews", f"SELECT assigned_class, count(*) AS n, count(*) FILTER ({SEEN}) AS n_reviewed FROM rec WHERE {LIVE} AND {MEMBER} GROUP BY 1",
           lambda d: d.filter(is_live() & is_member()).groupBy("assigned_class").agg(n("n"), F.count_if(mask_reviewed()).alias("n_reviewed")))
on_records("review_queue", f"SELECT iuid, image_id FROM rec WHERE {LIVE} AND NOT is_background AND NOT {SEEN} ORDER BY iuid LIMIT 100 OFFSET 50",
           lambda d: browse.page(d.filter(is_live() & ~F.col("is_background") & ~mask_reviewed()), [F.asc("iuid")], 50, 100).select("iuid", "image_id"))
on_records("filter_records", f"SELECT iuid FROM rec WHERE assigned_class IN ('c_8c08584ec6c4', 'c_bb113072b006') AND NOT is_background AND score >= 0.5 AND NOT refined AND merged_into IS NULL",
           lambda d: browse.filter_instances(d, ["c_8c08584ec6c4", "c_bb113072b006"], score=(0.5, None), refined=False, is_merge_child=False).select("iuid"))
on_records("merge_children", "SELECT iuid, merged_into FROM rec WHERE merged_into IS NOT NULL", lambda d: browse.filter_instances(d, is_merge_child=True).select("iuid", "merged_into"))
for _by, _key in (("score", "coalesce(score, '-inf'::DOUBLE)"), ("class", "coalesce(assigned_class, '~')"), ("image", "image_id")):
    on_records(f"page_by_{_by}", f"SELECT iuid FROM rec ORDER BY {_key} DESC NULLS LAST, iuid LIMIT 40 OFFSET 20", lambda d, by=_by: browse.page(d, browse.order_of(by), 20, 40).select("iuid"))
VIEW = f"""v AS (SELECT 'class:' || assigned_class AS pid, count(*) AS size, round(avg(score), 6) AS mean_score, 'class' AS kind FROM rec WHERE {LIVE} AND {MEMBER} GROUP BY 1
UNION ALL SELECT CAST(pid AS VARCHAR), count(*), round(avg(score), 6), 'part' FROM rec WHERE {POOL} GROUP BY 1)"""
on_records("partition_rows", f", {VIEW} SELECT * FROM v WHERE kind = 'class' AND pid LIKE '%a%' ORDER BY size DESC, pid LIMIT 20 OFFSET 3", lambda d: browse.partition_page(stats.partition_view(d), "class", "A", 3, 20))
PID = f"CASE WHEN {LIVE} AND {MEMBER} THEN 'class:' || assigned_class WHEN {POOL} THEN CAST(pid AS VARCHAR) END"
on_records("partition_of", f"SELECT iuid, {PID} AS pid FROM rec", browse.partition_of)
on_records("partition_members", f"SELECT iuid, {PID} AS pid FROM rec WHERE {PID} IN ('class:c_8c08584ec6c4', '3')",
           lambda d: browse.members(d, "class:c_8c08584ec6c4").select("iuid", F.lit("class:c_8c08584ec6c4").alias("pid")).unionByName(browse.members(d, "3").select("iuid", F.lit("3").alias("pid"))))
on_records("partition_window", f"SELECT iuid FROM rec WHERE {PID} = '3' ORDER BY iuid LIMIT 25 OFFSET 10", lambda d: browse.page(browse.members(d, "3"), [F.asc("iuid")], 10, 25).select("iuid"))
on_records("rejected_list", "SELECT iuid, image_id FROM rec WHERE is_background", lambda d: browse.rejected(d).select("iuid", "image_id"))
add("pool_ingest", f"SELECT iuid, coalesce(source = 'dock_cam', false) AS in_view FROM rec LEFT JOIN bat USING (batch_id) WHERE {POOL}",
    lambda s, r: browse.pool(with_source(records(s, r), batches(s, r)), None).select("iuid", (F.col("source") == "dock_cam").alias("in_view")))
add("image_members", f"SELECT image_id, count(*) AS n FROM rec WHERE {LIVE} AND (assigned_class IS NOT NULL OR NOT is_background) AND image_id IS NOT NULL GROUP BY 1",
    lambda s, r: records(s, r).filter(is_live() & (F.col("assigned_class").isNotNull() | ~F.col("is_background")) & F.col("image_id").isNotNull()).groupBy("image_id").agg(n("n")))
_health = VECTOR_SQL["feature_health"]
add("default_methods", f""", u AS (SELECT method, CASE WHEN method = 'decoder' THEN 0 WHEN method NOT IN ('shape', 'shapecoord', 'coords') THEN 1 ELSE 2 END AS t FROM h WHERE usable) SELECT method FROM u WHERE t = (SELECT min(t) FROM u)""",
    lambda s, r: browse.default_methods(feature_health(s, r)), f"h AS ({_health})")
# rollups
add("source_stats", f"SELECT coalesce(source, 'unregistered') AS source, assigned_class, count(*) AS n FROM rec LEFT JOIN bat USING (batch_id) WHERE {LIVE} AND {MEMBER} GROUP BY 1, 2",
    lambda s, r: with_source(records(s, r), batches(s, r)).filter(is_live() & is_member()).groupBy("source", "assigned_class").agg(n("n")))
add("taxonomy_tree", f""", k AS (SELECT assigned_class AS class_id, count(*) AS n FROM rec WHERE {LIVE} AND {MEMBER} GROUP BY 1),
l AS (SELECT CASE WHEN is_temp THEN 'temp' ELSE coalesce(superclass, '?') END AS superclass, CASE WHEN is_temp THEN 'temp' ELSE coalesce(concept, '?') END AS concept, class_id, coalesce(n, 0) AS n FROM classes LEFT JOIN concepts ON concept_id = concept LEFT JOIN k USING (class_id))
SELECT superclass, concept, class_id, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY ROLLUP (superclass, concept, class_id)""",
    lambda s, r: stats.taxonomy_tree(records(s, r), table(s, r, "classes"), table(s, r, "concepts")))
add("class_rules", f"SELECT coalesce(nullif(structure_type, ''), 'none') AS chain, count(DISTINCT class_id) AS n_classes, count(iuid) AS n_members FROM classes LEFT JOIN (SELECT * FROM rec WHERE {LIVE} AND {MEMBER}) ON assigned_class = class_id GROUP BY 1",
    lambda s, r: table(s, r, "classes").select("class_id", F.coalesce(F.nullif("structure_type", F.lit("")), F.lit("none")).alias("chain")).join(
        records(s, r).filter(is_live() & is_member()).groupBy(F.col("assigned_class").alias("class_id")).agg(n("k")), "class_id", "left").groupBy("chain").agg(F.countDistinct("class_id").alias("n_classes"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_members")))
# sets
DINO = f"(SELECT DISTINCT {BARE.format('iuid')} AS iuid FROM features WHERE method = 'dinov2')"


def dino(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "features").filter("method = 'dinov2'").select(hex_id("iuid").alias("iuid"), "method", "vec").filter("iuid is not null")


add("reconciled", f""", f AS (SELECT iuid FROM {DINO} WHERE iuid IS NOT NULL) SELECT coalesce(rec.iuid, f.iuid) AS iuid, CASE WHEN rec.iuid IS NULL THEN 'added' WHEN f.iuid IS NULL THEN 'dropped' ELSE 'kept' END AS status,
 CASE WHEN rec.iuid IS NOT NULL AND f.iuid IS NOT NULL AND merged_into IN (SELECT iuid FROM f) THEN merged_into END AS merged_into FROM rec FULL JOIN f ON rec.iuid = f.iuid""",
    lambda s, r: sets.reconcile(records(s, r), dino(s, r)))
add("with_features", f"SELECT iuid, image_id FROM rec WHERE iuid IN (SELECT iuid FROM {DINO} WHERE iuid IS NOT NULL)", lambda s, r: sets.subset(records(s, r), dino(s, r)).select("iuid", "image_id"))
add("aligned_features", f""", g AS (SELECT DISTINCT {BARE.format('iuid')} AS iuid, method FROM features WHERE (method = 'dinov2' AND len(vec) = 64) OR (method = 'coords' AND len(vec) = 6)),
w AS (SELECT iuid, m AS method FROM rec, (VALUES ('dinov2'), ('coords')) t(m)) SELECT w.method, count(*) AS n, count(*) FILTER (g.iuid IS NULL) AS n_zero FROM w LEFT JOIN g ON g.iuid = w.iuid AND g.method = w.method GROUP BY 1""",
    lambda s, r: sets.align(records(s, r), table(s, r, "features").withColumn("iuid", hex_id("iuid")).withColumn("vec", F.transform("vec", lambda x: F.lit(1.0).cast("float"))), {"dinov2": 64, "coords": 6}).groupBy("method").agg(n("n"), F.count_if(F.col("vec")[0] == 0).alias("n_zero")))
add("folded_features", f", f AS (SELECT {BARE.format('iuid')} AS iuid, max(method = 'dinov2') AS held FROM features WHERE vec IS NOT NULL AND method IN ('dinov2', 'coords') GROUP BY 1) SELECT iuid, held FROM rec JOIN f USING (iuid)",
    lambda s, r: (lambda f: sets.fold_features(records(s, r), f.filter("method = 'dinov2'").withColumn("vec", F.array(F.lit(1))), f.filter("method = 'coords'").withColumn("vec", F.array(F.lit(0)))).select("iuid", (F.col("vec")[0] == 1).alias("held")))(
        table(s, r, "features").filter("vec is not null").select(hex_id("iuid").alias("iuid"), "method")))
add("prunable_classes", "SELECT class_id FROM classes WHERE NOT coalesce(is_temp, false) AND class_id NOT IN (SELECT class_id FROM classes WHERE coco_cat_id <= 20) AND class_id NOT IN (SELECT assigned_class FROM rec WHERE assigned_class IS NOT NULL)",
    lambda s, r: sets.prunable(table(s, r, "classes"), table(s, r, "classes").filter("coco_cat_id <= 20"), records(s, r)))
# mutations of tables
BATCH = "(SELECT min(batch_id) FROM rec)"


def replaced(spark: SparkSession, root: str) -> DataFrame:
    """The first batch ingested again in mode `replace`, as new ids."""
    d = records(spark, root)
    first = d.agg(F.min("batch_id").alias("batch_id"))  # one row
    again = d.join(F.broadcast(first), "batch_id").select(*d.columns).withColumn("iuid", F.reverse("iuid")).withColumn("assigned_class", F.lit(None).cast("string")).withColumn("merged_into", F.lit(None).cast("string")).withColumn("is_background", F.lit(False))
    return events.ingest(d, again, "replace").select("iuid", "image_id", "assigned_class", "is_background")


add("ingest_replace", f""", n AS (SELECT reverse(iuid) AS iuid, image_id FROM rec WHERE batch_id = {BATCH})
SELECT iuid, image_id, assigned_class, is_background OR (assigned_class IS NULL AND merged_into IS NULL AND coalesce(image_id IN (SELECT image_id FROM n WHERE image_id IS NOT NULL), false)) AS is_background FROM rec
UNION ALL SELECT iuid, image_id, NULL, false FROM n WHERE iuid NOT IN (SELECT iuid FROM rec)""", replaced)
on_records("reset_state", "SELECT iuid, image_id, CAST(NULL AS VARCHAR) AS assigned_class, false AS is_background FROM rec", lambda d: events.reset(d).select("iuid", "image_id", "assigned_class", "is_background"))


def partition_accepts(spark: SparkSession, root: str) -> DataFrame:
    """State after the whole partition 3 is assigned and the partition 5 rejected."""
    d = records(spark, root)
    step = lambda pid, op, seq: browse.members(d, pid).select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), "iuid", F.lit("c_8c08584ec6c4").alias("class"), F.lit("partition").alias("source"), F.col("assign_score").alias("score"))
    return events.fold(step("3", "assign", 1).unionByName(step("5", "background", 2))).select("iuid", "assigned_class", "is_background", "assign_source")


on_pid = f"SELECT iuid, CASE WHEN pid = 3 THEN 'c_8c08584ec6c4' END AS assigned_class, pid = 5 AS is_background, CASE WHEN pid = 3 THEN 'partition' END AS assign_source FROM rec WHERE {POOL} AND pid IN (3, 5)"
add("assign_partition", on_pid, partition_accepts)
# exports
add("full_manifest", f"""SELECT 'img_' || CAST(image_id AS VARCHAR) || '.jpg' AS file, CASE WHEN is_background THEN '__rejected__' ELSE coalesce(name, assigned_class) END AS class, iuid, coalesce(source, 'unregistered') AS source_id, granularity, modality
FROM (SELECT rec.*, bat.source FROM rec LEFT JOIN bat USING (batch_id)) LEFT JOIN classes ON class_id = assigned_class WHERE {LIVE} AND (is_background OR assigned_class IS NOT NULL)""",
    lambda s, r: exports.full_manifest(with_source(records(s, r), batches(s, r)), table(s, r, "classes")))
add("project_report", f"""SELECT 'instances' AS metric, count(*) FILTER ({LIVE}) AS value FROM rec UNION ALL SELECT 'assigned', count(*) FILTER ({LIVE} AND {MEMBER}) FROM rec UNION ALL SELECT 'rejected', count(*) FILTER ({LIVE} AND is_background) FROM rec
UNION ALL SELECT 'images', count(DISTINCT image_id) FROM rec UNION ALL SELECT 'op:' || op, count(*) FROM cmd GROUP BY op""", lambda s, r: exports.report(records(s, r), commands(s, r)), f"{REC}, {CMD}")
