"""Queries over exports, imports, event folding, sets and the project's own tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.columns import hex_id
from gleaner.operators import events, exports, release, stats
from gleaner.operators.boxes import iou
from gleaner.operators.views import is_live, is_member, with_source
from gleaner.plans.adapters import DIMS, INST, dim, gate, instances
from gleaner.sources.documents import match_basename
from gleaner.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BOTH = f"WITH RECURSIVE {INST},\n{DIMS}"
MEMBER = "assigned_class IS NOT NULL AND NOT is_background"
POOL = "assigned_class IS NULL AND NOT is_background AND merged_into IS NULL"


def add(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLES[name] = sql


def _categories(spark: SparkSession) -> DataFrame:
    return exports.category_ids(dim(spark, "cls").selectExpr("class_id", "class_id as place", "pin"))


CATS = "cats(class_id, category_id) AS (VALUES ('A', 2), ('N', 1), ('R', 3), ('T', 4))"
add("category_ids", f"WITH {CATS} SELECT * FROM cats", lambda s, r: _categories(s))
add("category_ids_classes", """WITH c AS (SELECT class_id, coco_cat_id AS pin, row_number() OVER (PARTITION BY coco_cat_id ORDER BY class_id) AS nth FROM classes),
p AS (SELECT class_id, pin FROM c WHERE pin >= 1 AND nth = 1), r AS (SELECT class_id, row_number() OVER (ORDER BY class_id) AS k FROM c WHERE class_id NOT IN (SELECT class_id FROM p)),
f AS (SELECT g, row_number() OVER (ORDER BY g) AS k FROM range(1, 1000) t(g) WHERE g NOT IN (SELECT pin FROM p))
SELECT class_id, CAST(pin AS INT) AS category_id FROM p UNION ALL SELECT class_id, CAST(g AS INT) FROM r JOIN f USING (k)""",
    lambda s, r: exports.category_ids(table(s, r, "classes").selectExpr("class_id", "class_id as place", "coco_cat_id as pin")))
add("coco_annotations", f"""{BOTH}, {CATS}, h AS (SELECT image_id FROM live GROUP BY 1 HAVING image_id % 3 = 1 AND count(*) FILTER (NOT is_background) > 0)
SELECT row_number() OVER (ORDER BY iuid) AS id, iuid, image_id, category_id, x0 AS x, y0 AS y, bw AS w, bh AS h, area, coalesce(assign_source, '?') <> 'classifier' AS class_reviewed, mask_reviewed
FROM live JOIN cats ON class_id = assigned_class WHERE {MEMBER} AND image_id NOT IN (SELECT image_id FROM h) AND assigned_class NOT IN (SELECT class_id FROM cls WHERE temp)""",
    lambda s, r: exports.annotations(d := instances(s, r), _categories(s), release.held(d, gate(F.col("image_id")), "exclude_rejected"), dim(s, "cls").filter("temp")))
add("partial_export", f"""{BOTH} SELECT image_id, count(*) FILTER ({MEMBER}) AS n_pos, count(*) FILTER ({POOL}) AS n_ign, count(*) FILTER (is_background) AS n_neg,
 count(*) FILTER ({POOL}) = 0 AND count(*) FILTER ({MEMBER}) + count(*) FILTER (is_background) > 0 AS reviewed_exhaustive FROM live GROUP BY 1""", lambda s, r: exports.partial_labels(instances(s, r)))
add("manifest", f"""{BOTH} SELECT 'img_' || CAST(image_id AS VARCHAR) || '.jpg' AS file, CASE WHEN is_background THEN '__rejected__' ELSE assigned_class END AS class, iuid FROM live WHERE is_background OR assigned_class IS NOT NULL""",
    lambda s, r: exports.manifest(instances(s, r)))
add("merge_coco", f"""{BOTH}, u AS (SELECT CASE WHEN batch_id IN ('b0', 'b1') THEN 'one/' ELSE 'two/' END || CAST(image_id AS VARCHAR) AS image, assigned_class AS category, iuid FROM live WHERE {MEMBER})
SELECT image, category, iuid, dense_rank() OVER (ORDER BY category) AS category_id FROM u""",
    lambda s, r: exports.merge_documents({n: instances(s, r).filter(is_live() & is_member() & F.col("batch_id").isin(*b)).select("image_id", F.col("assigned_class").alias("category"), "iuid") for n, b in (("one", ("b0", "b1")), ("two", ("b2", "b3")))}))
add("import_match", f"""{BOTH}, n AS (SELECT *, iuid % 3 = 0 AS moved FROM live WHERE pid < 3), k AS (SELECT * FROM live WHERE pid >= 3 OR iuid % 3 <> 0),
x AS (SELECT n.iuid AS a, k.iuid AS b, greatest(least(n.x1, k.x1) - greatest(n.x0, k.x0), 0) * greatest(least(n.y1, k.y1) - greatest(n.y0, k.y0), 0) AS i, n.area AS aa, k.area AS ka FROM n JOIN k USING (image_id) WHERE n.moved),
m AS (SELECT a, b FROM x WHERE i / (aa + ka - i + 1e-6) > 0.3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY i / (aa + ka - i + 1e-6) DESC, b) = 1)
SELECT iuid, CASE WHEN moved THEN b ELSE iuid END AS match, CASE WHEN NOT moved THEN 'iuid' WHEN b IS NULL THEN 'none' ELSE 'iou' END AS how FROM n LEFT JOIN m ON a = iuid""",
    lambda s, r: exports.match_imports((d := instances(s, r).filter(is_live())).filter("pid < 3"), d.filter("pid >= 3 or iuid % 3 != 0"), iou()))
add("unmatched_basename", """WITH i AS (SELECT 'in/img_' || CAST(o_orderkey % 5000 AS VARCHAR) || '.jpg' AS file_name FROM orders), k AS (SELECT DISTINCT 'img_' || CAST(l_orderkey AS VARCHAR) || '.jpg' AS base FROM lineitem)
SELECT file_name, count(*) AS n FROM i WHERE substr(file_name, 4) NOT IN (SELECT base FROM k) GROUP BY 1""",
    lambda s, r: match_basename(table(s, r, "orders").select(F.concat(F.lit("in/img_"), (F.col("o_orderkey") % 5000).cast("string"), F.lit(".jpg")).alias("file_name")),
                                table(s, r, "lineitem").select(F.concat(F.lit("all/img_"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"), F.col("l_orderkey").alias("image_id"), F.col("l_orderkey").alias("row")))[1].groupBy("file_name").agg(F.count("*").alias("n")))


def _marks(s: SparkSession, r: str) -> DataFrame:
    d = instances(s, r)
    return exports.annotations(d, _categories(s), release.held(d, gate(F.col("image_id")), "exclude_rejected"), dim(s, "cls").filter("temp"))


A = ORACLES["coco_annotations"]
add("coco_document", f"""WITH a AS ({A}), i AS (SELECT DISTINCT image_id FROM a) SELECT 'images' AS part, image_id AS id, CAST(json_object('id', CAST(image_id AS VARCHAR), 'file_name', 'img_' || CAST(image_id AS VARCHAR) || '.jpg') AS VARCHAR) AS json FROM i
UNION ALL SELECT 'categories', category_id, CAST(json_object('id', category_id, 'name', class_id) AS VARCHAR) FROM (VALUES ('A', 2), ('N', 1), ('R', 3), ('T', 4)) c(class_id, category_id)
UNION ALL SELECT 'annotations', id, CAST(json_object('id', id, 'image_id', CAST(image_id AS VARCHAR), 'category_id', category_id, 'bbox', [x, y, w, h], 'area', CAST(area AS BIGINT), 'iuid', CAST(iuid AS VARCHAR), 'iscrowd', 0) AS VARCHAR) FROM a""",
    lambda s, r: (lambda m: exports.document(m.select("image_id").distinct().withColumn("file_name", F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".jpg"))), _categories(s).select("category_id", F.col("class_id").alias("name")), m.withColumn("iscrowd", F.lit(0))))(_marks(s, r)))
add("partial_annotations", f"""{BOTH}, {CATS} SELECT row_number() OVER (ORDER BY iuid) AS id, iuid, image_id, coalesce(category_id, 0) AS category_id, CAST(assigned_class IS NULL AS INT) AS iscrowd FROM live LEFT JOIN cats ON class_id = assigned_class WHERE NOT is_background AND (assigned_class IS NULL OR category_id IS NOT NULL)""",
    lambda s, r: exports.with_ignored(instances(s, r), _categories(s)))
add("coco_agnostic", f"SELECT id, iuid, image_id, 1 AS category_id FROM ({A})", lambda s, r: exports.agnostic(_marks(s, r))[0].select("id", "iuid", "image_id", "category_id"))
add("batch_document", f"""{BOTH} SELECT row_number() OVER (ORDER BY iuid) AS id, iuid, image_id, assigned_class AS label, dense_rank() OVER (ORDER BY assigned_class) AS category_id FROM live WHERE {MEMBER} AND batch_id = 'b1'""", lambda s, r: exports.labelled_batch(instances(s, r), "b1"))
add("unreviewed_counts", f"""{BOTH}, {CATS} SELECT category_id, count(*) AS n, count(*) FILTER (coalesce(assign_source, '?') = 'classifier') AS n_class_unreviewed, count(*) FILTER (NOT mask_reviewed) AS n_mask_unreviewed FROM live JOIN cats ON class_id = assigned_class WHERE {MEMBER} GROUP BY 1""",
    lambda s, r: exports.unreviewed(instances(s, r), _categories(s)))
add("merged_document", f"SELECT *, row_number() OVER (ORDER BY image, iuid) AS id FROM ({ORACLES['merge_coco']})", lambda s, r: exports.numbered(QUERIES["merge_coco"](s, r), "id", "image", "iuid"))
add("patched_annotations", f"SELECT id, iuid, CASE WHEN iuid % 5 = 0 THEN x + 1 ELSE x END AS x, CASE WHEN iuid % 5 = 0 THEN w - 1 ELSE w END AS w, CASE WHEN iuid % 5 = 0 THEN (w - 1) * h ELSE area END AS area FROM ({A})",
    lambda s, r: (lambda m: exports.patched(m, m.filter("iuid % 5 = 0").select("iuid", (F.col("x") + 1).alias("x"), "y", (F.col("w") - 1).alias("w"), "h", ((F.col("w") - 1) * F.col("h")).cast("double").alias("area"))).select("id", "iuid", "x", "w", "area"))(_marks(s, r)))


def commands(spark: SparkSession, root: str) -> DataFrame:
    """events as commands on 500 items."""
    kind = F.col("event_type")
    op = F.when(kind == "view", "assign").when(kind == "click", "unassign").when(kind == "purchase", "background").when(kind == "signup", "unreject").otherwise("undo")
    return table(spark, root, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("actor"), op.alias("op"), (F.col("event_id") * 7 % 500).alias("iuid"),
                                               F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")).alias("class"), F.when(F.col("event_id") % 2 == 0, "manual").otherwise("classifier").alias("source"))


COMMANDS = """c AS (SELECT event_id AS seq, user_id AS actor, CASE event_type WHEN 'view' THEN 'assign' WHEN 'click' THEN 'unassign' WHEN 'purchase' THEN 'background' WHEN 'signup' THEN 'unreject' ELSE 'undo' END AS op,
 event_id * 7 % 500 AS iuid, 'c' || CAST(event_id % 5 AS VARCHAR) AS class, CASE WHEN event_id % 2 = 0 THEN 'manual' ELSE 'classifier' END AS source FROM events)"""
FOLDED = f"""WITH {COMMANDS}, t AS (SELECT *, CASE WHEN op IN ('background', 'dedup') THEN 1 WHEN op IN ('assign', 'unreject') THEN 0 END AS bg FROM c WHERE op <> 'undo'),
w AS (SELECT *, coalesce(last_value(bg IGNORE NULLS) OVER (PARTITION BY iuid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was FROM t), d AS (SELECT * FROM w WHERE op <> 'unreject' OR was),
i AS (SELECT DISTINCT iuid FROM d), k AS (SELECT iuid, max(seq) AS since, arg_max(CASE WHEN op = 'assign' THEN class ELSE '' END, seq) AS v FROM d WHERE op IN ('assign', 'unassign', 'background', 'unreject') GROUP BY 1),
b AS (SELECT iuid, arg_max(bg, seq) AS v FROM d WHERE bg IS NOT NULL GROUP BY 1), s AS (SELECT iuid, arg_max(CASE WHEN op = 'assign' THEN source ELSE '' END, seq) AS v FROM d WHERE op IN ('assign', 'unassign') GROUP BY 1),
f AS (SELECT iuid, nullif(k.v, '') AS assigned_class, k.since, coalesce(b.v, 0) = 1 AS is_background, nullif(s.v, '') AS assign_source, CAST(NULL AS DOUBLE) AS assign_score, false AS mask_reviewed
 FROM i LEFT JOIN k USING (iuid) LEFT JOIN b USING (iuid) LEFT JOIN s USING (iuid))"""
add("fold_state", f"{FOLDED} SELECT * EXCLUDE (since) FROM f", lambda s, r: events.fold(commands(s, r).filter("op != 'undo'")))
add("fold_dedup", FOLDED.replace("WHEN 'click' THEN 'unassign'", "WHEN 'click' THEN 'dedup'") + " SELECT iuid, assigned_class, is_background FROM f",
    lambda s, r: events.fold(commands(s, r).filter("op != 'undo'").withColumn("op", F.when(F.col("op") == "unassign", "dedup").otherwise(F.col("op")))).select("iuid", "assigned_class", "is_background"))
add("fold_merged_classes", f"{FOLDED} SELECT iuid, CASE WHEN assigned_class = 'c1' AND since < 400 THEN 'c3' WHEN assigned_class = 'c2' AND since < 300 THEN CASE WHEN since < 400 THEN 'c3' ELSE 'c1' END ELSE assigned_class END AS assigned_class FROM f",
    lambda s, r: events.fold(commands(s, r).filter("op != 'undo'"), s.createDataFrame([(300, "c2", "c1"), (400, "c1", "c3")], "seq long, old string, new string")).select("iuid", "assigned_class"))
add("accepted_masks", f"WITH {COMMANDS} SELECT iuid, bool_or(op = 'accept_masks') AS mask_reviewed FROM (SELECT * REPLACE (CASE op WHEN 'unreject' THEN 'accept_masks' ELSE op END AS op) FROM c) WHERE op <> 'undo' GROUP BY 1",
    lambda s, r: events.fold(commands(s, r).filter("op != 'undo'").withColumn("op", F.when(F.col("op") == "unreject", "accept_masks").otherwise(F.col("op")))).select("iuid", "mask_reviewed"))
add("release_gates", f"WITH {COMMANDS} SELECT iuid AS image_id, CASE arg_max(class, seq) WHEN 'c0' THEN 'accepted' WHEN 'c1' THEN 'rejected' ELSE 'pending' END AS gate FROM c WHERE op = 'assign' GROUP BY 1",
    lambda s, r: events.gates(commands(s, r).withColumn("op", F.when(F.col("op") == "assign", "release_set")).select("seq", "op", F.col("iuid").alias("image_id"), F.when(F.col("class") == "c0", "accepted").when(F.col("class") == "c1", "rejected").otherwise(F.col("class")).alias("gate"))))
add("replayed", None, lambda s, r: events.replay(commands(s, r).withColumn("op", F.when((F.col("op") == "unreject") & (F.col("seq") % 2 == 0), "redo").otherwise(F.col("op")))))
add("effective_commands", f"""WITH {COMMANDS}, l AS (SELECT *, sum(CASE WHEN op = 'undo' THEN -1 ELSE 1 END) OVER (PARTITION BY actor ORDER BY seq) AS lv FROM c)
SELECT seq FROM l a WHERE op <> 'undo' AND NOT EXISTS (SELECT 1 FROM l b WHERE b.actor = a.actor AND b.seq > a.seq AND b.lv < a.lv)""", lambda s, r: events.effective(commands(s, r)).select("seq"))
add("distinct_merge_groups", """SELECT DISTINCT array_to_string(list_sort(list_distinct(list_transform(merge_members, lambda x: lower(trim(x))))), ',') AS members FROM meta WHERE len(merge_members) > 0""",
    lambda s, r: table(s, r, "meta").filter("size(merge_members) > 0").select(F.array_join(F.array_sort(F.array_distinct(F.transform("merge_members", lambda x: F.lower(F.trim(x))))), ",").alias("members")).distinct())
add("class_name_dedupe", "SELECT lower(trim(name)) AS name, min(class_id) AS class_id FROM classes GROUP BY 1", lambda s, r: table(s, r, "classes").groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("class_id").alias("class_id")))


def meta_rows(spark: SparkSession, root: str) -> DataFrame:
    """meta with usable ids, each once (its row with the smallest row number, then image)."""
    m = table(spark, root, "meta").withColumn("id", hex_id("iuid")).filter("id is not null")
    cols = ["row_no", "image_id", "batch_id", "granularity", "modality", "assigned_class", "is_background", "assign_source", "refined", "provenance"]
    once = m.groupBy("id").agg(F.min(F.struct(*cols, hex_id("merged_into").alias("merged_into"))).alias("r"))
    return once.select(F.col("id").alias("iuid"), "r.*")


META = """WITH m AS (SELECT regexp_replace(lower(iuid), '[\\s{}-]', '', 'g') AS id, * FROM meta),
r AS (SELECT * FROM m WHERE regexp_matches(id, '^[0-9a-f]{32}$') QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no NULLS FIRST, image_id NULLS FIRST, batch_id NULLS FIRST, granularity NULLS FIRST, modality NULLS FIRST, assigned_class NULLS FIRST,
  is_background NULLS FIRST, assign_source NULLS FIRST, refined NULLS FIRST, provenance NULLS FIRST,
  CASE WHEN regexp_matches(regexp_replace(lower(merged_into), '[\\s{}-]', '', 'g'), '^[0-9a-f]{32}$') THEN regexp_replace(lower(merged_into), '[\\s{}-]', '', 'g') END NULLS FIRST) = 1)"""
add("facet_kinds", f"{META} SELECT granularity, modality, count(*) AS n FROM r GROUP BY 1, 2", lambda s, r: meta_rows(s, r).groupBy("granularity", "modality").agg(F.count("*").alias("n")))
SOURCES = "b AS (SELECT batch_id, min(source) AS source FROM (SELECT unnest(batch_ids) AS batch_id, source FROM ingests) WHERE batch_id IS NOT NULL GROUP BY 1)"
add("provenance_methods", f"""{META}, {SOURCES} SELECT CASE WHEN refined AND list_contains(json_keys(provenance), 'draw') THEN 'hand-drawn' WHEN json_extract_string(provenance, '$.manual') NOT IN ('', 'false', '0') THEN 'manual'
  ELSE coalesce(json_extract_string(provenance, '$.box_pick.by[0]'), nullif(json_extract_string(provenance, '$.remask.backend'), ''), source, 'unregistered') END AS method, count(*) AS n FROM r LEFT JOIN b USING (batch_id) GROUP BY 1""",
    lambda s, r: with_source(meta_rows(s, r), batches(s, r)).groupBy(stats.method_of("provenance", F.col("refined"), F.col("source")).alias("method")).agg(F.count("*").alias("n")))


def batches(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, source) of the registered ingests, one row per batch (the least source, if several name it)."""
    return table(spark, root, "ingests").select(F.explode("batch_ids").alias("batch_id"), "source").filter("batch_id is not null").groupBy("batch_id").agg(F.min("source").alias("source"))


add("ingest_live", f"""{META}, i AS (SELECT DISTINCT ingest_id, unnest(batch_ids) AS batch_id FROM ingests),
p AS (SELECT batch_id, count(*) AS n FROM r WHERE assigned_class IS NULL AND NOT is_background AND NOT coalesce(regexp_matches(regexp_replace(lower(merged_into), '[\\s{{}}-]', '', 'g'), '^[0-9a-f]{{32}}$'), false) GROUP BY 1)
SELECT ingest_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pool FROM (SELECT DISTINCT ingest_id FROM ingests) LEFT JOIN i USING (ingest_id) LEFT JOIN p USING (batch_id) GROUP BY 1""",
    lambda s, r: stats.batch_live(meta_rows(s, r), table(s, r, "ingests")))
add("release_rules_concepts", """WITH r AS (SELECT unnest(part_rules) AS p FROM concepts), w AS (SELECT p.if_class AS if_class, unnest(p.then_classes) AS missing FROM r),
h AS (SELECT DISTINCT image_id, assigned_class AS c FROM meta WHERE assigned_class IS NOT NULL AND NOT is_background AND image_id IS NOT NULL)
SELECT DISTINCT h.image_id, w.if_class, w.missing FROM h JOIN w ON h.c = w.if_class WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.image_id = h.image_id AND x.c = w.missing)""", lambda s, r: concept_rules(s, r))


def concept_rules(spark: SparkSession, root: str) -> DataFrame:
    """The concepts' part rules over meta: images that hold a class but lack one that it demands."""
    rules = table(spark, root, "concepts").select(F.explode("part_rules").alias("p")).select(F.col("p.if_class").alias("if_class"), F.explode("p.then_classes").alias("then_class"))
    rows = table(spark, root, "meta").filter("image_id is not null").select("image_id", "assigned_class", "is_background", F.lit(None).cast("string").alias("merged_into"))
    return release.part_rules(rows, rules)
