"""Queries over vectors, suggestions and confidences, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.operators import events, models, suggest, vectors
from gleaner.plans.adapters import VEC, embedded
from gleaner.session import materialize
from gleaner.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
THRESHOLD = 0.65


def on_vectors(name: str, sql: str | None, f) -> None:
    QUERIES[name] = lambda spark, root: f(embedded(spark, root))
    if sql is not None:
        ORACLES[name] = f"WITH RECURSIVE {VEC}{sql}"


def pool(d: DataFrame) -> DataFrame:
    return d.filter("label is null")


def labelled(d: DataFrame) -> DataFrame:
    return d.filter("label is not null")


def classed(d: DataFrame) -> DataFrame:
    return d.filter("label is not null and label != '__reject__'")


def predicted(d: DataFrame) -> DataFrame:
    return suggest.predict(pool(d), labelled(d), THRESHOLD).join(d.select("iuid", "image_id", (F.col("iuid") % 7).alias("pid")), "iuid")


def confidences(d: DataFrame) -> DataFrame:
    return suggest.knn_confidence(pool(d), classed(d), d.filter("label = '__reject__'"))


PRED = f""", near AS (SELECT a AS iuid, ia AS image_id, 1 - cos AS d, lb FROM sims WHERE la IS NULL AND lb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) = 1),
pred AS (SELECT iuid, image_id, iuid % 7 AS pid, d, CASE WHEN d <= {THRESHOLD} THEN lb ELSE '__nomatch__' END AS label FROM near)"""
MARGIN = """, lab AS (SELECT a, max(cos) AS cos FROM sims WHERE la <> '__reject__' AND lb <> '__reject__' AND la <> lb GROUP BY 1)"""
CONF = f"""{MARGIN}, scale AS (SELECT greatest(median(1 - cos), 1e-6) AS scale FROM lab),
k3 AS (SELECT a, lb, cos FROM sims WHERE la IS NULL AND lb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a, lb ORDER BY cos DESC, b) <= 3),
dd AS (SELECT a, lb, avg(1 - cos) AS d FROM k3 GROUP BY 1, 2),
conf AS (SELECT x.a AS iuid, x.lb AS label, CASE WHEN x.d > y.d THEN 0.0 ELSE exp(-x.d / scale) END AS p FROM dd x LEFT JOIN dd y ON y.a = x.a AND y.lb = '__reject__', scale WHERE x.lb <> '__reject__')"""

on_vectors("l2_norms", " SELECT iuid, round(norm, 6) AS norm FROM norm", lambda d: d.select("iuid", F.round(vectors.norm("vec"), 6).alias("norm")))
on_vectors("zscore_stats", " SELECT pos - 1 AS pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM cell GROUP BY 1",
           lambda d: vectors.column_stats(d, "vec").select("pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")))
on_vectors("fused_space", """, n8 AS (SELECT iuid, sqrt(sum(x * x)) AS n FROM cell WHERE pos <= 8 GROUP BY 1),
both_ AS (SELECT iuid, pos - 1 AS pos, x, 1.0 AS w FROM unit UNION ALL SELECT c.iuid, c.pos + 63, c.x / (n + 1e-9), 0.5 FROM cell c JOIN n8 USING (iuid) WHERE c.pos <= 8),
s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM both_ GROUP BY 1)
SELECT iuid, pos, round((x - m) / (sd + 1e-9) * w, 5) + 0.0 AS x FROM both_ JOIN s USING (pos)""",
           lambda d: vectors.fuse(d.select("iuid", "vec", F.slice("vec", 1, 8).alias("head")), {"vec": 1.0, "head": 0.5}).select("iuid", F.posexplode("fused").alias("pos", "x")).withColumn("x", F.round("x", 5) + 0.0))
on_vectors("similar_topk", " SELECT b AS iuid, round(cos, 6) AS cos FROM sims WHERE a = 1 AND lb IS NULL ORDER BY sims.cos DESC, b LIMIT 25", lambda d: find_similar(d, 1, 25))
on_vectors("match_dedup", """ SELECT group_key, b AS iuid, round(cos, 6) AS cos FROM (SELECT *, CASE WHEN lb IS NULL THEN 'pid:' || CAST(b % 7 AS VARCHAR) ELSE 'class:' || lb END AS group_key FROM sims WHERE a = 1 AND coalesce(lb, '') <> '__reject__')
 QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY sims.cos DESC, b) = 1""".replace("sims.cos DESC", "cos DESC"), lambda d: match_groups(d, 1))
on_vectors("nn_margin", f"{MARGIN} SELECT round(median(1 - cos), 6) AS margin FROM lab", lambda d: suggest.margin(classed(d)).select(F.round("margin", 6).alias("margin")))
on_vectors("nn_predict", f"{PRED} SELECT iuid, round(d, 6) AS d, label FROM pred", lambda d: suggest.predict(pool(d), labelled(d), THRESHOLD).select("iuid", F.round("d", 6).alias("d"), "label"))
on_vectors("suggestion", f"""{PRED}, v AS (SELECT pid, label, count(*) AS n FROM pred GROUP BY 1, 2),
t AS (SELECT pid, label, n FROM v WHERE label NOT IN ('__reject__', '__nomatch__') QUALIFY row_number() OVER (PARTITION BY pid ORDER BY n DESC, label) = 1),
s AS (SELECT pid, CAST(sum(n) AS BIGINT) AS members, CAST(coalesce(sum(n) FILTER (label = '__reject__'), 0) AS BIGINT) AS n_reject, CAST(coalesce(sum(n) FILTER (label = '__nomatch__'), 0) AS BIGINT) AS n_none FROM v GROUP BY 1)
SELECT pid, members, t.label AS top_class, n_reject, n_none, round(coalesce(t.n, 0) / members, 6) AS confidence, (SELECT round(median(d), 6) FROM pred x WHERE x.pid = s.pid) AS median_d,
 CASE WHEN coalesce(t.n, -1) >= n_reject AND coalesce(t.n, -1) >= n_none THEN 'class' WHEN n_reject >= n_none THEN 'reject' ELSE 'none' END AS verdict FROM s LEFT JOIN t USING (pid)""", lambda d: suggest.verdicts(predicted(d), "pid"))
on_vectors("image_summary", f"{PRED} SELECT image_id, label, count(*) AS n, round(avg(greatest(0.0, 1 - d)), 6) AS score FROM pred WHERE label <> '__nomatch__' GROUP BY 1, 2", lambda d: suggest.image_summary(predicted(d)))
on_vectors("workload_rank", f"""{PRED}, w AS (SELECT image_id, count(*) AS n_uncat, count(*) FILTER (d > {THRESHOLD}) AS n_none, count(*) FILTER (d > 0.75 * {THRESHOLD} AND d <= {THRESHOLD}) AS n_border FROM pred GROUP BY 1)
SELECT image_id, n_uncat, n_none, n_border, n_uncat - n_none - n_border AS n_auto, n_none + 0.5 * n_border AS work_est, round((n_uncat - n_none - n_border) / n_uncat, 6) AS auto_frac FROM w""", lambda d: suggest.workload(predicted(d), THRESHOLD))
BANK = """, q AS (SELECT a, b, lb, cos FROM sims WHERE NOT ba AND bb), rq AS (SELECT a, avg(cos) AS rq FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) <= 10) GROUP BY 1),
rb AS (SELECT b, avg(cos) AS rb FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY b ORDER BY cos DESC, a) <= 10) GROUP BY 1)"""
on_vectors("csls", f"""{BANK} SELECT a AS q, b AS r, lb AS label, round(2 * cos - rq - rb, 6) AS csls FROM q JOIN rq USING (a) JOIN rb USING (b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY 2 * cos - rb DESC, b) = 1""",
           lambda d: suggest.csls(d.filter("not bank"), d.filter("bank")))
on_vectors("bank_suggest", f"""{BANK}, t AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) <= 10), m AS (SELECT a, lb, max(cos) AS cos FROM t GROUP BY 1, 2)
SELECT a AS q, lb AS label, round(cos, 6) AS score, row_number() OVER (PARTITION BY a ORDER BY m.cos DESC, lb) AS rank FROM m QUALIFY rank <= 3""", lambda d: suggest.bank_suggest(d.filter("not bank"), d.filter("bank")))
on_vectors("rank_for_class", f"{BANK} SELECT a AS q, round(max(cos), 6) AS score FROM q WHERE lb = 'c1' GROUP BY 1 ORDER BY max(cos) DESC, a LIMIT 40", lambda d: suggest.rank_for_class(d.filter("not bank"), d.filter("bank"), "c1", 40))
on_vectors("knn_conf", f"{CONF} SELECT iuid, label, round(p, 6) AS p FROM conf", lambda d: confidences(d).withColumn("p", F.round("p", 6)))
on_vectors("active_entropy", f"""{CONF}, t AS (SELECT iuid, sum(p) AS s, count(*) AS c FROM conf GROUP BY 1), q AS (SELECT iuid, c, CASE WHEN s <= 1e-12 THEN 1.0 / c ELSE p / s END AS q FROM conf JOIN t USING (iuid)),
o AS (SELECT iuid, any_value(c) AS c, -sum(q * ln(q + 1e-12)) / ln(any_value(c)) AS e, list_sort(list(q), 'DESC') AS l FROM q GROUP BY 1)
SELECT iuid, round(e, 6) + 0.0 AS entropy, round(1 - (l[1] - l[2]), 6) AS margin, round(1 - l[1], 6) AS least_conf FROM o""", lambda d: suggest.uncertainty(confidences(d)))
on_vectors("threshold_assign", f"{CONF}, t AS (SELECT iuid, label, round(p, 6) AS p FROM conf QUALIFY row_number() OVER (PARTITION BY iuid ORDER BY conf.p DESC, label) = 1) SELECT * FROM t WHERE p >= 0.3", lambda d: suggest.assign_above(confidences(d), 0.3))
on_vectors("rejections", f"{CONF}, t AS (SELECT iuid, round(max(p), 6) AS p FROM conf GROUP BY 1) SELECT * FROM t WHERE p < 0.35", lambda d: suggest.rejections(confidences(d), 0.35))
on_vectors("finch_level0", """, e AS (SELECT a, b FROM sims QUALIFY row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) = 1), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS least FROM s UNION SELECT s.b, r.least FROM r JOIN s ON s.a = r.node WHERE r.least < s.b) SELECT node AS iuid, min(least) AS cluster FROM r GROUP BY 1""", lambda d: vectors.finch_level(d))
on_vectors("finch_levels", None, lambda d: vectors.finch(d.select("iuid", "vec", F.lit(None).cast("string").alias("label"))))
on_vectors("coord_frame", " SELECT pos - 1 AS pos, round(min(x), 6) AS low, round(max(x), 6) AS high FROM cell GROUP BY 1",
           lambda d: d.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.round(F.min(F.col("x").cast("double")), 6).alias("low"), F.round(F.max(F.col("x").cast("double")), 6).alias("high")))
on_vectors("reference_counts", " SELECT label, count(*) AS n FROM vec WHERE bank AND label IS NOT NULL GROUP BY 1", lambda d: labelled(d).filter("bank").groupBy("label").agg(F.count("*").alias("n")))
WORK = f"""{PRED}, w AS (SELECT image_id, count(*) AS n_uncat, count(*) FILTER (d > {THRESHOLD}) AS n_none, count(*) FILTER (d > 0.75 * {THRESHOLD} AND d <= {THRESHOLD}) AS n_border FROM pred GROUP BY 1),
z AS (SELECT image_id, n_uncat, n_none + 0.5 * n_border AS work_est, round((n_uncat - n_none - n_border) / n_uncat, 6) AS auto_frac FROM w)"""


def work(d: DataFrame) -> DataFrame:
    return suggest.workload(predicted(d), THRESHOLD)


def diversified(d: DataFrame) -> DataFrame:
    p = predicted(d).filter("label not in ('__reject__', '__nomatch__')")
    shares = p.groupBy("image_id", "label").agg(F.count("*").alias("k")).withColumn("share", F.expr("k / sum(k) over (partition by image_id)"))
    return suggest.diversify(suggest.ranked_work(work(d)), shares, classed(d).groupBy("label").agg(F.count("*").alias("n")), 30)


on_vectors("diversify", None, diversified)
on_vectors("workload_easy", f"{WORK} SELECT image_id, row_number() OVER (ORDER BY work_est, auto_frac DESC, n_uncat, CAST(image_id AS VARCHAR)) AS rank FROM z", lambda d: suggest.ranked_work(work(d)).select("image_id", "rank"))
on_vectors("workload_hard", f"{WORK} SELECT image_id, row_number() OVER (ORDER BY work_est DESC, n_uncat DESC, image_id) AS rank FROM z", lambda d: suggest.ranked_work(work(d), "hard").select("image_id", "rank"))
on_vectors("nn_threshold", f"{MARGIN} SELECT round(coalesce(0.5 * median(1 - cos), 0.25), 6) AS threshold FROM lab", lambda d: suggest.threshold(suggest.margin(classed(d))).select(F.round("threshold", 6).alias("threshold")))
on_vectors("predicted_members", f"{PRED} SELECT iuid FROM pred WHERE pid = 3 AND label = 'c1'", lambda d: suggest.predicted_members(predicted(d), 3, "c1"))
on_vectors("image_distances", f"{PRED} SELECT image_id, iuid, round(d, 6) AS d FROM pred", lambda d: predicted(d).select("image_id", "iuid", F.round("d", 6).alias("d")))
on_vectors("accepted_suggestions", f"{PRED} SELECT iuid, CASE WHEN label <> '__reject__' THEN label END AS assigned_class, label = '__reject__' AS is_background FROM pred WHERE label <> '__nomatch__'",
           lambda d: events.fold(suggest.accept(predicted(d), d, 1)).select("iuid", "assigned_class", "is_background"))
on_vectors("rank_distinct", f"""{BANK}, c AS (SELECT a, a % 7 AS pid, max(cos) AS cos FROM q WHERE lb = 'c1' GROUP BY 1), o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY pid ORDER BY cos DESC, a) = 1)
SELECT pid, a AS q, round(cos, 6) AS score FROM o ORDER BY round(cos, 6) DESC, a LIMIT 5""", lambda d: suggest.rank_distinct(d.filter("not bank").withColumn("pid", F.col("iuid") % 7), d.filter("bank"), "c1", "pid", 5))
on_vectors("bank_added", " SELECT iuid, label FROM vec WHERE bank AND label IS NOT NULL OR (iuid % 3 = 0 AND label IS NOT NULL AND label <> '__reject__')", lambda d: suggest.grow_bank(d.filter("bank and label is not null"), d.filter("iuid % 3 = 0")).select("iuid", "label"))
on_vectors("match_lists", """, k AS (SELECT CASE WHEN lb IS NULL THEN 'pid:' || CAST(b % 7 AS VARCHAR) ELSE 'class:' || lb END AS group_key, b AS iuid, cos FROM sims WHERE a = 1 AND coalesce(lb, '') <> '__reject__'),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY cos DESC, iuid) = 1), l AS (SELECT 'mixed' AS list, * FROM b UNION ALL SELECT CASE WHEN group_key LIKE 'class:%' THEN 'class' ELSE 'pool' END, * FROM b)
SELECT list, row_number() OVER (PARTITION BY list ORDER BY l.cos DESC, iuid) AS rank, group_key, iuid, round(cos, 6) AS cos FROM l QUALIFY rank <= 4""", lambda d: suggest.matches(_against(d, 1).withColumn("pid", F.col("iuid") % 7), "exact", 4))
on_vectors("l2_nearest", """, e AS (SELECT a.iuid AS iuid, sqrt(sum(pow(a.x - b.x, 2))) AS dist FROM cell a JOIN cell b ON a.pos = b.pos WHERE b.iuid = 1 AND a.iuid <> 1 GROUP BY 1) SELECT iuid, round(dist, 6) AS dist FROM e""", lambda d: l2_to(d, 1))
on_vectors("biased_matrix", " SELECT iuid, pos - 1 AS pos, round(x, 6) AS x FROM unit UNION ALL SELECT iuid, 64 + i, 0.5 * CASE i WHEN 0 THEN iuid % 10 ELSE iuid % 7 END FROM vec, range(2) r(i)",
           lambda d: vectors.biased(d.withColumn("at", F.array((F.col("iuid") % 10).cast("double"), (F.col("iuid") % 7).cast("double"))), "at", 0.5).select("iuid", F.posexplode("matrix").alias("pos", "x")).withColumn("x", F.round("x", 6)))
on_vectors("propagated", f"{PRED}, g AS (SELECT a, lb, cos FROM sims WHERE la IS NULL AND lb IS NOT NULL AND lb <> '__reject__' QUALIFY row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) = 1) SELECT a AS iuid, lb AS label FROM g WHERE cos >= 0.3",
           lambda d: vectors.nearest(pool(d), classed(d), 1).filter("cos >= 0.3").select(F.col("q").alias("iuid"), "label"))
LEVELS = lambda d: vectors.finch(d.select("iuid", "vec", F.lit(None).cast("string").alias("label")))
on_vectors("finch_labels", None, lambda d: vectors.labels_at(materialize(LEVELS(d), "levels")))
on_vectors("finch_exact", None, lambda d: vectors.exact_count(d, materialize(LEVELS(d), "levels"), 12))
on_vectors("kmeans", None, lambda d: vectors.kmeans(d, 8))
IN_CLASS = """, e AS (SELECT a, b, la FROM sims WHERE la = lb AND la <> '__reject__' QUALIFY row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) = 1), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS least FROM s UNION SELECT s.b, r.least FROM r JOIN s ON s.a = r.node WHERE r.least < s.b), m AS (SELECT node, min(least) AS c FROM r GROUP BY 1),
z AS (SELECT label, coalesce(c, iuid) AS c, count(*) AS size FROM vec LEFT JOIN m ON node = iuid WHERE label IS NOT NULL AND label <> '__reject__' GROUP BY 1, 2)"""
on_vectors("csub_sizes", f"{IN_CLASS} SELECT label, row_number() OVER (PARTITION BY label ORDER BY size DESC, c) - 1 AS sub, size FROM z", lambda d: vectors.clusters_within(classed(d), "label").groupBy("label", F.col("k").alias("sub")).agg(F.count("*").alias("size")))
on_vectors("image_clusters", None, lambda d: vectors.clusters_within(d, "image_id").select("iuid", "image_id", (F.col("image_id") * 1000 + F.col("k")).alias("cluster")))

QUERIES["youden"] = lambda spark, root: suggest.youden(table(spark, root, "lineitem").select((F.col("l_partkey") % 1000 / 1000).alias("s"), "l_returnflag"), "s", F.col("l_returnflag") == "R")
ORACLES["youden"] = """WITH x AS (SELECT CAST(l_partkey % 1000 AS DOUBLE) / 1000 AS s, l_returnflag = 'R' AS y FROM lineitem), v AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM x GROUP BY 1),
c AS (SELECT s, round(sum(p) OVER (ORDER BY s DESC) / (SELECT sum(p) FROM v) - sum(n) OVER (ORDER BY s DESC) / (SELECT sum(n) FROM v), 9) AS j FROM v)
SELECT round(s, 6) AS threshold, round(j, 6) AS youden FROM c ORDER BY j DESC, s DESC LIMIT 1"""


QUERIES["pr_curve"] = lambda spark, root: suggest.pr_curve(table(spark, root, "lineitem").select((F.col("l_partkey") % 1000 / 1000).alias("s"), "l_returnflag"), "s", F.col("l_returnflag") == "R")
ORACLES["pr_curve"] = """WITH x AS (SELECT CAST(l_partkey % 1000 AS DOUBLE) / 1000 AS s, l_returnflag = 'R' AS y FROM lineitem), v AS (SELECT s, count(*) FILTER (y) AS p, count(*) AS n FROM x GROUP BY 1)
SELECT round(s, 6) AS threshold, round(sum(p) OVER w / sum(n) OVER w, 6) AS precision, round(sum(p) OVER w / (SELECT sum(p) FROM v), 6) AS recall FROM v WINDOW w AS (ORDER BY s DESC)"""


def feature_health(spark: SparkSession, root: str) -> DataFrame:
    """Per method: vectors, those with a null, NaN or infinite number, and whether the method is usable whole."""
    bad = F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = table(spark, root, "features").groupBy("method").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))
    return out.withColumn("usable", F.col("n_bad") == 0)


QUERIES["feature_health"] = feature_health
ORACLES["feature_health"] = """WITH f AS (SELECT method, coalesce(vec IS NULL OR list_count(vec) < len(vec) OR list_bool_or(list_transform(vec, lambda x: isnan(x) OR isinf(x))), vec IS NULL) AS bad FROM features)
SELECT method, count(*) AS n, count(*) FILTER (bad) AS n_bad, count(*) FILTER (bad) = 0 AS usable FROM f GROUP BY 1"""


def _against(d: DataFrame, iuid: int) -> DataFrame:
    """All other rows with their cosine to one row, which travels as a literal."""
    row = d.filter(F.col("iuid") == iuid).select(vectors.unit("vec").alias("u")).first()
    target = F.array(*[F.lit(x) for x in row["u"]]) if row else F.lit(None).cast("array<double>")
    return d.filter(F.col("iuid") != iuid).withColumn("exact", F.aggregate(F.zip_with(vectors.unit("vec"), target, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def find_similar(d: DataFrame, iuid: int, top: int) -> DataFrame:
    """The pool's rows most like one row."""
    return pool(_against(d, iuid)).orderBy(F.desc("exact"), "iuid").limit(top).select("iuid", F.round("exact", 6).alias("cos"))


def match_groups(d: DataFrame, iuid: int) -> DataFrame:
    """The row most like one row in each class and in each partition of the pool; rejected rows are skipped."""
    key = F.when(F.col("label").isNull(), F.concat(F.lit("pid:"), (F.col("iuid") % 7).cast("string"))).otherwise(F.concat(F.lit("class:"), "label"))
    rows = _against(d, iuid).filter("label is null or label != '__reject__'")
    best = rows.groupBy(key.alias("group_key")).agg(F.min(F.struct((-F.col("exact")).alias("far"), "iuid")).alias("b"))
    return best.select("group_key", F.col("b.iuid").alias("iuid"), F.round(-F.col("b.far"), 6).alias("cos"))


def l2_to(d: DataFrame, iuid: int) -> DataFrame:
    """(iuid, dist): the Euclidean distance of all other rows to one row, which travels as a literal."""
    row = d.filter(F.col("iuid") == iuid).select("vec").first()
    target = F.array(*[F.lit(float(x)) for x in row["vec"]]) if row else F.lit(None).cast("array<double>")
    return d.filter(F.col("iuid") != iuid).withColumn("target", target).select("iuid", F.round(vectors.distance("vec", "target"), 6).alias("dist"))


def project(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(iuid, x, y) of points(iuid, vec) on the two leading directions of rows(iuid, vec), in the frame in which rows fill [0, 1]."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    raw = lambda d: d.select("iuid", array_to_vector(F.col("vec").cast("array<double>")).alias("raw"))
    fitted = Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="v"), PCA(k=2, inputCol="v", outputCol="p")]).fit(raw(rows))
    flat = lambda d: fitted.transform(raw(d)).select("iuid", vector_to_array("p").alias("p"))
    frame = flat(rows).agg(*[f(F.col("p")[i]).alias(f"{n}{i}") for i in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    scaled = lambda i: ((F.col("p")[i] - F.col(f"lo{i}")) / F.greatest(F.col(f"hi{i}") - F.col(f"lo{i}"), F.lit(1e-9)))
    return flat(points).crossJoin(F.broadcast(frame)).select("iuid", scaled(0).alias("x"), scaled(1).alias("y"))


def pca_map(spark: SparkSession, root: str) -> DataFrame:
    """(iuid, x, y): the centred vectors on their two leading directions, scaled to [0, 1]."""
    rows = embedded(spark, root)
    return project(rows, rows)


def map_neighbours(spark: SparkSession, root: str, top: int = 10) -> DataFrame:
    """The rows nearest on the map to a new point, the mean of the bank."""
    rows = embedded(spark, root)
    mean = rows.filter("bank").select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    point = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec")).select(F.lit(-1).cast("long").alias("iuid"), "vec")  # one row
    at = F.broadcast(project(rows, point).select(F.col("x").alias("px"), F.col("y").alias("py")))
    far = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    return project(rows, rows).crossJoin(at).select("iuid", F.round(far, 6).alias("distance")).orderBy("distance", "iuid").limit(top)


#: Most rows of the pool that serve as negatives.
POOL_NEGATIVES = 4_000


def factored(rows: DataFrame) -> DataFrame:
    """(iuid, label, p) of the pool of rows(iuid, vec, label): P(class against all else) x P(class among the classes).

    Classes are labels of two rows or more. A logistic regression per class has the
    other classes, the rejected rows and the POOL_NEGATIVES pool rows of smallest hash
    as negatives, so that a row like no class scores low on all; a multinomial one
    tells the classes apart. Sides and classes weigh the same, whatever their size.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = rows.select("iuid", "label", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    sizes = {r["label"]: r["count"] for r in classed(rows).groupBy("label").count().filter("count >= 2").collect()}  # one row per class
    names = sorted(sizes)
    if len(names) < 2:
        raise ValueError(f"needs two classes of two rows or more, has {sizes}")
    number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, float(i))])
    known = classed(rows).select("features", number[F.col("label")].alias("y")).filter("y is not null")
    sample = pool(rows).orderBy(F.xxhash64("iuid"), "iuid").limit(POOL_NEGATIVES).select("features")
    rejected = rows.filter("label = '__reject__'").select("features")
    train = materialize(known.unionByName(rejected.unionByName(sample).withColumn("y", F.lit(-1.0))), "training")
    total = train.count()

    def fit(data: DataFrame, family: str, p: str):
        return LogisticRegression(labelCol="y", weightCol="w", regParam=0.01, standardization=False, maxIter=100, family=family, probabilityCol=p, rawPredictionCol=f"raw_{p}", predictionCol=f"is_{p}").fit(data)

    size = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (float(i), float(sizes[n]))])
    scored = fit(train.filter("y >= 0").withColumn("w", 1 / size[F.col("y")]), "multinomial", "among").transform(pool(rows))
    for i, name in enumerate(names):
        mine = F.col("y") == i
        side = train.select("features", F.when(mine, 1 / F.lit(float(sizes[name]))).otherwise(1 / F.lit(float(total - sizes[name]))).alias("w"), mine.cast("double").alias("y"))
        scored = fit(side, "binomial", f"own{i}").transform(scored)
    among = vector_to_array("among")
    each = [F.struct(F.lit(n).alias("label"), (vector_to_array(f"own{i}")[1] * among[i]).alias("p")) for i, n in enumerate(names)]
    return scored.select("iuid", F.explode(F.array(*each)).alias("s")).select("iuid", "s.label", "s.p")


def factored_lr(spark: SparkSession, root: str) -> DataFrame:
    return factored(embedded(spark, root))


QUERIES["pca_map"], QUERIES["map_neighbours"], QUERIES["factored_lr"] = pca_map, map_neighbours, factored_lr
on_vectors("forest", None, lambda d: models.predicted(classed(d), pool(d), "rf"))
on_vectors("cv_report", None, lambda d: models.report(classed(d)))
