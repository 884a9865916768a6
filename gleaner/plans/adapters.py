"""Domain tables made from the driver's tables, for Spark and (as SQL) for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gleaner.sources.tables import table

_ORDER = "l_linenumber l_partkey l_suppkey l_shipdate l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()


def instances(spark: SparkSession, root: str) -> DataFrame:
    """lineitem as instances of images (orders), with states, boxes on a 128 x 128 canvas and a partition id."""
    n = table(spark, root, "lineitem").withColumn("inst_no", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_ORDER)))
    bg, line = F.col("l_suppkey") % 7 == 0, F.col("l_linenumber") % 4
    open_ = (F.col("l_partkey") % 5 == 0) | bg
    source = F.when(line == 0, "manual").when(line == 1, "partition").when(line == 2, "classifier").otherwise("import")
    first = F.col("l_orderkey") * 100
    x0, y0 = F.col("l_partkey") % 80, F.col("l_suppkey") % 80
    bw, bh = 16 + F.col("l_quantity").cast("int") % 33, 16 + (F.col("l_partkey") + F.col("l_linenumber")) % 33
    return n.select(
        F.col("l_orderkey").alias("image_id"), "inst_no", (first + F.col("inst_no")).alias("iuid"),
        F.concat(F.lit("b"), (F.col("l_suppkey") % 4).cast("string")).alias("batch_id"),
        ((F.col("l_partkey") % 1000).cast("double") / 1000).alias("score"),
        F.when(~open_, F.col("l_returnflag")).alias("assigned_class"), bg.alias("is_background"),
        F.when(~open_, source).alias("assign_source"), F.when(F.col("inst_no") % 6 == 0, first + 1).alias("merged_into"),
        (F.col("l_tax") >= 0.04).alias("mask_reviewed"), (F.col("l_suppkey") % 10).alias("pid"),
        x0.alias("x0"), y0.alias("y0"), bw.alias("bw"), bh.alias("bh"), (x0 + bw).alias("x1"), (y0 + bh).alias("y1"), (bw * bh).cast("double").alias("area"),
    )


INST = """inst AS (
  SELECT l_orderkey AS image_id, inst_no, l_orderkey * 100 + inst_no AS iuid, 'b' || CAST(l_suppkey % 4 AS VARCHAR) AS batch_id,
    CAST(l_partkey % 1000 AS DOUBLE) / 1000 AS score,
    CASE WHEN l_partkey % 5 = 0 OR l_suppkey % 7 = 0 THEN NULL ELSE l_returnflag END AS assigned_class,
    (l_suppkey % 7 = 0) AS is_background,
    CASE WHEN l_partkey % 5 = 0 OR l_suppkey % 7 = 0 THEN NULL WHEN l_linenumber % 4 = 0 THEN 'manual'
         WHEN l_linenumber % 4 = 1 THEN 'partition' WHEN l_linenumber % 4 = 2 THEN 'classifier' ELSE 'import' END AS assign_source,
    CASE WHEN inst_no % 6 = 0 THEN l_orderkey * 100 + 1 END AS merged_into, (l_tax >= 0.04) AS mask_reviewed, l_suppkey % 10 AS pid,
    l_partkey % 80 AS x0, l_suppkey % 80 AS y0, 16 + CAST(l_quantity AS INT) % 33 AS bw, 16 + (l_partkey + l_linenumber) % 33 AS bh,
    l_partkey % 80 + 16 + CAST(l_quantity AS INT) % 33 AS x1, l_suppkey % 80 + 16 + (l_partkey + l_linenumber) % 33 AS y1,
    CAST((16 + CAST(l_quantity AS INT) % 33) * (16 + (l_partkey + l_linenumber) % 33) AS DOUBLE) AS area
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS inst_no FROM lineitem)),
live AS (SELECT * FROM inst WHERE merged_into IS NULL)"""


def log(spark: SparkSession, root: str) -> DataFrame:
    """events as the command log: seq, ts_us, op, actor, n_instances."""
    kind = F.col("event_type")
    op = F.when(kind == "view", "assign").when(kind == "click", "merge").when(kind == "purchase", "background").when(kind == "signup", "new_class").otherwise("undo")
    return table(spark, root, "events").select(
        F.col("event_id").alias("seq"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_us"), op.alias("op"),
        F.col("user_id").alias("actor"), F.get_json_object("props", "$.k").cast("long").alias("n_instances"), "value",
    )


LOG = """log AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us, CASE event_type WHEN 'view' THEN 'assign' WHEN 'click' THEN 'merge' WHEN 'purchase' THEN 'background'
    WHEN 'signup' THEN 'new_class' ELSE 'undo' END AS op, user_id AS actor, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n_instances, value FROM events)"""


def embedded(spark: SparkSession, root: str) -> DataFrame:
    """embeddings as features: iuid, image_id, vec, label (null for the unassigned pool), bank."""
    v = F.col("vec_id")
    label = F.when(v % 4 == 0, F.lit(None)).when(F.col("label") == 9, F.lit("__reject__")).otherwise(F.concat(F.lit("c"), F.col("label").cast("string")))
    return table(spark, root, "embeddings").select(v.alias("iuid"), (v - v % 5).alias("image_id"), F.col("embedding").alias("vec"), label.alias("label"), (v % 10 == 1).alias("bank"), F.col("label").alias("truth"))


VEC = """vec AS (
  SELECT vec_id AS iuid, vec_id - vec_id % 5 AS image_id, embedding AS vec, CASE WHEN vec_id % 4 = 0 THEN NULL WHEN label = 9 THEN '__reject__'
    ELSE 'c' || CAST(label AS VARCHAR) END AS label, vec_id % 10 = 1 AS bank, label AS truth FROM embeddings),
cell AS (SELECT iuid, image_id, label, bank, truth, generate_subscripts(vec, 1) AS pos, CAST(unnest(vec) AS DOUBLE) AS x FROM vec),
norm AS (SELECT iuid, sqrt(sum(x * x)) AS norm FROM cell GROUP BY iuid),
unit AS (SELECT c.iuid, c.image_id, c.label, c.bank, c.truth, c.pos, c.x / (n.norm + 1e-9) AS x FROM cell c JOIN norm n USING (iuid)),
sims AS (SELECT a.iuid AS a, b.iuid AS b, any_value(a.label) AS la, any_value(b.label) AS lb, any_value(a.image_id) AS ia, any_value(b.bank) AS bb, any_value(a.bank) AS ba, sum(a.x * b.x) AS cos
  FROM unit a JOIN unit b ON a.pos = b.pos AND a.iuid <> b.iuid GROUP BY a.iuid, b.iuid)"""

_DIMS = {
    "ing": ("batch_id string, source string", [("b0", "detA"), ("b1", "detA"), ("b2", "detB")]),
    "cls": ("class_id string, concept string, temp boolean, pin int", [("A", "kept", False, 2), ("N", "open", False, None), ("R", "returned", False, None), ("T", "open", True, None)]),
    "rules": ("if_class string, then_class string", [("R", "A")]),
}


def dim(spark: SparkSession, name: str) -> DataFrame:
    """A fixed dimension of a few rows."""
    schema, rows = _DIMS[name]
    return spark.createDataFrame(rows, schema)


DIMS = """ing(batch_id, source) AS (VALUES ('b0', 'detA'), ('b1', 'detA'), ('b2', 'detB')),
cls(class_id, concept, temp, pin) AS (VALUES ('A', 'kept', false, 2), ('N', 'open', false, NULL), ('R', 'returned', false, NULL), ('T', 'open', true, NULL)),
rules(if_class, then_class) AS (VALUES ('R', 'A'))"""


def gate(image: Column) -> Column:
    """The release state of an image: a third each accepted, rejected and pending."""
    return F.when(image % 3 == 0, "accepted").when(image % 3 == 1, "rejected").otherwise("pending")
