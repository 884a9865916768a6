"""Supervised models on the ML library: closed-set classifiers with a report, and a recommender of merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.session import materialize


def learner(algo: str, seed: int = 0):
    """A classifier over features, y and the weight w: logreg, or rf (100 trees)."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    if algo == "rf":
        return RandomForestClassifier(labelCol="y", weightCol="w", numTrees=100, seed=seed)
    return LogisticRegression(labelCol="y", weightCol="w", regParam=0.01, standardization=False, maxIter=100)


def prepared(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """(iuid, features, y, w) of rows(iuid, vec, label) with labels of two rows or more, all labels weighing the same; and the labels in the order of y."""
    from pyspark.ml.functions import array_to_vector

    sizes = rows.filter("label is not null").groupBy("label").agg(F.count("*").alias("n")).filter("n >= 2")
    names = sorted(r["label"] for r in sizes.select("label").collect())  # one row per class
    number = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, float(i))])
    return rows.join(F.broadcast(sizes), "label").select("iuid", array_to_vector(F.col("vec").cast("array<double>")).alias("features"), number[F.col("label")].alias("y"), (1 / F.col("n")).alias("w")), names


def predicted(train: DataFrame, queries: DataFrame, algo: str = "logreg") -> DataFrame:
    """(iuid, label, p): every label's probability for the queries(iuid, vec) under a model of train(iuid, vec, label)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data, names = prepared(train)
    model = learner(algo).fit(data)
    scored = model.transform(queries.select("iuid", array_to_vector(F.col("vec").cast("array<double>")).alias("features")))
    each = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("label"), vector_to_array("probability").alias("p"))
    return scored.select("iuid", F.explode(each).alias("s")).select("iuid", "s.label", "s.p")


def report(rows: DataFrame, folds: int = 3, algo: str = "logreg") -> DataFrame:
    """(fold, n, accuracy) of models trained without a fold, which is a hash of the id."""
    data, _ = prepared(rows)
    data = materialize(data.withColumn("fold", F.pmod(F.xxhash64("iuid"), F.lit(folds)).cast("int")), "folds")
    out: DataFrame | None = None
    for k in range(folds):
        held = learner(algo).fit(data.filter(F.col("fold") != k)).transform(data.filter(F.col("fold") == k))
        part = held.agg(F.lit(k).alias("fold"), F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


FEATURES = ["box_iou", "gap", "centroid_dist", "class_agree", "score_min", "score_mean", "area_ratio"]


def merge_probability(pairs: DataFrame, merged: Column, negatives: DataFrame) -> DataFrame:
    """(iuid_a, iuid_b, p): how likely each of pairs(iuid_a, iuid_b, FEATURES) is one object, by a model of the `merged` pairs and the chosen negatives(iuid_a, iuid_b)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import RobustScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    marked = pairs.withColumn("y", merged.cast("double"))
    train = materialize(marked.filter("y = 1").unionByName(marked.filter("y = 0").join(negatives, ["iuid_a", "iuid_b"], "left_semi").select(*marked.columns)), "pairs")
    share = train.agg(F.avg("y")).first()[0]  # both sides weigh the same
    train = train.withColumn("w", F.when(F.col("y") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    steps = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), RobustScaler(withCentering=True, inputCol="raw", outputCol="features"), LogisticRegression(labelCol="y", weightCol="w", maxIter=100, regParam=0.001)]
    return Pipeline(stages=steps).fit(train).transform(marked).select("iuid_a", "iuid_b", vector_to_array("probability")[1].alias("p"))
