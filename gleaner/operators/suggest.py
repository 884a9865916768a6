"""Label suggestions from nearest references, and what a review queue needs of them."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.operators.vectors import nearest

REJECT, NO_MATCH = "__reject__", "__nomatch__"


def margin(labelled: DataFrame) -> DataFrame:
    """One row: the median distance of labelled rows to their nearest row of another label; null with fewer than two labels."""
    near = nearest(labelled, labelled, 1, other_label=True)
    return near.agg(F.expr("percentile(1 - cos, 0.5)").alias("margin"))


def predict(queries: DataFrame, refs: DataFrame, threshold: float) -> DataFrame:
    """(iuid, d, label): each query's nearest reference other than itself; its label if d <= threshold, else no match.

    A labelled query skips copies (d <= 1e-6) among its eight nearest, and has
    no match if all eight are.
    """
    is_ref = queries.select(F.col("iuid").alias("q"), F.col("label").isNotNull().alias("is_ref"))
    near = nearest(queries, refs, 8).withColumn("d", 1 - F.col("cos")).join(is_ref, "q").filter(~F.col("is_ref") | (F.col("d") > 1e-6))
    best = near.groupBy("q").agg(F.min_by(F.struct("d", "label"), F.struct("rank")).alias("b"))
    out = queries.select("iuid").join(best.withColumnRenamed("q", "iuid"), "iuid", "left")
    return out.select("iuid", F.col("b.d").alias("d"), F.when(F.col("b.d") <= threshold, F.col("b.label")).otherwise(NO_MATCH).alias("label"))


def verdicts(predicted: DataFrame, by: str) -> DataFrame:
    """Per group: votes, the top class (smaller name wins ties), confidence and the verdict class / reject / none."""
    votes = predicted.groupBy(by, "label").agg(F.count("*").alias("n"))
    middle = predicted.groupBy(by).agg(F.round(F.expr("percentile(d, 0.5)"), 6).alias("median_d"))
    real = ~F.col("label").isin(REJECT, NO_MATCH)
    n = lambda name: F.sum(F.when(F.col("label") == name, F.col("n")).otherwise(0))
    out = votes.groupBy(by).agg(
        F.sum("n").alias("members"), F.min(F.when(real, F.struct((-F.col("n")).alias("minus"), "label"))).alias("top"), n(REJECT).alias("n_reject"), n(NO_MATCH).alias("n_none")
    )
    t = F.coalesce(-F.col("top.minus"), F.lit(-1))
    return out.join(middle, by).select(
        by, "members", F.col("top.label").alias("top_class"), "n_reject", "n_none", F.round(F.greatest(t, F.lit(0)) / F.col("members"), 6).alias("confidence"), "median_d",
        F.when((t >= F.col("n_reject")) & (t >= F.col("n_none")), "class").when(F.col("n_reject") >= F.col("n_none"), "reject").otherwise("none").alias("verdict"),
    )


def image_summary(predicted: DataFrame) -> DataFrame:
    """Per (image_id, label): suggestions and their mean score max(0, 1 - d)."""
    return predicted.filter(F.col("label") != NO_MATCH).groupBy("image_id", "label").agg(F.count("*").alias("n"), F.round(F.avg(F.greatest(F.lit(0.0), 1 - F.col("d"))), 6).alias("score"))


def workload(predicted: DataFrame, threshold: float) -> DataFrame:
    """Per image: no match, border (above three quarters of the threshold) and automatic suggestions, and the work they mean."""
    d = F.coalesce("d", F.lit(float("inf")))
    w = predicted.groupBy("image_id").agg(
        F.count("*").alias("n_uncat"), F.count_if(d > threshold).alias("n_none"), F.count_if((d > 0.75 * threshold) & (d <= threshold)).alias("n_border")
    )
    w = w.withColumn("n_auto", F.col("n_uncat") - F.col("n_none") - F.col("n_border"))
    return w.withColumn("work_est", F.col("n_none") + 0.5 * F.col("n_border")).withColumn("auto_frac", F.round(F.col("n_auto") / F.col("n_uncat"), 6))


def csls(queries: DataFrame, bank: DataFrame, k: int = 10) -> DataFrame:
    """(q, r, label, csls): each query's best bank row by 2 cos - r_q - r_b, where r is the mean cosine of the k nearest on the other side."""
    mean = lambda d: d.groupBy("q").agg(F.avg("cos").alias("r"))
    rq, rb = mean(nearest(queries, bank, k)), mean(nearest(bank, queries, k))
    biased = bank.join(rb.select(F.col("q").alias("iuid"), F.col("r").alias("bias")), "iuid")
    best = nearest(queries, biased, 1, bias=True)
    return best.join(rq.withColumnRenamed("r", "rq"), "q").select("q", "r", "label", F.round(F.col("score") - F.col("rq"), 6).alias("csls"))


def bank_suggest(queries: DataFrame, bank: DataFrame, k: int = 10, top: int = 3) -> DataFrame:
    """(q, label, score): the best score of each label among the k nearest bank rows, the `top` labels of each query."""
    best = nearest(queries, bank, k).groupBy("q", "label").agg(F.max("cos").alias("cos"))
    ranked = best.withColumn("rank", F.expr("row_number() over (partition by q order by cos desc, label)")).filter(F.col("rank") <= top)
    return ranked.select("q", "label", F.round("cos", 6).alias("score"), "rank")


def rank_for_class(queries: DataFrame, bank: DataFrame, label: str, top: int) -> DataFrame:
    """The `top` queries most like any bank row of the label."""
    best = nearest(queries, bank.filter(F.col("label") == label), 1)
    return best.select("q", F.round("cos", 6).alias("score"), "cos").orderBy(F.desc("cos"), "q").limit(top).select("q", "score")


def knn_confidence(queries: DataFrame, refs: DataFrame, background: DataFrame, k: int = 3) -> DataFrame:
    """(iuid, label, p): exp(-d / scale) of each label's mean distance d over its k nearest, 0 where the background is nearer.

    scale is the median distance of references to another label, at least 1e-6 (one row).
    """
    scale = margin(refs).select(F.greatest("margin", F.lit(1e-6)).alias("scale"))
    mean = F.avg(1 - F.col("cos"))
    d = nearest(queries, refs, k, per_label=True).groupBy("q", "label").agg(mean.alias("d"))
    bg = nearest(queries, background, k).groupBy("q").agg(mean.alias("d_bg"))
    p = F.when(F.col("d") > F.col("d_bg"), 0.0).otherwise(F.exp(-F.col("d") / F.col("scale")))
    return d.join(bg, "q", "left").crossJoin(F.broadcast(scale)).select(F.col("q").alias("iuid"), "label", p.alias("p"))


def uncertainty(probabilities: DataFrame) -> DataFrame:
    """(iuid, entropy, margin, least_conf) of each row's label probabilities, scaled to sum 1 (uniform, if all are 0)."""
    row = probabilities.groupBy("iuid").agg(F.sort_array(F.collect_list("p"), asc=False).alias("ps"), F.sum("p").alias("total"))
    q = F.transform("ps", lambda p: F.when(F.col("total") <= 1e-12, 1.0 / F.size("ps")).otherwise(p / F.col("total")))
    row = row.select("iuid", q.alias("q"))
    entropy = F.when(F.size("q") > 1, F.aggregate("q", F.lit(0.0), lambda a, x: a - x * F.log(x + 1e-12)) / F.log(F.size("q").cast("double"))).otherwise(0.0)
    second = F.coalesce(F.try_element_at("q", F.lit(2)), F.lit(0.0))
    return row.select("iuid", (F.round(entropy, 6) + 0.0).alias("entropy"), F.round(1 - (F.element_at("q", 1) - second), 6).alias("margin"), F.round(1 - F.element_at("q", 1), 6).alias("least_conf"))


def assign_above(probabilities: DataFrame, least: float) -> DataFrame:
    """(iuid, label, p) of each row's likeliest label, where p >= least; the smaller label wins ties."""
    top = probabilities.groupBy("iuid").agg(F.min(F.struct((-F.col("p")).alias("minus"), "label")).alias("t"))
    return top.select("iuid", F.col("t.label").alias("label"), F.round(-F.col("t.minus"), 6).alias("p")).filter(F.col("p") >= least)


def rejections(probabilities: DataFrame, cutoff: float) -> DataFrame:
    """(iuid, p) of rows whose likeliest label stays below the cutoff."""
    return probabilities.groupBy("iuid").agg(F.round(F.max("p"), 6).alias("p")).filter(F.col("p") < cutoff)


def youden(scored: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: the threshold with the largest TPR - FPR (the highest such score), in [0, 1]; 0.5 without both kinds.

    Scores are counted per distinct value first; the window runs over values.
    """
    per = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    cum = per.selectExpr("s", "sum(p) over (order by s desc) as tp", "sum(n) over (order by s desc) as fp")
    total = per.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))  # one row
    j = F.when((F.col("np") > 0) & (F.col("nn") > 0), F.round(F.col("tp") / F.col("np") - F.col("fp") / F.col("nn"), 9))
    best = cum.crossJoin(F.broadcast(total)).withColumn("j", j).agg(F.max(F.when(F.col("j").isNotNull(), F.struct("j", "s"))).alias("b"))
    return best.select(F.round(F.coalesce(F.least(F.greatest("b.s", F.lit(0.0)), F.lit(1.0)), F.lit(0.5)), 6).alias("threshold"), F.round(F.coalesce("b.j", F.lit(0.0)), 6).alias("youden"))


def threshold(margin_: DataFrame, explicit: float | None = None, gate: float = 0.5, default: float = 0.25) -> DataFrame:
    """One row: the distance up to which a label is suggested: as given, else gate x margin, else the default."""
    return margin_.select(F.coalesce(F.lit(explicit).cast("double"), F.col("margin") * gate, F.lit(default)).alias("threshold"))


def predicted_members(predicted: DataFrame, pid: int, label: str) -> DataFrame:
    return predicted.filter((F.col("pid") == pid) & (F.col("label") == label)).select("iuid")


def accept(predicted: DataFrame, state: DataFrame, seq: int, source: str = "suggestion") -> DataFrame:
    """Commands (seq, op, iuid, class, source, score) that accept the suggestions of rows without a class in state(iuid, label): assign, or background for a suggested rejection."""
    free = predicted.filter(F.col("label") != NO_MATCH).join(state.filter("label is null").select("iuid"), "iuid", "left_semi")
    reject = F.col("label") == REJECT
    return free.select(
        F.lit(seq).alias("seq"), F.when(reject, "background").otherwise("assign").alias("op"), "iuid", F.when(~reject, F.col("label")).alias("class"), F.lit(source).alias("source"), F.greatest(F.lit(0.0), 1 - F.col("d")).alias("score")
    )


def ranked_work(work: DataFrame, order: str = "easy") -> DataFrame:
    """workload() plus rank: images with least work first, or with most; done ones (nothing left) last."""
    by = "n_uncat = 0, work_est, auto_frac desc, n_uncat, cast(image_id as string)" if order == "easy" else "n_uncat = 0, work_est desc, n_uncat desc, image_id"
    return work.withColumn("rank", F.expr(f"row_number() over (order by {by})"))  # one row per image


def rank_distinct(queries: DataFrame, bank: DataFrame, label: str, pid: str, top: int) -> DataFrame:
    """The `top` queries most like any bank row of the label, the best of each partition only."""
    best = nearest(queries, bank.filter(F.col("label") == label), 1).select("q", "cos").join(queries.select(F.col("iuid").alias("q"), F.col(pid).alias("pid")), "q")
    one = best.groupBy("pid").agg(F.min(F.struct((-F.col("cos")).alias("far"), "q")).alias("b"))
    return one.select("pid", F.col("b.q").alias("q"), F.round(-F.col("b.far"), 6).alias("score")).orderBy(F.desc("score"), "q").limit(top)


def grow_bank(bank: DataFrame, confirmed: DataFrame) -> DataFrame:
    """bank plus the confirmed rows (iuid, vec, label) that it doesn't hold; rows without a label or rejected don't enter."""
    fresh = confirmed.filter(F.col("label").isNotNull() & (F.col("label") != REJECT) & F.col("vec").isNotNull()).join(bank.select("iuid"), "iuid", "left_anti")
    return bank.select("iuid", "vec", "label").unionByName(fresh.select("iuid", "vec", "label"))


def matches(rows: DataFrame, exact: str, k: int) -> DataFrame:
    """(list, rank, group_key, iuid, cos) of rows(iuid, label, pid, exact): the best row of each class, of each partition of the pool, and of both together, k of each; rejected rows are skipped."""
    key = F.when(F.col("label").isNull(), F.concat(F.lit("pid:"), F.col("pid").cast("string"))).otherwise(F.concat(F.lit("class:"), "label"))
    best = rows.filter(F.col("label").isNull() | (F.col("label") != REJECT)).groupBy(key.alias("group_key")).agg(F.min(F.struct((-F.col(exact)).alias("far"), "iuid")).alias("b"))
    kind = F.when(F.col("group_key").startswith("class:"), "class").otherwise("pool")
    each = best.select(F.explode(F.array(kind, F.lit("mixed"))).alias("list"), "group_key", F.col("b.iuid").alias("iuid"), (-F.col("b.far")).alias("cos"))
    ranked = each.withColumn("rank", F.expr("row_number() over (partition by list order by cos desc, iuid)")).filter(F.col("rank") <= k)
    return ranked.select("list", "rank", "group_key", "iuid", F.round("cos", 6).alias("cos"))


def pr_curve(scored: DataFrame, score: str, positive: Column) -> DataFrame:
    """(threshold, precision, recall) at each distinct score; counted per value first."""
    per = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count("*").alias("n"))
    cum = per.selectExpr("s", "sum(p) over (order by s desc) as tp", "sum(n) over (order by s desc) as seen")
    total = per.agg(F.sum("p").alias("np"))  # one row
    return cum.crossJoin(F.broadcast(total)).select(
        F.round("s", 6).alias("threshold"), F.round(F.col("tp") / F.col("seen"), 6).alias("precision"), F.round(F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0), 6).alias("recall")
    )


def diversify(work: DataFrame, fractions: DataFrame, labelled: DataFrame, limit: int, diversity: float = 1.0, order: str = "easy") -> DataFrame:
    """(image_id, rank): the order of work(image_id, work_est, rank), its head rearranged so that predicted classes vary.

    fractions(image_id, label, share) are each image's predicted classes,
    labelled(label, n) how often each class is given already. Of the first
    max(5 x limit, 600) images, `limit` are picked one by one: the next is the one
    with the best ease (or hardness) less 1.2 x diversity x the share-weighted
    cover of its classes, and its shares then add to the cover. The head is one
    bounded task; the rest keeps its order behind it.
    """
    head = max(5 * limit, 600)
    n = work.count()
    if diversity <= 0 or n <= 2:
        return work.select("image_id", "rank")
    most = F.broadcast(work.agg(F.max("work_est").alias("most")))  # one row
    parts = fractions.groupBy("image_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", "share")))).alias("shares"))
    top = work.filter(F.col("rank") <= head).join(parts, "image_id", "left").crossJoin(most).select("image_id", "rank", "work_est", "most", F.coalesce("shares", F.lit("{}")).alias("shares"))
    given = {r["label"]: r["n"] for r in labelled.collect()}  # one row per class
    kind = dict(work.dtypes)["image_id"]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        high = float(pdf["most"].iat[0]) or 1.0
        ease = pdf["work_est"].to_numpy(float) / high
        ease = ease if order == "hard" else 1.0 - ease
        shares = [json.loads(t) for t in pdf["shares"]]
        labels = sorted({c for s in shares for c in s} | set(given))
        at = {c: i for i, c in enumerate(labels)}
        x = np.zeros((len(pdf), len(labels)))
        for i, s in enumerate(shares):
            for c, v in s.items():
                x[i, at[c]] = v
        cover = np.array([given.get(c, 0) for c in labels], float) / max(given.values(), default=1)
        free, chosen = np.ones(len(pdf), bool), []
        for _ in range(min(limit, len(pdf))):
            value = np.where(free, ease - 1.2 * diversity * (x @ cover), -np.inf)
            i = int(value.argmax())
            chosen.append(i)
            free[i] = False
            cover += x[i]
        seq = [*chosen, *np.flatnonzero(free).tolist()]
        return pd.DataFrame({"image_id": pdf["image_id"].to_numpy()[seq], "rank": np.arange(1, len(seq) + 1, dtype=np.int32)})

    picked = top.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(lambda pdf: pick(pdf.drop(columns="__one")), f"image_id {kind}, rank int")
    return picked.unionByName(work.filter(F.col("rank") > head).select("image_id", F.col("rank").cast("int").alias("rank")))
