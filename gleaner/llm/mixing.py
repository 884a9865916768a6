"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.session import materialize, spread
from gleaner.sources.tables import table

#: Vocabulary file of the public tokenizer; a parameter, never part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents plus n_tokens, its text's size in tokens (0 for a null or empty text)."""
    schema = documents.withColumn("n_tokens", F.lit(0).cast("long")).schema
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, about 1 MB

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        coder = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in frames:
            pdf["n_tokens"] = [len(coder.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pdf

    return documents.mapInPandas(run, schema)


def source_rates(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(source, tokens, target_share, max_repeats, wanted, rate, capped) of every target source.

    wanted = target_share x budget tokens (all documents' tokens, if not given);
    rate = wanted / tokens, at most max_repeats; capped tells that wanted exceeds
    max_repeats x tokens. A target without documents has 0 tokens and is capped
    if it wants any; documents of other sources, or of none, count in the total
    only. A null max_repeats is no cap, a null share 0; repeated target rows count once.
    """
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = F.lit(float(budget)) if budget is not None else F.col("total").cast("double")
    wants = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = wants.join(per_source, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).crossJoin(
        F.broadcast(per_source.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")))  # one row
    )
    cap = F.col("max_repeats") * F.col("tokens")
    return (
        joined.withColumn("wanted", F.coalesce(F.col("target_share"), F.lit(0.0)) * total)
        .withColumn("capped", F.coalesce(F.col("wanted") > cap, F.lit(False)))
        .withColumn("rate", F.when(F.col("tokens") > 0, F.least(F.col("wanted") / F.col("tokens"), F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf"))))).otherwise(0.0))
        .select("source", "tokens", "target_share", "max_repeats", "wanted", "rate", "capped")
    )


def mix(sized: DataFrame, rates: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """sized once per emitted copy, with `copy` from 1: floor(rate) copies, and one more with the fraction's probability.

    The draw is a hash of the row's id and the seed, so it is the same on every
    run; the rates (one row per target source) are broadcast.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(1 << 40)) / float(1 << 40)
    few = F.broadcast(rates.select("source", "rate"))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    out = sized.join(few, "source").withColumn("copies", copies).filter("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("rate", "copies")


def _sized(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents, tokenised once."""
    return materialize(token_counts(spread(table(spark, root, "documents").select("doc_id", "source", "text"))).drop("text"), "sized")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return source_rates(_sized(spark, root), table(spark, root, "mix_targets")).filter("capped").select("source")


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    """Every emitted copy of the mixture."""
    sized = _sized(spark, root)
    return mix(sized, source_rates(sized, table(spark, root, "mix_targets")), "doc_id").select("doc_id", "source", "copy", "n_tokens")


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Each source's target and actual share of the mixture."""
    sized = _sized(spark, root)
    rates = source_rates(sized, table(spark, root, "mix_targets"))
    got = mix(sized, rates, "doc_id").groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("copies"))
    out = rates.join(got, "source", "left").fillna(0, ["mixed_tokens", "copies"])
    total = out.agg(F.sum("mixed_tokens").alias("all_tokens"))
    return out.crossJoin(F.broadcast(total)).withColumn("actual_share", F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(0.0)).drop("all_tokens")  # one row
