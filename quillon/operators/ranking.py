"""How comparable ranked lists and shard scores are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def positions(scored: DataFrame, pk: str, k: int, by: str | None = None) -> DataFrame:
    """Top k with position from 0: (by, pk, pos)."""
    w = W.partitionBy(*([by] if by else [])).orderBy(F.desc("score"), F.col(pk).cast("string"))
    return scored.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < k).select(*([by] if by else []), pk, "pos")


def kendall_tau(a: DataFrame, b: DataFrame, pk: str, by: list[str] | None = None) -> DataFrame:
    """(by, tau) over common items of two top-k lists without ties; 1 where there is no pair.

    The pairs are those of two lists of k items, for each query.
    """
    by = by or []
    common = a.select(*by, pk, F.col("pos").alias("x")).join(b.select(*by, pk, F.col("pos").alias("y")), [*by, pk])
    other = common.select(*by, F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = (common.join(other, by) if by else common.join(other)).where("x < x2")
    sign = F.when(F.col("y") < F.col("y2"), 1).otherwise(-1)
    keys = a.select(*by).distinct() if by else a.sparkSession.range(1).select()
    if not by:
        return pairs.agg(F.coalesce(F.avg(sign), F.lit(1.0)).alias("tau"))
    tau = pairs.groupBy(*by).agg(F.avg(sign).alias("tau"))
    return keys.join(tau, by, "left").select(*by, F.coalesce("tau", F.lit(1.0)).alias("tau"))


def jaccard(a: DataFrame, b: DataFrame, pk: str) -> DataFrame:
    """One row: similarity of two sets of keys, 1 where both are empty."""
    both = a.select(pk, F.lit(1).alias("x")).join(b.select(pk, F.lit(1).alias("y")), pk, "full_outer")
    return both.agg(F.coalesce(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("jaccard"))


def divergence(a: DataFrame, b: DataFrame, pk: str, k: int) -> DataFrame:
    """One row: the first position at which two lists differ, k where none does."""
    both = a.select("pos", F.col(pk).alias("x")).join(b.select("pos", F.col(pk).alias("y")), "pos", "full_outer")
    return both.agg(F.coalesce(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("pos"))), F.lit(k)).alias("position"))


def summary(taus: DataFrame, at_least: float = 0.95) -> DataFrame:
    t = F.col("tau")
    return taus.agg(F.avg(t).alias("mean"), F.coalesce(F.stddev_samp(t), F.lit(0.0)).alias("std"), F.min(t).alias("low"), F.max(t).alias("high"), F.avg(F.when(t >= at_least, 1.0).otherwise(0.0)).alias("share"))


def score_stats(top: DataFrame, shard: str = "_shard") -> DataFrame:
    """(shard, hits, low, high, mean, spread) of scored hits."""
    s = F.col("score")
    return top.groupBy(shard).agg(F.count("*").alias("hits"), F.min(s).alias("low"), F.max(s).alias("high"), F.avg(s).alias("mean"), (F.max(s) - F.min(s)).alias("spread"))


def skew(counts: DataFrame, n: str) -> DataFrame:
    """One row: coefficient of variation (population), median, and greatest over median."""
    x = F.col(n).cast("double")
    return counts.agg((F.stddev_pop(x) / F.avg(x)).alias("cv"), F.percentile(x, F.lit(0.5)).alias("median"), (F.max(x) / F.percentile(x, F.lit(0.5))).alias("max_over_median"))


def inflation(total: Column, shard: Column) -> Column:
    """How much a shard's own statistics inflate its scores."""
    return F.log1p(total) / F.greatest(F.log1p(shard), F.lit(0.1))


def divergent_replicas(scores: DataFrame, factor: float = 5.0) -> DataFrame:
    """Replicas (node_id, score) whose score is over ``factor`` times the median."""
    median = scores.agg(F.percentile("score", F.lit(0.5)).alias("median"))
    return scores.join(F.broadcast(median)).where(F.col("score") > factor * F.col("median")).select("node_id", "score")
