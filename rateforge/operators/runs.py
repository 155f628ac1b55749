"""Summaries over run logs, latencies and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.quantiles import interpolated_wide


def seed_statistics(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over seeds; a single run has deviation 0."""
    return runs.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
    )


def summarize_runs(runs: DataFrame) -> DataFrame:
    """Learning-curve summary per training size."""
    def std(c: str, name: str):
        return F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(name)

    return runs.groupBy("size").agg(
        F.avg("macro_f1").alias("f1_mean"), std("macro_f1", "f1_std"),
        F.avg("mae").alias("mae_mean"), std("mae", "mae_std"),
        F.avg("accuracy").alias("acc_mean"),
        F.avg("train_time").alias("train_time"),
        F.avg("inference_time").alias("infer_time"),
    )


def step_gains(summary: DataFrame, min_gain: float) -> DataFrame:
    """Gain to the next size and whether the curve is flat there.

    The summary holds one row per training size, so one small window is enough.
    """
    order = W.partitionBy(F.lit(0)).orderBy("size")
    gain = F.lead("f1_mean").over(order) - F.col("f1_mean")
    noise = F.greatest(F.col("f1_std"), F.lead("f1_std").over(order), F.lit(min_gain))
    return summary.select("size", "f1_mean", "f1_std", gain.alias("gain"), noise.alias("noise")).withColumn(
        "flat", F.coalesce(F.col("gain") < F.col("noise"), F.lit(False))
    )


def choose_size(summary: DataFrame, min_gain: float) -> DataFrame:
    """Smallest size after which the next gain is within noise, else the largest."""
    steps = step_gains(summary, min_gain)
    return steps.agg(
        F.coalesce(F.min(F.when(F.col("flat"), F.col("size"))), F.max("size")).alias("chosen_size")
    )


def latency_profile(df: DataFrame, latency_ms: str) -> DataFrame:
    """Median, p95 and texts per second of single requests."""
    q = interpolated_wide(df, latency_ms, {"p50": 0.5, "p95": 0.95})
    rate = df.agg((F.count(latency_ms) * 1000.0 / F.sum(latency_ms)).alias("per_second")).scalar()
    return q.withColumn("per_second", rate)


def model_comparison(runs: DataFrame, costs: DataFrame, n_eval: int) -> DataFrame:
    """Quality against cost per model; a model missing on either side stays, with nulls."""
    quality = runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("macro_f1").alias("f1_mean"),
        F.coalesce(F.stddev_samp("macro_f1"), F.lit(0.0)).alias("f1_std"),
        F.avg("mae").alias("mae_mean"),
        (F.avg("train_time") / 60.0).alias("train_minutes"),
        (F.avg("inference_time") / F.lit(float(n_eval)) * 1000.0).alias("seconds_per_1000"),
    )
    cost = costs.select(
        "model", "size_mb", (F.lit(1000.0) / F.col("texts_per_second")).alias("cpu_seconds_per_1000")
    )
    return quality.join(cost, "model", "full_outer")
