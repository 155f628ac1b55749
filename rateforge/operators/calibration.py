"""Temperature scaling: fit on validation, apply anywhere, evaluate before and after."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bins import CONF_EDGES, bin_index
from ..functions.probs import (
    CLASSES, PROB_COLS, confidence, log_prob_sql, predicted_class, row_brier, row_log_loss,
    with_tempered,
)

LOW_T, HIGH_T = 0.05, 20.0


def _probs() -> list[Column]:
    return [F.col(c) for c in PROB_COLS]


def apply_temperature(df: DataFrame, temperature) -> DataFrame:
    """Replace p1..p5 by softmax(ln p / T)."""
    return with_tempered(df, temperature)


def log_loss(df: DataFrame, y: str = "y_true") -> DataFrame:
    return df.agg(F.avg(row_log_loss(_probs(), F.col(y))).alias("log_loss"))


def brier(df: DataFrame, y: str = "y_true") -> DataFrame:
    return df.agg(F.avg(row_brier(_probs(), F.col(y))).alias("brier"))


def _log_columns(df: DataFrame, y: str, *kept: str) -> DataFrame:
    """Log-probabilities d1..d5 and dy of the true class, shifted so that the largest is 0.

    The shift scales with 1/T like the logarithms themselves, so it cancels in the loss
    and keeps every exponential at most 1.
    """
    z = df.selectExpr(*kept, f"`{y}` AS y", *[f"{log_prob_sql(f'p{c}')} AS z{c}" for c in CLASSES])
    top = z.selectExpr(
        "*", "greatest(z1, z2, z3, z4, z5) AS top",
        f"CASE {' '.join(f'WHEN y = {c} THEN z{c}' for c in CLASSES)} END AS zy",
    )
    return top.selectExpr(*kept, *[f"z{c} - top AS d{c}" for c in CLASSES], "zy - top AS dy")


def temperature_grid(df: DataFrame, grid: list[float], y: str = "y_true") -> DataFrame:
    """Log-loss at every temperature of a fixed grid, in one pass over the rows."""
    losses = []
    for i, t in enumerate(grid):
        b = f"{1.0 / t!r}D"
        total = " + ".join(f"exp(d{c} * {b})" for c in CLASSES)
        losses.append(F.expr(f"avg(ln({total}) - dy * {b}) AS l{i}"))
    cells = [f"struct({float(t)!r}D AS temperature, l{i} AS log_loss)" for i, t in enumerate(grid)]
    return _log_columns(df, y).agg(*losses).selectExpr(f"inline(array({', '.join(cells)}))")


def best_of_grid(df: DataFrame, grid: list[float], y: str = "y_true") -> DataFrame:
    """The grid temperature with the least log-loss."""
    return temperature_grid(df, grid, y).orderBy("log_loss", "temperature").limit(1)


def fit_temperatures(
    df: DataFrame, by: str = "model", y: str = "y_true", tolerance: float = 1e-9, passes: int = 60
) -> dict:
    """Temperature in [0.05, 20] of least log-loss for every value of ``by``; a search that
    has not settled after ``passes`` steps is an error.

    The loss is convex in 1/T, so Newton steps kept inside a bracket converge in a
    handful of passes.  A pass is one aggregate over a cached projection for all values
    at once: each has its own bracket and 1/T, sent to the rows as a table of one small
    row a value, and values that have settled take no further part.
    """
    spark = df.sparkSession
    logs = df.select(F.col(by).alias("_by"), *[c for c in df.columns if c != by])
    kept = _log_columns(logs, y, "_by").persist()

    def slopes(at: dict) -> dict:
        kind = kept.schema["_by"].dataType.simpleString()
        states = F.broadcast(spark.createDataFrame(list(at.items()), f"_at {kind}, _b double"))
        e = kept.join(states, F.col("_by").eqNullSafe(F.col("_at"))).selectExpr("*", *[f"exp(d{c} * _b) AS e{c}" for c in CLASSES])
        total = " + ".join(f"e{c}" for c in CLASSES)
        first = " + ".join(f"e{c} * d{c}" for c in CLASSES)
        second = " + ".join(f"e{c} * d{c} * d{c}" for c in CLASSES)
        moments = e.selectExpr("_by", "dy", f"({first}) / ({total}) AS mean", f"({second}) / ({total}) AS square")
        sums = moments.groupBy("_by").agg(F.expr("avg(mean - dy)").alias("first"), F.expr("avg(square - mean * mean)").alias("second"))
        return {r["_by"]: (r["first"], r["second"]) for r in sums.collect()}

    try:
        names = [r["_by"] for r in kept.select("_by").distinct().collect()]
        low, high = ({n: edge for n in names} for edge in (1.0 / HIGH_T, 1.0 / LOW_T))
        at, settled = dict.fromkeys(names, 1.0), {}
        for _ in range(passes):
            if not at:
                break
            for name, (first, second) in slopes(at).items():
                here = at[name]
                (high if first > 0 else low)[name] = here
                step = here - first / second if second > 0 else math.nan
                following = step if low[name] < step < high[name] else math.sqrt(low[name] * high[name])
                at[name] = following
                if abs(following - here) <= tolerance * here:
                    settled[name] = 1.0 / at.pop(name)
        if at:
            raise RuntimeError(f"the temperatures of {sorted(map(str, at))} did not settle in {passes} steps")
    finally:
        kept.unpersist()
    return settled


def fit_temperature(
    df: DataFrame, y: str = "y_true", tolerance: float = 1e-9, passes: int = 60
) -> float:
    """The temperature of one table; an empty table is an error."""
    found = fit_temperatures(df.withColumn("_all", F.lit(0)), "_all", y, tolerance, passes)
    if not found:
        raise ValueError("no rows to fit a temperature on")
    return found[0]


def evaluate(df: DataFrame, by: list[str], y: str = "y_true") -> DataFrame:
    """log-loss, Brier, calibration error, mean confidence and accuracy per group.

    Everything is summed per confidence bin first: one shuffle of at most eight rows
    per group.
    """
    probs = _probs()
    rows = df.select(
        *by,
        row_log_loss(probs, F.col(y)).alias("loss"),
        row_brier(probs, F.col(y)).alias("brier"),
        confidence(probs).alias("conf"),
        (predicted_class(probs) == F.col(y)).cast("double").alias("ok"),
    ).withColumn("bin", bin_index(F.col("conf"), CONF_EDGES))
    bins = rows.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("loss", "brier", "conf", "ok")],
    )
    n = F.sum("n")
    return bins.groupBy(*by).agg(
        n.alias("n"),
        (F.sum("loss") / n).alias("log_loss"),
        (F.sum("brier") / n).alias("brier"),
        (F.sum(F.abs(F.col("ok") - F.col("conf"))) / n).alias("ece"),
        (F.sum("conf") / n).alias("mean_conf"),
        (F.sum("ok") / n).alias("accuracy"),
    )


def calibration_table(df: DataFrame, temperatures: dict[str, float]) -> DataFrame:
    """Before/after metrics per model and split; ``df`` is (model, split, y_true, p1..p5).

    ``argmax_changed`` counts rows whose predicted class moved; it must be zero.
    """
    t = F.when(F.lit(False), F.lit(0.0))
    for model, value in temperatures.items():
        t = t.when(F.col("model") == model, F.lit(float(value)))
    scaled = with_tempered(df.withColumn("t", t), "t", out="q")
    moved = scaled.groupBy("model", "split").agg(
        F.count_if(
            predicted_class(_probs()) != predicted_class([F.col(f"q{c}") for c in CLASSES])
        ).alias("argmax_changed")
    )
    stages = [
        F.struct(F.lit(stage).alias("stage"),
                 *[F.col(f"{p}{c}").alias(f"p{c}") for c in CLASSES])
        for stage, p in (("before", "p"), ("after", "q"))
    ]
    long = scaled.select("model", "split", "t", "y_true", F.inline(F.array(*stages)))
    table = evaluate(long, ["model", "split", "stage", "t"])
    return table.join(moved, ["model", "split"]).withColumnRenamed("t", "temperature")


def calibrate(df: DataFrame, fit_split: str = "val") -> tuple[dict[str, float], DataFrame]:
    """Fit every model on ``fit_split`` and compare before/after on all splits present."""
    models = sorted(r["model"] for r in df.select("model").distinct().collect())
    fitted = fit_temperatures(df.where(F.col("split") == fit_split))
    if missing := [m for m in models if m not in fitted]:
        raise ValueError(f"no rows of {missing} to fit a temperature on")
    temperatures = {m: fitted[m] for m in models}
    table = calibration_table(df, temperatures)
    moved = table.where((F.col("stage") == "after") & (F.col("argmax_changed") > 0))
    if not moved.isEmpty():
        raise AssertionError("temperature scaling changed a predicted class")
    return temperatures, table
