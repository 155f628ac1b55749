"""Agreement of two prediction sets for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.probs import CLASSES, PROB_COLS
from ..plans.materialize import cut
from ..plans.quantiles import interpolated_wide
from ..plans.ranking import top_n


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every id of either set with both predictions and the largest probability difference;
    null where one set lacks the id."""
    left = a.select("row_id", F.col("y_pred").alias("pred_a"),
                    *[F.col(c).alias(f"a{i}") for i, c in zip(CLASSES, PROB_COLS)])
    right = b.select("row_id", F.col("y_pred").alias("pred_b"),
                     *[F.col(c).alias(f"b{i}") for i, c in zip(CLASSES, PROB_COLS)])
    gaps = [F.abs(F.col(f"a{i}") - F.col(f"b{i}")) for i in CLASSES]
    both = F.col("pred_a").isNotNull() & F.col("pred_b").isNotNull()
    return left.join(right, "row_id", "full").select(
        "row_id", "pred_a", "pred_b", F.when(both, F.greatest(*gaps)).alias("max_gap")
    )


def parity_check(
    a: DataFrame, b: DataFrame, min_agreement: float = 0.97, max_median: float = 0.01
) -> DataFrame:
    """One row: ids in both sets, ids in one only, agreement, gap quantiles and the verdict.

    An id that one set lacks fails the check.  The pairs are stored once for all figures.
    """
    pairs = cut(paired(a, b))
    quantiles = interpolated_wide(pairs, "max_gap", {"median": 0.5, "p95": 0.95, "maximum": 1.0})
    both = F.col("max_gap").isNotNull()
    same = F.when(both, (F.col("pred_a") == F.col("pred_b")).cast("double"))
    figures = pairs.agg(
        F.avg(same).alias("agreement"), F.count_if(both & (F.col("pred_a") != F.col("pred_b"))).alias("differing"),
        F.count_if(~both).alias("incomplete"),
    ).first()
    out = quantiles.withColumns({k: F.lit(v) for k, v in figures.asDict().items()})
    good = (F.col("agreement") >= min_agreement) & (F.col("median") <= max_median) & (F.col("incomplete") == 0)
    return out.withColumn("passed", good)


def mismatches(a: DataFrame, b: DataFrame, n: int = 10) -> DataFrame:
    """The first n ids whose predicted ratings differ."""
    differing = paired(a, b).where(F.col("pred_a") != F.col("pred_b"))
    return top_n(differing, n, F.col("row_id"))
