"""Joins with cardinality contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.probs import PROB_COLS
from ..plans.materialize import cut


def key_report(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """One row: keys repeated on either side and left rows without a partner.

    Only the keys are shuffled, once for both sides.
    """
    tagged = left.select(on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(on, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    keys = tagged.groupBy(on).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return keys.agg(
        F.count_if(F.col("l") > 1).alias("left_repeats"),
        F.count_if(F.col("r") > 1).alias("right_repeats"),
        F.coalesce(F.sum(F.when(F.col("r") == 0, F.col("l"))), F.lit(0)).alias("unmatched"),
    )


def one_to_one_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join that fails unless it is one-to-one and every left row has a partner."""
    report = key_report(left, right, on).first().asDict()
    broken = {k: v for k, v in report.items() if v}
    if broken:
        raise ValueError(f"join on {on} is not one-to-one and complete: {broken}")
    return left.join(right, on, "left")


def load_split(clean: DataFrame, split: DataFrame) -> DataFrame:
    """Clean rows with their part; a row without a part is an error."""
    return one_to_one_join(clean, split, "row_id")


def aligned_wide(models: dict[str, DataFrame]) -> DataFrame:
    """One row per id with the truth and every model's prediction and probabilities.

    All models go through one shuffle; ``rows`` and the truth range let a caller see
    whether the id sets and truths agree.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [
            df.select("row_id", "y_true", "y_pred", *PROB_COLS).withColumn("model", F.lit(m))
            for m, df in models.items()
        ],
    )
    cells = [
        F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}")
        for m in models
        for c in ("y_pred", *PROB_COLS)
    ]
    present = [F.count_if(F.col("model") == m).alias(f"rows_{m}") for m in models]
    return tagged.groupBy("row_id").agg(
        F.min("y_true").alias("y_true"), F.max("y_true").alias("y_high"), *present, *cells
    )


def _alignment(wide: DataFrame, models) -> DataFrame:
    once = reduce(lambda a, b: a & b, [F.col(f"rows_{m}") == 1 for m in models])
    return wide.agg(
        F.count(F.lit(1)).alias("ids"),
        F.count_if(~once).alias("incomplete"),
        F.count_if(F.col("y_true") != F.col("y_high")).alias("truth_differs"),
    )


def alignment_report(models: dict[str, DataFrame]) -> DataFrame:
    """One row: ids, ids not held exactly once by each model, ids with differing truths."""
    return _alignment(aligned_wide(models), models)


def align(models: dict[str, DataFrame]) -> DataFrame:
    """Wide predictions of several models; disagreeing ids or truths are an error.

    The wide table is stored before it is checked, so the shuffle runs once.
    """
    wide = cut(aligned_wide(models))
    report = _alignment(wide, models).first()
    if report["incomplete"] or report["truth_differs"]:
        raise ValueError(f"predictions do not align: {report.asDict()}")
    return wide.drop("y_high", *[f"rows_{m}" for m in models])


def attach_texts(pairs: DataFrame, texts: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Texts of both members of a small table of id pairs, which is what is sent out:
    the texts stay where they are."""
    a = texts.select(F.col("row_id").alias(left_id), F.col("text").alias("left_text"))
    b = texts.select(F.col("row_id").alias(right_id), F.col("text").alias("right_text"))
    half = a.join(F.broadcast(pairs), left_id)
    return b.join(F.broadcast(half), right_id)
