"""The unified error table, model agreement and its crosstab."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.bins import length_bin
from ..functions.mentions import earliest_mention, mention_group
from ..functions.probs import CLASSES, PROB_COLS, confidence, predicted_class
from .joins import align, one_to_one_join

BOTH_RIGHT, BOTH_WRONG, ONLY_A, ONLY_B = "both_right", "both_wrong", "only_a", "only_b"
AGREEMENT = (BOTH_RIGHT, BOTH_WRONG, ONLY_A, ONLY_B)
NO_RUBRIC = "без рубрики"


def agreement_label(y: Column, a: Column, b: Column) -> Column:
    return (
        F.when((y == a) & (y == b), BOTH_RIGHT)
        .when((y != a) & (y != b), BOTH_WRONG)
        .when((y == a) & (y != b), ONLY_A)
        .when((y != a) & (y == b), ONLY_B)
    )


def add_features(df: DataFrame) -> DataFrame:
    """Length, emoji, mention and rubric features plus the agreement of two models."""
    return (
        df.withColumn("length_chars", F.length("text"))
        .withColumn("length_words", tx.word_count(F.col("text")))
        .withColumn("len_bin", length_bin(F.col("length_chars")))
        .withColumn("has_emoji", F.when(tx.has_emoji(F.col("text"), wide=True), "да").otherwise("нет"))
        .withColumn("mention", earliest_mention(F.col("text")))
        .withColumn("mention_group", mention_group(F.col("mention"), F.col("y_true")))
        .withColumn("rubric_main", tx.first_item_or(F.col("rubrics"), NO_RUBRIC))
        .withColumn(
            "agreement", agreement_label(F.col("y_true"), F.col("pred_base"), F.col("pred_tr"))
        )
    )


def mean_probs(models: list[str]) -> list[Column]:
    """Class probabilities averaged over models of an aligned wide table."""
    out = []
    for c in CLASSES:
        total = F.col(f"{models[0]}_p{c}")
        for m in models[1:]:
            total = total + F.col(f"{m}_p{c}")
        out.append(total / F.lit(float(len(models))))
    return out


def ensemble(models: dict[str, DataFrame]) -> DataFrame:
    """Averaged probabilities, predicted class and confidence over aligned models."""
    wide = align(models)
    averaged = wide.select(
        "row_id", "y_true", *[p.alias(c) for p, c in zip(mean_probs(list(models)), PROB_COLS)]
    )
    probs = [F.col(c) for c in PROB_COLS]
    return averaged.withColumn("y_pred", predicted_class(probs)).withColumn(
        "conf", confidence(probs)
    )


def prediction_table(base: DataFrame, seeds: dict[str, DataFrame], main: str) -> DataFrame:
    """Truth, predictions and confidences of the base model, one seed and the ensemble."""
    wide = align({"base": base} | seeds)
    names = list(seeds)
    step = wide.withColumns({f"e{c}": p for c, p in zip(CLASSES, mean_probs(names))})
    ens = [F.col(f"e{c}") for c in CLASSES]
    return step.select(
        "row_id", "y_true",
        F.col("base_y_pred").alias("pred_base"),
        F.col(f"{main}_y_pred").alias("pred_tr"),
        predicted_class(ens).alias("pred_ens"),
        confidence([F.col(f"base_p{c}") for c in CLASSES]).alias("conf_base"),
        confidence([F.col(f"{main}_p{c}") for c in CLASSES]).alias("conf_tr"),
        confidence(ens).alias("conf_ens"),
    )


def error_table(
    base: DataFrame, seeds: dict[str, DataFrame], main: str, clean: DataFrame
) -> DataFrame:
    """Predictions joined to their reviews, with features; unmatched ids are an error."""
    table = prediction_table(base, seeds, main)
    texts = clean.select("row_id", "text", "rubrics", "group_key")
    return add_features(one_to_one_join(table, texts, "row_id"))


def agreement_crosstab(df: DataFrame) -> DataFrame:
    """Agreement counts by true class, with a total row marked by a null class."""
    counts = df.groupBy("y_true").agg(
        *[F.count_if(F.col("agreement") == a).alias(a) for a in AGREEMENT]
    )
    return counts.rollup("y_true").agg(*[F.sum(a).alias(a) for a in AGREEMENT])


def mention_mismatch(df: DataFrame) -> DataFrame:
    """Share of rows with a mention and, among them, of mentions unlike the truth."""
    has = F.col("mention").isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(has.cast("double")).alias("with_mention"),
        F.avg(F.when(has, (F.col("mention") != F.col("y_true")).cast("double"))).alias("mismatch"),
    )
