"""Seeded samples of an exact size, reproducible on any file layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.ranking import smallest_by_hash, top_n


def sample(df: DataFrame, n: int, seed: int, ids: list[str] = ("row_id",)) -> DataFrame:
    """min(n, rows) rows drawn by hash order."""
    return smallest_by_hash(df, list(ids), n, seed).drop("rank")


def sample_per_stratum(
    df: DataFrame, n: int, seed: int, strata: list[str], ids: list[str] = ("row_id",)
) -> DataFrame:
    """min(n, rows) rows of every stratum."""
    return smallest_by_hash(df, list(ids), n, seed, list(strata)).drop("rank")


def nested_subsamples(
    df: DataFrame, sizes: list[int], repeats: int, seed: int, ids: list[str] = ("row_id",)
) -> DataFrame:
    """Subsamples for every (size, repeat); samples of one repeat nest.

    Each repeat needs one ranking, up to its largest size; the smaller sizes are the
    heads of that ranking.
    """
    largest = max(sizes)
    draws = [
        smallest_by_hash(df, list(ids), largest, seed + r)
        .withColumn("repeat", F.lit(r))
        .withColumn("seed", F.lit(seed + r))
        for r in range(repeats)
    ]
    ranked = reduce(DataFrame.unionByName, draws)
    fitting = F.filter(
        F.array(*[F.lit(s) for s in sorted(sizes)]), lambda s: s >= F.col("rank")
    )
    # Every size below the sample's own length repeats the row once; a size larger
    # than the table keeps the whole table.
    return ranked.withColumn("size", F.explode(fitting)).drop("rank")


def least_confidence_ranking(
    df: DataFrame, n: int, conf_a: str = "conf_base", conf_b: str = "conf_tr"
) -> DataFrame:
    """The n rows whose smaller of two confidences is largest."""
    ranked = df.withColumn("least_conf", F.least(conf_a, conf_b))
    return top_n(ranked, n, F.desc("least_conf"), F.col("row_id"))


def example_rows(df: DataFrame, n: int = 12, seed: int = 42) -> DataFrame:
    """Examples for reading: only-A-right, only-B-right (sampled), both wrong (confident)."""
    from .errors import ONLY_A, ONLY_B, BOTH_WRONG

    one_right = df.where(F.col("agreement").isin(ONLY_A, ONLY_B))
    sampled = sample_per_stratum(one_right, n, seed, ["agreement"]).withColumn(
        "example", F.col("agreement")
    )
    wrong = least_confidence_ranking(df.where(F.col("agreement") == BOTH_WRONG), n)
    return sampled.unionByName(
        wrong.drop("least_conf").withColumn("example", F.lit("both_wrong_confident"))
    )

