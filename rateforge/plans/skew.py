"""Joining per-key statistics back to rows when one key may hold a third of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key with at least this many rows is "hot".  There can be at most
# total_rows / HOT_ROWS hot keys, which is what bounds the broadcast side.
HOT_ROWS = 5_000_000


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: list[str],
    ids: list[str],
    count_col: str = "n",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left-join ``stats`` (one row per key, with a row count) onto ``df``.

    Hot keys are answered by a broadcast of the few hot statistics.  Their rows then
    carry a per-row join hash into the shuffle join, so they spread evenly instead
    of meeting in one task.  Rows with a null key get null statistics.
    """
    values = [c for c in stats.columns if c not in keys]
    hot = stats.where(F.col(count_col) >= hot_rows).select(
        *keys, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values]
    )
    cold = stats.where(F.col(count_col) < hot_rows).select(
        F.xxhash64(*keys).alias("_spread"),
        *[F.col(k).alias(f"_cold_{k}") for k in keys],
        *[F.col(c).alias(f"_cold_{c}") for c in values],
    )
    spread = F.when(F.col("_hot"), F.xxhash64(*ids)).otherwise(F.xxhash64(*keys))
    left = df.join(F.broadcast(hot), keys, "left").withColumn("_spread", spread)
    matches = left["_spread"] == cold["_spread"]
    for k in keys:
        matches = matches & (left[k] == cold[f"_cold_{k}"])
    joined = left.join(cold, matches, "left")
    return joined.select(
        *[left[c] for c in df.columns],
        *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cold_{c}")).alias(c) for c in values],
    )


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key; rows with a null key are left out, as in a pandas group-by."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
