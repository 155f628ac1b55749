"""Exact ranks under a seeded hash order without sorting the table in one place.

Rows are counted per leading-bits bucket of their hash; a running total over that
small count table says in which bucket a rank falls, so only rows of that bucket
need to be ordered among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import HASH_BITS, seeded_hash

BUCKET_BITS = 16  # 65,536 buckets


def with_hash(df: DataFrame, ids: list[str], seed: int | str) -> DataFrame:
    h = seeded_hash(seed, *[F.col(c) for c in ids])
    return df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", HASH_BITS - BUCKET_BITS))


def bucket_offsets(keyed: DataFrame, strata: list[str]) -> DataFrame:
    """Rows per (stratum, bucket) and the rows in earlier buckets of the stratum.

    The window runs over at most 65,536 pre-aggregated rows per stratum.
    """
    counts = keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    order = W.partitionBy(*(strata or [F.lit(0)])).orderBy("_b")
    return counts.withColumn("_before", F.sum("_cnt").over(order) - F.col("_cnt"))


def smallest_by_hash(
    df: DataFrame, ids: list[str], n: int, seed: int | str, strata: list[str] = ()
) -> DataFrame:
    """The n rows with the smallest (hash, ids) per stratum, with their 1-based ``rank``.

    Strata with fewer rows are returned whole; rows with a null stratum are left out.
    """
    strata = list(strata)
    keyed = with_hash(df.dropna(subset=strata) if strata else df, ids, seed)
    offsets = bucket_offsets(keyed, strata).where(F.col("_before") < n)
    # Without strata there are at most 65,536 offsets: the rows stay where they are.
    near = keyed.join(offsets if strata else F.broadcast(offsets), [*strata, "_b"])
    inside = W.partitionBy(*strata, "_b").orderBy("_h", *ids)
    ranked = near.withColumn("rank", F.col("_before") + F.row_number().over(inside))
    return ranked.where(F.col("rank") <= n).drop("_h", "_b", "_cnt", "_before")


def label_by_rank(df: DataFrame, ids: list[str], seed: int | str, label_of) -> DataFrame:
    """Add ``label_of(rank)`` for each row's 1-based hash rank over the whole table.

    ``label_of`` must be piecewise constant in the rank.  Buckets that lie inside one
    piece are labelled by a broadcast of at most 65,536 rows; only buckets that
    straddle a border are shuffled and ordered.
    """
    keyed = with_hash(df, ids, seed)
    offsets = bucket_offsets(keyed, [])
    first, last = label_of(F.col("_before") + 1), label_of(F.col("_before") + F.col("_cnt"))
    bounds = offsets.select("_b", "_before", F.when(first == last, first).alias("label"))
    marked = keyed.join(F.broadcast(bounds), "_b")
    inside = W.partitionBy("_b").orderBy("_h", *ids)
    border = marked.where(F.col("label").isNull()).withColumn(
        "label", label_of(F.col("_before") + F.row_number().over(inside))
    )
    return (
        marked.where(F.col("label").isNotNull())
        .unionByName(border)
        .drop("_h", "_b", "_before")
    )


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First n rows in a total order (each task keeps at most n)."""
    return df.orderBy(*order).limit(n)
