"""Exact leakage checks between the parts of a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from .splitting import fingerprint


def keys_across_parts(df: DataFrame, key: Column) -> DataFrame:
    """One row: keys found in more than one part (least part < greatest part)."""
    spans = df.where(key.isNotNull()).groupBy(key.alias("key")).agg(
        (F.min("split") < F.max("split")).alias("crosses")
    )
    return spans.agg(F.count_if("crosses").alias("crossing"))


def group_overlap(df: DataFrame, group: str) -> DataFrame:
    return keys_across_parts(df, F.col(group))


def text_overlap(df: DataFrame) -> DataFrame:
    return keys_across_parts(df, tx.text_digest(tx.casefold(F.col("text"))))


def punctuation_free_copies(df: DataFrame) -> DataFrame:
    """Copies once punctuation is gone: rows involved and keys spanning parts."""
    key = tx.text_digest(tx.strip_punctuation(tx.casefold(F.col("text"))))
    keys = df.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("n"), (F.min("split") < F.max("split")).alias("crosses")
    )
    return keys.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_groups"),
        F.count_if("crosses").alias("crossing"),
    )


def leakage_verdict(df: DataFrame, group: str, stored: DataFrame) -> DataFrame:
    """Check table: group overlap, text overlap, unchanged test ids - each PASS or FAIL.

    ``stored`` is the one-row fingerprint written with the split.
    """
    def check(counted: DataFrame, name: str) -> DataFrame:
        value = F.col("crossing")
        return counted.select(
            F.lit(name).alias("check"), value.alias("value"),
            F.when(value == 0, "PASS").otherwise("FAIL").alias("result"),
        )

    now = fingerprint(df.where(F.col("split") == "test"))
    kept = stored.select("n", "digest_a", "digest_b")
    changed = now.exceptAll(kept).agg(F.count(F.lit(1)).alias("crossing"))
    return (
        check(group_overlap(df, group), "group_overlap")
        .unionByName(check(text_overlap(df), "text_overlap"))
        .unionByName(check(changed, "test_ids_changed"))
    )


def require_no_leakage(verdict: DataFrame) -> None:
    """Fail the job when any check failed."""
    failed = [r["check"] for r in verdict.where(F.col("result") != "PASS").collect()]
    if failed:
        raise RuntimeError(f"leakage checks failed: {failed}")
