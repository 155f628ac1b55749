"""Class-distinctive terms and token-count distributions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..plans.materialize import stored
from ..plans.quantiles import interpolated
from ..plans.ranking import top_n
from .profile import QUANTILES
from .sampling import sample


def long_words(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def term_log_odds(
    df: DataFrame, label: str, a: int, b: int, min_df: int = 50, n_sample: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """(term, df, log_odds of class a against b) for terms in at least min_df texts.

    Shares are smoothed as (count + 1) / (texts + 2).
    """
    rows = df.where(F.col("text").isNotNull() & F.col(label).isNotNull())
    rows = rows if n_sample is None else sample(rows, n_sample, seed)
    # The outer form: a plain explode makes the optimizer add a size test that would
    # run the tokenizer twice.
    terms = rows.select(
        F.col(label).alias("y"),
        F.explode_outer(F.array_distinct(long_words(F.col("text")))).alias("term"),
    ).where(F.col("term").isNotNull())
    counts = terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        F.count_if(F.col("y") == a).alias("in_a"),
        F.count_if(F.col("y") == b).alias("in_b"),
    ).where(F.col("df") >= min_df)

    def logit(hits: str, cls: int) -> Column:
        texts = rows.agg(F.count_if(F.col(label) == cls)).scalar().cast("double")
        share = (F.col(hits) + 1).cast("double") / (texts + F.lit(2.0))
        return F.ln(share / (F.lit(1.0) - share))

    return counts.select("term", "df", (logit("in_a", a) - logit("in_b", b)).alias("log_odds"))


def distinctive_terms(
    df: DataFrame, label: str, a: int = 1, b: int = 5, min_df: int = 50, k: int = 25,
    n_sample: int | None = None, seed: int = 42,
) -> DataFrame:
    """The k terms most typical of class a and the k most typical of class b."""
    scored = stored(term_log_odds(df, label, a, b, min_df, n_sample, seed))
    # Ties between equal counts must not depend on the last bits of a logarithm.
    scored = scored.withColumn("_k", F.round("log_odds", 9))
    first = top_n(scored, k, F.desc("_k"), F.col("term")).withColumn("typical_of", F.lit(a))
    last = top_n(scored, k, F.asc("_k"), F.col("term")).withColumn("typical_of", F.lit(b))
    return first.unionByName(last).drop("_k")


def token_count(text: Column) -> Column:
    """Word and punctuation tokens: the stand-in when no subword tokenizer is supplied."""
    marks = F.length(F.regexp_replace(text, r"[\p{L}\p{N}_\s]+", ""))
    return F.regexp_count(text, F.lit(f"{tx.WORD}+")) + marks


def token_profile(df: DataFrame, n: int | None, seed: int) -> DataFrame:
    """Token-count quantiles of a sample of non-empty texts."""
    rows = df.where(F.col("text") != "")
    rows = rows if n is None else sample(rows, n, seed)
    return interpolated(
        rows.select(token_count(F.col("text")).alias("tokens")), "tokens", QUANTILES
    )


def tokenizer_lengths(
    df: DataFrame, load_tokenizer: Callable[[], Callable[[list[str]], list[int]]]
) -> DataFrame:
    """(row_id, tokens) from a supplied tokenizer, loaded once per task."""

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = load_tokenizer()
        for batch in batches:
            yield pd.DataFrame({"row_id": batch["row_id"], "tokens": count(list(batch["text"]))})

    return df.select("row_id", "text").mapInPandas(lengths, "row_id long, tokens int")
