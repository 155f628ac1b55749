"""Column, length, noise, duplicate and mention profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.bins import histogram_bin
from ..functions.mentions import prioritised_mention
from ..plans.materialize import cut
from ..plans.quantiles import interpolated
from ..plans.ranking import top_n
from .cleaning import in_range, text_key

# Profile quantiles, short-text and long-text thresholds.
QUANTILES = {
    "min": 0.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_9": 0.999, "max": 1.0,
}
SHORT_WORDS = (2, 3, 5, 10)
LONG_TOKENS = (64, 128, 256, 512)


def _rows(df: DataFrame, names: tuple[str, ...], entries: list[tuple[Column, ...]]) -> DataFrame:
    """Turn a one-row aggregate into a long table."""
    structs = [F.struct(*[c.alias(n) for n, c in zip(names, e)]) for e in entries]
    return df.select(F.inline(F.array(*structs)))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, nulls and blank strings, in one pass."""
    types = dict(df.dtypes)
    aggs = []
    for c, t in types.items():
        blank = tx.is_blank(F.col(c)) & F.col(c).isNotNull() if t == "string" else F.lit(False)
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.count_if(blank).alias(f"b_{c}")]
    entries = [(F.lit(c), F.lit(t), F.col(f"n_{c}"), F.col(f"b_{c}")) for c, t in types.items()]
    return _rows(df.agg(*aggs), ("column", "dtype", "nulls", "blank"), entries)


def value_counts(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    """Counts and shares per value; the total is a sum of the counts, which are read again
    from their exchange, not from the input."""
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n").cast("double") / total.cast("double"))


def quantile_profile(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Quantiles of several integer measures, one row per measure."""
    pairs = [F.struct(F.lit(k).alias("measure"), c.alias("v")) for k, c in measures.items()]
    long = df.select(F.inline(F.array(*pairs)))
    return interpolated(long, "v", QUANTILES, ["measure"]).drop("n")


def approximate_quantile_profile(
    df: DataFrame, measures: dict[str, Column], accuracy: int = 10_000
) -> DataFrame:
    """Same table with approximate, non-interpolated quantiles in one pass."""
    probs = [F.lit(p) for p in QUANTILES.values()]
    wide = df.agg(
        *[F.percentile_approx(c, F.array(*probs), accuracy).alias(k) for k, c in measures.items()]
    )
    entries = [
        (F.lit(k), *[F.get(F.col(k), F.lit(i)).cast("double") for i in range(len(probs))])
        for k in measures
    ]
    return _rows(wide, ("measure", *QUANTILES), entries)


def length_by_group(df: DataFrame, value: str, by: str) -> DataFrame:
    """Mean, median, p90, p99 and max of an integer measure per group."""
    rows = df.where(F.col(by).isNotNull())
    probs = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}
    return interpolated(rows, value, probs, [by], mean="mean").drop("n")


def threshold_shares(df: DataFrame, words: Column, tokens: Column) -> DataFrame:
    """Shares of texts below k words and above m tokens."""
    total = F.count(F.lit(1)).cast("double")
    wide = df.agg(
        total.alias("total"),
        *[F.count_if(words < k).alias(f"lt_{k}") for k in SHORT_WORDS],
        *[F.count_if(tokens > m).alias(f"gt_{m}") for m in LONG_TOKENS],
    )
    names = [f"lt_{k}" for k in SHORT_WORDS] + [f"gt_{m}" for m in LONG_TOKENS]
    return _rows(
        wide, ("threshold", "n", "share"),
        [(F.lit(c), F.col(c), F.col(c) / F.col("total")) for c in names],
    )


def noise_rates(df: DataFrame, raw: str = "text") -> DataFrame:
    """Counts of emoji, links, no-Cyrillic texts and of literal and real newlines."""
    clean = tx.normalize_text(F.col(raw))
    return df.select(F.col(raw).alias("raw"), clean.alias("clean")).agg(
        F.count_if(tx.has_emoji(F.col("clean"))).alias("emoji"),
        F.count_if(tx.has_url(F.col("clean"))).alias("url"),
        F.count_if(tx.no_cyrillic(F.col("clean"))).alias("no_cyrillic"),
        F.count_if(F.contains(F.col("raw"), F.lit("\\n"))).alias("literal_newline"),
        F.count_if(F.contains(F.col("raw"), F.lit("\n"))).alias("real_newline"),
    )


def style_by_class(df: DataFrame, label: str = "rating") -> DataFrame:
    """Mean style features per class."""
    t = F.col("text")
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(
            F.avg(tx.has_emoji(t).cast("double")).alias("has_emoji"),
            F.avg(tx.has_url(t).cast("double")).alias("has_url"),
            F.avg(tx.no_cyrillic(t).cast("double")).alias("no_cyr"),
            F.avg(F.regexp_count(t, F.lit("!")).cast("double")).alias("excl"),
            F.avg(tx.capital_share(t)).alias("caps_share"),
        )
    )


def length_by_class(df: DataFrame, value: str, label: str) -> DataFrame:
    """Mean and median length per class."""
    rows = df.where(F.col(label).isNotNull())
    return interpolated(rows, value, {"median": 0.5}, [label], mean="mean").drop("n")


def duplicate_profile(df: DataFrame, label: str = "rating", entity: str = "name_ru") -> DataFrame:
    """Copies of texts: extra rows, rows and groups involved, conflicts, shared entities.

    Both aggregates read stored keys, so that a text is prepared, folded and digested once.
    """
    rows = cut(df.select(
        label, entity, "address", (F.col("text") != "").alias("known"),
        text_key(F.col("text")).alias("key"), tx.text_digest(F.col("text")).alias("digest"),
    ))
    keys = (
        rows.where(F.col("known"))
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.min(label) < F.max(label), F.lit(False)).alias("conflict"),
            F.coalesce(F.min(entity) < F.max(entity), F.lit(False)).alias("shared"),
        )
    )
    copied = F.col("n") > 1
    texts = keys.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_copies"),
        F.coalesce(F.sum(F.when(copied, F.col("n"))), F.lit(0)).alias("rows_in_groups"),
        F.count_if(copied).alias("groups"),
        F.count_if(F.col("conflict")).alias("conflicting_groups"),
        F.count_if(F.col("shared")).alias("cross_entity_groups"),
    )
    whole = (
        rows.groupBy(entity, "address", label, "digest")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("full_row_copies"))
    )
    names = ["extra_copies", "rows_in_groups", "groups", "conflicting_groups",
             "cross_entity_groups"]
    first = _rows(texts, ("metric", "value"), [(F.lit(c), F.col(c)) for c in names])
    last = _rows(whole, ("metric", "value"),
                 [(F.lit("full_row_copies"), F.col("full_row_copies"))])
    return first.unionByName(last)


def class_floor(df: DataFrame, rating: str = "rating", majority: int = 5) -> DataFrame:
    """Share p of the majority class and what always predicting it would score."""
    p = F.avg((F.col(rating) == majority).cast("double"))
    valid = df.where(in_range(F.col(rating)))
    return valid.agg(F.count(F.lit(1)).alias("n"), p.alias("accuracy")).withColumn(
        "macro_f1", F.lit(2.0) * F.col("accuracy") / (F.lit(1.0) + F.col("accuracy")) / F.lit(5.0)
    )


def escape_counts(df: DataFrame, raw: str = "text") -> DataFrame:
    """How often each escape sequence comes first in a text."""
    firsts = df.select(tx.first_escape(F.col(raw)).alias("escape"))
    return value_counts(firsts, "escape").drop("share")


def mention_quality(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Rows with an explicit mention and how often it equals the rating."""
    m = df.select(F.col(rating), prioritised_mention(F.col("text")).alias("mention"))
    return m.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("mention").alias("with_mention"),
        F.avg((F.col("mention") == F.col(rating)).cast("double")).alias("agreement"),
    )


def mention_crosstab(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Truth against mentioned rating."""
    m = df.select(F.col(rating), prioritised_mention(F.col("text")).alias("mention"))
    rows = m.where(F.col("mention").isNotNull() & F.col(rating).isNotNull())
    return crosstab(rows, rating, "mention", [1, 2, 3, 4, 5], prefix="m")


def crosstab(
    df: DataFrame, row: str, column: str, values: list, prefix: str = "c",
    shares: bool = False, total: bool = False,
) -> DataFrame:
    """Counts of ``row`` by the given ``column`` values, optionally as row shares.

    ``total`` adds a row of sums, marked by a null key, from the pivoted table.
    """
    rows = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = [
        F.count_if(F.col(column) == F.lit(v)).alias(f"{prefix}{i + 1}")
        for i, v in enumerate(values)
    ]
    names = [f"{prefix}{i + 1}" for i in range(len(values))]
    table = rows.groupBy(row).agg(*cells)
    if total:
        table = table.rollup(row).agg(*[F.sum(c).alias(c) for c in names])
    if shares:
        size = sum((F.col(c) for c in names[1:]), F.col(names[0])).cast("double")
        table = table.select(row, *[F.try_divide(F.col(c).cast("double"), size).alias(c)
                                    for c in names])
    return table


def class_spread(df: DataFrame, part: str, label: str, values: list) -> DataFrame:
    """Largest difference of any class share between parts."""
    table = crosstab(df, part, label, values, shares=True)
    names = [f"c{i + 1}" for i in range(len(values))]
    ranges = table.agg(*[(F.max(c) - F.min(c)).alias(c) for c in names])
    return ranges.select(F.greatest(*[F.col(c) for c in names]).alias("max_spread"))


def clipped_histogram(df: DataFrame, value: str, cap: float = 0.99, bins: int = 60) -> DataFrame:
    """Histogram of an integer measure clipped at its p99.

    Values collapse to (value, count) first, so clipping and binning touch only the
    distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("f"))
    top = interpolated(df, value, {"cap": cap}).select("cap").scalar()
    clipped = counts.withColumn("x", F.least(F.col(value).cast("double"), top))
    low = counts.agg(F.min(F.col(value).cast("double"))).scalar()
    return (
        clipped.withColumn("bin", histogram_bin(F.col("x"), low, top, bins))
        .groupBy("bin")
        .agg(F.sum("f").alias("n"))
    )


def longest_texts(df: DataFrame, n: int = 3) -> DataFrame:
    """The n longest texts."""
    rows = df.select("row_id", F.length("text").alias("chars"))
    return top_n(rows.where(F.col("chars").isNotNull()), n, F.desc("chars"), F.col("row_id"))
