"""Entity keys, group sizes, chains, category statistics and variance shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..plans.quantiles import interpolated
from ..plans.ranking import top_n
from ..plans.skew import HOT_ROWS, attach, group_sizes

# Configuration name of a group key and its column.
GROUP_KEYS = {"name": "gk_name", "name_addr": "gk_name_addr"}


def group_column(group_key: str | None) -> str:
    if group_key not in GROUP_KEYS:
        raise ValueError(f"group_key must be one of {sorted(GROUP_KEYS)}, got {group_key!r}")
    return GROUP_KEYS[group_key]


def with_group_keys(df: DataFrame, group_key: str = "name") -> DataFrame:
    """Add the normalised name key, the name+address key and the chosen ``group_key``."""
    chosen = group_column(group_key)
    return (
        df.withColumn("gk_name", tx.norm_key(F.col("name_ru")))
        .withColumn("addr_key", tx.norm_key(F.col("address")))
        .withColumn("gk_name_addr", tx.composite_key(F.col("gk_name"), F.col("addr_key")))
        .withColumn("group_key", F.col(chosen))
    )


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """(size, groups): at most about sqrt(2 * rows) distinct sizes exist."""
    sizes = group_sizes(df, [key]).withColumnRenamed("n", "size")
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def _rows_in_top(k: int) -> F.Column:
    """Rows held by the k largest groups, from a descending running group count."""
    taken = F.greatest(F.least(F.col("groups"), F.lit(k) - F.col("larger")), F.lit(0))
    return F.sum(taken * F.col("size"))


def _descending(histogram: DataFrame) -> DataFrame:
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("size"))
    return histogram.withColumn("larger", F.sum("groups").over(order) - F.col("groups"))


def group_stats(df: DataFrame, key: str) -> DataFrame:
    """Concentration of rows in groups: counts, size quantiles, largest and top-10 share."""
    hist = _descending(size_histogram(df, key))
    q = F.percentile("size", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("groups"))
    rows = F.sum(F.col("size") * F.col("groups"))
    out = hist.agg(
        F.sum("groups").alias("groups"),
        q.alias("q"),
        F.max("size").alias("size_max"),
        (F.max("size") / rows).alias("largest_share"),
        (_rows_in_top(10) / rows).alias("top10_share"),
    )
    return out.select(
        "groups", F.get("q", F.lit(0)).alias("size_median"), F.get("q", F.lit(1)).alias("size_p90"),
        F.get("q", F.lit(2)).alias("size_p99"), "size_max", "largest_share", "top10_share",
    )


def top_shares(df: DataFrame, key: str, ks: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """Cumulative share of rows held by the k largest groups."""
    rows = F.sum(F.col("size") * F.col("groups"))
    wide = _descending(size_histogram(df, key)).agg(
        *[(_rows_in_top(k) / rows).alias(f"k{k}") for k in ks]
    )
    pairs = [F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("share")) for k in ks]
    return wide.select(F.inline(F.array(*pairs)))


def log_size_histogram(df: DataFrame, key: str, bins: int = 60) -> DataFrame:
    """Histogram of log10(group size) with equal-width bins between min and max."""
    from ..functions.bins import histogram_bin

    hist = size_histogram(df, key).withColumn("x", F.log10(F.col("size").cast("double")))
    low, high = hist.agg(F.min("x")).scalar(), hist.agg(F.max("x")).scalar()
    return (
        hist.withColumn("bin", histogram_bin(F.col("x"), low, high, bins))
        .groupBy("bin")
        .agg(F.sum("groups").alias("n"))
    )


def chain_summary(df: DataFrame, name: str, place: str) -> DataFrame:
    """Names found at more than one place, and the rows they hold.

    "More than one distinct value" is min < max, which needs no distinct set.
    """
    names = df.where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("n"), (F.min(place) < F.max(place)).alias("chain")
    )
    return names.agg(
        F.count(F.lit(1)).alias("names"),
        F.count_if("chain").alias("chains"),
        F.coalesce(F.sum(F.when(F.col("chain"), F.col("n"))), F.lit(0)).alias("chain_rows"),
        F.try_divide(
            F.coalesce(F.sum(F.when(F.col("chain"), F.col("n"))), F.lit(0)).cast("double"),
            F.sum("n").cast("double"),
        ).alias("chain_share"),
    )


def chain_rows(df: DataFrame, name: str, place: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with a flag telling whether their name is a chain."""
    stats = df.where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("n"), (F.min(place) < F.max(place)).alias("is_chain")
    )
    out = attach(df, stats, [name], ["row_id"], hot_rows=hot_rows)
    return out.withColumn("is_chain", F.coalesce("is_chain", F.lit(False))).drop("n")


def top_groups(df: DataFrame, name: str, place: str, k: int = 10) -> DataFrame:
    """Largest groups by rows with their number of distinct places."""
    groups = df.where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("reviews"), F.countDistinct(place).alias("places")
    )
    return top_n(groups, k, F.desc("reviews"), F.col(name))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values of several columns; HyperLogLog when ``approximate``."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[count(c).alias(c) for c in columns])


def part_sketches(df: DataFrame, by: list[str], keys: dict[str, Column], measures: dict[str, Column], lg_k: int = 14, k: int = 800) -> DataFrame:
    """Mergeable sketches of every part: HyperLogLog of ``keys`` and KLL of the integer
    ``measures``, as binary columns with the number of rows.

    Stored once a part, they answer later for any union of parts without its rows."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.hll_sketch_agg(c, lg_k).alias(f"hll_{n}") for n, c in keys.items()],
        *[F.kll_sketch_agg_bigint(c.cast("bigint"), k).alias(f"kll_{n}") for n, c in measures.items()],
    )


def merged_sketches(sketches: DataFrame, by: list[str], keys: list[str], measures: list[str], probs: dict[str, float]) -> DataFrame:
    """Distinct numbers of ``keys`` and quantiles of ``measures`` from stored sketches merged by ``by``."""
    merged = sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"), *[F.hll_union_agg(f"hll_{n}").alias(f"hll_{n}") for n in keys],
        *[F.kll_merge_agg_bigint(f"kll_{n}").alias(f"kll_{n}") for n in measures],
    )
    quantiles = [F.kll_sketch_get_quantile_bigint(f"kll_{n}", F.lit(p)).alias(f"{n}_{q}") for n in measures for q, p in probs.items()]
    return merged.select(*by, "rows", *[F.hll_sketch_estimate(f"hll_{n}").alias(n) for n in keys], *quantiles)


def category_stats(df: DataFrame, category: str, rating: str, min_n: int = 2000) -> DataFrame:
    """Per category: rows, mean rating, share of ones; only categories with min_n rows."""
    return (
        df.where(F.col(category).isNotNull())
        .groupBy(category)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col(rating)).alias("mean_rating"),
            F.avg((F.col(rating) == 1).cast("double")).alias("share_1"),
        )
        .where(F.col("n") >= min_n)
    )


def between_variance(df: DataFrame, key: str, value: str, min_n: int = 30) -> DataFrame:
    """Share of the value's variance explained by the group, on groups of min_n rows.

    The row-level variance of the group mean follows from per-group counts and sums,
    so no mean is ever sent back to the rows.
    """
    v = F.col(value).cast("double")
    groups = (
        df.where(F.col(key).isNotNull() & v.isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
        .where(F.col("n") >= min_n)
    )
    total = groups.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("groups"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"),
    )
    centre = F.col("s") * F.col("s") / F.col("rows")
    share = F.try_divide(F.col("b") - centre, F.col("q") - centre)
    return total.select("rows", "groups", share.alias("between_share"))


def with_group_mean(
    df: DataFrame, key: str, value: str, ids: list[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Group size and group mean on every row."""
    stats = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("group_mean")
    )
    return attach(df, stats, [key], ids, hot_rows=hot_rows).withColumnRenamed("n", "group_size")


def group_mean_histogram(
    df: DataFrame, key: str, value: str, min_n: int = 30, bins: int = 60
) -> DataFrame:
    """Histogram of group means over groups of at least min_n rows."""
    from ..functions.bins import histogram_bin

    means = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"))
        .where(F.col("n") >= min_n)
    )
    low, high = means.agg(F.min("m")).scalar(), means.agg(F.max("m")).scalar()
    return (
        means.withColumn("bin", histogram_bin(F.col("m"), low, high, bins))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def size_profile(df: DataFrame, key: str) -> DataFrame:
    """Describe group sizes: mean, median, p90, p99, max."""
    sizes = group_sizes(df, [key]).withColumnRenamed("n", "size")
    q = interpolated(sizes, "size", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0})
    return q.withColumnRenamed("n", "groups")


def top_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n")
    )
    return top_n(counts, k, F.desc("n"), F.col(column))


def keep_top_categories(
    df: DataFrame, column: str, k: int, other: str, out: str
) -> DataFrame:
    """The k most frequent categories stay, the rest become ``other``.

    The lookup side has exactly k rows, so it may be broadcast.
    """
    top = top_categories(df, column, k).select(column, F.lit(True).alias("_top"))
    joined = df.join(F.broadcast(top), column, "left")
    return joined.withColumn(out, F.when(F.col("_top"), F.col(column)).otherwise(other)).drop("_top")
