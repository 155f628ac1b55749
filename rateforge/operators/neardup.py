"""Near-duplicates of evaluation texts in the training part.

Texts become sets of hashed word shingles.  MinHash bands propose candidates and
the exact Jaccard similarity of the sets decides, so there are no false hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..functions.hashing import seeded_hash
from ..plans.materialize import cut
from ..plans.ranking import smallest_by_hash, top_n
from ..plans.skew import HOT_ROWS, attach
from .joins import attach_texts

SET = ["k1", "k2"]
SHORT_TOKENS = 5
PROBES = 4


def shingle_sets(df: DataFrame, keep: list[str], k: int = 3) -> DataFrame:
    """Token count, sorted distinct shingle hashes and a 128-bit key of that set."""
    words = df.select(*keep, tx.tokens(F.col("text")).alias("words"))
    hashed = words.select(
        *keep,
        F.size("words").alias("n_tokens"),
        F.sort_array(
            F.array_distinct(F.transform(tx.shingles(F.col("words"), k), lambda s: F.xxhash64(s)))
        ).alias("hs"),
    )
    return hashed.withColumns(
        {"k1": F.xxhash64(F.lit(1), "hs"), "k2": F.xxhash64(F.lit(2), "hs")}
    )


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One row per distinct shingle set: exact copies collapse before the shuffle."""
    return rows.groupBy(*SET).agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("id"), F.any_value("hs").alias("hs")
    )


def band_keys(sets: DataFrame, bands: int, rows_per_band: int) -> DataFrame:
    """(id, band key) postings from MinHash signatures.

    The minimum over a set's shingles is a plain aggregate that combines before it
    shuffles one row of minima per set and task.
    """
    perms = range(bands * rows_per_band)
    signed = (
        sets.select(*SET, "id", F.explode_outer("hs").alias("h"))
        .groupBy(*SET)
        .agg(F.min("id").alias("id"), *[F.min(F.xxhash64("h", F.lit(i))).alias(f"m{i}")
                                        for i in perms])
    )
    keys = [
        F.xxhash64(F.lit(b), *[f"m{b * rows_per_band + j}" for j in range(rows_per_band)])
        for b in range(bands)
    ]
    return signed.select("id", F.explode(F.array(*keys)).alias("band"))


def _verified(
    pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float
) -> DataFrame:
    """Candidate (q, t) pairs whose exact Jaccard similarity reaches the threshold."""
    a = left.select(F.col("id").alias("q"), F.col("hs").alias("qs"))
    b = right.select(F.col("id").alias("t"), F.col("hs").alias("ts"))
    joined = pairs.distinct().join(a, "q").join(b, "t")
    short = F.least(F.size("qs"), F.size("ts"))
    long = F.greatest(F.size("qs"), F.size("ts"))
    shared = F.size(F.array_intersect("qs", "ts"))
    similarity = shared.cast("double") / (F.size("qs") + F.size("ts") - shared).cast("double")
    fitting = joined.where(short >= long * F.lit(threshold))
    return fitting.withColumn("jaccard", similarity).where(F.col("jaccard") >= threshold)


def _probe_partners(postings: DataFrame) -> DataFrame:
    """A few partners per band key, whatever its size: fixed-width aggregate state."""
    return postings.groupBy("band").agg(
        F.count(F.lit(1)).alias("band_size"),
        F.array_distinct(
            F.array(
                F.min("id"),
                F.max("id"),
                F.min_by("id", F.xxhash64("id", F.lit(1))),
                F.min_by("id", F.xxhash64("id", F.lit(2))),
            )
        ).alias("partners"),
    )


def prefix_pairs(asked: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Candidate (q, t) pairs that hold every pair of sets at the threshold.

    Sets at Jaccard t or more share at least t of the larger one's shingles, so each has
    one of them among its rarest n - ceil(t n) + 1.  Texts on one template, alike below
    the threshold, have rarer shingles of their own there and do not meet.
    """
    both = asked.select("id", "hs", F.lit(True).alias("asked")).unionByName(
        members.select("id", "hs", F.lit(False).alias("asked"))
    )
    rows = cut(both.select("id", "asked", F.size("hs").alias("n"), F.explode("hs").alias("h")))
    frequency = rows.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    order = W.partitionBy("asked", "id").orderBy("f", "h")
    needed = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1
    ranked = rows.join(frequency, "h").withColumn("place", F.row_number().over(order))
    rare = cut(ranked.where(F.col("place") <= needed).select("id", "asked", "h"))
    left = rare.where("asked").select(F.col("id").alias("q"), "h")
    right = rare.where("not asked").select(F.col("id").alias("t"), "h")
    return left.join(right, "h").select("q", "t").distinct()


def train_sets(df: DataFrame) -> DataFrame:
    """Distinct shingle sets of the training part, stored for all that compare with them."""
    return cut(distinct_sets(shingle_sets(df.where(F.col("split") == "train"), ["row_id"])))


def query_rows(df: DataFrame, n_query: int | None, seed: int) -> DataFrame:
    """Rows of val and test that are looked up: all, or n_query of each part."""
    rows = df.where(F.col("split").isin("val", "test"))
    if n_query is None:
        return rows
    return smallest_by_hash(rows, ["row_id"], n_query, seed, ["split"]).drop("rank")


def near_duplicates(
    df: DataFrame, n_query: int | None = 10_000, threshold: float = 0.8, seed: int = 42,
    bands: int = 16, rows_per_band: int = 4, hot_rows: int = HOT_ROWS,
    train: DataFrame | None = None,
) -> DataFrame:
    """(part, row_id, short, has_dup) for every looked-up row; ``train`` are the
    ``train_sets`` where they are already there.

    The question is whether a partner exists, so a band key shared by very many
    training texts is first answered by a few probes.  Queries still without a partner
    meet the members of such keys by their rarest shingles, not by the key.
    """
    train = train_sets(df) if train is None else train
    rows = cut(shingle_sets(query_rows(df, n_query, seed), ["row_id", "split"]))
    asked = cut(distinct_sets(rows.drop("split")))

    same = asked.join(train.select(*SET), SET, "left_semi").select(F.col("id").alias("q"))
    open_sets = asked.join(train.select(*SET), SET, "left_anti")
    train_bands = cut(band_keys(train, bands, rows_per_band))
    open_bands = cut(band_keys(open_sets, bands, rows_per_band))

    probes = _probe_partners(train_bands)
    first_pairs = open_bands.join(
        probes.select("band", F.explode("partners").alias("t")), "band"
    ).select(F.col("id").alias("q"), "t")
    found = _verified(first_pairs, open_sets, train, threshold).select("q").distinct()
    found = cut(found)

    wide_bands = probes.where(F.col("band_size") > PROBES).select("band")
    rest = open_bands.join(found, F.col("id") == F.col("q"), "left_anti").join(
        wide_bands, "band", "left_semi"
    )
    crowded = train_bands.join(wide_bands, "band", "left_semi").select("id").distinct()
    rest_pairs = prefix_pairs(
        open_sets.join(rest.select("id").distinct(), "id", "left_semi"),
        train.join(crowded, "id", "left_semi"), threshold,
    )
    later = _verified(rest_pairs, open_sets, train, threshold).select("q").distinct()

    hits = same.unionByName(found).unionByName(later).select(F.col("q").alias("id"))
    answered = asked.select(*SET, "n", "id").join(
        hits.withColumn("hit", F.lit(True)), "id", "left"
    ).select(*SET, "n", F.coalesce("hit", F.lit(False)).alias("has_dup"))
    out = attach(rows.drop("hs"), answered, SET, ["row_id"], hot_rows=hot_rows)
    return out.select(
        F.col("split").alias("part"), "row_id",
        (F.col("n_tokens") < SHORT_TOKENS).alias("short"), "has_dup",
    )


def near_duplicate_rates(flags: DataFrame) -> DataFrame:
    """Looked-up rows, hits and hit rate by part and by short/long text."""
    cells = [
        F.count(F.lit(1)).alias("n"),
        F.count_if("has_dup").alias("hits"),
        F.avg(F.col("has_dup").cast("double")).alias("rate"),
    ]
    by_part = flags.groupBy(F.col("part").alias("value")).agg(*cells)
    length = F.when(F.col("short"), "short").otherwise("long")
    by_length = flags.groupBy(length.alias("value")).agg(*cells)
    return by_part.withColumn("slice", F.lit("part")).unionByName(
        by_length.withColumn("slice", F.lit("length"))
    )


def near_duplicate_examples(
    df: DataFrame, flags: DataFrame, n: int = 10, free: int = 4, threshold: float = 0.8,
    seed: int = 42, train: DataFrame | None = None,
) -> DataFrame:
    """Up to n hits with their first partner; short texts only among the first ``free``.
    ``train`` are the ``train_sets`` where they are already there."""
    order = [
        F.when(F.col("part") == "val", 0).otherwise(1),
        seeded_hash(seed, F.col("row_id")),
        F.col("row_id"),
    ]
    hits = flags.where(F.col("has_dup"))
    early = top_n(hits, free, *order)
    steady = top_n(hits.where(~F.col("short")), n, *order)
    chosen = cut(top_n(early.unionByName(steady).distinct(), n, *order))

    texts = df.join(F.broadcast(chosen.select("row_id")), "row_id", "left_semi")
    # At most n looked-up rows: their shingles are sent out, and each training text counts
    # the shared ones, so the partner is exact and no text is signed again.
    asked = cut(shingle_sets(texts, ["row_id"])).select(
        F.col("row_id").alias("q"), F.size("hs").alias("q_size"), F.explode("hs").alias("h")
    )
    sets = train_sets(df) if train is None else train
    terms = sets.select("id", F.size("hs").alias("size"), F.explode("hs").alias("h"))
    shared = terms.join(F.broadcast(asked), "h").groupBy("q", "q_size", "id", "size").agg(
        F.count(F.lit(1)).alias("both")
    )
    jaccard = F.col("both") / (F.col("q_size") + F.col("size") - F.col("both"))
    partners = shared.where(jaccard >= threshold).groupBy("q").agg(F.min("id").alias("partner_id"))
    pairs = chosen.join(partners, F.col("row_id") == F.col("q")).select(
        "part", "row_id", "partner_id"
    )
    out = attach_texts(pairs, df.select("row_id", "text"), "row_id", "partner_id")
    return out.select(
        "part", "row_id", "partner_id",
        tx.snippet(F.col("left_text"), 140).alias("left_text"),
        tx.snippet(F.col("right_text"), 140).alias("right_text"),
    )
