"""Row filters, duplicate handling and the audited filter chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..plans.materialize import stored
from ..plans.skew import HOT_ROWS, attach
from .groups import GROUP_KEYS, with_group_keys

STEPS = ("rating_out_of_range", "no_name", "too_short", "conflicting_copies", "repeated_copy")


def in_range(rating: Column, low: float = 1, high: float = 5) -> Column:
    """Range test in which null fails instead of staying unknown."""
    return F.coalesce(rating.between(low, high), F.lit(False))


def enough_words(text: Column, min_words: int) -> Column:
    """Word-count test on squeezed text, reading it once; null counts as no words."""
    if min_words <= 0:
        return F.lit(True)
    pattern = f"^[^ ]+( [^ ]+){{{min_words - 1}}}"
    return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))


def text_key(text: Column) -> Column:
    """Key under which two texts count as copies."""
    return tx.text_digest(tx.casefold(text))


def copy_stats(df: DataFrame, key: Column, label: str = "rating") -> DataFrame:
    """One row per text key: copies, first row and label range.

    All state is fixed-width, so a text held by a third of the rows collapses
    before the shuffle.
    """
    return df.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("row_id").alias("first_id"),
        F.min(label).alias("low"),
        F.max(label).alias("high"),
    )


def mark_copies(df: DataFrame, label: str = "rating", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add per row: copies of its text, whether it is the first, whether labels conflict.

    Rows are stored with their key: statistics and rows both need it, and a text is folded once.
    """
    keyed = stored(df.withColumn("key", text_key(F.col("text"))))
    stats = copy_stats(keyed, F.col("key"), label)
    joined = attach(keyed, stats, ["key"], ["row_id"], hot_rows=hot_rows)
    return joined.select(
        *df.columns,
        F.col("n").alias("copies"),
        (F.col("row_id") == F.col("first_id")).alias("is_first"),
        F.coalesce(F.col("low") < F.col("high"), F.lit(False)).alias("conflict"),
    )


def drop_conflicts(df: DataFrame, label: str = "rating", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Drop every copy of a text whose copies carry more than one label."""
    marked = mark_copies(df, label, hot_rows)
    return marked.where(~F.col("conflict")).select(*df.columns)


def keep_first_copy(df: DataFrame) -> DataFrame:
    """Keep the copy with the lowest ``row_id`` of each text.

    The survivors are matched back by ``row_id``, which is unique, so no join key
    is ever hot.
    """
    first = copy_stats(df, text_key(F.col("text")), "row_id").select(
        F.col("first_id").alias("row_id")
    )
    return df.join(first, "row_id", "left_semi")


def _row_step(min_words: int) -> Column:
    """Number of the first row-level step the record fails, else null."""
    return (
        F.when(~in_range(F.col("rating")), F.lit(1))
        .when(tx.is_blank(F.col("name_ru")), F.lit(2))
        .when(~enough_words(F.col("text"), min_words), F.lit(3))
    )


def _prepared(df: DataFrame, min_words: int) -> DataFrame:
    return df.withColumn("text", tx.normalize_text(F.col("text"))).withColumn(
        "step", _row_step(min_words)
    )


def _keyed_steps(df: DataFrame, min_words: int) -> DataFrame:
    """Per (step, text key): rows, first row and rating range, in one pass over the rows.

    Rows failing a row-level step have no key and collapse to one group per step.  The
    step is read back as an aggregate: a filter on it, unlike one on a grouping column,
    cannot be pushed to the scan, where it would normalise every text a second time.
    """
    rows = _prepared(df, min_words)
    key = F.when(F.col("step").isNull(), text_key(F.col("text")))
    return rows.select("row_id", "rating", "step", key.alias("key")).groupBy("step", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("row_id").alias("first_id"),
        F.min("rating").alias("low"),
        F.max("rating").alias("high"),
        F.max("step").alias("failed"),
    )


def filter_steps(df: DataFrame, min_words: int = 1) -> DataFrame:
    """Rows removed by each step of the chain, in order, counted on what is left."""
    failed, n = F.col("failed"), F.col("n")
    conflict = failed.isNull() & (F.col("low") < F.col("high"))
    repeated = failed.isNull() & (F.col("low") == F.col("high"))
    removed = [F.sum(F.when(failed == i, n)) for i in (1, 2, 3)]
    removed += [F.sum(F.when(conflict, n)), F.sum(F.when(repeated, n - 1))]
    wide = _keyed_steps(df, min_words).agg(
        *[F.coalesce(c, F.lit(0)).alias(f"s{i}") for i, c in enumerate(removed, start=1)]
    )
    rows = [
        F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), F.col(f"s{i}").alias("removed"))
        for i, s in enumerate(STEPS, start=1)
    ]
    return wide.select(F.inline(F.array(*rows)))


def survivors(df: DataFrame, min_words: int = 1) -> DataFrame:
    """Rows that pass all five steps, with the text normalised.

    Only rows passing the row-level steps can be the first copy of a text, so the semi
    join on the unique ``row_id`` applies the whole chain.
    """
    kept = _keyed_steps(df, min_words).where(
        F.col("failed").isNull() & (F.col("low") == F.col("high"))
    )
    rows = df.withColumn("text", tx.normalize_text(F.col("text")))
    return rows.join(kept.select(F.col("first_id").alias("row_id")), "row_id", "left_semi")


def clean_table(df: DataFrame, min_words: int = 1, group_key: str = "name") -> DataFrame:
    """The clean review table: survivors with byte ratings and entity keys."""
    keyed = with_group_keys(survivors(df, min_words), group_key)
    return keyed.select(
        "row_id", "text", F.col("rating").cast("tinyint").alias("rating"),
        "name_ru", "address", "rubrics", *GROUP_KEYS.values(), "group_key",
    )


def members(df: DataFrame, keys: DataFrame, on: list[str], keep: bool = True) -> DataFrame:
    """Rows whose key is (or is not) in a computed key set; the key set is deduplicated
    by the semi join itself."""
    return df.join(keys.select(*on), on, "left_semi" if keep else "left_anti")


def validate_requests(df: DataFrame, max_chars: int | None = tx.MAX_TEXT_CHARS) -> DataFrame:
    """Add ``reason``: null for a scorable text, else why it is rejected.

    ``max_chars`` is the limit of single requests; None sets none.
    """
    t = F.col("text")
    reason = (
        F.when(t.isNull(), "missing")
        .when(F.length(t) < 1, "empty")
        .when(F.lit(False) if max_chars is None else F.length(t) > max_chars, "too_long")
        .when(tx.is_blank(t), "blank")
    )
    return df.withColumn("reason", reason)


def validate_batches(df: DataFrame, batch: str, max_batch: int = 64) -> DataFrame:
    """One row per request batch: size and whether the batch is acceptable."""
    checked = validate_requests(df)
    return checked.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        (
            F.count(F.lit(1)).between(1, max_batch)
            & (F.count_if(F.col("reason").isNotNull()) == 0)
        ).alias("accepted"),
    )
