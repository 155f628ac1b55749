"""Sources, projections, filters, profiles and keys on review-shaped rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bins, mentions, text as tx
from ..operators import cleaning, groups, profile, terms
from ..plans.materialize import cut, stored
from ..sources import tables, tskv
from .inputs import (
    CLEANED, NORMALISED, NW, REVIEWS, W, WS, fold, norm_key, norm_text, reviews, sq,
    table, texts, words,
)
from .registry import query


def normalised(spark, sf):
    return reviews(spark, sf).withColumn("text", tx.normalize_text(F.col("text")))


def named(spark, sf):
    """Normalised reviews with a name and a rating in range, plus their keys."""
    rows = normalised(spark, sf).where(
        ~tx.is_blank(F.col("name_ru")) & cleaning.in_range(F.col("rating"))
    )
    return groups.with_group_keys(rows)


# ------------------------------------------------------------------ sources
# Known fields are written around each value, one field is left out of some records
# and one value carries a TAB, so the parse has something to get right.
_LINE = """concat('tskv', chr(9), 'address=', lang, chr(9), 'name_ru=', source, chr(9), 'note=', 'a=b',
 CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat(chr(9), 'rubrics=', lang, ';', source) END,
 chr(9), 'rating=', CASE WHEN doc_id % 11 = 0 THEN 'n/a' ELSE CAST(n_chars % 6 AS VARCHAR(9)) END,
 chr(9), 'text=', replace(text, chr(10), ' '), CASE WHEN doc_id % 13 = 0 THEN chr(13) ELSE '' END)"""


def _lines(spark, sf):
    lines = table(spark, sf, "documents").selectExpr("doc_id AS row_id", f"{_LINE} AS line")
    line = F.regexp_replace("line", r"[\r\n]+\z", "")
    return lines.select("row_id", *[tskv.field(line, f).alias(f) for f in tskv.FIELDS])


_FIELDS_SQL = """SELECT doc_id AS row_id, lang AS address, source || chr(9) || 'note=a=b' AS name_ru,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang || ';' || source END AS rubrics,
 CASE WHEN doc_id % 11 = 0 THEN 'n/a' ELSE CAST(n_chars % 6 AS VARCHAR) END AS rating,
 regexp_replace(replace(text, chr(10), ' '), '[\\r\\n]+\\z', '') AS text FROM documents"""

query("S1_tskv_fields", _FIELDS_SQL)(_lines)


@query("S2_incomplete_records",
       f"SELECT count(*) AS records, count(*) FILTER (rubrics IS NULL) AS incomplete FROM ({_FIELDS_SQL})")
def _(spark, sf):
    return tskv.missing_fields(_lines(spark, sf))


@query("S3_numeric_coercion", f"""SELECT r.row_id, TRY_CAST(rating AS DOUBLE) AS rating, b.bad_values
 FROM ({_FIELDS_SQL}) r, (SELECT count(*) FILTER (TRY_CAST(rating AS DOUBLE) IS NULL AND rating IS NOT NULL)
 AS bad_values FROM ({_FIELDS_SQL})) b""")
def _(spark, sf):
    rows = _lines(spark, sf)
    bad = tskv.bad_number_count(rows).scalar()
    return tskv.coerce_rating(rows).select("row_id", "rating", bad.alias("bad_values"))


@query("S4_pruned_scan", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def _(spark, sf):
    return tables.read_table(spark, f"{sf}/documents.parquet", ["doc_id", "lang"]).where(F.col("lang") == "en")


# -------------------------------------------------------------- projections
@query("P1_normalize_text", f"WITH raw AS ({REVIEWS}) SELECT row_id, {norm_text('text')} AS text FROM raw")
def _(spark, sf):
    return normalised(spark, sf).select("row_id", "text")


@query("P2_P3_P4_entity_keys", f"""WITH raw AS ({REVIEWS}) SELECT row_id, {norm_key('name_ru')} AS gk_name,
 {norm_key('name_ru')} || ' | ' || {norm_key('address')} AS gk_name_addr,
 {norm_key('name_ru')} || ' | ' || {norm_key('address')} AS group_key FROM raw""")
def _(spark, sf):
    return groups.with_group_keys(reviews(spark, sf), "name_addr").select(
        "row_id", "gk_name", "gk_name_addr", "group_key"
    )


@query("P5_P6_lengths_and_bins", f"""WITH raw AS ({REVIEWS}), n AS (SELECT row_id, {norm_text('text')} AS t FROM raw)
 SELECT row_id, length(t) AS chars, {words('t')} AS words, CASE WHEN length(t) < 50 THEN '<50'
 WHEN length(t) < 100 THEN '50-99' WHEN length(t) < 200 THEN '100-199' WHEN length(t) < 400 THEN '200-399'
 WHEN length(t) < 800 THEN '400-799' ELSE '800+' END AS len_bin FROM n""")
def _(spark, sf):
    rows = normalised(spark, sf).select(
        "row_id", F.length("text").cast("bigint").alias("chars"),
        tx.word_count(F.col("text"), squeezed=True).cast("bigint").alias("words"),
    )
    return rows.withColumn("len_bin", bins.length_bin(F.col("chars")))


@query("P7_P8_P9_list_parts", f"""WITH raw AS ({REVIEWS}) SELECT row_id, split_part(rubrics, ';', 1) AS first_rubric,
 coalesce(nullif({sq("split_part(coalesce(rubrics, ''), ';', 1)")}, ''), 'без рубрики') AS rubric_main,
 len(string_split(rubrics, ';')) AS n_rubrics, split_part(address, ',', 1) AS place FROM raw""")
def _(spark, sf):
    return reviews(spark, sf).select(
        "row_id", tx.first_item(F.col("rubrics")).alias("first_rubric"),
        tx.first_item_or(F.col("rubrics"), "без рубрики").alias("rubric_main"),
        tx.item_count(F.col("rubrics")).cast("bigint").alias("n_rubrics"),
        tx.first_item(F.col("address"), ",").alias("place"),
    )


_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"
_EMOJI_WIDE = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2764}\x{FE0F}]"


@query("P10_F7_F8_text_flags", f"""WITH raw AS ({REVIEWS}) SELECT row_id,
 CASE WHEN regexp_matches(coalesce(text, ''), '{_EMOJI_WIDE}') THEN 'да' ELSE 'нет' END AS has_emoji_wide,
 regexp_matches(coalesce(text, ''), '{_EMOJI}') AS has_emoji,
 regexp_matches(coalesce(text, ''), 'https?://|www\\.') AS has_url,
 NOT regexp_matches(coalesce(text, ''), '[а-яА-ЯёЁ]') AS no_cyrillic,
 contains(coalesce(text, ''), chr(92) || 'n') AS literal_newline,
 contains(coalesce(text, ''), chr(10)) AS real_newline FROM raw""")
def _(spark, sf):
    t = F.coalesce(F.col("text"), F.lit(""))
    return reviews(spark, sf).select(
        "row_id", F.when(tx.has_emoji(t, wide=True), "да").otherwise("нет").alias("has_emoji_wide"),
        tx.has_emoji(t).alias("has_emoji"), tx.has_url(t).alias("has_url"),
        tx.no_cyrillic(t).alias("no_cyrillic"), F.contains(t, F.lit("\\n")).alias("literal_newline"),
        F.contains(t, F.lit("\n")).alias("real_newline"),
    )


@query("P13_top_categories", f"""WITH raw AS ({REVIEWS}), r AS (SELECT row_id,
 coalesce(nullif({sq("split_part(coalesce(rubrics, ''), ';', 1)")}, ''), 'без рубрики') AS rubric_main FROM raw),
 top AS (SELECT rubric_main FROM r GROUP BY 1 ORDER BY count(*) DESC, rubric_main LIMIT 5)
 SELECT row_id, rubric_main, CASE WHEN rubric_main IN (SELECT rubric_main FROM top) THEN rubric_main ELSE 'прочие' END
 AS rubric_slice FROM r""")
def _(spark, sf):
    rows = reviews(spark, sf).select(
        "row_id", tx.first_item_or(F.col("rubrics"), "без рубрики").alias("rubric_main")
    )
    return groups.keep_top_categories(rows, "rubric_main", 5, "прочие", "rubric_slice")


@query("P14_P15_snippets", f"""WITH raw AS ({REVIEWS}), n AS (SELECT row_id, coalesce(text, '') AS t FROM raw),
 f AS (SELECT *, replace(replace(t, '|', '/'), chr(10), ' ') AS a, {sq("replace(t, '|', '/')")} AS b FROM n)
 SELECT row_id, substr(a, 1, 160) || CASE WHEN length(a) > 160 THEN '…' ELSE '' END AS short,
 substr(b, 1, 350) || CASE WHEN length(b) > 350 THEN '…' ELSE '' END AS squeezed,
 length(substr(t, 1, 20000)) AS cut_chars FROM f""")
def _(spark, sf):
    t = F.coalesce(F.col("text"), F.lit(""))
    return reviews(spark, sf).select(
        "row_id", tx.snippet(t, 160).alias("short"), tx.squeezed_snippet(t).alias("squeezed"),
        F.length(tx.truncate(t)).cast("bigint").alias("cut_chars"),
    )


@query("P19_clipped_histogram", f"""WITH raw AS ({REVIEWS}), n AS (SELECT CAST(length({norm_text('text')}) AS DOUBLE) AS v FROM raw),
 q AS (SELECT quantile_cont(v, 0.99) AS hi, min(v) AS lo FROM n),
 b AS (SELECT least(CAST(floor((least(v, hi) - lo) / ((hi - lo) / 60.0)) AS INT), 59) AS bin FROM n, q)
 SELECT bin, count(*) AS n FROM b GROUP BY 1""")
def _(spark, sf):
    rows = normalised(spark, sf).select(F.length("text").alias("chars"))
    return profile.clipped_histogram(rows, "chars")


@query("P19_group_size_histogram", f"""WITH {NORMALISED}, s AS (SELECT log10(count(*)) AS x FROM named GROUP BY gk_name),
 q AS (SELECT min(x) AS lo, max(x) AS hi FROM s)
 SELECT least(coalesce(CAST(floor((x - lo) / ((hi - lo) / 60.0)) AS INT), 0), 59) AS bin, count(*) AS n FROM s, q GROUP BY 1""")
def _(spark, sf):
    return groups.log_size_histogram(named(spark, sf), "gk_name")


# ------------------------------------------------------------------ filters
_STEPS_SQL = f"""WITH {CLEANED} SELECT 1 AS step_no, 'rating_out_of_range' AS step, (SELECT count(*) FROM norm) - (SELECT count(*) FROM s1) AS removed
 UNION ALL SELECT 2, 'no_name', (SELECT count(*) FROM s1) - (SELECT count(*) FROM s2)
 UNION ALL SELECT 3, 'too_short', (SELECT count(*) FROM s2) - (SELECT count(*) FROM s3)
 UNION ALL SELECT 4, 'conflicting_copies', (SELECT count(*) FROM s3) - (SELECT count(*) FROM s4)
 UNION ALL SELECT 5, 'repeated_copy', (SELECT count(*) FROM s4) - (SELECT count(*) FROM s5)"""


@query("F6_filter_chain_steps", _STEPS_SQL)
def _(spark, sf):
    return cleaning.filter_steps(reviews(spark, sf))


@query("F6_clean_table", f"""WITH {CLEANED} SELECT row_id, text, rating, name_ru, address, rubrics,
 gk_name, gk_name_addr, gk_name AS group_key FROM clean""")
def _(spark, sf):
    return cleaning.clean_table(reviews(spark, sf))


@query("F1_F2_F3_row_filters", f"WITH {CLEANED} SELECT row_id, text, rating FROM s3")
def _(spark, sf):
    rows = normalised(spark, sf)
    return rows.where(
        cleaning.in_range(F.col("rating"))
        & ~tx.is_blank(F.col("name_ru"))
        & cleaning.enough_words(F.col("text"), 1)
    ).select("row_id", "text", "rating")


@query("F4_conflict_filter", f"""WITH {NORMALISED}, k AS (SELECT *, {fold('text')} AS k FROM named)
 SELECT row_id, rating FROM k WHERE k NOT IN (SELECT k FROM k GROUP BY k HAVING count(DISTINCT rating) > 1)""")
def _(spark, sf):
    return cleaning.drop_conflicts(named(spark, sf)).select("row_id", "rating")


@query("F5_keep_first_copy", f"""WITH {NORMALISED}, k AS (SELECT row_id, row_number() OVER (PARTITION BY {fold('text')}
 ORDER BY row_id) AS rn FROM named) SELECT row_id FROM k WHERE rn = 1""")
def _(spark, sf):
    return cleaning.keep_first_copy(named(spark, sf)).select("row_id")


@query("W2_W3_copy_marks", f"""WITH {NORMALISED}, k AS (SELECT row_id, rating, {fold('text')} AS k FROM named)
 SELECT row_id, count(*) OVER w AS copies, row_id = min(row_id) OVER w AS is_first,
 min(rating) OVER w < max(rating) OVER w AS conflict FROM k WINDOW w AS (PARTITION BY k)""")
def _(spark, sf):
    return cleaning.mark_copies(named(spark, sf)).select("row_id", "copies", "is_first", "conflict")


@query("F9_J4_key_membership", f"""WITH {NORMALISED}, big AS (SELECT gk_name FROM named GROUP BY 1 HAVING count(*) >= 4)
 SELECT row_id, gk_name IN (SELECT gk_name FROM big) AS in_big FROM named""")
def _(spark, sf):
    rows = named(spark, sf)
    big = rows.groupBy("gk_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 4)
    inside = cleaning.members(rows, big, ["gk_name"]).select("row_id", F.lit(True).alias("in_big"))
    outside = cleaning.members(rows, big, ["gk_name"], keep=False).select(
        "row_id", F.lit(False).alias("in_big")
    )
    return inside.unionByName(outside)


@query("F11_A14_category_stats", f"""WITH {NORMALISED}, c AS (SELECT rating, split_part(rubrics, ';', 1) AS rubric FROM named WHERE rubrics IS NOT NULL)
 SELECT rubric, count(*) AS n, avg(rating) AS mean_rating, avg(CASE WHEN rating = 1 THEN 1.0 ELSE 0.0 END) AS share_1
 FROM c GROUP BY 1 HAVING count(*) >= 20""")
def _(spark, sf):
    rows = named(spark, sf).withColumn("rubric", tx.first_item(F.col("rubrics")))
    return groups.category_stats(rows, "rubric", "rating", min_n=20)


@query("F12_request_validation", f"""WITH raw AS ({REVIEWS}) SELECT row_id, CASE WHEN text IS NULL THEN 'missing'
 WHEN length(text) < 1 THEN 'empty' WHEN length(text) > 20000 THEN 'too_long' WHEN {sq('text')} = '' THEN 'blank' END AS reason FROM raw""")
def _(spark, sf):
    return cleaning.validate_requests(reviews(spark, sf)).select("row_id", "reason")


@query("F12_batch_validation", f"""SELECT conv_id, count(*) AS n, count(*) FILTER (length(text) < 1 OR text IS NULL OR length(text) > 20000
 OR {sq('text')} = '') AS rejected, count(*) BETWEEN 1 AND 3 AND count(*) FILTER (length(text) < 1 OR text IS NULL
 OR length(text) > 20000 OR {sq('text')} = '') = 0 AS accepted FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    return cleaning.validate_batches(table(spark, sf, "conversations"), "conv_id", max_batch=3)


# ----------------------------------------------------------------- profiles
@query("A1_column_profile", f"WITH raw AS ({REVIEWS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS nulls, "
    + (f"count(*) FILTER ({c} IS NOT NULL AND {sq(c)} = '')" if t == "string" else "CAST(0 AS BIGINT)")
    + " AS blank FROM raw"
    for c, t in (("row_id", "bigint"), ("text", "string"), ("rating", "double"),
                 ("name_ru", "string"), ("address", "string"), ("rubrics", "string"))))
def _(spark, sf):
    return profile.column_profile(reviews(spark, sf))


@query("A2_value_counts", f"""WITH raw AS ({REVIEWS}) SELECT rating, count(*) AS n,
 count(*) / CAST((SELECT count(*) FROM raw) AS DOUBLE) AS share FROM raw GROUP BY rating""")
def _(spark, sf):
    return profile.value_counts(reviews(spark, sf), "rating", keep_null=True)


def _quantiles_sql(v: str) -> str:
    probs = (("min", 0.0), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p99_9", 0.999), ("max", 1.0))
    return ", ".join(f"round(quantile_cont(CAST({v} AS DOUBLE), {p}), 6) AS {k}" for k, p in probs)


def _rounded(df, *columns):
    """Interpolation differs in the last bits between engines: compare six digits."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


@query("A3_length_quantiles", f"""WITH raw AS ({REVIEWS}), n AS (SELECT {norm_text('text')} AS t FROM raw)
 SELECT 'chars' AS measure, {_quantiles_sql('length(t)')} FROM n
 UNION ALL SELECT 'words', {_quantiles_sql(words('t'))} FROM n""")
def _(spark, sf):
    t = F.col("text")
    out = profile.quantile_profile(
        normalised(spark, sf), {"chars": F.length(t), "words": tx.word_count(t, squeezed=True)}
    )
    return _rounded(out, *profile.QUANTILES)


@query("A3_length_quantiles_approximate")
def _(spark, sf):
    t = F.col("text")
    return profile.approximate_quantile_profile(
        normalised(spark, sf), {"chars": F.length(t), "words": tx.word_count(t, squeezed=True)}
    )


@query("A3_approximate_ranks", "SELECT measure, true AS within FROM (VALUES ('chars'), ('words')) v(measure)")
def _(spark, sf):
    """Every approximate quantile has a rank within 1/1000 of the wanted one, counted exactly."""
    t = F.col("text")
    rows = normalised(spark, sf).select(F.length(t).alias("chars"), tx.word_count(t, squeezed=True).alias("words"))
    long = cut(rows.select(F.expr("inline(array(struct('chars' AS measure, chars AS v), struct('words' AS measure, words AS v)))")).where("v is not null"))
    table_ = profile.approximate_quantile_profile(rows, {m: F.col(m) for m in ("chars", "words")})
    probs = profile.QUANTILES
    shares = long.join(F.broadcast(table_), "measure").groupBy("measure").agg(
        *[F.avg((F.col("v") < F.col(k)).cast("double")).alias(f"lo_{k}") for k in probs],
        *[F.avg((F.col("v") <= F.col(k)).cast("double")).alias(f"hi_{k}") for k in probs])
    ok = [(F.col(f"lo_{k}") <= p + 0.001) & (F.col(f"hi_{k}") >= p - 0.001) for k, p in probs.items()]
    return shares.select("measure", F.array_min(F.array(*ok)).alias("within"))


@query("A4_length_by_group", f"""WITH raw AS ({REVIEWS}), n AS (SELECT split_part(address, ',', 1) AS place, {norm_text('text')} AS t FROM raw),
 w AS (SELECT place, {words('t')} AS words FROM n)
 SELECT place, round(avg(words), 6) AS mean, round(quantile_cont(words, 0.5), 6) AS p50, round(quantile_cont(words, 0.9), 6) AS p90,
 round(quantile_cont(words, 0.99), 6) AS p99, CAST(max(words) AS DOUBLE) AS max FROM w GROUP BY 1""")
def _(spark, sf):
    rows = normalised(spark, sf).select(
        tx.first_item(F.col("address"), ",").alias("place"), tx.word_count(F.col("text"), squeezed=True).alias("words")
    )
    return _rounded(profile.length_by_group(rows, "words", "place"), "mean", "p50", "p90", "p99")


_TOKENS = rf"len(regexp_extract_all(t, '{W}+|[^\p{{L}}\p{{N}}_\s]'))"


@query("A5_threshold_shares", f"WITH raw AS ({REVIEWS}), n AS (SELECT {norm_text('text')} AS t FROM raw), "
       f"m AS (SELECT {words('t')} AS w, {_TOKENS} AS k FROM n) " + " UNION ALL ".join(
    [f"SELECT 'lt_{k}' AS threshold, count(*) FILTER (w < {k}) AS n, count(*) FILTER (w < {k}) / CAST(count(*) AS DOUBLE) AS share FROM m" for k in (2, 3, 5, 10)]
    + [f"SELECT 'gt_{k}', count(*) FILTER (k > {k}), count(*) FILTER (k > {k}) / CAST(count(*) AS DOUBLE) FROM m" for k in (64, 128, 256, 512)]))
def _(spark, sf):
    rows = normalised(spark, sf).select(
        tx.word_count(F.col("text"), squeezed=True).alias("words"), terms.token_count(F.col("text")).alias("tokens")
    )
    return profile.threshold_shares(rows, F.col("words"), F.col("tokens"))


@query("A6_noise_rates", f"""WITH raw AS ({REVIEWS}), n AS (SELECT text AS raw_text, {norm_text('text')} AS t FROM raw)
 SELECT count(*) FILTER (regexp_matches(t, '{_EMOJI}')) AS emoji, count(*) FILTER (regexp_matches(t, 'https?://|www\\.')) AS url,
 count(*) FILTER (NOT regexp_matches(t, '[а-яА-ЯёЁ]')) AS no_cyrillic,
 count(*) FILTER (contains(raw_text, chr(92) || 'n')) AS literal_newline,
 count(*) FILTER (contains(raw_text, chr(10))) AS real_newline FROM n""")
def _(spark, sf):
    return profile.noise_rates(reviews(spark, sf))


@query("A7_style_by_class", f"""WITH {NORMALISED}, f AS (SELECT rating, text AS t,
 len(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё]')) AS letters, len(regexp_extract_all(text, '[A-ZА-ЯЁ]')) AS caps FROM named)
 SELECT rating, avg(CAST(regexp_matches(t, '{_EMOJI}') AS INT)) AS has_emoji, avg(CAST(regexp_matches(t, 'https?://|www\\.') AS INT)) AS has_url,
 avg(1 - CAST(regexp_matches(t, '[а-яА-ЯёЁ]') AS INT)) AS no_cyr, avg(len(regexp_extract_all(t, '!'))) AS excl,
 round(avg(caps / CAST(nullif(letters, 0) AS DOUBLE)), 6) AS caps_share FROM f GROUP BY rating""")
def _(spark, sf):
    return _rounded(profile.style_by_class(named(spark, sf)), "caps_share")


@query("A8_length_by_class", f"""WITH {NORMALISED} SELECT rating, avg(length(text)) AS mean,
 quantile_cont(CAST(length(text) AS DOUBLE), 0.5) AS median FROM named GROUP BY rating""")
def _(spark, sf):
    rows = named(spark, sf).select("rating", F.length("text").alias("chars"))
    return profile.length_by_class(rows, "chars", "rating")


@query("A9_duplicate_profile", f"""WITH {NORMALISED}, k AS (SELECT {fold('text')} AS k, count(*) AS n, count(DISTINCT rating) AS nr,
 count(DISTINCT name_ru) AS nn FROM norm WHERE text <> '' GROUP BY 1)
 SELECT 'extra_copies' AS metric, CAST(sum(n - 1) AS BIGINT) AS value FROM k
 UNION ALL SELECT 'rows_in_groups', CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM k
 UNION ALL SELECT 'groups', count(*) FILTER (n > 1) FROM k
 UNION ALL SELECT 'conflicting_groups', count(*) FILTER (nr > 1) FROM k
 UNION ALL SELECT 'cross_entity_groups', count(*) FILTER (nn > 1) FROM k
 UNION ALL SELECT 'full_row_copies', (SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT name_ru, address, rating, text FROM norm)) AS BIGINT) FROM norm)""")
def _(spark, sf):
    return profile.duplicate_profile(normalised(spark, sf))


@query("A10_T1_T3_top_groups", f"""WITH {NORMALISED} SELECT gk_name, count(*) AS reviews, count(DISTINCT addr_key) AS places
 FROM named GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return groups.top_groups(named(spark, sf), "gk_name", "addr_key")


@query("A10_top_first_rubrics", f"""WITH {NORMALISED} SELECT split_part(rubrics, ';', 1) AS rubric, count(*) AS n FROM named
 WHERE rubrics IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    rows = named(spark, sf).select(tx.first_item(F.col("rubrics")).alias("rubric"))
    return groups.top_categories(rows, "rubric", 10)


@query("A11_group_concentration", f"""WITH {NORMALISED}, s AS (SELECT count(*) AS size FROM named GROUP BY gk_name)
 SELECT count(*) AS groups, quantile_cont(size, 0.5) AS size_median, quantile_cont(size, 0.9) AS size_p90,
 quantile_cont(size, 0.99) AS size_p99, max(size) AS size_max, max(size) / CAST(sum(size) AS DOUBLE) AS largest_share,
 (SELECT CAST(sum(size) AS DOUBLE) FROM (SELECT size FROM s ORDER BY size DESC LIMIT 10)) / CAST(sum(size) AS DOUBLE) AS top10_share FROM s""")
def _(spark, sf):
    return groups.group_stats(named(spark, sf), "gk_name")


@query("W6_cumulative_top_share", f"""WITH {NORMALISED}, s AS (SELECT count(*) AS size, row_number() OVER (ORDER BY count(*) DESC) AS r FROM named GROUP BY gk_name)
 SELECT k, (SELECT CAST(sum(size) AS DOUBLE) FROM s WHERE r <= k) / (SELECT CAST(sum(size) AS DOUBLE) FROM s) AS share
 FROM (VALUES (1), (10), (100)) AS t(k)""")
def _(spark, sf):
    return groups.top_shares(named(spark, sf), "gk_name")


@query("A11_group_size_profile", f"""WITH {NORMALISED}, s AS (SELECT count(*) AS size FROM named GROUP BY gk_name)
 SELECT count(*) AS groups, quantile_cont(size, 0.5) AS p50, quantile_cont(size, 0.9) AS p90, quantile_cont(size, 0.99) AS p99,
 CAST(max(size) AS DOUBLE) AS max FROM s""")
def _(spark, sf):
    return groups.size_profile(named(spark, sf), "gk_name")


@query("A12_chain_summary", f"""WITH {NORMALISED}, c AS (SELECT count(*) AS n, count(DISTINCT addr_key) > 1 AS chain FROM named GROUP BY gk_name)
 SELECT count(*) AS names, count(*) FILTER (chain) AS chains, CAST(sum(n) FILTER (chain) AS BIGINT) AS chain_rows,
 CAST(sum(n) FILTER (chain) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS chain_share FROM c""")
def _(spark, sf):
    return groups.chain_summary(named(spark, sf), "gk_name", "addr_key")


@query("A12_chain_suppliers", """WITH c AS (SELECT count(*) AS n, count(DISTINCT l_partkey) > 1 AS chain FROM lineitem GROUP BY l_suppkey)
 SELECT count(*) AS names, count(*) FILTER (chain) AS chains, CAST(sum(n) FILTER (chain) AS BIGINT) AS chain_rows,
 CAST(sum(n) FILTER (chain) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS chain_share FROM c""")
def _(spark, sf):
    return groups.chain_summary(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("A12_chain_rows", f"""WITH {NORMALISED}, c AS (SELECT gk_name, count(DISTINCT addr_key) > 1 AS is_chain FROM named GROUP BY 1)
 SELECT row_id, is_chain FROM named JOIN c USING (gk_name)""")
def _(spark, sf):
    return groups.chain_rows(named(spark, sf), "gk_name", "addr_key").select("row_id", "is_chain")


@query("A13_distinct_counts", f"""WITH {NORMALISED} SELECT count(DISTINCT gk_name) AS gk_name, count(DISTINCT addr_key) AS addr_key,
 count(DISTINCT rubrics) AS rubrics FROM named""")
def _(spark, sf):
    return groups.distinct_counts(named(spark, sf), ["gk_name", "addr_key", "rubrics"])


@query("A13_A3_merged_sketches", f"""WITH {NORMALISED}, p AS (SELECT gk_name, addr_key, length(text) AS chars, CASE WHEN row_id % 2 = 0 THEN 0 ELSE 1 END AS half FROM named)
 SELECT half, count(*) AS rows, count(DISTINCT gk_name) AS exact_names, true AS names_within, true AS addresses_within, true AS median_within, true AS p95_within FROM p GROUP BY half""")
def _(spark, sf):
    """Sketches stored for eight parts and merged into two halves, against exact figures:
    four standard errors of the distinct numbers, 1.5 % of the ranks of the quantiles."""
    rows = named(spark, sf).select("row_id", "gk_name", "addr_key", F.length("text").alias("chars")).withColumn(
        "part", F.pmod("row_id", F.lit(8))).withColumn("half", F.pmod("row_id", F.lit(2)).cast("int"))
    sketches = stored(groups.part_sketches(rows, ["part", "half"], {"names": F.col("gk_name"), "addresses": F.col("addr_key")}, {"chars": F.col("chars")}))
    merged = groups.merged_sketches(sketches, ["half"], ["names", "addresses"], ["chars"], {"p50": 0.5, "p95": 0.95})
    exact = rows.groupBy("half").agg(F.countDistinct("gk_name").alias("exact_names"), F.countDistinct("addr_key").alias("exact_addresses"))
    ranks = rows.join(merged.select("half", "chars_p50", "chars_p95"), "half").groupBy("half").agg(
        *[(F.count_if(F.col("chars") < F.col(f"chars_{q}")) / F.count(F.lit(1))).alias(f"under_{q}") for q in ("p50", "p95")],
        *[(F.count_if(F.col("chars") <= F.col(f"chars_{q}")) / F.count(F.lit(1))).alias(f"upto_{q}") for q in ("p50", "p95")])
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), 0.035 * F.col(b))
    within = lambda q, p: F.lit(p).between(F.col(f"under_{q}") - 0.015, F.col(f"upto_{q}") + 0.015)
    return merged.join(exact, "half").join(ranks, "half").select(
        "half", "rows", "exact_names", near("names", "exact_names").alias("names_within"), near("addresses", "exact_addresses").alias("addresses_within"),
        within("p50", 0.5).alias("median_within"), within("p95", 0.95).alias("p95_within"))


@query("A15_between_group_variance", """WITH r AS (SELECT l_suppkey AS g, l_quantity AS v FROM lineitem),
 b AS (SELECT g, v, avg(v) OVER (PARTITION BY g) AS m, count(*) OVER (PARTITION BY g) AS n FROM r)
 SELECT count(*) AS rows, count(DISTINCT g) AS groups, round(var_samp(m) / var_samp(v), 6) AS between_share FROM b WHERE n >= 30""")
def _(spark, sf):
    out = groups.between_variance(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity")
    return out.withColumn("between_share", F.round("between_share", 6))


@query("W1_group_mean", f"""WITH {NORMALISED} SELECT row_id, count(*) OVER (PARTITION BY gk_name) AS group_size,
 avg(rating) OVER (PARTITION BY gk_name) AS group_mean FROM named""")
def _(spark, sf):
    return groups.with_group_mean(named(spark, sf), "gk_name", "rating", ["row_id"]).select(
        "row_id", "group_size", "group_mean"
    )


@query("A15_group_mean_histogram", f"""WITH {NORMALISED}, m AS (SELECT avg(rating) AS m FROM named GROUP BY gk_name HAVING count(*) >= 3),
 q AS (SELECT min(m) AS lo, max(m) AS hi FROM m)
 SELECT least(coalesce(CAST(floor((m - lo) / ((hi - lo) / 60.0)) AS INT), 0), 59) AS bin, count(*) AS n FROM m, q GROUP BY 1""")
def _(spark, sf):
    return groups.group_mean_histogram(named(spark, sf), "gk_name", "rating", min_n=3)


@query("A16_class_floor", f"""WITH raw AS ({REVIEWS}), v AS (SELECT * FROM raw WHERE rating BETWEEN 1 AND 5),
 p AS (SELECT count(*) AS n, avg(CASE WHEN rating = 5 THEN 1.0 ELSE 0.0 END) AS accuracy FROM v)
 SELECT n, accuracy, 2 * accuracy / (1 + accuracy) / 5 AS macro_f1 FROM p""")
def _(spark, sf):
    return profile.class_floor(reviews(spark, sf))


@query("A17_A24_crosstab_with_total", f"""WITH {NORMALISED} SELECT split_part(address, ',', 1) AS place,
 {', '.join(f'count(*) FILTER (rating = {k}) AS r{k}' for k in range(1, 6))} FROM named GROUP BY ROLLUP (split_part(address, ',', 1))""")
def _(spark, sf):
    rows = named(spark, sf).withColumn("place", tx.first_item(F.col("address"), ","))
    return profile.crosstab(rows, "place", "rating", [1, 2, 3, 4, 5], prefix="r", total=True)


@query("A17_row_shares", f"""WITH {NORMALISED} SELECT split_part(address, ',', 1) AS place,
 {', '.join(f'count(*) FILTER (rating = {k}) / CAST(count(*) AS DOUBLE) AS r{k}' for k in range(1, 6))} FROM named GROUP BY 1""")
def _(spark, sf):
    rows = named(spark, sf).withColumn("place", tx.first_item(F.col("address"), ","))
    return profile.crosstab(rows, "place", "rating", [1, 2, 3, 4, 5], prefix="r", shares=True)


@query("A23_escape_counts", f"""WITH raw AS ({REVIEWS}) SELECT regexp_extract(text, '(\\\\.)', 1) AS escape, count(*) AS n FROM raw
 WHERE regexp_extract(text, '(\\\\.)', 1) <> '' GROUP BY 1""")
def _(spark, sf):
    return profile.escape_counts(reviews(spark, sf))


@query("T2_longest_texts", f"WITH raw AS ({REVIEWS}) SELECT row_id, length(text) AS chars FROM raw WHERE text IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, sf):
    return profile.longest_texts(reviews(spark, sf)).withColumn("chars", F.col("chars").cast("bigint"))


# ----------------------------------------------------------------- mentions
_EX = "regexp_extract(low, '{}', {})"
_DIGIT = rf"(?:^|[^\p{{Nd}}])([1-5]){WS}*(?:-{WS}*)?(?:зв[её]зд|балл|из{WS}*5|/{WS}*5|из{WS}*пяти)"
_VERB = rf"(?:оценк{W}*|ставлю|поставил{W}*|поставлю|дам|даю){WS}*[:\-–]?{WS}*([1-5])(?:[^\p{{Nd}}]|\z)"
_WORDP = rf"(?:^|{NW})(одну|одна|две|три|четыре|пять){WS}+зв[её]зд"
_PRIORITISED = f"""coalesce(TRY_CAST(nullif({_EX.format(_DIGIT, 1)}, '') AS INT), TRY_CAST(nullif({_EX.format(_VERB, 1)}, '') AS INT),
 CASE {_EX.format(_WORDP, 1)} WHEN 'одну' THEN 1 WHEN 'одна' THEN 1 WHEN 'две' THEN 2 WHEN 'три' THEN 3
 WHEN 'четыре' THEN 4 WHEN 'пять' THEN 5 END)"""


@query("N1_prioritised_mention", f"""WITH {NORMALISED}, l AS (SELECT row_id, lower(text) AS low FROM named)
 SELECT row_id, {_PRIORITISED} AS mention FROM l""")
def _(spark, sf):
    return named(spark, sf).select("row_id", mentions.prioritised_mention(F.col("text")).alias("mention"))


def _early_sql() -> str:
    parts = []
    for i, pattern in enumerate(mentions.EARLY_PATTERNS):
        whole, left, value = (f"regexp_extract(low, '{pattern}', {g})" for g in (0, 1, 2))
        if i < 3:
            val = f"TRY_CAST(nullif({value}, '') AS INT)"
        else:
            whens = " ".join(f"WHEN starts_with({value}, '{s}') THEN {v}" for s, v in mentions.STEM_VALUES)
            val = f"CASE {whens} END"
        parts.append(
            f"SELECT row_id, {i} AS no, strpos(low, {whole}) + length({left}) AS pos, {val} AS v "
            f"FROM l WHERE {whole} <> ''"
        )
    return " UNION ALL ".join(parts)


EARLY_SQL = f"""l AS (SELECT row_id, lower(text) AS low FROM named), hits AS ({_early_sql()}),
 best AS (SELECT row_id, arg_min(v, pos * 10 + no) AS v FROM hits GROUP BY row_id)"""


@query("N2_earliest_mention", f"""WITH {NORMALISED}, {EARLY_SQL} SELECT n.row_id, CAST(v AS DOUBLE) AS mention
 FROM named n LEFT JOIN best USING (row_id)""")
def _(spark, sf):
    return named(spark, sf).select("row_id", mentions.earliest_mention(F.col("text")).alias("mention"))


@query("P11_mention_group", f"""WITH {NORMALISED}, {EARLY_SQL} SELECT n.row_id, CASE WHEN v IS NULL THEN 'нет упоминания'
 WHEN v = rating THEN 'совпадает с оценкой' ELSE 'не совпадает с оценкой' END AS mention_group FROM named n LEFT JOIN best USING (row_id)""")
def _(spark, sf):
    rows = named(spark, sf)
    group = mentions.mention_group(mentions.earliest_mention(F.col("text")), F.col("rating"))
    return rows.select("row_id", group.alias("mention_group"))


@query("N8_mention_quality", f"""WITH {NORMALISED}, l AS (SELECT rating, lower(text) AS low FROM named), m AS (SELECT rating, {_PRIORITISED} AS mention FROM l)
 SELECT count(*) AS n, count(mention) AS with_mention, avg(CASE WHEN mention IS NULL THEN NULL WHEN mention = rating THEN 1.0 ELSE 0.0 END) AS agreement FROM m""")
def _(spark, sf):
    return profile.mention_quality(named(spark, sf))


@query("N8_mention_crosstab", f"""WITH {NORMALISED}, l AS (SELECT rating, lower(text) AS low FROM named), m AS (SELECT rating, {_PRIORITISED} AS mention FROM l)
 SELECT rating, {', '.join(f'count(*) FILTER (mention = {k}) AS m{k}' for k in range(1, 6))} FROM m WHERE mention IS NOT NULL GROUP BY rating""")
def _(spark, sf):
    return profile.mention_crosstab(named(spark, sf))


# -------------------------------------------------------------------- terms
_TERMS = rf"""t AS (SELECT quality AS y, unnest(list_distinct(regexp_extract_all(lower(text), '{W[:-1]}]{{2,}}'))) AS term
 FROM documents JOIN labels USING (doc_id)), c AS (SELECT term, count(*) AS df, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b
 FROM t GROUP BY term HAVING count(*) >= 20), n AS (SELECT CAST(count(*) FILTER (quality = 1) AS DOUBLE) AS na, CAST(count(*) FILTER (quality = 0) AS DOUBLE) AS nb
 FROM documents JOIN labels USING (doc_id)), s AS (SELECT term, df, (a + 1) / (na + 2) AS pa, (b + 1) / (nb + 2) AS pb FROM c, n),
 lo AS (SELECT term, df, ln(pa / (1 - pa)) - ln(pb / (1 - pb)) AS log_odds FROM s)"""


def _labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn(
        "row_id", F.col("doc_id")
    )


@query("N6_term_log_odds", f"WITH {_TERMS} SELECT term, df, round(log_odds, 6) AS log_odds FROM lo")
def _(spark, sf):
    scored = terms.term_log_odds(_labelled(spark, sf), "quality", 1, 0, min_df=20)
    return scored.withColumn("log_odds", F.round("log_odds", 6))


@query("N6_distinctive_terms", f"""WITH {_TERMS}, r AS (SELECT term, df, round(log_odds, 9) AS k, log_odds FROM lo)
 SELECT term, df, round(log_odds, 6) AS log_odds, typical_of FROM (SELECT *, 1 AS typical_of FROM r ORDER BY k DESC, term LIMIT 25)
 UNION ALL SELECT term, df, round(log_odds, 6), typical_of FROM (SELECT *, 0 AS typical_of FROM r ORDER BY k, term LIMIT 25)""")
def _(spark, sf):
    out = terms.distinctive_terms(_labelled(spark, sf), "quality", 1, 0, min_df=20, k=25)
    return out.select("term", "df", F.round("log_odds", 6).alias("log_odds"), "typical_of")


@query("N7_token_profile", f"""WITH raw AS ({REVIEWS}), n AS (SELECT {norm_text('text')} AS t FROM raw)
 SELECT {_quantiles_sql(_TOKENS)}, count(*) AS n FROM n WHERE t <> ''""")
def _(spark, sf):
    return _rounded(terms.token_profile(normalised(spark, sf), None, 42), *profile.QUANTILES)


@query("N7_tokenizer_lengths", r"""SELECT doc_id AS row_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z\s]')) AS INTEGER) AS tokens FROM documents""")
def _(spark, sf):
    """The hook for a supplied tokenizer, with a small one that the twin can state."""
    def load():
        import re

        pattern = re.compile(r"[A-Za-z]+|[^A-Za-z\s]", re.ASCII)
        return lambda batch: [len(pattern.findall(t)) for t in batch]

    rows = texts(spark, sf).select(F.col("doc_id").alias("row_id"), "text")
    return terms.tokenizer_lengths(rows, load)
