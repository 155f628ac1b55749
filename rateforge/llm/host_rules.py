"""Quality rules with a host-level verdict, with DataFrame functions only.

Each text is measured once, inside its row.  Rule failures are then counted per host
(the documents' ``source``), each host's failure rates shrunk towards a beta prior that
is fitted to all hosts by moments, and hosts whose shrunk rate is over a limit reject
their documents.  A host of few documents stays near the prior; one of many speaks for
itself.

Defined results: a null text has no words and fails; a null host has no host verdict;
repeated rows count each; extra columns are ignored; with no rows there are no hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rateforge.plans.skew import attach

from .common import WORD_SQL, cut

WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT, MAX_SYMBOLS_PERCENT = 10, 20, 10
#: A host goes when a rule's shrunk failure rate is over this.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight, in documents; the lower one keeps a host of few documents near the mean.
LEAST_WEIGHT, MOST_WEIGHT = 10.0, 1_000_000.0
RULES = ("short", "repeats", "symbols")


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that a text holds twice or more.  Windows are compared by 64-bit
    hashes; only texts in which two are equal sort them with their places."""

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        return F.aggregate(
            F.sequence(F.lit(0), last), F.lit(0),
            lambda total, k: total + F.when(k == last, window).otherwise(
                F.least(F.lit(window), F.get(places, k + 1) - F.get(places, k))))

    def sorted_places(pairs: Column) -> Column:
        same = F.filter(pairs, lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]))
        return _bound(F.sort_array(F.transform(same, lambda p: p["i"])), covered)

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_bound(pairs, sorted_places))

    starts = F.sequence(F.lit(0), F.size(words) - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    return F.when(F.size(words) <= window, 0).otherwise(_bound(hashes, counted))


def measures(text: Column) -> Column:
    """Struct of a text's counts."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD_SQL))
    n_dup = _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return _bound(F.regexp_extract_all(text, F.lit(WORD_SQL), F.lit(0)), lambda words: F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        n_dup.cast("bigint").alias("n_dup_lines"),
        repeated_words(words).cast("bigint").alias("n_repeat_words"),
    ))


def failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": F.col("n_repeat_words") * 100 > n * MAX_REPEATED_PERCENT,
        "symbols": F.col("n_symbols") * 100 > n * MAX_SYMBOLS_PERCENT,
    }


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(source, n_docs, rate_<rule>..., host_ok): shrunk failure rates and the verdict.

    With p and n a host's raw rate and documents and m the mean over all documents, the
    variance between hosts is the n-weighted mean of (p - m)^2 less the part that
    binomial noise explains, m (1 - m) hosts / documents; the prior's weight follows from it."""
    fails = failures()
    hosts = measured.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(fails[r].cast("int")).alias(f"f_{r}") for r in RULES])
    hosts = cut(hosts)
    sums = hosts.agg(
        F.count(F.lit(1)).alias("h"), F.sum("n_docs").alias("n"),
        *[F.sum(f"f_{r}").alias(f"f_{r}") for r in RULES],
        *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n_docs")).alias(f"q_{r}") for r in RULES],
    ).first()
    rates, ok = {}, F.lit(True)
    for r in RULES:
        mean, weight = 0.0, MOST_WEIGHT
        if sums["n"]:
            mean = sums[f"f_{r}"] / sums["n"]
            noise = mean * (1 - mean) * sums["h"] / sums["n"]
            between = sums[f"q_{r}"] / sums["n"] - mean * mean - noise
            if between > 0:
                weight = min(max(mean * (1 - mean) / between - 1, LEAST_WEIGHT), MOST_WEIGHT)
        rates[f"rate_{r}"] = (F.col(f"f_{r}") + mean * weight) / (F.col("n_docs") + weight)
        ok = ok & (rates[f"rate_{r}"] <= limit)
    return hosts.select("source", "n_docs", *[c.alias(k) for k, c in rates.items()], ok.alias("host_ok"))


def judged(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The counts of every document with base_failed, its host's verdict and ``kept``."""
    measured = cut(docs.select("doc_id", "source", measures(F.col("text")).alias("m"))).select("doc_id", "source", "m.*")
    failed = failures()
    rows = measured.withColumn("base_failed", failed["short"] | failed["repeats"])
    joined = attach(rows, host_verdicts(measured, limit), ["source"], ["doc_id"], count_col="n_docs")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True)))


def quality(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               "base_failed", "kept")


def _prior(rule: str) -> str:
    return f"""(SELECT sum(f_{rule}) / sum(n_docs) AS m,
       sum(f_{rule} * f_{rule} / n_docs) / sum(n_docs) - power(sum(f_{rule}) / sum(n_docs), 2)
       - (sum(f_{rule}) / sum(n_docs)) * (1 - sum(f_{rule}) / sum(n_docs)) * count(*) / sum(n_docs) AS v FROM hosts)"""


def _over(rule: str) -> str:
    w = f"(CASE WHEN p_{rule}.v > 0 THEN least(greatest(p_{rule}.m * (1 - p_{rule}.m) / p_{rule}.v - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) ELSE {MOST_WEIGHT} END)"
    return f"(f_{rule} + p_{rule}.m * {w}) / (n_docs + {w}) > {HOST_LIMIT}"


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
places AS (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW}),
win AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM places),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM dup) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines
       WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
d AS (SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN dl ON dl.r = w.r LEFT JOIN rep ON rep.r = w.r),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n_docs,
                 CAST(sum(CASE WHEN n_words < {MIN_WORDS} THEN 1 ELSE 0 END) AS DOUBLE) AS f_short,
                 CAST(sum(CASE WHEN n_repeat_words * 100 > n_words * {MAX_REPEATED_PERCENT} THEN 1 ELSE 0 END) AS DOUBLE) AS f_repeats,
                 CAST(sum(CASE WHEN n_symbols * 100 > n_words * {MAX_SYMBOLS_PERCENT} THEN 1 ELSE 0 END) AS DOUBLE) AS f_symbols
          FROM d WHERE source IS NOT NULL GROUP BY source),
bad AS (SELECT source FROM hosts, {_prior('short')} AS p_short, {_prior('repeats')} AS p_repeats, {_prior('symbols')} AS p_symbols
        WHERE {_over('short')} OR {_over('repeats')} OR {_over('symbols')}),
b AS (SELECT d.*, (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED_PERCENT}) AS base_failed FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND bad.source IS NULL) AS kept
FROM b LEFT JOIN bad ON bad.source = b.source
"""
