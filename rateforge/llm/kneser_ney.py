"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

*Training.*  Words of trusted texts (quality label 1) are counted as n-grams of order 3.
The counts are sharded by hash: contexts, continuation counts and discounted
probabilities come from joins and aggregates of the shards.  Lower orders count distinct
left neighbours, except behind the begin mark, which has none.  Each order has three
discounts, from its counts of counts.  All distinct texts of the trusted documents that may train
do.  Up to ``LOCAL_TOKENS`` tokens the finished model is sorted arrays that every task holds;
beyond that it lies in shards (``ngram_shards``).

*Scoring* happens inside the rows, or in the shards.  A text's statistic is its mean negative log10
probability per token, shrunk towards the trusted mean by ``SHRINK`` tokens, so that a
short text needs more than a few unlucky words.

*Thresholds.*  Per language: the ``QUANTILE`` of the statistic over all trusted documents
outside the training sample, exact to 1/1000, plus ``MARGIN``.  Languages with fewer than
``LEAST_DOCS`` of them, and null languages, use the quantile over all.

Defined results: a null or empty text is one end token; rows without a language use the
common threshold; repeated rows give repeated rows; extra columns are kept by ``kept``
and ignored by ``judged``; without trusted texts on both
sides everything is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from . import ngram_shards
from .common import WORD, WORD_SQL, cut, map_arrow, share, stored, workspace

LOCAL_TOKENS = 2_000_000
QUANTILE, MARGIN, SHRINK, LEAST_DOCS = 0.995, 0.1, 30, 100
STEP, SENT_IDS = 1000, 1_000_000
#: Share of the trusted documents that may train; the others only set thresholds.
TRAIN_SHARE = 0.7


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def vocabulary(texts: DataFrame) -> list[str]:
    """The distinct words of the training texts, sorted; their tokens bound them."""

    def listed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 256):
            found = {w for t in batch.column(0).slice(start, 256).to_pylist() for w in words_of(t)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["w"])

    return sorted(map_arrow(texts.select("text"), listed, "w string").distinct().toArrow().column("w").to_pylist())


def trigrams(texts: DataFrame, words: list[str]) -> DataFrame:
    """(u, v, w, c): counts of triples of word numbers (from 1), with two begin marks
    (V + 2) in front of a text and an end (V + 1) behind it."""
    end, begin = len(words) + 1, len(words) + 2
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def listed(batch: pa.RecordBatch, number: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 256):
            parts = [np.array([begin, begin, *map(number.__getitem__, words_of(t)), end], np.int32)
                     for t in batch.column(0).slice(start, 256).to_pylist()]
            triples = [np.concatenate([x[k:len(x) - 2 + k] for x in parts]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in triples], ["u", "v", "w"])

    rows = map_arrow(texts.select("text"), listed, "u int, v int, w int", lambda: {w: i for i, w in enumerate(sent.value, 1)})
    return rows.groupBy("u", "v", "w").agg(F.count(F.lit(1)).alias("c"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of counts one, two, and three or more."""
    of = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    return discounts_of([of.get(k, 0) for k in (1, 2, 3, 4)])


def discounts_of(counts: list[int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = counts
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5  # too little text for counts of counts
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _order(counts: DataFrame, context: list[str], keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Of counts (context..., w, c): (context..., w, p) discounted probabilities and
    (context..., g) the mass left for the lower order, from a join on the context."""
    d = _discounts(counts)
    taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    sums = keep(counts.groupBy(*context).agg(F.sum("c").alias("_t"), F.sum(taken).alias("_g")))
    return (counts.join(sums, context).select(*context, "w", ((F.col("c") - taken) / F.col("_t")).alias("p")),
            sums.select(*context, (F.col("_g") / F.col("_t")).alias("g")))


def _columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table that the training texts bound, as arrays; nulls become nan."""
    table = df.toArrow()
    return [c.to_numpy() for c in table.columns]


class Model:
    """Sorted arrays of the n-grams' probabilities and of the contexts' left-over mass."""

    def __init__(self, words: list[str], uni: np.ndarray, bi: tuple, tri: tuple):
        """``words``: the known ones, numbered from 1; 0 is unknown, then come end and
        begin.  ``uni``: p and g by number.  ``bi``: keys, p, g.  ``tri``: keys, p."""
        self.words, (self.p1, self.g1) = words, uni
        self.bi, self.p2, self.g2 = bi
        self.tri, self.p3 = tri
        self.base = len(words) + 3

    def scorer(self) -> Scorer:
        return Scorer(self)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


class Scorer:
    def __init__(self, model: Model):
        self.m, self.ids = model, {w: i for i, w in enumerate(model.words, 1)}

    def probabilities(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        m = self.m
        p = m.p1[w]
        known, at = _lookup(m.bi, v * m.base + w)
        # The mass a one-word context leaves stands with the word; 1 where it was never one.
        p = np.where(known, m.p2[at], 0.0) + m.g1[v] * p if len(m.bi) else p
        context, at = _lookup(m.bi, u * m.base + v)
        if len(m.bi):
            known, found = _lookup(m.tri, np.where(context, at, -1) * m.base + w)
            left = np.where(context, m.g2[at], 1.0)
            p = np.where(context & known, m.p3[found], 0.0) + left * p
        return p

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (the end counts) and log10 probability of each text."""
        end, begin = self.m.base - 2, self.m.base - 1
        get, parts, sizes = self.ids.get, [], []
        for t in texts:
            words = words_of(t)
            ids = np.empty(len(words) + 3, np.int64)
            ids[:2], ids[-1] = begin, end
            ids[2:-1] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
            parts.append(ids)
            sizes.append(len(words) + 1)
        flat, n = np.concatenate(parts), np.array(sizes)
        starts = np.concatenate(([0], np.cumsum(n + 2)))[:-1]
        places = np.repeat(starts + 2 - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        logs = np.log10(self.probabilities(flat[places - 2], flat[places - 1], flat[places]))
        return n, np.add.reduceat(logs, np.concatenate(([0], np.cumsum(n)[:-1])))


def fit(texts: DataFrame) -> Model | None:
    """Model of the column ``text``; the caller bounds its size.  None without rows.  The
    tables that count joins leave on the way are removed when the arrays are there."""
    with workspace(texts.sparkSession) as keep:
        return _fit(keep(texts), keep)


def _fit(texts: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> Model | None:
    words = vocabulary(texts)
    three = keep(trigrams(texts, words))
    if three.isEmpty():
        return None
    begin, base = len(words) + 2, len(words) + 3
    inner = three.where(F.col("v") != begin).groupBy("v", "w").agg(F.count(F.lit(1)).alias("c"))
    first = three.where(F.col("v") == begin).groupBy("v", "w").agg(F.sum("c").alias("c"))
    two = keep(inner.unionByName(first))
    one = cut(two.groupBy("w").agg(F.count(F.lit(1)).alias("c")))
    p3, g3 = _order(three, ["u", "v"], keep)
    p2, g2 = _order(two, ["v"], keep)
    w, c = _columns(one)
    taken = np.array(_discounts(one))[np.minimum(c, 3) - 1]
    # Numbers 0 to V + 1 can follow, 0 being all unknown words; the begin mark never does.
    p1 = np.full(base, taken.sum() / c.sum() / (base - 1))
    p1[w] += (c - taken) / c.sum()
    g1 = np.ones(base)
    v, g = _columns(g2)
    g1[v] = g
    pairs = p2.join(g3.select(F.col("u").alias("v"), F.col("v").alias("w"), "g"), ["v", "w"], "full")
    v, w, p, g = _columns(pairs.select("v", "w", "p", "g"))
    keys = v.astype(np.int64) * base + w
    order = np.argsort(keys)
    keys2, p2, g2 = keys[order], np.nan_to_num(p[order], nan=0.0), np.nan_to_num(g[order], nan=1.0)
    u, v, w, p = _columns(p3.select("u", "v", "w", "p"))
    keys = np.searchsorted(keys2, u.astype(np.int64) * base + v) * base + w
    order = np.argsort(keys)
    return Model(words, np.stack((p1, g1)), (keys2, p2, g2), (keys[order], p[order]))


def token_count() -> Column:
    """Tokens of ``text``; the end counts."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_SQL)) + 1


def training_ids(trusted: DataFrame) -> DataFrame:
    """Ids of the trusted documents that train: a share picked by a hash."""
    return trusted.where(share(F.col("doc_id"), TRAIN_SHARE, "train"))


def _sendable(ids: DataFrame) -> DataFrame:
    """Few ids go to the rows; beyond that, rows and ids are shuffled."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


class Verdict:
    """Model and thresholds; without a model it lies in shards, or there is none."""

    def __init__(self, model: Model | None, mean: float, common: float, by_language: dict[str, float]):
        self.model, self.mean, self.common, self.by_language = model, mean, common, by_language

    def threshold(self, language: str | None) -> float:
        return self.by_language.get(language, self.common)


def statistic(n: np.ndarray, logs: np.ndarray, mean: float, shrink: int = SHRINK) -> np.ndarray:
    return (-logs + shrink * mean) / (n + shrink)


def scored(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(doc_id, lang, n_tokens, log10_prob) of every row under the model sent out."""

    def work(batch: pa.RecordBatch, scorer: Scorer) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            n, logs = scorer.scores(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(logs)],
                                             ["doc_id", "lang", "n_tokens", "log10_prob"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text"), work, "doc_id bigint, lang string, n_tokens bigint, log10_prob double",
                     lambda: sent.value.scorer())


def training_texts(docs: DataFrame, used: DataFrame) -> tuple[DataFrame, int]:
    """The distinct texts of the documents ``used`` and their tokens: copies add nothing but weight,
    so each text trains once.  A text is read from the least id that has it; only texts that such
    an id has twice are shuffled."""
    rows = docs.select("doc_id", "text").join(_sendable(used), "doc_id").select("doc_id", "text", *ngram_shards.text_key(), F.isnull("text").alias("none"))
    key = ["h1", "h2", "none"]
    copies = rows.select("doc_id", *key, token_count().alias("n")).groupBy("doc_id", *key, "n").agg(F.count(F.lit(1)).alias("rows"))
    first = cut(copies.groupBy(*key, "n").agg(F.min(F.struct("doc_id", "rows")).alias("of")).select(*key, "n", "of.*"))
    found = [rows.join(_sendable(first.where(c).select("doc_id", *key)), ["doc_id", *key]).select("text") for c in ("rows = 1", "rows > 1")]
    return found[0].unionByName(found[1].distinct()), first.agg(F.sum("n")).first()[0] or 0


def train(docs: DataFrame, labels: DataFrame, local_tokens: int = LOCAL_TOKENS, every_row: bool = True) -> tuple[Verdict, DataFrame | None]:
    """Verdict, and the scored rows of ``docs`` (stored), from the labels of the same ids.
    Without ``every_row`` a model that every task holds scores only the rows that set the
    thresholds.  Rows scored in shards also have their text's key (h1, h2)."""
    trusted = cut(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("q")).where("q = 1").select("doc_id"))
    used = cut(training_ids(trusted))
    texts, tokens = training_texts(docs, used)
    setting = _sendable(stored(trusted.join(used, "doc_id", "left_anti")))
    if tokens > local_tokens:
        model = None
        with workspace(docs.sparkSession) as keep:
            rows = ngram_shards.scored(docs, texts, tokens, keep, discounts_of)
    else:
        model = fit(texts)
        if model is None:
            return Verdict(None, 0.0, float("inf"), {}), None
        sent = docs.sparkSession.sparkContext.broadcast(model)
        rows = stored(scored(docs if every_row else docs.join(setting, "doc_id", "left_semi"), sent))
        sent.destroy()
    fresh = cut(rows.join(setting, "doc_id", "left_semi"))
    if fresh.isEmpty():
        return Verdict(None, 0.0, float("inf"), {}), None
    # Integers sum to the same mean in any order.
    mean = fresh.agg((F.sum((F.col("log10_prob") * -1_000_000).cast("decimal(38,0)")) / F.sum("n_tokens")).cast("double").alias("m")).first()["m"] / 1e6
    step = F.floor((F.lit(SHRINK * mean) - F.col("log10_prob")) / (F.col("n_tokens") + SHRINK) * STEP).cast("bigint")
    counts = cut(fresh.groupBy("lang", step.alias("s")).agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST_DOCS)
    # A statistic has few distinct thousandths, so a language is a short list of counts.
    weighted = F.expr(f"percentile(s, {QUANTILE}, n)")
    limits = {r["lang"]: (r["s"] + 1) / STEP + MARGIN for r in counts.join(sizes, "lang").groupBy("lang").agg(weighted.alias("s")).collect()}
    common = (counts.agg(weighted.alias("s")).first()["s"] + 1) / STEP + MARGIN
    return Verdict(model, mean, common, limits), rows


def _statistic(verdict: Verdict) -> tuple[Column, Column]:
    """A scored row's statistic and its language's threshold."""
    limit = F.lit(verdict.common)
    if verdict.by_language:
        table = F.create_map(*[F.lit(x) for item in sorted(verdict.by_language.items()) for x in item])
        limit = F.coalesce(F.try_element_at(table, F.col("lang")), limit)
    return (F.lit(SHRINK * verdict.mean) - F.col("log10_prob")) / (F.col("n_tokens") + SHRINK), limit


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, lang, n_tokens, log10_prob, perplexity, threshold, kept) of every row; the
    threshold is one of the statistic, like perplexity as a power of ten."""
    verdict, rows = train(docs, labels, **options)
    if rows is None:
        rows = docs.select("doc_id", "lang", F.lit(None).cast("bigint").alias("n_tokens"), F.lit(None).cast("double").alias("log10_prob"))
        return rows.select("*", *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "statistic", "threshold")], F.lit(True).alias("kept"))
    stat, limit = _statistic(verdict)
    return rows.select(
        "doc_id", "lang", "n_tokens", "log10_prob", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens")).alias("perplexity"),
        stat.alias("statistic"), limit.alias("threshold")).withColumn("kept", F.col("statistic") <= F.col("threshold"))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps."""
    verdict, rows = train(docs, labels, every_row=False, **options)
    if rows is None:
        return docs
    if verdict.model is None:
        stat, limit = _statistic(verdict)
        gone = rows.where(stat > limit).select(F.col("lang").alias("_gone_lang"), F.col("h1").alias("_gone_1"), F.col("h2").alias("_gone_2"))
        named = docs.select("*", *(k.alias(f"_text_{i}") for i, k in enumerate(ngram_shards.text_key(), 1)))
        same = (F.col("_text_1") == F.col("_gone_1")) & (F.col("_text_2") == F.col("_gone_2")) & F.col("lang").eqNullSafe(F.col("_gone_lang"))
        return named.join(_sendable(stored(gone.distinct())), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    sent = docs.sparkSession.sparkContext.broadcast(verdict)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def work(batch: pa.RecordBatch, scorer: Scorer) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            n, logs = scorer.scores(part.column(text).to_pylist())
            limits = np.array([sent.value.threshold(x) for x in part.column(lang).to_pylist()])
            yield part.filter(pa.array(statistic(n, logs, sent.value.mean) <= limits))

    return map_arrow(docs, work, docs.schema, lambda: sent.value.model.scorer())
