"""TF-IDF over word and character n-grams, fitted and applied with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..plans.materialize import cut, released
from .terms import long_words


@dataclass(frozen=True)
class TfidfConfig:
    """Analyzer ("word" or "char"), n-gram range, document-frequency floor, vocabulary size."""

    analyzer: str
    low: int
    high: int
    min_df: int
    max_features: int


# The two feature blocks of the baseline.
WORD_TFIDF = TfidfConfig("word", 1, 2, 3, 300_000)
CHAR_TFIDF = TfidfConfig("char", 2, 5, 5, 500_000)
# Texts whose n-grams are counted together.
TEXTS_AT_ONCE = 512
VARIANTS = {"word": (WORD_TFIDF,), "char": (CHAR_TFIDF,), "word+char": (WORD_TFIDF, CHAR_TFIDF)}


def word_ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """Word n-grams of all sizes in [low, high], joined by one space.

    ``words`` must be a stored column: it is read inside a lambda, once per n-gram.
    """
    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
        return words if n == 1 else F.when(F.size(words) >= n, joined).otherwise(F.array())

    return F.concat(*[grams(n) for n in range(low, high + 1)])


def char_words(text: Column) -> Column:
    """Lower-cased whitespace-separated words."""
    return F.filter(F.split(tx.squeeze(F.lower(text)), " "), lambda w: w != "")


def char_ngrams(words: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside words padded by one space on each side.

    A size longer than the padded word adds the whole word once, and only if no
    smaller size already covered it whole.
    """
    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)

        def block(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
            cut = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
            return cut if n == low else F.when(size >= n, cut).otherwise(F.array())

        return F.concat(*[block(n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words, grams))


def with_ngrams(df: DataFrame, config: TfidfConfig, out: str) -> DataFrame:
    """Add the n-grams of ``text``; words are split in a projection of their own."""
    split, build = (
        (long_words, word_ngrams) if config.analyzer == "word" else (char_words, char_ngrams)
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    step = df.withColumn(f"_{out}_words", split(text))
    return step.withColumn(out, build(F.col(f"_{out}_words"), config.low, config.high)).drop(
        f"_{out}_words"
    )


def word_grams(word: str, low: int, high: int) -> list[str]:
    """What ``char_ngrams`` gives for one word."""
    padded = f" {word} "
    size = len(padded)
    return [padded[i:i + n] for n in range(low, high + 1) for i in range(max(size - n + 1, int(n == low)))]


def _char_counts(df: DataFrame, config: TfidfConfig) -> DataFrame:
    """(term, df, cf) of every ``TEXTS_AT_ONCE`` texts: a word is taken apart once for all of
    its places, and a term is a row once for all of its texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                lists = batch.column(0).slice(start, TEXTS_AT_ONCE)
                words = lists.flatten().dictionary_encode()
                kinds = len(words.dictionary)
                if not kinds:
                    continue
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                places, times = np.unique(row * kinds + words.indices.to_numpy(), return_counts=True)
                row, word = np.divmod(places, kinds)
                grams = [word_grams(w, config.low, config.high) for w in words.dictionary.to_pylist()]
                sizes = np.array([len(g) for g in grams])
                terms = pa.array([g for own in grams for g in own], pa.string()).dictionary_encode()
                n, codes, firsts = len(terms.dictionary), terms.indices.to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
                cf = np.bincount(codes, np.repeat(np.bincount(word, times, kinds), sizes), n).astype(np.int64)
                own = sizes[word]
                ahead = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                pairs = np.unique(np.repeat(row, own) * n + codes[np.repeat(firsts[word], own) + ahead])
                held = np.bincount(pairs % n, minlength=n)
                yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(held), pa.array(cf)], ["term", "df", "cf"])

    words = df.select(char_words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    return words.mapInArrow(counted, "term string, df bigint, cf bigint")


def _word_counts(df: DataFrame, config: TfidfConfig) -> DataFrame:
    """(term, df, cf) of every ``TEXTS_AT_ONCE`` texts: n-grams are counted as numbers of
    words, and a term is a row once for all of its texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                lists = batch.column(0).slice(start, TEXTS_AT_ONCE)
                words = lists.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                word, terms = words.indices.to_numpy().astype(np.int64), words.dictionary
                kinds, prefix, names = len(terms), word, terms
                for n in range(1, config.high + 1):
                    if n > 1:  # an n-gram is the number of the one a word shorter and its last word
                        whole = row[n - 1:] == row[:len(row) - n + 1]
                        pairs, prefix_of = np.unique(prefix[:len(whole)] * kinds + word[n - 1:], return_inverse=True)
                        first, last = np.divmod(pairs, max(kinds, 1))
                        names = pc.binary_join_element_wise(names.take(pa.array(first)), terms.take(pa.array(last)), " ")
                        prefix = prefix_of
                    else:
                        whole = np.ones(len(row), bool)
                    if n < config.low or not whole.any():
                        continue
                    code = prefix[whole]
                    cf = np.bincount(code, minlength=len(names))
                    held = np.bincount(np.unique(row[:len(whole)][whole] * len(names) + code) % len(names), minlength=len(names))
                    own = np.flatnonzero(cf)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array(held[own]), pa.array(cf[own])], ["term", "df", "cf"])

    words = df.select(long_words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    return words.mapInArrow(counted, "term string, df bigint, cf bigint")


def term_statistics(df: DataFrame, config: TfidfConfig) -> DataFrame:
    """(term, df, cf): texts holding the term and occurrences, above the document floor.

    N-grams are counted over some texts at a time before they become rows, and those are
    combined map-side.
    """
    counts = _char_counts(df, config) if config.analyzer == "char" else _word_counts(df, config)
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where(F.col("df") >= config.min_df)


def vocabulary(df: DataFrame, config: TfidfConfig) -> DataFrame:
    return most_frequent(cut(term_statistics(df, config)), config)


def most_frequent(terms: DataFrame, config: TfidfConfig) -> DataFrame:
    """The ``max_features`` most frequent of ``terms``; ties go to the smaller term.

    A histogram of the frequencies (few distinct values) gives the frequency at which
    the vocabulary fills up.  Terms above it are taken as they are; only those equal to
    it are ordered, for the places left.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("cf"))
    filled = terms.groupBy("cf").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(order) - F.col("n")
    )
    last = filled.where(F.col("before") < config.max_features).orderBy("cf").first()
    if last is None:
        return terms
    above = terms.where(F.col("cf") > last["cf"])
    level = terms.where(F.col("cf") == last["cf"])
    places = config.max_features - last["before"]
    if last["n"] > places:
        level = level.orderBy("term").limit(places)
    return above.unionByName(level)


@dataclass
class TfidfModel:
    """Fitted vocabulary and inverse document frequencies of one feature block."""

    config: TfidfConfig
    counts: CountVectorizerModel
    weights: np.ndarray

    def raw(self, df: DataFrame, out: str) -> DataFrame:
        """Add the struct (indices, values) of a text's counts; the vocabulary travels to the
        tasks, the rows are not shuffled."""
        terms, vector = f"_{out}_t", f"_{out}_c"
        step = with_ngrams(df, self.config, terms)
        step = self.counts.copy({self.counts.inputCol: terms, self.counts.outputCol: vector}).transform(step)
        parts = F.unwrap_udt(vector)
        return step.withColumn(out, F.struct(parts["indices"].alias("indices"), parts["values"].alias("values"))).drop(terms, vector)


def weighted(lists: list[tuple[pa.Array, pa.Array]], idf: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, indices, values) of rows whose blocks stand side by side: damped counts times
    idf, every block of a row scaled to length one."""
    rows, places, values, before = [], [], [], 0
    n = len(lists[0][0])
    for (index, count), w in zip(lists, idf):
        row = np.repeat(np.arange(n), index.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = index.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        value = (1.0 + np.log(count.flatten().to_numpy(zero_copy_only=False))) * w[at]
        norm = np.sqrt(np.bincount(row, value * value, minlength=n))
        rows.append(row)
        places.append(at + before)
        values.append(value / norm[row])
        before += len(w)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int64)
    return starts, np.concatenate(places)[order], np.concatenate(values)[order]


def raw_columns(df: DataFrame, blocks: list[TfidfModel]) -> tuple[DataFrame, list[Column], list[str]]:
    """``df`` with the counts of every block, the columns an Arrow function takes of them, and
    the names to drop afterwards."""
    names = [f"_block{i}" for i in range(len(blocks))]
    for block, name in zip(blocks, names):
        df = block.raw(df, name)
    return df, [F.col(n)[part] for n in names for part in ("indices", "values")], names


def add_features(df: DataFrame, blocks: list[TfidfModel], out: str = "features") -> DataFrame:
    """TF-IDF blocks side by side as a struct (indices, values); row-local."""
    sent = df.sparkSession.sparkContext.broadcast([b.weights for b in blocks])
    df, columns, names = raw_columns(df, blocks)

    def combine(*parts: pa.Array) -> pa.Array:
        starts, indices, values = weighted(list(zip(parts[::2], parts[1::2])), sent.value)
        lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, t)) for x, t in ((indices, pa.int32()), (values, pa.float64()))]
        return pa.StructArray.from_arrays(lists, ["indices", "values"])

    udf = F.arrow_udf(combine, "struct<indices: array<int>, values: array<double>>")
    return df.withColumn(out, udf(*columns)).drop(*names)


def counter(terms: pa.ChunkedArray) -> CountVectorizerModel:
    """As ``CountVectorizerModel.from_vocabulary``, which hands the driver's JVM one term a
    call; here all go by one.  No term holds a line feed, as words end at white space."""
    lines = SparkContext.getOrCreate()._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(terms.to_pylist()))
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", lines)
    model._set(vocabSize=len(terms))
    return model.setInputCol("terms").setOutputCol("tf")


def fit_tfidf(df: DataFrame, config: TfidfConfig) -> TfidfModel:
    """Vocabulary by corpus frequency above the document floor; smoothed idf plus one.

    The vocabulary is bounded by ``max_features``, which is what makes it safe to hold
    on the driver and to ship to the tasks.
    """
    model = tfidf_of(vocabulary(df, config), df, config)
    released(df.sparkSession)  # a fit has several vocabularies, whose counts are shuffled
    return model


def tfidf_of(terms: DataFrame, df: DataFrame, config: TfidfConfig) -> TfidfModel:
    """The model of a vocabulary's (term, df, cf) rows over the texts ``df``."""
    rows = terms.select("term", "df", "cf").toArrow().sort_by([("cf", "descending"), ("term", "ascending")])
    if not len(rows):
        raise ValueError(f"no {config.analyzer} term occurs in {config.min_df} texts")
    frequency = rows["df"].to_numpy().astype(float)
    return TfidfModel(config, counter(rows["term"]), np.log((df.count() + 1.0) / (frequency + 1.0)) + 1.0)


def fit_blocks(df: DataFrame, configs: tuple[TfidfConfig, ...]) -> list[TfidfModel]:
    return [fit_tfidf(df, c) for c in configs]


def tfidf_weights(df: DataFrame, config: TfidfConfig) -> DataFrame:
    """Long form of the same weights: (row_id, term, weight).

    Used to inspect or export features; the vocabulary keeps at most ``max_features``
    terms.  Weights are row-local and only then become a row a term, so that no row of a
    text's term is shuffled.
    """
    terms = vocabulary(df, config)
    if terms.isEmpty():
        return df.select("row_id", F.lit("").alias("term"), F.lit(0.0).alias("weight")).where(F.lit(False))
    model = tfidf_of(terms, df, config)
    names = df.sparkSession.createDataFrame(pa.table({"i": pa.array(range(len(model.weights)), pa.int32()), "term": model.counts.vocabulary}))
    rows = add_features(df.select("row_id", "text"), [model])
    pairs = F.arrays_zip(F.col("features")["indices"].alias("i"), F.col("features")["values"].alias("weight"))
    return rows.select("row_id", F.explode(pairs).alias("x")).select("row_id", "x.*").join(
        F.broadcast(names), "i").select("row_id", "term", "weight")


def union_profile(df: DataFrame, configs: tuple[TfidfConfig, ...]) -> DataFrame:
    """(row_id, block, terms, total, squares) of the union of several blocks: how many
    features of a block a text has, their summed weights and summed squares."""
    blocks = fit_blocks(df, configs)
    sizes = np.cumsum([0, *(len(b.weights) for b in blocks)]).tolist()
    rows = add_features(df.select("row_id", "text"), blocks)
    pairs = F.arrays_zip(F.col("features")["indices"].alias("i"), F.col("features")["values"].alias("v"))
    part = lambda k: F.transform(F.filter(pairs, lambda p: (p["i"] >= sizes[k]) & (p["i"] < sizes[k + 1])), lambda p: p["v"])
    each = F.explode(F.array(*[F.struct(F.lit(c.analyzer).alias("block"), part(k).alias("v")) for k, c in enumerate(configs)]))
    add = lambda f: F.aggregate("v", F.lit(0.0), f)
    return rows.select("row_id", each.alias("x")).select("row_id", "x.*").select(
        "row_id", "block", F.size("v").alias("terms"), add(lambda s, x: s + x).alias("total"), add(lambda s, x: s + x * x).alias("squares"))


def document_frequencies(df: DataFrame, config: TfidfConfig) -> DataFrame:
    """(term, df, cf, idf) of the terms above the document floor."""
    n = df.agg(F.count(F.lit(1))).scalar().cast("double")
    return term_statistics(df, config).withColumn(
        "idf", F.ln((n + 1.0) / (F.col("df") + 1).cast("double")) + 1.0
    )
