"""Language-model scoring by a hidden Markov model over words.

*Base.*  Word counts cover the whole training part.  The most frequent words, at most
``HOT_WORDS``, are sent out; the others' counts reach the texts that hold them by a join
on the word, with equal words of a text combined first.

*Symbols.*  The ``OWN`` most frequent words and the end are symbols of their own, all
other words share ``SUFFIXES`` symbols by their last bytes.  Within such a symbol a word
has its smoothed share of the symbol's count, one share being left for unseen words, so a
text's probability is the symbols' times the shares.

*Training.*  Baum-Welch: each task runs the scaled forward-backward recursion over its
texts, many side by side, in single precision, and returns expected counts, which Spark
sums over all tasks in double precision; the driver only divides them.  Every step covers the whole training part; they end when a
step gains less than ``TOLERANCE`` of log-likelihood (natural) a token.
For training a text of more than ``SEGMENT`` tokens is cut into segments.

*Scoring.*  The scaled forward recursion over whole texts, so the likelihood is exact.

Defined results: a null or empty text is one end token; a null doc_id counts as empty
for the fold; repeated rows train and score each; extra columns are ignored; without
training rows every symbol has the smoothing's probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, map_arrow
from .neighbours import fold

FOLDS, SMOOTH = 10, 0.1
STATES, TOLERANCE = 8, 5e-4
OWN, SUFFIXES, SUFFIX_BYTES = 3_000, 509, 3
HOT_WORDS, HOT_BYTES = 300_000, 64
SEGMENT, PACK, SCALED = 1024, 500_000, 4
#: Pseudo-tokens by which a state's symbols lean on the overall ones, and per transition.
LEAN, FEW = 20.0, 0.5
_FLUSH = 200_000


def tokens_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased; bytes.split knows just the contract's white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def suffix(word: bytes, suffixes: int = SUFFIXES) -> int:
    return zlib.crc32(word[-SUFFIX_BYTES:]) % suffixes


def _suffix_col(word: Column, suffixes: int = SUFFIXES) -> Column:
    return (F.crc32(F.substring(word, -SUFFIX_BYTES, SUFFIX_BYTES)) % suffixes).cast("int")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts; tasks combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])
            found.clear()
            return batch

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(start, 256).to_pylist():
                    found.update(tokens_of(text))
                if len(found) > _FLUSH:
                    yield out()
        if found:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What tasks need to turn texts into symbols and to look up frequent words."""

    def __init__(self, hot: list[tuple[bytes, int]], n_tokens: int, n_types: int, n_texts: int, own: int,
                 sums: dict[int, tuple[int, int]], suffixes: int = SUFFIXES):
        """``hot``: frequent words and counts, most frequent first; ``sums``: count and
        number of words of each suffix, without the ``own`` first words."""
        self.n_tokens, self.n_types, self.n_texts, self.suffixes = n_tokens, n_types, n_texts, suffixes
        self.words = [w for w, _ in hot]
        counts = np.array([c for _, c in hot], float)
        own = min(own, len(hot))
        self.end = own
        self.size = own + 1 + suffixes
        self.symbols = np.array([i if i < own else own + 1 + suffix(w, suffixes) for i, w in enumerate(self.words)], np.int64)
        self.sum = np.array([sums.get(s, (0, 0))[0] for s in range(suffixes)], float)
        self.types = np.array([sums.get(s, (0, 0))[1] for s in range(suffixes)], float)
        self.base = np.log10((counts + SMOOTH) / (n_tokens + SMOOTH * (n_types + 1)))
        below = np.maximum(self.symbols - own - 1, 0)
        total = self.sum[below] + SMOOTH * (self.types[below] + 1)
        self.within = np.where(np.arange(len(hot)) < own, 0.0, np.log10((counts + SMOOTH) / total))
        self.end_base = float(np.log10((n_texts + SMOOTH) / (n_tokens + SMOOTH * (n_types + 1))))
        # Counts of symbols, for the models' first guess and for what they lean on.
        self.counts = np.concatenate((counts[:own], [n_texts], self.sum))

    def overall(self) -> np.ndarray:
        smoothed = self.counts + SMOOTH
        return smoothed / smoothed.sum()


def vocabulary(counts: DataFrame, n_texts: int, own: int = OWN, hot_words: int = HOT_WORDS) -> Vocabulary:
    """From all words' counts.  Frequent words are those over a count that lets at most
    ``hot_words`` through; a histogram over logarithmic steps finds it."""
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    short = counts.where(F.length("word") <= HOT_BYTES)
    step = F.floor(F.log2("c") * 16)
    histogram = {r["s"]: r["n"] for r in short.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    through, least = 0, None
    for s in sorted(histogram, reverse=True):
        through += histogram[s]
        if through > hot_words:
            break
        least = s
    hot = [] if least is None else short.where(step >= least).select("word", "c").collect()
    hot = sorted(((bytes(r["word"]), r["c"]) for r in hot), key=lambda x: (-x[1], x[0]))
    sums = {r["s"]: (r["n"], r["v"]) for r in counts.groupBy(_suffix_col(F.col("word")).alias("s")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    for w, c in hot[:own]:
        n, v = sums[suffix(w)]
        sums[suffix(w)] = n - c, v - 1
    return Vocabulary(hot, (totals["n"] or 0) + n_texts, totals["v"] + (n_texts > 0), n_texts, own, sums)


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, n_known, base, within, symbols, rare, rare_n): sums
    over the frequent words and the end, the symbols as packed 16-bit numbers, and the
    distinct other words with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def setup():
        v = sent.value
        return v, {w: i for i, w in enumerate(v.words)}

    def work(batch: pa.RecordBatch, state) -> Iterator[pa.RecordBatch]:
        v, places = state
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            columns: list[list] = [[] for _ in range(7)]
            for text in part.column(2).to_pylist():
                words = tokens_of(text)
                at = np.fromiter(map(places.get, words, repeat(-1)), np.int64, len(words))
                hot = at[at >= 0]
                symbols = np.empty(len(words) + 1, "<u2")
                symbols[-1] = v.end
                symbols[:-1][at >= 0] = v.symbols[hot]
                others = np.flatnonzero(at < 0).tolist()
                rare = [words[i] for i in others]
                symbols[others] = [v.end + 1 + suffix(w, v.suffixes) for w in rare]
                rare = Counter(rare)
                for column, x in zip(columns, (
                        len(words) + 1, len(hot) + (v.n_texts > 0), v.base[hot].sum() + v.end_base, v.within[hot].sum(),
                        symbols.tobytes(), list(rare), list(rare.values()))):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             ["doc_id", "held_out", "n_tokens", "n_known", "base", "within", "symbols", "rare", "rare_n"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text")
    rows = map_arrow(rows, work, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, within double, "
                                 "symbols binary, rare array<binary>, rare_n array<int>", setup)
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def rare_sums(rows: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row, known, base, within): sums over the words that were not sent out."""
    v = vocabulary
    words = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select(
        "row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    # One row per suffix: a table of a fixed size.
    totals = rows.sparkSession.createDataFrame(
        [(s, float(v.sum[s] + SMOOTH * (v.types[s] + 1))) for s in range(v.suffixes)], "s int, total double")
    joined = words.join(counts, "word", "left").withColumn("s", _suffix_col(F.col("word"), v.suffixes)).join(F.broadcast(totals), "s")
    c = F.coalesce("c", F.lit(0)) + SMOOTH
    return joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10(c / F.lit(v.n_tokens + SMOOTH * (v.n_types + 1)))).alias("rare_base"),
        F.sum(F.col("n") * F.log10(c / F.col("total"))).alias("rare_within"))


class HMM:
    """Start, transition and emission probabilities (states x symbols)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def guess(cls, overall: np.ndarray, states: int, seed: int = 7) -> HMM:
        rng = np.random.default_rng(seed)
        emit = overall * rng.uniform(0.2, 1.8, (states, len(overall)))
        move = rng.uniform(0.5, 1.5, (states, states)) + np.eye(states) * states
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, overall: np.ndarray) -> HMM:
        start, move, emit = start + FEW, move + FEW, emit + LEAN * overall
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probabilities of symbol sequences, none of them empty."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order])
        flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        emit, out = np.ascontiguousarray(self.emit.T), np.zeros(len(texts))
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
        alpha = None
        for t in range(lengths[0]):
            n = active[t]
            seen = emit[flat[starts[:n] + t]]
            alpha = self.start * seen if t == 0 else (alpha[:n] @ self.move) * seen
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            out[:n] += np.log10(scale)
        result = np.empty(len(texts))
        result[order] = out
        return result

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions over symbol sequences."""
        return self.expected_and_log(texts)[:3]

    def expected_and_log(self, texts: list[np.ndarray], kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """``expected`` and the sequences' log-likelihood; the recursion runs on numbers of
        ``kind``, and sums over texts are in double precision whatever it is.

        Tokens lie by their place in the texts, longest text first, so that every step works
        on one stretch of the arrays and in place.  Sums are brought to one at every
        ``SCALED``-th place and at a text's end.  A symbol's emissions are taken relative to the
        greatest one, which no count depends on, so that in between they stay far above
        underflow however rare the symbols are."""
        k, size = self.emit.shape
        top = self.emit.max(axis=0)
        top = np.where(top > 0, top, 1.0)
        texts = sorted(texts, key=len, reverse=True)
        lengths = np.array([len(t) for t in texts])
        steps = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        ends = np.concatenate(([0], np.cumsum(active))).tolist()
        active = [*active.tolist(), 0]
        symbols, at = np.concatenate(texts), np.concatenate(([0], np.cumsum(lengths)))[:-1]
        emit, ones = np.ascontiguousarray((self.emit / top).T, kind), np.ones((k, 1), kind)
        first, ahead_of = self.start.astype(kind), self.move.astype(kind)
        flat = np.empty(ends[-1], np.int64)
        seen, alpha = np.empty((len(flat), k), kind), np.empty((len(flat), k), kind)
        beta, scales = np.ones((len(texts), k), kind), {}
        log = float(np.bincount(symbols, minlength=size) @ np.log(top))
        for t in range(steps):
            n, own = active[t], slice(ends[t], ends[t + 1])
            flat[own] = symbols[at[:n]]
            at += 1
            now = alpha[own]
            np.take(emit, flat[own], axis=0, out=seen[own], mode="clip")
            if t == 0:
                np.multiply(first, seen[own], out=now)
            else:
                np.dot(alpha[ends[t - 1]:ends[t - 1] + n], ahead_of, out=now)
                now *= seen[own]
            if t % SCALED == SCALED - 1:
                scales[t] = np.dot(now, ones)
                now /= scales[t]
                log += float(np.log(scales[t]).sum(dtype=float))
            if active[t + 1] < n:  # what is left of the scale where texts end
                last = np.dot(now[active[t + 1]:], ones)
                beta[active[t + 1]:n] /= last
                log += float(np.log(last).sum(dtype=float))
        back, move = np.ascontiguousarray(ahead_of.T), np.zeros((k, k))
        for t in range(steps - 1, 0, -1):
            n, own = active[t], slice(ends[t], ends[t + 1])
            ahead, after = seen[own], beta[:n]
            alpha[own] *= after
            ahead *= after
            if t in scales:
                ahead /= scales[t]
            move += alpha[ends[t - 1]:ends[t - 1] + n].T @ ahead
            np.dot(ahead, back, out=after)
        alpha[:ends[1]] *= beta[:ends[1]]
        # One count over (symbol, state) pairs.
        pairs = (flat[:, None] * k + np.arange(k)).ravel()
        emit = np.bincount(pairs, alpha.ravel(), size * k).reshape(size, k).T
        return alpha[:ends[1]].sum(0, dtype=float), move * self.move, emit, log


def segments(texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for t in texts:
        symbols = np.frombuffer(t, "<u2")
        out += [symbols[i:i + SEGMENT] for i in range(0, len(symbols), SEGMENT)]
    return out


def _packs(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    pack, size = [], 0
    for t in texts:
        pack.append(t)
        size += len(t) // 2
        if size >= PACK:
            yield pack
            pack, size = [], 0
    if pack:
        yield pack


def baum_welch_step(sequences: DataFrame, model: HMM, overall: np.ndarray) -> tuple[HMM, float]:
    """The next model, of expected counts of all tasks, summed by Spark, and the
    log-likelihood under ``model``."""
    sent = sequences.sparkSession.sparkContext.broadcast(model)
    states, size = model.emit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        texts = (t for b in batches for s in range(0, b.num_rows, 512) for t in b.column(0).slice(s, 512).to_pylist())
        for pack in _packs(texts):
            found = np.concatenate([np.ravel(x) for x in sent.value.expected_and_log(segments(pack), np.float32)])
            total = found if total is None else total + found
        if total is not None:
            # One vector of a fixed length a task, in rows of 64 numbers.
            total = np.concatenate((total, np.zeros(-len(total) % 64))).reshape(-1, 64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "x"])

    rows = sequences.select("symbols").mapInArrow(run, "i int, x array<double>")
    sums = rows.groupBy("i").agg(*[F.sum(F.col("x")[k]).alias(f"x{k}") for k in range(64)]).toPandas().sort_values("i")
    flat = sums.drop(columns="i").to_numpy().ravel()
    if not len(flat):
        return model, 0.0
    a, b = states, states + states * states
    c = b + states * size
    if not np.isfinite(flat).all():
        raise FloatingPointError("expected counts or the likelihood are not finite")
    return HMM.of_counts(flat[:a], flat[a:b].reshape(states, states), flat[b:c].reshape(states, size), overall), float(flat[c])


def trained(sequences: DataFrame, vocabulary: Vocabulary, states: int = STATES, steps: int | None = None) -> HMM:
    """Model of the (row, n_tokens, symbols) rows; ``steps`` ends training earlier."""
    overall = vocabulary.overall()
    model = HMM.guess(overall, states)
    sequences = cut(sequences.select("symbols"))
    before, done = None, 0
    while steps is None or done < steps:
        after, log = baum_welch_step(sequences, model, overall)
        if before is not None and log - before < TOLERANCE * vocabulary.n_tokens:
            return model
        model, before, done = after, log, done + 1
        if not vocabulary.n_tokens:
            break
    return model


def scored(rows: DataFrame, model: HMM) -> DataFrame:
    """(row, path): log10 probability of every row's symbols."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            logs = sent.value.log10([np.frombuffer(s, "<u2") for _, s in held])
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in held], pa.int64()), pa.array(logs)], ["row", "path"])

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                for r, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.append((r, s))
                    size += len(s) // 2
                    if size >= 3 * PACK:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return rows.select("row", "symbols").mapInArrow(run, "row bigint, path double")


def language_scores(docs: DataFrame, states: int = STATES, steps: int | None = None, own: int = OWN, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    training = docs.where(fold(F.col("doc_id"), FOLDS) != 0)
    counts = cut(word_counts(training))
    n_texts = training.count()
    v = vocabulary(counts, n_texts, own, hot_words)
    rows = encoded(docs, v)
    model = trained(rows.where("not held_out").select("row", "n_tokens", "symbols"), v, states, steps)
    paths = scored(rows, model)
    slim = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within")
    joined = slim.join(rare_sums(rows, counts, v), "row", "left").join(paths, "row")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.n_tokens).cast("bigint").alias("train_tokens"), (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("path") + F.col("within") + zero("rare_within")).alias("score"))
