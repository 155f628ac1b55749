"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

*Terms* are words and their first four and five letters, lower-cased; those that toxic
labelled examples hold more often than the others do (likelihood ratio) are kept.  *Weights* are
(1 + ln tf) x idf, idf over all documents, at unit length.  Examples of equal weights are
one entry of the index with its counts of both classes.

*Index.*  Entries stand in blocks; for each term a block has its largest weight and its
postings.  A query's bound for a block is the sum of its weights times these maxima;
blocks are scored from the largest bound down until no bound exceeds the k-th best
similarity found, so the k nearest are exact.

*Votes.*  Each of the k nearest entries votes with its examples, weighted by a power of
the similarity, against a prior of one average example; a logistic curve fitted to the
examples' own votes (each without itself) turns the vote into a probability.  A text
without any term gets the examples' rate among such texts.  The nearest entries' smallest
example ids are the evidence.

The index has at most ``MAX_EXAMPLES`` examples of ``MAX_TERMS`` terms, a documented bound
that makes it fit to send out; which labelled rows are examples is decided by a hash.
Texts are scored inside their rows.

Defined results: null and empty texts have no terms; a null label is none; several labels
of one document count as the largest; a null doc_id is held out; ties go to the entry of
the smallest example id; repeated rows give repeated rows; without any example the score
is 0 everywhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, cut, map_arrow, texts_of

MAX_EXAMPLES, MAX_TERMS = 20_000, 2_000
#: Likelihood-ratio statistic from which a term is kept, and fewest examples with it.
LEAST_RATIO, LEAST_EXAMPLES = 25.0, 4
PREFIXES = (4, 5)
K, BLOCK, POWER = 12, 64, 4.0
FOLDS = 5
_LETTERS = re.compile(r"[^\W\d_]+")
_REMEMBERED = 300_000


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def terms_of(word: str) -> list[str]:
    return [word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n)]


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


class Terms:
    """The kept terms of texts; remembers those of words."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.known = terms, {}

    def counts(self, text: str | None) -> dict[int, int]:
        found: Counter = Counter()
        known, terms = self.known, self.terms
        if len(known) > _REMEMBERED:
            known.clear()
        for word, n in Counter(words_of(text)).items():
            ids = known.get(word)
            if ids is None:
                ids = known[word] = tuple(terms[t] for t in terms_of(word) if t in terms)
            for i in ids:
                found[i] += n
        return found


class BlockMaxIndex:
    """Entries of unit vectors in blocks with per-term maxima."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        n_blocks = -(-len(vectors) // block)
        self.block = block
        self.most = np.zeros((n_terms, n_blocks))
        # For each block: the row of every term in its postings (the last row is empty).
        self.row = np.full((n_blocks, n_terms), -1, np.int32)
        self.postings = []
        for b in range(n_blocks):
            own = vectors[b * block:(b + 1) * block]
            terms = np.unique(np.concatenate([t for t, _ in own]))
            self.row[b, terms] = np.arange(len(terms))
            weights = np.zeros((len(terms) + 1, block))
            for e, (t, w) in enumerate(own):
                weights[self.row[b, t], e] = w
            self.most[terms, b] = weights[:-1].max(axis=1)
            self.postings.append(weights)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(similarity, entry) of the k nearest entries of positive similarity, best first,
        equal ones by entry."""
        bounds = weights @ self.most[terms]
        best = np.zeros(0)
        entries = np.zeros(0, np.int64)
        for b in np.argsort(-bounds, kind="stable").tolist():
            # A bound is a sum in another order than a score: a hair's breadth is no skip.
            if bounds[b] <= 0 or len(best) == k and bounds[b] < best[-1] - 1e-9:
                break
            scores = np.round(weights @ self.postings[b][self.row[b, terms]], 12)
            good = np.flatnonzero(scores >= best[-1] if len(best) == k else scores > 0)
            if len(good):
                best = np.concatenate((best, scores[good]))
                entries = np.concatenate((entries, good + b * self.block))
                order = np.lexsort((entries, -best))[:k]
                best, entries = best[order], entries[order]
        return list(zip(best.tolist(), entries.tolist()))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


class Model:
    """Terms, weights, index and calibration; small enough to send to every task."""

    def __init__(self, terms: dict[str, int], idf: np.ndarray, examples: list[tuple[int, int, dict[int, int]]], k: int = K):
        """``examples``: (id, label, counts of terms)."""
        self.terms, self.idf, self.k = terms, idf, k
        labels = [y for _, y, _ in examples]
        self.rate = sum(labels) / len(labels) if labels else 0.0
        empty = [y for _, y, c in examples if not c]
        self.empty = (sum(empty) + self.rate) / (len(empty) + 1) if labels else 0.0
        entries: dict[tuple, list] = {}
        for i, y, counts in examples:
            if counts:
                entry = entries.setdefault(tuple(sorted(counts.items())), [i, 0, 0])
                entry[0] = min(entry[0], i)
                entry[1 + y] += 1
        # Entries of similar terms in one block have sharp bounds.
        order = sorted(entries.items(), key=lambda x: (min(x[0], key=lambda t: (-idf[t[0]], t[0])), x[1][0]))
        self.ids = [e[0] for _, e in order]
        self.clean = np.array([e[1] for _, e in order], float)
        self.toxic = np.array([e[2] for _, e in order], float)
        self.vectors = [self.vector(dict(key)) for key, _ in order]
        self.index = BlockMaxIndex(self.vectors, len(terms))
        self.a, self.b = 1.0, 0.0
        self._calibrate()

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts))
        weights = np.array([1 + math.log(counts[t]) for t in terms.tolist()]) * self.idf[terms]
        return terms, weights / math.sqrt(float(weights @ weights))

    def vote(self, near: list[tuple[float, int]], less: tuple[int, int] | None = None) -> float:
        """Share of toxic votes; ``less`` is an (entry, label) that does not vote."""
        toxic, total = self.rate, 1.0
        for s, e in near:
            w, t, c = s ** POWER, self.toxic[e], self.clean[e]
            if less and e == less[0]:
                t, c = t - less[1], c - (1 - less[1])
            toxic, total = toxic + w * t, total + w * (t + c)
        return toxic / total

    def _calibrate(self) -> None:
        """Logistic curve over the votes' log-odds, by Newton steps with a weak pull to the identity."""
        x, y, n = [], [], []
        for e, (terms, weights) in enumerate(self.vectors):
            near = self.index.nearest(terms, weights, self.k)
            for label, count in ((0, self.clean[e]), (1, self.toxic[e])):
                if count:
                    p = min(max(self.vote(near, (e, label)), 1e-6), 1 - 1e-6)
                    x.append(math.log(p / (1 - p)))
                    y.append(label)
                    n.append(count)
        if not x or len(set(y)) < 2:
            return
        x, y, n = np.array(x), np.array(y, float), np.array(n)
        theta, pull, start = np.array([1.0, 0.0]), np.array([1.0, 1.0]), np.array([1.0, 0.0])
        features = np.stack((x, np.ones_like(x)))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(theta @ features, -35, 35)))
            gradient = features @ (n * (p - y)) + pull * (theta - start)
            step = np.linalg.solve((features * (n * p * (1 - p))) @ features.T + np.diag(pull), gradient)
            theta = theta - step
            if np.abs(step).max() < 1e-10:
                break
        self.a, self.b = max(float(theta[0]), 1e-3), float(theta[1])

    def score(self, counts: dict[int, int]) -> tuple[float, list[int]]:
        """Probability and the ids of the three nearest examples."""
        if not counts or not self.ids:
            return self.empty, []
        near = self.index.nearest(*self.vector(counts), self.k)
        if not near:
            return self.empty, []
        p = min(max(self.vote(near), 1e-6), 1 - 1e-6)
        return _sigmoid(self.a * math.log(p / (1 - p)) + self.b), [self.ids[e] for _, e in near[:3]]


def _ratio(n11: Column, n10: Column, n1: int, n0: int) -> Column:
    """Likelihood-ratio statistic of having a term and being toxic."""
    def part(a: Column, b: Column) -> Column:
        def one(k: Column, e: Column) -> Column:
            return F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
        share = (a + b) / float(n1 + n0)
        return one(a, share * n1) + one(b, share * n0)
    return 2 * (part(n11, n10) + part(n1 - n11, n0 - n10))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS, k: int = K) -> Model:
    """Model from the labelled rows of ``docs`` outside the held-out fold, idf from all rows."""
    known = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id"), FOLDS) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = cut(bounded(known, "doc_id", F.lit(1), max_examples, "example"))  # at most max_examples rows: bounded, so sent out whole
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("y", (F.col("y") > 0).cast("int"))
    # Copies would make their chance words look telling, so equal texts of a class are one example.
    texts = cut(texts.groupBy("text", "y").agg(F.min("doc_id").cast("bigint").alias("doc_id")).select("doc_id", "text", "y"))
    classes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = classes.get(1, 0), classes.get(0, 0)

    def listed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for text, y in zip(texts_of(batch), batch.column(2).to_pylist()):
            for t in {t for w in set(words_of(text)) for t in terms_of(w)}:
                found.setdefault(t, [0, 0])[y > 0] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found)), pa.array([c[0] for c in found.values()], pa.int64()), pa.array([c[1] for c in found.values()], pa.int64())],
            ["term", "n10", "n11"])

    terms: dict[str, int] = {}
    if n1 and n0:
        counts = map_arrow(texts, listed, "term string, n10 bigint, n11 bigint")
        counts = counts.groupBy("term").agg(F.sum("n10").alias("n10"), F.sum("n11").alias("n11")).where(F.col("n10") + F.col("n11") >= LEAST_EXAMPLES)
        rated = counts.where(F.col("n11") * n0 > F.col("n10") * n1).withColumn("g", F.round(_ratio(F.col("n11"), F.col("n10"), n1, n0), 6)).where(F.col("g") >= LEAST_RATIO)
        best = rated.orderBy(F.desc("g"), "term").limit(max_terms).select("term").collect()
        terms = {r["term"]: i for i, r in enumerate(sorted(best))}

    def frequencies(batch: pa.RecordBatch, state: Terms) -> pa.RecordBatch:
        df: Counter = Counter()
        for text in texts_of(batch):
            df.update(state.counts(text).keys())
        return pa.RecordBatch.from_arrays(
            [pa.array([-1, *df], pa.int32()), pa.array([batch.num_rows, *df.values()], pa.int64())], ["t", "n"])

    totals = map_arrow(docs.select("text"), frequencies, "t int, n bigint", lambda: Terms(terms)).groupBy("t").agg(F.sum("n").alias("n"))
    df = {r["t"]: r["n"] for r in totals.collect()}
    idf = np.array([math.log((1 + df.get(-1, 0)) / (1 + df.get(t, 0))) + 1 for t in range(len(terms))])

    def vectors(batch: pa.RecordBatch, state: Terms) -> pa.RecordBatch:
        found = [state.counts(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([list(c) for c in found], pa.list_(pa.int32())),
             pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["doc_id", "y", "t", "c"])

    rows = map_arrow(texts, vectors,
                     "doc_id bigint, y int, t array<int>, c array<int>", lambda: Terms(terms)).collect()
    examples = sorted((r["doc_id"], int(r["y"] > 0), tuple(sorted(zip(r["t"], r["c"])))) for r in rows)
    return Model(terms, idf, [(i, y, dict(c)) for i, y, c in examples], k)


class Scorer:
    """Scores texts with a model; remembers the scores of equal counts."""

    def __init__(self, model: Model):
        self.model, self.terms, self.known = model, Terms(model.terms), {}

    def score(self, text: str | None) -> tuple[float, list[int]]:
        counts = self.terms.counts(text)
        key = tuple(sorted(counts.items()))
        if (found := self.known.get(key)) is None:
            if len(self.known) > _REMEMBERED:
                self.known.clear()
            found = self.known[key] = self.model.score(counts)
        return found


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, scorer: Scorer) -> pa.RecordBatch:
        found = [scorer.score(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))],
            ["doc_id", "score", "evidence"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work, "doc_id bigint, score double, evidence array<bigint>", lambda: Scorer(sent.value))


def kept(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``limit``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, scorer: Scorer) -> pa.RecordBatch:
        return batch.filter(pa.array([scorer.score(t)[0] < limit for t in texts_of(batch)]))

    return map_arrow(docs, work, docs.schema, lambda: Scorer(sent.value))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns, and the evidence."""
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
