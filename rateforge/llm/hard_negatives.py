"""Hard-negative mining by matrix products in a residue number system.

Components become integers floor(scale x component).  Scores of a block of anchors against a
block of rows are inner products of these integers: for each of several small primes the
residues, centred on zero, are multiplied as float32 matrices, over slices of so many
components that no sum reaches 2^24, so that every product is exact; Chinese remaindering
(mixed radix, digit by digit) gives back the signed score.  The primes are as many as the
largest product of two row norms asks for (Cauchy-Schwarz), measured over all rows.

Anchors and rows are dealt into blocks of a bounded number of rows and every pair of
blocks is one task's work, so nothing passes the driver and no group grows with the input.
A first round keeps the best positives of an anchor in each block and merges them by rank;
a second one keeps, for each positive, the best rows of other labels whose scores lie in
that positive's window.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component (or one whose scaled value is not finite) take no part; shorter vectors count as
padded with zeros; equal scores are ordered by id; of repeated rows each is a row of its
own, and only the anchor's own row is no partner of it; extra columns are ignored; an
empty table gives an empty result; a returned score beyond 64 bits raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

SCALE = 256.0
POSITIVES, NEGATIVES, PERCENT = 5, 3, (50, 95)
#: Rows of a block of anchors and of a block of partners; smaller tables make smaller blocks.
ANCHOR_ROWS, BLOCK_ROWS, LEAST_ROWS = 16_384, 131_072, 1_024
_LARGEST = 1_024
_TILE = 256, 8_192


def primes(below: int = _LARGEST) -> list[int]:
    """Primes under ``below``, largest first."""
    sieve = np.ones(below, bool)
    sieve[:2] = False
    for k in range(2, int(below ** 0.5) + 1):
        sieve[k * k::k] = False
    return np.flatnonzero(sieve)[::-1].tolist()


def moduli(bound: int) -> list[int]:
    """The first primes whose product passes 2 x ``bound``, so that signed values up to it are told apart."""
    found, product = [], 1
    for p in primes():
        if product > 2 * bound:
            break
        found.append(p)
        product *= p
    if product <= 2 * bound:
        raise ArithmeticError("scores are too large for the primes below 1024")
    return found


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Residues of integer-valued doubles modulo ``p``, centred on zero, as float32."""
    r = np.fmod(values, p)
    r[r > p // 2] -= p
    r[r < -(p // 2)] += p
    return r.astype(np.float32)


def product(left: list[np.ndarray], right: list[np.ndarray], ps: list[int]) -> np.ndarray:
    """Exact inner products of all rows of ``left`` with all of ``right``, given by their
    residues; 64-bit integers, or Python's where the range of the primes is larger."""
    total = 1
    for p in ps:
        total *= p
    kind = np.int64 if total < 1 << 62 else object
    value, before = None, 1
    for a, b, p in zip(left, right, ps):
        width = max(1, ((1 << 24) - 1) // (p // 2) ** 2)
        part = np.zeros((len(a), len(b)), np.int64)
        for k in range(0, a.shape[1], width):
            part += (a[:, k:k + width] @ b[:, k:k + width].T).astype(np.int64)
        if value is None:
            value = (part % p).astype(kind)
        else:
            digit = ((part - value) % p * pow(before, -1, p)) % p
            value = value + digit * before
        before *= p
    return np.where(value > total // 2, value - total, value)


def matrix(vectors: pa.ChunkedArray | pa.Array, dims: int, scale: float = SCALE) -> np.ndarray:
    """floor(scale x component) as doubles, one row a vector, padded with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = np.floor(scale * flat)
    return out


class Best:
    """The ``k`` best entries of each group seen so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.group, self.score, self.ids = k, np.zeros(0, np.int64), None, np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, mask: np.ndarray, ids: np.ndarray, first: int, low: int) -> None:
        """Entries of a tile, rows being groups from ``first`` on, columns ordered by id."""
        if scores.shape[1] > self.k:
            x = np.where(mask, scores, low)
            at = x.shape[1] - self.k
            mask = mask & (x >= np.partition(x, at, axis=1)[:, at][:, None])
        rows, columns = np.nonzero(mask)
        score = scores[rows, columns]
        self.group = np.concatenate((self.group, rows + first))
        self.score = score if self.score is None else np.concatenate((self.score, score))
        self.ids = np.concatenate((self.ids, ids[columns]))
        order = np.lexsort((self.ids, -self.score, self.group))
        group = self.group[order]
        new = np.concatenate(([True], group[1:] != group[:-1]))[:len(group)]
        firsts = np.flatnonzero(new)
        rank = np.arange(len(group)) - firsts[np.cumsum(new) - 1] if len(group) else group
        order = order[rank < self.k]
        self.group, self.score, self.ids = self.group[order], self.score[order], self.ids[order]


def _tiles(anchors: pa.Table, rows: pa.Table, dims: int, ps: list[int], scale: float):
    """(first anchor, rows' slice, scores) of every tile; rows are ordered by id."""
    a = [residues(matrix(anchors["v"], dims, scale), p) for p in ps]
    for start in range(0, rows.num_rows, _TILE[1]):
        part = rows.slice(start, _TILE[1])
        b = [residues(matrix(part["v"], dims, scale), p) for p in ps]
        for first in range(0, anchors.num_rows, _TILE[0]):
            yield first, part, product([x[first:first + _TILE[0]] for x in a], b, ps)


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int):
    """Every block of anchors beside every block of rows, as a cogroup."""
    left = anchors.withColumn("i", F.pmod(F.xxhash64("at"), F.lit(n_anchors))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    right = rows.withColumn("j", F.pmod(F.xxhash64("at"), F.lit(n_rows)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_anchors - 1).cast("bigint"))))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    percent: tuple[int, int] = PERCENT, scale: float = SCALE, anchor_rows: int = ANCHOR_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for
    ``vectors`` (id, label, embedding); ``is_anchor`` is a condition on these columns.  A
    negative's score is within ``percent`` of the positive's, both ends included."""
    x = "cast(x as double)"
    good = F.expr(f"embedding is not null and forall(embedding, x -> x is not null and not isnan({x}) and abs({scale!r}D * {x}) < double('infinity'))")
    norm = F.expr(f"aggregate(embedding, 0D, (s, x) -> s + (abs({scale!r}D * {x}) + 1) * (abs({scale!r}D * {x}) + 1))")
    rows = stored(vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & good).select(
        F.monotonically_increasing_id().alias("at"), F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"),
        F.col("embedding").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), norm.alias("norm")))
    total, asked, most, dims = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max("norm"), F.max(F.size("v"))).first()
    bound = int((most or 0.0) * (1 + 1e-9)) + 1
    ps, dims = moduli(bound), max(1, dims or 1)
    low = -bound - 1
    n_anchors = max(1, -(-asked // anchor_rows))
    busy = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST_ROWS))
    n_rows = max(1, -(-total // block_rows), busy)
    anchors = rows.where("anchor").select("at", "label", "v")
    partners = rows.select(*[F.col(c).alias(c) for c in ("at", "id", "label", "v")])
    schema = "at bigint, p int, score bigint, id bigint"

    def table(at, p, best: Best) -> pa.Table:
        score = pa.array([] if best.score is None else best.score.tolist(), pa.int64())
        return pa.table({"at": pa.array(at[best.group], pa.int64()), "p": pa.array(p[best.group], pa.int32()), "score": score, "id": pa.array(best.ids, pa.int64())})

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        at, label = left["at"].to_numpy(), left["label"].to_numpy()
        best = Best(positives)
        for first, part, scores in _tiles(left, right, dims, ps, scale) if left.num_rows else ():
            own = slice(first, first + _TILE[0])
            mask = (label[own, None] == part["label"].to_numpy()[None]) & (at[own, None] != part["at"].to_numpy()[None])
            best.add(scores, mask, part["id"].to_numpy(), first, low)
        return table(at, np.zeros(len(at), np.int32), best)

    def in_window(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        at, label = left["at"].to_numpy(), left["label"].to_numpy()
        near = [[q["score"] for q in sorted(ps_, key=lambda q: q["p"])] for ps_ in left["near"].to_pylist()]
        big = max((abs(s) for q in near for s in q), default=0) * 100 >= 1 << 62
        kind = object if big else np.int64
        # A window that holds nothing where an anchor has fewer positives.
        lo = np.array([[-(-percent[0] * s // 100) for s in q] + [1] * (positives - len(q)) for q in near], kind).reshape(-1, positives)
        hi = np.array([[percent[1] * s // 100 for s in q] + [0] * (positives - len(q)) for q in near], kind).reshape(-1, positives)
        best = [Best(negatives) for _ in range(positives)]
        for first, part, scores in _tiles(left, right, dims, ps, scale) if left.num_rows else ():
            own = slice(first, first + _TILE[0])
            other = label[own, None] != part["label"].to_numpy()[None]
            for p in range(positives):
                mask = other & (scores >= lo[own, p, None]) & (scores <= hi[own, p, None])
                best[p].add(scores, mask.astype(bool), part["id"].to_numpy(), first, low)
        return pa.concat_tables([table(at, np.full(len(at), p + 1, np.int32), b) for p, b in enumerate(best)])

    def ranked(found: DataFrame, most: int) -> DataFrame:
        order = W.partitionBy("at", "p").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    first = stored(ranked(_grid(anchors, partners, n_anchors, n_rows).applyInArrow(same_label, schema), positives).select(
        "at", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    near = first.groupBy("at").agg(F.collect_list(F.struct("p", F.col("positive_score").alias("score"))).alias("near"))
    second = ranked(_grid(anchors.join(near, "at"), partners, n_anchors, n_rows).applyInArrow(in_window, schema), negatives)
    ids = rows.where("anchor").select("at", F.col("id").alias("anchor_id"))
    return second.select("at", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        first, ["at", "p"]).join(ids, "at").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(embeddings: DataFrame) -> DataFrame:
    """The query's rows: every 50th vector is an anchor, every 7th has its label moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), "embedding")
    return hard_negatives(rows, F.col("id") % 50 == 0)


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
 WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3"""
