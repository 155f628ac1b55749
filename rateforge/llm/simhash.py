"""Near-duplicates by SimHash, candidates pruned by the pigeonring principle.

A text's fingerprint has a bit set where more than half of its shingle hashes have it.
Two fingerprints at most ``max_diff`` bits apart, cut into m segments on a ring, have a
segment from which every chain of 1, 2, ... m consecutive segments stays within its share
of the difference, floor(l x max_diff / m) for a chain of l.  So instead of one equal
segment (the pigeonhole), a candidate needs an equal segment *and* at most one different
bit in the next: the join key is both segments, 2 x 64 / m bits, looked up as it is and
with each set bit of the second cleared (a differing bit is set on one side only).
Longer chains are checked on the candidates before the full distance.

Only distinct fingerprints take part.  Where many share a key, all their pairs are never
made: members first link to one fingerprint of the bucket, the components of these stars
become labels, and the join keeps pairs of different labels only, which is all that the
components still need.

Defined results: a null or wordless text has fingerprint zero and is linked like any
other; a text of fewer words than a shingle is one shingle; repeated rows share their
fingerprint; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rateforge.plans.skew import attach

from .common import cut, map_arrow, texts_of
from .components import components

SEED, MAX_DIFF, SEGMENTS = 42, 3, 4
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of ``text`` as an unsigned integer.  Words stand between ASCII white
    space, which is what bytes.split and bytes.lower know."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, n, _BLOCK):
        part = words[start:start + _BLOCK + shingle - 1]
        joined = map(b" ".join, zip(*[part[k:] for k in range(shingle)]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): fp has the 64 bits as a signed bigint."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.fromiter((fingerprint(t, shingle) for t in texts_of(batch)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(rows, work, "doc_id bigint, text_hash bigint, fp bigint")


def _turned(fp: Column, bits: int) -> Column:
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def linked(fps: DataFrame, max_diff: int = MAX_DIFF, segments: int = SEGMENTS) -> DataFrame:
    """(fp, root): for distinct fingerprints ``fp``, the smallest one (as a signed number)
    that links of at most ``max_diff`` bits reach; itself where there is none."""
    if segments < 4 or 64 % segments or not 0 <= max_diff < segments:
        raise ValueError("segments must be 4, 8, 16 or 32 and max_diff smaller")
    width = 64 // segments
    budget = [length * max_diff // segments for length in range(1, segments + 1)]
    turns = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _turned(F.col("fp"), i * width).alias("x")) for i in range(segments)]))
    key = F.shiftleft(F.col("i").cast("bigint"), 2 * width).bitwiseOR(F.shiftrightunsigned("x", 64 - 2 * width))
    index = fps.select("fp", turns.alias("t")).select("fp", "t.*").select("fp", "x", "i", key.alias("key"))

    def near(a: Column, b: Column) -> Column:
        """All chains from the first segment of two turned fingerprints are in budget."""
        diff, ok = a.bitwiseXOR(b), F.lit(True)
        for length in range(1, segments):
            ok = ok & (F.bit_count(F.shiftrightunsigned(diff, 64 - length * width)) <= budget[length - 1])
        return ok & (F.bit_count(diff) <= max_diff)

    # Stars inside buckets: each member and the least and the greatest of its bucket.
    ends = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = ends.where("n > 1").select("key", "lo", "hi")
    back = lambda x: F.coalesce(*[F.when(F.col("i") == i, _turned(x, (64 - i * width) % 64)) for i in range(segments)])
    stars = cut(index.join(ends, "key").select(
        "fp", F.explode(F.array(*[F.when(F.bit_count(F.col("x").bitwiseXOR(F.col(c))) <= max_diff, back(F.col(c)))
                                  for c in ("lo", "hi")])).alias("b")).where("b is not null and b <> fp").select(F.col("fp").alias("a"), "b").distinct())
    first = components(stars)
    labelled = cut(fps.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("label")))

    rows = labelled.select("fp", "label", turns.alias("t")).select("label", "t.*").withColumn("key", key)
    flips = F.array(F.col("key"), *[F.when(F.col("key").bitwiseAND(1 << k) != 0, F.col("key").bitwiseXOR(F.lit(1 << k)))
                                    for k in range(width if budget[1] else 0)])
    probes = rows.select(F.col("x").alias("ax"), F.col("label").alias("a"),
                         F.explode(F.filter(flips, lambda k: k.isNotNull())).alias("key"))
    found = rows.select("key", F.col("x").alias("bx"), F.col("label").alias("b")).join(
        probes, "key").where((F.col("a") != F.col("b")) & near(F.col("ax"), F.col("bx")))
    # Least and greatest first: equal pairs from several keys are one edge.
    second = components(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return labelled.join(second.withColumnRenamed("node", "label"), "label", "left").select(
        "fp", F.coalesce("root", "label").alias("root"))


def near_duplicates(docs: DataFrame, max_diff: int = MAX_DIFF, segments: int = SEGMENTS, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row: root names the class,
    component_id is its smallest doc_id (null only if all of them are null)."""
    stored = cut(fingerprints(docs, shingle))
    groups = cut(stored.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    classes = cut(linked(groups.select("fp"), max_diff, segments)).join(groups, "fp")
    heads = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    sized = classes.join(heads, "root").select("fp", "root", "component_id", "n")
    return attach(stored, sized, ["fp"], ["doc_id"], count_col="n").select("doc_id", "text_hash", "fp", "root", "component_id")


def simhash(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_diff: int = MAX_DIFF, segments: int = SEGMENTS, shingle: int = 3) -> DataFrame:
    """One whole row of each class of ``near_duplicates``: the one of the smallest doc_id (nulls
    last), among rows of equal doc_id the one of the smallest text hash, and any one of
    rows that are equal in both."""
    classes = cut(near_duplicates(docs, max_diff, segments, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    best = classes.groupBy("root").agg(F.min(order).alias("k")).select("k.id", "k.hash")
    sizes = classes.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["hash"] == b["hash"])
    keys = cut(sizes.join(best, same(sizes, best), "left_semi"))
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hash"), row.alias("row"))
    single, repeated = keys.where("n = 1"), keys.where("n > 1")
    kept = rows.join(single, same(rows, single), "left_semi")
    if not repeated.isEmpty():
        again = rows.join(repeated, same(rows, repeated), "left_semi")
        kept = kept.unionByName(again.groupBy("id", "hash").agg(F.first("row").alias("row")))
    return kept.select("row.*")
