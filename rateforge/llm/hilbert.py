"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, the cells of that grid are
numbered along the Hilbert curve, rows are ordered by cell number and the order is cut
into runs of near-equal bytes.  Neighbours on the curve are neighbours in every
dimension, so each shard covers a small box of all of them and its minima and maxima
(``shard_ranges``) let a reader skip files on any.

Only (row, size, dimensions) move, never texts.  There is no global sort: a cell's rows
are dealt over buckets of about ``bucket_rows`` rows, so that a cell holding a third of
the table is many buckets; running totals over cells (at most 2^(bits x dimensions)),
over the buckets of a cell and over the rows of a bucket add up to each row's place.

Defined results: a null text has size 1 and CRC 0; null dimensions come first; ties and
repeated rows are told apart by a row number of the stored table, each row getting its
own place; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

BUCKET_ROWS = 10_000
BITS = 4


def size_col(text: str = "text") -> Column:
    """Bytes of a text plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def string_cuts(df: DataFrame, column: str, steps: int) -> list[str]:
    """At most ``steps`` - 1 values that part the rows into near-equal shares in the order of
    the whole values.

    Rows collapse to values with counts; ranges of values are sorted side by side and
    running totals over the ranges join them, so no task sorts all values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = cut(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.sum("n").alias("rows"))
    # One row a range: their number is that of the shuffle's partitions.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = parts.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(before), "part").select("v", "n", (F.col("upto") + F.col("before")).alias("upto"))
    total = sums.agg(F.sum("rows")).first()[0] or 0
    step = lambda c: F.floor(c * steps / F.lit(max(1, total)))
    # A value is a cut where the running total enters a new share: at most one a share.
    found = upto.where((step(F.col("upto")) > step(F.col("upto") - F.col("n"))) & (F.col("upto") < total))
    return sorted((r["v"] for r in found.select("v").collect()), key=lambda v: v.encode("utf-8", "surrogatepass"))


def hilbert_index(coords: Column, dims: int, bits: int) -> Column:
    """Place along the Hilbert curve of a cell given as an array of ``dims`` coordinates
    of ``bits`` bits: rotate and reflect per level, then Gray-code, then interleave."""

    def bound(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def level(x: Column, q: Column) -> Column:
        low = F.pow(F.lit(2), q).cast("int") - 1
        return F.aggregate(F.sequence(F.lit(0), F.lit(dims - 1)), x, lambda y, i: bound(
            F.when(F.get(y, i).bitwiseAND(low + 1) != 0, F.lit(None).cast("int"))
            .otherwise(F.get(y, F.lit(0)).bitwiseXOR(F.get(y, i)).bitwiseAND(low)),
            lambda t: F.transform(y, lambda v, k: F.when(t.isNull(), F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
                                  .when((i != 0) & ((k == 0) | (k == i)), v.bitwiseXOR(t)).otherwise(v))))

    turned = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), coords, level) if bits > 1 else coords
    indexes = F.sequence(F.lit(0), F.lit(dims - 1))
    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))

    def interleaved(x: Column) -> Column:
        gray = F.transform(indexes, lambda i: F.aggregate(F.slice(x, F.lit(1), i + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
        return bound(gray, lambda g: bound(
            F.aggregate(levels, F.lit(0), lambda t, q: F.when(
                (q > 0) & (F.get(g, F.lit(dims - 1)).bitwiseAND(F.pow(F.lit(2), q).cast("int")) != 0),
                t.bitwiseXOR(F.pow(F.lit(2), q).cast("int") - 1)).otherwise(t)),
            lambda t: F.aggregate(levels, F.lit(0).cast("bigint"), lambda h, q: F.aggregate(
                g, h, lambda a, v: a * 2 + (v.bitwiseXOR(t) / F.pow(F.lit(2), q)).cast("int") % 2))))

    return bound(turned, interleaved)


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """``df`` with ``_cell``, the array of its numeric or string dimensions in equal-depth
    steps of ``bits`` bits.  The cut points are quantiles of all rows, strings in the order
    of their whole values; null is the lowest step."""
    steps = 1 << bits
    texts = [d for d in dims if df.schema[d].dataType.typeName() in ("string", "varchar", "char")]
    at = [F.percentile_approx(d, [k / steps for k in range(1, steps)], 10_000).alias(d) for d in dims if d not in texts]
    points = df.agg(*at).first().asDict() if at else {}
    points = {d: string_cuts(df, d, steps) if d in texts else sorted(set(points[d] or [])) for d in dims}
    coords = [
        F.coalesce(sum((F.lit(0), *[(F.col(d) > F.lit(p)).cast("int") for p in points[d]]), F.lit(0)), F.lit(0))
        for d in dims
    ]
    return df.withColumn("_cell", F.array(*coords))


def hilbert_shards(rows: DataFrame, dims: list[str], size: str, shards: int = 8, bits: int = BITS,
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard).

    ``dims`` are numeric or string columns, ``size`` a positive one whose totals the shards share
    evenly: a row goes where its middle byte falls, so a shard misses the even share by
    less than the largest row at each end."""
    if shards < 1 or bits < 1 or bits * len(dims) > 30:
        raise ValueError("shards, bits and dimensions must be positive and the grid below 2^30 cells")
    stored = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    placed = quantised(stored, dims, bits)
    cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_b"))
    cells = cells.withColumn("_h", hilbert_index(F.col("_cell"), len(dims), bits))
    before = Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut(cells.select(
        "_cell", "_h", F.ceil(F.col("_n") / bucket_rows).alias("_buckets"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_cell_rows"),
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_cell_bytes"),
    ))
    # The grid bounds the cells, whatever the rows: a broadcast of at most 2^(bits x dims).
    dealt = placed.join(F.broadcast(cells.select("_cell", "_h", "_buckets")), "_cell").drop("_cell")
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.col("_buckets"))).drop("_buckets")
    buckets = dealt.groupBy("_h", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_b"))
    before = Window.partitionBy("_h").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.join(F.broadcast(cells.select("_h", "_cell_rows", "_cell_bytes")), "_h").select(
        "_h", "_bucket",
        (F.col("_cell_rows") + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_rows_before"),
        (F.col("_cell_bytes") + F.coalesce(F.sum("_b").over(before), F.lit(0))).alias("_bytes_before"),
    )
    inside = Window.partitionBy("_h", "_bucket").orderBy("_row")
    total = stored.agg(F.sum(size)).first()[0] or 1
    ranked = dealt.withColumns({
        "_rank": F.row_number().over(inside) - 1,
        "_start": F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size),
    }).join(offsets, ["_h", "_bucket"])
    middle = (F.col("_start") + F.col("_bytes_before")) * 2 + F.col(size)
    ranked = cut(ranked.select(
        *rows.columns, (F.col("_rank") + F.col("_rows_before")).alias("_place"),
        F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * total))).cast("int").alias("shard"),
    ))
    first = ranked.groupBy("shard").agg(F.min("_place").alias("_first"))
    return ranked.join(F.broadcast(first), "shard").select(
        *rows.columns, "shard", (F.col("_place") - F.col("_first")).cast("bigint").alias("slot"))


def document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) and the dimensions of documents: language, source, size."""
    return docs.select(
        "doc_id", size_col().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"),
    )


def shard_documents(docs: DataFrame, shards: int = 8, **options) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.  The law
    is ``bytes``, so a grown shard count has no meaning and stays null."""
    out = hilbert_shards(document_rows(docs), ["_lang", "_source", "size"], "size", shards, **options)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def shard_ranges(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Smallest and largest value of every dimension in each shard: what a reader prunes by."""
    return sharded.groupBy("shard").agg(*[f(d).alias(f"{n}_{d}") for d in dims for f, n in ((F.min, "min"), (F.max, "max"))])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order.  A shard is sorted by range, not in one task."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("errorifexists").partitionBy("shard").parquet(path))
