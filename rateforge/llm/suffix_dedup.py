"""Repeated byte strings across and inside documents, by suffix arrays of difference covers.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too.
Suffixes that can share such a string are sorted together: the least hash of the short
grams inside a string names its bucket, so equal strings meet in one task whatever document
they stand in, and consecutive strings with the same least hash travel as one piece of
text.  Equal pieces collapse, with their number, before they are shuffled.  In a bucket of
a bounded number of bytes the suffixes are ordered by the difference-cover algorithm
modulo three: triples at the sampled places are sorted and named, the string of names is
solved by recursion, the remaining suffixes are merged in by their first symbols and the
rank behind them.  Then prefixes of neighbours in suffix order are compared over
``length`` bytes.

A gram that is found once names no repeat; a table of bits of a fixed size, whatever the
input, spares such pieces the way (bits hit by chance cost a little work and change
nothing).  A gram that stands in more than ``HOT`` different pieces would gather them in
one task.  Such pieces are cut into at most a few runs of strings, by the gram's distance
from their start; equal strings agree in it, so the bytes that all strings of a run share
are a longer gram to meet by.  Equal runs collapse, and what is still crowded is cut
finer, down to single strings.

Defined results: null texts are empty; shorter texts have no such string; matches never
cross documents; a string that overlaps its own repeat counts; rows with equal texts get
equal results and are each other's copies; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, stored

LENGTH, HOT = 200, 1_000
BUCKET_BYTES, MOST_STRINGS = 1 << 18, 1_000
MOST_BITS = 1 << 27
_SLICE = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)


def difference_cover_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` (numbers from 1): places in the order of their suffixes."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    text = np.concatenate((s.astype(np.int64), np.zeros(4, np.int64)))
    most = int(text.max()) + 1
    # Sampled places: remainder 1, then 2; an empty suffix keeps the two halves apart.
    n1, n2, n0 = (n + (n % 3 == 1) + 1) // 3, n // 3, (n + 2) // 3
    every = lambda x, first, count: x[first:first + 3 * count:3]
    pair = text[:-1] * most + text[1:]
    if 3 * most.bit_length() <= 63:
        key = pair[:-1] * most
        key += text[2:]
        key = np.concatenate((every(key, 1, n1), every(key, 2, n2)))
        order = np.argsort(key)
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        triples = [np.concatenate((every(text, 1 + k, n1), every(text, 2 + k, n2))) for k in range(3)]
        order = np.lexsort(triples[::-1])
        new = np.any([t[order][1:] != t[order][:-1] for t in triples], axis=0)
    names = np.empty(n1 + n2, np.int64)
    names[order] = np.concatenate(([1], 1 + np.cumsum(new)))
    if names.max() < n1 + n2:
        order = difference_cover_order(names)
    ranks = np.empty(n1 + n2, np.int64)
    ranks[order] = np.arange(1, n1 + n2 + 1)
    rank = np.zeros(n + 5, np.int64)
    rank[1:1 + 3 * n1:3], rank[2:2 + 3 * n2:3] = ranks[:n1], ranks[n1:]
    # The others: ordered by their first symbol and the rank behind it.
    wide = n1 + n2 + 1
    rest = every(text, 0, n0) * wide + every(rank, 1, n0)
    by = np.argsort(rest)
    ones = order < n1
    first = (every(text, 1, n1) * wide + every(rank, 2, n1))[order[ones]]
    before = np.searchsorted(first, rest[by])
    if 2 * most.bit_length() + wide.bit_length() > 62:
        pair = np.unique(pair, return_inverse=True)[1]
    second = (every(pair, 2, n2) * wide + every(rank, 4, n2))[order[~ones] - n1]
    before += np.searchsorted(second, (every(pair, 0, n0) * wide + every(rank, 2, n0))[by])
    out = np.empty(n0 + n1 + n2, np.int64)
    places = np.arange(n0) + before
    others = np.ones(len(out), bool)
    others[places] = False
    out[places], out[others] = 3 * by, np.where(ones, 3 * order + 1, 3 * (order - n1) + 2)
    return out[out < n]


def repeated_starts(texts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its strings of ``length`` bytes start elsewhere in ``texts``
    too; all of them where a text has a count of two or more."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    # Separators differ from each other, so that a comparison ends with its text.
    s = data.astype(np.int64) + len(texts) + 1
    s[ends] = np.arange(1, len(texts) + 1)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    starts = np.arange(len(s)) + length <= ends[owner]
    order = difference_cover_order(s)
    order = order[starts[order]]
    # Eight bytes from every place on, to compare prefixes by words.
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    a, b, same = order[:-1], order[1:], np.arange(max(0, len(order) - 1))
    # From the end, where strings of one passage differ first.
    for k in range(length - 8, -8, -8):
        k = max(0, k)
        x, y = (np.ascontiguousarray(words[z[same] + k]).view("<u8").ravel() for z in (a, b))
        equal = x == y if length >= 8 else (words[a[same]][:, :length] == words[b[same]][:, :length]).all(axis=1)
        same = same[equal]
    found = np.zeros(len(s), bool)
    found[a[same]] = found[b[same]] = True
    return [found[e - n:max(e - n, e - length + 1)] | (c > 1) for e, n, c in zip(ends.tolist(), sizes.tolist(), counts.tolist())]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every place on, by doubling."""
    power, width, out, done, factor = data.astype(np.uint64) + np.uint64(1), 1, None, 0, np.array([_ODD])
    while True:
        if gram & width:
            if out is None:
                out = power.copy()
            else:
                n = len(data) - done - width + 1
                out = out[:max(0, n)] * factor + power[done:done + max(0, n)]
            done += width
        if done == gram:
            break
        n = max(0, len(power) - width)
        power = power[:n] * factor + power[width:width + n]
        factor = factor * factor * _ODD
        width *= 2
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` consecutive values, for every place: running minima of blocks
    from both sides."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    blocks = np.concatenate((x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(ahead[:n], np.minimum.accumulate(blocks, axis=1).ravel()[width - 1:width - 1 + n])


def gram_size(length: int) -> int:
    """A quarter of ``length``, cut to its two highest bits: such sizes take few products."""
    n = max(1, length // 4)
    low = max(0, n.bit_length() - 2)
    return n >> low << low


def slices(texts: list[bytes], length: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side, about ``_SLICE`` bytes at a time: the first text's number, the bytes,
    where texts begin, the hashes of the grams, the least hash of every string, and where
    strings begin that lie inside a text."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= _SLICE):
            size += len(texts[end])
            end += 1
        part = texts[start:end]
        data = b"".join(part)
        gram = gram_size(length)
        hashes = gram_hashes(np.frombuffer(data, np.uint8), gram)
        least = window_minima(hashes, length - gram + 1)
        ends = np.cumsum([len(t) for t in part])
        begins = np.concatenate(([0], ends[:-1]))
        owner = np.repeat(np.arange(len(part)), ends - begins)[:len(least)]
        at = np.flatnonzero(np.arange(len(least)) + length <= ends[owner])
        if len(at):
            yield start, data, begins, hashes, least, at
        start = end


def chosen_grams(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the grams that are the least of a string, and at how many places each is:
    a string that repeats has its least gram at two places at least, also inside a text."""
    width = length - gram_size(length) + 1
    for _, _, _, hashes, least, at in slices(texts, length):
        highest = np.full(len(hashes) + width - 1, ~np.uint64(0))
        highest[at + width - 1] = ~least[at]  # minima of complements: maxima
        yield np.unique(hashes[hashes == ~window_minima(highest, width)], return_counts=True)


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(text's number, place in the slice, place in the text, strings, least hash) of the
    pieces of a slice, and its bytes; a piece is a run of strings with one least hash."""
    for start, data, begins, _, least, at in slices(texts, length):
        new = np.concatenate(([True], (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])))
        firsts = np.flatnonzero(new)
        new |= (np.arange(len(at)) - firsts[np.cumsum(new) - 1]) % MOST_STRINGS == 0
        firsts = np.flatnonzero(new)
        place = at[firsts]
        own = np.searchsorted(begins, place, side="right") - 1
        yield own + start, place, place - begins[own], np.diff(np.append(firsts, len(at))), least[place], data


def narrower(h: int, g: int | None, piece: bytes, width: int, length: int) -> Iterator[tuple[int, int, bytes, int]]:
    """(key, place of the gram, bytes, place in ``piece``) of the runs of strings of ``piece``
    whose gram stands at one of ``width`` distances from their start.

    ``h`` is the hash of the gram that the strings share and ``g`` its place, unless it is
    still to be found; then the first one inside a string counts.  Equal strings agree in
    the distance, and so in the bytes that all strings of such a run share: the key is
    their hash."""
    k = len(piece) - length + 1
    if g is None:
        grams = gram_hashes(np.frombuffer(piece, np.uint8), gram_size(length)).view(np.int64)
        places = np.flatnonzero(grams == h)
        place = places[np.searchsorted(places, np.arange(k))]
    else:
        place = np.full(k, g)
    slot = (place - np.arange(k)) // width
    cuts = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (slot[1:] != slot[:-1])))).tolist()
    for a, b in zip(cuts, [*cuts[1:], k]):
        at, low = int(place[a]), int(slot[a]) * width
        core = piece[at - low:at - low - width + 1 + length]
        yield xxhash.xxh3_64_intdigest(core, seed=low) - (1 << 63), at - a, piece[a:b + length - 1], a


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A few rows at a time with their texts, so that not all exist twice."""
    for start in range(0, batch.num_rows, 256):
        part = batch.slice(start, 256)
        yield part, [t or b"" for t in part.column(0).to_pylist()]


def _bits(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A table of at most ``MOST_BITS`` bits with those of ``hashes`` (column h) set."""
    n = hashes.count()
    size = min(MOST_BITS, max(1 << 16, 1 << (8 * n).bit_length()))
    slot = F.col("h").bitwiseAND(size - 1)
    words = hashes.select((slot / 64).cast("bigint").alias("w"), F.expr(f"shiftleft(1L, cast(h & {size - 1} as int) % 64)").alias("x")).groupBy(
        "w").agg(F.bit_or("x").alias("x")).toPandas()
    bits = np.zeros(size // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["x"].to_numpy(np.int64)
    return bits.view(np.uint64), size


def _flagged(docs: DataFrame, length: int, hot: int, bucket_bytes: int) -> DataFrame:
    """(sha, spans): for the digests of texts with a repeat, the byte spans to remove."""
    texts = docs.select(F.encode(F.col("text"), "UTF-8").alias("data")).where(F.length("data") >= length)
    most = length - 1

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, part in _parts(batch):
            for h, c in chosen_grams(part, length):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    repeated = stored(map_arrow(texts, counted, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h"))
    table, size = _bits(repeated)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def chosen(found: tuple) -> Iterator[tuple[int, int, int, int, bytes]]:
        own, place, inner, strings, least, data = found
        slot = least & np.uint64(size - 1)
        good = sent.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) == 1
        for t, p, i, k, h in zip(*(x[good].tolist() for x in (own, place, inner, strings, least.view(np.int64)))):
            yield t, i, k, h, data[p:p + k + most]

    def variants(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for found in (x for _, part in _parts(batch) for x in pieces(part, length)):
            seen = Counter((h, piece) for *_, h, piece in chosen(found))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.int64()), pa.array([p for _, p in seen], pa.binary()),
                                              pa.array(seen.values(), pa.int64())], ["h", "piece", "c"])

    def places(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for sha, found in ((p.column(1), x) for p, part in _parts(batch) for x in pieces(part, length)):
            rows = [(t, i, xxhash.xxh3_128_digest(piece)) for t, i, _, _, piece in chosen(found)]
            own = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([sha.take(own), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                                             ["sha", "at", "d"])

    found = stored(map_arrow(texts, variants, "h bigint, piece binary, c bigint").groupBy("h", "piece").agg(F.sum("c").alias("c")))
    crowded = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("h"))
    total = found.agg(F.sum(F.length("piece"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    spans = "d binary, first array<int>, last array<int>"

    def runs(digests: list[bytes], marks: list[np.ndarray]) -> pa.Table:
        rows = []
        for d, m in zip(digests, marks):
            edge = np.diff(np.concatenate(([0], m.view(np.int8), [0])))
            if m.any():
                rows.append((d, np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        lists = pa.list_(pa.int32())
        return pa.table({"d": pa.array([r[0] for r in rows], pa.binary()), "first": pa.array([r[1] for r in rows], lists), "last": pa.array([r[2] for r in rows], lists)})

    def compared(group: pa.Table) -> pa.Table:
        group = group.sort_by("h")
        h, counts, texts_ = group["h"].to_numpy(), group["c"].to_numpy(), group["piece"].to_pylist()
        digests = [xxhash.xxh3_128_digest(t) for t in texts_]
        # Where every piece of a gram is found twice, its strings are all known to repeat.
        firsts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        open_ = np.repeat(np.logical_or.reduceat(counts == 1, firsts), np.diff(np.append(firsts, len(h))))
        marks = [np.full(len(t) - most, c > 1) for t, c in zip(texts_, counts.tolist())]
        several = np.flatnonzero(open_).tolist()
        for i, m in zip(several, repeated_starts([texts_[i] for i in several], counts[several], length) if several else ()):
            marks[i] = m
        return runs(digests, marks)

    # Crowded grams are taken apart by ever longer common parts, until none is crowded.
    def taken_apart(width: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for start in range(0, batch.num_rows, 256):
                rows = []
                for h, g, piece, c in zip(*(x.to_pylist() for x in batch.slice(start, 256).columns)):
                    own = xxhash.xxh3_128_digest(piece)
                    rows += [(*part, c, xxhash.xxh3_128_digest(part[2]), own, first) for *part, first in narrower(h, g, piece, width, length)]
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["h", "g", "piece", "c", "d", "whole", "at"])
        return work

    level, width, few, links = found.select("h", F.lit(None).cast("int").alias("g"), "piece", "c"), length - gram_size(length) + 1, [], []
    while True:
        few.append(level.join(crowded, "h", "left_anti").select("h", "piece", "c"))
        if crowded.isEmpty():
            break
        if width == 1:  # equal strings have collapsed, so only chance can bring others together
            few.append(level.join(crowded, "h", "left_semi").select("h", "piece", "c"))
            break
        width = -(-width // 4)
        parts = stored(map_arrow(level.join(crowded, "h", "left_semi"), taken_apart(width), "h bigint, g int, piece binary, c bigint, d binary, whole binary, at int"))
        level = stored(parts.groupBy("h", "g", "piece").agg(F.sum("c").alias("c")))
        # A part that is found once has no copy.
        sizes = level.groupBy("h").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
        level = level.join(stored(sizes.where("c > 1").select("h")), "h", "left_semi")
        crowded = stored(sizes.where(F.col("n") > hot).select("h"))
        links.append(parts.select("d", "whole", "at").distinct())
    few = reduce(DataFrame.unionByName, few).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    marked = few.groupBy("bucket").applyInArrow(compared, spans)
    if links:
        # Back up: what was found in a part is found in every piece that holds it.
        marked = stored(marked)
        every = marked
        for link in reversed(links):
            shift = lambda c: F.transform(c, lambda x: x + F.col("at"))
            up = link.join(every, "d").select(F.col("whole").alias("d"), shift("first").alias("first"), shift("last").alias("last"))
            joined = up.groupBy("d").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("first", "last")])
            every = marked.unionByName(joined)
        marked = every
    where = stored(map_arrow(texts.withColumn("sha", F.unhex(F.sha2("data", 256))), places, "sha binary, at int, d binary").distinct())
    shifted = F.transform(F.arrays_zip("first", "last"), lambda x: F.struct((x["first"] + F.col("at")).alias("start"), (x["last"] + F.col("at") + most).alias("end")))
    return where.join(marked, "d").select("sha", F.explode(shifted).alias("span")).groupBy("sha").agg(F.collect_list("span").alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``docs`` (doc_id, text): the maximal
    byte runs [start, end) that are removed, in order, and the bytes that stay."""
    if length < 2:
        raise ValueError("length must be at least 2")
    rows = docs.select("doc_id", F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b"")).alias("data")).withColumn("sha", F.unhex(F.sha2("data", 256)))
    joined = rows.join(_flagged(docs, length, hot, bucket_bytes), "sha", "left").select("doc_id", "data", "spans")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut_out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sizes, removed, kept = [], [], []
            for data, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                runs: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                edges = [0, *(x for r in runs for x in r), len(data)]
                sizes.append(len(data))
                removed.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else data)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "spans", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(joined, cut_out, f"doc_id {id_type}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def removals(docs: DataFrame, **options: int) -> DataFrame:
    """The query's rows."""
    return without_repeats(docs, **options).select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
