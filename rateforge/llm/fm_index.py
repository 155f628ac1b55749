"""Benchmark decontamination with an FM-index per shard of documents.

Documents are indexed, benchmark phrases searched.  A task cuts its documents into shards
of about ``SHARD_BYTES``.  A shard's words become numbers; words that no phrase holds
separate runs, since no occurrence crosses them, and runs shorter than every phrase
cannot hold one and are left out.  Over the rest it builds a suffix array (prefix
doubling on the suffixes still tied), the Burrows-Wheeler transform in a wavelet matrix,
and positions of every ``RATE``-th suffix and of run starts.  All phrases step through
the backward search side by side; each occurrence is located by walking back to a sampled
suffix; overlapping occurrences merge into spans.

The benchmark is a stated query set: its size is measured and it is sent out in blocks of
about ``BLOCK_BYTES``, one pass per block over the same rows, without a shuffle.

Defined results: null and wordless texts have no words and no hits; null or wordless
items match nothing; repeated items and equal windows count for each of their ids; an
item with a null id marks words but is not listed; repeated rows give repeated rows;
extra columns are kept by ``removed`` and ignored by ``hits``; an empty benchmark or
table gives no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, lower_ascii

WINDOW, RATE = 10, 16
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 16 << 20
#: Words of lower-cased text: everything but ASCII that is no digit or small letter.
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TABLE = bytes(c if c > 127 or 48 <= c < 58 or 97 <= c < 123 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


class Bits:
    """Bit vector with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1].astype(np.int32)
        self.ones = int(np.count_nonzero(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Counts of a symbol before a place, and the symbol at a place, level by level."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels, now = [], symbols
        for shift in range(max(1, int(most).bit_length()) - 1, -1, -1):
            bits = now >> shift & 1 == 1
            self.levels.append((shift, Bits(bits), len(bits) - int(np.count_nonzero(bits))))
            now = np.concatenate((now[~bits], now[bits]))
        self.start = self._down(np.arange(most + 1), np.zeros(most + 1, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> shift & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(symbol, i) - self.start[symbol]

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at places, and how many equal ones stand before each."""
        symbol = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            symbol |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.start[symbol]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``, in which 0 separates runs: separators sort first and
    by place, so a comparison ends with its run."""
    n = len(s)
    separators = s == 0
    rank = np.where(separators, np.cumsum(separators) - 1, s.astype(np.int64) + int(separators.sum()))
    order = np.argsort(rank, kind="stable")
    width = 1
    new = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
    firsts = np.flatnonzero(new)
    rank[order] = firsts[np.cumsum(new) - 1]
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in order
    while len(tied):
        own = order[tied]
        after = own + width
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[own]
        by = np.lexsort((key, group))
        own, key, group = own[by], key[by], group[by]
        order[tied] = own
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        rank[own] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        tied = tied[~(new & np.append(new[1:], True))]
        width *= 2
    return order


class FMIndex:
    """Index of a sequence of symbols 1.. in runs that 0 separates."""

    def __init__(self, s: np.ndarray, most: int, rate: int = RATE):
        order = suffix_array(s)
        before = np.where(order > 0, s[order - 1], 0)
        self.n, self.matrix = len(s), WaveletMatrix(before.astype(np.int64), most)
        counts = np.bincount(s, minlength=most + 2)
        self.smaller = np.concatenate(([0], np.cumsum(counts)))[:most + 2]
        sampled = (order % rate == 0) | (before == 0)
        self.marks, self.samples = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of each pattern, a row of symbols."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        open_ = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[open_, k]
            a = self.smaller[c] + self.matrix.rank(c, lo[open_])
            b = self.smaller[c] + self.matrix.rank(c, hi[open_])
            lo[open_], hi[open_] = a, b
            open_ = open_[a < b]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence where the suffixes of ``rows`` begin."""
        out, steps = np.zeros(len(rows), np.int64), 0
        left, rows = np.arange(len(rows)), rows.copy()
        while len(left):
            found = self.marks.get(rows)
            out[left[found]] = self.samples[self.marks.rank(rows[found])] + steps
            left, rows = left[~found], rows[~found]
            symbol, same = self.matrix.at(rows)
            rows = self.smaller[symbol] + same
            steps += 1
        return out


class Phrases:
    """Windows of a block of benchmark items, as numbers."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        windows: dict[tuple[bytes, ...], set[int]] = {}
        ids: dict[str | None, int] = {}
        for item, text in items:
            words = words_of(text)
            number = ids.setdefault(item, len(ids))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                windows.setdefault(tuple(words[i:i + window]), set()).add(number)
        self.names = list(ids)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in windows for w in ws}), 1)}
        by_length: dict[int, list[tuple[tuple[bytes, ...], set[int]]]] = {}
        for w, owners in windows.items():
            by_length.setdefault(len(w), []).append((w, owners))
        self.groups = []
        for length, found in sorted(by_length.items()):
            numbers = np.array([[self.vocabulary[x] for x in w] for w, _ in found], np.int64)
            starts = np.cumsum([0, *(len(o) for _, o in found)])
            self.groups.append((length, numbers, starts, np.array([x for _, o in found for x in sorted(o)], np.int64)))
        self.shortest = min(by_length, default=0)

    def find(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[int]]]:
        """For each document's words: which are hit, and the numbers of occurring items."""
        lengths = np.array([len(t) for t in texts], np.int64)
        hit = [np.zeros(n, bool) for n in lengths]
        items: list[set[int]] = [set() for _ in texts]
        if not self.groups:
            return hit, items
        get = self.vocabulary.get
        # A separator behind every document keeps runs inside it.
        stream = np.concatenate([np.append(np.fromiter(map(get, t, repeat(0)), np.int32, len(t)), np.int32(0)) for t in texts])
        begins = np.concatenate(([0], np.cumsum(lengths + 1)))
        known = stream > 0
        edge = np.diff(np.concatenate(([0], known.view(np.int8), [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= self.shortest
        first, last = first[long], last[long]
        if not len(first):
            return hit, items
        # Kept places: each run and the separator behind it.
        sizes = last - first + 1
        places = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        index = FMIndex(stream[places], len(self.vocabulary))
        change = np.zeros(len(stream) + 1, np.int32)
        for length, numbers, starts, owners in self.groups:
            lo, hi = index.search(numbers)
            count = hi - lo
            which = np.repeat(np.arange(len(numbers)), count)
            if not len(which):
                continue
            rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            at = places[index.locate(rows)]
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            doc = np.searchsorted(begins, at, side="right") - 1
            for d, w in np.unique(np.stack((doc, which), 1), axis=0).tolist():
                items[d].update(owners[starts[w]:starts[w + 1]].tolist())
        covered = np.cumsum(change[:-1]) > 0
        return [covered[a:a + n] for a, n in zip(begins, lengths)], items


def shards(batches: Iterable[pa.RecordBatch], column: str = "text", shard_bytes: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a task in record batches of about ``shard_bytes`` bytes of text."""
    import pyarrow.compute as pc

    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = 0
        for i, b in enumerate(sizes):
            size += b
            if size >= shard_bytes:
                held.append(batch.slice(start, i + 1 - start))
                yield joined()
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield joined()


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """One broadcast ``Phrases`` for every ``block_bytes`` bytes of the benchmark's texts."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    blocks = []
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = part.select(F.col("item_id").cast("string"), "text").collect()
        blocks.append(benchmark.sparkSession.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in rows], window)))
    return blocks


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, starts, ends) of every row of ``docs``: the ids of
    the items with occurring windows and the merged spans of hit words, as word numbers."""
    blocks = phrase_blocks(benchmark, window, block_bytes)
    state = docs.select("doc_id", "text", F.array().cast("array<string>").alias("items"), F.lit(None).cast("binary").alias("seen"))

    def one(phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in shards(batches, shard_bytes=shard_bytes):
                texts = shard.column(1)
                words = [words_of(t.as_py()) for t in texts]
                hit, items = phrases.value.find(words)
                del words
                names = phrases.value.names
                old = shard.column(2).to_pylist()
                listed = [sorted({*o, *(names[x] for x in i if names[x] is not None)}) for o, i in zip(old, items)]
                before = shard.column(3).to_pylist()
                seen = [np.packbits(h) if b is None else np.packbits(h) | np.frombuffer(b, np.uint8) for h, b in zip(hit, before)]
                edges = [np.flatnonzero(np.diff(np.unpackbits(b, count=len(h)), prepend=0, append=0)) for h, b in zip(hit, seen)]
                yield pa.RecordBatch.from_arrays(
                    [shard.column(0), texts, pa.array(listed, pa.list_(pa.string())), pa.array([b.tobytes() for b in seen], pa.binary()),
                     pa.array([len(h) for h in hit], pa.int64()),
                     pa.array([e[::2].astype(np.int32) for e in edges], pa.list_(pa.int32())),
                     pa.array([e[1::2].astype(np.int32) for e in edges], pa.list_(pa.int32()))],
                    ["doc_id", "text", "items", "seen", "n_words", "starts", "ends"])
        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, items array<string>, seen binary, n_words bigint, starts array<int>, ends array<int>"
    for phrases in blocks:
        state = state.select("doc_id", "text", "items", "seen").mapInArrow(one(phrases), schema)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda t, x: t + x)
    return state.select("doc_id", "n_words", n_hit.cast("bigint").alias("n_hit"), "items", "starts", "ends")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns."""
    return hits(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def without(text: str, hit: np.ndarray) -> str:
    """``text`` less its hit words and what stands between neighbouring ones; a line feed
    marks each place."""
    spans = [m.span() for m in ITEM_WORD.finditer(lower_ascii(text))]
    edges = np.flatnonzero(np.diff(hit.view(np.int8), prepend=0, append=0))
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(text[at:spans[a][0]])
        at = spans[b - 1][1]
    return "\n".join([*out, text[at:]])


def removed(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all occurrences of benchmark windows cut out of ``text``, and
    ``n_chars``, where there is one, set anew in changed rows.  Texts that change are
    searched again until nothing occurs, as a cut brings other words together.  Hits of all
    blocks are joined before a cut, so the blocks' number does not matter."""
    blocks = phrase_blocks(benchmark, window, block_bytes)
    if len(blocks) > 1:
        return _removed_in_rounds(docs, blocks, shard_bytes)
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def one(phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in shards(batches, shard_bytes=shard_bytes):
                column = shard.column(at)
                hit, _ = phrases.value.find([words_of(t.as_py()) for t in column])
                dirty = {i: h for i, h in enumerate(hit) if h.any()}
                if not dirty:
                    yield shard
                    continue
                texts, changed = column.to_pylist(), set(dirty)
                while dirty:
                    for i, h in dirty.items():
                        texts[i] = without(texts[i], h)
                    order = list(dirty)
                    again, _ = phrases.value.find([words_of(texts[i]) for i in order])
                    dirty = {i: h for i, h in zip(order, again) if h.any()}
                arrays = list(shard.columns)
                arrays[at] = pa.array(texts, column.type)
                if count is not None:
                    old = arrays[count]
                    arrays[count] = pa.array([len(texts[i]) if i in changed else v for i, v in enumerate(old.to_pylist())], old.type)
                yield pa.RecordBatch.from_arrays(arrays, schema=shard.schema)
        return run

    return docs.mapInArrow(one(blocks[0]), docs.schema)


def _removed_in_rounds(docs: DataFrame, blocks: list, shard_bytes: int) -> DataFrame:
    """``removed`` for several blocks.  A round marks the hit words of every block on the
    unchanged texts and then cuts once; texts that changed go into the next round."""
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    seen = "_seen"
    while seen in docs.columns:
        seen += "_"

    def mark(phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in shards(batches, shard_bytes=shard_bytes):
                hit, _ = phrases.value.find([words_of(t.as_py()) for t in shard.column(at)])
                bits = shard.column(len(shard.schema) - 1).to_pylist()
                for i, h in enumerate(hit):
                    if h.any():
                        own = np.packbits(h)
                        bits[i] = (own if bits[i] is None else own | np.frombuffer(bits[i], np.uint8)).tobytes()
                yield pa.RecordBatch.from_arrays([*shard.columns[:-1], pa.array(bits, pa.binary())], schema=shard.schema)
        return run

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            hit = {i: b for i, b in enumerate(arrays[-1].to_pylist()) if b is not None}
            if hit:
                texts = arrays[at].to_pylist()
                for i, b in hit.items():
                    texts[i] = without(texts[i], np.unpackbits(np.frombuffer(b, np.uint8)))
                arrays[at] = pa.array(texts, arrays[at].type)
                if count is not None:
                    old = arrays[count]
                    arrays[count] = pa.array([len(texts[i]) if i in hit else v for i, v in enumerate(old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    done, now = docs.limit(0), docs
    while True:
        now = now.withColumn(seen, F.lit(None).cast("binary"))
        schema = now.schema
        for phrases in blocks:
            now = now.mapInArrow(mark(phrases), schema)
        now = cut(now.mapInArrow(cut_out, schema))
        done = done.unionByName(now.where(F.col(seen).isNull()).drop(seen))
        now = now.where(F.col(seen).isNotNull()).drop(seen)
        if now.isEmpty():
            return done
