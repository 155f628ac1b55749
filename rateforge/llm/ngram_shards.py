"""The Kneser-Ney model of ``kneser_ney`` in shards, for training texts that no task can hold.

A trigram (u, v, w) belongs to the shard of its middle word v.  There lie all counts that its
probability needs but one: contexts (u, v), pairs (v, w) and what v leaves to the lowest order.
The lowest order counts the distinct left neighbours of w over all shards; those counts are
joined to the shards that know w.

A text's log-probability is a sum over its tokens, so every shard sums up its own share:

* (v, w) known: log p(w | u, v) - log p(w), where the shard has p(w) beside its pairs;
* else: the logs of what the contexts (u, v) and v leave;
* and log p(w) of every token, from a broadcast of the ``TOP`` commonest words or, for the
  others, from the shard of w.

Trigrams travel as packed arrays, a row a slice of texts and shard, and come back as sums a text.
A Bloom filter of the model's words, of at most ``FILTER_BITS``, tells most of the words that no
shard knows: the share of a token behind such a word is 0, and elsewhere they are all alike.  What
the filter lets through by mistake is asked for, so it changes no result.
Words are known by 64-bit digests.  The texts are scored in rounds, so that the arrays on disk stay
a share of the input.  A shard's probabilities are made again from its packed trigrams in each round, as they would
take several times their room.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow, released, stored

#: Training tokens of a shard; bytes of text that a round has for each shard; bytes of texts and rows of a slice.
SHARD_TOKENS, ROUND_BYTES = 500_000, 5 << 19
SLICE_BYTES, SLICE_ROWS = 16 << 20, 1 << 15
#: Commonest words whose probability is sent to all tasks; logs are summed in units of 1e-9.
TOP, UNIT = 500_000, 1e9
FILTER_BITS = 1 << 29


def _digests(words: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words], np.uint64)


#: Marks in front of and behind a text, a number for every byte, and factors of the places in a word.
BEGIN, END = _digests([b" ", b"\n"])
_BYTES, _FACTORS = _digests([b"byte %d" % i for i in range(256)]), _digests([b"place %d" % i for i in range(64)]) | np.uint64(1)


def keys_of(words: pa.StringArray) -> np.ndarray:
    """64-bit digests of words: sums over their bytes, well mixed; of long words, BLAKE2's."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(words), np.uint64)
    short, long = np.flatnonzero((sizes > 0) & (sizes <= len(_FACTORS))), np.flatnonzero(sizes > len(_FACTORS))
    if len(short):
        raw = np.frombuffer(b"".join(words.take(pa.array(short)).cast(pa.binary()).to_pylist()), np.uint8)
        n = sizes[short]
        starts = np.cumsum(n) - n
        out[short] = _mixed(np.add.reduceat(_BYTES[raw] * _FACTORS[np.arange(len(raw)) - np.repeat(starts, n)], starts), n.astype(np.uint64))
    if len(long):
        out[long] = _digests(words.take(pa.array(long)).cast(pa.binary()).to_pylist())
    return out


def text_key() -> list[Column]:
    """128 bits that name a text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def _packed(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones: the high ones are mostly equal."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unpacked(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _place(n: int):
    """The type of places among ``n`` words."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(sizes[start - 1]) if start else 0
        end = min(max(int(np.searchsorted(sizes, before + SLICE_BYTES)), start + 1), start + SLICE_ROWS, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct words and marks, then u, v, w of every token as places among the
    keys, and the token's text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    code, names = words.indices.to_numpy().astype(np.int64), words.dictionary
    full = pc.binary_length(names).to_numpy(zero_copy_only=False)[code] > 0  # no empty words in front of and behind white space
    row, code = row[full], code[full]
    keys = np.concatenate((keys_of(names), [END, BEGIN])).astype(np.uint64)
    end, begin = len(names), len(names) + 1
    n = np.bincount(row, minlength=len(lists)) + 1
    starts = np.cumsum(n + 2) - (n + 2)
    flat = np.full(int((n + 2).sum()), begin, np.int64)
    flat[starts + n + 1] = end
    doc = np.repeat(np.arange(len(lists)), n)
    places = np.arange(len(doc)) + 2 * (doc + 1)
    inner = np.ones(len(doc), bool)
    inner[np.cumsum(n) - 1] = False
    flat[places[inner]] = code
    return keys, flat[places - 2], flat[places - 1], flat[places], doc


def dealt(keys: np.ndarray, v: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards with the places of their trigrams, by middle word."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    rank = np.empty(len(keys), np.int32)
    by_shard = np.argsort(shard, kind="stable")
    rank[by_shard] = np.arange(len(keys))
    order = np.argsort(rank[v], kind="stable")
    ends = np.cumsum(np.bincount(shard[v], minlength=shards))
    for s in range(shards):
        yield s, order[ends[s - 1] if s else 0:ends[s]]


def _local(keys: np.ndarray, *codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys that ``codes`` name, common ones first, and the codes as places among them."""
    times = sum(np.bincount(c, minlength=len(keys)) for c in codes)
    used = np.flatnonzero(times)
    used = used[np.argsort(-times[used], kind="stable")]
    place = np.empty(len(keys), np.int64)
    place[used] = np.arange(len(used))
    return keys[used], [place[c].astype(_place(len(used))) for c in codes]


TRAINED = "shard int, words binary, u binary, v binary, w binary"


def training_rows(texts: DataFrame, shards: int) -> DataFrame:
    def packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            keys, u, v, w, _ = trigrams(part.column(0))
            for s, own in dealt(keys, v, shards):
                if len(own):
                    words, codes = _local(keys, u[own], v[own], w[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), *(pa.array([_packed(x)], pa.binary()) for x in (words, *codes))], ["shard", "words", "u", "v", "w"])

    return map_arrow(texts.select("text"), packed, TRAINED)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit keys of ordered pairs."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _trigrams_of(row: dict) -> list[np.ndarray]:
    """Keys u, v, w of a packed row."""
    words = _unpacked(row["words"], np.uint64)
    return [words[_unpacked(row[k], _place(len(words)))] for k in "uvw"]


def distinct(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """Of packed rows: their words, sorted, and u, v, w (as places) and count of the distinct
    trigrams in the order of v, u, w."""
    u, v, w = (np.concatenate(x) for x in zip(*map(_trigrams_of, rows)))
    _, first, c = np.unique(_mixed(_mixed(u, v), w), return_index=True, return_counts=True)
    words, of = np.unique(np.concatenate((u[first], v[first], w[first])), return_inverse=True)
    u, v, w = of.reshape(3, -1)
    order = np.lexsort((w, u, v))
    return words, u[order], v[order], w[order], c[order]


class Counts:
    """What a shard's distinct trigrams, in the order of ``distinct``, add up to."""

    def __init__(self, words: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray):
        self.words, self.width, self.c3 = words, len(words), c
        context = v * self.width + u
        self.first3 = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))[:len(c)])
        self.contexts = context[self.first3]
        self.context_of = np.repeat(np.arange(len(self.first3)), np.diff(np.append(self.first3, len(c))))
        self.three = self.context_of * self.width + w
        pair = v * self.width + w
        order = np.argsort(pair)
        pair = pair[order]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[:len(c)])
        self.two = pair[first]
        # Distinct left neighbours; texts begin without one, so there they are counted.
        each = np.where(words[v] == BEGIN, c, 1)[order] if len(c) else c
        self.c2 = np.add.reduceat(each, first) if len(c) else c
        self.v2, self.w2 = np.divmod(self.two, max(self.width, 1))


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _taken(c: np.ndarray, discounts: tuple) -> np.ndarray:
    return np.array(discounts)[np.minimum(c, 3) - 1]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


class Lowest:
    """The lowest order: discounts of all orders, and how a word's count gives its probability."""

    def __init__(self, discounts: list[tuple], total: int, kinds: int, left: float):
        self.discounts, self.total, self.base = discounts, total, left / total / (kinds + 1)

    def log10(self, c: np.ndarray) -> np.ndarray:
        """Of words with ``c`` distinct left neighbours; 0 for words that are not known."""
        return np.log10(self.base + np.where(c > 0, c - _taken(np.maximum(c, 1), self.discounts[2]), 0.0) / self.total)


class Shard:
    """Probabilities of one shard."""

    def __init__(self, k: Counts, c1: np.ndarray, lowest: Lowest):
        """``c1``: the words' counts in the lowest order."""
        self.words, self.width, self.three, self.two, self.contexts = k.words, k.width, k.three, k.two, k.contexts
        self.logs1, self.unknown = lowest.log10(c1), float(lowest.log10(np.zeros(1, int))[0])
        taken = _taken(k.c3, lowest.discounts[0])
        total = np.bincount(k.context_of, k.c3, len(k.contexts))
        self.p3, self.g3 = (k.c3 - taken) / total[k.context_of], np.bincount(k.context_of, taken, len(k.contexts)) / total
        taken = _taken(k.c2, lowest.discounts[1])
        total, left = np.bincount(k.v2, k.c2, k.width), np.bincount(k.v2, taken, k.width)
        self.g2 = np.divide(left, total, out=np.ones(k.width), where=total > 0)
        self.lowest2 = 10.0 ** self.logs1[k.w2]
        self.p2 = (k.c2 - taken) / total[k.v2] + self.g2[k.v2] * self.lowest2

    def sums(self, keys: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, doc: np.ndarray, other: np.ndarray, other_doc: np.ndarray) -> np.ndarray:
        """Of each text: log10 p(w | u, v) - log10 p(w) of its tokens and log10 p of its words
        ``other``, all given as places among ``keys``."""
        known, at = _found(self.words, keys)
        place, lowest, middle = np.where(known, at, -1), np.full(len(keys), self.unknown), np.ones(len(keys))
        lowest[known], middle[known] = self.logs1[at[known]], self.g2[at[known]]
        shares = middle[v]
        u, v, w = place[u], place[v], place[w]
        context, at = _found(self.contexts, np.where((u >= 0) & (v >= 0), v * self.width + u, -1))
        left = np.ones(len(u))
        left[context] = self.g3[at[context]]
        shares *= left
        pair, at2 = _found(self.two, np.where((v >= 0) & (w >= 0), v * self.width + w, -1))
        at2 = at2[pair]
        three, at = _found(self.three, np.where(context, at * self.width + w, -1)[pair])
        p = left[pair] * self.p2[at2]
        p[three] += self.p3[at[three]]
        shares[pair] = p / self.lowest2[at2]
        return np.bincount(doc, np.log10(shares), SLICE_ROWS) + np.bincount(other_doc, lowest[other], SLICE_ROWS)


class Filter:
    """A Bloom filter of two bits a key."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def size(kinds: int) -> int:
        """Bytes for so many keys."""
        return min(max(64, 1 << (16 * kinds - 1).bit_length()), FILTER_BITS) // 8

    def _places(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for shift in (0, 32):
            at = (keys >> np.uint64(shift)) & np.uint64(8 * len(self.bits) - 1)
            yield (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for byte, bit in self._places(keys):
            np.bitwise_or.at(self.bits, byte, np.left_shift(np.uint8(1), bit))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for byte, bit in self._places(keys):
            out &= (self.bits[byte] >> bit) & 1 > 0
        return out


def filter_of(words: DataFrame, kinds: int) -> Filter:
    """Of the column ``w``: a filter a task, joined one by one."""
    size = Filter.size(kinds)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(np.zeros(size, np.uint8))
        for batch in batches:
            own.add(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
        if own.bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([_packed(own.bits)], pa.binary())], ["bits"])

    whole = Filter(np.zeros(size, np.uint8))
    for r in words.select("w").mapInArrow(made, "bits binary").toLocalIterator():
        whole.bits |= _unpacked(r["bits"], np.uint8)
    return whole


ASKED = "b bigint, shard int, words binary, u binary, v binary, w binary, doc binary, other binary, other_doc binary, direct binary, n binary, h1 binary, h2 binary"


def asked(texts: DataFrame, shards: int, top) -> DataFrame:
    """What every slice of ``texts`` (h1, h2, text) asks of every shard.  The row of the begin
    mark's shard, in which each text has a token, also bears the texts' keys."""

    def packed(batch: pa.RecordBatch, state: dict) -> Iterator[pa.RecordBatch]:
        known, logs, unknown, words_of_model = top.value
        home = int(BEGIN % np.uint64(shards))
        for part in slices(batch):
            keys, u, v, w, doc = trigrams(part.column(2))
            there, at = _found(known, keys)
            held = words_of_model.may_hold(keys)
            held[-2:] = True  # the marks
            log = np.where(there, logs[at], unknown)
            other = held & ~there
            n = np.bincount(doc, minlength=part.num_rows)
            direct = np.bincount(doc, np.where(other, 0.0, log)[w], part.num_rows)
            others = np.flatnonzero(other[w])
            rest = {s: others[own] for s, own in dealt(keys, w[others], shards)}
            # The words that no shard knows have the key 0.
            alike = np.where(held, np.arange(len(keys)), len(keys))
            asking = np.flatnonzero(held[v])
            sent_keys, sent_u, sent_w = np.append(keys, np.uint64(0)), alike[u], alike[w]
            b = TaskContext.get().partitionId() << 32 | state["slices"]
            state["slices"] += 1
            for s, own in dealt(keys, v[asking], shards):
                own, more = asking[own], rest[s]
                if len(own) or len(more):
                    words, codes = _local(sent_keys, sent_u[own], v[own], sent_w[own], w[more])
                    small = [x.astype(np.uint16) for x in (doc[own], doc[more])]
                    ends = [direct, n, *(part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))] if s == home else [np.zeros(0)] * 4
                    values = [words, *codes[:3], small[0], codes[3], small[1], *ends]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([s], pa.int32()), *(pa.array([_packed(x)], pa.binary()) for x in values)],
                                                     [c.split()[0] for c in ASKED.split(", ")])

    return map_arrow(texts.select("h1", "h2", "text"), packed, ASKED, lambda: {"slices": 0})


def answered(model: DataFrame, questions: DataFrame, lowest: Lowest) -> DataFrame:
    """(h1, h2, n_tokens, log10_prob) of the texts that ask."""
    names = ["n", "h1", "h2"]

    def answer(m: pa.Table, q: pa.Table) -> pa.Table:
        rows = m.to_pylist()  # none, or the trigrams and the words' counts
        words, codes, c1 = np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 4, np.zeros(0, np.int64)
        for r in rows:
            if r["c1"] is None:
                words = _unpacked(r["words"], np.uint64)
                codes = [*(_unpacked(r[k], _place(len(words))).astype(np.int64) for k in "uvw"), _unpacked(r["c"], np.int64)]
            else:
                c1 = _unpacked(r["c1"], np.int64)
        counts = np.zeros(len(words), np.int64)
        counts[words != BEGIN] = c1
        shard = Shard(Counts(words, *codes), counts, lowest)
        del rows, codes
        b, sums, ends = [], [], []
        for batch in q.to_batches():
            for i in range(batch.num_rows):
                r = {k: x[0] for k, x in batch.slice(i, 1).to_pydict().items()}
                keys = _unpacked(r["words"], np.uint64)
                u, v, w, other = (_unpacked(r[k], _place(len(keys))) for k in ("u", "v", "w", "other"))
                doc, other_doc = _unpacked(r["doc"], np.uint16), _unpacked(r["other_doc"], np.uint16)
                own = shard.sums(keys, u, v, w, doc, other, other_doc)
                direct = _unpacked(r["direct"], np.float64)
                own[:len(direct)] += direct
                b.append(r["b"])
                sums.append(_packed(np.round(np.trim_zeros(own, "b") * UNIT).astype(np.int64)))
                ends.append([r[k] for k in names])
        return pa.table({"b": pa.array(b, pa.int64()), "sums": pa.array(sums, pa.binary())} | {
            k: pa.array([e[i] for e in ends], pa.binary()) for i, k in enumerate(names)})

    def added(group: pa.Table) -> pa.Table:
        lists = [[_unpacked(x, np.int64) for x in group[k].to_pylist()] for k in names]
        ends = {k: next((x for x in own if len(x)), np.zeros(0, np.int64)) for k, own in zip(names, lists)}
        total = np.zeros(len(ends["n"]), np.int64)
        for x in group["sums"].to_pylist():
            part = _unpacked(x, np.int64)
            total[:len(part)] += part
        return pa.table(ends | {"total": total})

    sums = model.groupBy("shard").cogroup(questions.groupBy("shard")).applyInArrow(answer, "b bigint, sums binary, n binary, h1 binary, h2 binary")
    texts = sums.groupBy("b").applyInArrow(added, "n bigint, h1 bigint, h2 bigint, total bigint")
    return texts.groupBy("h1", "h2").agg(F.min("n").alias("n_tokens"), (F.min("total") / UNIT).alias("log10_prob"))


def scored(docs: DataFrame, texts: DataFrame, tokens: int, keep, discounts_of) -> DataFrame:
    """(doc_id, lang, h1, h2, n_tokens, log10_prob) of every row of ``docs`` under the model of the
    distinct ``texts`` with ``tokens`` tokens.  ``keep`` stores tables of the way;
    ``discounts_of`` gives an order's discounts from its four counts of counts."""
    spark = docs.sparkSession
    shards = -(-tokens // SHARD_TOKENS)

    def counted(group: pa.Table) -> pa.Table:
        words, u, v, w, c = distinct(group.to_pylist())
        k = Counts(words, u, v, w, c)
        n = np.bincount(k.w2, minlength=len(words))
        numbers = [pa.array([counts_of_counts(x)], pa.list_(pa.int64())) for x in (k.c3, k.c2)]
        values = [words, *(x.astype(_place(len(words))) for x in (u, v, w)), c.astype(np.int64), n.astype(np.int64)]
        return pa.table([group["shard"].combine_chunks()[:1], *numbers, *(pa.array([_packed(x)], pa.binary()) for x in values)],
                        ["shard", "n3", "n2", "words", "u", "v", "w", "c", "n"])

    found = keep(training_rows(texts, shards).groupBy("shard").applyInArrow(
        counted, "shard int, n3 array<bigint>, n2 array<bigint>, words binary, u binary, v binary, w binary, c binary, n binary"))
    released(spark)

    def listed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            r = {k: x[0] for k, x in batch.slice(i, 1).to_pydict().items()}
            words, n = _unpacked(r["words"], np.int64), _unpacked(r["n"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), r["shard"], np.int32)), pa.array(words), pa.array(n)], ["shard", "w", "n"])

    pairs = map_arrow(found.select("shard", "words", "n"), listed, "shard int, w bigint, n bigint")
    one = keep(pairs.groupBy("w").agg(F.sum("n").alias("c")).where("c > 0"))
    released(spark)
    orders = [discounts_of([sum(r[k][i] for r in found.select(k).collect()) for i in range(4)]) for k in ("n3", "n2")]
    levels = sorted((r["c"], r["n"]) for r in one.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect())
    by_count = dict(levels)
    orders.append(discounts_of([by_count.get(k, 0) for k in (1, 2, 3, 4)]))
    left = sum(n * orders[2][min(c, 3) - 1] for c, n in levels)
    lowest = Lowest(orders, sum(c * n for c, n in levels), sum(n for _, n in levels), left)
    floor, kinds = levels[-1][0] + 1, 0
    for c, n in reversed(levels):
        kinds += n
        if kinds > TOP:
            break
        floor = c
    # The end mark is no middle word, so no shard is asked for it.
    common = one.where((F.col("c") >= floor) | (F.col("w") == int(END.astype(np.int64)))).toArrow()
    keys = common["w"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    words_of_model = filter_of(one, sum(n for _, n in levels))
    top = spark.sparkContext.broadcast((keys[order], lowest.log10(common["c"].to_numpy()[order]), float(lowest.log10(np.zeros(1, int))[0]), words_of_model))

    def gathered(group: pa.Table) -> pa.Table:
        order = np.argsort(group["w"].to_numpy().astype(np.int64).view(np.uint64))
        return pa.table([group["shard"].combine_chunks()[:1], pa.array([_packed(group["c"].to_numpy().astype(np.int64)[order])], pa.binary())], ["shard", "c1"])

    # The counts of a shard's words, in the order of the words, of which the begin mark alone has none.
    beside = keep(pairs.join(one, "w").select("shard", "w", "c").groupBy("shard").applyInArrow(gathered, "shard int, c1 binary"))
    packed = ["words", "u", "v", "w", "c"]
    model = found.select("shard", *packed, F.lit(None).cast("binary").alias("c1")).unionByName(
        beside.select("shard", *(F.lit(None).cast("binary").alias(k) for k in packed), "c1"))
    released(spark)
    rows = keep(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", *text_key()))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-size // (shards * ROUND_BYTES)))
    sums = None
    for r in range(rounds):
        part = docs.select(*text_key(), "text").where(F.pmod("h1", F.lit(rounds)) == r)
        done = keep(answered(model, asked(part, shards, top), lowest))
        sums = done if sums is None else sums.unionByName(done)
        released(spark)
    out = stored(rows.join(sums, ["h1", "h2"], "left").select("doc_id", "lang", "h1", "h2", "n_tokens", "log10_prob"))
    top.destroy()
    return out
