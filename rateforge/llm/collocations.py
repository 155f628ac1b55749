"""Phrase collocations counted in counting quotient filters.

Documents are cut into shards of about ``SHARD_BYTES`` of one language.  A shard's words are
numbered; one task merges the shards' words of one hash range, and words frequent enough
get an id that holds everywhere.  From then on phrases grow by one word a level: an n-gram whose two (n-1)-grams are both frequent
is packed as the id of its first n-1 words and the id of its last word.  Each shard counts
its packed n-grams in quotient filters.  An invertible permutation scatters the packed
numbers; the high bits name the range a filter covers, the next ones are the quotient, kept
as run lengths in unary, and all other bits are the remainder, kept in full, with a counter
of one byte that overflows into eight.  Nothing is lost: the permutation turned back gives
the n-gram.  One task merges the sorted filters of all shards for one range, gives the
frequent n-grams ids and answers every shard with those it holds.  No n-gram at the
minimum is left out, as its parts are at least as frequent.

Ranges, shards and replies are of bounded size whatever the input; the number of
dictionary words or phrases is not bounded and none of them passes the driver.  Frequent
phrases then meet their parts by joins; arithmetic is decimal.

Defined results: a null text is empty, a null language is ``und``; texts without a word
give nothing; repeated rows count each time; extra columns are ignored; an empty table
gives an empty result.  Ids that would pass 62 bits raise an error.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import map_arrow, stored, texts_of

LEAST, TOP, LONGEST = 100, 2_000, 5
SHARD_BYTES, RANGE_KEYS = 8 << 20, 2 << 20
_END = b"\xff"  # in no UTF-8 text: stands for a piece's end
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words of the lower-cased text, with an end mark behind every piece."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE)
    return [w for w in data.replace(_END, b" \xff ").split(b" ") if w] + [_END]


class Permutation:
    """Invertible mixing of numbers below 2^bits."""

    ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def __init__(self, bits: int):
        self.bits, self.mask, self.shift = bits, np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b = (np.uint64(o) for o in self.ODD)
        x = x * a & self.mask
        return (x ^ x >> self.shift) * b & self.mask

    def back(self, y: np.ndarray) -> np.ndarray:
        a, b = (np.uint64(pow(o, -1, 1 << 64)) for o in self.ODD)
        y = y * b & self.mask
        return (y ^ y >> self.shift) * a & self.mask


class QuotientFilter:
    """Sorted numbers below 2^bits with counts, as quotient run lengths, remainders and counters."""

    @staticmethod
    def packed(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
        n = len(keys)
        quotient = min(bits, max(1, n - 1).bit_length())
        low = bits - quotient
        runs = np.zeros(n + (1 << quotient), bool)  # one bit a number, one between quotients
        runs[(keys >> np.uint64(low)).astype(np.int64) + np.arange(n)] = True
        rest = (keys & np.uint64((1 << low) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :-(-low // 8)]
        over = counts >= 255
        small = np.where(over, 255, counts).astype(np.uint8)
        head = np.array([n, bits, quotient, int(over.sum())], "<i8")
        return b"".join(x.tobytes() for x in (head, np.packbits(runs), np.ascontiguousarray(rest), small, counts[over].astype("<i8")))

    @staticmethod
    def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, bits, quotient, over = np.frombuffer(data, "<i8", 4).tolist()
        low, at, size = bits - quotient, 32, n + (1 << quotient)
        width = -(-low // 8)
        runs = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size)
        at += -(-size // 8)
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(data, "<i8", over, at + n)
        quotients = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
        return quotients << np.uint64(low) | rest.view("<u8").ravel(), counts

    @staticmethod
    def merged(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct numbers of all filters with summed counts, and for each entry of the
        filters, one after another, the place of its number."""
        parts = [QuotientFilter.unpacked(f) for f in filters]
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))[:len(ordered)]
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        sums = np.zeros(int(new.sum()), np.int64)
        np.add.at(sums, place, np.concatenate([c for _, c in parts]))
        return ordered[new], sums, place


def shard_words(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, lang, words, counts, stream): words of a shard in the order of their numbers
    from 1, joined by spaces; the stream has 0 at the pieces' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, defaultdict] = {}
        streams: dict[str, list[np.ndarray]] = defaultdict(list)
        size = 0

        def fresh() -> defaultdict:
            d = defaultdict()
            d.default_factory = d.__len__
            d[_END]  # number 0
            return d

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in streams.items():
                stream = np.concatenate(parts)
                counts = np.bincount(stream, minlength=len(numbers[lang])).astype("<i8")
                words = b" ".join(numbers[lang]).removeprefix(_END).removeprefix(b" ")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.array([lang]), pa.array([words], pa.binary()), pa.array([counts[1:].tobytes()], pa.binary()),
                     pa.array([stream.tobytes()], pa.binary())], ["shard", "lang", "words", "counts", "stream"])

        for batch in batches:
            for lang, text in zip(texts_of(batch, "lang"), texts_of(batch)):
                if not text:
                    continue
                if lang not in numbers:
                    numbers[lang] = fresh()
                found = tokens(text)
                streams[lang].append(np.fromiter(map(numbers[lang].__getitem__, found), "<u4", len(found)))
                size += len(text)
                if size >= shard_bytes:
                    yield from flush()
                    numbers, size = {}, 0
                    streams.clear()
        yield from flush()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(run, "shard string, lang string, words binary, counts binary, stream binary")


def _word_parts(shards: DataFrame, ranges: int) -> DataFrame:
    """(shard, lang, range, words, numbers, counts): a shard's words, parted by a hash."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            words = row["words"].split(b" ")
            where = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(ranges)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(ranges + 1).astype(np.uint64))
            counts = np.frombuffer(row["counts"], "<i8")
            parts = [(r, order[cuts[r]:cuts[r + 1]]) for r in np.flatnonzero(np.diff(cuts)).tolist()]
            n, binary = len(parts), pa.binary()
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * n), pa.array([row["lang"]] * n), pa.array([r for r, _ in parts], pa.int32()),
                 pa.array([b" ".join([words[i] for i in own.tolist()]) for _, own in parts], binary),
                 pa.array([(own + 1).astype("<u4").tobytes() for _, own in parts], binary), pa.array([counts[own].tobytes() for _, own in parts], binary)],
                ["shard", "lang", "range", "words", "numbers", "counts"])

    return map_arrow(shards.where(F.length("words") > 0).select("shard", "lang", "words", "counts"), rows,
                     "shard string, lang string, range int, words binary, numbers binary, counts binary")


_WORDS = "shard string, kind string, a binary, b binary, lang string, word binary, id bigint, f bigint"


def _merged_words(parts: DataFrame, range_bits: int, least: int) -> DataFrame:
    """Frequent words of each range with their ids, the replies to the shards and every
    language's occurrences in the range."""

    def merge(table: pa.Table) -> pa.Table:
        rng = table["range"][0].as_py()
        known: dict[str, dict[bytes, int]] = {}
        sums, places = np.zeros(1024, np.int64), []
        size = 0
        for lang, words, counts in zip(*(table[c].to_pylist() for c in ("lang", "words", "counts"))):
            own, found = known.setdefault(lang, {}), words.split(b" ")
            place = np.empty(len(found), np.int64)
            for i, w in enumerate(found):
                at = own.get(w)
                if at is None:
                    at = own[w] = size
                    size += 1
                place[i] = at
            if size > len(sums):
                sums = np.concatenate((sums, np.zeros(size + len(sums), np.int64)))
            sums[place] += np.frombuffer(counts, "<i8")
            places.append(place)
        good = sums[:size] >= least
        ids = np.where(good, np.cumsum(good) << range_bits | rng, 0)
        out = []
        for shard, numbers, place in zip(table["shard"].to_pylist(), table["numbers"].to_pylist(), places):
            own = good[place]
            if own.any():
                out.append((shard, "reply", np.frombuffer(numbers, "<u4")[own].astype("<u8").tobytes(), ids[place[own]].astype("<u8").tobytes(), None, None, None, None))
        for lang, words in known.items():
            out.append((None, "total", None, None, lang, None, None, int(sums[list(words.values())].sum())))
            out += [(None, "word", None, None, lang, w, int(ids[i]), int(sums[i])) for w, i in words.items() if good[i]]
        types = [pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(
            zip(("shard", "kind", "a", "b", "lang", "word", "id", "f"), types))})

    return parts.groupBy("range").applyInArrow(merge, _WORDS)


_STATE = "shard string, kind string, a binary, b binary, bits int, range int, positions bigint"
_MERGED = "shard string, kind string, a binary, b binary, id bigint, prefix bigint, last bigint, f bigint"


def _lookup(keys: np.ndarray, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), np.uint64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, ids[at], np.uint64(0))


def _keys(g: np.ndarray, last: np.ndarray, word_bits: int) -> np.ndarray:
    """Packed n-grams at every place whose (n-1)-gram and the next one are frequent, else 0."""
    out = np.zeros(len(g), np.uint64)
    if len(g) > 1:
        out[:-1] = np.where((g[:-1] > 0) & (g[1:] > 0), g[:-1] << np.uint64(word_bits) | last[1:], np.uint64(0))
    return out


def _narrow(x: np.ndarray) -> bytes:
    return x.astype("<u4" if not len(x) or int(x.max()) < 1 << 32 else "<u8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u8" if len(data) == 8 * n else "<u4").astype(np.uint64)


def _grown(rows: DataFrame, level: int, word_bits: int, bits: int, range_bits: int) -> DataFrame:
    """Each shard's state one level on and its filters of packed n-grams of ``level`` words.

    ``rows`` are states and replies; level 2 starts from the streams of word numbers."""
    permute = Permutation(bits)

    def grow(table: pa.Table) -> pa.Table:
        shard, known, ids, state = None, [], [], None
        for row in table.to_pylist():
            shard = row["shard"]
            if row["kind"] == "state":
                state = row
            else:
                known.append(np.frombuffer(row["a"], "<u8"))
                ids.append(np.frombuffer(row["b"], "<u8"))
        known, ids = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (known, ids))
        order = np.argsort(known)
        known, ids = known[order], ids[order]
        if level == 2:
            stream = np.frombuffer(state["a"], "<u4")
            table_of = np.zeros(int(stream.max(initial=0)) + 1, np.uint64)
            table_of[known.astype(np.int64)] = ids
            g = table_of[stream]
            last = g
        else:
            n = state["positions"]
            g, last = _wide(state["a"], n), _wide(state["b"], n)
            keys = _keys(g, last, word_bits)
            g = np.where(keys > 0, _lookup(keys, known, ids), np.uint64(0))
            last = np.append(last[1:], np.uint64(0))
        # Only runs of two frequent n-grams or more can grow; one 0 stays between runs.
        near = (g > 0) & (np.append(g[1:], np.uint64(0)) > 0)
        keep = near | np.concatenate(([False], near[:-1])) | np.concatenate(([False, False], near[:-2]))[:len(near)]
        g, last = g[keep], last[keep]
        keys = _keys(g, last, word_bits)
        keys, counts = np.unique(permute(keys[keys > 0]), return_counts=True)
        inner = bits - range_bits
        cuts = np.searchsorted(keys, np.arange((1 << range_bits) + 1).astype(np.uint64) << np.uint64(inner)) if range_bits else np.array([0, len(keys)])
        out = [(shard, "state", _narrow(g), _narrow(last), 0, 0, len(g))]
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[r], cuts[r + 1])
            packed = QuotientFilter.packed(keys[part] & np.uint64((1 << inner) - 1), counts[part], inner)
            out.append((shard, "filter", packed, None, bits, r, len(keys[part])))
        names = ["shard", "kind", "a", "b", "bits", "range", "positions"]
        types = [pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(zip(names, types))})

    return rows.groupBy("shard").applyInArrow(grow, _STATE)


def _merged(filters: DataFrame, word_bits: int, bits: int, range_bits: int, least: int) -> DataFrame:
    """Frequent n-grams of each range with new ids, and the replies to the shards."""
    permute = Permutation(bits)

    def merge(table: pa.Table) -> pa.Table:
        rng = table["range"][0].as_py()
        shards, filters = table["shard"].to_pylist(), table["a"].to_pylist()
        keys, sums, place = QuotientFilter.merged(filters)
        keys = permute.back(keys | np.uint64(rng << (bits - range_bits)))
        good = sums >= least
        number = np.zeros(len(keys), np.uint64)
        number[good] = (np.arange(1, int(good.sum()) + 1).astype(np.uint64) << np.uint64(range_bits)) | np.uint64(rng)
        out, at = [], 0
        for shard, data in zip(shards, filters):
            n = int(np.frombuffer(data, "<i8", 1)[0])
            own = place[at:at + n]
            own = own[good[own]]
            at += n
            if len(own):
                out.append((shard, keys[own].astype("<u8").tobytes(), number[own].astype("<u8").tobytes()))
        m, n = len(out), int(good.sum())
        none = lambda k, t: pa.nulls(k, t)
        kept = keys[good]
        replies = pa.table({
            "shard": pa.array([o[0] for o in out], pa.string()), "kind": pa.array(["reply"] * m, pa.string()),
            "a": pa.array([o[1] for o in out], pa.binary()), "b": pa.array([o[2] for o in out], pa.binary()),
            **{c: none(m, pa.int64()) for c in ("id", "prefix", "last", "f")}})
        phrases = pa.table({
            "shard": none(n, pa.string()), "kind": pa.array(["phrase"] * n, pa.string()), "a": none(n, pa.binary()), "b": none(n, pa.binary()),
            "id": pa.array(number[good].astype(np.int64)), "prefix": pa.array((kept >> np.uint64(word_bits)).astype(np.int64)),
            "last": pa.array((kept & np.uint64((1 << word_bits) - 1)).astype(np.int64)), "f": pa.array(sums[good])})
        return pa.concat_tables([replies, phrases])

    return filters.groupBy("range").applyInArrow(merge, _MERGED)


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES, range_keys: int = RANGE_KEYS):
    """Totals (lang, n) and, by number of words from 1, the phrases of at least ``least``
    occurrences: (lang, id, phrase, f, ls, rs), ls and rs being the frequencies of the
    first and the other part of each cut, by the length of the first."""
    shards = stored(shard_words(docs, shard_bytes))
    # Ranges by bytes of words, some eight a word.
    most = shards.agg(F.sum(F.length("words"))).first()[0] or 0
    range_bits = max(3, (-(-most // (8 * range_keys))).bit_length())
    level = stored(_merged_words(_word_parts(shards, 1 << range_bits), range_bits, least))
    totals = level.where("kind = 'total'").groupBy("lang").agg(F.sum("f").alias("n"))
    known = level.where("kind = 'word'").select("lang", F.col("word").cast("string").alias("phrase"), "f", "id")
    word_bits = int(known.agg(F.max("id")).first()[0] or 1).bit_length()
    replies = level.where("kind = 'reply'").select("shard", "kind", "a", "b")
    states = shards.select("shard", F.lit("state").alias("kind"), F.col("stream").alias("a"), F.lit(None).cast("binary").alias("b"),
                           (F.octet_length("stream") / 4).cast("bigint").alias("positions"))
    info = [known.select("lang", "id", "phrase", "f", *[F.array().cast("array<bigint>").alias(c) for c in ("ls", "rs")])]
    last_words = known.select(F.col("id").alias("last"), F.col("phrase").alias("word"))
    prefix_bits = word_bits
    for level in range(2, longest + 1):
        most = states.agg(F.sum("positions")).first()[0] or 0
        range_bits = max(3, (-(-most // range_keys)).bit_length())
        bits = max(prefix_bits + word_bits, range_bits + 1)
        if bits > 62:
            raise ArithmeticError("packed phrases pass 62 bits")
        grown = stored(_grown(states.unionByName(replies, allowMissingColumns=True), level, word_bits, bits, range_bits))
        states = grown.where("kind = 'state' and positions > 0").select("shard", "kind", "a", "b", "positions")
        merged = stored(_merged(grown.where("kind = 'filter'").select("shard", "range", "a"), word_bits, bits, range_bits, least))
        replies = merged.where("kind = 'reply'").select("shard", "kind", "a", "b")
        found = merged.where("kind = 'phrase'").select("id", "prefix", "last", "f")
        before = info[-1]
        first = before.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"), F.col("f").alias("hf"), "ls")
        rest = before.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("tf"), "rs")
        info.append(stored(found.join(first, "prefix").join(last_words, "last").withColumn(
            "phrase", F.concat_ws(" ", "head", "word")).withColumn("tail", F.expr("substring(phrase, instr(phrase, ' ') + 1)")).join(
            rest, ["lang", "tail"]).select(
            "lang", "id", "phrase", "f", F.concat("ls", F.array("hf")).alias("ls"), F.concat(F.array("tf"), "rs").alias("rs"), "head", "tail", "hf", "tf")))
        prefix_bits = int(found.agg(F.max("id")).first()[0] or 1).bit_length()
    return totals, info


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    totals, info = phrases(docs, least, longest, **sizes)
    # A phrase inside a longer one that is as frequent is inside one of one word more.
    inside = [x.where("hf <= f").select("lang", F.col("head").alias("phrase")).unionByName(
        x.where("tf <= f").select("lang", F.col("tail").alias("phrase"))).distinct() for x in info[2:]]
    columns = ["lang", "phrase", "f", "ls", "rs"]
    kept = [x.select(*columns).join(y, ["lang", "phrase"], "left_anti") for x, y in zip(info[1:], inside)] + [info[-1].select(*columns)]
    found = kept[0]
    for x in kept[1:]:
        found = found.unionByName(x)
    score = ("cast(1000 * f as decimal(20, 0)) * cast(n as decimal(18, 0)) div "
             "(cast(element_at(ls, k) as decimal(19, 0)) * cast(element_at(rs, k) as decimal(18, 0)))")
    cut = F.expr(f"array_min(transform(sequence(1, size(ls)), k -> struct({score} as score, k as k, element_at(ls, k) as l, element_at(rs, k) as r)))")
    scored = found.join(totals, "lang").withColumn("c", cut).select(
        "lang", "phrase", F.col("f").alias("a"), "c.l", "c.r", "n", "c.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GRAM = lambda k: " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
SQL = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
 t AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
 g AS ({' UNION ALL '.join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: {_GRAM(k)})) AS phrase FROM t WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))}),
 f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM t GROUP BY lang),
 c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
 cuts AS (SELECT c.lang, c.k, c.phrase, c.f AS a, x.j, l.f AS l, r.f AS r, n, (CAST(1000 AS HUGEINT) * c.f * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM c JOIN range(1, {LONGEST}) x(j) ON x.j < c.k JOIN n USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:x.j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[x.j + 1:], ' ')),
 best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
 inside AS (SELECT b.lang, b.phrase FROM best b JOIN c x ON x.lang = b.lang AND x.k > b.k AND x.f >= b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')),
 kept AS (SELECT * FROM best ANTI JOIN inside USING (lang, phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
 FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}"""
