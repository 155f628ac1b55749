"""SentencePiece BPE encoding with offsets, and decoding.

*Normalising.*  The model's compiled character map is a double array followed by
zero-ended replacements.  At every position the longest key that prefixes the rest of the
text is replaced; without a key one character is kept.  Each normalised character
remembers the original bytes it came from, so every piece projects to a byte span of the
original text.

*Encoding.*  Pairs of neighbouring symbols merge best score first, leftmost first among
equals, until no pair is a piece; symbols outside the vocabulary fall back to bytes.  No
piece of usual models holds a word mark after another character, so nothing merges across
the start of a word: words are encoded one by one and the ids of short ones remembered.
Where a model has such pieces, the text is one segment.

*Decoding.*  Pieces become their characters, byte pieces their bytes, word marks spaces;
the first word mark goes if the model adds one.

Defined results: null and empty texts encode to begin and end only and decode to the
empty text; extra columns are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

MARK = "▁"
REMEMBERED, SHORT = 250_000, 48


class CharMap:
    """Longest-prefix replacement by a compiled character map."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size:]

    def longest(self, data: bytes, start: int) -> tuple[int, int]:
        """Length of the longest key at ``start`` (0: none) and where its replacement begins."""
        units, best, at = self.units, (0, 0), 0
        at ^= self._offset(units[0])
        for i in range(start, len(data)):
            at ^= data[i]
            if at >= len(units):
                break
            unit = units[at]
            if unit & 0x800000FF != data[i]:
                break
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - start, units[at] & 0x7FFFFFFF
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def apply(self, text: str) -> tuple[str, list[int]]:
        """Normalised text, and for each of its characters (and the end) the byte of the
        original where it begins."""
        data, out, align, i = text.encode("utf-8", "replace"), [], [], 0
        while i < len(data):
            length, at = self.longest(data, i) if self.units else (0, 0)
            if length:
                new = self.replacements[at:self.replacements.index(0, at)].decode("utf-8")
            else:
                first = data[i]
                length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[i:i + length].decode("utf-8")
            out.append(new)
            align += [i] * len(new)
            i += length
        return "".join(out), [*align, len(data)]


class Pieces:
    """One model file; lives as long as its task."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            self._load(sentencepiece_model_pb2.ModelProto.FromString(file.read()))

    @classmethod
    def from_proto(cls, proto) -> Pieces:
        made = cls.__new__(cls)
        made._load(proto)
        return made

    def _load(self, proto) -> None:
        normal, unknown, control, user, unused, byte = 1, 2, 3, 4, 5, 6
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        if spec.precompiled_charsmap and not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("word marks must be escaped and stand before words")
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        if any(p.type in (user, unused) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids, self.scores, self.bytes = {}, {}, {}
        self.surface: list[bytes | None] = []
        self.begin = self.end = self.unknown = None
        for i, p in enumerate(proto.pieces):
            surface = b""
            if p.type == normal:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                surface = p.piece.replace(MARK, " ").encode()
            elif p.type == byte:
                self.bytes[int(p.piece[3:5], 16)] = i
                surface = bytes([int(p.piece[3:5], 16)])
            elif p.type == unknown:
                self.unknown, surface = i, proto.trainer_spec.unk_surface.encode()
            elif p.piece == proto.trainer_spec.bos_piece:
                self.begin = i
            elif p.piece == proto.trainer_spec.eos_piece:
                self.end = i
            self.surface.append(surface)
        self.marked = {i for p, i in self.ids.items() if p.startswith(MARK)}
        merging = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in merging)
        cut = not any(MARK in p.lstrip(MARK) for p in self.ids)
        single = f"[{alone}]" if alone else "(?!)"
        self.segment = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|{single}" if cut else "(?s:.+)")
        # Words behind single spaces and line starts can stand for themselves.
        self.plain = cut and self.map is None and not self.squeeze and self.dummy and 10 not in map(ord, merging)
        self.known: dict[str, bytes] = {}
        self.side_by_side = SideBySide(self.ids, self.scores)
        self.line_end = self._word("\n") if self.plain else b""
        # Source bytes of every piece; the first byte piece of a character has all of its.
        self.lengths = np.array([len(s or b"") for s in self.surface], np.int64)
        self.inner = np.zeros(len(self.surface), bool)
        for b, i in self.bytes.items():
            self.lengths[i] = 1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            self.inner[i] = 0x80 <= b < 0xC0

    # normalising

    def normalize(self, text: str) -> tuple[str, list[int] | None]:
        """Normalised text with word marks, and the original byte at which each of its
        characters begins (None: character k, less the mark in front, is character k)."""
        if not text:
            return "", [0]
        if self.map is None and not self.squeeze:
            return (MARK if self.dummy else "") + text.replace(" ", MARK), None
        text, align = self.map.apply(text) if self.map else CharMap(b"").apply(text)
        if self.squeeze:
            kept = [i for i, c in enumerate(text) if c != " " or i and text[i - 1] != " "]
            while kept and text[kept[-1]] == " ":
                kept.pop()
            end = align[kept[-1] + 1] if kept else align[-1]
            text, align = "".join(text[i] for i in kept), [*(align[i] for i in kept), end]
        if not text:
            return "", [0]
        if self.dummy:
            text, align = " " + text, [align[0], *align]
        return text.replace(" ", MARK), align

    # encoding

    def _merge(self, segment: str) -> list[str]:
        """Symbols of one segment after all merges."""
        scores, n, low = self.scores, len(segment), float("-inf")
        if n <= SHORT:
            parts = list(segment)
            pairs = [scores.get(a + b, low) for a, b in zip(parts, parts[1:])]
            while pairs and (best := max(pairs)) != low:
                i = pairs.index(best)
                parts[i] += parts.pop(i + 1)
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = scores.get(parts[i] + parts[i + 1], low)
                if i:
                    pairs[i - 1] = scores.get(parts[i - 1] + parts[i], low)
            return parts
        parts: list[str | None] = list(segment)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, i, p) for i in range(n - 1) if (s := scores.get(p := segment[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            left = parts[i]
            if left is None or (j := after[i]) >= n or left + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := scores.get(p := piece + parts[k])) is not None:
                    heapq.heappush(heap, (-s, i, p))
            if (h := before[i]) >= 0 and (s := scores.get(p := parts[h] + piece)) is not None:
                heapq.heappush(heap, (-s, h, p))
        return [p for p in parts if p is not None]

    def _ids(self, segment: str) -> list[int]:
        out = []
        for p in self._merge(segment):
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _cut(self, text: str) -> list[str]:
        """Keys into ``known`` that make up a text: words for ``_word`` where single spaces
        stand between them, else segments of the normalised text behind a space."""
        if self.plain and "  " not in text and MARK not in text and text[:1] not in ("", " "):
            return text.replace("\n", " \n").split(" ")
        return [" " + s for s in self.segment.findall(self.normalize(text)[0])]

    def _word(self, key: str) -> bytes:
        """Ids of a key of ``_cut``.  A word has its mark in front unless it begins a line."""
        if key[:1] == " ":
            segments = [key[1:]]
        else:
            segments = self.segment.findall(key if key[:1] == "\n" else MARK + key)
        ids = [i for s in segments for i in self._ids(s)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, keys) -> None:
        """Put the ids of many keys into ``known``: short words of known characters side
        by side in arrays, the others one by one."""
        rows: dict[int, list[tuple[str, bytes, str]]] = {8: [], 14: [], 24: [], SHORT: []}
        for k in keys:
            head, body = b"", MARK + k
            if k[:1] == " ":
                body = k[1:]
            elif k[:1] == "\n":
                head, body = self.line_end, k[1:]
            if 0 < len(body) <= SHORT and self.ids.keys() >= set(body):
                rows[8 if len(body) <= 8 else 14 if len(body) <= 14 else 24 if len(body) <= 24 else SHORT].append((k, head, body))
            else:
                self.known[k] = self._word(k)
        for width, words in rows.items():
            if words:
                ids = self.side_by_side.ids([w for _, _, w in words], width)
                self.known.update((k, head + packed) for (k, head, _), packed in zip(words, ids))

    def learn(self, texts: list[str | None]) -> None:
        """Meet the words of many texts at once."""
        if self.plain:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            fresh = {k for t in texts if t for k in self._cut(t) if len(k) <= SHORT}.difference(self.known)
            self._learn(fresh)

    def encode_packed(self, text: str | None) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        keys, known = self._cut(text or ""), self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = set(keys).difference(known)
        if len(fresh) > 8:
            self._learn(fresh)
        else:
            known.update((k, self._word(k)) for k in fresh)
        out = b"".join([struct.pack("<I", self.begin), *map(known.__getitem__, keys), struct.pack("<I", self.end)])
        for k in fresh:
            if len(k) > SHORT:
                del known[k]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Original byte span of every piece of ``encode(text)`` but begin and end.  A byte
        piece has the span of its whole character, an added mark an empty one."""
        text = text or ""
        norm, align = self.normalize(text)
        if align is None:
            align = [0] * (len(norm) - len(text))
            at = 0
            for c in text:
                align.append(at)
                at += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
            align.append(at)
        out, at, run = [], 0, False
        for segment in self.segment.findall(norm):
            for p in self._merge(segment):
                lo, hi = align[at], align[at + len(p)]
                if p not in self.ids and not self.bytes and run:
                    out[-1] = out[-1][0], hi
                else:
                    out += [(lo, hi)] * (1 if p in self.ids or not self.bytes else len(p.encode()))
                run = p not in self.ids and not self.bytes
                at += len(p)
        return out

    def located(self, text: str | None) -> tuple[bytes, np.ndarray]:
        """``encode_packed(text)`` and ``spans(text)`` as an array of two columns.  Where
        every character stands for itself the spans follow from the ids, as pieces lie end
        to end and a mark is a space, but for the added one."""
        packed = self.encode_packed(text)
        if not text or self.map or self.squeeze or not self.bytes or MARK in text:
            return packed, np.array(self.spans(text), np.int64).reshape(-1, 2)
        ids = np.frombuffer(packed, "<u4")[1:-1]
        lengths, inner = self.lengths[ids], self.inner[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if inner.any():
            starts = starts[np.maximum.accumulate(np.where(inner, 0, np.arange(len(ids))))]
        both = np.stack((starts, ends), 1)
        return packed, np.maximum(both - 1, 0) if self.dummy else both

    # decoding

    def decode(self, ids) -> str:
        surface = self.surface
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        data = b"".join(map(surface.__getitem__, ids))
        if (self.dummy or self.squeeze) and data.startswith(b" "):
            first = next(i for i in ids if surface[i])
            if first in self.marked:
                data = data[len(data) - len(data.lstrip(b" ")):] if self.squeeze else data[1:]
        return data.decode("utf-8", "rateforge_bytes")


def _each_byte(error):
    return "�", error.start + 1


codecs.register_error("rateforge_bytes", _each_byte)


class SideBySide:
    """Merges many short words at once: a row of symbols for each, in each step the best
    pair of every row (the first among equals) becomes one symbol."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        pairs = sorted((ids[p[:k]] << 32 | ids[p[k:]], i, scores[p]) for p, i in ids.items()
                       for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        # A last entry that no pair equals keeps every search inside.
        self.keys = np.array([*(k for k, _, _ in pairs), np.iinfo(np.int64).max], np.int64)
        self.merged = np.array([*(i for _, i, _ in pairs), 0], np.int64)
        self.score = np.array([*(x for _, _, x in pairs), -np.inf])
        self.of_char = np.zeros(0x110000, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        hit = self.keys[at] == wanted
        return np.where(hit, self.score[at], -np.inf), self.merged[at]

    def ids(self, words: list[str], width: int) -> list[bytes]:
        """Packed ids of words of 1 to ``width`` characters, all of them pieces."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        cols = np.arange(width)
        alive = cols < lengths[:, None]
        symbol = np.zeros((n, width), np.int64)
        symbol[alive] = self.of_char[chars]
        score = np.full((n, width), -np.inf)
        made = np.zeros((n, width), np.int64)
        both = alive[:, 1:]
        left, right = symbol[:, :-1][both], symbol[:, 1:][both]
        score[:, :-1][both], made[:, :-1][both] = self._find(left, right)
        after = np.tile(cols + 1, (n, 1))
        before = np.tile(cols - 1, (n, 1))
        rows = np.arange(n)
        while len(rows):
            i = score[rows].argmax(axis=1)
            more = score[rows, i] > -np.inf
            rows, i = rows[more], i[more]
            if not len(rows):
                break
            j = after[rows, i]
            symbol[rows, i] = made[rows, i]
            alive[rows, j] = False
            score[rows, j] = -np.inf
            k = after[rows, j]
            after[rows, i] = k
            score[rows, i] = -np.inf
            inner = k < lengths[rows]
            r, a, b = rows[inner], i[inner], k[inner]
            before[r, b] = a
            score[r, a], made[r, a] = self._find(symbol[r, a], symbol[r, b])
            h = before[rows, i]
            inner = h >= 0
            r, a, b = rows[inner], h[inner], i[inner]
            score[r, a], made[r, a] = self._find(symbol[r, a], symbol[r, b])
        packed = symbol[alive].astype("<u4").tobytes()
        ends = (alive.sum(axis=1).cumsum() * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) of every row; the last
    is of the pieces' original byte spans, start and end as little-endian unsigned 32-bit
    integers, begin and end left out."""

    def work(batch: pa.RecordBatch, pieces: Pieces) -> Iterator[pa.RecordBatch]:
        n, ids, decoded, spans = [], [], [], []
        for start in range(0, batch.num_rows, 1024):
            texts = batch.column(1).slice(start, 1024).to_pylist()
            pieces.learn(texts)
            for text in texts:
                packed, found = pieces.located(text)
                spans.append(hashlib.sha256(found.astype("<u4").tobytes()).hexdigest())
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(pieces.decode(np.frombuffer(packed, "<u4")).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(spans)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work,
                     "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string", lambda: Pieces(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, starts, ends): token ids with begin and end, and the original byte span of
    each piece between them."""
    name, kind = docs.schema[id_col].name, docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch, pieces: Pieces) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            texts = part.column(1).to_pylist()
            spans = [pieces.spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([pieces.encode(t) for t in texts], pa.list_(pa.int32())),
                 pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int32())),
                 pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int32()))],
                [name, "ids", "starts", "ends"])

    return map_arrow(docs.select(id_col, text_col), work,
                     f"`{name}` {kind}, ids array<int>, starts array<int>, ends array<int>", lambda: Pieces(path))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) decoded from an array of ids; null ids give a null text."""
    name, kind = encoded.schema[id_col].name, encoded.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch, pieces: Pieces) -> Iterator[pa.RecordBatch]:
        texts = [None if ids is None else pieces.decode(ids) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [name, "text"])

    return map_arrow(encoded.select(id_col, ids_col), work, f"`{name}` {kind}, text string", lambda: Pieces(path))


def token_at(starts: list[int], byte: int) -> int:
    """Index of the last piece that begins at or before ``byte``."""
    return bisect_left(starts, byte + 1) - 1
