"""Token operators against the libraries themselves."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rateforge.llm import pieces, token_counts

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def strings(alphabet, n, length):
    rng = random.Random(5)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(length))) for _ in range(n)]


def test_encoding_and_decoding_equal_the_library(library):
    own = pieces.Pieces(PIECES)
    for text in strings(["a", "b", " ", "  ", "\n", "▁", "the", "5", "é", ".", "日", "\U0001f600", "<s>", "\x00"], 4000, 12):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)
    rng = random.Random(6)
    for _ in range(1000):
        ids = [rng.choice([rng.randrange(259), rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == library.decode(ids)


def test_side_by_side_equals_one_by_one():
    own = pieces.Pieces(PIECES)
    words = [w for w in strings(["a", "the", "r", "in", "▁", "e"], 2000, 9) if w]
    packed = own.side_by_side.ids(words, 64)
    assert packed == [struct.pack(f"<{len(i)}I", *i) for i in map(own._ids, words)]


def test_spans_cover_the_text():
    own = pieces.Pieces(PIECES)
    for text in strings(["a", " ", "thé", "日", "\n", "xyz"], 500, 9):
        spans, data = own.spans(text), text.encode()
        assert len(spans) == len(own.encode(text)) - 2
        if text:
            assert spans[0][0] == 0 and spans[-1][1] == len(data)
        covered = sorted(set(spans))
        assert b"".join(data[a:b] for a, b in covered) == data


@pytest.mark.parametrize("squeeze", [False, True])
def test_character_map_is_longest_prefix(squeeze):
    """The given pieces behind the library's own NFKC map: same ids, and spans of sources."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = sentencepiece_model_pb2.ModelProto.FromString(normalizer.serialized_model_proto()).normalizer_spec
    with open(PIECES, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    proto.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    own = pieces.Pieces.from_proto(proto)
    for text in strings(["ｱ", "ﾞ", "①", "a", "e\u0301", "é", "ﬁ", "㍿", " ", "Ⅷ", "\u3000", "the", "\n"], 2000, 8):
        assert own.encode(text) == library.encode(text, add_bos=True, add_eos=True), ascii(text)
        spans = own.spans(text)
        assert len(spans) == len(own.encode(text)) - 2
        assert all(0 <= x <= y <= len(text.encode()) for x, y in spans) and spans == sorted(spans)
    assert own.map.apply("aﬁ①") == ("afi1", [0, 1, 1, 4, 7])


def test_digests_of_odd_rows(odd, empty, library):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(odd, PIECES).collect())

    def want(doc_id, text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        return (doc_id or 0, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest())

    assert got == sorted(want(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect())
    assert pieces.digests(empty, PIECES).count() == 0


def test_digests_hold_the_spans(odd):
    own = pieces.Pieces(PIECES)
    for text in [*strings(["a", " ", "  ", "thé", "日", "\n", "\U0001f600", "▁", "\x00", "xyz"], 1000, 9), *(r.text for r in odd.collect())]:
        packed, spans = own.located(text)
        assert packed == own.encode_packed(text) and spans.tolist() == [list(x) for x in own.spans(text)], ascii(text)[:200]
    want = sorted((r.doc_id or 0, hashlib.sha256(b"".join(struct.pack("<II", *x) for x in own.spans(r.text))).hexdigest()) for r in odd.collect())
    assert sorted((r.doc_id or 0, r.spans_sha256) for r in pieces.digests(odd, PIECES).collect()) == want


def test_encode_decode_tables(odd):
    encoded = pieces.encode(odd.where("doc_id in (1, 7)"), PIECES)
    assert {r.doc_id: len(r.ids) - 2 - len(r.starts) for r in encoded.collect()} == {1: 0, 7: 0}
    texts = {r.doc_id: r.text for r in pieces.decode(encoded, PIECES).collect()}
    assert texts[1] == odd.where("doc_id = 1").first().text


def test_counts_equal_the_library(odd, empty):
    tokenizer = Tokenizer.from_file(WORDS)
    counter = token_counts.Counter(WORDS, call_bytes=64, remembered=50)
    alphabet = ["a", "B", "<|endoftext|>", " ", "\n", "́", "\x85", "\x1c", "é", "1", "!", "'s", " ", "Σ", "İ", "日", "\t"]
    for text in strings(alphabet, 3000, 10):
        assert counter.counts([text]) == [len(tokenizer.encode(text, add_special_tokens=False).ids)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, WORDS).collect())
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    sizes = [(i or 0, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in rows]
    assert got == sorted((*x, x[2] > 2048) for x in sizes)
    assert token_counts.token_counts(empty, WORDS).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_files_count_whole_texts(name, library):
    path = public_tokenizers.path(name)
    counter = token_counts.Counter(path)
    texts = ["a  b\n\nc the", "", None, "x" * 300]
    encode = library.encode if name.endswith("model") else lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    assert counter.counts(texts) == [len(encode(t or "")) for t in texts]
