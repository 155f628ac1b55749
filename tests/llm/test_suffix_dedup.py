"""Difference-cover suffix arrays and removed spans against brute force."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from rateforge.llm import op_queries, suffix_dedup as sd  # noqa: F401  registers
from rateforge.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 30, 31, 32, 400])
@pytest.mark.parametrize("alphabet", [1, 2, 5, 1 << 22])
def test_order_equals_sorted_suffixes(n, alphabet):
    rng = np.random.default_rng(n)
    for _ in range(20):
        s = rng.integers(1, alphabet + 1, n)
        assert sd.difference_cover_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_hashes_and_minima():
    data = np.frombuffer(b"abcabcabcabcxabcabc" * 3, np.uint8)
    for gram in (1, 2, 3, 6, 7, 50):
        h = sd.gram_hashes(data, gram).tolist()
        grams = [data[i:i + gram].tobytes() for i in range(len(data) - gram + 1)]
        assert len(h) == len(grams) and len(set(h)) == len(set(grams)) == len(set(zip(h, grams)))
        for width in (1, 4, 9, 60):
            assert sd.window_minima(np.array(h, np.uint64), width).tolist() == [min(h[i:i + width]) for i in range(len(h) - width + 1)]


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((doc, len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows, 200)
    assert sum(w[2] for w in want) > 10_000
    assert collected(QUERIES["op12_suffix_dedup"](spark, SF)) == want


@pytest.mark.parametrize("length,hot,size", [(8, 1000, 500), (3, 2, 1 << 20), (20, 1, 2000), (13, 3, 300)])
def test_passages_periods_and_hot_grams(spark, length, hot, size):
    rng = np.random.default_rng(length)
    word = lambda k: "".join(rng.choice(list("abé"), k))
    passage = word(40)
    texts = [word(int(rng.integers(0, 60))) + passage[int(rng.integers(0, 9)):] + word(int(rng.integers(0, 60))) for _ in range(40)]
    texts += ["ab" * 700, "x" * 90, "x" * 90, "abababab" * 3, "", None, "short", texts[0], texts[0]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert collected(sd.removals(df, length=length, hot=hot, bucket_bytes=size)) == brute(rows, length)


def test_crowded_pieces_come_apart_in_few_runs():
    """Every string is in one run, equal strings have one key, and a piece gives a few runs
    where it gave a row a string."""
    rng, length = np.random.default_rng(1), 200
    gram = sd.gram_size(length)
    middle = rng.bytes(170)
    texts = [rng.bytes(int(rng.integers(0, 60))) + middle + middle[:int(rng.integers(80, 170))] + rng.bytes(40) for _ in range(30)]
    found = [(h, data[p:p + k + length - 1]) for _, place, _, strings, least, data in sd.pieces(texts, length)
             for p, k, h in zip(place.tolist(), strings.tolist(), least.view(np.int64).tolist())]
    span = length - gram + 1
    for width in (-(-span // 4), 3, 1):
        keys, n = {}, 0
        for h, piece in found:
            runs = list(sd.narrower(h, None, piece, width, length))
            again = [(key, part) for key, _, part, _ in runs]
            for key, g, part, at in runs:
                assert piece[at:at + len(part)] == part
                finer = [(k, q) for k, _, q, _ in sd.narrower(key, g, part, width, length)]
                assert finer == [(key, part)]  # the place carries over
                for i in range(len(part) - length + 1):
                    keys.setdefault((h, part[i:i + length]), set()).add(key)
                    n += 1
            if width > 3:
                assert len(again) <= 10 < len(piece) - length + 1 or len(piece) - length < 12
        assert n == sum(len(p) - length + 1 for _, p in found)
        assert all(len(k) == 1 for k in keys.values())


def test_odd_rows_and_spans(odd, empty):
    want = brute([(r.doc_id, r.text) for r in odd.collect()], 200)
    assert collected(sd.removals(odd)) == want
    assert sd.removals(empty).count() == 0
    for r in sd.without_repeats(odd).collect():
        assert r.n_bytes == len(r.kept) + sum(s.end - s.start for s in r.spans)
