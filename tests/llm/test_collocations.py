"""Quotient filters round trip; mined phrases against counting by hand and SQL."""

import os
import re
from collections import Counter

import numpy as np
import pytest

from rateforge.llm import collocations as co, op_queries  # noqa: F401  registers
from rateforge.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bits", [1, 5, 17, 40, 62])
def test_permutation_turns_back_and_filters_keep_all(bits):
    rng = np.random.default_rng(bits)
    permute = co.Permutation(bits)
    x = np.unique(rng.integers(0, 1 << bits, 3000).astype(np.uint64))
    y = permute(x)
    assert len(np.unique(y)) == len(x) and int(y.max()) < 1 << bits and (permute.back(y) == x).all()
    y.sort()
    counts = rng.integers(1, 600, len(y))
    keys, back = co.QuotientFilter.unpacked(co.QuotientFilter.packed(y, counts, bits))
    assert (keys == y).all() and (back == counts).all()
    half = len(y) // 2
    parts = [co.QuotientFilter.packed(y[a], counts[a], bits) for a in (slice(0, half + 1), slice(half, None))]
    keys, sums, place = co.QuotientFilter.merged(parts)
    want = counts.copy()
    want[half] *= 2
    assert (keys == y).all() and (sums == want).all() and (keys[place] == np.concatenate((y[:half + 1], y[half:]))).all()


def brute(rows, least, top=2000, longest=5):
    f, n = Counter(), Counter()
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    good = {k: v for k, v in f.items() if v >= least}
    drop = set()
    for (lang, p), v in good.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p) and v >= good[lang, p[i:j]]:
                    drop.add((lang, p[i:j]))
    out = {}
    for (lang, p), a in good.items():
        if len(p) > 1 and (lang, p) not in drop:
            score, k = min((1000 * a * n[lang] // (good[lang, p[:k]] * good[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), good[lang, p[:k]], good[lang, p[k:]], n[lang]))
    return sorted((lang, rank, p.decode(), -a, le, r, m, -s) for lang, found in out.items()
                  for rank, (s, a, p, le, r, m) in enumerate(sorted(found)[:top], 1))


def collected(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
@pytest.mark.parametrize("least,sizes", [(3, {"shard_bytes": 20_000, "range_keys": 500}), (20, {})])
def test_phrases_equal_counting(spark, least, sizes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    want = brute([(r.lang, r.text) for r in docs.collect()], least)
    assert len(want) > 50
    assert collected(co.collocations(docs, least, **sizes)) == want


def test_odd_rows_and_hot_phrases(spark, odd, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert collected(co.collocations(odd, 2)) == brute(rows, 2)
    assert co.collocations(empty).count() == 0
    made = [("en", "a b c a b c a b, x Y z" * 30), (None, "a b " * 300), ("en", "!?!"), ("en", "q\tr s\x00 é " * 99), ("fr", None)] * 3
    df = spark.createDataFrame(made, "lang string, text string")
    assert collected(co.collocations(df)) == brute(made, 100)


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op11_collocations"]).fetchall()
    assert want and collected(QUERIES["op11_collocations"](spark, SF)) == sorted(want)
