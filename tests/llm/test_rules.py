"""SimHash, host rules, url trust and Hilbert shards against brute force and SQL."""

import itertools
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rateforge.llm import hilbert, host_rules, op_queries, simhash, url_trust
from rateforge.llm.components import components
from rateforge.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def near_pairs(values):
    return [(a, b) for a, b in itertools.combinations(sorted(values), 2) if (a ^ b).bit_count() <= 3]


@given
def test_op1_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = {r.doc_id: fingerprint(r.text) for r in docs}
    want = roots(fps, [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_links_in_dense_groups(spark):
    """Thousands of fingerprints a few bits around few centres: no link is lost."""
    rng = np.random.default_rng(3)
    found = set()
    for centre in rng.integers(0, 1 << 63, 6).tolist():
        for _ in range(120):
            x = centre
            for bit in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                x ^= 1 << bit
            found.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in found]
    links = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    got = {r.fp: r.root for r in simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    assert got == roots(signed, links)


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)}


def test_simhash_of_odd_rows(odd, empty):
    got = sorted(((r.doc_id or 0), r.fingerprint, r.component_id) for r in simhash.simhash(odd).collect())
    assert len(got) == odd.count()
    same = {x[2] for x in got if x[0] in (1, 2)}
    assert same == {1}
    assert {x[1] for x in got if x[0] in (3, 4, 5)} == {"0" * 16} and {x[2] for x in got if x[0] in (3, 4, 5)} == {3}
    assert simhash.simhash(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 3, 6, 7, 8, None} <= set(ids) and not {2, 4, 5} & set(ids)
    assert simhash.keep_one(odd.where("doc_id = 2")).count() == 1
    assert simhash.keep_one(empty).count() == 0


def test_kept_rows_are_one_of_each_class(spark):
    """Texts with edited words: one row a class of the fingerprints at most three bits apart."""
    rng = np.random.default_rng(5)
    texts = []
    for base in range(5):
        words = [f"w{base}x{i}" for i in range(400)]
        for edits in (0, 0, 1, 1, 2, 3, 8, 40):
            copy = list(words)
            for at in rng.integers(0, 400, edits).tolist():
                copy[at] = f"e{rng.integers(1 << 30)}"
            texts.append(" ".join(copy))
    fps = [fingerprint(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert any(texts[a] != texts[b] for a, b in links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(roots(range(len(texts)), links).values()))


@given
@pytest.mark.parametrize("name", ["op2_host_rules", "op4_url_trust"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    names = [d[0] for d in con.execute(ORACLES[name]).description]
    got = [tuple(r[n] for n in names) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def brute_measures(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


def test_measures_equal_brute_force(spark, odd, empty):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é", "\U0001f600", "\x0b"], rng.integers(0, 80))) for _ in range(150)]
    rows = spark.createDataFrame([(i, t, None, "h") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    rows = rows.unionByName(odd.select("doc_id", "text", "lang", "source"))
    got = [tuple(r) for r in rows.select("text", host_rules.measures(F.col("text")).alias("m")).select("text", "m.*").collect()]
    assert all(r[1:] == brute_measures(r[0]) for r in got)
    assert host_rules.quality(odd).count() == odd.count()
    assert host_rules.quality(empty).count() == 0


def test_bad_host_loses_all_and_small_host_does_not(spark):
    good, bad = "these are ten fine words that stand in a row here {}", "a # b # c # d # e # f # g # h # i {} # k"
    rows = [(i, good.format(i), "good") for i in range(300)] + [(1000 + i, bad.format(i), "bad") for i in range(200)]
    rows += [(2000, good.format("x"), "bad"), (2001, bad.format("y"), "small"), (2002, good.format("z"), None)]
    got = {r.doc_id: r.kept for r in host_rules.quality(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not got[2000] and not got[1000] and got[2001] and got[2002] and got[5]


def page(i, url, *links):
    return (i, url, "".join(f'<a class="x" href="{x}">t</a>' for x in links))


def test_trust_follows_links_and_distrust_goes_back(spark):
    rules = [("allow", "good.org", "/"), ("block", "bad.org", "/")]
    pages = [
        page(1, "http://good.org/a", "http://friend.org/", "/local"), page(2, "http://friend.org/x", "//Second.org/y"),
        page(3, "http://bad.org/a"), page(4, "https://FARM.org/z?q=1", "http://bad.org/1", "http://bad.org/2"),
        page(5, "http://second.org"), page(6, "http://lonely.org/"), page(7, None), page(8, "no scheme"), (9, "http://bad.org/b", None),
        page(10, "http://both.org/", "http://bad.org/", "http://friend.org/"),
    ]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in url_trust.judged(frame, rules).collect()}
    verdicts = {i: r.verdict for i, r in got.items()}
    assert verdicts == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block"}
    assert (got[4].host, got[4].path, got[7].host, got[8].path) == ("farm.org", "/z", "", "")
    scores = {r.host: r for r in url_trust.host_scores(url_trust.ruled(frame, rules)).collect()}
    assert scores["good.org"].trust > scores["friend.org"].trust > scores["second.org"].trust > 0 == scores["farm.org"].trust
    assert url_trust.judged(frame.where("false"), rules).count() == 0


def test_ranks_equal_power_iteration(spark):
    rng = np.random.default_rng(2)
    n = 12
    weights = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.3)
    np.fill_diagonal(weights, 0)
    s = np.zeros(n)
    s[:3] = 1 / 3
    v = s.copy()
    out = weights.sum(1)
    for _ in range(url_trust.STEPS):
        p = np.divide(weights, out[:, None], where=out[:, None] > 0, out=np.zeros((n, n)))
        v = s * (0.15 + 0.85 * v[out == 0].sum()) + 0.85 * v @ p
    nodes = spark.createDataFrame([("k", str(i), float(s[i])) for i in range(n)], "kind string, host string, s double")
    edges = spark.createDataFrame([("k", str(i), str(j), float(weights[i, j])) for i in range(n) for j in range(n) if weights[i, j]],
                                  "kind string, src string, dst string, w double")
    got = {int(r.host): r.v for r in url_trust.propagate(nodes, edges).collect()}
    assert np.allclose([got[i] for i in range(n)], v)


def test_longest_rule_wins(spark):
    urls = ["http://www.example.com/en/a", "http://x.example.com/en/", "http://example.com/de", "http://a.net/es/1", "http://notexample.com/en/", "http://example.com"]
    frame = spark.createDataFrame([page(i, u) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_trust.judged(frame).collect()}
    assert got == {0: ("www.example.com/en/", "allow"), 1: ("example.com/en/", "block"), 2: ("com/", "allow"), 3: ("net/es/", "block"),
                   4: ("com/", "allow"), 5: (None, "allow")}


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_visits_neighbours(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    rows = spark.createDataFrame([(list(c),) for c in cells], "c array<int>").select("c", hilbert.hilbert_index(F.col("c"), dims, bits).alias("h")).collect()
    rows.sort(key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(len(cells)))
    assert all(sum(abs(x - y) for x, y in zip(a.c, b.c)) == 1 for a, b in zip(rows, rows[1:]))


def check_shards(rows, docs):
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    return sizes


@given
def test_long_common_prefixes_do_not_hide_a_dimension(spark):
    """Sources that share their first bytes still part the rows, and shards cover few of them."""
    rows = [(i, f"https://common.example/crawl-{i % 16:02d}", None if i % 50 == 0 else 10 + i % 3) for i in range(1600)]
    df = spark.createDataFrame(rows, "id bigint, source string, size bigint")
    cuts = hilbert.string_cuts(df, "source", 16)
    assert len(cuts) == 15 and cuts == sorted(cuts)
    df = df.fillna({"size": 10})
    ranges = hilbert.shard_ranges(hilbert.hilbert_shards(df, ["source"], "size", 8), ["source"]).collect()
    assert len(ranges) == 8 and all(int(r.max_source[-2:]) - int(r.min_source[-2:]) <= 2 for r in ranges)
    hot = spark.createDataFrame([("same",)] * 90 + [(None,)] * 5 + [("z",)] * 5, "source string")
    assert hilbert.string_cuts(hot, "source", 4) in (["same"], [])
    assert hilbert.string_cuts(hot.where("source is null"), "source", 4) == []


def test_shards_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sizes = check_shards(op_queries.op10(spark, SF).collect(), docs)
    largest = max(len(t.encode()) for _, t in docs)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * largest + 2


def test_shards_of_odd_rows_and_hot_cells(spark, odd, empty, tmp_path):
    rows = hilbert.shard_documents(odd).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert hilbert.shard_documents(empty).count() == 0
    same = spark.range(2000).select(F.lit(1).alias("a"), F.lit(5).alias("b"), F.lit(3).alias("size"))
    spread = hilbert.hilbert_shards(same, ["a", "b"], "size", 8, bucket_rows=50)
    assert sorted(r["count"] for r in spread.groupBy("shard").count().collect()) == [250] * 8
    hilbert.write_shards(spread, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000
    assert hilbert.shard_ranges(spread, ["a"]).count() == 8
