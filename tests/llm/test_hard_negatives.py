"""Residue-number products and mined negatives against plain integers and SQL."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rateforge.llm import hard_negatives as hn, op_queries  # noqa: F401  registers
from rateforge.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [1.0, 300.0, 1e6, 1e12, 1e25])
def test_products_are_exact(size):
    rng = np.random.default_rng(1)
    a, b = (np.floor(rng.normal(0, size, (n, 130))) for n in (7, 9))
    bound = int(max(sum(int(x) ** 2 for x in row) for m in (a, b) for row in m.tolist())) + 1
    ps = hn.moduli(bound)
    got = hn.product([hn.residues(a, p) for p in ps], [hn.residues(b, p) for p in ps], ps)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b.tolist()] for r in a.tolist()]
    assert got.tolist() == want


def brute(rows, positives=5, negatives=3):
    """``rows``: (id, label, vector) that take part."""
    ints = [[int(np.floor(256 * float(x))) for x in v] for _, _, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (anchor, label, _) in enumerate(rows):
        if anchor % 50:
            continue
        scored = sorted((-dot(ints[i], ints[j]), rows[j][0], rows[j][1]) for j in range(len(rows)) if j != i)
        same = [(s, k) for s, k, lab in scored if lab == label][:positives]
        for s, k in same:
            good = [(t, m) for t, m, lab in scored if lab != label and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(anchor, k, r, m, -s, -t) for r, (t, m) in enumerate(good, 1)]
    return sorted(out)


def collected(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in df.select(names).collect())


def test_blocks_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(260):
        v = rng.normal(0, 1, 6).round(1).tolist() if i % 3 else [0.5, -0.25, 0.1, 0.3, -0.7, 0.2]  # a third are one vector
        rows.append((i, int(rng.integers(0, 3)), v, "x"))
    rows += [rows[50], rows[51], (1000, 1, [1.0, 2.0], "x"), (1050, 1, [], "x"), (1100, 1, [3e9] * 6, "x")]
    odd = [(None, 1, [1.0] * 6, "x"), (150, None, [1.0] * 6, "x"), (200, 1, None, "x"), (250, 1, [1.0, None], "x"),
           (300, 1, [float("nan")], "x"), (350, 1, [float("inf")], "x"), (400, 1, [-float("inf")], "x")]
    df = spark.createDataFrame(rows + odd, "id bigint, label int, embedding array<double>, at string")
    want = brute([r[:3] for r in rows])
    assert want
    for size in (64, 1000):
        got = hn.hard_negatives(df, F.col("id") % 50 == 0, anchor_rows=3, block_rows=size)
        assert collected(got) == want
    assert hn.hard_negatives(df.where("false"), F.col("id") % 50 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
def test_query_equals_sql_and_brute_force(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(ORACLES["op13_hard_negatives"]).fetchall()
    got = collected(QUERIES["op13_hard_negatives"](spark, SF))
    assert got == sorted(want)
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got == brute(rows)
