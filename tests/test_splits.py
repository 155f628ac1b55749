import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rateforge.operators import joins, leakage, neardup, sampling, splitting
from rateforge.plans.ranking import smallest_by_hash


@pytest.fixture(scope="module")
def synthetic(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 8, 6000)
    g = np.repeat(np.arange(6000), sizes)
    rating = rng.choice([1, 2, 3, 4, 5], len(g), p=[0.07, 0.03, 0.05, 0.10, 0.75])
    pdf = pd.DataFrame({"row_id": np.arange(len(g)), "gk_name": [f"g{x}" for x in g], "rating": rating})
    return spark.createDataFrame(pdf).persist()


def _check(split, tol_share=0.03, tol_class=0.02):
    pdf = split.toPandas()
    assert (pdf.groupby("gk_name")["split"].nunique() == 1).all()
    shares = pdf["split"].value_counts(normalize=True)
    for p, f in zip(splitting.PARTS, splitting.FRACTIONS):
        assert abs(shares[p] - f) < tol_share
    overall = pdf["rating"].value_counts(normalize=True)
    for p in splitting.PARTS:
        part = pdf.loc[pdf["split"] == p, "rating"].value_counts(normalize=True)
        assert (part - overall).abs().max() < tol_class


def test_group_split(spark, synthetic):
    a = splitting.make_split(synthetic, 42)
    _check(a)
    again, other = splitting.make_split(synthetic, 42), splitting.make_split(synthetic, 7)
    assert a.exceptAll(again).count() == 0 and a.exceptAll(other).count() > 0
    assert leakage.group_overlap(a, "gk_name").first()[0] == 0
    moved = a.withColumn("split", F.when(F.col("row_id") == 0, F.when(F.col("split") == "train", "test").otherwise("train")).otherwise(F.col("split")))
    n = a.where("row_id = 0").join(a.select("gk_name", F.col("row_id").alias("r2")), "gk_name").count()
    assert leakage.group_overlap(moved, "gk_name").first()[0] == (1 if n > 1 else 0)


def test_split_with_a_group_of_a_third_of_all_rows(spark, synthetic):
    hot = spark.range(12_000).select((F.col("id") + 10**6).alias("row_id"), F.lit("hot").alias("gk_name"),
                                     (F.col("id") % 5 + 1).alias("rating"))
    df = splitting.make_split(synthetic.unionByName(hot), 42, hot_rows=1000)
    pdf = df.toPandas()
    assert pdf.loc[pdf.gk_name == "hot", "split"].unique().tolist() == ["train"]
    shares = pdf["split"].value_counts(normalize=True)
    assert abs(shares["test"] - 0.15) < 0.03 and abs(shares["val"] - 0.15) < 0.03
    assert pdf["split"].notna().all() and len(pdf) == synthetic.count() + 12_000


def test_bad_fractions():
    with pytest.raises(ValueError):
        splitting.check_fractions((0.7, 0.2, 0.2))
    with pytest.raises(ValueError):
        splitting.check_fractions((0.71, 0.14, 0.15))


def test_random_split_has_exact_sizes(spark):
    df = spark.range(1003).withColumnRenamed("id", "row_id")
    counts = {r.split: r["count"] for r in splitting.random_split(df, 1).groupBy("split").count().collect()}
    assert counts == {"train": 702, "val": 150, "test": 151}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    def fp(ids):
        return splitting.fingerprint(spark.createDataFrame([(i,) for i in ids], "row_id long")).first()

    assert fp([3, 1, 2]) == fp([1, 2, 3]) != fp([1, 2, 4])
    assert fp([1, 1, 2]) != fp([2, 2, 1])


def test_text_overlap_and_verdict(spark):
    df = spark.createDataFrame([(1, "train", "a"), (2, "test", "a"), (3, "train", "b"), (4, "val", "c")], "row_id long, split string, text string")
    assert leakage.text_overlap(df).first()[0] == 1
    ok = df.where("text <> 'a'").withColumn("g", F.col("row_id"))
    assert leakage.text_overlap(ok).first()[0] == 0
    stored = splitting.fingerprint(ok.where("split = 'test'"))
    leakage.require_no_leakage(leakage.leakage_verdict(ok, "g", stored))
    with pytest.raises(RuntimeError):
        leakage.require_no_leakage(leakage.leakage_verdict(df.withColumn("g", F.lit(1)), "g", stored))


def test_samples(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    a = sampling.sample(df, 4, 42)
    assert a.count() == 4 and a.exceptAll(sampling.sample(df.repartition(3), 4, 42)).count() == 0
    assert sampling.sample(df, 100, 42).count() == 10 == sampling.sample(df, 10, 42).count()
    nested = sampling.nested_subsamples(df, [2, 5, 20], 2, 1)
    sizes = {(r["repeat"], r["size"]): r["count"] for r in nested.groupBy("repeat", "size").count().collect()}
    assert sizes == {(r, s): min(s, 10) for r in (0, 1) for s in (2, 5, 20)}
    strata = df.withColumn("s", F.when(F.col("row_id") > 0, F.col("row_id") % 2))
    got = {r.s: r["count"] for r in smallest_by_hash(strata, ["row_id"], 3, 1, ["s"]).groupBy("s").count().collect()}
    assert got == {0: 3, 1: 3}


def test_join_contracts(spark):
    left = spark.createDataFrame([(1,), (2,)], "row_id long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row_id long, v string")
    assert joins.one_to_one_join(left, right, "row_id").count() == 2
    for bad in (right.where("row_id > 1"), right.union(right)):
        with pytest.raises(ValueError):
            joins.one_to_one_join(left, bad, "row_id")


def test_eval_guard(spark):
    df = spark.createDataFrame([("val",), ("test",)], "split string")
    with pytest.raises(PermissionError):
        splitting.select_eval(df, "test")
    assert splitting.select_eval(df, "test", allow_test=True).count() == 1


# ---------------------------------------------------------------- near-duplicates
def _text(words):
    return " ".join(words)


def _brute(pdf, threshold=0.8):
    import re

    def sh(t):
        w = re.findall(r"\w+", t.casefold())
        return {" ".join(w)} if len(w) < 3 else {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}

    sets = {r.row_id: sh(r.text) for r in pdf.itertuples()}
    train = [i for i, s in zip(pdf.row_id, pdf.split) if s == "train"]
    return {
        i: any(len(sets[i] & sets[t]) / len(sets[i] | sets[t]) >= threshold for t in train)
        for i, s in zip(pdf.row_id, pdf.split) if s != "train"
    }


def test_near_duplicates_match_brute_force_under_a_hot_template(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    template = list(rng.choice(vocab, 60))
    rows = []
    for i in range(240):
        if i % 3 == 0:  # a third of the rows are variations of one template
            words = list(template)
            for k in rng.integers(0, 60, rng.integers(0, 8)):
                words[k] = rng.choice(vocab)
        elif i % 7 == 0:
            words = ["ok", "да"][: 1 + i % 2]
        else:
            words = list(rng.choice(vocab, rng.integers(5, 40)))
        rows.append((i, _text(words), ["train", "train", "train", "val", "test"][int(rng.integers(0, 5))]))
    pdf = pd.DataFrame(rows, columns=["row_id", "text", "split"])
    df = spark.createDataFrame(pdf)
    flags = neardup.near_duplicates(df, n_query=None, bands=32, rows_per_band=2, hot_rows=20)
    got = {r.row_id: r.has_dup for r in flags.collect()}
    assert got == _brute(pdf)
    assert any(got.values()) and not all(got.values())
    limited = neardup.near_duplicates(df, n_query=10, bands=32, rows_per_band=2).toPandas()
    assert limited.groupby("part").size().to_dict() == {"val": 10, "test": 10}
    examples = neardup.near_duplicate_examples(df, flags).toPandas()
    assert len(examples) == 10 and examples.row_id.is_unique


def test_sets_of_the_training_part_are_made_once(spark, monkeypatch):
    rows = [(i, _text(f"w{j}" for j in range(i // 2, i // 2 + 20)), ["train", "val"][i % 2]) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, text string, split string")
    want = neardup.near_duplicate_examples(df, neardup.near_duplicates(df, n_query=None)).toPandas()
    train = neardup.train_sets(df)
    monkeypatch.setattr(neardup, "train_sets", None)
    flags = neardup.near_duplicates(df, n_query=None, train=train)
    got = neardup.near_duplicate_examples(df, flags, train=train).toPandas()
    assert len(got) == 6 and got.equals(want)


@pytest.mark.parametrize("changed, hit", [(9, False), (1, True)])
def test_similarity_threshold(spark, changed, hit):
    base = [f"a{i}" for i in range(42)]
    other = base[:-changed] + [f"z{i}" for i in range(changed)]
    df = spark.createDataFrame([(1, _text(base), "train"), (2, _text(other), "val")], "row_id long, text string, split string")
    assert neardup.near_duplicates(df, None).first().has_dup is hit


def test_template_of_a_third_of_the_rows_makes_few_candidates(spark):
    """Texts on one template at similarity 0.6 do not meet; a real near-copy still does."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(60)]

    def text(i):
        return " ".join([*template, *(f"own{i}w{k}" for k in range(20))])

    for n in (40, 80):
        rows = [(i, text(i), "train") for i in range(n)] + [(1000 + i, text(1000 + i), "test") for i in range(n)]
        rows += [(5000 + i, " ".join(str(rng.random()) for _ in range(40)), "train") for i in range(2 * n)]
        rows.append((9999, text(3) + " more", "test"))
        df = spark.createDataFrame(rows, "row_id long, text string, split string")
        sets = neardup.distinct_sets(neardup.shingle_sets(df, ["row_id"]))
        asked, members = sets.where("id between 1000 and 4999 or id = 9999"), sets.where("id < 1000")
        pairs = neardup.prefix_pairs(asked, members, 0.8)
        assert pairs.count() == 1 and pairs.first().t == 3
        found = neardup.near_duplicates(df, n_query=None).where("has_dup").collect()
        assert [r.row_id for r in found] == [9999]


def test_hash_tree_sees_every_change_and_no_layout(spark):
    def rows(ids, parts=1):
        return spark.createDataFrame([(i,) for i in ids], "row_id long").repartition(parts)

    ids = [5, -3, 70_000, 70_001, 1 << 40, -(1 << 50), 9]
    root = splitting.id_digest(rows(ids)).first()
    assert root == splitting.id_digest(rows(ids[::-1] + [None], 5)).first() and root.n == 7
    others = [ids[1:], ids + [10], ids + [5], [6, *ids[1:]]]
    digests = {splitting.id_digest(rows(o)).first().digest for o in others}
    assert len(digests) == 4 and root.digest not in digests
    moved = splitting.changed_ranges(splitting.id_leaves(rows(ids)), splitting.id_leaves(rows([5, -3, 70_000, 1 << 40, -(1 << 50), 9, 1 << 41]))).collect()
    assert {(r.first_id, r.last_id, r.n_before, r.n_after) for r in moved} == {(65536, 131071, 2, 1), (1 << 41, (1 << 41) + 65535, 0, 1)}
    assert splitting.id_digest(rows([None])).first().asDict() == {"n": 0, "digest": None}
