import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame, functions as F

from rateforge.functions import hashing, probs
from rateforge.operators import bootstrap, calibration, errors, joins, metrics, parity, runs
from rateforge.plans.quantiles import double_of, interpolated, interpolated_wide, ordered_image


def frame(spark, y, p, **extra):
    cols = {"y_true": y, "y_pred": p} | extra
    return spark.createDataFrame(pd.DataFrame(cols))


def scores(spark, y, p):
    return metrics.metrics(frame(spark, y, p)).first()


def test_metric_set(spark):
    r = scores(spark, [1, 2, 3, 4, 5, 5], [1, 2, 3, 4, 5, 5])
    assert (r.macro_f1, r.accuracy, r.qwk, r.mae) == (1.0, 1.0, 1.0, 0.0)
    r = scores(spark, [1, 2, 3, 4, 5], [1, 2, 3, 4, 4])
    assert math.isclose(r.macro_f1, (3 + 2 / 3) / 5) and r.accuracy == 0.8 and math.isclose(r.mae, 0.2)
    assert scores(spark, [1, 5], [5, 1]).mae == 4
    assert math.isclose(scores(spark, [1, 2, 4, 5], [1, 2, 4, 5]).macro_f1, 0.8)
    assert scores(spark, [5, 5], [5, 5]).qwk == 0.0


def test_constant_prediction(spark):
    y = np.random.default_rng(0).choice([1, 2, 3, 4, 5], 20_000, p=[0.07, 0.03, 0.05, 0.1, 0.75])
    r, p = scores(spark, y, np.full(20_000, 5)), (y == 5).mean()
    assert math.isclose(r.accuracy, p) and math.isclose(r.macro_f1, 2 * p / (1 + p) / 5) and r.f1_1 == 0


def test_confusion(spark):
    df = frame(spark, [1, 1, 5, 5, 5], [1, 5, 5, 5, 4])
    rows = {r.truth: r for r in metrics.confusion_matrix(df).collect()}
    assert len(rows) == 5 and rows[1].pred_5 == 1 and sum(rows[5][f"pred_{k}"] for k in range(1, 6)) == 3
    shares = {r.truth: r for r in metrics.confusion_matrix(df, normalize=True).collect()}
    assert shares[1].pred_1 == 0.5 and shares[2].pred_2 == 0.0


def test_present_only(spark):
    cells = frame(spark, [1, 1, 2, 2], [1, 1, 2, 2]).agg(*metrics.count_cells())
    r = cells.select(metrics.macro_f1().alias("a"), metrics.macro_f1(present_only=True).alias("b")).first()
    assert math.isclose(r.a, 0.4) and r.b == 1.0


def test_per_class_and_distance(spark):
    df = frame(spark, [1, 2, 3, 4, 5, 5], [1, 2, 3, 4, 3, 5]).withColumn("model", F.lit("m"))
    table = {r["class"]: r for r in metrics.per_class_table(df).collect()}
    assert table[5].recall == 0.5 and table[5].n == 2 and table[3].precision == 0.5
    d = metrics.distance_table(df).first()
    assert math.isclose(d.exact, 5 / 6) and math.isclose(d.off_by_2_plus, 1 / 6) and d.far_among_errors == 1.0
    perfect = metrics.distance_table(df.withColumn("y_pred", F.col("y_true"))).first()
    assert perfect.far_among_errors is None


def test_slices_hide_small_f1(spark):
    y = np.arange(600) % 5 + 1
    df = frame(spark, y, y, s=["a"] * 50 + ["b"] * 550)
    rows = {r.value: r for r in metrics.slice_table(df, ["s"], {"m": "y_pred"}).collect()}
    assert rows["a"].f1 is None and rows["b"].f1 == 1.0
    assert math.isclose(rows["a"].share + rows["b"].share, 1.0)


def test_reliability(spark):
    df = frame(spark, [1] * 10, [1] * 8 + [2] * 2, conf=[0.8] * 10).withColumn("model", F.lit("m"))
    assert abs(metrics.calibration_error(df).first().ece) < 1e-12
    assert metrics.reliability_table(df).first().n == 10


def test_agreement(spark):
    df = frame(spark, [1, 2, 3, 4], [1, 1, 3, 1], b=[1, 2, 1, 1])
    got = [r[0] for r in df.select(errors.agreement_label(F.col("y_true"), F.col("y_pred"), F.col("b"))).collect()]
    assert got == ["both_right", "only_b", "only_a", "both_wrong"]


def test_features(spark):
    df = spark.createDataFrame(
        [(5, 5, 5, "ставлю 5 звёзд 😀", "Кафе;Бар"), (4, 4, 1, "нормально", None), (1, 2, 1, "на пятёрку", "Отель")],
        "y_true int, pred_base int, pred_tr int, text string, rubrics string")
    rows = errors.add_features(df).collect()
    assert [r.mention_group for r in rows] == ["совпадает с оценкой", "нет упоминания", "не совпадает с оценкой"]
    assert [r.has_emoji for r in rows] == ["да", "нет", "нет"]
    assert [r.rubric_main for r in rows] == ["Кафе", "без рубрики", "Отель"]


@pytest.mark.parametrize("draws", [bootstrap.block_draws, bootstrap.hashed_draws])
def test_bootstrap(spark, draws, monkeypatch):
    monkeypatch.setattr(bootstrap, "BLOCK_GROUPS", 120)  # several blocks
    rng = np.random.default_rng(0)
    y = rng.integers(1, 6, 3000)
    good = np.where(rng.random(3000) < 0.9, y, rng.integers(1, 6, 3000))
    bad = np.where(rng.random(3000) < 0.4, y, rng.integers(1, 6, 3000))
    df = frame(spark, y, good, bad=bad, g=rng.integers(0, 300, 3000))
    run = lambda seed: {
        r.name: r for r in bootstrap.cluster_bootstrap(
            df, {"a": "y_pred", "b": "bad"}, "g", 100, seed, (("a", "b"),), draws).collect()}
    one = run(1)
    for r in one.values():
        assert r.low <= r.estimate <= r.high
    assert one["a - b"].low > 0 and one["a - b"].significant and one["a"].significant is None
    assert one == run(1) and one != run(2)
    single = metrics.metrics(df).first().macro_f1
    assert math.isclose(one["a"].estimate, single)
    # Width close to that of a plain cluster bootstrap with NumPy.
    cells = np.zeros((300, 25))
    np.add.at(cells, (df.toPandas()["g"].to_numpy(), (y - 1) * 5 + good - 1), 1)

    def f1(c):
        m = c.reshape(5, 5)
        d = m.sum(0) + m.sum(1)
        return (2 * np.diag(m) / d).mean()

    sims = [f1(np.bincount(rng.integers(0, 300, 300), minlength=300) @ cells) for _ in range(400)]
    width = np.percentile(sims, 97.5) - np.percentile(sims, 2.5)
    assert 0.6 < (one["a"].high - one["a"].low) / width < 1.6


def test_hashed_draws_travel_packed(spark, monkeypatch):
    """Every replicate's cells equal those of draws taken one by one, over several blocks."""
    monkeypatch.setattr(bootstrap, "BLOCK_DRAWS", 140)  # seven positions a block
    monkeypatch.setattr(bootstrap, "TASK_DRAWS", 90)
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 9, (30, 25))
    names = [f"m_{i}" for i in range(25)]
    groups = spark.createDataFrame(pd.DataFrame(cells, columns=names).assign(group=np.arange(30)))
    got = bootstrap.hashed_draws(groups, {"m": "p"}, 20, 5)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row a draw
    md5 = lambda *ids: int(hashlib.md5("|".join(map(str, ids)).encode()).hexdigest()[:15], 16)
    order = sorted(range(30), key=lambda g: (md5(5, g), g))
    for r in got.collect():
        picks = [order[md5(5, r.rep, d) % 30] for d in range(30)]
        assert [r[c] for c in names] == cells[picks].sum(axis=0).tolist()
    assert got.count() == 20


def test_hashes_side_by_side_equal_md5():
    leads = [b"%d|%d|" % (s, r) for s in (5, -3, 42) for r in (0, 7, 10, 99, 100, 12345)] + [b"x" * 43, b"x" * 44, b"x" * 60, b""]
    tails = [b"%d" % p for p in (0, 9, 10, 123, 4567, 10**6, 10**10, 10**11)] + [b""]
    got = hashing.seeded_hashes(leads, tails)
    assert got.tolist() == [[int(hashlib.md5(a + b).hexdigest()[:15], 16) for b in tails] for a in leads]


def test_a_block_counts_its_draws_at_once(spark, monkeypatch):
    """Not once for every task's part: parts times blocks grows with the square of the groups."""
    calls, counted = spark.sparkContext.accumulator(0), np.bincount

    def noted(*a, **b):
        calls.add(1)
        return counted(*a, **b)

    class Arrays:
        bincount = staticmethod(noted)

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(bootstrap, "np", Arrays())
    monkeypatch.setattr(bootstrap, "BLOCK_DRAWS", 100)  # four blocks of ten positions
    monkeypatch.setattr(bootstrap, "TASK_DRAWS", 20)  # twenty parts each
    groups = spark.createDataFrame(pd.DataFrame(np.ones((40, 25), int), columns=[f"m_{i}" for i in range(25)]).assign(group=np.arange(40)))
    assert bootstrap.hashed_draws(groups, {"m": "p"}, 10, 5).where("m_0 = 40").count() == 10
    assert 0 < calls.value <= 8


def _softmax_rows(n, scale, seed=0):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 5)) * 1.5
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(5, p=r) for r in p]) + 1
    s = z * scale
    q = np.exp(s - s.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    return pd.DataFrame(q, columns=list(probs.PROB_COLS)).assign(y_true=y, row_id=np.arange(n))


def test_temperature_identity_and_argmax(spark):
    df = spark.createDataFrame(_softmax_rows(200, 1.0))
    same = calibration.apply_temperature(df, 1.0).orderBy("row_id").toPandas()
    assert np.allclose(same[list(probs.PROB_COLS)], df.orderBy("row_id").toPandas()[list(probs.PROB_COLS)])
    for t in (0.3, 4.0):
        out = calibration.apply_temperature(df, t).orderBy("row_id").toPandas()[list(probs.PROB_COLS)].to_numpy()
        assert np.allclose(out.sum(1), 1) and (out.argmax(1) == same[list(probs.PROB_COLS)].to_numpy().argmax(1)).all()


def test_fit_temperature(spark):
    over = spark.createDataFrame(_softmax_rows(20_000, 2.5))
    t = calibration.fit_temperature(over)
    assert 2.0 < t < 3.1
    stages = over.withColumn("stage", F.lit("before")).unionByName(
        calibration.apply_temperature(over, t).withColumn("stage", F.lit("after")))
    r = {x.stage: x for x in calibration.evaluate(stages, ["stage"]).collect()}
    for k in ("log_loss", "brier", "ece"):
        assert r["after"][k] < r["before"][k]
    assert r["after"].accuracy == r["before"].accuracy
    assert calibration.fit_temperature(spark.createDataFrame(_softmax_rows(5_000, 0.5))) < 1
    wrong = over.withColumn("y_true", F.col("y_true") % 5 + 1).where(
        F.col("y_true") != probs.predicted_class([F.col(c) for c in probs.PROB_COLS]))
    assert calibration.fit_temperature(wrong) <= 20.0


def test_prediction_struct(spark):
    df = spark.createDataFrame([(0.1, 0.1, 0.1, 0.2, 0.5)], list(probs.PROB_COLS))
    r = df.select(probs.prediction_struct([F.col(c) for c in probs.PROB_COLS], F.lit(False)).alias("r")).first().r
    assert (r.rating, r.confidence, r.expected_rating, r.truncated) == (5, 0.5, 3.9, False)
    assert r.probabilities == {"1": 0.1, "2": 0.1, "3": 0.1, "4": 0.2, "5": 0.5}
    tie = spark.createDataFrame([(0.4, 0.1, 0.4, 0.05, 0.05)], list(probs.PROB_COLS))
    assert tie.select(probs.predicted_class([F.col(c) for c in probs.PROB_COLS])).first()[0] == 1
    assert df.select(probs.one_hot(F.lit(2))).first()[0] == [0, 1, 0, 0, 0]


def test_alignment(spark):
    a = spark.createDataFrame(_softmax_rows(50, 1.0)).withColumn("y_pred", F.lit(1))
    assert joins.align({"a": a, "b": a}).count() == 50
    for other in (a.where("row_id > 0"), a.withColumn("y_true", F.col("y_true") % 5 + 1)):
        with pytest.raises(ValueError):
            joins.align({"a": a, "b": other})


def test_parity(spark):
    a = spark.createDataFrame(_softmax_rows(100, 1.0)).withColumn("y_pred", F.lit(1))
    same = parity.parity_check(a, a).first()
    assert same.passed and same.agreement == 1.0 and same.maximum == 0.0
    b = a.withColumn("y_pred", F.when(F.col("row_id") < 10, 2).otherwise(1))
    assert not parity.parity_check(a, b).first().passed
    assert [r.row_id for r in parity.mismatches(a, b, 3).collect()] == [0, 1, 2]
    part = parity.parity_check(a, a.where("row_id < 2")).first()
    assert part.n == 2 and part.incomplete == a.count() - 2 and part.agreement == 1 and not part.passed


def test_run_statistics(spark):
    df = spark.createDataFrame([("a", 0.50), ("a", 0.52), ("a", 0.54), ("b", 0.5)], "m string, v double")
    r = {x.m: x for x in runs.seed_statistics(df, ["m"], "v").collect()}
    assert math.isclose(r["a"]["mean"], 0.52) and math.isclose(r["a"]["std"], 0.02)
    assert (r["b"]["mean"], r["b"]["std"]) == (0.5, 0.0)


@pytest.mark.parametrize("means, std, want", [
    ([0.30, 0.36, 0.375, 0.378], 0.004, 50_000), ([0.30, 0.31, 0.33, 0.36], 0.02, 10_000),
    ([0.30, 0.34, 0.38, 0.42], 0.002, 100_000),
])
def test_plateau_rule(spark, means, std, want):
    rows = list(zip([10_000, 25_000, 50_000, 100_000], means, [std] * 4))
    df = spark.createDataFrame(rows, "size long, f1_mean double, f1_std double")
    assert runs.choose_size(df, 0.005).first()[0] == want


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25)])  # a third share one value
    df = spark.createDataFrame(pd.DataFrame({"v": v, "k": np.round(v * 10).astype(int)}))
    probs_ = {"a": 0.0, "b": 0.123, "c": 0.5, "d": 0.999, "e": 1.0}
    got = interpolated_wide(df, "v", probs_).first()
    assert got.n == 6000 and np.allclose([got[k] for k in probs_], np.quantile(v, list(probs_.values())), rtol=1e-15)
    got = interpolated(df, "k", probs_).first()
    assert np.allclose([got[k] for k in probs_], np.quantile(np.round(v * 10), list(probs_.values())))
    assert interpolated_wide(df.where("v > 99"), "v", {"a": 0.5}).first()["a"] is None


def test_images_order_doubles_and_turn_back(spark):
    rng = np.random.default_rng(6)
    powers = [2.0 ** k for k in (-1074, -1073, -1023, -1022, -1021, -1, 0, 1, 52, 53, 511, 1022, 1023)]
    v = [0.0, -0.0, 5e-324, float(np.finfo(float).max), float("inf"), *powers, *(np.nextafter(p, 0) for p in powers), *(np.nextafter(p, 9e307) for p in powers[:-1]),
         *rng.normal(size=200), *np.exp(rng.normal(0, 200, 500))]
    v = [float(x) for x in v] + [-float(x) for x in v]
    rows = spark.createDataFrame([(x,) for x in v] + [(float("nan"),)], "v double").select("v", ordered_image(F.col("v")).alias("u")).collect()
    assert all(math.isnan(double_of(r.u)) if math.isnan(r.v) else double_of(r.u) == r.v for r in rows)
    known = sorted((r for r in rows if not math.isnan(r.v)), key=lambda r: r.v)
    assert all((a.u < b.u) == (a.v < b.v) for a, b in zip(known, known[1:])) and max(r.u for r in known) < max(r.u for r in rows)


def test_quantiles_of_millions_of_distinct_values(spark):
    df = spark.range(3_000_000, numPartitions=8).select(((F.col("id") * 7_368_787 % 3_000_000) / 7.0 - 1e5).alias("v"))
    probs_ = {"a": 0.0, "b": 0.1234567, "c": 0.5, "d": 0.95, "e": 1.0}
    got = interpolated_wide(df, "v", probs_).first()
    want = np.quantile(np.arange(3_000_000) / 7.0 - 1e5, list(probs_.values()))
    assert got.n == 3_000_000 and np.allclose([got[k] for k in probs_], want, rtol=1e-13)


def test_temperatures_of_all_models_in_the_same_passes(spark):
    tables = {m: _softmax_rows(3_000, t) for m, t in (("a", 2.5), ("b", 0.6), ("c", 1.0), (None, 4.0))}
    df = reduce(DataFrame.unionByName, [spark.createDataFrame(x).withColumn("model", F.lit(m)) for m, x in tables.items()])
    got = calibration.fit_temperatures(df)
    assert set(got) == set(tables)
    for m, x in tables.items():
        assert math.isclose(got[m], calibration.fit_temperature(spark.createDataFrame(x)), rel_tol=1e-8)
    assert calibration.fit_temperatures(df.where("false")) == {}
    with pytest.raises(RuntimeError):
        calibration.fit_temperatures(df, passes=2)
