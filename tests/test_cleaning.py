from pyspark.sql import functions as F

from rateforge.functions import text as tx
from rateforge.operators import cleaning, groups, profile
from rateforge.plans.skew import attach

SCHEMA = "row_id long, text string, rating double, name_ru string, address string, rubrics string"


def rows(spark):
    return spark.createDataFrame([
        (0, "Хорошо", 5.0, "Кафе", "a", "x"), (1, "хорошо", 5.0, "Кафе", "b", "x"),
        (2, "ХОРОШО", 1.0, "Бар", "a", "y"), (3, "Плохо ", 4.0, "Бар", "a", "y"),
        (4, "плохо", 4.0, "Бар", "a", "y"), (5, "нет", 0.0, "Бар", "a", "y"),
        (6, "имя", 3.0, " ", "a", "y"), (7, " \\n ", 3.0, "Бар", "a", "y"),
        (8, "рейтинг", None, "Бар", "a", "y"), (9, "ещё", 2.0, "КАФЁ", "c", None),
    ], SCHEMA)


def test_chain_counts_and_survivors(spark):
    steps = {r.step: r.removed for r in cleaning.filter_steps(rows(spark)).collect()}
    assert steps == {"rating_out_of_range": 2, "no_name": 1, "too_short": 1,
                     "conflicting_copies": 3, "repeated_copy": 1}
    clean = cleaning.clean_table(rows(spark))
    assert [(r.row_id, r.text, r.rating) for r in clean.orderBy("row_id").collect()] == [
        (3, "Плохо", 4), (9, "ещё", 2)]
    assert dict(clean.dtypes)["rating"] == "tinyint"
    assert clean.where("row_id = 9").first().group_key == "кафе"


def test_conflicts_and_first_copy(spark):
    df = rows(spark).where("row_id < 5")
    df = df.withColumn("text", F.trim("text"))
    assert sorted(r.row_id for r in cleaning.drop_conflicts(df).collect()) == [3, 4]
    assert sorted(r.row_id for r in cleaning.keep_first_copy(df).collect()) == [0, 3]


def test_attach_gives_the_same_answer_with_hot_keys(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    df = df.unionByName(spark.createDataFrame([(9999, None)], "row_id long, k string"))
    stats = df.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("row_id").alias("m"))
    cold = attach(df, stats, ["k"], ["row_id"])
    hot = attach(df, stats, ["k"], ["row_id"], hot_rows=100)
    assert hot.count() == 3001
    assert cold.exceptAll(hot).count() == 0 and hot.exceptAll(cold).count() == 0
    assert hot.where("row_id = 9999").first().n is None


def test_hot_copies_are_marked_alike(spark):
    df = spark.range(500).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "копия").otherwise(F.col("id").cast("string")).alias("text"),
        (F.col("id") % 5).cast("double").alias("rating"))
    a, b = cleaning.mark_copies(df), cleaning.mark_copies(df, hot_rows=10)
    assert a.exceptAll(b).count() == 0
    assert b.where("is_first and copies > 1").count() == 1
    assert cleaning.drop_conflicts(df, hot_rows=10).count() == 333


def test_group_statistics(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "g string")
    r = groups.group_stats(df, "g").first()
    assert (r.groups, r.size_median, r.size_max, r.largest_share, r.top10_share) == (3, 3.0, 6, 0.6, 1.0)
    shares = {x.k: x.share for x in groups.top_shares(df, "g", (1, 2)).collect()}
    assert shares == {1: 0.6, 2: 0.9}


def test_between_variance_matches_pandas(spark):
    import pandas as pd

    pdf = pd.DataFrame({"g": ["a"] * 40 + ["b"] * 35 + ["c"] * 5, "v": [(i * 7) % 5 + 1.0 for i in range(80)]})
    got = groups.between_variance(spark.createDataFrame(pdf), "g", "v").first()
    big = pdf[pdf.groupby("g")["v"].transform("size") >= 30]
    want = big.groupby("g")["v"].transform("mean").var() / big["v"].var()
    assert got["rows"] == 75 and abs(got["between_share"] - want) < 1e-9


def test_request_validation(spark):
    df = spark.createDataFrame([(1, ""), (2, "  "), (3, "x" * 20_001), (4, "ok"), (5, None)], "row_id long, text string")
    got = {r.row_id: r.reason for r in cleaning.validate_requests(df).collect()}
    assert got == {1: "empty", 2: "blank", 3: "too_long", 4: None, 5: "missing"}
    big = spark.range(65).select(F.lit(1).alias("b"), F.lit("ok").alias("text"))
    assert cleaning.validate_batches(big, "b").first().accepted is False


def test_class_floor(spark):
    r = profile.class_floor(rows(spark)).first()
    assert r.n == 8 and abs(r.accuracy - 0.25) < 1e-12 and abs(r.macro_f1 - 2 * 0.25 / 1.25 / 5) < 1e-12


def test_copies_are_keyed_once(spark):
    """Statistics and rows read stored keys: no text is prepared or folded a second time."""
    raw = rows(spark).withColumn("text", tx.normalize_text(F.col("text")))
    marked = cleaning.mark_copies(raw)
    profiled = profile.duplicate_profile(raw)
    for df in (marked, profiled):
        assert "lower(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.row_id: (r.copies, r.is_first, r.conflict) for r in marked.where("row_id < 5").collect()} == {
        0: (3, True, True), 1: (3, False, True), 2: (3, False, True), 3: (2, True, False), 4: (2, False, False)}
    assert {r.metric: r.value for r in profiled.collect()} == {
        "extra_copies": 3, "rows_in_groups": 5, "groups": 2, "conflicting_groups": 1, "cross_entity_groups": 1, "full_row_copies": 0}
