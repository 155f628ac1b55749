import math

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from rateforge.catalog import all_queries, model_queries
from rateforge.functions.probs import PROB_COLS
from rateforge.operators import features, models, scoring, terms
from rateforge.operators.features import TfidfConfig
from rateforge.sources import runlog
from rateforge.streaming import scoring as stream

WORDS = TfidfConfig("word", 1, 2, 1, 1000)
CHARS = TfidfConfig("char", 2, 4, 1, 1000)
CONFIGS = {"word": (WORDS,), "char": (CHARS,), "word+char": (WORDS, CHARS)}
TEXTS = ["отлично вкусно", "ужасно грязно", "нормально", "хорошо быстро", "плохо долго", "отлично"] * 5
RATINGS = [5, 1, 3, 4, 2, 5] * 5


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(i, t, r) for i, (t, r) in enumerate(zip(TEXTS, RATINGS))]
    return spark.createDataFrame(rows, "row_id long, text string, rating int").persist()


def grams(spark, text, config):
    return features.with_ngrams(spark.createDataFrame([(text,)], "text string"), config, "t").first().t


def test_ngrams(spark):
    assert grams(spark, "Да, a очень Вкусно", TfidfConfig("word", 1, 2, 1, 9)) == [
        "да", "очень", "вкусно", "да очень", "очень вкусно"]
    # Short words enter whole once; longer sizes are skipped after that.
    assert grams(spark, "я Бы", TfidfConfig("char", 2, 5, 1, 9)) == [
        " я", "я ", " я ", " б", "бы", "ы ", " бы", "бы ", " бы "]


def test_features_equal_the_long_form(spark, reviews):
    model = features.fit_tfidf(reviews, WORDS)
    vocabulary = model.counts.vocabulary
    rows = {r.row_id: dict(zip(r.features.indices, r.features.values)) for r in features.add_features(reviews, [model]).collect()}
    long = features.tfidf_weights(reviews, WORDS).collect()
    assert sum(len(v) for v in rows.values()) == len(long)
    for r in long:
        assert math.isclose(rows[r.row_id][vocabulary.index(r.term)], r.weight, rel_tol=1e-12)
    assert all(math.isclose(sum(x * x for x in v.values()), 1.0) for v in rows.values())


def test_weights_of_terms_are_not_shuffled(spark, reviews):
    for config in (WORDS, CHARS):
        plan = features.tfidf_weights(reviews, config)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan
    none = features.tfidf_weights(spark.createDataFrame([(1, "once only"), (2, None)], "row_id long, text string"), TfidfConfig("word", 1, 2, 3, 9))
    assert none.columns == ["row_id", "term", "weight"] and none.count() == 0


def test_vocabulary_goes_to_the_jvm_at_once(spark, reviews, monkeypatch, tmp_path):
    """Not a term a call, which took longer than the passes of a fit; same model."""
    def refused(*_):
        raise AssertionError("a term a call")

    for config in (WORDS, CHARS):
        want = CountVectorizerModel.from_vocabulary(features.fit_tfidf(reviews, config).counts.vocabulary, "terms", "tf")
        with monkeypatch.context() as patched:
            patched.setattr(CountVectorizerModel, "_new_java_array", staticmethod(refused))
            got = features.fit_tfidf(reviews, config)
            one = models.RatingModel([got], np.zeros((len(got.weights), 5)), np.zeros(5))
            one.save(spark, str(tmp_path / config.analyzer))
            again = models.RatingModel.load(spark, str(tmp_path / config.analyzer)).blocks[0]
        rows = features.with_ngrams(reviews, config, "terms").select("row_id", "terms")
        counts = [[(r.row_id, r.tf) for r in m.transform(rows).orderBy("row_id").collect()] for m in (want, got.counts, again.counts)]
        assert counts[0] == counts[1] == counts[2] and got.counts.vocabulary == want.vocabulary == again.counts.vocabulary
        terms = features.vocabulary(reviews, config).collect()
        assert want.vocabulary == [r.term for r in sorted(terms, key=lambda r: (-r.cf, r.term))]


def test_blocks_side_by_side(spark, reviews):
    got = {(r.row_id, r.block): r for r in features.union_profile(reviews, (WORDS, CHARS)).collect()}
    assert len(got) == 60 and all(math.isclose(r.squares, 1.0) for r in got.values())
    for config in (WORDS, CHARS):
        for r in features.tfidf_weights(reviews, config).groupBy("row_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect():
            own = got[r.row_id, config.analyzer]
            assert own.terms == r.n and math.isclose(own.total, r.w)


def test_sublinear_counts(spark):
    df = spark.createDataFrame([(1, "да да да нет")], "row_id long, text string")
    config = TfidfConfig("word", 1, 1, 1, 10)
    w = {r.term: r.weight for r in features.tfidf_weights(df, config).collect()}
    assert math.isclose(w["да"] / w["нет"], 1 + math.log(3))


@pytest.mark.parametrize("variant", ["word", "char", "word+char"])
def test_variants_fit_and_predict(spark, reviews, variant):
    run = models.run_experiment(reviews, reviews, variant, None, configs=CONFIGS, max_iter=50, c=100.0)
    out = run.model.transform(reviews).toPandas()
    assert len(out) == 30 and set(out["y_pred"]) <= {1, 2, 3, 4, 5}
    assert np.allclose(out[list(PROB_COLS)].sum(axis=1), 1.0)
    assert run.row["accuracy"] == (out["y_pred"] == out["rating"]).mean() > 0.9


def test_class_weights(spark):
    assert models.parse_class_weight("none") is None is models.parse_class_weight(None)
    with pytest.raises(ValueError):
        models.parse_class_weight("TODO")
    counts = [50, 10, 5, 20, 15]
    df = spark.createDataFrame([(k + 1,) for k, n in enumerate(counts) for _ in range(n)], "rating int")
    got = {r.rating: r.weight for r in models.balanced_weights(df).collect()}
    assert all(math.isclose(got[k + 1], 100 / (5 * n)) for k, n in enumerate(counts))


def test_log_of_a_run(spark, reviews, tmp_path):
    models.run_experiment(reviews, reviews, "word", "balanced", configs=CONFIGS, max_iter=5, log_path=str(tmp_path / "l"))
    r = runlog.read_runs(spark, str(tmp_path / "l")).first()
    assert r.model == "tfidf-word+logreg" and r.dataset_size == 30 and '"class_weight": "balanced"' in r.model_params


def test_log_odds(spark):
    rows = [(1, "плохо место")] * 3 + [(5, "отлично место")] * 4 + [(3, "иное")] * 2
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, rating int, text string")
    got = {r.term: r for r in terms.term_log_odds(df, "rating", 1, 5, min_df=3).collect()}
    logit = lambda p: math.log(p / (1 - p))
    assert set(got) == {"плохо", "отлично", "место"}
    assert math.isclose(got["плохо"].log_odds, logit(4 / 5) - logit(1 / 6))


def test_scoring_batch_stream_and_hook(spark, reviews, tmp_path):
    model = models.fit_rating_model(reviews, (WORDS,), None, c=100.0, max_iter=50)
    requests = reviews.select("row_id", "text").unionByName(
        spark.createDataFrame([(100, " "), (101, None), (102, "плохо место " * 3000)], "row_id long, text string"))
    batch = scoring.score(requests, model, 1.3, max_tokens=1)
    rows = {r.row_id: r.prediction for r in batch.collect()}
    assert len(rows) == 33 and rows[0].truncated and not rows[2].truncated and rows[102].truncated
    assert {r.row_id: r.reason for r in batch.where("reason is not null").collect()} == {100: "blank", 101: "missing"}
    assert rows[100] is None and rows[101] is None
    scored = [p for p in rows.values() if p]
    assert all(1 <= p.rating <= 5 and math.isclose(sum(p.probabilities.values()), 1, abs_tol=1e-3) for p in scored)

    requests.repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream.read_requests(spark, str(tmp_path / "in"), requests.schema, files_per_trigger=1)
    job = stream.start_scoring(source, lambda df: scoring.score(df, model, 1.3, max_tokens=1),
                               str(tmp_path / "out"), str(tmp_path / "offsets"))
    job.awaitTermination()
    streamed = {r.row_id: r.prediction for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == rows

    def load():
        return lambda batch: [([0.1, 0.1, 0.1, 0.2, 0.5], len(t) > 9) for t in batch]

    hooked = {r.row_id: r.prediction for r in scoring.score_with(requests, load).collect()}
    assert len(hooked) == 33 and hooked[100] is None and hooked[102].truncated and hooked[0].rating == 5 and hooked[0].truncated and not hooked[2].truncated


def test_double_sink_survives_a_repeated_batch(spark, reviews, tmp_path):
    model = models.fit_rating_model(reviews, (WORDS,), None, c=100.0, max_iter=20)
    requests = reviews.select("row_id", "text").unionByName(spark.createDataFrame(
        [(100, " "), (101, None), (102, ""), (103, "плохо " * 4000)], "row_id long, text string"))
    requests.repartition(3).write.parquet(str(tmp_path / "in"))
    sink = stream.DoubleSink(str(tmp_path / "out"), lambda df: scoring.score(df, model, 1.3).select("row_id", "prediction"))
    source = stream.read_requests(spark, str(tmp_path / "in"), requests.schema, files_per_trigger=1)
    stream.start_double_sink(source, sink, str(tmp_path / "offsets")).awaitTermination()

    def ids(side):
        return sorted(r.row_id for r in sink.read(spark, side).select("row_id").collect())

    assert ids("scored") == list(range(30)) and ids("rejected") == [100, 101, 102, 103]
    reasons = {r.row_id: r.reason for r in sink.read(spark, "rejected").collect()}
    assert reasons == {100: "blank", 101: "missing", 102: "empty", 103: "too_long"}
    # The last batch again, as after a crash between its writes and the stream's own mark.
    last = sink.read(spark, "scored").agg(F.max("batch")).first()[0]
    keys = [r.row_id for side in ("scored", "rejected") for r in sink.read(spark, side).where(f"batch = {last}").select("row_id").collect()]
    sink.write(requests.where(F.col("row_id").isin(keys)), last)
    assert ids("scored") == list(range(30)) and ids("rejected") == [100, 101, 102, 103]
    # A batch without its mark is not seen.
    next((tmp_path / "out" / "marks").glob(str(last))).unlink()
    assert len(ids("scored")) + len(ids("rejected")) == 34 - len(keys)


def test_saved_model_scores_alike(spark, reviews, tmp_path):
    model = models.fit_rating_model(reviews.where("rating > 1"), (WORDS, CHARS), "balanced", max_iter=20)
    assert np.isneginf(model.bias[0])
    model.save(spark, str(tmp_path / "m"))
    again = models.RatingModel.load(spark, str(tmp_path / "m"))
    a, b = (m.transform(reviews).orderBy("row_id").select(*PROB_COLS, "y_pred").collect() for m in (model, again))
    assert a == b and all(r.p1 == 0.0 and r.y_pred > 1 for r in a)


def test_fits_together_equal_single_fits(spark, reviews):
    noisy = reviews.withColumn("rating", F.when(F.col("row_id") % 7 == 0, 3).otherwise(F.col("rating")))
    together = models.fit_variants(noisy, ("word", "word+char"), (None, "balanced"), configs=CONFIGS)
    for (variant, weight), got in together.items():
        alone = models.fit_rating_model(noisy, CONFIGS[variant], weight)
        assert got.gradient_norm <= 1e-5 >= alone.gradient_norm and math.isclose(got.loss, alone.loss, rel_tol=1e-6)
        a, b = (np.array(m.transform(noisy).orderBy("row_id").select(*PROB_COLS).collect()) for m in (got, alone))
        assert np.abs(a - b).max() < 5e-3
    samples = {"a": noisy.where("row_id < 12"), "b": noisy.where("row_id >= 6")}
    both = models.fit_samples(samples, CONFIGS["word"])
    for name, df in samples.items():
        alone = models.fit_rating_model(df, CONFIGS["word"])
        assert both[name].blocks[0].counts.vocabulary == alone.blocks[0].counts.vocabulary
        assert math.isclose(both[name].loss, alone.loss, rel_tol=1e-6, abs_tol=1e-4)


def test_learning_curve_and_comparison(spark, reviews):
    options = {"configs": CONFIGS, "max_iter": 5}
    runs_, summary, chosen = models.learning_curve(reviews, reviews, [10, 20], 2, "word", None, **options)
    assert runs_.count() == 4 and summary.count() == 2 and chosen.first()[0] in (10, 20)
    table = models.compare_configurations(reviews, reviews, ("word",), ("none", "balanced"), **options)
    scores = [r.macro_f1 for r in table.collect()]
    assert len(scores) == 2 and scores == sorted(scores, reverse=True)


def test_tokenizer_hook(spark, reviews):
    def load():
        return lambda batch: [len(t.split()) for t in batch]

    got = {r.row_id: r.tokens for r in terms.tokenizer_lengths(reviews, load).collect()}
    assert got[0] == 2 and got[2] == 1


def test_char_terms_are_counted_before_they_are_rows(spark, monkeypatch):
    """Both counts equal those of the exploded n-grams, for odd texts too, over several slices."""
    monkeypatch.setattr(features, "TEXTS_AT_ONCE", 3)
    texts = ["a bb bb", None, "", "  ", "\u00c9t\u00e9 \u65e5\u672c\u8a9e \U0001f600", "x", "Abc abc ABCDEFG", "bb " * 50, "aaaaaaa", "a bb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    for low, high in ((2, 5), (4, 6)):
        config = features.TfidfConfig("char", low, high, 1, 1000)
        got = features.term_statistics(df, config)
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = {}
        for i, r in enumerate(features.with_ngrams(df, config, "g").select("g").collect()):
            for g in r.g:
                want.setdefault(g, []).append(i)
        assert {(r.term, r.df, r.cf) for r in got.collect()} == {(g, len(set(x)), len(x)) for g, x in want.items()}


def test_word_terms_are_counted_before_they_are_rows(spark, monkeypatch):
    """As for characters; texts of one word or none, and pairs over the end of a text."""
    monkeypatch.setattr(features, "TEXTS_AT_ONCE", 3)
    texts = ["aa bb bb", None, "", "  ", "\u00c9t\u00e9 \u65e5\u672c\u8a9e \U0001f600", "xx", "Abc abc ABCDEFG", "bb " * 50, "aa", "aa bb", "x y z", "aa bb cc aa bb cc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    for low, high in ((1, 2), (2, 4), (1, 1), (3, 3)):
        config = features.TfidfConfig("word", low, high, 1, 1000)
        got = features.term_statistics(df, config)
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = {}
        for i, r in enumerate(features.with_ngrams(df, config, "g").select("g").collect()):
            for g in r.g:
                want.setdefault(g, []).append(i)
        assert {(r.term, r.df, r.cf) for r in got.collect()} == {(g, len(set(x)), len(x)) for g, x in want.items()}


def test_streams_read_tables_that_are_folders(spark, reviews, monkeypatch, tmp_path):
    """More files than one batch takes: every row is scored once, as from a table of one file."""
    model = models.fit_rating_model(reviews, (WORDS,), None, c=100.0, max_iter=5)
    monkeypatch.setattr(model_queries, "_scorer", lambda *_: model)
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate([*TEXTS * 3, None, " ", "", "плохо " * 4000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    df.repartition(70).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "file" / "documents.parquet")
    found = {}
    for kind in ("folder", "file"):
        sf = str(tmp_path / kind)
        found[kind] = [sorted(map(tuple, all_queries()[q](spark, sf).collect()), key=str)
                       for q in ("V1_streaming_scoring", "M8_V1_batch_equals_stream", "V1_F12_double_sink")]
    scored, same, sides = found["folder"]
    assert found["folder"] == found["file"] and sorted(r[0] for r in scored) == list(range(94))
    assert same == [(94, 3, 1, 0, True)]
    assert sides == [("blank", 1, True), ("empty", 1, True), ("missing", 1, True), ("scored", 90, True), ("too_long", 1, True)]
