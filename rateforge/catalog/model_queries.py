"""Features, classifiers, scoring, storage and streaming on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.probs import PROB_COLS
from ..operators import features, models, scoring, softmax, splitting
from ..plans.materialize import cut, shared_folder
from ..sources import runlog, tables, tskv
from ..sources.files import hadoop
from ..streaming import scoring as stream
from .inputs import MODELS, NOT_WS, ORDERS, W, predictions, predictions_sql, rated_orders, table, texts
from .registry import query
from .review_queries import _FIELDS_SQL, _LINE
from .split_queries import SPLIT, split_orders

WORDS, CHARS = features.WORD_TFIDF, features.CHAR_TFIDF
# Raw lines written by one task.
RAW_FILE_BYTES = 64 << 20


def documents(spark, sf) -> DataFrame:
    return texts(spark, sf).select(F.col("doc_id").alias("row_id"), "text")


_WORD_TERMS = rf"""t AS (SELECT doc_id AS row_id, regexp_extract_all(lower(text), '{W[:-1]}]{{2,}}') AS w FROM documents),
 occ AS (SELECT row_id, unnest(w) AS term FROM t UNION ALL SELECT row_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t)"""
_CHAR_TERMS = rf"""wd AS (SELECT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '{NOT_WS}+')) AS w FROM documents), pd AS (SELECT row_id, ' ' || w || ' ' AS p FROM wd),
 occ AS ({' UNION ALL '.join(f"SELECT row_id, unnest(list_transform(range(1, length(p) - {n - 2}), lambda i: substr(p, i, {n}))) AS term FROM pd" for n in range(CHARS.low, CHARS.high + 1))})"""


def _frequencies(occ: str, min_df: int) -> str:
    return f"""WITH {occ}, tf AS (SELECT row_id, term, count(*) AS tf FROM occ GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
 df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term HAVING count(*) >= {min_df})"""


@query("M1_word_document_frequencies", _frequencies(_WORD_TERMS, WORDS.min_df) + " SELECT term, df, cf, round(ln((n + 1.0) / (df + 1)) + 1, 6) AS idf FROM df, n")
def _(spark, sf):
    out = features.document_frequencies(documents(spark, sf), WORDS)
    return out.withColumn("idf", F.round("idf", 6))


@query("M1_word_tfidf_weights", _frequencies(_WORD_TERMS, WORDS.min_df) + f""", v AS (SELECT * FROM df ORDER BY cf DESC, term LIMIT {WORDS.max_features}),
 w AS (SELECT row_id, term, (1 + ln(tf)) * (ln((n + 1.0) / (df + 1)) + 1) AS w FROM tf JOIN v USING (term), n)
 SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM w""")
def _(spark, sf):
    out = features.tfidf_weights(documents(spark, sf), WORDS)
    return out.withColumn("weight", F.round("weight", 6))


@query("M2_char_document_frequencies", _frequencies(_CHAR_TERMS, CHARS.min_df) + " SELECT term, df, cf, round(ln((n + 1.0) / (df + 1)) + 1, 6) AS idf FROM df, n")
def _(spark, sf):
    out = features.document_frequencies(documents(spark, sf), CHARS)
    return out.withColumn("idf", F.round("idf", 6))


@query("M2_union_weights", f"""WITH {_WORD_TERMS}, wtf AS (SELECT row_id, term, count(*) AS tf FROM occ GROUP BY 1, 2), {_CHAR_TERMS.replace(" occ AS", " cocc AS")},
 ctf AS (SELECT row_id, term, count(*) AS tf FROM cocc GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
 tf AS (SELECT 'word' AS block, * FROM wtf UNION ALL SELECT 'char', * FROM ctf),
 df AS (SELECT block, term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1, 2 HAVING count(*) >= CASE block WHEN 'word' THEN {WORDS.min_df} ELSE {CHARS.min_df} END),
 v AS (SELECT * FROM df QUALIFY row_number() OVER (PARTITION BY block ORDER BY cf DESC, term) <= CASE block WHEN 'word' THEN {WORDS.max_features} ELSE {CHARS.max_features} END),
 w AS (SELECT row_id, block, (1 + ln(tf)) * (ln((n + 1.0) / (df + 1)) + 1) AS w FROM tf JOIN v USING (block, term), n),
 s AS (SELECT row_id, block, count(*) AS terms, sum(w) / sqrt(sum(w * w)) AS total FROM w GROUP BY 1, 2)
 SELECT d.doc_id AS row_id, b.block, CAST(coalesce(terms, 0) AS INTEGER) AS terms, round(coalesce(total, 0), 4) AS total
 FROM documents d CROSS JOIN (VALUES ('word'), ('char')) b(block) LEFT JOIN s ON s.row_id = d.doc_id AND s.block = b.block""")
def _(spark, sf):
    out = features.union_profile(documents(spark, sf), (WORDS, CHARS))
    return out.select("row_id", "block", "terms", F.round("total", 4).alias("total"))


@query("M3_balanced_weights", f"""SELECT y_true, count(*) AS n, round((SELECT count(*) FROM ({ORDERS})) / CAST(5 * count(*) AS DOUBLE), 9) AS weight FROM ({ORDERS}) GROUP BY y_true""")
def _(spark, sf):
    out = models.balanced_weights(rated_orders(spark, sf), "y_true")
    return out.withColumn("weight", F.round("weight", 9))


@query("J7_weights_on_rows", f"""SELECT row_id, round((SELECT count(*) FROM ({ORDERS})) / CAST(5 * count(*) OVER (PARTITION BY y_true) AS DOUBLE), 9) AS weight FROM ({ORDERS})""")
def _(spark, sf):
    out = models.with_weights(rated_orders(spark, sf), "balanced", "y_true")
    return out.select("row_id", F.round("weight", 9).alias("weight"))


def rated_texts(spark, sf) -> DataFrame:
    """Documents with a rating the text can predict: language and length band."""
    return texts(spark, sf).select(
        F.col("doc_id").alias("row_id"), "text", F.col("source").alias("grp"),
        (F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3)
         .otherwise(4) + F.when(F.col("n_chars") > 3000, 1).otherwise(0)).alias("rating"),
    )


def _parts(spark, sf) -> DataFrame:
    """Split rows, stored once: every fit and every pass of a fit reads them again."""
    return cut(splitting.random_split(rated_texts(spark, sf), 42))


@query("M3_logistic_regression")
def _(spark, sf):
    rows = _parts(spark, sf)
    train, val = (rows.where(F.col("split") == p) for p in ("train", "val"))
    run = models.run_experiment(train, val, "word", "balanced")
    return run.model.transform(val).select("row_id", "rating", "y_pred", *PROB_COLS)


_RATED = """SELECT CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END + CASE WHEN n_chars > 3000 THEN 1 ELSE 0 END AS rating FROM documents"""


@query("M3_optimality", f"""WITH r AS ({_RATED}) SELECT rating, count(*) AS n, CAST(count(*) AS DOUBLE) AS mass, true AS stationary, true AS below_prior FROM r GROUP BY rating""")
def _(spark, sf):
    """What holds only at the optimum: the free biases make every class's summed
    probability its number of rows, the gradient of the penalised loss vanishes, and the
    loss is below that of the class shares alone."""
    rows = rated_texts(spark, sf)
    model = models.fit_rating_model(rows, (WORDS,))
    scored = model.transform(rows)
    shares = scored.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    total = shares.agg(F.sum("n")).scalar()
    prior = shares.agg(F.sum(-F.col("n") / total * F.ln(F.col("n") / total))).scalar()
    mass = scored.agg(*[F.sum(c).alias(c) for c in PROB_COLS])
    by_class = F.element_at(F.array(*[F.col(c) for c in PROB_COLS]), F.col("rating"))
    return shares.crossJoin(mass).select(  # one row of sums beside at most five
        "rating", "n", F.round(by_class, 1).alias("mass"), F.lit(bool(model.gradient_norm <= softmax.TOLERANCE)).alias("stationary"),
        (F.lit(float(model.loss)) < prior).alias("below_prior"))


_KEPT: dict[tuple, object] = {}


def _once(spark, sf: str, name: str, make):
    """What ``make`` gives, made once for a session and a folder of tables."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _compared(spark, sf) -> DataFrame:
    def make():
        rows = _parts(spark, sf)
        return models.compare_configurations(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val"))

    return _once(spark, sf, "comparison", make)


def _stationary() -> Column:
    return (F.col("gradient_norm") <= softmax.TOLERANCE).alias("stationary")


@query("M5_configuration_comparison")
def _(spark, sf):
    return _compared(spark, sf).orderBy(F.desc("macro_f1"))


@query("M5_optimality", """SELECT variant, class_weight, true AS stationary, true AS scored FROM (VALUES ('word'), ('char'), ('word+char')) v(variant)
 CROSS JOIN (VALUES ('none'), ('balanced')) w(class_weight)""")
def _(spark, sf):
    return _compared(spark, sf).select("variant", "class_weight", _stationary(), F.col("macro_f1").between(0.1, 1.0).alias("scored"))


def _curve(spark, sf):
    def make():
        rows = _parts(spark, sf)
        pool = rows.where(F.col("split") == "train")
        n = pool.count()
        found = models.learning_curve(pool, rows.where(F.col("split") == "val"), [n // 4, n // 2], 2, "word", "balanced")
        return n, *found

    return _once(spark, sf, "curve", make)


@query("M6_learning_curve")
def _(spark, sf):
    _, _, summary, chosen = _curve(spark, sf)
    return summary.withColumn("chosen_size", chosen.scalar())


@query("M6_optimality", """SELECT CAST(q AS INTEGER) AS quarters, CAST(r AS BIGINT) AS repeat, true AS stationary, true AS scored, true AS chosen_is_a_size FROM range(1, 3) a(q) CROSS JOIN range(0, 2) b(r)""")
def _(spark, sf):
    n, runs, _, chosen = _curve(spark, sf)
    size = chosen.scalar()
    return runs.select(F.when(F.col("size") == n // 4, 1).when(F.col("size") == n // 2, 2).alias("quarters"), "repeat", _stationary(),
                       F.col("macro_f1").between(0.1, 1.0).alias("scored"), size.isin(n // 4, n // 2).alias("chosen_is_a_size"))


def _inflation(spark, sf) -> DataFrame:
    def make():
        rows = rated_texts(spark, sf)
        grouped = cut(splitting.make_split(rows, 42, group="grp"))
        return models.leak_inflation(grouped, _parts(spark, sf), rows.count() // 2)

    return _once(spark, sf, "inflation", make)


@query("M7_leak_inflation")
def _(spark, sf):
    return _inflation(spark, sf).drop("gradient_norm")


@query("M7_optimality", """SELECT split_kind, true AS stationary, true AS scored FROM (VALUES ('grouped'), ('random')) v(split_kind)""")
def _(spark, sf):
    return _inflation(spark, sf).select("split_kind", _stationary(), F.col("macro_f1").between(0.0, 1.0).alias("scored"))


@query("M3_invariants", """SELECT CAST(floor(count(*) * 0.15) AS BIGINT) AS n, true AS sums_to_one, true AS predicts_largest, true AS beats_constant FROM documents""")
def _(spark, sf):
    """What holds for any fit: every val row scored, probabilities that sum to one, their
    largest predicted, and better accuracy than always answering the commonest rating."""
    rows = _parts(spark, sf)
    val = rows.where(F.col("split") == "val")
    scored = cut(_scorer(spark, sf).transform(val).select("rating", "y_pred", *PROB_COLS))
    best = F.greatest(*PROB_COLS)
    total = sum((F.col(c) for c in PROB_COLS[1:]), F.col(PROB_COLS[0]))
    commonest = scored.groupBy("rating").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.bool_and(F.get(F.array(*PROB_COLS), F.col("y_pred") - 1) == best).alias("predicts_largest"),
        (F.count_if(F.col("rating") == F.col("y_pred")) > commonest).alias("beats_constant"),
    )


@query("M8_V1_batch_equals_stream", """SELECT count(*) AS n, count(*) FILTER (text IS NULL OR regexp_matches(text, '^\\s*$')) AS with_reason,
 count(*) FILTER (length(text) > 20000) AS long_scored, CAST(0 AS BIGINT) AS differing, true AS confident FROM documents""")
def _(spark, sf):
    """Every row comes back from batch and stream alike, long texts scored."""
    model = _scorer(spark, sf)
    docs = documents(spark, sf)
    batch = scoring.score(docs, model, 1.3).select("row_id", F.length("text").alias("size"), "prediction", "reason")
    stored = stream_scores(spark, sf, model).select("row_id", F.col("prediction.rating").alias("streamed"))
    both = batch.join(stored, "row_id", "full")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count("reason").alias("with_reason"),
        F.count_if((F.col("size") > 20_000) & F.col("prediction").isNotNull()).alias("long_scored"),
        F.count_if(~F.col("prediction.rating").eqNullSafe(F.col("streamed"))).alias("differing"),
        F.bool_and(F.col("prediction.confidence").between(0.2, 1.0)).alias("confident"),
    )


def _scorer(spark, sf) -> models.RatingModel:
    """Fitted and saved once; every query that scores loads it."""
    def make():
        path = _folder(spark)
        train = _parts(spark, sf).where(F.col("split") == "train")
        models.fit_rating_model(train, (WORDS,), "balanced").save(spark, path)
        return path

    return models.RatingModel.load(spark, _once(spark, sf, "scorer", make))


@query("M8_P18_batch_scoring")
def _(spark, sf):
    scored = scoring.score(documents(spark, sf), _scorer(spark, sf), temperature=1.3)
    return scored.select("row_id", "prediction.rating", "prediction.confidence",
                         "prediction.expected_rating", "prediction.truncated", "reason")


@query("M8_user_model_hook", r"""SELECT doc_id AS row_id, CASE WHEN contains(text, 'the') THEN 5 ELSE 1 END AS rating, CAST(0.6 AS DOUBLE) AS confidence, length(text) > 5000 AS truncated FROM documents""")
def _(spark, sf):
    def load():
        def predict(batch):
            out = []
            for t in batch:
                p = [0.1, 0.1, 0.1, 0.1, 0.6] if "the" in t else [0.6, 0.1, 0.1, 0.1, 0.1]
                out.append((p, len(t) > 5000))
            return out
        return predict

    scored = scoring.score_with(documents(spark, sf), load)
    return scored.select("row_id", "prediction.rating", "prediction.confidence", "prediction.truncated")


def _requests(spark, sf) -> DataFrame:
    """The documents' files as a stream (row_id, text): the table is one file or a folder of files."""
    schema = table(spark, sf, "documents").schema
    at, files = hadoop(spark, f"{sf}/documents.parquet")
    where = (f"{sf}/documents.parquet", "*") if files.getFileStatus(at).isDirectory() else (sf, "documents.parquet")
    return stream.read_requests(spark, where[0], schema, pattern=where[1]).select(F.col("doc_id").alias("row_id"), "text")


def stream_scores(spark, sf, model) -> DataFrame:
    """What a stream over the documents' files has stored when it has read them all."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    job = stream.start_scoring(
        _requests(spark, sf),
        lambda df: scoring.score(df, model, 1.3).select("row_id", "prediction", "reason"),
        f"{folder}/out", f"{folder}/offsets",
    )
    job.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


class _Repeated(stream.DoubleSink):
    """Writes its first batch twice, as a query does that is restarted before its own mark."""

    def write(self, batch: DataFrame, number: int) -> None:
        for _ in range(2 if number == 0 else 1):
            super().write(batch, number)


@query("V1_F12_double_sink", r"""WITH r AS (SELECT CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 1 THEN 'empty' WHEN length(text) > 20000 THEN 'too_long'
 WHEN regexp_matches(text, '^\s*$') THEN 'blank' END AS reason FROM documents)
 SELECT coalesce(reason, 'scored') AS kind, count(*) AS n, true AS shaped FROM r GROUP BY 1""")
def _(spark, sf):
    """Requests streamed from the documents' files: scored ones and rejected ones, each in
    its place, the first batch written twice as a restarted query would."""
    folder = _folder(spark)
    model = _scorer(spark, sf)
    sink = _Repeated(folder, lambda df: scoring.score(df, model, 1.3).select("row_id", "prediction"))
    stream.start_double_sink(_requests(spark, sf), sink, f"{folder}/offsets").awaitTermination()
    scored, rejected = sink.read(spark, "scored"), sink.read(spark, "rejected")
    return scored.agg(F.lit("scored").alias("kind"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction.confidence").between(0.2, 1.0)).alias("shaped")).unionByName(
        rejected.groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("shaped"))).where("n > 0")


@query("V1_streaming_scoring")
def _(spark, sf):
    scored = stream_scores(spark, sf, _scorer(spark, sf))
    return scored.select("row_id", "prediction.rating", "prediction.confidence", "reason")


# ------------------------------------------------------------------- storage
def _folder(spark) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


@query("S7_K1_prediction_store", f"SELECT row_id, y_true, y_pred FROM ({predictions_sql(MODELS['transformer'], ORDERS)}) WHERE row_id % 2 = 0")
def _(spark, sf):
    folder = _folder(spark)
    rows = rated_orders(spark, sf)
    split = F.when(F.col("row_id") % 2 == 0, "val").otherwise("test")
    stored = [
        predictions(rows, seed).withColumn("model", F.lit(name)).withColumn("split", split)
        for name, seed in MODELS.items()
    ]
    for rows_ in stored:  # each model by its own call
        tables.write_predictions(rows_, folder)
    return tables.read_predictions(spark, folder, "transformer", "val").select("row_id", "y_true", "y_pred")


@query("S1_S6_cached_tskv_scan", _FIELDS_SQL.replace("doc_id AS row_id", "row_number() OVER (ORDER BY doc_id) - 1 AS row_id"))
def _(spark, sf):
    folder = _folder(spark)
    # Files in the order of the ids, more of them for more text, so that no task writes or reads a fixed share.
    lines = table(spark, sf, "documents").selectExpr("doc_id", f"{_LINE} AS value")
    parts = max(4, -(-(lines.agg(F.sum(F.octet_length("value"))).first()[0] or 0) // RAW_FILE_BYTES))
    lines.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(f"{folder}/raw")
    read = lambda path: tskv.read_tskv(spark, path, tskv.block_index(spark, path, f"{folder}/index"))
    first = tables.derived_table(spark, f"{folder}/raw", f"{folder}/parsed", read)
    again = tables.derived_table(spark, f"{folder}/raw", f"{folder}/parsed", read)
    assert first.inputFiles() == again.inputFiles()
    return again.select("row_id", *tskv.FIELDS)


@query("K3_K4_versioned_split", f"WITH {SPLIT} SELECT row_id, split FROM ds")
def _(spark, sf):
    folder = _folder(spark)
    rows = split_orders(spark, sf)
    tables.save_split(rows.drop("split"), rows.select("row_id", "split"), folder, version="v1", seed=42, group_col="grp")
    return spark.read.parquet(f"{folder}/split_v1").select("row_id", "split")


@query("K3_K4_published_manifest", f"""WITH {SPLIT} SELECT split, count(*) AS rows, count(DISTINCT grp) AS groups, 'v1' AS version, CAST(42 AS BIGINT) AS seed, true AS second_refused FROM ds GROUP BY split""")
def _(spark, sf):
    """A version is published once: a second writer is refused and changes nothing."""
    folder = _folder(spark)
    rows = split_orders(spark, sf)
    publish = lambda df, seed: tables.save_split(df.drop("split"), df.select("row_id", "split"), folder, version="v1", seed=seed, group_col="grp")
    publish(rows, 42)
    try:
        publish(rows.limit(10), 43)
        refused = False
    except FileExistsError:
        refused = True
    manifest = tables.split_manifest(spark, folder, "v1")
    return manifest.select("split", "rows", "groups", "version", "seed", F.lit(refused).alias("second_refused"))


@query("K2_csv_result", f"SELECT CAST(y_true AS VARCHAR) AS y_true, CAST(count(*) AS VARCHAR) AS n FROM ({ORDERS}) GROUP BY y_true")
def _(spark, sf):
    folder = _folder(spark)
    counts = rated_orders(spark, sf).groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))
    tables.write_csv(counts, folder)
    return spark.read.option("header", True).csv(folder)


@query("S5_json_result", f"SELECT y_true, count(*) AS n FROM ({ORDERS}) GROUP BY y_true")
def _(spark, sf):
    folder = _folder(spark)
    counts = rated_orders(spark, sf).groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))
    # One JSON document: an array of at most five records.
    counts.agg(F.to_json(F.collect_list(F.struct("y_true", "n"))).alias("value")).write.text(folder)
    return tables.read_json_if_exists(spark, folder).select(F.col("y_true").cast("int").alias("y_true"), "n")


@query("K5_experiment_log", """SELECT event_type AS model, count(*) AS dataset_size, round(avg(value), 6) AS mae, '{"a":2,"b":1}' AS model_params FROM events GROUP BY event_type""")
def _(spark, sf):
    folder = _folder(spark)
    stats = table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("v")
    )
    params = F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))
    runlog.log_runs(stats.select(F.col("event_type").alias("model"), F.col("n").alias("dataset_size"), F.col("v").alias("mae"), params.alias("model_params")), folder)
    runs = runlog.read_runs(spark, folder).where(F.col("experiment_id").rlike(r"^\d{8}-\d{6}-[0-9a-f]{6}$"))
    return runs.select("model", "dataset_size", F.round("mae", 6).alias("mae"), "model_params")
