"""Metrics, slices, bootstrap, calibration and parity on rated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import bins, probs
from ..operators import analysis, bootstrap, calibration, errors, joins, metrics, parity, runs, sampling
from ..plans.materialize import cut
from .inputs import (
    CLASSES, MODELS, ORDERS, REVIEW_TRUTH, SEEDS, argmax_sql, md5_hash,
    predictions, predictions_sql, rated_orders, review_truth, reviews, sq, table, words,
)
from .registry import query
from .review_queries import EARLY_SQL, _EMOJI_WIDE
from .inputs import REVIEWS


# ----------------------------------------------------- rows with two models each
def two_models(spark, sf) -> DataFrame:
    """Orders with predictions and confidences of two models."""
    base = rated_orders(spark, sf)
    for name, seed in MODELS.items():
        short = {"baseline": "base", "transformer": "tr"}[name]
        scored = predictions(base.select("row_id", "y_true", "grp"), seed)
        cols = scored.select("row_id", F.col("y_pred").alias(f"pred_{short}"),
                             F.col("conf").alias(f"conf_{short}"))
        base = base.join(cols, "row_id")
    return base


def stacked(spark, sf) -> DataFrame:
    """(model, row_id, y_true, grp, p1..p5, y_pred, conf) for both models."""
    rows = rated_orders(spark, sf)
    return reduce(
        DataFrame.unionByName,
        [predictions(rows, seed).withColumn("model", F.lit(name)) for name, seed in MODELS.items()],
    )


_CONF = "greatest(p1, p2, p3, p4, p5)"
STACKED = " UNION ALL ".join(
    f"SELECT '{name}' AS model, row_id, y_true, grp, y_pred, p1, p2, p3, p4, p5, {_CONF} AS conf FROM ({predictions_sql(seed, ORDERS)})"
    for name, seed in MODELS.items()
)
TWO = f"""st AS ({STACKED}), two AS (SELECT b.row_id, b.y_true, b.grp, b.y_pred AS pred_base, t.y_pred AS pred_tr, b.conf AS conf_base, t.conf AS conf_tr
 FROM st b JOIN st t USING (row_id) WHERE b.model = 'baseline' AND t.model = 'transformer')"""


def _cells(y="y_true", p="y_pred", n="1") -> str:
    return ", ".join(
        f"CAST(coalesce(sum(CASE WHEN {y} = {i} AND {p} = {j} THEN {n} END), 0) AS DOUBLE) AS c{(i - 1) * 5 + j - 1}"
        for i in CLASSES for j in CLASSES
    )


def _class_f1(k: int, prefix: str = "c") -> tuple[str, str]:
    i = k - 1
    row = " + ".join(f"{prefix}{i * 5 + j}" for j in range(5))
    col = " + ".join(f"{prefix}{j * 5 + i}" for j in range(5))
    d = f"({row} + {col})"
    return f"CASE WHEN {d} > 0 THEN 2.0 * {prefix}{i * 6} / {d} ELSE 0 END", d


def _macro(prefix: str = "c", present: bool = False) -> str:
    f1 = [_class_f1(k, prefix) for k in CLASSES]
    total = " + ".join(x for x, _ in f1)
    if present:
        seen = " + ".join(f"CASE WHEN {d} > 0 THEN 1 ELSE 0 END" for _, d in f1)
        return f"({total}) / nullif({seen}, 0)"
    return f"({total}) / 5.0"


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def _metrics_sql(source: str, by: str) -> str:
    qwk = ("1 - CAST(sum((y_true - y_pred) * (y_true - y_pred)) AS DOUBLE) / nullif((sum(y_true * y_true) + sum(y_pred * y_pred)) "
           "- 2.0 * sum(y_true) * sum(y_pred) / count(*), 0)")
    f1 = ", ".join(f"round({_class_f1(k)[0]}, 6) AS f1_{k}" for k in CLASSES)
    head = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {head}n, round({_macro()}, 6) AS macro_f1, round(acc, 6) AS accuracy, round(mae, 6) AS mae, round(coalesce(qwk, 0), 6) AS qwk, {f1}
 FROM (SELECT {head}count(*) AS n, {_cells()}, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc,
 avg(CAST(abs(y_true - y_pred) AS DOUBLE)) AS mae, {qwk} AS qwk FROM ({source}) s{group}) t"""


_METRIC_COLS = ["macro_f1", "accuracy", "mae", "qwk", *[f"f1_{k}" for k in CLASSES]]


@query("E1_metric_set", _metrics_sql(STACKED, "model"))
def _(spark, sf):
    return _r(metrics.metrics(stacked(spark, sf), ["model"]), *_METRIC_COLS)


@query("E1_metric_set_per_group", _metrics_sql(STACKED, "model, grp"))
def _(spark, sf):
    return _r(metrics.metrics(stacked(spark, sf), ["model", "grp"]), *_METRIC_COLS)


@query("E2_confusion_matrix", f"""SELECT y_true AS truth, {', '.join(f'count(*) FILTER (y_pred = {k}) AS pred_{k}' for k in CLASSES)}
 FROM ({STACKED}) WHERE model = 'baseline' GROUP BY y_true""")
def _(spark, sf):
    return metrics.confusion_matrix(stacked(spark, sf).where(F.col("model") == "baseline"))


@query("E2_confusion_row_shares", f"""SELECT y_true AS truth, {', '.join(f'count(*) FILTER (y_pred = {k}) / CAST(count(*) AS DOUBLE) AS pred_{k}' for k in CLASSES)}
 FROM ({STACKED}) WHERE model = 'baseline' GROUP BY y_true""")
def _(spark, sf):
    rows = stacked(spark, sf).where(F.col("model") == "baseline")
    return metrics.confusion_matrix(rows, normalize=True)


@query("E3_E4_counts_and_f1", f"""SELECT model, {', '.join(f'CAST(c{i} AS BIGINT) AS c{i}' for i in range(25))},
 round({_macro()}, 6) AS macro_f1, round({_macro(present=True)}, 6) AS present_f1
 FROM (SELECT model, {_cells()} FROM ({STACKED}) WHERE y_true <= 3 GROUP BY model)""")
def _(spark, sf):
    rows = stacked(spark, sf).where(F.col("y_true") <= 3)
    cells = rows.groupBy("model").agg(*metrics.count_cells())
    return cells.withColumns({
        "macro_f1": F.round(metrics.macro_f1(), 6),
        "present_f1": F.round(metrics.macro_f1(present_only=True), 6),
    })


@query("E5_per_class_table", " UNION ALL ".join(
    f"""SELECT model, {k} AS class, n, round(rec, 6) AS recall, round(prec, 6) AS precision, round(CASE WHEN rec + prec > 0 THEN 2 * rec * prec / (rec + prec) ELSE 0 END, 6) AS f1
 FROM (SELECT model, count(*) FILTER (y_true = {k}) AS n,
 CAST(count(*) FILTER (y_true = {k} AND y_pred = {k}) AS DOUBLE) / greatest(count(*) FILTER (y_true = {k}), 1) AS rec,
 CAST(count(*) FILTER (y_true = {k} AND y_pred = {k}) AS DOUBLE) / greatest(count(*) FILTER (y_pred = {k}), 1) AS prec
 FROM ({STACKED}) GROUP BY model)""" for k in CLASSES))
def _(spark, sf):
    return _r(metrics.per_class_table(stacked(spark, sf)), "recall", "precision", "f1")


@query("E6_error_distance", f"""SELECT model, count(*) FILTER (y_true = y_pred) / CAST(count(*) AS DOUBLE) AS exact,
 count(*) FILTER (abs(y_true - y_pred) = 1) / CAST(count(*) AS DOUBLE) AS off_by_1, count(*) FILTER (abs(y_true - y_pred) >= 2) / CAST(count(*) AS DOUBLE) AS off_by_2_plus,
 count(*) FILTER (abs(y_true - y_pred) >= 2) / CAST(nullif(count(*) FILTER (y_true <> y_pred), 0) AS DOUBLE) AS far_among_errors FROM ({STACKED}) GROUP BY model""")
def _(spark, sf):
    return metrics.distance_table(stacked(spark, sf))


_BIN = ("CASE WHEN {0} < 0.4 THEN 0 WHEN {0} < 0.5 THEN 1 WHEN {0} < 0.6 THEN 2 WHEN {0} < 0.7 THEN 3 WHEN {0} < 0.8 THEN 4 "
        "WHEN {0} < 0.9 THEN 5 WHEN {0} < 0.95 THEN 6 WHEN {0} < 1.0001 THEN 7 END")


@query("E8_reliability_table", f"""SELECT model, {_BIN.format('conf')} AS bin, count(*) AS n, round(avg(conf), 6) AS mean_conf,
 round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS acc FROM ({STACKED}) GROUP BY 1, 2""")
def _(spark, sf):
    return _r(metrics.reliability_table(stacked(spark, sf)), "mean_conf", "acc").drop("label")


_ECE = f"""SELECT model, round(sum(n * abs(acc - mc)) / sum(n), 6) AS ece FROM (SELECT model, {_BIN.format('conf')} AS bin, count(*) AS n, avg(conf) AS mc,
 avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc FROM ({STACKED}) GROUP BY 1, 2) GROUP BY model"""


@query("E8_calibration_error", _ECE)
def _(spark, sf):
    return _r(metrics.calibration_error(stacked(spark, sf)), "ece")


@query("P6_confidence_bins", f"""SELECT row_id, CASE {_BIN.format('conf')} WHEN 0 THEN '<0.4' WHEN 1 THEN '0.4-0.5' WHEN 2 THEN '0.5-0.6' WHEN 3 THEN '0.6-0.7'
 WHEN 4 THEN '0.7-0.8' WHEN 5 THEN '0.8-0.9' WHEN 6 THEN '0.9-0.95' WHEN 7 THEN '0.95+' END AS label FROM ({STACKED}) WHERE model = 'transformer'""")
def _(spark, sf):
    rows = stacked(spark, sf).where(F.col("model") == "transformer")
    return rows.select("row_id", bins.confidence_bin(F.col("conf")).alias("label"))


@query("P16_P17_argmax_expected", f"""SELECT row_id, y_pred, round(conf, 9) AS conf, round(p1 + 2 * p2 + 3 * p3 + 4 * p4 + 5 * p5, 6) AS expected_rating,
 round(p1, 4) AS prob_1, round(p5, 4) AS prob_5 FROM ({STACKED}) WHERE model = 'baseline'""")
def _(spark, sf):
    rows = predictions(rated_orders(spark, sf), MODELS["baseline"])
    p = [F.col(c) for c in probs.PROB_COLS]
    shaped = rows.select(
        "row_id", probs.predicted_class(p).alias("y_pred"),
        F.round(probs.confidence(p), 9).alias("conf"),
        F.round(probs.expected_rating(p), 6).alias("expected_rating"),
        probs.prediction_struct(p, F.lit(False)).alias("record"),
    )
    cell = F.col("record")["probabilities"]
    return shaped.select("row_id", "y_pred", "conf", "expected_rating",
                         cell["1"].alias("prob_1"), cell["5"].alias("prob_5"))


@query("P18_prediction_struct", f"""SELECT row_id, y_pred AS rating, round(conf, 4) AS confidence, row_id % 2 = 0 AS truncated, 5 AS n_probs FROM ({STACKED}) WHERE model = 'transformer'""")
def _(spark, sf):
    p = [F.col(c) for c in probs.PROB_COLS]
    record = probs.prediction_struct(p, F.col("row_id") % 2 == 0)
    rows = predictions(rated_orders(spark, sf), MODELS["transformer"]).select("row_id", record.alias("r"))
    return rows.select("row_id", "r.rating", "r.confidence", "r.truncated", F.size("r.probabilities").alias("n_probs"))


@query("P20_label_shift", f"SELECT row_id, y_true - 1 AS label, y_true AS rating FROM ({ORDERS})")
def _(spark, sf):
    rows = rated_orders(spark, sf).select("row_id", probs.to_label(F.col("y_true")).alias("label"))
    return rows.withColumn("rating", probs.to_rating(F.col("label")))


# ----------------------------------------------------------------- agreement
_AGREE = """CASE WHEN y_true = pred_base AND y_true = pred_tr THEN 'both_right' WHEN y_true <> pred_base AND y_true <> pred_tr THEN 'both_wrong'
 WHEN y_true = pred_base THEN 'only_a' ELSE 'only_b' END"""


def _agreed(spark, sf):
    label = errors.agreement_label(F.col("y_true"), F.col("pred_base"), F.col("pred_tr"))
    return two_models(spark, sf).withColumn("agreement", label)


@query("P12_agreement_labels", f"WITH {TWO} SELECT row_id, {_AGREE} AS agreement FROM two")
def _(spark, sf):
    return _agreed(spark, sf).select("row_id", "agreement")


@query("E9_agreement_crosstab", f"""WITH {TWO}, a AS (SELECT *, {_AGREE} AS agreement FROM two) SELECT y_true,
 {', '.join(f"count(*) FILTER (agreement = '{a}') AS {a}" for a in errors.AGREEMENT)} FROM a GROUP BY ROLLUP (y_true)""")
def _(spark, sf):
    return errors.agreement_crosstab(_agreed(spark, sf))


@query("T6_least_confidence", f"""WITH {TWO} SELECT row_id, least(conf_base, conf_tr) AS least_conf FROM two
 WHERE {_AGREE} = 'both_wrong' ORDER BY 2 DESC, 1 LIMIT 12""")
def _(spark, sf):
    wrong = _agreed(spark, sf).where(F.col("agreement") == errors.BOTH_WRONG)
    return sampling.least_confidence_ranking(wrong, 12).select("row_id", "least_conf")


@query("T7_U1_example_rows", f"""WITH {TWO}, a AS (SELECT row_id, {_AGREE} AS agreement, least(conf_base, conf_tr) AS lc FROM two),
 s AS (SELECT row_id, agreement AS example, row_number() OVER (PARTITION BY agreement ORDER BY {md5_hash('42', 'row_id')}, row_id) AS r FROM a WHERE agreement IN ('only_a', 'only_b'))
 SELECT row_id, example FROM s WHERE r <= 12 UNION ALL
 SELECT row_id, 'both_wrong_confident' FROM (SELECT row_id FROM a WHERE agreement = 'both_wrong' ORDER BY lc DESC, row_id LIMIT 12)""")
def _(spark, sf):
    return sampling.example_rows(_agreed(spark, sf), 12, 42).select("row_id", "example")


# -------------------------------------------------------------------- slices
_SLICES = {"priority_hash": "CAST(row_id % 7 AS VARCHAR)", "segment": "CAST(grp % 900 AS VARCHAR)"}


def _slice_sql() -> str:
    parts = []
    for s, e in _SLICES.items():
        for m, p in (("base", "pred_base"), ("tr", "pred_tr")):
            parts.append(f"""SELECT '{s}' AS slice, value, '{m}' AS model, n, round(n / CAST((SELECT count(*) FROM two) AS DOUBLE), 6) AS share,
 round(acc, 6) AS accuracy, round(mae, 6) AS mae, CASE WHEN n >= 100 THEN round({_macro(present=True)}, 6) END AS f1
 FROM (SELECT {e} AS value, count(*) AS n, avg(CASE WHEN y_true = {p} THEN 1.0 ELSE 0.0 END) AS acc, avg(CAST(abs(y_true - {p}) AS DOUBLE)) AS mae,
 {_cells(p=p)} FROM two GROUP BY 1)""")
    return f"WITH {TWO} " + " UNION ALL ".join(parts)


@query("E7_slice_table", _slice_sql())
def _(spark, sf):
    rows = two_models(spark, sf)
    for s, e in _SLICES.items():
        rows = rows.withColumn(s, F.expr(e.replace("VARCHAR", "STRING")))
    table_ = metrics.slice_table(rows, list(_SLICES), {"base": "pred_base", "tr": "pred_tr"})
    return _r(table_, "share", "accuracy", "mae", "f1")


# ---------------------------------------------------------- alignment and errors
def _seed_models(spark, sf) -> dict[str, DataFrame]:
    rows = rated_orders(spark, sf)
    return {name: predictions(rows, seed) for name, seed in SEEDS.items()}


_MEANS = {k: "(" + " + ".join(f"{m}.p{k}" for m in SEEDS) + ") / 3.0" for k in CLASSES}
ENSEMBLE = f"""SELECT s1.row_id, s1.y_true, {', '.join(f'{v} AS p{k}' for k, v in _MEANS.items())}
 FROM {' JOIN '.join(f'({predictions_sql(seed, ORDERS)}) {name}' + ('' if name == 's1' else ' USING (row_id)') for name, seed in SEEDS.items())}"""


@query("E11_J3_ensemble", f"""SELECT row_id, y_true, {argmax_sql()} AS y_pred, round({_CONF}, 9) AS conf FROM ({ENSEMBLE})""")
def _(spark, sf):
    return errors.ensemble(_seed_models(spark, sf)).select("row_id", "y_true", "y_pred", F.round("conf", 9).alias("conf"))


@query("J3_alignment_report", f"SELECT count(*) AS ids, CAST(0 AS BIGINT) AS incomplete, count(*) FILTER (row_id % 10 = 0) AS truth_differs FROM ({ORDERS})")
def _(spark, sf):
    models = _seed_models(spark, sf)
    shifted = F.when(F.col("row_id") % 10 == 0, F.col("y_true") % 5 + 1).otherwise(F.col("y_true"))
    models["s3"] = models["s3"].withColumn("y_true", shifted)
    return joins.alignment_report(models)


@query("J1_J2_key_contract", """SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS left_repeats,
 CAST(0 AS BIGINT) AS right_repeats, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) AS unmatched""")
def _(spark, sf):
    orders = table(spark, sf, "orders").where(F.col("o_orderstatus") == "O")
    return joins.key_report(
        table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k"),
        orders.withColumnRenamed("o_orderkey", "k"), "k",
    )


@query("J2_inner_join_with_filter", "SELECT l.doc_id, d.lang, l.quality FROM labels l JOIN documents d USING (doc_id) WHERE d.lang = 'en'")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang").where(F.col("lang") == "en")
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "lang", "quality")


def _error_table(spark, sf):
    truth = review_truth(spark, sf)
    seeds = {name: predictions(truth, seed) for name, seed in SEEDS.items()}
    clean = reviews(spark, sf).selectExpr(
        "row_id", "coalesce(text, '') AS text", "rubrics", "address AS group_key"
    )
    return errors.error_table(predictions(truth, MODELS["baseline"]), seeds, "s1", clean)


_ENS_REVIEW = ENSEMBLE.replace(ORDERS, REVIEW_TRUTH)
ERROR_TABLE = f"""raw AS ({REVIEWS}), named AS (SELECT row_id, coalesce(text, '') AS text, rubrics FROM raw), {EARLY_SQL},
 base AS ({predictions_sql(MODELS['baseline'], REVIEW_TRUTH)}), s1 AS ({predictions_sql(SEEDS['s1'], REVIEW_TRUTH)}), ens AS ({_ENS_REVIEW}),
 et AS (SELECT b.row_id, b.y_true, b.y_pred AS pred_base, s.y_pred AS pred_tr, {argmax_sql('e.p')} AS pred_ens,
 greatest(b.p1, b.p2, b.p3, b.p4, b.p5) AS conf_base, greatest(e.p1, e.p2, e.p3, e.p4, e.p5) AS conf_ens, n.text,
 length(n.text) AS length_chars, {words('n.text')} AS length_words, CAST(v AS DOUBLE) AS mention,
 CASE WHEN length(n.text) < 50 THEN '<50' WHEN length(n.text) < 100 THEN '50-99' WHEN length(n.text) < 200 THEN '100-199' WHEN length(n.text) < 400 THEN '200-399'
 WHEN length(n.text) < 800 THEN '400-799' ELSE '800+' END AS len_bin,
 CASE WHEN regexp_matches(n.text, '{_EMOJI_WIDE}') THEN 'да' ELSE 'нет' END AS has_emoji,
 CASE WHEN v IS NULL THEN 'нет упоминания' WHEN v = b.y_true THEN 'совпадает с оценкой' ELSE 'не совпадает с оценкой' END AS mention_group,
 coalesce(nullif({sq("split_part(coalesce(n.rubrics, ''), ';', 1)")}, ''), 'без рубрики') AS rubric_main
 FROM base b JOIN s1 s USING (row_id) JOIN ens e USING (row_id) JOIN named n USING (row_id) LEFT JOIN best USING (row_id))"""


@query("E12_error_table", f"""WITH {ERROR_TABLE} SELECT row_id, y_true, pred_base, pred_tr, pred_ens, round(conf_base, 9) AS conf_base, round(conf_ens, 9) AS conf_ens,
 length_chars, length_words, len_bin, has_emoji, mention, mention_group, rubric_main, {_AGREE} AS agreement FROM et""")
def _(spark, sf):
    return _error_table(spark, sf).select(
        "row_id", "y_true", "pred_base", "pred_tr", "pred_ens", F.round("conf_base", 9).alias("conf_base"),
        F.round("conf_ens", 9).alias("conf_ens"), F.col("length_chars").cast("bigint").alias("length_chars"),
        F.col("length_words").cast("bigint").alias("length_words"), "len_bin", "has_emoji", "mention",
        "mention_group", "rubric_main", "agreement",
    )


@query("E7_review_slices", f"WITH {ERROR_TABLE} " + " UNION ALL ".join(
    f"""SELECT '{s}' AS slice, value, '{m}' AS model, n, round(n / CAST((SELECT count(*) FROM et) AS DOUBLE), 6) AS share, round(acc, 6) AS accuracy,
 round(mae, 6) AS mae, CASE WHEN n >= 100 THEN round({_macro(present=True)}, 6) END AS f1 FROM (SELECT {s} AS value, count(*) AS n,
 avg(CASE WHEN y_true = {p} THEN 1.0 ELSE 0.0 END) AS acc, avg(CAST(abs(y_true - {p}) AS DOUBLE)) AS mae, {_cells(p=p)} FROM et GROUP BY 1)"""
    for s in ("len_bin", "has_emoji", "mention_group") for m, p in (("base", "pred_base"), ("tr", "pred_tr"))))
def _(spark, sf):
    rows = _error_table(spark, sf)
    out = metrics.slice_table(rows, ["len_bin", "has_emoji", "mention_group"], {"base": "pred_base", "tr": "pred_tr"})
    return _r(out, "share", "accuracy", "mae", "f1")


@query("N8_mention_mismatch", f"""WITH {ERROR_TABLE} SELECT count(*) AS n, count(mention) / CAST(count(*) AS DOUBLE) AS with_mention,
 count(*) FILTER (mention <> y_true) / CAST(count(mention) AS DOUBLE) AS mismatch FROM et""")
def _(spark, sf):
    return errors.mention_mismatch(_error_table(spark, sf))


# ----------------------------------------------------------------- bootstrap
_PAIRS = (("transformer", "baseline"),)
_BOOT_MODELS = {"baseline": "pred_base", "transformer": "pred_tr"}


def _boot_cells(p: str, name: str) -> str:
    return ", ".join(
        f"count(*) FILTER (y_true = {i} AND {p} = {j}) AS {name}{(i - 1) * 5 + j - 1}" for i in CLASSES for j in CLASSES
    )


_SUMS = ", ".join(f"CAST(sum(w * {m}{i}) AS DOUBLE) AS {m}{i}" for m in ("a", "b") for i in range(25))
_BOOT = f"""WITH {TWO}, g AS (SELECT grp, {_boot_cells('pred_base', 'a')}, {_boot_cells('pred_tr', 'b')} FROM two GROUP BY grp),
 p AS (SELECT *, row_number() OVER (ORDER BY {md5_hash('42', 'grp')}, grp) - 1 AS pos FROM g), k AS (SELECT count(*) AS gn FROM g),
 d AS (SELECT rep, {md5_hash('42', 'rep', 'pos')} % gn AS pos FROM p, k, range(1000) r(rep)),
 wt AS (SELECT rep, pos, count(*) AS w FROM d GROUP BY 1, 2), s AS (SELECT rep, {_SUMS} FROM wt JOIN p USING (pos) GROUP BY rep),
 f AS (SELECT {_macro('a')} AS fa, {_macro('b')} AS fb FROM s),
 t AS (SELECT {_macro('a')} AS fa, {_macro('b')} AS fb FROM (SELECT {_SUMS.replace('w * ', '')} FROM g)),
 o AS (SELECT 'baseline' AS name, (SELECT fa FROM t) AS estimate, quantile_cont(fa, 0.025) AS low, quantile_cont(fa, 0.975) AS high, false AS d FROM f
 UNION ALL SELECT 'transformer', (SELECT fb FROM t), quantile_cont(fb, 0.025), quantile_cont(fb, 0.975), false FROM f
 UNION ALL SELECT 'transformer - baseline', (SELECT fb - fa FROM t), quantile_cont(fb - fa, 0.025), quantile_cont(fb - fa, 0.975), true FROM f)
 SELECT name, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN d THEN low > 0 OR high < 0 END AS significant FROM o"""


@query("E10_E13_bootstrap_hashed_draws", _BOOT)
def _(spark, sf):
    out = bootstrap.cluster_bootstrap(
        two_models(spark, sf), _BOOT_MODELS, "grp", 1000, 42, _PAIRS, bootstrap.hashed_draws
    )
    return _r(out, "estimate", "low", "high")


@query("E10_E13_cluster_bootstrap")
def _(spark, sf):
    return bootstrap.cluster_bootstrap(two_models(spark, sf), _BOOT_MODELS, "grp", 1000, 42, _PAIRS)


@query("E10_E13_block_against_hashed_draws", "SELECT name, true AS same_estimate, true AS close_limits FROM (VALUES ('baseline'), ('transformer'), ('transformer - baseline')) v(name)")
def _(spark, sf):
    """The production draw against the checkable one: equal estimates, and limits at most a
    quarter of the interval apart."""
    rows = cut(two_models(spark, sf))
    runs_ = [bootstrap.cluster_bootstrap(rows, _BOOT_MODELS, "grp", 1000, 42, _PAIRS, draws=d)
             for d in (bootstrap.block_draws, bootstrap.hashed_draws)]
    other = runs_[1].select("name", *[F.col(c).alias(f"o_{c}") for c in ("estimate", "low", "high")])
    near = lambda c: F.abs(F.col(c) - F.col(f"o_{c}")) <= (F.col("o_high") - F.col("o_low")) / 4
    return runs_[0].join(other, "name").select(
        "name", (F.abs(F.col("estimate") - F.col("o_estimate")) < 1e-12).alias("same_estimate"),
        (near("low") & near("high")).alias("close_limits"))


# --------------------------------------------------------------- calibration
def _temper_sql(t: str) -> dict[int, str]:
    z = {k: f"ln(least(greatest(p{k}, 1e-12), 1.0)) / {t}" for k in CLASSES}
    top = f"greatest({', '.join(z.values())})"
    e = {k: f"exp({v} - {top})" for k, v in z.items()}
    return {k: f"{v} / ({' + '.join(e.values())})" for k, v in e.items()}


@query("C1_apply_temperature", f"""SELECT row_id, {', '.join(f'round({v}, 6) AS p{k}' for k, v in _temper_sql('1.7').items())} FROM ({STACKED}) WHERE model = 'transformer'""")
def _(spark, sf):
    rows = predictions(rated_orders(spark, sf), MODELS["transformer"])
    return _r(calibration.apply_temperature(rows, 1.7).select("row_id", *probs.PROB_COLS), *probs.PROB_COLS)


_PY = "CASE y_true WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 WHEN 4 THEN p4 ELSE p5 END"
_LOSS = f"-ln(least(greatest({_PY}, 1e-12), 1.0))"
_BRIER = " + ".join(f"(p{k} - CASE WHEN y_true = {k} THEN 1 ELSE 0 END) ** 2" for k in CLASSES)


@query("C2_C3_log_loss_brier", f"SELECT round(avg({_LOSS}), 6) AS log_loss, round(avg({_BRIER}), 6) AS brier FROM ({STACKED}) WHERE model = 'baseline'")
def _(spark, sf):
    rows = predictions(rated_orders(spark, sf), MODELS["baseline"])
    loss = calibration.log_loss(rows).scalar()
    return calibration.brier(rows).select(F.round(loss, 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


def _evaluate_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, CAST(sum(n) AS BIGINT) AS n, round(sum(l) / sum(n), 6) AS log_loss, round(sum(b) / sum(n), 6) AS brier, round(sum(abs(ok - c)) / sum(n), 6) AS ece,
 round(sum(c) / sum(n), 6) AS mean_conf, round(sum(ok) / sum(n), 6) AS accuracy FROM (SELECT {by}, {_BIN.format(_CONF)} AS bin, count(*) AS n, sum({_LOSS}) AS l,
 sum({_BRIER}) AS b, sum({_CONF}) AS c, sum(CASE WHEN {argmax_sql()} = y_true THEN 1.0 ELSE 0.0 END) AS ok FROM ({source}) x GROUP BY {by}, 2{', 3' if ',' in by else ''}) y GROUP BY {by}"""


_EVAL_COLS = ["log_loss", "brier", "ece", "mean_conf", "accuracy"]


@query("C5_calibration_metrics", _evaluate_sql(STACKED, "model"))
def _(spark, sf):
    return _r(calibration.evaluate(stacked(spark, sf), ["model"]), *_EVAL_COLS)


GRID = [round(0.05 * 400 ** (i / 40), 6) for i in range(41)]


@query("C4_temperature_grid", f"""WITH z AS (SELECT y_true, {', '.join(f'ln(least(greatest(p{k}, 1e-12), 1.0)) AS z{k}' for k in CLASSES)},
 ln(least(greatest({_PY}, 1e-12), 1.0)) AS zy FROM ({STACKED}) WHERE model = 'transformer'), g AS (SELECT unnest({GRID}::DOUBLE[]) AS temperature)
 SELECT temperature, round(avg(ln({' + '.join(f'exp(z{k} / temperature)' for k in CLASSES)}) - zy / temperature), 6) AS log_loss
 FROM z, g GROUP BY temperature ORDER BY 2, 1""")
def _(spark, sf):
    rows = predictions(rated_orders(spark, sf), MODELS["transformer"])
    return _r(calibration.temperature_grid(rows, GRID), "log_loss")


# Newton steps on the convex loss in 1/T, as a recursive query.
def _newton(model: str) -> str:
    e = [f"exp(b * z{k})" for k in CLASSES]
    s = " + ".join(e)
    m = "(" + " + ".join(f"{x} * z{k}" for x, k in zip(e, CLASSES)) + f") / ({s})"
    q = "(" + " + ".join(f"{x} * z{k} * z{k}" for x, k in zip(e, CLASSES)) + f") / ({s})"
    return f"""SELECT 0 AS i, CAST(1 AS DOUBLE) AS b UNION ALL SELECT i + 1, any_value(b) - avg({m} - zy) / avg({q} - ({m}) * ({m}))
 FROM it, z WHERE i < 12 AND z.model = '{model}' GROUP BY i"""


_SPLIT = "CASE WHEN row_id % 2 = 0 THEN 'val' ELSE 'test' END"
_CAL = f"""z AS (SELECT model, {', '.join(f'ln(least(greatest(p{k}, 1e-12), 1.0)) AS z{k}' for k in CLASSES)}, ln(least(greatest({_PY}, 1e-12), 1.0)) AS zy
 FROM st WHERE row_id % 2 = 0)"""


def _fitted_sql() -> str:
    return f"""WITH RECURSIVE st AS ({STACKED}), {_CAL}, it AS ({_newton('baseline')})
 SELECT 'baseline' AS model, round(1 / b, 5) AS temperature FROM it WHERE i = 12 UNION ALL
 SELECT * FROM (WITH RECURSIVE it AS ({_newton('transformer')}) SELECT 'transformer' AS model, round(1 / b, 5) AS temperature FROM it WHERE i = 12)"""


def _by_split(spark, sf):
    split = F.when(F.col("row_id") % 2 == 0, "val").otherwise("test")
    return stacked(spark, sf).withColumn("split", split)


@query("C4_fit_temperature", _fitted_sql())
def _(spark, sf):
    temperatures, _ = calibration.calibrate(_by_split(spark, sf))
    rows = [(m, round(t, 5)) for m, t in temperatures.items()]
    return spark.createDataFrame(rows, "model string, temperature double")


_AFTER = ", ".join(f"{v} AS p{k}" for k, v in _temper_sql("t.temperature").items())


@query("C6_before_after_table", f"""WITH tt AS ({_fitted_sql().replace(', 5) AS temperature', ', 12) AS temperature')}), sp AS (SELECT *, {_SPLIT} AS split FROM ({STACKED})),
 ba AS (SELECT model, split, 'before' AS stage, y_true, p1, p2, p3, p4, p5 FROM sp UNION ALL
 SELECT sp.model, split, 'after', y_true, {_AFTER} FROM sp JOIN tt t USING (model))
 SELECT * EXCLUDE (k), 0::BIGINT AS argmax_changed, split_part(k, '/', 1) AS model, split_part(k, '/', 2) AS split, split_part(k, '/', 3) AS stage FROM
 ({_evaluate_sql("SELECT *, model || '/' || split || '/' || stage AS k FROM ba", 'k')})""")
def _(spark, sf):
    _, out = calibration.calibrate(_by_split(spark, sf))
    return _r(out.drop("temperature"), *_EVAL_COLS)


# ------------------------------------------------------- analysis of one part
def _analysis_sql(split: str) -> str:
    part = f"(SELECT *, {_AGREE} AS agreement FROM two WHERE {_SPLIT} = '{split}')"
    rows = [f"SELECT 'errors' AS section, agreement AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS value FROM {part} GROUP BY agreement"]
    for m, p in (("base", "pred_base"), ("tr", "pred_tr")):
        rows.append(f"SELECT 'slices', 'agreement/' || agreement || '/{m}', count(*), round(avg(CASE WHEN y_true = {p} THEN 1.0 ELSE 0.0 END), 6) FROM {part} GROUP BY agreement")
        rows.append(f"SELECT 'bootstrap', '{m}', n, round({_macro()}, 6) FROM (SELECT count(*) AS n, {_cells(p=p)} FROM {part})")
    return f"""WITH {TWO}, tt AS ({_fitted_sql().replace(', 5) AS temperature', ', 12) AS temperature')}), sp AS (SELECT * FROM (SELECT *, {_SPLIT} AS split FROM ({STACKED})) WHERE split = '{split}'),
 ba AS (SELECT model, 'before' AS stage, y_true, p1, p2, p3, p4, p5 FROM sp UNION ALL SELECT sp.model, 'after', y_true, {_AFTER} FROM sp JOIN tt t USING (model))
 {' UNION ALL '.join(rows)} UNION ALL SELECT 'calibration', k, n, log_loss FROM ({_evaluate_sql("SELECT *, model || '/' || stage AS k FROM ba", 'k')})"""


def _analysis(spark, sf, split: str, **options) -> DataFrame:
    rows = two_models(spark, sf).withColumn("split", F.expr(_SPLIT.replace("VARCHAR", "STRING")))
    label = errors.agreement_label(F.col("y_true"), F.col("pred_base"), F.col("pred_tr"))
    found = analysis.analyse(rows.withColumn("agreement", label), _by_split(spark, sf), split, ["agreement"], "grp", **options)
    total = found["errors"].agg(F.count(F.lit(1))).scalar()
    parts = [
        found["errors"].groupBy(F.col("agreement").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("value")).select(F.lit("errors").alias("section"), "key", "n", "value"),
        found["slices"].select(F.lit("slices").alias("section"), F.concat_ws("/", "slice", "value", "model").alias("key"), "n", F.col("accuracy").alias("value")),
        found["bootstrap"].where("significant is null").select(F.lit("bootstrap").alias("section"), F.col("name").alias("key"), total.alias("n"), F.col("estimate").alias("value")),
        found["calibration"].select(F.lit("calibration").alias("section"), F.concat_ws("/", "model", "stage").alias("key"), "n", F.col("log_loss").alias("value")),
    ]
    return _r(reduce(DataFrame.unionByName, parts), "value")


@query("E14_analysis_val", _analysis_sql("val"))
def _(spark, sf):
    return _analysis(spark, sf, "val")


@query("E14_analysis_test", _analysis_sql("test"))
def _(spark, sf):
    return _analysis(spark, sf, "test", allow_test=True)


# -------------------------------------------------------------------- parity
_PARITY = f"""a AS (SELECT * FROM ({STACKED}) WHERE model = 'transformer'), b AS ({predictions_sql(3, ORDERS)}),
 pr AS (SELECT row_id, a.y_pred AS pred_a, b.y_pred AS pred_b, greatest({', '.join(f'abs(a.p{k} - b.p{k})' for k in CLASSES)}) AS gap FROM a JOIN b USING (row_id))"""


@query("M9_parity_check", f"""WITH {_PARITY} SELECT count(*) AS n, round(quantile_cont(gap, 0.5), 9) AS median, round(quantile_cont(gap, 0.95), 9) AS p95, round(max(gap), 9) AS maximum,
 round(avg(CASE WHEN pred_a = pred_b THEN 1.0 ELSE 0.0 END), 9) AS agreement, count(*) FILTER (pred_a <> pred_b) AS differing,
 2 * (SELECT count(*) FROM orders) - 2 * count(*) AS incomplete,
 avg(CASE WHEN pred_a = pred_b THEN 1.0 ELSE 0.0 END) >= 0.97 AND quantile_cont(gap, 0.5) <= 0.01 AS passed FROM pr""")
def _(spark, sf):
    rows = rated_orders(spark, sf)
    out = parity.parity_check(predictions(rows, MODELS["transformer"]), predictions(rows, 3))
    return _r(out, "median", "p95", "maximum", "agreement", digits=9)


@query("M9_parity_mismatches", f"WITH {_PARITY} SELECT row_id, pred_a, pred_b, round(gap, 9) AS max_gap FROM pr WHERE pred_a <> pred_b ORDER BY row_id LIMIT 10")
def _(spark, sf):
    rows = rated_orders(spark, sf)
    out = parity.mismatches(predictions(rows, MODELS["transformer"]), predictions(rows, 3))
    return _r(out, "max_gap", digits=9)


# ------------------------------------------------------------ runs and latency
@query("A20_seed_statistics", """SELECT event_type AS model, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std
 FROM events GROUP BY event_type""")
def _(spark, sf):
    rows = table(spark, sf, "events").withColumnRenamed("event_type", "model")
    return _r(runs.seed_statistics(rows, ["model"], "value"), "mean", "std")


_RUNS = """SELECT CAST(10000 * (1 + user_id % 4) AS BIGINT) AS size, user_id AS seed, event_type AS model, value / 100.0 + CAST(user_id % 4 AS DOUBLE) / 50.0 AS macro_f1,
 value / 50.0 AS mae, 1.0 - value / 200.0 AS accuracy, value AS train_time, value / 10.0 AS inference_time FROM events"""
_SUMMARY = """SELECT size, avg(macro_f1) AS f1_mean, coalesce(stddev_samp(macro_f1), 0) AS f1_std, avg(mae) AS mae_mean, coalesce(stddev_samp(mae), 0) AS mae_std,
 avg(accuracy) AS acc_mean, avg(train_time) AS train_time, avg(inference_time) AS infer_time FROM r GROUP BY size"""


def _run_rows(spark, sf):
    cols = _RUNS[len("SELECT "):_RUNS.index(" FROM events")]
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(cols):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(cols[start:i])
            start = i + 1
    return table(spark, sf, "events").selectExpr(*parts, cols[start:])


_SUM_COLS = ["f1_mean", "f1_std", "mae_mean", "mae_std", "acc_mean", "train_time", "infer_time"]


@query("A21_learning_curve_summary", f"WITH r AS ({_RUNS}), s AS ({_SUMMARY}) SELECT size, {', '.join(f'round({c}, 6) AS {c}' for c in _SUM_COLS)} FROM s")
def _(spark, sf):
    return _r(runs.summarize_runs(_run_rows(spark, sf)), *_SUM_COLS)


@query("W4_plateau_rule", f"""WITH r AS ({_RUNS}), s AS ({_SUMMARY}), g AS (SELECT size, lead(f1_mean) OVER (ORDER BY size) - f1_mean AS gain,
 greatest(f1_std, lead(f1_std) OVER (ORDER BY size), 0.005) AS noise FROM s) SELECT coalesce(min(size) FILTER (gain < noise), max(size)) AS chosen_size FROM g""")
def _(spark, sf):
    return runs.choose_size(runs.summarize_runs(_run_rows(spark, sf)), 0.005)


@query("A22_latency_profile", """SELECT count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95,
 round(count(value) * 1000.0 / sum(value), 6) AS per_second FROM events""")
def _(spark, sf):
    return _r(runs.latency_profile(table(spark, sf, "events"), "value"), "per_second")


@query("A25_model_comparison", f"""WITH r AS ({_RUNS}), q AS (SELECT model, count(*) AS runs, avg(macro_f1) AS f1_mean, coalesce(stddev_samp(macro_f1), 0) AS f1_std, avg(mae) AS mae_mean,
 avg(train_time) / 60.0 AS train_minutes, avg(inference_time) / 5000.0 * 1000.0 AS seconds_per_1000 FROM r WHERE model <> 'signup' GROUP BY model),
 c AS (SELECT event_type AS model, max(value) AS size_mb, 1000.0 / avg(value) AS cpu_seconds_per_1000 FROM events WHERE event_type <> 'error' GROUP BY 1)
 SELECT coalesce(q.model, c.model) AS model, runs, round(f1_mean, 6) AS f1_mean, round(f1_std, 6) AS f1_std, round(mae_mean, 6) AS mae_mean,
 round(train_minutes, 6) AS train_minutes, round(seconds_per_1000, 6) AS seconds_per_1000, size_mb, round(cpu_seconds_per_1000, 6) AS cpu_seconds_per_1000
 FROM q FULL JOIN c ON q.model = c.model""")
def _(spark, sf):
    costs = table(spark, sf, "events").where(F.col("event_type") != "error").groupBy(
        F.col("event_type").alias("model")
    ).agg(F.max("value").alias("size_mb"), F.avg("value").alias("texts_per_second"))
    rows = _run_rows(spark, sf).where(F.col("model") != "signup")
    out = runs.model_comparison(rows, costs, 5000)
    return _r(out, "f1_mean", "f1_std", "mae_mean", "train_minutes", "seconds_per_1000", "cpu_seconds_per_1000")
