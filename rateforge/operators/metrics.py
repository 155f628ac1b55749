"""Classification metrics from confusion counts.

Rows collapse to (truth, prediction) counts in one partial aggregation; all the
metrics are arithmetic on at most 25 cells per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bins import CONF_EDGES, CONF_LABELS, bin_index, bin_label
from ..functions.probs import CLASSES


def models_long(df: DataFrame, models: dict[str, str], keep: list[str], conf: dict | None = None):
    """One row per (row, model) with ``y_pred`` and, if given, ``conf``."""
    cells = []
    for name, column in models.items():
        fields = [F.lit(name).alias("model"), F.col(column).alias("y_pred")]
        if conf:
            fields.append(F.col(conf[name]).alias("conf"))
        cells.append(F.struct(*fields))
    return df.select(*keep, F.inline(F.array(*cells)))


def confusion_counts(
    df: DataFrame, by: list[str] = (), y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    """(by..., y_true, y_pred, n)."""
    return df.groupBy(*by, F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def count_cells(y: str = "y_true", p: str = "y_pred", n: str = "1", name: str = "c") -> list[Column]:
    """25 aggregates: rows with truth i and prediction j, in row-major order.

    The expressions are generated as SQL text: one parse each instead of a chain of
    driver calls.
    """
    return [
        F.expr(f"coalesce(sum(CASE WHEN ({y} - 1) * 5 + {p} - 1 = {i} THEN {n} END), 0L) AS `{name}{i}`")
        for i in range(25)
    ]


def _sum_of(cells: list[str]) -> str:
    return " + ".join(f"`{c}`" for c in cells)


def class_f1(name: str = "c") -> tuple[list[str], list[str]]:
    """Per class: F1 (0 when undefined) and its denominator, as SQL over 25 cells."""
    f1, denominators = [], []
    for c in range(5):
        actual = _sum_of([f"{name}{c * 5 + j}" for j in range(5)])
        said = _sum_of([f"{name}{i * 5 + c}" for i in range(5)])
        d = f"CAST({actual} + {said} AS DOUBLE)"
        denominators.append(d)
        f1.append(f"coalesce(try_divide(2D * `{name}{c * 6}`, {d}), 0D)")
    return f1, denominators


def macro_f1(name: str = "c", present_only: bool = False) -> Column:
    """Mean F1 over all five classes, or over those seen in truth or prediction."""
    f1, d = class_f1(name)
    total = " + ".join(f1)
    if not present_only:
        return F.expr(f"({total}) / 5D")
    seen = " + ".join(f"CAST({x} > 0 AS INT)" for x in d)
    return F.expr(f"try_divide({total}, CAST({seen} AS DOUBLE))")


def metrics(df: DataFrame, by: list[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """macro-F1, accuracy, MAE, quadratic kappa and per-class F1 for every group.

    The expected squared distance in kappa follows from the moments of the two margins.
    """
    by = list(by)
    sums = confusion_counts(df, by, y, p).groupBy(*by).agg(
        *count_cells(n="n"),
        *[F.expr(e) for e in (
            "sum(n) AS n", "sum(IF(y_true = y_pred, n, 0L)) AS hits",
            "sum(n * abs(y_true - y_pred)) AS abs_error",
            "sum(n * (y_true - y_pred) * (y_true - y_pred)) AS sq_error",
            "sum(n * y_true) AS sy", "sum(n * y_pred) AS sp",
            "sum(n * y_true * y_true) AS syy", "sum(n * y_pred * y_pred) AS spp",
        )],
    )
    f1, _ = class_f1()
    chance = "(CAST(syy + spp AS DOUBLE) - 2D * sy * sp / n)"
    return sums.selectExpr(
        *by, "n",
        f"({' + '.join(f1)}) / 5D AS macro_f1",
        "CAST(hits AS DOUBLE) / n AS accuracy",
        "CAST(abs_error AS DOUBLE) / n AS mae",
        f"coalesce(1D - try_divide(CAST(sq_error AS DOUBLE), {chance}), 0D) AS qwk",
        *[f"{f} AS f1_{c}" for c, f in zip(CLASSES, f1)],
    )


def confusion_matrix(
    df: DataFrame, y: str = "y_true", p: str = "y_pred", normalize: bool = False
) -> DataFrame:
    """5x5 table over all classes, as counts or as shares of the true class."""
    cells = df.agg(*count_cells(y, p))
    rows = [
        F.struct(
            F.lit(c).alias("truth"),
            *[F.col(f"c{i * 5 + j}").alias(f"pred_{k}") for j, k in enumerate(CLASSES)],
        )
        for i, c in enumerate(CLASSES)
    ]
    table = cells.select(F.inline(F.array(*rows)))
    if not normalize:
        return table
    names = [f"pred_{k}" for k in CLASSES]
    size = F.greatest(sum((F.col(c) for c in names[1:]), F.col(names[0])), F.lit(1))
    return table.select(
        "truth", *[(F.col(c).cast("double") / size.cast("double")).alias(c) for c in names]
    )


def per_class_table(long: DataFrame) -> DataFrame:
    """Rows, recall, precision and F1 per (model, class); denominators are at least 1."""
    counts = confusion_counts(long, ["model"])
    stats = counts.groupBy("model").agg(*count_cells(n="n"))
    entries = []
    for i, c in enumerate(CLASSES):
        actual = _sum_of([f"c{i * 5 + j}" for j in range(5)])
        said = _sum_of([f"c{j * 5 + i}" for j in range(5)])
        entries.append(f"struct({c} AS class, {actual} AS n, {said} AS said, c{i * 6} AS tp)")
    table = stats.selectExpr("model", f"inline(array({', '.join(entries)}))")

    def ratio(a, b):
        return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")

    table = table.withColumns({"recall": ratio("tp", "n"), "precision": ratio("tp", "said")})
    f1 = F.try_divide(
        2.0 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")
    )
    return table.select(
        "model", "class", "n", "recall", "precision", F.coalesce(f1, F.lit(0.0)).alias("f1")
    )


def distance_table(long: DataFrame) -> DataFrame:
    """Shares of exact, off-by-one and off-by-two-or-more answers per model."""
    d = F.abs(F.col("y_true") - F.col("y_pred"))
    n = F.count(F.lit(1)).cast("double")
    return long.groupBy("model").agg(
        (F.count_if(d == 0) / n).alias("exact"),
        (F.count_if(d == 1) / n).alias("off_by_1"),
        (F.count_if(d >= 2) / n).alias("off_by_2_plus"),
        F.try_divide(F.count_if(d >= 2).cast("double"), F.count_if(d > 0).cast("double")).alias(
            "far_among_errors"
        ),
    )


def slice_table(
    df: DataFrame, slices: list[str], models: dict[str, str], min_n: int = 100
) -> DataFrame:
    """Accuracy, MAE and present-class macro-F1 per slice value and model.

    Rows first collapse to counts per combination of slice values, truth and
    predictions; only those combinations are repeated per slice and model.
    """
    combos = df.groupBy(*slices, "y_true", *models.values()).agg(
        F.count(F.lit(1)).alias("w")
    )
    cells = [
        F.struct(
            F.lit(s).alias("slice"), F.col(s).cast("string").alias("value"),
            F.lit(m).alias("model"), F.col(c).alias("y_pred"),
        )
        for s in slices
        for m, c in models.items()
    ]
    long = combos.select("y_true", "w", F.inline(F.array(*cells))).where(
        F.col("value").isNotNull()
    )
    stats = long.groupBy("slice", "value", "model").agg(
        *count_cells(n="w"), F.sum("w").alias("n"),
        F.expr("sum(IF(y_true = y_pred, w, 0L)) AS hits"),
        F.expr("sum(w * abs(y_true - y_pred)) AS abs_error"),
    )
    total = combos.agg(F.sum("w")).scalar().cast("double")
    n = F.col("n").cast("double")
    f1 = macro_f1(present_only=True)
    return stats.select(
        "slice", "value", "model", "n", (n / total).alias("share"),
        (F.col("hits").cast("double") / n).alias("accuracy"),
        (F.col("abs_error").cast("double") / n).alias("mae"),
        F.when(F.col("n") >= min_n, f1).alias("f1"),
    )


def reliability_table(long: DataFrame) -> DataFrame:
    """Per model and confidence bin: rows, mean confidence, accuracy."""
    inside = (F.col("conf") >= CONF_EDGES[0]) & (F.col("conf") < CONF_EDGES[-1])
    binned = long.where(inside).withColumn("bin", bin_index(F.col("conf"), CONF_EDGES))
    return (
        binned.groupBy("model", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("conf").alias("mean_conf"),
            F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("acc"),
        )
        .withColumn("label", bin_label(F.col("bin"), CONF_LABELS))
    )


def calibration_error(long: DataFrame) -> DataFrame:
    """Expected calibration error per model from the unrounded bins."""
    bins = reliability_table(long)
    gap = F.col("n") * F.abs(F.col("acc") - F.col("mean_conf"))
    return bins.groupBy("model").agg((F.sum(gap) / F.sum("n")).alias("ece"))
