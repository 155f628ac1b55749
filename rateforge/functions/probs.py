"""Class-probability expressions over five columns p1..p5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CLASSES = (1, 2, 3, 4, 5)
PROB_COLS = tuple(f"p{c}" for c in CLASSES)
EPS = 1e-12


def columns(prefix: str = "p") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in CLASSES]


def confidence(probs: list[Column]) -> Column:
    return F.greatest(*probs)


def predicted_class(probs: list[Column]) -> Column:
    """1-based argmax; ties go to the lowest class."""
    best = F.greatest(*probs)
    chain = F.when(probs[0] == best, F.lit(1))
    for c, p in zip(CLASSES[1:-1], probs[1:-1]):
        chain = chain.when(p == best, F.lit(c))
    return chain.otherwise(F.lit(CLASSES[-1]))


def expected_rating(probs: list[Column]) -> Column:
    total = probs[0]
    for c, p in zip(CLASSES[1:], probs[1:]):
        total = total + p * F.lit(float(c))
    return total


def log_prob(p: Column) -> Column:
    return F.ln(F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0)))


def log_prob_sql(column: str) -> str:
    return f"ln(least(greatest({column}, {EPS}D), 1D))"


def with_tempered(df: DataFrame, temperature, source: str = "p", out: str = "p") -> DataFrame:
    """Set out1..out5 to softmax(ln p / T), shifted by the row maximum.

    T is a number or the name of a column.  The steps are separate projections, so each
    logarithm and exponential is written once in the generated code.
    """
    t = f"`{temperature}`" if isinstance(temperature, str) else f"{float(temperature)!r}D"
    keep = [f"`{c}`" for c in df.columns if c not in {f"{out}{k}" for k in CLASSES}]
    z = [f"{log_prob_sql(f'{source}{c}')} / {t} AS _z{c}" for c in CLASSES]
    step = df.selectExpr("*", *z).selectExpr(
        *keep, *[f"_z{c}" for c in CLASSES], "greatest(_z1, _z2, _z3, _z4, _z5) AS _top"
    )
    step = step.selectExpr(*keep, *[f"exp(_z{c} - _top) AS _e{c}" for c in CLASSES])
    total = " + ".join(f"_e{c}" for c in CLASSES)
    return step.selectExpr(*keep, *[f"_e{c} / ({total}) AS {out}{c}" for c in CLASSES])


def prob_of_class(probs: list[Column], y: Column) -> Column:
    chain = F.when(y == CLASSES[0], probs[0])
    for c, p in zip(CLASSES[1:], probs[1:]):
        chain = chain.when(y == c, p)
    return chain


def row_log_loss(probs: list[Column], y: Column) -> Column:
    return -log_prob(prob_of_class(probs, y))


def one_hot(y: Column) -> Column:
    """Five 0/1 values marking the class."""
    return F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (k == y).cast("int"))


def row_brier(probs: list[Column], y: Column) -> Column:
    terms = [(p - (y == c).cast("double")) ** 2 for c, p in zip(CLASSES, probs)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def prediction_struct(probs: list[Column], truncated: Column) -> Column:
    """Rounded result record: rating, confidence, expected rating, probabilities, cut flag."""
    keys = F.array(*[F.lit(str(c)) for c in CLASSES])
    return F.struct(
        predicted_class(probs).alias("rating"),
        F.round(confidence(probs), 4).alias("confidence"),
        F.round(expected_rating(probs), 3).alias("expected_rating"),
        F.map_from_arrays(keys, F.array(*[F.round(p, 4) for p in probs])).alias("probabilities"),
        truncated.alias("truncated"),
    )


def to_label(rating: Column) -> Column:
    return rating - 1


def to_rating(label: Column) -> Column:
    return label + 1
