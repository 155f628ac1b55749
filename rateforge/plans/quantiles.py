"""Exact, linearly interpolated quantiles that never gather raw rows in one task."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def interpolated(
    df: DataFrame, value: str, probs: dict[str, float], by: list[str] = (), mean: str | None = None
) -> DataFrame:
    """Quantiles of an integer measure such as a length or a group size.

    Rows collapse to (key, value, count) before the final aggregate, whose state
    holds the distinct values only.  ``mean`` names a column for the mean, which the
    same counts give.
    """
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_f"))
    )
    q = F.percentile(F.col(value), F.array(*[F.lit(p) for p in probs.values()]), F.col("_f"))
    average = F.sum(F.col(value) * F.col("_f")) / F.sum("_f").cast("double")
    out = counts.groupBy(*by).agg(q.alias("_q"), F.sum("_f").alias("n"), *([average.alias(mean)] if mean else []))
    quantiles = [F.get("_q", F.lit(i)).alias(k) for i, k in enumerate(probs)]
    return out.select(*by, "n", *quantiles, *([mean] if mean else []))


_DIGIT = 16
_INFINITY = 2047 << 52


def ordered_image(value: Column) -> Column:
    """A double as a bigint in the same order: sign and magnitude of its bit pattern.

    Exponent and fraction come out of exact operations (comparisons, products and
    quotients of powers of two).  Both zeros are 0; a NaN is above infinity, as Spark
    sorts it."""
    a, least = F.abs(value), 2.0 ** -1022
    normal = F.when((a >= least) & (a < F.lit(math.inf)), a).otherwise(1.0)
    # log2 may be one off beside a power of two; the comparisons put it right.
    guess = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(normal)).cast("int")))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    e = F.when(power(guess) > normal, guess - 1).when((guess < 1023) & (power(guess + 1) <= normal), guess + 1).otherwise(guess)
    fraction = ((normal / power(e) - 1.0) * float(1 << 52)).cast("bigint")
    tiny = (F.when(a < least, a).otherwise(0.0) * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("bigint")
    bits = (
        F.when(F.isnan(value), F.lit(_INFINITY + 1)).when(a == F.lit(math.inf), F.lit(_INFINITY))
        .when(a < least, tiny).otherwise(F.shiftleft((e + 1023).cast("bigint"), 52) + fraction)
    )
    return F.when((value < 0.0) & ~F.isnan(value), -bits).otherwise(bits)


def double_of(image: int) -> float:
    """The double that has this ordered image."""
    if abs(image) > _INFINITY:
        return math.nan
    value = struct.unpack("<d", struct.pack("<q", abs(image)))[0]
    return -value if image < 0 else value


def interpolated_wide(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles of a continuous measure with unboundedly many distinct values.

    Radix selection over the ordered image of the values, 16 bits a pass: four counting
    passes whatever the number of rows or their values, each a grouped count of at most
    65,536 digits for every prefix still wanted (two a quantile).
    """
    images = df.where(F.col(value).isNotNull()).select(ordered_image(F.col(value).cast("double")).alias("u"))
    wanted: dict[int, tuple[int, int]] = {}  # rank from 0: (prefix of the image, rank inside it)
    n = None
    for level in range(4):
        low = 48 - _DIGIT * level
        digit = F.shiftright("u", 48) if level == 0 else F.shiftright("u", low).bitwiseAND(0xFFFF)
        prefix = F.lit(0).cast("bigint") if level == 0 else F.shiftright("u", low + _DIGIT)
        rows = images.select(prefix.alias("prefix"), digit.alias("digit"))
        if level:
            rows = rows.where(F.col("prefix").isin(sorted({p for p, _ in wanted.values()})))
        counts = rows.groupBy("prefix", "digit").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by(
            [("prefix", "ascending"), ("digit", "ascending")])
        at, digits, sizes = (counts[c].to_numpy() for c in ("prefix", "digit", "n"))
        if level == 0:
            n = int(sizes.sum())
            if n == 0:
                break
            ends = {edge(p * (n - 1)) for p in probs.values() for edge in (math.floor, math.ceil)}
            wanted = {k: (0, k) for k in ends}
        for rank, (p, inside) in wanted.items():
            first, last = np.searchsorted(at, [p, p + 1]) if level else (0, len(at))
            upto = np.cumsum(sizes[first:last])
            k = int(np.searchsorted(upto, inside, side="right"))
            own = int(digits[first + k])
            wanted[rank] = ((p << _DIGIT) + own if level else own, inside - int(upto[k] - sizes[first + k]))

    def quantile(p: float) -> float | None:
        if n == 0:
            return None
        spot = p * (n - 1)
        a, b = (double_of(wanted[edge(spot)][0]) for edge in (math.floor, math.ceil))
        return a if a == b else a + (b - a) * (spot - math.floor(spot))

    cells = [F.lit(quantile(p)).cast("double").alias(k) for k, p in probs.items()]
    return df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("n"), *cells)
