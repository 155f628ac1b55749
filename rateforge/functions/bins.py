"""Left-closed binning into labelled ranges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bin edges and labels.  The last edge may be None (open end).
LENGTH_EDGES = (0, 50, 100, 200, 400, 800, None)
LENGTH_LABELS = ("<50", "50-99", "100-199", "200-399", "400-799", "800+")
CONF_EDGES = (0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0001)
CONF_LABELS = ("<0.4", "0.4-0.5", "0.5-0.6", "0.6-0.7", "0.7-0.8", "0.8-0.9", "0.9-0.95", "0.95+")


def bin_index(value: Column, edges) -> Column:
    """0-based bin ordinal; null when the value is null or outside the edges."""
    chain = F.when(value.isNull() | (value < F.lit(edges[0])), F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:]):
        if upper is None:
            return chain.otherwise(F.lit(i))
        chain = chain.when(value < F.lit(upper), F.lit(i))
    return chain


def bin_label(index: Column, labels) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), index)


def length_bin(chars: Column) -> Column:
    return bin_label(bin_index(chars, LENGTH_EDGES), LENGTH_LABELS)


def confidence_bin(conf: Column) -> Column:
    return bin_label(bin_index(conf, CONF_EDGES), CONF_LABELS)


def histogram_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin ordinal in [0, bins); the top edge belongs to the last bin."""
    width = (high - low) / F.lit(float(bins))
    raw = F.floor(F.try_divide(value - low, width)).cast("int")
    return F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1))
