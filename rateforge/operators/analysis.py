"""One analysis of stored predictions on one part of the split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .bootstrap import cluster_bootstrap
from .calibration import calibration_table, fit_temperatures
from .metrics import slice_table
from .splitting import select_eval


def analyse(
    errors: DataFrame, predictions: DataFrame, split: str, slices: list[str], group: str,
    allow_test: bool = False, fit_split: str = "val", n_boot: int = 1000, seed: int = 42,
) -> dict[str, DataFrame]:
    """Error table, slices, bootstrap and calibration of one part.

    ``errors`` is an error table with ``split``, ``predictions`` is (model, split, y_true,
    p1..p5).  Both are guarded alike: the test part needs ``allow_test``.  Temperatures
    always come from ``fit_split`` and are only applied to the part.
    """
    rows = select_eval(errors, split, allow_test)
    scored = select_eval(predictions, split, allow_test)
    columns = {"base": "pred_base", "tr": "pred_tr"}
    fitted = fit_temperatures(predictions.where(F.col("split") == fit_split))
    return {
        "errors": rows,
        "slices": slice_table(rows, slices, columns),
        "bootstrap": cluster_bootstrap(rows, columns, group, n_boot, seed, (("tr", "base"),)),
        "calibration": calibration_table(scored, fitted),
    }
