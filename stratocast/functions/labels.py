"""Technical names to table labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Method name (with optimiser, where it matters) and its label, in table order.
METHOD_LABELS = {
    "base": "Base Forecast",
    "BottomUp": "Bottom-up",
    "MinTrace_method-ols": "Ordinary Least Squares",
    "MinTrace_method-wls_struct": "Structural Scaling",
    "equal_weights_pred": "WHC (equal weights)",
    "weighted_pred_differential_evolution": "WHC (differential evolution)",
    "weighted_pred_ensemble_selection": "WHC (ensemble selection)",
    "weighted_pred_optimize_nnls": "WHC (nnls)",
}

# Label of the way models are trained.
FORECAST_METHOD_LABELS = {"global": "multi-level", "level": "single-level"}

# Models that fit every series alone: training them per level or on all levels gives the same forecasts.
LOCAL_MODELS = ("AutoETS", "AutoARIMA")


def map_labels(col: Column, labels: dict[str, str]) -> Column:
    """Label of a name; names without one stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col), col)


def label_position(col: Column, labels: dict[str, str] = METHOD_LABELS) -> Column:
    """Place of a label in its table, null for unknown labels."""
    table = F.create_map(*[F.lit(x) for i, v in enumerate(labels.values()) for x in (v, i)])
    return F.try_element_at(table, col)


def method_with_optimiser(method: Column, optim: Column) -> Column:
    """Only the weighted method depends on the optimiser, so only its name carries it."""
    return F.when(method == "weighted_pred", F.concat_ws("_", method, optim)).otherwise(method)


def compose_row_label(*cols: Column) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in cols])
