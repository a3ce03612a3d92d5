"""Tables over the scores of many datasets. Input is the metrics table:
Model, optim_method, forecast_method, forecast_model, elapsed_time, method, metric, dataset, dataset_type,
time_limit, value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocast.functions.labels import (
    FORECAST_METHOD_LABELS,
    LOCAL_MODELS,
    METHOD_LABELS,
    compose_row_label,
    label_position,
    map_labels,
    method_with_optimiser,
)
from stratocast.functions.text import elapsed_text, score_text

AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max, "median": F.median, "sum": F.sum, "count": F.count}


def duplicate_as_level(scores: DataFrame, local_models: Sequence[str] = LOCAL_MODELS) -> DataFrame:
    """Local models have one result for both ways of training, so their rows also appear as `level`.
    Each row is emitted once or twice: no second scan."""
    local = F.col("forecast_model").isin(list(local_models))
    ways = F.when(local, F.array(F.col("forecast_method"), F.lit("level"))).otherwise(F.array("forecast_method"))
    cols = [F.col("_way").alias(c) if c == "forecast_method" else F.col(c) for c in scores.columns]
    return scores.withColumn("_way", F.explode(ways)).select(*cols)


def dedupe_baselines(scores: DataFrame, keep: str = "ensemble_selection") -> DataFrame:
    """Methods without weights are the same for every optimiser: keep them once."""
    return scores.filter((F.col("method") == "weighted_pred") | (F.col("optim_method") == keep))


def select_scores(scores: DataFrame, **equals) -> DataFrame:
    """Equality filters; None means any, a list means any of."""
    for col, want in equals.items():
        if isinstance(want, (list, tuple)):
            scores = scores.filter(F.col(col).isin(list(want)))
        elif want is not None:
            scores = scores.filter(F.col(col) == want)
    return scores


def rank_min(scores: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Ascending rank, ties share the smallest; missing values have no rank. A group holds the experiments
    of one dataset."""
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    return scores.withColumn("rank", F.when(F.col(value).isNotNull(), F.rank().over(w)))


def split_wins(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    """The winners of a group share one point."""
    winners = F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).over(Window.partitionBy(*by))
    return ranked.withColumn("wins", F.when(F.col("rank") == 1, F.lit(1.0) / winners).otherwise(F.lit(0.0)))


def score_summary(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    return ranked.groupBy(*by).agg(
        F.avg("value").alias("avg_value"),
        F.stddev_samp("value").alias("std_value"),
        F.avg("rank").alias("avg_rank"),
        F.sum("wins").alias("total_wins"),
        F.avg("elapsed_time").alias("avg_elapsed_time"),
    )


def control_counts(scores: DataFrame, rows: Sequence[str], cols: Sequence[str] = ()) -> DataFrame:
    """Scores per cell; every cell of a report must hold one per dataset."""
    return scores.groupBy(*rows, *cols).agg(F.count("value").alias("n_scores"))


def check_counts(scores: DataFrame, rows: Sequence[str], cols: Sequence[str], n_datasets: int) -> None:
    bad = control_counts(scores, rows, cols).filter(F.col("n_scores") != n_datasets).limit(1).collect()
    if bad:
        raise ValueError(f"a report cell does not hold one score per dataset: {bad[0].asDict()}")


def ordered(df: DataFrame, row: str, labels: dict[str, str] = METHOD_LABELS) -> DataFrame:
    return df.orderBy(label_position(F.col(row), labels), row)


def _column_order(cols: Sequence[str]) -> list[str]:
    """Plain columns, then the local models, then single- and multi-level ones."""
    groups = ["AutoARIMA", "AutoETS", "single-level", "multi-level"]
    return [c for c in cols if not any(g in c for g in groups)] + [
        c for g in groups for c in cols if g in c and not any(e in c for e in groups[: groups.index(g)])
    ]


def _arranged(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in cols])


def pivot_columns(column: str, extra: str | None) -> Column:
    """Label of a pivot column: the value, with the value of a second column in brackets. Local models appear
    once, without brackets (their multi-level twin is null and drops out)."""
    if extra is None:
        return F.col(column)
    tag = map_labels(F.col(extra), FORECAST_METHOD_LABELS) if extra == "forecast_method" else F.col(extra).cast("string")
    label = F.concat(F.col(column), F.lit(" ("), tag, F.lit(")"))
    if extra == "forecast_method" and column == "forecast_model":
        local = F.col(column).isin(list(LOCAL_MODELS))
        label = F.when(~local, label).when(F.col(extra) == "level", F.col(column))
    return label


def pivot_scores(scores: DataFrame, row: str, label: Column, aggfunc: str, values: Sequence[str] | None) -> DataFrame:
    grouped = scores.withColumn("_col", label).filter(F.col("_col").isNotNull()).groupBy(row)
    return grouped.pivot("_col", list(values) if values else None).agg(AGGREGATES[aggfunc]("value"))


def pivot_model_metrics(
    scores: DataFrame, metric: str, row_values: str = "method", column_values: str = "forecast_model",
    add_to_col_values: str | None = None, forecast_method: str | None = None, forecast_model: str | None = None,
    method: str | None = None, time_limit: int | None = None, dataset_type: str | None = None,
    aggfunc: str = "mean", columns: Sequence[str] | None = None, text: bool = True,
) -> DataFrame:
    """Mean score by row label and column label. `columns` fixes the pivot columns and saves the pass that
    finds them. Rows of the method table come in table order."""
    df = select_scores(
        duplicate_as_level(scores), forecast_method=forecast_method, forecast_model=forecast_model,
        dataset_type=dataset_type, metric=metric, method=method, time_limit=time_limit,
    )
    df = dedupe_baselines(df)
    named = map_labels(method_with_optimiser(F.col("method"), F.col("optim_method")), METHOD_LABELS)
    df = df.withColumn("method", named).filter(label_position(F.col("method")).isNotNull())
    out = pivot_scores(df, row_values, pivot_columns(column_values, add_to_col_values), aggfunc, columns)
    cells = [c for c in out.columns if c != row_values]
    if column_values == "method" and not columns:
        cells = [m for m in METHOD_LABELS.values() if m in cells]
    cells = _column_order(cells)
    if text:
        out = out.select(row_values, *[score_text(F.col(f"`{c}`")).alias(c) for c in cells])
    else:
        out = _arranged(out, [row_values, *cells])
    return ordered(out, "method") if row_values == "method" else out.orderBy(row_values)


SUMMARY = ("avg_value", "std_value", "avg_rank", "total_wins")


def rank_models(
    scores: DataFrame, metric: str, row_values: str = "method", add_to_row_values: Sequence[str] = (),
    grouping_variable: str | None = None, grouping_values: Sequence[str] | None = None, Model: str | None = None,
    optim_method: str | None = None, method: str | None = None, forecast_model: str | None = None,
    forecast_method: str | None = None, time_limit: int | None = None, columns_to_remove: Sequence[str] = (),
    sort_values: bool = False, text: bool = True,
) -> DataFrame:
    """Mean, spread, mean rank and shared wins over datasets. Ranks are taken within each dataset, or within
    each dataset and value of the grouping variable, which then also spreads the columns."""
    df = select_scores(
        duplicate_as_level(scores), Model=Model, optim_method=optim_method, method=method, metric=metric,
        forecast_model=forecast_model, forecast_method=forecast_method, time_limit=time_limit,
    )
    df = dedupe_baselines(df).withColumn("forecast_method", map_labels(F.col("forecast_method"), FORECAST_METHOD_LABELS))
    group = ["dataset"] + ([grouping_variable] if grouping_variable else [])
    df = split_wins(rank_min(df, group), group)
    if row_values == "method":
        named = map_labels(method_with_optimiser(F.col("method"), F.col("optim_method")), METHOD_LABELS)
        df = df.withColumn("_row", named).filter(label_position(F.col("_row")).isNotNull())
    else:
        df = df.withColumn("_row", compose_row_label(*[F.col(c) for c in (row_values, *add_to_row_values)]))
    df = df.withColumn(row_values, F.col("_row"))
    if grouping_variable is None:
        out = score_summary(df, [row_values])
        cells = [*SUMMARY, "avg_elapsed_time"]
    else:
        spread = df.groupBy(row_values).pivot(grouping_variable, list(grouping_values) if grouping_values else None)
        out = spread.agg(
            F.avg("value").alias("avg_value"), F.stddev_samp("value").alias("std_value"),
            F.avg("rank").alias("avg_rank"), F.sum("wins").alias("total_wins"),
        )
        # pivot names columns <value>_<aggregate>; tables put the aggregate first
        for c in out.columns:
            for a in SUMMARY:
                if c.endswith(f"_{a}"):
                    out = out.withColumnRenamed(c, f"{a}_{c[: -len(a) - 1]}")
        cells = [c for c in out.columns if c != row_values]
    cells = [c for c in cells if not any(word in c for word in columns_to_remove)]
    order = [F.col("avg_value")] if sort_values and grouping_variable is None else []
    if row_values == "method":
        order.append(label_position(F.col("method")))
    out = out.orderBy(*order, row_values)
    if text:
        shown = lambda c: elapsed_text(F.col(c)) if c == "avg_elapsed_time" else score_text(F.col(f"`{c}`"), 2)
        out = out.select(row_values, *[shown(c).alias(c) for c in cells])
    return _arranged(out, _column_order([row_values, *cells]))


def metrics_by_group(
    scores: DataFrame, metrics: Sequence[str], grouping_variable: str = "forecast_method",
    Model: str | None = None, optim_method: str | None = None, method: str | None = None,
    forecast_model: str | None = None, forecast_method: str | None = None, time_limit: int | None = None,
    columns_to_remove: Sequence[str] = (), remove_constant: bool = False, columns: Sequence[str] | None = None,
    text: bool = True,
) -> DataFrame:
    """Several metrics side by side: mean per method, one column `<metric>_<group>`."""
    df = select_scores(
        duplicate_as_level(scores), Model=Model, optim_method=optim_method, method=method,
        forecast_model=forecast_model, forecast_method=forecast_method, time_limit=time_limit, metric=list(metrics),
    )
    df = dedupe_baselines(df)
    named = map_labels(method_with_optimiser(F.col("method"), F.col("optim_method")), METHOD_LABELS)
    df = df.withColumn("method", named).filter(label_position(F.col("method")).isNotNull())
    group = F.col(grouping_variable)
    group = map_labels(group, FORECAST_METHOD_LABELS) if grouping_variable == "forecast_method" else group
    out = pivot_scores(df, "method", F.concat_ws("_", "metric", group), "mean", columns)
    if remove_constant:
        out = drop_constant_columns(out, keep=["method"])
    cells = [c for c in out.columns if c != "method" and not any(word in c for word in columns_to_remove)]
    cells = _column_order(cells)
    out = ordered(_arranged(out, ["method", *cells]), "method")
    if text:
        out = out.select("method", *[score_text(F.col(f"`{c}`")).alias(c) for c in cells])
    return out


def drop_constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Without columns that have exactly one distinct value: one aggregation, whose single row is needed to
    know the schema."""
    cols = [c for c in df.columns if c not in keep]
    if not cols:
        return df
    n = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return df.drop(*[c for i, c in enumerate(cols) if n[i] == 1])


# The report settings of the published tables.
TABLES = {
    "table_7": (pivot_model_metrics, dict(metric="MASE", time_limit=600, add_to_col_values="forecast_method")),
    "table_8": (rank_models, dict(metric="MASE", forecast_model="Leaderboard", grouping_variable="forecast_method", time_limit=600)),
    "table_9": (
        rank_models,
        dict(metric="MASE", forecast_method="global", grouping_variable="forecast_model", time_limit=1800,
             columns_to_remove=("AutoARIMA", "AutoETS")),
    ),
    "table_10": (
        rank_models,
        dict(metric="MASE", optim_method="ensemble_selection", method="weighted_pred", row_values="forecast_model",
             add_to_row_values=("optim_method", "forecast_method", "time_limit"), sort_values=True),
    ),
    "table_13": (
        pivot_model_metrics,
        dict(metric="MASE", row_values="dataset", column_values="method", forecast_method="level",
             forecast_model="Leaderboard", time_limit=600),
    ),
    "table_14": (
        pivot_model_metrics,
        dict(metric="MASE", row_values="dataset", column_values="method", forecast_method="global",
             forecast_model="Leaderboard", time_limit=600),
    ),
    "table_15": (
        metrics_by_group,
        dict(metrics=("MASE", "RMSSE", "SMAPE", "WAPE"), forecast_model="Leaderboard", time_limit=600,
             columns_to_remove=("AutoARIMA", "AutoETS"), remove_constant=True),
    ),
    "table_16": (
        pivot_model_metrics,
        dict(metric="MASE", row_values="dataset", column_values="method", forecast_method="global",
             forecast_model="Leaderboard", time_limit=1800),
    ),
    "table_17": (
        metrics_by_group,
        dict(metrics=("MASE", "RMSSE", "SMAPE", "WAPE"), grouping_variable="forecast_model", time_limit=1800,
             columns_to_remove=("AutoARIMA", "AutoETS"), remove_constant=True),
    ),
    "table_18": (
        rank_models,
        dict(metric="MASE", method="base", row_values="forecast_model",
             add_to_row_values=("optim_method", "forecast_method", "time_limit"), sort_values=True),
    ),
}


def published_table(scores: DataFrame, name: str, **changes) -> DataFrame:
    report, settings = TABLES[name]
    return report(scores, **{**settings, **changes})
