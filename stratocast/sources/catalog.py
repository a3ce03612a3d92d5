"""The public panels, the choice among them and the grid of experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.operators.optimisers import METHODS
from stratocast.spec import PanelSpec

# Panel, keys, frequency, test period (also fold length and horizon).
PANELS = {
    "website_traffic": (("DeviceCategory", "Browser"), "D", 180),
    "store_item_demand": (("store", "item"), "ME", 6),
    "retail_prices": (("State", "Commodity"), "ME", 12),
    "prison_population": (("State", "Gender", "Legal", "Indigenous"), "QE", 4),
    "natural_gas_usage": (("duoarea", "process"), "ME", 12),
    "italian_grocery_store": (("brand", "item"), "D", 180),
    "global_electricity_production": (("parameter", "product", "country_name"), "ME", 15),
    "australian_labour_market": (("Sex", "state_and_territory", "hier_1"), "QE", 14),
    "M5": (("state_id", "store_id", "cat_id", "dept_id"), "D", 180),
    "tourism": (("Region", "State", "Purpose"), "QE", 7),
    "superstore": (("ShipMode", "Segment", "Region", "Category"), "ME", 4),
}

# Training budgets in seconds, ways of training, models of the full grid.
TIME_LIMITS = (600, 1800)
FORECAST_METHODS = ("global", "level")
GRID_MODELS = ("AutoARIMA", "AutoETS", "Leaderboard")


def panel_spec(name: str) -> PanelSpec:
    if name not in PANELS:
        raise ValueError(f"unknown panel {name!r}; known: {sorted(PANELS)}")
    keys, freq, _ = PANELS[name]
    return PanelSpec(name, keys, freq, "date", "total")


def catalogue(spark: SparkSession) -> DataFrame:
    """name, private, freq, test_period, fold_length, future_periods."""
    rows = [(n, False, f, h, h, h) for n, (_, f, h) in PANELS.items()]
    cols = "name string, private boolean, freq string, test_period int, fold_length int, future_periods int"
    return spark.createDataFrame(rows, cols)


def select_datasets(
    datasets: DataFrame, run_private: bool, run_public: bool,
    include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
) -> DataFrame:
    if include:
        datasets = datasets.filter(F.col("name").isin(list(include)))
    if exclude:
        datasets = datasets.filter(~F.col("name").isin(list(exclude)))
    if not run_private:
        datasets = datasets.filter(~F.col("private"))
    if not run_public:
        datasets = datasets.filter("private")
    return datasets


def redundant() -> Column:
    """Configurations that cannot add information: local models need no training per level and no long
    budget, and training per level gets the short budget only."""
    local = F.col("model").isin("AutoETS", "AutoARIMA")
    level, long = F.col("forecast_method") == "level", F.col("time_limit") == 1800
    return (level & local) | (long & local) | (level & long)


def experiment_grid(base: DataFrame, reduce: bool = True, **choices: Sequence) -> DataFrame:
    """Every combination of the choices for every row of `base`, e.g. model, forecast_method, time_limit."""
    for name, values in choices.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return base.filter(~redundant()) if reduce else base


def weight_grid(base: DataFrame, optim_methods: Sequence[str] = METHODS, prune: Sequence[bool] = (False,)) -> DataFrame:
    return experiment_grid(base, reduce=False, optim_method=optim_methods, remove_groups=prune)
