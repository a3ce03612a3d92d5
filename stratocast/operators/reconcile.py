"""Coherent forecasts: parts add up to wholes.

Minimum-trace reconciliation is a projection. On a balanced crossed hierarchy (every combination of key
values exists) it factorises over the keys, so it is one pass per key: compare each total with the sum of
its parts and share the difference. Anything else is solved by conjugate gradients, whose matrix product
is a cube sum and a join back to the leaves. No summing matrix is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.operators.hierarchy import cube_levels, has_key
from stratocast.operators.models import PRED_TYPE, null_safe_on
from stratocast.session import SMALL, cut_lineage

METHODS = ("BottomUp", "MinTrace_method-wls_struct", "MinTrace_method-ols")


def bottom_up(forecasts: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Leaf forecasts summed up to every level."""
    leaves = forecasts.filter("level_id = 0")
    return cube_levels(leaves, keys, by=[*by, "ds"], measures=["pred"]).select(*by, "level_id", *keys, "ds", "pred")


def _structural(method: str) -> bool:
    if method not in ("ols", "wls_struct"):
        raise ValueError(f"unknown weighting {method!r}; use 'ols' or 'wls_struct'")
    return method == "wls_struct"


def mint_balanced(forecasts: DataFrame, keys: Sequence[str], by: Sequence[str], method: str = "ols") -> DataFrame:
    """One pass per key over all nodes. With total t, parts summing to X and m parts, each part gets
    (t-X)/(m+1) for equal variances and (t-X)/(2m) for variances proportional to the leaves below.

    A pass compares rows that differ in one key only. Their sums are aggregated with map-side combine, written and
    joined back, so that no group sits in one task and no pass is computed twice. The factorisation needs every
    total to have the same number of parts: a pass that finds another number raises.
    """
    struct = _structural(method)
    n = len(keys)
    out = cut_lineage(forecasts.select(*by, "level_id", *keys, "ds", F.col("pred").cast("double").alias("pred")))
    for i, key in enumerate(keys):
        bit = 1 << (n - 1 - i)
        group = [*by, "ds", *[k for k in keys if k != key], "_base"]
        out = out.withColumn("_base", F.col("level_id").bitwiseAND(~bit))
        rolled = ~has_key(F.col("level_id"), keys, key)
        sums = {
            "_t": F.max(F.when(rolled, F.col("pred"))),
            "_x": F.sum(F.when(~rolled, F.col("pred"))),
            "_m": F.count(F.when(~rolled, F.col("pred"))),
        }
        totals = cut_lineage(out.groupBy(*group).agg(*[s.alias(c) for c, s in sums.items()]))
        parts = totals.agg(F.min("_m").alias("low"), F.max("_m").alias("high"), F.count("*").alias("n"), F.count("_t").alias("t")).first()
        if parts["low"] != parts["high"] or parts["n"] != parts["t"]:
            raise ValueError(f"the hierarchy is not balanced in {key!r}: totals have {parts['low']} to {parts['high']} parts; use mint_cg")
        out = out.alias("o").join(totals.alias("s"), null_safe_on(group, "o", "s")).select("o.*", *sums)
        diff = F.col("_t") - F.col("_x")
        part = diff / (2 * F.col("_m") if struct else F.col("_m") + 1)
        whole = diff / 2 if struct else part
        out = cut_lineage(
            out.select(*by, "level_id", *keys, "ds", (F.col("pred") + F.when(rolled, -whole).otherwise(part)).alias("pred"))
        )
    return out


def _to_leaves(state: DataFrame, nodes: DataFrame, keys, by, carry) -> DataFrame:
    """For every leaf row the sum of the node values above it, with `carry` columns kept."""
    n = len(keys)
    wide = state.withColumn("level_id", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    ident = [*by, "ds"]
    up = wide.select(
        *ident, "level_id", *carry, *[F.col(k).alias(f"_leaf_{k}") for k in keys],
        *[F.when(has_key(F.col("level_id"), keys, k), F.col(k)).alias(k) for k in keys],
    )
    both = up.alias("u").join(nodes.alias("n"), null_safe_on([*ident, "level_id", *keys], "u", "n"), "left")
    cols = [F.col(f"u.{c}").alias(c) for c in [*ident, *carry]] + [F.col(f"u._leaf_{k}").alias(k) for k in keys]
    return both.groupBy(*cols).agg(F.sum(F.coalesce(F.col("n.v"), F.lit(0.0))).alias("q"))


def mint_cg(
    forecasts: DataFrame, keys: Sequence[str], by: Sequence[str], method: str = "ols",
    tol: float = 1e-9, max_iter: int = 100,
) -> DataFrame:
    """Any hierarchy, nested or incomplete. All horizons and experiments are solved side by side; each
    stops moving when its own residual is small. The state is written once per iteration, and one
    aggregation of it gives every scalar of the step. The number of iterations depends on the number of
    keys, not on the number of nodes."""
    struct = _structural(method)
    ident = [*by, "ds"]
    forecasts = cut_lineage(forecasts.select(*ident, "level_id", *keys, F.col("pred").cast("double").alias("v")))
    leaves = forecasts.filter("level_id = 0").select(*ident, *keys)

    def weigh(df):  # W^-1 times a node value
        return df.withColumn("v", F.col("v") / F.col("n") if struct else F.col("v"))

    def up(df, value):  # sums and numbers of leaves per node
        df = df.select(*ident, *keys, F.col(value).alias("v"), F.lit(1).cast("bigint").alias("n"))
        return cube_levels(df, keys, by=ident, measures=["v", "n"])

    counts = up(leaves.withColumn("one", F.lit(1.0)), "one").drop("v")
    y = counts.alias("c").join(forecasts.alias("y"), null_safe_on([*ident, "level_id", *keys], "c", "y")).select(
        *[F.col(f"c.{c}").alias(c) for c in [*ident, "level_id", *keys, "n"]], "y.v"
    )
    rhs = _to_leaves(leaves, weigh(y), keys, by, [])
    state = cut_lineage(
        rhs.select(*ident, *keys, F.lit(0.0).alias("x"), F.col("q").alias("r"), F.col("q").alias("p"))
    )
    first = cut_lineage(state.groupBy(*ident).agg(F.sum(F.col("r") * F.col("r")).alias("rho0")))
    few = first.limit(SMALL + 1).count() <= SMALL
    state = _with(state, first, ident, few)
    for _ in range(max_iter):
        nodes = up(state, "p")
        state = cut_lineage(_to_leaves(state, weigh(nodes), keys, by, ["x", "r", "p", "rho0"]))
        dot = lambda a, b: F.sum(F.col(a) * F.col(b))
        s = state.groupBy(*ident).agg(
            dot("p", "q").alias("pq"), dot("r", "r").alias("rr"), dot("r", "q").alias("rq"), dot("q", "q").alias("qq"),
            F.max("rho0").alias("rho0"),
        )
        # systems that are solved have p = 0 and stand still
        s = s.withColumn("alpha", F.when(F.col("pq") > 0, F.col("rr") / F.col("pq")).otherwise(0.0))
        rho = F.col("rr") - 2 * F.col("alpha") * F.col("rq") + F.col("alpha") * F.col("alpha") * F.col("qq")
        s = s.withColumn("rho", F.greatest(rho, F.lit(0.0)))
        done = F.col("rho") <= tol * tol * F.col("rho0")
        s = s.withColumn("beta", F.when(done, None).otherwise(F.try_divide(F.col("rho"), F.col("rr"))))
        r = F.col("r") - F.col("alpha") * F.col("q")
        state = _with(state, s.select(*ident, "alpha", "beta"), ident, few).select(
            *ident, *keys, "rho0", (F.col("x") + F.col("alpha") * F.col("p")).alias("x"), r.alias("r"),
            F.when(F.col("beta").isNull(), 0.0).otherwise(r + F.col("beta") * F.col("p")).alias("p"),
        )
        if not s.filter(F.col("beta").isNotNull()).limit(1).count():
            break
    else:
        raise RuntimeError(f"reconciliation did not converge in {max_iter} iterations")
    return cube_levels(state, keys, by=ident, measures=["x"]).select(
        *by, "level_id", *keys, "ds", F.col("x").alias("pred")
    )


def _with(df: DataFrame, scalars: DataFrame, ident: Sequence[str], few: bool) -> DataFrame:
    """Attach per-system scalars: one row per experiment and horizon date, whatever the number of leaves. If they
    are few they are broadcast, and the leaves of a date stay spread out."""
    b = scalars.alias("b")
    return df.alias("a").join(F.broadcast(b) if few else b, null_safe_on(ident, "a", "b")).select(
        "a.*", *[F.col(f"b.{c}") for c in scalars.columns if c not in ident]
    )


def is_balanced(leaves: DataFrame, keys: Sequence[str]) -> bool:
    """Does every combination of key values exist? Two counts, no data leaves the cluster."""
    dim = leaves.select(*keys).distinct()
    row = dim.agg(F.count("*").alias("n"), *[F.count_distinct(k).alias(k) for k in keys]).first()
    full = 1
    for k in keys:
        full *= row[k]
    return row["n"] == full


def reconcile_all(
    forecasts: DataFrame, keys: Sequence[str], by: Sequence[str], balanced: bool, methods: Sequence[str] = METHODS
) -> DataFrame:
    """All methods for every experiment, stacked: by, method, level_id, keys, ds, pred."""
    mint = mint_balanced if balanced else mint_cg
    if len(methods) > 1:
        forecasts = cut_lineage(forecasts.select(*by, "level_id", *keys, "ds", "pred"))
    out = None
    for m in methods:
        if m == "BottomUp":
            rec = bottom_up(forecasts, keys, by)
        elif m.startswith("MinTrace_method-"):
            rec = mint(forecasts, keys, by, m.removeprefix("MinTrace_method-"))
        else:
            raise ValueError(f"unknown reconciliation {m!r}; use one of {METHODS}")
        rec = rec.select(*by, F.lit(m).alias("method"), "level_id", *keys, "ds", F.col("pred").cast(PRED_TYPE).alias("pred"))
        out = rec if out is None else out.unionByName(rec)
    return out


def id_mismatch_report(forecast_ids: DataFrame, hierarchy_ids: DataFrame) -> DataFrame:
    """Ids on one side only. Both are `unique_id` columns."""
    f = forecast_ids.select("unique_id").distinct()
    s = hierarchy_ids.select("unique_id").distinct()
    return f.join(s, "unique_id", "left_anti").withColumn("missing_in", F.lit("hierarchy")).unionByName(
        s.join(f, "unique_id", "left_anti").withColumn("missing_in", F.lit("forecast"))
    )
