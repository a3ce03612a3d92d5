"""Building blocks of the reference SQL (DuckDB dialect): each returns the text of common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

ROWS = """rows_ AS (
  SELECT r_name, n_name, c_mktsegment, o_orderpriority, last_day(CAST(o_orderdate AS DATE)) AS ds,
         CAST(o_totalprice AS DECIMAL(18,2)) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

WIDE_ROWS = """rows_ AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, l_returnflag, l_linestatus, last_day(CAST(l_shipdate AS DATE)) AS ds,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS y
  FROM lineitem)"""

DAILY_ROWS = """rows_ AS (
  SELECT event_type, CAST(user_id % 10 AS VARCHAR) AS user_group, CAST(ts AS DATE) AS ds,
         CAST(value AS DECIMAL(18,2)) AS y
  FROM events)"""


def panel(keys: Sequence[str], rows: str = ROWS, freq: str = "ME") -> str:
    """rows_, leaf, cal, panel, levels: sums per leaf, calendar, gaps filled with 0, every key subset."""
    k = ", ".join(keys)
    if freq == "D":
        cal = "SELECT CAST(unnest(generate_series((SELECT min(ds) FROM rows_), (SELECT max(ds) FROM rows_), INTERVAL 1 DAY)) AS DATE) AS ds"
    else:
        cal = """SELECT last_day(CAST(unnest(generate_series((SELECT date_trunc('month', min(ds)) FROM rows_),
            (SELECT date_trunc('month', max(ds)) FROM rows_), INTERVAL 1 MONTH)) AS DATE)) AS ds"""
    return f"""{rows},
leaf AS (SELECT {k}, ds, sum(y) AS y FROM rows_ GROUP BY {k}, ds),
cal AS ({cal}),
dim AS (SELECT DISTINCT {k} FROM rows_),
panel AS (
  SELECT {", ".join("g." + c for c in keys)}, g.ds, coalesce(leaf.y, 0) AS y
  FROM (SELECT {k}, ds FROM dim CROSS JOIN cal) g
  LEFT JOIN leaf ON {" AND ".join(f"g.{c} = leaf.{c}" for c in keys)} AND g.ds = leaf.ds),
levels AS MATERIALIZED (
  SELECT CAST(grouping({k}) AS INTEGER) AS level_id, {k}, ds, sum(y) AS y
  FROM panel GROUP BY ds, CUBE({k}))"""


def folds(fold_length: int, test_period: int) -> str:
    """dates, fold: expanding windows over the training dates."""
    return f"""dates AS (SELECT ds, row_number() OVER (ORDER BY ds) AS i FROM cal),
train_n AS (SELECT CAST(count(*) - {test_period} AS INTEGER) AS n, CAST(floor((count(*) - {test_period}) * 0.45 / {fold_length}) AS INTEGER) AS k FROM dates),
fold AS (
  SELECT f AS fold, n - (k - f + 1) * {fold_length} AS n_train,
         (SELECT ds FROM dates WHERE i = n - (k - f + 1) * {fold_length}) AS cutoff_ds,
         (SELECT ds FROM dates WHERE i = n - (k - f + 1) * {fold_length} + 1) AS test_from,
         (SELECT ds FROM dates WHERE i = n - (k - f + 1) * {fold_length} + {fold_length}) AS test_to
  FROM (SELECT n, k, CAST(unnest(generate_series(1, k)) AS INTEGER) AS f FROM train_n))"""


def same_series(a: str, b: str, cols: Sequence[str]) -> str:
    """Equality of one id instead of null-safe equality of every column: always a plain hash join."""
    one = lambda t: " || '|' || ".join(f"coalesce(CAST({t}.{c} AS VARCHAR), '~')" for c in cols)
    return f"{one(a)} = {one(b)}"


def null_join(a: str, b: str, cols: Sequence[str]) -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)


def baselines(keys: Sequence[str], h: int, m: int, folded: bool, test_period: int, models: Sequence[str] | None = None) -> str:
    """pred(model, [fold], level_id, keys, step, pred) for the closed-form models, from history rows
    hist([fold], series, ds, y, back) with back = 0 on the last date."""
    s = ["level_id", *keys]
    g = (["fold"] if folded else []) + s
    gs = ", ".join(g)
    if folded:
        hist = f"""hist AS MATERIALIZED (
  SELECT fold, {", ".join(s)}, ds, y, row_number() OVER (PARTITION BY fold, {", ".join(s)} ORDER BY ds DESC) - 1 AS back
  FROM levels JOIN fold ON ds <= cutoff_ds)"""
    else:
        hist = f"""hist AS MATERIALIZED (
  SELECT {", ".join(s)}, ds, y, row_number() OVER (PARTITION BY {", ".join(s)} ORDER BY ds DESC) - 1 AS back
  FROM levels WHERE ds IN (SELECT ds FROM dates WHERE i <= (SELECT count(*) - {test_period} FROM dates)))"""
    keep = f"WHERE model IN ({', '.join(repr(x) for x in models)})" if models else ""
    avg = "CAST(sum(y) AS DOUBLE) / count(*)"
    return f"""{hist},
step AS (SELECT CAST(unnest(generate_series(1, {h})) AS INTEGER) AS step),
stat AS (
  SELECT {gs}, {avg} AS mean_y, CAST(max(CASE WHEN back = 0 THEN y END) AS DOUBLE) AS last_y FROM hist GROUP BY {gs}),
spos AS (
  SELECT {gs}, back % {m} AS pos, {avg} AS mean_y, CAST(max(CASE WHEN back < {m} THEN y END) AS DOUBLE) AS last_y
  FROM hist GROUP BY {gs}, back % {m}),
pred AS MATERIALIZED (SELECT * FROM (
  SELECT 'Naive' AS model, {gs}, step, CAST(last_y AS DECIMAL(28,6)) AS pred FROM stat CROSS JOIN step
  UNION ALL SELECT 'Zero', {gs}, step, CAST(0 AS DECIMAL(28,6)) FROM stat CROSS JOIN step
  UNION ALL SELECT 'Average', {gs}, step, CAST(mean_y AS DECIMAL(28,6)) FROM stat CROSS JOIN step
  UNION ALL SELECT 'SeasonalNaive', {gs}, step, CAST(last_y AS DECIMAL(28,6)) FROM spos JOIN step ON pos = ({m} - step % {m}) % {m}
  UNION ALL SELECT 'SeasonalAverage', {gs}, step, CAST(mean_y AS DECIMAL(28,6)) FROM spos JOIN step ON pos = ({m} - step % {m}) % {m}
  ) {keep})"""


def fold_forecasts(keys: Sequence[str], m: int, fold_length: int, test_period: int, models=None) -> str:
    """bt(model, fold, level_id, keys, ds, y, pred)."""
    s = ["level_id", *keys]
    return f"""{folds(fold_length, test_period)},
{baselines(keys, fold_length, m, True, test_period, models)},
bt AS (
  SELECT p.model, p.fold, {", ".join("p." + c for c in s)}, d.ds, l.y, p.pred
  FROM pred p JOIN fold f ON p.fold = f.fold JOIN dates d ON d.i = f.n_train + p.step
  JOIN levels l ON l.ds = d.ds AND {same_series("l", "p", s)})"""


def horizon(keys: Sequence[str], m: int, h: int, test_period: int, models=None) -> str:
    """fc(model, level_id, keys, ds, y, pred) on the held-out dates (h <= test_period)."""
    s = ["level_id", *keys]
    return f"""{baselines(keys, h, m, False, test_period, models)},
fc AS (
  SELECT p.model, {", ".join("p." + c for c in s)}, d.ds, l.y, p.pred
  FROM pred p JOIN dates d ON d.i = (SELECT count(*) - {test_period} FROM dates) + p.step
  JOIN levels l ON l.ds = d.ds AND {same_series("l", "p", s)})"""


def mint(keys: Sequence[str], by: Sequence[str], method: str, source: str, name: str) -> str:
    """Reconciliation on a balanced crossed hierarchy from interaction effects: the leaf target
    z = S'W^-1 y, its averages over every key subset, inclusion-exclusion, scaling, sums."""
    n = len(keys)
    subsets = [[k for i, k in enumerate(keys) if not g >> (n - 1 - i) & 1] for g in range(1 << n)]
    b = ", ".join(by)
    card = {k: f"(SELECT count(DISTINCT {k}) FROM {source} WHERE level_id = 0)" for k in keys}

    def leaves_below(sub):
        out = " * ".join(card[k] for k in keys if k not in sub)
        return f"({out or '1'})"

    on = lambda sub: " AND ".join([f"x.{c} = z.{c}" for c in (*by, "ds", *sub)])
    weight = lambda sub: leaves_below(sub) if method == "wls_struct" else "1"
    z = " + ".join(
        f"(SELECT CAST(x.pred AS DOUBLE) / {weight(s)} FROM {source} x WHERE x.level_id = {g} AND {on(s)})"
        for g, s in enumerate(subsets)
    )
    means = ", ".join(
        f"avg(z) OVER (PARTITION BY {', '.join([*by, 'ds', *s])}) AS m{g}" for g, s in enumerate(subsets)
    )
    # effect of subset B: sum over C in B of (-1)^(|B|-|C|) m_C, divided by lambda_B
    terms = []
    for gb, sb in enumerate(subsets):
        eff = " + ".join(
            f"({(-1) ** (len(sb) - len(sc))}) * m{gc}" for gc, sc in enumerate(subsets) if set(sc) <= set(sb)
        )
        lam = " + ".join(
            f"{leaves_below(sa)} / {weight(sa)}" if method == "wls_struct" else leaves_below(sa)
            for sa in subsets if set(sb) <= set(sa)
        )
        terms.append(f"({eff}) / ({lam})")
    k = ", ".join(keys)
    return f"""{name}_z AS (SELECT {b}, ds, {k}, {z} AS z FROM (SELECT * FROM {source} WHERE level_id = 0) z),
{name}_m AS (SELECT {b}, ds, {k}, {means} FROM {name}_z),
{name}_b AS (SELECT {b}, ds, {k}, {" + ".join(terms)} AS pred FROM {name}_m),
{name} AS (
  SELECT {b}, CAST(grouping({k}) AS INTEGER) AS level_id, {k}, ds, sum(pred) AS pred
  FROM {name}_b GROUP BY {b}, ds, CUBE({k}))"""
