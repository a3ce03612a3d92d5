"""Compare registered queries with their reference SQL in DuckDB.

Run as a script: python tests/compare.py <sf_dir> [name ...]
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cpus: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stratocast-test-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time() else v
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(spark, con, query, sql, sf_dir) -> str | None:
    """None when both give the same columns and rows, to the last bit."""
    df = query(spark, sf_dir)
    a_cols, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b_cols, b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:2]} / {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ; first {bad[0]}"
    return None if a else "no rows"


def main():
    from __spark_entry__ import oracle_sql, queries

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    sql = oracle_sql()
    failed = 0
    for name, q in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                note = differences(spark, con, q, sql[name], sf_dir) or "ok"
            else:
                note = f"rows only: {q(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
        failed += note != "ok" and not note.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.2f}s  {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
