"""Runs every query on Spark and its SQL on DuckDB and compares the rows.

python -m checks.compare SF_DIR [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

from checks.oracle import ORACLE
from checks.queries import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        v = v.item()
    return v


def rows(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name: str, sf_dir: str) -> str:
    """'' when equal, else what differs. Doubles must agree to the last bit."""
    df = QUERIES[name](spark, sf_dir)
    mine = rows(df.columns, df.collect())
    cur = con.execute(ORACLE[name])
    theirs = rows([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows vs {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{mine[0]}\n   {a}\n   {b}"
    return ""


def main() -> int:
    from pyspark.sql import SparkSession

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        if name not in ORACLE:
            print(f"ONLY {name}", flush=True)
            continue
        try:
            diff = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - reported per query
            diff = f"{type(e).__name__}: {str(e)[:500]}"
        bad += bool(diff)
        print(f"{'DIFF' if diff else 'same'} {name} {time.time() - start:.2f}s {diff}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
