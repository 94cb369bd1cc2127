"""Compare every registered query with its SQL on one folder of tables."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in order, values as comparable text."""

    def text(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and np.isnan(value)):
            return "NULL"
        if isinstance(value, (bool, np.bool_)):
            return str(bool(value))
        if isinstance(value, (float, np.floating)):
            return repr(float(value)) if not float(value).is_integer() else str(int(value))
        if hasattr(value, "isoformat"):
            return pd.Timestamp(value).isoformat()
        return str(value)

    out = pd.DataFrame({c: df[c].map(text) for c in sorted(df.columns)}).astype(str)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def difference(spark, name: str, run, sql: str, folder: str, con) -> str | None:
    """What differs between the query and its SQL, or None."""
    ours = normal(run(spark, folder).toPandas())
    theirs = normal(con.execute(sql).df())
    if list(ours.columns) != list(theirs.columns):
        return f"{name}: columns {list(ours.columns)} vs {list(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{name}: {len(ours)} rows vs {len(theirs)}"
    if not ours.equals(theirs):
        rows = (ours != theirs).any(axis=1)
        return f"{name}: {rows.sum()} rows differ\n{ours[rows].head(5)}\n{theirs[rows].head(5)}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    failed = 0
    for name, run in entry.queries().items():
        if name not in entry.oracle_sql() or only and name not in only:
            continue
        started = time.time()
        try:
            problem = difference(spark, name, run, entry.oracle_sql()[name], folder, con)
        except Exception as err:  # report and go on with the next query
            problem = f"{name}: {type(err).__name__} {str(err)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.2f}s", flush=True)
        if problem:
            print(problem, flush=True)
    print("failed:", failed)
