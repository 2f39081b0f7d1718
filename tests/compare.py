"""Run registered queries in Spark and DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(round(value, 9) + 0.0, ".12g")
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, con, run, sql, sf_dir) -> str | None:
    """None when equal, else a short description."""
    df = run(spark, sf_dir)
    ours = _rows(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = _rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} rows differ, e.g. {str(wrong[0])[:600]}" if wrong else None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        try:
            if name not in oracles:
                problem = f"no oracle; {run(spark, sf_dir).count()} rows"
            else:
                problem = differences(spark, con, run, oracles[name], sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__} {str(error)[:1500]}"
            if chosen:
                traceback.print_exc()
        bad += problem is not None
        print(f"{name:32s} {time.time() - started:6.2f}s {problem or 'ok'}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
