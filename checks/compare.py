"""Run registered queries next to DuckDB: ``python -m checks.compare SF_DIR [name part ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from statetrail.session import build_session

from . import oracle, registered

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark, con, sf_dir: str, name: str) -> str:
    """Empty if both engines agree on columns, types of numbers and all rows."""
    df = registered.queries()[name](spark, sf_dir)
    mine = sorted_rows(df.columns, df.collect())
    sql = oracle.oracle_sql().get(name)
    if sql is None:
        return ""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = sorted_rows(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if not mine:
        return "no rows"
    if len(mine) != len(theirs):
        return f"{len(mine)} / {len(theirs)} rows"
    for a, b in zip(mine, theirs):
        if repr(a) != repr(b):
            return f"{a}\n   / {b}"
    return ""


def main(sf_dir: str, *parts: str) -> int:
    spark = build_session("compare", "local[8]", spark_sql_shuffle_partitions="8",
                          spark_ui_enabled="false",
                          spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in registered.queries():
        if parts and not any(part in name for part in parts):
            continue
        start = time.time()
        found = difference(spark, con, sf_dir, name)
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name:28s} {time.time() - start:6.2f}s {found}",
              flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
