"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

Usage: python -m checks.compare [sf_dir] [name,name,...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and value != value:
        return "nan"
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'ok' or the first difference."""
    answer = con.execute(sql)
    columns = [c[0] for c in answer.description]
    theirs = _rows(columns, answer.fetchall())
    ours = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} against {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return "ok" if not different else f"{len(different)} rows differ; first {different[0]}"


def main() -> int:
    from censemble.plans.catalog import QUERIES
    from censemble.session import local_session
    from checks.oracle_sql import ORACLE

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(QUERIES)
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            verdict = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name]) if name in ORACLE else "no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            verdict = f"failed: {str(error)[:700]}"
        bad += verdict not in ("ok", "no SQL")
        print(f"{name:28s} {time.time() - started:6.2f}s  {verdict[:900]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
