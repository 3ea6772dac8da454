"""Run registered queries and compare them with their SQL.

python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def make_session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("ledgerlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows),
                  key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(spark: SparkSession, con, query, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else a short description."""
    df = query(spark, sf_dir)
    left = _rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(left) != len(right):
        only_left = [r for r in left if r not in set(right)][:2] if len(left) < 20000 else ""
        only_right = [r for r in right if r not in set(left)][:2] if len(right) < 20000 else ""
        return f"{len(left)} rows != {len(right)}: {only_left} / {only_right}"
    for a, b in zip(left, right):
        if a != b:
            return f"{str(a)[:400]} != {str(b)[:400]}"
    kinds = [(type(x).__name__, type(y).__name__) for a, b in zip(left[:1], right[:1])
             for x, y in zip(a, b) if x is not None and y is not None
             and type(x) is not type(y)]
    return f"types {kinds}" if kinds else None


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in sql:
                problem = difference(spark, con, queries[name], sql[name], sf_dir)
                count = con.execute(f"SELECT count(*) FROM ({sql[name]})").fetchone()[0]
            else:
                problem, count = None, queries[name](spark, sf_dir).count()
        except Exception as error:  # report and go on with the next query
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        note = "" if name in sql else " (rows only)"
        print(f"{'OK  ' if problem is None else 'FAIL'} {name:34s} {count:7d} rows "
              f"{time.time() - start:5.1f}s{note} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
