"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LAST_SQL: list[float] = []
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows),
                  key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, sf: str, name: str, query, sql: str) -> str | None:
    """None if both agree, else what differs."""
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    start = time.time()
    cur = con.execute(sql)
    LAST_SQL.append(time.time() - start)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        have, expected = set(got), set(want)
        missing = [r for r in want if r not in have][:2]
        extra = [r for r in got if r not in expected][:2]
        return f"{len(got)} vs {len(want)} rows; only Spark: {extra}; only SQL: {missing}"
    if not got:
        return "no rows"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connect(sf), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, sf, name, query, sql[name])
            else:
                problem = None if query(spark, sf).count() else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'OK  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s (sql {LAST_SQL[-1] if LAST_SQL else 0:.1f}s) "
              f"{'' if problem is None else problem[:900]}", flush=True)
    print(f"{bad} failing")
