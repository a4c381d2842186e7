"""Run registered queries against their DuckDB counterparts: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in data)


def compare(spark, con, fn, sql, sf_dir):
    """(equal, row count, note); the note shows the first differing rows."""
    df = fn(spark, sf_dir)
    got = rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, len(got), f"columns {sorted(set(df.columns) ^ set(names))}"
    if got == want:
        return True, len(got), ""
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    differing = len(set(got) - set(want))
    return False, len(got), f"{len(got)} vs {len(want)} rows, {differing} differ\n  spark {extra}\n  duck  {missing}"


def session():
    from tickloom.session import SESSION_CONF

    builder = SparkSession.builder.master("local[8]").appName("compare")
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    return builder.config("spark.driver.memory", "8g").getOrCreate()


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            ok, count, note = compare(spark, con, fn, oracle_sql()[name], sf_dir)
        except Exception as e:  # report and go on
            ok, count, note = False, -1, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {count:7d} rows {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{bad} failed")
    spark.stop()


if __name__ == "__main__":
    main()
