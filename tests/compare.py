"""Runs queries and their SQL side by side, as the driver does. Usage: python tests/compare.py SF [NAME...]"""

from __future__ import annotations

import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return db


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows), sorted(columns)


def differs(spark, db, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if both results are equal."""
    df = query(spark, sf_dir)
    mine, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(sql)
    want, names = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if columns != names:
        return f"columns {columns} {names}"
    if mine != want:
        a, b = set(mine), set(want)
        return f"{len(mine)} rows, wanted {len(want)}; extra {sorted(a - b)[:3]}; missing {sorted(b - a)[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = f"/root/testdata/{sys.argv[1]}"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, db = entry.queries(), entry.oracle_sql(), oracle(sf)
    for name in sys.argv[2:] or sorted(sql):
        began = time.time()
        try:
            said = differs(spark, db, name, queries[name], sql[name], sf) if name in sql else f"{queries[name](spark, sf).count()} rows, no SQL"
        except Exception as error:
            said = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
