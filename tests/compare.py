"""Compares a registered query with its DuckDB oracle on one scale: python tests/compare.py DIR [NAME...]"""

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differs(spark_df, sql, con):
    """None if equal, else what differs."""
    result = con.execute(sql)
    names, want = [c[0] for c in result.description], result.fetchall()
    got = spark_df.collect()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    a, b = rows_of(spark_df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    return next((f"{x} against {y}" for x, y in zip(a, b) if x != y), None)


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:] or list(e.queries())
    con, sqls = connect(sf), e.oracle_sql()
    for n in names:
        t = time.time()
        try:
            df = e.queries()[n](spark, sf)
            said = differs(df, sqls[n], con) if n in sqls else f"rows {df.count()}"
        except Exception as x:
            said = "ERROR " + str(x)[:1500]
        print(n, "ok" if said is None else said, f"{time.time() - t:.1f}s", len(con.execute(sqls[n]).fetchall()) if n in sqls and said is None else "", flush=True)
