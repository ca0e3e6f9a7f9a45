"""Compares registered queries with their SQL on DuckDB: python tests/oracle.py [SF] [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(made, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def compare(spark, duck, frame, sql):
    """None, or what differs."""
    out = duck.execute(sql)
    want = rows([d[0] for d in out.description], out.fetchall())
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(want[1]) != len(got[1]):
        return f"{len(got[1])} rows, SQL has {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if any(x != y and not (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True))]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else None


def connect(sf_dir):
    import duckdb

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return duck


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    duck, sql = connect(sf), entry.oracle_sql()
    for name, f in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            frame = f(spark, sf)
            told = compare(spark, duck, frame, sql[name]) if name in sql else f"no SQL, {frame.count()} rows"
        except Exception as e:
            told = f"FAILED {type(e).__name__}: {str(e)[:300]}"
        print(f"{name}: {'ok' if told is None else told} ({time.time() - t:.1f} s)", flush=True)
