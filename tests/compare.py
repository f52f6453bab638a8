"""Run registered queries against their comparison SQL: python tests/compare.py [folder] [name-part ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in records) if not records else sorted(
        (tuple(_plain(r[i]) for i in order) for r in records), key=repr)


def oracle(folder, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def spark_rows(frame):
    return rows_of(frame.columns, [tuple(r) for r in frame.collect()])


def compare(spark, folder, name):
    began = time.time()
    got = spark_rows(entry.queries()[name](spark, folder))
    print(f"[spark {time.time() - began:5.2f}s]", end=" ")
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got[1]), None
    want = oracle(folder, sql)
    if got == want:
        return len(got[1]), ""
    extra = list(set(got[1]) - set(want[1]))[:2]
    lacking = list(set(want[1]) - set(got[1]))[:2]
    return len(got[1]), f"spark {got[0]} {len(got[1])} vs sql {want[0]} {len(want[1])}; only spark {extra}; only sql {lacking}"


if __name__ == "__main__":
    from newsflow.session import new_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = new_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in entry.queries():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        began = time.time()
        try:
            n, problem = compare(spark, folder, name)
        except Exception as error:  # noqa: BLE001
            n, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        verdict = "rows only" if problem is None else (problem[:1500] or "ok")
        print(f"{name:28s} {n:8d} rows {time.time() - began:6.2f}s  {verdict}", flush=True)
    print("mismatches:", bad)
