"""Lookups by code where keys have more digits than a code."""

import compare

import __spark_entry__ as entry

SUPPLIERS, CUSTOMERS = (7, 12344, 99998, 123455, 1234567), (0, 7, 8, 12345, 99999, 123456, 123457, 123458, 999990)


def test_longer_keys(spark, tmp_path):
    spark.createDataFrame([(k, f"S{k}", 1) for k in SUPPLIERS], "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k,) for k in CUSTOMERS], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    con = compare.duckdb.connect()
    for name in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    cursor = con.execute(entry.oracle_sql()["j9a_lookup_by_code"])
    want = compare.rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert compare.spark_rows(entry.queries()["j9a_lookup_by_code"](spark, str(tmp_path))) == want
