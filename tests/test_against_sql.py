"""Queries against their SQL on values that the given tables don't hold."""

from collections import Counter

import duckdb

import __spark_entry__


def differences(spark, folder, table, df, name):
    """Rows that a query returns and its SQL doesn't, and the other way round, over one small table."""
    df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    found = Counter(tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
        wanted = Counter(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    return found - wanted, wanted - found


BALANCES = [-0.0, 0.0, -0.0, 0.01, -0.01, 1.0, -1.0, 7.999999999999999, 9999.99, None]


def customers(spark):
    return spark.createDataFrame(list(enumerate(BALANCES)), "c_custkey bigint, c_acctbal double")


def test_bin_keys_order_has_one_zero(spark, tmp_path):
    assert differences(spark, tmp_path, "customer", customers(spark), "bin_keys_order") == ({}, {})


def test_bin_sigbits_double_has_one_zero(spark, tmp_path):
    assert differences(spark, tmp_path, "customer", customers(spark), "bin_sigbits_double") == ({}, {})


def test_bin_precision_rounds_halves_as_its_sql(spark, tmp_path):
    halves = [1705.0, 21.95, 24.45, 30650.0, 7285.0, 85050.0]
    odd = [None, None, 0.0, -0.0, 1000.0, 999.5, 999.4999999999999, 9.995e24, 1.005e-30, 2.2250738585072014e-308, 5e-324]
    prices = halves + [-v for v in halves] + odd + [v / 100 for v in range(100000, 160000, 5)]
    df = spark.createDataFrame(list(enumerate(prices)), "l_orderkey bigint, l_extendedprice double")
    assert differences(spark, tmp_path, "lineitem", df, "bin_precision") == ({}, {})
