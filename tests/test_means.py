"""Means of scores don't depend on the order of rows or on partitions."""

import random

import duckdb

from tessera.functions.dialect import ORACLE, SPARK

# Their mean is 0.4005, half a permille step; added up in doubles, one after another, it depends on their order.
SCORES = [0.1, 0.7, 0.2, 0.6, 0.3, 0.5, 0.05, 0.75, 0.402, 0.403] * 111 + [0.4005] * 10


def test_one_permille_for_all_orders(spark):
    rng, seen, doubles = random.Random(4), set(), set()
    for parts in (1, 2, 8, 64):
        rows = SCORES[:]
        rng.shuffle(rows)
        df = spark.createDataFrame([(s,) for s in rows], "s double").repartition(parts)
        seen.add(df.selectExpr(f"{SPARK.exact_mean('s')} AS m", f"{SPARK.whole(SPARK.exact_mean('s') + ' / 1E-3', 'INT')} AS p").first())
        total = 0.0
        for s in rows:
            total += s
        doubles.add(total / len(rows))
    assert len(seen) == 1 and len(doubles) > 1
    assert abs(next(iter(seen)).m - 0.4005) < 1e-15
    rows = [(s,) for s in SCORES]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (s DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", rows)
    assert con.execute(f"SELECT {ORACLE.exact_mean('s')}, {ORACLE.whole(ORACLE.exact_mean('s') + ' / 1E-3', 'INT')} FROM t").fetchone() == tuple(next(iter(seen)))


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(0.25,), (None,), (0.75,)], "s double")
    assert df.selectExpr(f"{SPARK.exact_mean('s')} AS m").first().m == 0.5
    assert df.where("s > 1").selectExpr(f"{SPARK.exact_mean('s')} AS m").first().m is None
