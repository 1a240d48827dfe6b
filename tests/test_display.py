"""Display cells against the SQL that states them."""

import random

import duckdb
from pyspark.sql import functions as F

from logloom.functions import display


def test_cents_round_as_the_sql_does(spark):
    r = random.Random(5)
    amounts = [0.145, 1.005, 2.445, 0.125, -0.145, 0.0, *(k / 1000 for k in range(5, 4000, 10)), *(r.randrange(10**6) / 1e6 * 2.5 + r.randrange(10**6) / 1e6 * 15.0 for _ in range(500)), *(k / 1e6 * 2.5 + 30_000 / 1e6 * 10.0 for k in range(0, 40_000, 2000))]
    con = duckdb.connect()
    con.execute("CREATE TABLE v (id INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO v VALUES (?, ?)", list(enumerate(amounts)))
    want = [w for (w,) in con.execute("SELECT '~$' || CAST(CAST(x AS DECIMAL(18, 2)) AS VARCHAR) || ' est' FROM v ORDER BY id").fetchall()]
    made = spark.createDataFrame(list(enumerate(amounts)), "id int, x double")
    none = F.lit(None).cast("double")
    got = [g.c for g in made.select("id", display.cost_cell(none, F.col("x")).alias("c")).orderBy("id").collect()]
    assert got == want
