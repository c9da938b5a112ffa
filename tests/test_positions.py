"""Positions and running sums over a whole table against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gameline.operators.positions import positions


@pytest.fixture(scope="module")
def given():
    rng = random.Random(7)
    return [(rng.choice([None, *range(50)]), i, rng.choice([None, 1, 2, 3]), rng.random()) for i in range(3000)]


def test_positions_and_sums(spark, given):
    df = spark.createDataFrame(given, "k int, i int, n int, x double").repartition(7)
    got = positions(df, ["k", F.desc("i")], "at", "all", {"so_far": "n", "mass": "x"}).collect()
    order = sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    at, total, mass = {}, 0, 0.0
    for place, r in enumerate(order):
        total, mass = total + (r[2] or 0), mass + r[3]
        at[r[1]] = (place + 1, 3000, total, mass)
    assert len(got) == 3000
    for r in got:
        place, n, so_far, mass = at[r.i]
        assert (r["at"], r["all"], r.so_far) == (place, n, so_far) and r.mass == pytest.approx(mass)


def test_empty_and_one_row(spark):
    df = spark.createDataFrame([(1, 2)], "k int, n int")
    assert [tuple(r) for r in positions(df, ["k"], total="all", sums={"s": "n"}).collect()] == [(1, 2, 1, 1, 2)]
    assert positions(df.limit(0), ["k"], total="all", sums={"s": "n"}).collect() == []


def test_no_single_partition(spark, data):
    from gameline.catalog import ALL

    for name in ("cv_folds", "running_bets"):
        plan = ALL[name][0](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name
