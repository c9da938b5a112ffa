"""The chunked path orders every kind of tie-break value as the plain window does."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gameline.operators import context, heat

NAN, INF = float("nan"), float("inf")
DAY = dt.date(2024, 1, 1)

# tie-break values of one crowded (key, date) pair, all different
VALUES = {
    "double": [None, -INF, -1e300, -2.5, -1e-300, 0.0, 1e-300, 3.0, 4.0, 1e300, INF, NAN] + [10.5 + i for i in range(60)],
    "bigint": [None, -(2**62), 2**62, 2**62 + 1, 2**62 + 2, -1, 0] + list(range(100, 150)),
    "string": [None, "", "a", "aa", "b", "é", "漢", "abcdefgh", "abcdefghi", "abcdefghij" * 4 + "x", "abcdefghij" * 4 + "y"]
              + [f"key{i:04d}" for i in range(50)],
    "date": [None] + [DAY + dt.timedelta(days=i * i) for i in range(50)],
    "timestamp": [None] + [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i) for i in range(50)],
    "boolean": [None, True, False],
    # alike in more than 24 bytes, some the beginning of others
    "string!long": [None] + ["the same beginning of every text " + "x" * (i % 3) + f"{i:03d}" * (i % 2) + "\0" * (i % 4) + str(i) for i in range(60)],
    "binary": [None, b"", b"\0", b"\0\0"] + [b"\xff" * 30 + bytes([i]) for i in range(50)],
    "decimal(38,2)": [None] + [Decimal(f"{10**34}.{i:02d}") for i in range(50)],
}


def rows(spark, kind):
    data = [(1, DAY, v, i) for i, v in enumerate(VALUES[kind])] + [(1, None, v, 100 + i) for i, v in enumerate(VALUES[kind])]
    data += [(2, DAY, v, 200 + i) for i, v in enumerate(VALUES[kind][:3])]
    return spark.createDataFrame(data, f"k long, d date, t {kind.split('!')[0]}, n long").repartition(5)


def result(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("kind", sorted(VALUES))
def test_frames_on_every_type(spark, kind):
    df = rows(spark, kind)

    def build(w):
        return {"before": F.lag("n", 1).over(w), "after": F.lead("n", 2).over(w),
                "near": F.sum("n").over(w.rowsBetween(-5, -1))}

    plain = df.withColumns(build(Window.partitionBy("k").orderBy("d", "t")))
    assert result(heat.with_frames(df, ["k"], "d", ["t"], build, 5, 2, chunk_rows=8)) == result(plain)


@pytest.mark.parametrize("kind", ["double", "string"])
def test_running_totals_on_every_type(spark, kind):
    df = rows(spark, kind)
    w = Window.partitionBy("k").orderBy("d", "t").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumns({"total": F.sum("n").over(w), "ordinal": F.count(F.lit(1)).over(w)})
    assert result(heat.running_totals(df, ["k"], "d", ["t"], {"total": "n"}, slot_rows=2)) == result(plain)


def test_equal_tie_breaks_are_split(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.lit(DAY).alias("d"), F.lit(7).cast("long").alias("t"), F.col("id").alias("n"))
    slots = heat._slots(df, ["k"], "d", ["t"], 20).groupBy("_bin").count()
    assert slots.agg(F.max("count")).first()[0] < 60
    got = heat.running_totals(df, ["k"], "d", ["t"], {"total": "n"}, slot_rows=20)
    assert sorted(r.ordinal for r in got.collect()) == list(range(1, 501))


@pytest.mark.parametrize("value", ["'the same twenty-four bytes in ' || lpad(id, 4, '0')", "'equal for all of the rows, ever'",
                                   "unhex(repeat('ff', 40))", "CAST(1.5 AS DECIMAL(20,2))"])
def test_long_and_equal_tie_breaks_are_split(spark, value):
    df = spark.range(300).select(F.lit(1).alias("k"), F.lit(DAY).alias("d"), F.expr(value).alias("t"), F.col("id").alias("n"))
    slots = heat._slots(df, ["k"], "d", ["t"], 10).groupBy("_bin").count()
    assert slots.agg(F.max("count")).first()[0] < 40


@pytest.mark.parametrize("chunk", [4, 1000])
def test_ranks_with_infinities(spark, chunk):
    values = [INF, -INF, 1e300, -1e300, 0.0, 0.0, 1.0, 2.0, 2.0, 3.0, None] + [float(i) for i in range(30)]
    df = spark.createDataFrame([(DAY, v, i) for i, v in enumerate(values)], "game_date date, v double, n long")
    known = sorted(v for v in values if v is not None)
    got = {r.n: r for r in context.dense_rank_desc(context.average_rank(df, "v", "up", chunk_rows=chunk), "v", "down", chunk_rows=chunk).collect()}
    for i, v in enumerate(values):
        if v is None:
            assert got[i].up is None and got[i].down is None
        else:
            places = [j + 1 for j, x in enumerate(known) if x == v]
            assert got[i].up == sum(places) / len(places)
            assert got[i].down == sorted(set(known), reverse=True).index(v) + 1
