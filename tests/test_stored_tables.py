"""Merging by period and publishing by pointer."""

import datetime
import glob
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gameline.operators.quality import check_table
from gameline.sources import sinks

D = datetime.date


def files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_touches_only_its_periods(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "player string, game_date date, seq int, pts double"
    first = [("a", D(2025, 1, 5), 1, 1.0), ("a", D(2025, 1, 5), 2, 2.0), ("b", D(2025, 2, 1), 1, 3.0), ("c", None, 1, 4.0), ("a", D(2025, 3, 9), 1, 5.0)]
    key = ["player", "game_date"]
    sinks.merge_table(spark.createDataFrame(first, schema), path, key, ["seq"])
    assert rows(sinks.read_merged(spark, path)) == sorted([r for r in first if r[3] != 1.0], key=str)
    before = files(path)
    sinks.merge_table(spark.createDataFrame([("b", D(2025, 2, 1), 0, 9.0), ("d", D(2025, 2, 7), 1, 6.0)], schema), path, key, ["seq"])
    after = files(path)
    changed = {f.split("/")[0] for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {"stored_period=2025-02-01"}
    want = [("a", D(2025, 1, 5), 2, 2.0), ("b", D(2025, 2, 1), 0, 9.0), ("d", D(2025, 2, 7), 1, 6.0), ("c", None, 1, 4.0), ("a", D(2025, 3, 9), 1, 5.0)]
    assert rows(sinks.read_merged(spark, path)) == sorted(want, key=str)
    # a row without a date replaces its older self; nothing changes without new rows
    sinks.merge_table(spark.createDataFrame([("c", None, 2, 7.0)], schema), path, key, ["seq"])
    assert rows(sinks.read_merged(spark, path)) == sorted([*[r for r in want if r[0] != "c"], ("c", None, 2, 7.0)], key=str)
    before = files(path)
    sinks.merge_table(spark.createDataFrame([], schema), path, key, ["seq"])
    assert files(path) == before
    with pytest.raises(ValueError):
        sinks.merge_table(spark.createDataFrame(first, schema), path, ["player"])


def test_merge_with_a_new_column(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.merge_table(spark.createDataFrame([("a", D(2025, 1, 5), 1.0), ("b", D(2025, 2, 5), 1.0)], "player string, game_date date, pts double"),
                      path, ["player", "game_date"])
    sinks.merge_table(spark.createDataFrame([("a", D(2025, 1, 6), 2.0, 3)], "player string, game_date date, pts double, ast int"), path,
                      ["player", "game_date"])
    got = sinks.read_merged(spark, path).select("player", "game_date", "pts", "ast")
    assert rows(got) == sorted([("a", D(2025, 1, 5), 1.0, None), ("a", D(2025, 1, 6), 2.0, 3), ("b", D(2025, 2, 5), 1.0, None)], key=str)


def checks(limit):
    return lambda df: check_table(df.agg(F.max("x").alias("m")), {"largest": (F.col("m"), F.col("m") < limit)})


def test_failing_gate_keeps_the_last_version(spark, tmp_path):
    path = str(tmp_path / "p")
    assert sinks.publish(spark.range(3).withColumnRenamed("id", "x"), path, checks(10))
    assert not sinks.publish(spark.range(30).withColumnRenamed("id", "x"), path, checks(10))
    assert sinks.read_published(spark, path).count() == 3
    assert sinks.publish(spark.range(5).withColumnRenamed("id", "x"), path)
    assert sinks.read_published(spark, path).count() == 5


def test_failing_write_keeps_the_last_version(spark, tmp_path):
    path = str(tmp_path / "p")
    assert sinks.publish(spark.range(3).withColumnRenamed("id", "x"), path, checks(10))
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("x"))
    with pytest.raises(PySparkException):
        sinks.publish(broken, path, checks(10))
    assert sinks.read_published(spark, path).count() == 3
