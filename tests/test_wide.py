"""Medians and moments of many columns, and how a fit grows: pieces, fits side by side, shared vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gameline.operators import overunder, wide
from gameline.plans import training
from gameline.session import pieces


def frame(spark, columns, parts=5):
    names = [f"c{i}" for i in range(len(columns))]
    rows = list(zip(*[[None if x is None else float(x) for x in c] for c in columns]))
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(parts), names


def test_medians_are_exact(spark):
    rng = np.random.default_rng(1)
    n = 2001
    close = 1.0 + np.arange(n) * np.finfo(float).eps  # values that differ in their last bits
    columns = [rng.normal(size=n), rng.normal(size=n) * 1e300, rng.integers(-3, 3, n), np.zeros(n), -rng.exponential(size=n) * 1e-310,
               close, np.where(np.arange(n) % 2, -0.0, 0.0), np.where(np.arange(n) < 900, np.inf, rng.normal(size=n))]
    df, names = frame(spark, columns)
    for rows, take in ((df, slice(None)),):
        got = wide.medians(rows, names)
        assert [got[c] for c in names] == [np.median(c[take]) for c in columns]
    even, names = frame(spark, [c[:-1] for c in columns])
    got = wide.medians(even, names)
    assert [got[c] for c in names] == [np.median(c[:-1]) for c in columns]


def test_medians_of_missing_and_odd_values(spark):
    df, names = frame(spark, [[None] * 4, [1, None, 4, None], [float("nan"), float("nan"), 1, float("nan")], [7, None, None, None]])
    got = wide.medians(df, names)
    assert (got["c0"], got["c1"], got["c3"]) == (None, 2.5, 7.0) and np.isnan(got["c2"])
    assert wide.medians(df.limit(0), names) == dict.fromkeys(names)
    assert wide.moments(df.limit(0), {"c1": 2.5}) == {"c1": (None, None)}


def test_moments_fill_and_keep_constant_columns_flat(spark):
    rng = np.random.default_rng(2)
    x = [float(v) if i % 9 else None for i, v in enumerate(rng.normal(1e6, 1.0, 3000))]
    df, names = frame(spark, [x, [0.1] * 3000])
    got = wide.moments(df, {"c0": 1e6, "c1": 0.1})
    filled = np.array([1e6 if v is None else v for v in x])
    assert got["c0"] == pytest.approx((filled.mean(), filled.std()), rel=1e-12)
    assert got["c1"] == (0.1, 0.0)


def test_scaling_does_not_turn_rows_into_cells(spark, monkeypatch):
    df, names = frame(spark, [np.arange(100.0), np.arange(100.0) ** 2])
    monkeypatch.setattr(type(df), "unpivot", lambda *a, **k: pytest.fail("one row per column and row"))
    assert training.Scaling.fit(df, names).medians == {"c0": 49.5, "c1": (49.0 ** 2 + 50.0 ** 2) / 2}


def test_pieces_do_not_grow_without_end(spark):
    df = spark.range(1000, numPartitions=500)
    most = pieces(spark)
    assert most >= spark.sparkContext.defaultParallelism
    assert training.in_pieces(df, 10**9).rdd.getNumPartitions() == most < 500
    assert training.in_pieces(df, 120_000).rdd.getNumPartitions() == 3
    assert training.in_pieces(df).rdd.getNumPartitions() == 1
    assert training.side_by_side(spark, 1000) == training.FITS_AT_ONCE and training.side_by_side(spark, 10**9) == 1


def test_fits_have_one_piece_a_core_or_a_few_large_ones(spark):
    df, cores = spark.range(1000, numPartitions=500), spark.sparkContext.defaultParallelism
    assert training.in_pieces(df, cores * 500_000).rdd.getNumPartitions() == cores
    assert training.in_pieces(df, cores * 500_000 + 1).rdd.getNumPartitions() == 2 * cores


def test_bundles_of_one_preparation_share_their_vectors(spark):
    df, names = frame(spark, [np.arange(50.0), np.sin(np.arange(50.0))])
    df = df.withColumn("label", F.col("c0") * 2 - 9)
    one = training._fit_all(df, training.Scaling.fit(df, names), {"a": training.ridge(1.0, 50, 1.0), "b": training.ridge(90.0, 50, 1.0)})
    other = training._fit_all(df, training.Scaling.fit(df, ["c0"]), {"c": training.ridge(5.0, 50, 1.0)})
    bundles = {k: training.Bundle(m, names, "x", "ridge", {}) for k, m in {**one, **other}.items()}
    want = df
    for name, bundle in bundles.items():
        want = bundle.score(want, name)
    got = training.score_bundles(df, bundles)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("struct(z_c0,") == 2  # one vector for each preparation


def test_classifier_inputs_are_all_that_the_features_read(spark):
    for prop in ("pts", "trb", "pra"):
        given = [c for c in overunder.inputs([prop])]
        row = spark.createDataFrame([tuple(float(i + 1) for i in range(len(given)))], ", ".join(f"{c} double" for c in given))
        more = row.withColumns({c: F.lit(3.0) for c in ("trb_l5", "ast_matchup_edge", "mp_l5", "is_b2b") if c not in given})
        names = overunder.OVER_UNDER_FEATURES
        a, b = (overunder.over_under_features(x, prop, F.lit(2.0), consistent_below=1.0).select(*names).first() for x in (row, more))
        assert a == b
