"""Training, scoring, saving."""

import inspect
import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gameline import session
from gameline.catalog.models import feature_rows, inputs
from gameline.operators import dataset, lines, rolling, schedule
from gameline.plans import daily, training, views
from gameline.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    # 0.001 of the scale leaves too few rows for a split by date
    df = feature_rows(spark, "/root/testdata/sf0.01").persist()
    yield df
    df.unpersist()


def known(spark, n=1500):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = x @ np.array([1.0, 2.0, -1.0]) + rng.normal(size=n)
    data = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(data, "a double, b double, c double, label double"), x, y


@pytest.mark.parametrize("alpha", [1.0, 400.0])
def test_ridge_penalty(spark, alpha):
    df, x, y = known(spark)
    scaling = training.Scaling.fit(df, ["a", "b", "c"])
    model = training._fit_all(df, scaling, {"r": training.ridge(alpha, len(y), float(np.std(y, ddof=1)))})["r"].stages[-1]
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(model.coefficients.toArray(), want, rtol=1e-3)


def test_scaling_fills_with_medians(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (3.0, 3.0), (8.0, 4.0)], "a double, label double")
    s = training.Scaling.fit(df, ["a"])
    assert s.medians == {"a": 3.0} and s.means == {"a": 3.75}
    assert s.stds["a"] == pytest.approx(np.std([1, 3, 3, 8]))


def test_seventy_features(rows):
    cols = inputs(rows)
    assert len(cols) == 70 and not dataset.leak_issues(cols)


def test_regression_bundle(spark, rows, tmp_path):
    def few(n, sd):
        return {"ridge": training.ridge(1.0, n, sd), "gbm": training.minutes_model(3)}

    bundle, predictions = training.train_regression(rows, "pts", inputs(rows), "pts_l10", regressors=few, ensemble=True)
    assert bundle.metrics["mae"] == min(bundle.metrics[f"{k}_mae"] for k in ("ridge", "gbm", "ensemble"))
    cutoff = rows.agg(F.date_sub(F.max("game_date"), 21)).first()[0]
    assert predictions.where(F.col("game_date") < F.lit(cutoff)).isEmpty()
    bundle.save(str(tmp_path / "m"), spark)
    again = training.Bundle.load(str(tmp_path / "m"), spark)
    assert again.features == bundle.features and again.kind == bundle.kind
    a = bundle.score(predictions.limit(0).sparkSession.createDataFrame(rows.limit(5).collect(), rows.schema)).collect()
    b = again.score(spark.createDataFrame(rows.limit(5).collect(), rows.schema)).collect()
    assert a == b and all(r.prediction >= 0 for r in a)
    flags = training.judge_bundles([bundle], spark).first()
    assert flags.target == "pts" and flags.band in ("suspicious", "profitable", "losing")
    assert training.importances(bundle, spark).count() in (0, 5)


def test_validation_days_choose(rows):
    def two(n, sd):
        return {"a": training.ridge(1.0, n, sd), "b": training.ridge(1e6, n, sd)}

    bundle, _ = training.train_regression(rows, "trb", inputs(rows), regressors=two, select_on="validation")
    assert bundle.kind in ("a", "b") and bundle.metrics["mae"] > 0
    with pytest.raises(ValueError):
        training.train_regression(rows, "pts", ["mp"])


def test_minutes_fit_on_older_rows(spark):
    raw = views.games(spark, "/root/testdata/sf0.01")
    g = rolling.rolling_features(raw, rolling.spec_task())
    with pytest.raises(ValueError):
        training.train_minutes(g, trees=2)  # without the schedule
    g = schedule.attach_schedule(g, schedule.team_schedule(raw))
    bundle = training.train_minutes(g, trees=2)
    assert {"mae", "train_mae", "baseline_mae"} <= set(bundle.metrics)
    p = training.predicted_minutes(g, bundle)
    assert p.where((F.col("predicted_minutes") < 0) | (F.col("predicted_minutes") > 48)).isEmpty()


def test_classifier_needs_enough_rows(rows):
    assert training.train_classifier(rows, "pts", min_rows=10**9, trees=1) is None


def test_daily_run_writes_outputs(spark, rows, tmp_path):
    def one(n, sd):
        return {"ridge": training.ridge(1.0, n, sd)}

    models = {p: training.train_regression(rows, p, inputs(rows), regressors=one)[0] for p in ("pts", "trb")}
    day = F.lit("2001-08-03").cast("date")
    run = daily.run_daily(rows, models, day, out=str(tmp_path))
    total = run.summary.first()
    assert total.total_players == run.players.count()
    assert spark.read.parquet(str(tmp_path / "opportunities")).count() == total.total_opportunities
    assert sinks.read_latest_run(spark, str(tmp_path / "summary")).first().total_players == total.total_players
    games = rows.limit(1).select(F.col("tm").alias("home"), F.col("opp").alias("away"))
    coming = daily.run_daily(rows, models, day, games=games, min_minutes=0.0)
    assert coming.players.select("team").distinct().count() <= 2


def test_prop_codes(spark):
    df = spark.createDataFrame([("player_points",), ("other",)], "m string")
    assert [r[0] for r in df.select(lines.code_of(F.col("m"), lines.MARKET_PROPS)).collect()] == ["pts", None]


def test_classifier_queries_see_matchup_history(spark, data, monkeypatch):
    from gameline.catalog import models
    from gameline.operators import overunder

    given = []
    monkeypatch.setattr(training, "train_classifier", lambda df, prop, **_: given.append(overunder.over_under_features(
        df, prop, F.col(f"{prop}_line"), F.col(prop)).agg(F.max("matchup_games"), F.max(F.abs("matchup_edge"))).first()))
    for query in (models.train_classifiers, models.class_picks):
        query(spark, data).collect()
    assert len(given) == 9 and all(games > 0 and edge > 0 for games, edge in given)


def test_classifier_queries_fit_the_published_ensembles(spark, data, monkeypatch):
    from gameline.catalog import models

    given, taken = [], inspect.signature(training.train_classifier)

    def noted(*args, **settings):
        call = taken.bind(*args, **settings)
        call.apply_defaults()
        made = training.classifiers(1000, call.arguments["trees"])
        given.append([made["gbm_deep"].getMaxIter(), made["gbm_wide"].getMaxIter(), made["rf_deep"].getNumTrees(), made["rf_wide"].getNumTrees()])

    monkeypatch.setattr(training, "train_classifier", noted)
    for query in (models.train_classifiers, models.class_picks):
        query(spark, data).collect()
    assert given == [[200, 300, 200, 300]] * 9


def test_fits_side_by_side_ship_the_package_once(monkeypatch):
    monkeypatch.setattr(session, "_shipped", set())
    added = []
    context = SimpleNamespace(applicationId="an application", addPyFile=lambda path: time.sleep(0.2) or added.append(path))
    given = SimpleNamespace(sparkContext=context)
    with ThreadPoolExecutor(8) as workers:
        assert all(s is given for s in workers.map(session.ship, [given] * 8))
    assert len(added) == 1
