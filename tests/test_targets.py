"""Many targets on one preparation, the boosted grid by prefixes, and the gates against leaks."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gameline.operators import dataset
from gameline.plans import training


@pytest.fixture(scope="module")
def table(spark):
    """Two features, three targets, one of them missing at times, over 60 days."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        a, b = (float(x) for x in rng.normal(size=2))
        noise = [float(x) for x in rng.normal(size=3)]
        rows.append((i % 30, i, i // 15, a if i % 11 else None, b, a + noise[0], b - noise[1], None if i % 7 == 0 else a + b + noise[2], b))
    df = spark.createDataFrame(rows, "player int, seq long, day int, a_l5 double, b_l5 double, pts double, trb double, ast double, trb_l10 double")
    return df.withColumn("game_date", F.date_add(F.lit("2025-01-01").cast("date"), "day")).drop("day").persist()


def two(rows, sd):
    return {"ridge": training.ridge(1.0, rows, sd), "flat": training.ridge(1e7, rows, sd)}


@pytest.mark.parametrize("select_on", ["test", "validation"])
def test_targets_side_by_side_equal_each_alone(table, select_on):
    settings = dict(regressors=two, ensemble=True, select_on=select_on, test_days=10, validation_days=10)
    lines = {"pts": None, "trb": "trb_l10"}
    together = training.train_targets(table, lines, ["a_l5", "b_l5"], **settings)
    for target, line in lines.items():
        alone, predictions = training.train_regression(table, target, ["a_l5", "b_l5"], line, **settings)
        bundle, found = together[target]
        assert bundle.kind == alone.kind == "ridge"
        assert bundle.metrics == pytest.approx(alone.metrics)
        key = ["player", "seq"]
        a, b = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (found, predictions))
        assert a.columns.tolist() == b.columns.tolist() and np.allclose(a.predicted, b.predicted) and ("line" in a) == bool(line)
        # the bundle scores raw rows as the shared vectors were scored
        again = bundle.score(table, "p", floor=None).toPandas().set_index("seq").p
        assert np.allclose(again.loc[a.seq], a.predicted)


def test_missing_targets_take_no_part(table):
    bundle, found = training.train_targets(table, {"ast": None, "pts": None}, ["a_l5", "b_l5"], regressors=two, test_days=10)["ast"]
    assert bundle.metrics["train_rows"] == table.where("ast is not null and game_date < date'2025-02-19'").count()
    assert found.where("actual is null").isEmpty() and found.count() > 0


def test_boosted_grid_by_prefixes_equals_the_plain_grid(table):
    rows = VectorAssembler(inputCols=["b_l5"], outputCol="features").transform(table.withColumn("label", F.col("trb")))
    folds = dataset.contiguous_folds(rows.select("game_date", "seq", "label", "features"), "game_date", ["seq"], 3).persist()
    grid = dict(lengths=(2, 4), depths=(1, 2), steps=(0.1,), leaves=(15,))
    got = training.boosted_grid(folds, **grid)
    want = {}
    for n in grid["lengths"]:
        for depth in grid["depths"]:
            errors = []
            for fold in range(3):
                gbm = GBTRegressor(labelCol="label", maxIter=n, maxDepth=depth, stepSize=0.1, minInstancesPerNode=15, subsamplingRate=0.8,
                                   seed=training.SEED)
                model = gbm.fit(folds.where(F.col("fold") != fold).select("label", "features"))
                errors.append(model.transform(folds.where(F.col("fold") == fold)).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0])
            want[n, depth, 0.1, 15] = sum(errors) / 3
    assert got == pytest.approx(want)
    best = training.grid_search(rows, "gbm", 900, 1.0, **grid)
    assert (best.getMaxIter(), best.getMaxDepth()) == min(want, key=want.get)[:2]


def test_a_feature_that_gives_the_target_away_stops_training(table):
    leaking = table.withColumn("x_l5", F.col("pts") + F.col("b_l5") * 0.1)
    with pytest.raises(ValueError, match="x_l5 with pts"):
        training.train_targets(leaking, {"pts": None}, ["a_l5", "x_l5"], regressors=two, test_days=10)
    with pytest.raises(ValueError, match="x_l5 with pts"):
        training.train_regression(leaking, "pts", ["a_l5", "x_l5"], regressors=two, test_days=10)


def test_current_columns_stop_training(table):
    with pytest.raises(ValueError, match="current-event column trb"):
        training.train_targets(table, {"pts": None}, ["a_l5", "trb"], regressors=two)
