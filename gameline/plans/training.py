"""Regression and over/under models on Spark ML.

Data stays distributed throughout; the driver sees one row of fitted figures per step (medians, means,
deviations, metrics), never rows of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.functions import metrics
from gameline.functions.metrics import aliased
from gameline.operators import dataset, decisions, overunder, quality, stats, wide
from gameline.session import pieces, use_checkpoint_folder

SEED = 42
FITS_AT_ONCE = 8
ROWS_A_PIECE = 50_000
MOST_ROWS_A_PIECE = 500_000

# fixed values: inputs of the minutes model
MINUTES_FEATURES = [
    "mp_l5", "mp_l10", "mp_l20", "mp_l3", "mp_avg_l3", "mp_std_l10", "mp_std_l20", "days_rest", "is_b2b",
    "is_b2b_second", "games_last_7d", "games_last_14d", "high_min_prev", "games_streak", "player_days_rest",
    "games_played",
]


@contextmanager
def kept(df: DataFrame):
    """Keep a frame that several fits read; lost pieces are computed again from their source."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def settled(df: DataFrame) -> DataFrame:
    """A computed frame that stays after what it was made from is released: a checkpoint where there is a folder, else kept."""
    if use_checkpoint_folder(df.sparkSession):
        return df.checkpoint()
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def in_pieces(df: DataFrame, n: int | None = None, rows: int = ROWS_A_PIECE, most_rows: int = MOST_ROWS_A_PIECE) -> DataFrame:
    """A frame of ``n`` rows in no more pieces than these or the cluster's cores need: a fit starts hundreds of jobs over them.

    A tree's fit makes and shuffles the statistics of all open nodes once for every piece, so there is one piece a core, or a few
    where these would be large.  Every task of every job reports to the driver, so the number of pieces has a bound that does not
    depend on the rows.
    """
    n = df.count() if n is None else n
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = -(-n // rows)
    if wanted > cores:
        wanted = min(wanted, cores * -(-n // (cores * most_rows)))
    return df.coalesce(max(1, min(pieces(df.sparkSession), wanted)))


def side_by_side(spark: SparkSession, n: int, at_once: int = FITS_AT_ONCE) -> int:
    """How many fits over ``n`` rows run at the same time: small ones wait for each other's jobs, large ones fill the cores and would only
    share the memory."""
    return max(1, min(at_once, 4 * pieces(spark) * ROWS_A_PIECE // max(1, n)))


def _one_row(df: DataFrame) -> dict:
    return df.first().asDict()


@dataclass
class Scaling:
    """Medians, means and population deviations of the training rows, after filling."""

    features: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str]) -> Scaling:
        # one figure per feature; ``train`` is read several times and should be kept
        medians = {c: 0.0 if m is None else m for c, m in wide.medians(train, features).items()}
        found = wide.moments(train, medians)
        return cls(list(features), medians, {c: found[c][0] or 0.0 for c in features}, {c: found[c][1] or 1.0 for c in features})

    def stages(self) -> list:
        """Persistable stages: fill and scale in SQL, then assemble."""
        made = ", ".join(
            f"(coalesce(cast(`{c}` AS double), {self.medians[c]!r}D) - {self.means[c]!r}D) / {self.stds[c]!r}D AS `z_{c}`"
            for c in self.features)
        scaled = SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__")
        assembled = VectorAssembler(inputCols=[f"z_{c}" for c in self.features], outputCol="features")
        return [scaled, assembled]


def ridge(alpha: float, rows: int, label_std: float, label: str = "label", prediction: str = "prediction") -> LinearRegression:
    """Ridge with penalty ``alpha`` on the sum of squares; Spark's penalty is per row and label deviation."""
    return LinearRegression(labelCol=label, predictionCol=prediction, elasticNetParam=0.0, standardization=False,
                            solver="normal", regParam=alpha * label_std / rows)


# fixed values of the three blocks that follow: settings of the published models
def base_regressors(rows: int, label_std: float, trees: int = 100) -> dict[str, Estimator]:
    return {
        "gbm": GBTRegressor(labelCol="label", maxIter=trees, maxDepth=4, stepSize=0.1, minInstancesPerNode=20, seed=SEED),
        "ridge": ridge(1.0, rows, label_std),
        "rf": RandomForestRegressor(labelCol="label", numTrees=trees, maxDepth=8, minInstancesPerNode=20,
                                    featureSubsetStrategy="all", seed=SEED),
    }


def tuned_regressors(rows: int, label_std: float, trees: int = 150) -> dict[str, Estimator]:
    """The tuned settings: subsampled boosting, deeper forest on random feature subsets."""
    return {
        "gbm": GBTRegressor(labelCol="label", maxIter=trees, maxDepth=5, stepSize=0.05, minInstancesPerNode=15,
                            subsamplingRate=0.8, seed=SEED),
        "ridge": ridge(1.0, rows, label_std),
        "rf": RandomForestRegressor(labelCol="label", numTrees=trees, maxDepth=10, minInstancesPerNode=15,
                                    featureSubsetStrategy="sqrt", seed=SEED),
    }


def classifiers(rows: int, trees: int = 300) -> dict[str, Estimator]:
    """Two boosted, two forests and a logistic baseline; ``trees`` scales the largest ensembles."""
    most = max(1, trees)
    fewer = max(1, trees * 2 // 3)
    return {
        "gbm_deep": GBTClassifier(labelCol="label", maxIter=fewer, maxDepth=5, stepSize=0.05, minInstancesPerNode=10,
                                  subsamplingRate=0.8, seed=SEED),
        "gbm_wide": GBTClassifier(labelCol="label", maxIter=most, maxDepth=3, stepSize=0.1, minInstancesPerNode=20, seed=SEED),
        "rf_deep": RandomForestClassifier(labelCol="label", numTrees=fewer, maxDepth=10, minInstancesPerNode=10,
                                          featureSubsetStrategy="sqrt", seed=SEED),
        "rf_wide": RandomForestClassifier(labelCol="label", numTrees=most, maxDepth=6, minInstancesPerNode=20,
                                          featureSubsetStrategy="0.7", seed=SEED),
        "logistic": LogisticRegression(labelCol="label", elasticNetParam=0.0, standardization=False,
                                       regParam=1.0 / (0.1 * rows), maxIter=1000),
    }


def averaged(models: Mapping[str, PipelineModel]) -> PipelineModel:
    """Ensemble of fitted models that share their preparation: the mean of their predictions."""
    first = next(iter(models.values()))
    members, columns = [], []
    for name, model in models.items():
        column = f"p_{name}"
        members.append(model.stages[-1].copy().setPredictionCol(column))
        columns.append(f"`{column}`")
    mean = SQLTransformer(statement=f"SELECT *, ({' + '.join(columns)}) / {len(columns)}D AS prediction FROM __THIS__")
    return PipelineModel(stages=[*first.stages[:-1], *members, mean])


def boosted_grid(folds: DataFrame, lengths: Sequence[int] = (100, 150), depths: Sequence[int] = (4, 5),
                 steps: Sequence[float] = (0.05, 0.1), leaves: Sequence[int] = (15, 20), k: int = 3,
                 at_once: int = FITS_AT_ONCE) -> dict[tuple[int, int, float, int], float]:
    """Mean absolute error over ``k`` folds for each (trees, depth, step, rows of a leaf) of the boosted grid.

    A boosted model holds every shorter one, so only the longest is fitted for each fold and the errors of
    all lengths come from one pass over the fold's rows.  ``folds``: label, features, fold.
    """
    cells = [(d, s, m) for d in depths for s in steps for m in leaves]

    def errors(fold: int, depth: int, step: float, leaf: int) -> list[float]:
        gbm = GBTRegressor(labelCol="label", maxIter=max(lengths), maxDepth=depth, stepSize=step, minInstancesPerNode=leaf,
                           subsamplingRate=0.8, seed=SEED)
        model = gbm.fit(folds.where(F.col("fold") != fold).select("label", "features"))
        return model.evaluateEachIteration(folds.where(F.col("fold") == fold).select("label", "features"), "absolute")

    found = _together(folds.sparkSession, {f"{f}/{c}": partial(errors, f, *c) for c in cells for f in range(k)}, at_once)
    return {(n, *c): sum(found[f"{f}/{c}"][n - 1] for f in range(k)) / k for n in lengths for c in cells}


def grid_search(train: DataFrame, kind: str, rows: int, label_std: float, order: str = "game_date",
                seq: Sequence[str] = ("seq",), parallelism: int = 4, **grid) -> Estimator:
    """Best settings by mean absolute error over three unshuffled folds; ``train`` has features and label.

    ``grid`` are the values of ``boosted_grid``.  Of equally good settings the first counts.
    """
    folds = dataset.contiguous_folds(train, order, seq, 3)
    if kind == "gbm":
        with kept(folds.select("label", "features", "fold")) as whole, kept(in_pieces(whole)) as numbered:
            errors = boosted_grid(numbered, **grid)
        n, depth, step, leaf = min(errors, key=errors.get)
        return GBTRegressor(labelCol="label", maxIter=n, maxDepth=depth, stepSize=step, minInstancesPerNode=leaf, subsamplingRate=0.8, seed=SEED)
    if kind != "ridge":
        raise ValueError(f"no grid for {kind!r}")
    estimator = ridge(1.0, rows, label_std)
    # a fold trains on two thirds of the rows
    scale = label_std / (rows * 2 / 3)
    cells = ParamGridBuilder().addGrid(estimator.regParam, [a * scale for a in (0.1, 0.5, 1.0, 2.0, 5.0)]).build()
    search = CrossValidator(estimator=estimator, estimatorParamMaps=cells, numFolds=3, foldCol="fold", seed=SEED,
                            evaluator=RegressionEvaluator(labelCol="label", metricName="mae"), parallelism=parallelism)
    found = search.fit(folds)
    best = cells[min(range(len(cells)), key=lambda i: found.avgMetrics[i])]
    return ridge(best[estimator.regParam] / scale, rows, label_std)


@dataclass
class Bundle:
    """A fitted model with everything needed to score and to judge it."""

    model: PipelineModel
    features: list[str]
    target: str
    kind: str
    metrics: dict[str, float]
    settings: dict[str, float] = field(default_factory=dict)

    def metrics_table(self, spark: SparkSession) -> DataFrame:
        cells = {**self.metrics, **self.settings}
        rows = [(self.target, self.kind, k, float(v)) for k, v in cells.items() if v is not None]
        return spark.createDataFrame(rows, "target string, kind string, name string, value double")

    def save(self, path: str, spark: SparkSession) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.metrics_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")
        names = [(i, f) for i, f in enumerate(self.features)]
        spark.createDataFrame(names, "position int, feature string").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/features")

    @classmethod
    def load(cls, path: str, spark: SparkSession, settings: Sequence[str] = ("consistent_below", "threshold")) -> Bundle:
        # both tables hold a handful of rows: one per figure, one per feature
        rows = spark.read.parquet(f"{path}/metrics").collect()
        features = [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("position").collect()]
        figures = {r.name: r.value for r in rows}
        return cls(PipelineModel.load(f"{path}/model"), features, rows[0].target, rows[0].kind,
                   {k: v for k, v in figures.items() if k not in settings},
                   {k: v for k, v in figures.items() if k in settings})

    def score(self, df: DataFrame, name: str = "prediction", floor: float | None = 0.0) -> DataFrame:
        """Add the prediction, not below ``floor``; the working columns are dropped again."""
        scored = self.model.transform(df)
        value = F.col("prediction") if floor is None else F.greatest(F.col("prediction"), F.lit(floor))
        return scored.select(*df.columns, value.alias(name))

    def probability(self, df: DataFrame, name: str = "prob_over") -> DataFrame:
        """Add the probability of going over."""
        scored = self.model.transform(df)
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


def score_bundles(df: DataFrame, bundles: Mapping[str, Bundle], floor: float | None = 0.0) -> DataFrame:
    """Add the predictions of several bundles, none below ``floor``; those trained on one preparation read one vector."""
    shared: dict[tuple, dict[str, Bundle]] = {}
    for name, bundle in bundles.items():
        shared.setdefault(tuple(map(id, bundle.model.stages[:2])), {})[name] = bundle
    scored, given = df, list(df.columns)
    for alike in shared.values():
        ahead = next(iter(alike.values())).model.stages[:2]
        scored = PipelineModel(stages=ahead).transform(scored).select(*given, "features")
        for name, bundle in alike.items():
            value = F.col("prediction") if floor is None else F.greatest(F.col("prediction"), F.lit(floor))
            made = PipelineModel(stages=bundle.model.stages[2:]).transform(scored)
            scored = made.select(*given, "features", value.alias(name))
            given.append(name)
        scored = scored.drop("features")
    return scored.select(*df.columns, *bundles)


def _fit_all(train: DataFrame, scaling: Scaling, estimators: Mapping[str, Estimator]) -> dict[str, PipelineModel]:
    """Fit several estimators on one prepared frame, the preparation computed once."""
    ahead = scaling.stages()
    prepared = PipelineModel(stages=ahead).transform(train)
    out = {}
    with kept(in_pieces(prepared.select("label", "features"), train.count())) as rows:
        for name, estimator in estimators.items():
            out[name] = PipelineModel(stages=[*ahead, estimator.fit(rows)])
    return out


@dataclass
class Prepared:
    """One assembled vector table for several targets.

    ``rows``: identifiers, ``part`` (0 trained on, 1 judged on, 2 tested on), ``features``, and for each
    target its label and its line.  ``sizes`` holds the trained rows and the label's deviation of each target.
    """

    rows: DataFrame
    stages: list
    features: list[str]
    lines: dict[str, str | None]
    sizes: dict[str, tuple[int, float]]

    def of(self, target: str, part: int) -> DataFrame:
        label = F.col(f"_label_{target}")
        line = [F.col(f"_line_{target}").alias("line")] if self.lines[target] else []
        ids = [c for c in self.rows.columns if not c.startswith("_") and c not in ("part", "features")]
        return self.rows.where((F.col("part") == part) & label.isNotNull()).select(*ids, label.alias("label"), *line, "features")


def _parts(df: DataFrame, test_days: int, select_on: str, validation_days: int, order: str) -> DataFrame:
    """Add ``part``: 0 for training rows, 1 for validation days, 2 for the last ``test_days`` days."""
    marked = dataset.temporal_split(df, test_days, order)
    if select_on == "test":
        return marked.withColumn("part", F.col("is_test") * 2).drop("is_test")
    if select_on != "validation":
        raise ValueError(f"unknown selection {select_on!r}")
    newest = marked.where("is_test = 0").agg(F.date_sub(F.max(order), validation_days)).scalar()
    late = F.when(F.col(order) >= newest, 1).otherwise(0)
    return marked.withColumn("part", F.when(F.col("is_test") == 1, 2).otherwise(late)).drop("is_test")


@contextmanager
def prepared(df: DataFrame, lines: Mapping[str, str | None], features: Sequence[str], test_days: int = 21, select_on: str = "test",
             validation_days: int = 21, order: str = "game_date"):
    """Fill, scale and assemble once for all targets (``lines``: target to line column or None), and look for leaks.

    Medians, means and deviations are those of all training rows.  Small tables are kept in few pieces, since
    a fit starts hundreds of jobs over them.
    """
    use_checkpoint_folder(df.sparkSession)
    ids = [c for c in ("player", order, "seq") if c in df.columns]
    needed = dict.fromkeys([*ids, *features, *lines, *[c for c in lines.values() if c]])
    with kept(df.select(*needed)) as narrow:
        marked = _parts(narrow, test_days, select_on, validation_days, order)
        scaling = Scaling.fit(marked.where("part = 0"), features)
        stages = scaling.stages()
        vectors = PipelineModel(stages=stages).transform(marked).select(
            *ids, "part", "features", *[F.col(t).cast("double").alias(f"_label_{t}") for t in lines],
            *[F.col(c).cast("double").alias(f"_line_{t}") for t, c in lines.items() if c])
        with kept(in_pieces(vectors, narrow.count())) as rows:
            train = rows.where("part = 0")
            sizes = _one_row(train.agg(*[a for t in lines for a in (
                F.count(f"_label_{t}").alias(f"n_{t}"), F.stddev_samp(f"_label_{t}").alias(f"s_{t}"))]))
            narrow.unpersist()  # the vectors stand; the fits need the memory
            dataset.require_low_correlation(train, features, {t: f"_label_{t}" for t in lines if t in dataset.TARGETS})
            yield Prepared(rows, stages, list(features), dict(lines),
                           {t: (sizes[f"n_{t}"], sizes[f"s_{t}"] or 1.0) for t in lines})


def _together(spark: SparkSession, calls: Mapping[str, Callable[[], object]], at_once: int) -> dict:
    """Run independent fits at the same time, each as jobs of a scheduler pool of its own."""
    def pooled(name: str):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return calls[name]()

    with ThreadPoolExecutor(max(1, min(at_once, len(calls) or 1))) as workers:
        waiting = {name: workers.submit(inheritable_thread_target(spark)(pooled), name) for name in calls}
        return {name: w.result() for name, w in waiting.items()}


def _score_target(p: Prepared, target: str, fitted: Mapping[str, object], judge: int) -> tuple[Bundle, DataFrame]:
    """Judge the fitted models of a target and bundle the best one with its figures and test predictions."""
    models = {name: PipelineModel(stages=[*p.stages, m]) for name, m in fitted.items() if not isinstance(m, PipelineModel)}
    direct: dict[str, object] = {n: m for n, m in fitted.items() if not isinstance(m, PipelineModel)}
    if "ensemble" in fitted:
        models["ensemble"] = averaged(models)
        direct["ensemble"] = PipelineModel(stages=models["ensemble"].stages[len(p.stages):])

    def judged(name: str, part: int) -> dict:
        scored = direct[name].transform(p.of(target, part)).select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
        return _one_row(scored.agg(*aliased(metrics.regression_metrics())))

    marks = {name: judged(name, judge) for name in models}
    best = min(marks, key=lambda n: marks[n]["mae"] if marks[n]["mae"] is not None else float("inf"))
    on_test = marks[best] if judge == 2 else judged(best, 2)
    figures = {**on_test, **{f"train_{k}": v for k, v in judged(best, 0).items()},
               **{f"{n}_mae": m["mae"] for n, m in marks.items()}, "train_rows": p.sizes[target][0]}
    bundle = Bundle(models[best], p.features, target, best, figures)
    scored = direct[best].transform(p.of(target, 2))
    ids = [c for c in ("player", "game_date", "seq") if c in scored.columns]
    line = ["line"] if p.lines[target] else []
    predictions = scored.select(*ids, F.col("label").alias("actual"), F.col("prediction").alias("predicted"), *line, F.lit(target).alias("prop"))
    if line:
        simulated = _one_row(predictions.agg(*aliased(metrics.simulated_decisions())))
        bundle.metrics.update({k: simulated[k] for k in ("n_bets", "accuracy", "roi_pct")})
    return bundle, predictions


def train_targets(df: DataFrame, lines: Mapping[str, str | None], features: Sequence[str], test_days: int = 21,
                  regressors: Callable[..., Mapping[str, Estimator]] = base_regressors, ensemble: bool = False,
                  select_on: str = "test", validation_days: int = 21, trees: int | None = None, order: str = "game_date",
                  at_once: int = FITS_AT_ONCE) -> dict[str, tuple[Bundle, DataFrame]]:
    """Fit several regressors for each target on the older rows and keep each target's best: (bundle, test predictions).

    ``lines`` names the targets and their line columns, None where a target has none.  The preparation is
    computed once; the fits of all targets run side by side.  Rows without a target take no part in its fit.
    ``select_on='test'`` compares on the test rows; ``'validation'`` sets the last days before them aside for
    the choice.  The predictions are kept, so they outlive the preparation.
    """
    dataset.require_leak_free(features)
    options = {} if trees is None else {"trees": trees}
    with prepared(df, lines, features, test_days, select_on, validation_days, order) as p:
        members = {t: regressors(*p.sizes[t], **options) for t in lines}

        def fit(target: str, name: str):
            return members[target][name].fit(p.of(target, 0).select("label", "features"))

        at_once = side_by_side(df.sparkSession, max((n for n, _ in p.sizes.values()), default=0), at_once)
        # the fits that take longest begin first
        names = sorted({(n, t) for t, m in members.items() for n in m}, key=lambda x: (x[0] == "ridge", x))
        fitted = _together(df.sparkSession, {f"{t}/{n}": partial(fit, t, n) for n, t in names}, at_once)
        of = {t: {n: fitted[f"{t}/{n}"] for n in m} for t, m in members.items()}
        if ensemble:
            of = {t: {**m, "ensemble": PipelineModel(stages=[])} for t, m in of.items()}
        done = _together(df.sparkSession, {t: partial(_score_target, p, t, of[t], 2 if select_on == "test" else 1) for t in lines}, at_once)
        return {t: (b, settled(found)) for t, (b, found) in done.items()}


def train_regression(df: DataFrame, target: str, features: Sequence[str], line: str | None = None, **settings) -> tuple[Bundle, DataFrame]:
    """``train_targets`` for one target: its bundle and the predictions of its test rows."""
    rows = df.where(F.col(target).isNotNull())
    return train_targets(rows, {target: line}, features, **settings)[target]


def judge_bundles(bundles: Sequence[Bundle], spark: SparkSession, max_gap: float = 0.15) -> DataFrame:
    """Plausibility flags of trained models, one row per target."""
    rows = [(b.target, b.metrics["mae"], b.metrics["r2"], b.metrics.get("train_r2"), b.metrics.get("accuracy"))
            for b in bundles]
    scores = spark.createDataFrame(rows, "target string, mae double, r2 double, train_r2 double, accuracy double")
    return quality.metric_checks(scores, max_gap)


def train_classifier(df: DataFrame, prop: str, line: str | None = None, test_days: int = 21, trees: int = 300,
                     min_rows: int = 500, select_on: str = "test", validation_days: int = 21,
                     order: str = "game_date") -> tuple[Bundle, DataFrame] | None:
    """Fit five over/under classifiers on the older rows and keep the best calibrated one.

    ``df`` holds the feature table with the target ``prop`` and its line column.  Returns nothing when
    fewer than ``min_rows`` complete rows exist, else the bundle and the scored test rows.
    """
    use_checkpoint_folder(df.sparkSession)
    line = line or f"{prop}_line"
    base = df.where(F.col(prop).isNotNull() & F.col(line).isNotNull())
    below = _one_row(stats.exact_medians(base.select(F.coalesce(
        F.col(f"{overunder._stat(prop)}_std_l10"), F.lit(5.0)).alias("variance")), ["variance"]))["variance"]
    if below is None:
        return None
    names = overunder.OVER_UNDER_FEATURES
    built = overunder.over_under_features(base, prop, F.col(line), F.col(prop), consistent_below=below)
    rows = built.na.drop(subset=[*names, "went_over", "line"]).withColumn("label", F.col("went_over").cast("double"))
    ids = [c for c in ("player", order, "seq") if c in rows.columns]
    rows = rows.select(*ids, "actual", "line", "went_over", "label", *names)
    with kept(dataset.temporal_split(rows, test_days, order)) as marked:
        n = marked.count()
        if n < min_rows:
            return None
        past, test = marked.where("is_test = 0").drop("is_test"), marked.where("is_test = 1").drop("is_test")
        if select_on == "validation":
            inner = dataset.temporal_split(past, validation_days, order)
            train, judge = inner.where("is_test = 0"), inner.where("is_test = 1")
        else:
            train, judge = past, test
        dataset.require_leak_free(names)
        scaling = Scaling.fit(train, names)
        size = train.count()
        models = _fit_all(train, scaling, classifiers(size, trees))

        def judged(model: PipelineModel, part: DataFrame) -> dict:
            scored = model.transform(part).select("label", vector_to_array("probability")[1].alias("prob"))
            return _one_row(scored.agg(*aliased(metrics.classifier_metrics())))

        marks = {name: judged(m, judge) for name, m in models.items()}
        best = min(marks, key=lambda k: marks[k]["brier"] if marks[k]["brier"] is not None else 1.0)
        on_test = marks[best] if select_on == "test" else judged(models[best], test)
        bundle = Bundle(models[best], list(names), prop, best,
                        {**on_test, **{f"{k}_brier": m["brier"] for k, m in marks.items()}, "train_rows": size},
                        {"consistent_below": below})
        scored = bundle.probability(test, "prob").select(*ids, "actual", "line", "went_over", "prob", F.lit(prop).alias("prop"))
        chosen = decisions.profitable_threshold(decisions.confidence_buckets(scored))
        bundle.settings["threshold"] = _one_row(chosen)["threshold"]
        scored = settled(scored)
    return bundle, scored


def classifier_rows(df: DataFrame, props: Sequence[str], order: str = "game_date") -> DataFrame:
    """Only the columns that classifiers of ``props`` are trained on and scored by, so that no other one is made or kept."""
    wanted = {"player", order, "seq", "games_played", *overunder.inputs(props), *props, *[f"{p}_line" for p in props]}
    return df.select(*[c for c in df.columns if c in wanted])


def train_props(df: DataFrame, props: Sequence[str], at_once: int = FITS_AT_ONCE, **settings) -> dict[str, tuple[Bundle, DataFrame]]:
    """``train_classifier`` for several props side by side; props with too few rows are left out.

    ``df`` should be kept: every prop reads it.
    """
    at_once = side_by_side(df.sparkSession, df.count(), at_once)
    done = _together(df.sparkSession, {p: partial(train_classifier, df, p, **settings) for p in props}, at_once)
    return {p: found for p, found in done.items() if found is not None}


def importances(bundle: Bundle, spark: SparkSession, top: int = 5) -> DataFrame:
    """Largest feature weights of a fitted model; linear weights keep their sign."""
    fitted = bundle.model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        weights = fitted.featureImportances.toArray()
    elif hasattr(fitted, "coefficients"):
        weights = fitted.coefficients.toArray()
    else:
        return spark.createDataFrame([], "feature string, weight double")
    rows = [(f, float(w)) for f, w in zip(bundle.features, weights)]
    return (spark.createDataFrame(rows, "feature string, weight double")
            .orderBy(F.abs("weight").desc(), "feature").limit(top))


def _present(df: DataFrame, features: Sequence[str]) -> None:
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"features are missing: {missing}")


def minutes_folds(df: DataFrame, target: str, features: Sequence[str], k: int = 5, least: int = 5, trees: int = 200,
                  order: str = "game_date", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Time-ordered validation of the minutes model: one row per fold with sizes and errors."""
    _present(df, features)
    usable = dataset.enough_history(df.where(F.col(target).isNotNull()), least)
    usable = usable.withColumn("label", F.col(target).cast("double")).select(*dict.fromkeys([order, *seq, "label", *features]))
    spark = df.sparkSession
    with kept(dataset.expanding_folds(usable, order, seq, k)) as numbered:
        def validated(fold: int) -> tuple:
            train, held = numbered.where(F.col("fold") < fold), numbered.where(F.col("fold") == fold)
            model = _fit_all(train, Scaling.fit(train, features), {"gbm": minutes_model(trees)})["gbm"]
            scored = model.transform(held).select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
            m = _one_row(scored.agg(F.count(F.lit(1)).alias("n"), *aliased(metrics.regression_metrics())))
            return fold + 1, m["mae"], m["r2"], train.count(), m["n"]

        at_once = side_by_side(spark, numbered.count())
        done = _together(spark, {f"fold {i}": partial(validated, i) for i in range(k)}, at_once)
    return spark.createDataFrame(list(done.values()), "fold int, mae double, r2 double, train_size long, val_size long")


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean error, its population deviation and mean R² over folds."""
    return folds.agg(F.avg("mae").alias("avg_mae"), F.stddev_pop("mae").alias("std_mae"), F.avg("r2").alias("avg_r2"))


def minutes_model(trees: int = 200) -> GBTRegressor:
    return GBTRegressor(labelCol="label", maxIter=trees, maxDepth=4, stepSize=0.1, minInstancesPerNode=20, seed=SEED)


def train_minutes(df: DataFrame, target: str = "mp", features: Sequence[str] = MINUTES_FEATURES, test_days: int = 14,
                  least: int = 5, trees: int = 200, order: str = "game_date") -> Bundle:
    """Fit the minutes model on the older rows only and compare it with the ten-game mean.

    ``target`` is ``mp`` for the current event or a ``lead`` column for the next one.
    """
    use_checkpoint_folder(df.sparkSession)
    _present(df, features)
    usable = dataset.enough_history(df.where(F.col(target).isNotNull()), least)
    usable = usable.withColumn("label", F.col(target).cast("double"))
    usable = usable.select(*dict.fromkeys([order, "label", *features, *[c for c in ("mp_l10",) if c in df.columns]]))
    with kept(dataset.temporal_split(usable, test_days, order)) as marked:
        train, test = marked.where("is_test = 0").drop("is_test"), marked.where("is_test = 1").drop("is_test")
        model = _fit_all(train, Scaling.fit(train, features), {"gbm": minutes_model(trees)})["gbm"]
        figures: dict[str, float] = {}
        for name, part in (("", test), ("train_", train)):
            scored = model.transform(part).select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
            figures.update({f"{name}{k}": v for k, v in _one_row(scored.agg(*aliased(metrics.regression_metrics()))).items()})
        if "mp_l10" in test.columns:
            base = stats.fill_medians(test.select("label", "mp_l10"), ["mp_l10"])
            figures["baseline_mae"] = _one_row(base.agg(F.avg(F.abs(F.col("label") - F.col("mp_l10"))).alias("m")))["m"]
    return Bundle(model, list(features), target, "gbm", figures)


def predicted_minutes(df: DataFrame, bundle: Bundle, name: str = "predicted_minutes") -> DataFrame:
    """Add the predicted minutes, limited to 0..48."""
    return bundle.score(df, name, floor=0.0).withColumn(name, F.least(F.col(name), F.lit(48.0)))
