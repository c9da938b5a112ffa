"""What models are fed with: scaling, complete rows, fold summaries, filled shares, checks of minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gameline.catalog.base import GAMES, OBS, r
from gameline.catalog.cleaning import _log
from gameline.functions import metrics
from gameline.operators import dataset, quality, rolling
from gameline.plans import training
from gameline.plans.views import games, observations, tidy
from gameline.sources import feeds

_FORM = ["value_l5", "value_l10", "value_l20"]


def _rolled(spark, sf):
    spec = rolling.RollingSpec(stats=["value"], means={5: 1, 10: 1, 20: 1})
    return rolling.rolling_features(observations(spark, sf), spec)


_ROLLED = OBS + """,
rl AS (SELECT *, avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS value_l5,
  avg(value) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS value_l10,
  avg(value) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS value_l20
  FROM obs WINDOW w AS (PARTITION BY player ORDER BY game_date, seq)),
cut AS (SELECT max(game_date) - 21 AS d FROM rl)"""


def standardise(spark, sf):
    """Recent form filled with the medians of the training rows, and scaled by their mean and deviation."""
    df = _rolled(spark, sf)
    train = dataset.temporal_split(df).where("is_test = 0")
    with training.kept(train.select(*_FORM)) as form:
        scaled, _ = training.Scaling.fit(form, _FORM).stages()
    return tidy(scaled.transform(df).select("seq", *[F.col(f"z_{c}").alias(f"z_{c}") for c in _FORM]))


STANDARDISE = f"""WITH {_ROLLED},
med AS (SELECT {', '.join(f'median({c}) AS {c}' for c in _FORM)} FROM rl, cut WHERE game_date < d),
filled AS (SELECT seq, game_date, {', '.join(f'coalesce(rl.{c}, med.{c}) AS {c}' for c in _FORM)} FROM rl, med),
fit AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _FORM)} FROM filled, cut WHERE game_date < d)
SELECT seq, {', '.join(r(f'({c} - m_{c}) / s_{c}', f'z_{c}') for c in _FORM)} FROM filled, fit"""


def complete_rows(spark, sf):
    """Rows that have every feature and the target: what classifiers are trained on."""
    return tidy(_rolled(spark, sf).na.drop(subset=[*_FORM, "res"]).select("seq", *_FORM, "res"))


COMPLETE_ROWS = f"""WITH {_ROLLED} SELECT seq, {', '.join(r(c) for c in _FORM)}, res FROM rl
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_FORM, 'res'])}"""


def fold_errors(spark, sf):
    """Mean error, its deviation and mean R² of the ten-game mean over five folds in time order."""
    folds = dataset.expanding_folds(_rolled(spark, sf).where(F.col("value_l10").isNotNull()), "game_date", ["seq"], 5)
    each = (folds.where(F.col("fold") >= 0).groupBy("fold").agg(
        *[c.alias(n) for n, c in metrics.regression_metrics("value", "value_l10").items()]))
    return tidy(training.fold_summary(each))


FOLD_ERRORS = f"""WITH {_ROLLED},
n AS (SELECT *, row_number() OVER (ORDER BY game_date, seq) - 1 AS pos, count(*) OVER () AS n_rows FROM rl WHERE value_l10 IS NOT NULL),
f AS (SELECT *, (pos - (n_rows - 5 * (n_rows // 6))) // (n_rows // 6) AS fold FROM n WHERE pos >= n_rows - 5 * (n_rows // 6)),
m AS (SELECT fold, avg(abs(value - value_l10)) AS mae,
  1 - sum((value - value_l10) ** 2) / (var_pop(value) * count(*)) AS r2 FROM f GROUP BY fold)
SELECT {r('avg(mae)', 'avg_mae')}, {r('stddev_pop(mae)', 'std_mae')}, {r('avg(r2)', 'avg_r2')} FROM m"""


def feed_shares(spark, sf):
    """Shares of a landed log: text that is no number counts as zero; the home flag stays an empty number."""
    log = _log(spark, sf).withColumn("FG_PCT", F.when(F.col("FTA") != "0.0", F.col("FG_PCT")).otherwise(""))
    return tidy(feeds.clean_log(log).select("player", "game_date", "mp", "pts", "fg_pct", "3p_pct", "ft_pct", "is_home"))


FEED_SHARES = f"""WITH {GAMES} SELECT 'Player ' || player AS player, CAST(game_date AS VARCHAR) AS game_date, {r('floor(mp) + 0.5', 'mp')},
  {r('pts')}, {r('CASE WHEN fta <> 0 THEN fg_pct ELSE 0 END', 'fg_pct')}, {r('"3p_pct"', '"3p_pct"')}, {r('ft_pct')},
  CAST(NULL AS DOUBLE) AS is_home
FROM games JOIN nation ON opp = n_nationkey"""


def minutes_copies(spark, sf):
    """Checks that the five-game mean, taken as predicted minutes, is neither the actual minutes nor the ten-game mean."""
    spec = rolling.RollingSpec(stats=["mp"], means={5: 1, 10: 1})
    rolled = rolling.rolling_features(games(spark, sf), spec)
    return tidy(quality.minutes_checks(rolled.withColumn("predicted_minutes", F.col("mp_l5"))))


MINUTES_COPIES = f"""WITH {GAMES},
m AS (SELECT mp, avg(mp) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p,
  avg(mp) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l10
  FROM games WINDOW w AS (PARTITION BY player ORDER BY game_date, seq)),
c AS (SELECT corr(mp, p) AS a, corr(p, coalesce(l10, 0)) FILTER (p IS NOT NULL) AS b FROM m)
SELECT 'corr_actual' AS "check", {r('a', 'value')}, CAST(a <= 0.95 AS BIGINT) AS passed FROM c
UNION ALL SELECT 'corr_recent', {r('b', 'value')}, CAST(b <= 0.99 AS BIGINT) FROM c"""

QUERIES = {
    "standardise": (standardise, STANDARDISE),
    "complete_rows": (complete_rows, COMPLETE_ROWS),
    "fold_errors": (fold_errors, FOLD_ERRORS),
    "feed_shares": (feed_shares, FEED_SHARES),
    "minutes_copies": (minutes_copies, MINUTES_COPIES),
}
