"""Bets: backtests, breakdowns, sweeps, picks, tracking and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from gameline.catalog.base import BETS, GAMES, PREDICTIONS, graded, metrics, payout, r
from gameline.functions import metrics as M
from gameline.functions import odds
from gameline.functions.metrics import aliased
from gameline.operators import decisions, quality, latest, lines, rolling
from gameline.plans.views import bets, game_players, games, observations, predictions, tidy


def backtest_bets(spark, sf):
    return tidy(bets(spark, sf, 1.5).select("player", "seq", "direction", "edge", "won", "profit"))


BACKTEST_BETS = f"""WITH {BETS} SELECT player, seq, direction, {r('edge')}, CAST(won AS BIGINT) AS won, {r('profit')}
  FROM bets WHERE edge >= 1.5"""


def backtest_overall(spark, sf):
    return tidy(decisions.overall(bets(spark, sf)))


BACKTEST_OVERALL = f"WITH {BETS} {metrics('bets')}"


def by_prop(spark, sf):
    return tidy(decisions.breakdown(bets(spark, sf), "prop"))


BY_PROP = f"WITH {BETS} {metrics('bets', 'prop')}"


def by_direction(spark, sf):
    return tidy(decisions.breakdown(bets(spark, sf, 1.5), "direction"))


BY_DIRECTION = f"WITH {BETS} {metrics('(SELECT * FROM bets WHERE edge >= 1.5)', 'direction')}"

_EDGE_CASE = "CASE " + " ".join(
    f"WHEN edge > {lo} AND edge <= {hi} THEN '{name}'" for lo, hi, name in
    zip(odds.EDGE_EDGES, odds.EDGE_EDGES[1:], odds.EDGE_LABELS)) + " END"


def by_edge_bucket(spark, sf):
    return tidy(decisions.by_edge_bucket(bets(spark, sf)))


EDGES = f"eb AS (SELECT *, {_EDGE_CASE} AS edge_bucket FROM bets)"
BY_EDGE_BUCKET = f"WITH {BETS}, {EDGES} {metrics('(SELECT * FROM eb WHERE edge_bucket IS NOT NULL)', 'edge_bucket')}"


def daily_cumulative(spark, sf):
    return tidy(decisions.daily(bets(spark, sf)))


DAILY_CUMULATIVE = f"""WITH {BETS}, d AS (SELECT game_date, sum(profit) AS p, sum(won) AS w, count(*) AS n
  FROM bets GROUP BY game_date)
SELECT CAST(game_date AS VARCHAR) AS game_date, {r('p', 'daily_profit')}, CAST(w AS BIGINT) AS daily_wins,
  n AS daily_bets, {r('w::DOUBLE / n', 'daily_win_rate')},
  {r('sum(p) OVER (ORDER BY game_date ROWS UNBOUNDED PRECEDING)', 'cumulative_profit')} FROM d"""


def running_bets(spark, sf):
    out = decisions.running(bets(spark, sf))
    return tidy(out.select("seq", "cumulative_bets", "cumulative_profit", "cumulative_roi"))


RUNNING_BETS = f"""WITH {BETS}, x AS (SELECT seq, row_number() OVER (ORDER BY game_date, seq) AS n,
  sum(profit) OVER (ORDER BY game_date, seq ROWS UNBOUNDED PRECEDING) AS p FROM bets)
SELECT seq, n AS cumulative_bets, {r('p', 'cumulative_profit')}, {r('p / n * 100', 'cumulative_roi')} FROM x"""


def by_tier(spark, sf):
    minutes = rolling.rolling_features(
        games(spark, sf).select("player", "game_date", "seq", "mp"),
        rolling.RollingSpec(stats=["mp"], means={10: 1}, counter=None), bound=game_players(spark, sf))
    return tidy(decisions.by_tier(bets(spark, sf), minutes))


_TIER_CASE = "CASE " + " ".join(
    f"WHEN m > {lo} AND m <= {hi} THEN '{name}'" for lo, hi, name in
    zip(odds.TIER_EDGES, odds.TIER_EDGES[1:], odds.TIER_LABELS)) + " END"
BY_TIER = f"""WITH {BETS}, {GAMES}, ml AS (SELECT player, avg(mp) OVER (PARTITION BY player ORDER BY game_date, seq
    ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mp_l10 FROM games),
am AS (SELECT player, avg(mp_l10) AS m FROM ml GROUP BY player),
t AS (SELECT bets.*, {_TIER_CASE} AS player_tier FROM bets LEFT JOIN am USING (player))
{metrics('(SELECT * FROM t WHERE player_tier IS NOT NULL)', 'player_tier')}"""


def threshold_sweep(spark, sf):
    return tidy(decisions.threshold_sweep(bets(spark, sf)))


SWEEP = """sweep AS (SELECT threshold, count(*) AS bets, sum(won) * 100.0::DOUBLE / count(*) AS win_rate,
  sum(profit) / count(*) * 100 AS roi, sum(profit) AS profit
  FROM bets JOIN (SELECT i * 0.25::DOUBLE AS threshold FROM range(21) t(i)) ON edge >= threshold
  GROUP BY threshold HAVING count(*) >= 50)"""
THRESHOLD_SWEEP = f"""WITH {BETS}, {SWEEP} SELECT {r('threshold')}, bets, {r('win_rate')}, {r('roi')}, {r('profit')}
  FROM sweep"""


def best_threshold(spark, sf):
    return tidy(decisions.best_threshold(decisions.threshold_sweep(bets(spark, sf))))


BEST_THRESHOLD = f"WITH {BETS}, {SWEEP} SELECT {r('threshold')}, {r('roi')} FROM sweep ORDER BY sweep.roi DESC, sweep.threshold LIMIT 1"


def best_props(spark, sf):
    return tidy(decisions.best_props(bets(spark, sf)))


BEST_PROPS = f"SELECT * FROM ({BY_PROP}) WHERE total_bets >= 100 AND roi > 0"


def rule_flags(spark, sf):
    return tidy(decisions.rule_flags(bets(spark, sf)))


RULE_FLAGS = f"""WITH {BETS}, {EDGES}, {SWEEP}, p AS ({metrics('bets', 'prop')}), o AS ({metrics('bets')}),
e AS ({metrics("(SELECT * FROM eb WHERE edge_bucket IN ('2-2.5', '2.5-3', '3-5', '5+'))", 'edge_bucket')}),
b AS (SELECT threshold FROM sweep ORDER BY roi DESC, threshold LIMIT 1)
SELECT 'model' AS rule, 'all' AS subject, CASE WHEN profitable = 1 THEN 'keep' ELSE 'filter' END AS advice, roi AS figure FROM o
UNION ALL SELECT 'prop', prop, CASE WHEN roi > 0 THEN 'focus' ELSE 'avoid' END, roi FROM p WHERE roi > 0 OR roi < -5
UNION ALL SELECT 'edge', 'minimum', 'use', threshold FROM b WHERE threshold > 0
UNION ALL SELECT 'edge', 'high', 'use', f FROM (SELECT round(avg(roi), 6) + 0.0 AS f FROM e) WHERE f > 5"""


def _probabilities(spark, sf):
    """A probability per prediction from the gap between prediction and line."""
    p = predictions(spark, sf)
    return p.withColumn("prob", F.round(1 / (1 + F.exp(-(F.col("predicted") - F.col("line")) / 8)), 6)).withColumn(
        "went_over", (F.col("actual") > F.col("line")).cast("int"))


PROBS = PREDICTIONS + """,
probs AS (SELECT *, round(1 / (1 + exp(-(predicted - line) / 8)), 6) AS prob, CAST(actual > line AS INTEGER) AS went_over
  FROM preds)"""


def confidence_buckets(spark, sf):
    return tidy(decisions.confidence_buckets(_probabilities(spark, sf)))


_TAILS = "CASE " + " ".join(
    f"WHEN (prob >= {lo} AND prob < {hi}) OR (prob <= 1 - {lo}::DOUBLE AND prob > 1 - {hi}::DOUBLE) THEN {lo}"
    for lo, hi, _ in decisions.CONFIDENCE_BUCKETS) + " END"
_NAMES = "CASE low " + " ".join(f"WHEN {lo} THEN '{n}'" for lo, _, n in decisions.CONFIDENCE_BUCKETS) + " END"
BUCKETS = f"""cb AS (SELECT {_TAILS} AS low, count(*) AS n, sum(((prob > 0.5)::INT = went_over)::INT) AS w FROM probs
  GROUP BY 1 HAVING low IS NOT NULL AND count(*) >= 10)"""
CONFIDENCE_BUCKETS = f"""WITH {PROBS}, {BUCKETS} SELECT {r('low')}, {_NAMES} AS bucket, n, {r('w::DOUBLE / n', 'accuracy')},
  {r('(w * 1.0::DOUBLE - (n - w) * 1.1::DOUBLE) / n * 100', 'roi')} FROM cb"""


def confidence_threshold(spark, sf):
    return tidy(decisions.profitable_threshold(decisions.confidence_buckets(_probabilities(spark, sf))))


CONFIDENCE_THRESHOLD = f"""WITH {PROBS}, {BUCKETS}
SELECT {r('coalesce(min(low) FILTER (w::DOUBLE / n > 0.5238), 0.55)', 'threshold')} FROM cb"""


def confidence_picks(spark, sf):
    p = _probabilities(spark, sf).withColumnRenamed("prob", "prob_over")
    return tidy(decisions.gate_picks(p, minimum=0.60).select("player", "seq", "direction", "confidence", "tier"))


CONFIDENCE_PICKS = f"""WITH {PROBS}, x AS (SELECT player, seq, CASE WHEN prob >= 0.6 THEN 'OVER' WHEN prob <= 0.4 THEN 'UNDER' END
  AS direction, CASE WHEN prob >= 0.6 THEN prob WHEN prob <= 0.4 THEN 1 - prob END AS c FROM probs)
SELECT player, seq, direction, {r('c', 'confidence')}, CASE WHEN c >= 0.65 THEN 'HIGH' WHEN c >= 0.6 THEN 'MEDIUM' END AS tier
FROM x WHERE direction IS NOT NULL"""


def expected_roi(spark, sf):
    picks = decisions.gate_picks(_probabilities(spark, sf), "prob", 0.60)
    return tidy(picks.agg(F.avg("confidence").alias("avg_confidence"), M.expected_roi().alias("expected_roi")))


EXPECTED_ROI = f"""WITH x AS ({CONFIDENCE_PICKS}), c AS (SELECT avg(confidence) AS c FROM x)
SELECT {r('c', 'avg_confidence')}, {r('CASE WHEN c > 0.5238 THEN (c - (1 - c) * 1.1) * 100 END', 'expected_roi')} FROM c"""


def brier(spark, sf):
    p = _probabilities(spark, sf)
    return tidy(p.agg(*aliased(M.classifier_metrics("went_over", "prob"))))


BRIER = f"""WITH {PROBS} SELECT {r('avg(((prob > 0.5)::INT = went_over)::INT::DOUBLE)', 'accuracy')},
  {r('avg((prob - went_over) ** 2)', 'brier')} FROM probs"""


def regression_metrics(spark, sf):
    return tidy(predictions(spark, sf).groupBy("prop").agg(*aliased(M.regression_metrics())))


_REGRESSION = """avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
  1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS r2"""
REGRESSION_METRICS = f"""WITH {PREDICTIONS}, x AS (SELECT prop, {_REGRESSION} FROM preds GROUP BY prop)
SELECT prop, {r('mae')}, {r('rmse')}, {r('r2')} FROM x"""


def sim_accuracy(spark, sf):
    return tidy(predictions(spark, sf).groupBy("prop").agg(*aliased(M.simulated_decisions())))


_SIM = """count(*) AS n, sum(((predicted > line) = (actual > line))::INT) AS w"""
SIM_ACCURACY = f"""WITH {PREDICTIONS}, x AS (SELECT prop, {_SIM} FROM preds GROUP BY prop)
SELECT prop, n AS n_bets, CAST(w AS BIGINT) AS wins, CAST(n - w AS BIGINT) AS losses, {r('w::DOUBLE / n', 'accuracy')},
  {r('w::DOUBLE / n - 0.5', 'edge')}, {r('w - (n - w) * 1.1::DOUBLE', 'profit_units')},
  {r('(w - (n - w) * 1.1::DOUBLE) / n * 100', 'roi_pct')} FROM x"""


def metric_limits(spark, sf):
    """Scores per prop against plausibility limits; each prop stands for a target of its own."""
    p = predictions(spark, sf).withColumn("target", lines.code_of(F.col("prop"), {
        "1-URGENT": "pts", "2-HIGH": "trb", "3-MEDIUM": "ast", "4-NOT SPECIFIED": "pra"}, F.col("prop")))
    scores = p.groupBy("target").agg(*aliased({**M.regression_metrics(), **{
        "accuracy": M.simulated_decisions()["accuracy"]}})).drop("rmse").withColumn("train_r2", F.lit(0.2))
    return tidy(quality.metric_checks(scores))


METRIC_LIMITS = f"""WITH {PREDICTIONS}, t AS (SELECT *, CASE prop WHEN '1-URGENT' THEN 'pts' WHEN '2-HIGH' THEN 'trb'
    WHEN '3-MEDIUM' THEN 'ast' WHEN '4-NOT SPECIFIED' THEN 'pra' ELSE prop END AS target FROM preds),
x AS (SELECT target, {_REGRESSION}, sum(((predicted > line) = (actual > line))::INT)::DOUBLE / count(*) AS accuracy
  FROM t GROUP BY target),
l AS (SELECT *, CASE target WHEN 'pts' THEN 0.70 WHEN 'trb' THEN 0.65 WHEN 'ast' THEN 0.65 WHEN 'pra' THEN 0.75 ELSE 0.8 END AS top,
  CASE target WHEN 'pts' THEN 3.5 WHEN 'trb' THEN 1.5 WHEN 'ast' THEN 1.0 WHEN 'pra' THEN 5.0 ELSE 0.3 END AS low FROM x)
SELECT target, {r('mae')}, {r('r2')}, {r('accuracy')}, 0.2::DOUBLE AS train_r2, CAST(r2 > top AS BIGINT) AS r2_too_high,
  CAST(mae < low AS BIGINT) AS mae_too_low, CAST(0.2 - r2 > 0.15 AS BIGINT) AS overfit,
  CAST(accuracy > 0.62 AS BIGINT) AS accuracy_high, CAST(accuracy > 0.65 AS BIGINT) AS accuracy_impossible,
  CASE WHEN accuracy > 0.60 THEN 'suspicious' WHEN accuracy > 0.5238 THEN 'profitable' ELSE 'losing' END AS band FROM l"""



PRICED = PREDICTIONS + """,
priced AS (SELECT *, CASE WHEN prop = '1-URGENT' THEN 120 ELSE -110 END AS over_odds,
  CASE WHEN prop = '5-LOW' THEN -185 ELSE -105 END AS under_odds FROM preds),
rated AS (SELECT player, seq, game_date, prop, actual, predicted, line, CASE WHEN abs(predicted - line) < 0.5 THEN NULL
    WHEN predicted > line THEN 'OVER' ELSE 'UNDER' END AS direction,
  CASE WHEN abs(predicted - line) < 0.5 THEN NULL WHEN predicted > line THEN over_odds ELSE under_odds END AS odds,
  abs(predicted - line) AS edge,
  CASE WHEN abs(predicted - line) >= 3 THEN 3 WHEN abs(predicted - line) >= 2 THEN 2
    WHEN abs(predicted - line) >= 1.5 THEN 1 ELSE 0 END AS strength FROM priced)"""
_LABEL = """CASE WHEN edge < 0.5 THEN 'NO EDGE' WHEN strength = 3 THEN 'STRONG' WHEN strength = 2 THEN 'MODERATE'
  WHEN strength = 1 THEN 'SLIGHT' ELSE 'NO BET' END"""


def _rated(spark, sf, strength=1):
    p = predictions(spark, sf).withColumns({
        "over_odds": F.when(F.col("prop") == "1-URGENT", 120).otherwise(-110),
        "under_odds": F.when(F.col("prop") == "5-LOW", -185).otherwise(-105)})
    return decisions.rate_edges(p, strength)


def edge_rating(spark, sf):
    return tidy(_rated(spark, sf, None).select("player", "seq", "direction", "odds", "edge", "strength", "label"), "odds")


EDGE_RATING = f"""WITH {PRICED} SELECT player, seq, direction, {r('odds')}, {r('edge')},
  CAST(strength AS BIGINT) AS strength, {_LABEL} AS label FROM rated"""


def direction_split(spark, sf):
    return tidy(decisions.direction_split(_rated(spark, sf)))


DIRECTION_SPLIT = f"""WITH {PRICED} SELECT direction, count(*) AS n, count(*) FILTER (strength = 3) AS strong,
  count(*) FILTER (strength = 2) AS moderate, count(*) FILTER (strength = 1) AS slight,
  {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()', 'share_pct')} FROM rated WHERE strength >= 1 GROUP BY direction"""


def topk_per_group(spark, sf):
    k = latest.top_per_group(_rated(spark, sf), ["prop", "strength"], [F.desc("edge"), F.col("seq")], 10)
    return tidy(k.select("prop", "strength", "rank", "player", "seq", "edge"))


TOPK_PER_GROUP = f"""WITH {PRICED} SELECT prop, CAST(strength AS BIGINT) AS strength,
  row_number() OVER (PARTITION BY prop, strength ORDER BY edge DESC, seq) AS rank, player, seq, {r('edge')}
FROM rated WHERE strength >= 1 QUALIFY rank <= 10"""


def topk(spark, sf):
    return tidy(_rated(spark, sf).orderBy(F.desc("edge"), "seq").limit(10).select("player", "seq", "edge", "direction"))


TOPK = f"""WITH {PRICED} SELECT player, seq, {r('edge')}, direction FROM rated WHERE strength >= 1
  ORDER BY rated.edge DESC, seq LIMIT 10"""


def tracking_sheet(spark, sf):
    t = decisions.tracking_sheet(_rated(spark, sf), F.lit("2001-08-03").cast("date"))
    return tidy(t.select("date", "player", "prop", "direction", "line", "pred", "edge", "odds", "strength", "label",
                         "units_bet"), "odds")


TRACKING_SHEET = f"""WITH {PRICED} SELECT '2001-08-03' AS date, player, prop, direction, {r('line')}, {r('predicted', 'pred')},
  {r('edge')}, {r('odds')}, CAST(strength AS BIGINT) AS strength, {_LABEL} AS label, 1.0::DOUBLE AS units_bet
FROM rated WHERE strength >= 1"""


def _tracking(spark, sf):
    """Locked bets on every prediction with enough edge, dated by their event."""
    p = _rated(spark, sf, None).select(
        "player", "game_date", "seq", F.col("prop").alias("prop_display"), F.col("direction").alias("real_direction"),
        (F.col("predicted") - F.col("line")).alias("real_edge"), F.col("line").alias("vegas_line"),
        F.col("predicted").alias("prediction"), F.col("odds").alias("bet_odds"))
    return decisions.lock_bets(p.withColumn("prop_display", F.concat_ws("#", "prop_display", "seq")),
                               F.to_timestamp("game_date"))


def lock_bets(spark, sf):
    t = _tracking(spark, sf)
    return tidy(t.select("date", "player", "prop", "bet_direction", "vegas_line", "prediction", "edge", "edge_abs",
                         "confidence", "odds"), "odds")


_LOCK = """SELECT game_date AS date, player, prop || '#' || seq AS prop, seq, direction AS bet_direction, line AS vegas_line,
  predicted AS prediction, round_even(predicted - line, 1) AS edge, round_even(edge, 1) AS edge_abs,
  CASE WHEN edge >= 5 THEN 'HIGH' ELSE 'MED' END AS confidence, odds FROM rated WHERE edge >= 3"""
LOCK_BETS = f"""WITH {PRICED}, t AS ({_LOCK}) SELECT CAST(date AS VARCHAR) AS date, player, prop, bet_direction,
  {r('vegas_line')}, {r('prediction')}, {r('edge')}, {r('edge_abs')}, confidence, {r('odds')} FROM t"""


def _graded(spark, sf):
    actuals = observations(spark, sf).where(F.col("res") != "P").select(
        F.col("game_date").alias("date"), "player", F.concat_ws("#", "prop", "seq").alias("prop"),
        F.col("value").alias("actual"))
    return decisions.grade(_tracking(spark, sf), actuals)


def grade_join(spark, sf):
    return tidy(_graded(spark, sf).select("date", "player", "prop", "bet_direction", "vegas_line", "actual", "result", "profit"))


GRADED = PRICED + f""",
t AS ({_LOCK}),
gr AS (SELECT t.*, o.value AS actual, {graded('bet_direction', 'o.value', 'vegas_line')} AS result
  FROM t LEFT JOIN obs o ON o.seq = t.seq AND o.player = t.player AND o.game_date = t.date AND o.res <> 'P'),
gp AS (SELECT *, {payout('odds', 'result')} AS profit FROM gr)"""
GRADE_JOIN = f"""WITH {GRADED} SELECT CAST(date AS VARCHAR) AS date, player, prop, bet_direction, {r('vegas_line')},
  {r('actual')}, result, {r('profit')} FROM gp"""


def graded_summary(spark, sf):
    t = _graded(spark, sf).withColumn("prop", F.split("prop", "#")[0])
    return tidy(decisions.graded_summary(t))


def _record(level: str, name: str, group: str) -> str:
    return f"""SELECT '{level}' AS level, {name} AS name, count(*) AS graded, count(*) FILTER (result = 'WIN') AS wins,
  count(*) FILTER (result = 'LOSS') AS losses, count(*) FILTER (result = 'PUSH') AS pushes,
  {r("count(*) FILTER (result = 'WIN') * 100.0::DOUBLE / nullif(count(*) FILTER (result IN ('WIN', 'LOSS')), 0)", 'win_pct')},
  {r('sum(profit)', 'profit')}, {r('sum(profit) / count(*)', 'profit_per_bet')}
FROM gp WHERE result IS NOT NULL {group}"""


GRADED_SUMMARY = f"""WITH {GRADED} {_record('overall', "'all'", '')}
UNION ALL {_record('confidence', 'confidence', 'GROUP BY confidence')}
UNION ALL {_record('prop', "split_part(prop, '#', 1)", "GROUP BY split_part(prop, '#', 1)")}"""


def _scores(spark, sf):
    """Wide scores per entity: the five-game mean as prediction, the ten-game mean as line."""
    spec = rolling.RollingSpec(stats=["pts", "trb", "ast"], means={5: 1, 10: 1})
    g = rolling.rolling_features(games(spark, sf).select("player", "game_date", "seq", "tm", "opp", "pts", "trb", "ast"), spec, bound=game_players(spark, sf))
    last = latest.latest_row(g, ["player"], ["game_date", "seq"])
    props = ["pts", "trb", "ast", "pra", "pr", "pa"]

    def total(prop, n):
        parts = {"pra": ("pts", "trb", "ast"), "pr": ("pts", "trb"), "pa": ("pts", "ast")}.get(prop, (prop,))
        out = F.lit(0.0)
        for s in parts:
            out = out + F.col(f"{s}_l{n}")
        return out

    wide = decisions.wide_scores(
        last.select("player", F.col("tm").alias("team"), F.col("opp").alias("opponent"), *[
            c for c in last.columns if c.endswith(("_l5", "_l10"))]),
        {p: total(p, 5) for p in props}, {p: total(p, 10) for p in props})
    return wide, props


def opportunities(spark, sf):
    wide, props = _scores(spark, sf)
    found = decisions.opportunities(decisions.long_scores(wide, ["player", "team", "opponent"], props))
    return tidy(found.withColumn("prop_name", lines.code_of(F.col("prop"), lines.PROP_NAMES, F.col("prop"))))


_PROP_SQL = {"pts": ("pts",), "trb": ("trb",), "ast": ("ast",), "pra": ("pts", "trb", "ast"), "pr": ("pts", "trb"), "pa": ("pts", "ast")}
_FR = "(PARTITION BY player ORDER BY game_date, seq ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
SCORES = GAMES + ", rl AS (SELECT player, game_date, seq, tm, opp, " + ", ".join(
    f"avg({s}) OVER {_FR.format(n)} AS {s}_l{n}" for s in ("pts", "trb", "ast") for n in (5, 10)) + """ FROM games),
lr AS (SELECT * FROM rl QUALIFY row_number() OVER (PARTITION BY player ORDER BY game_date DESC, seq DESC) = 1),
sc AS (""" + " UNION ALL ".join(
    f"""SELECT player, tm AS team, opp AS opponent, '{p}' AS prop, '{lines.PROP_NAMES[p]}' AS prop_name,
  {" + ".join(f"{s}_l5" for s in parts)} AS p, round_even({" + ".join(f"{s}_l10" for s in parts)}, 1) AS line FROM lr"""
    for p, parts in _PROP_SQL.items()) + """),
op AS (SELECT *, abs(round_even(p - line, 1)) AS edge, CASE WHEN p > line THEN 'OVER' ELSE 'UNDER' END AS direction FROM sc)"""
_KEEP = "edge >= 1.5 AND (direction <> 'OVER' OR edge >= 3)"
OPPORTUNITIES = f"""WITH {SCORES} SELECT player, team, opponent, prop, prop_name, {r('round_even(p, 1)', 'prediction')}, {r('line')},
  {r('edge')}, direction, CASE WHEN edge >= 3 THEN 'STRONG' ELSE 'MODERATE' END AS strength FROM op WHERE {_KEEP}"""


def run_summary(spark, sf):
    wide, props = _scores(spark, sf)
    found = decisions.opportunities(decisions.long_scores(wide, ["player", "team", "opponent"], props))
    return tidy(decisions.run_summary(wide, found, F.lit("2001-08-03")))


RUN_SUMMARY = f"""WITH {SCORES} SELECT '2001-08-03' AS date, (SELECT count(*) FROM lr) AS total_players,
  count(*) FILTER ({_KEEP}) AS total_opportunities, count(*) FILTER ({_KEEP} AND edge >= 3) AS strong_bets,
  count(*) FILTER ({_KEEP} AND edge < 3) AS moderate_bets FROM op"""

QUERIES = {
    "backtest_bets": (backtest_bets, BACKTEST_BETS),
    "backtest_overall": (backtest_overall, BACKTEST_OVERALL),
    "by_prop": (by_prop, BY_PROP),
    "by_direction": (by_direction, BY_DIRECTION),
    "by_edge_bucket": (by_edge_bucket, BY_EDGE_BUCKET),
    "daily_cumulative": (daily_cumulative, DAILY_CUMULATIVE),
    "running_bets": (running_bets, RUNNING_BETS),
    "by_tier": (by_tier, BY_TIER),
    "threshold_sweep": (threshold_sweep, THRESHOLD_SWEEP),
    "best_threshold": (best_threshold, BEST_THRESHOLD),
    "best_props": (best_props, BEST_PROPS),
    "rule_flags": (rule_flags, RULE_FLAGS),
    "confidence_buckets": (confidence_buckets, CONFIDENCE_BUCKETS),
    "confidence_threshold": (confidence_threshold, CONFIDENCE_THRESHOLD),
    "confidence_picks": (confidence_picks, CONFIDENCE_PICKS),
    "expected_roi": (expected_roi, EXPECTED_ROI),
    "brier": (brier, BRIER),
    "regression_metrics": (regression_metrics, REGRESSION_METRICS),
    "sim_accuracy": (sim_accuracy, SIM_ACCURACY),
    "metric_limits": (metric_limits, METRIC_LIMITS),
    "edge_rating": (edge_rating, EDGE_RATING),
    "direction_split": (direction_split, DIRECTION_SPLIT),
    "topk_per_group": (topk_per_group, TOPK_PER_GROUP),
    "topk": (topk, TOPK),
    "tracking_sheet": (tracking_sheet, TRACKING_SHEET),
    "lock_bets": (lock_bets, LOCK_BETS),
    "grade_join": (grade_join, GRADE_JOIN),
    "graded_summary": (graded_summary, GRADED_SUMMARY),
    "opportunities": (opportunities, OPPORTUNITIES),
    "run_summary": (run_summary, RUN_SUMMARY),
}
