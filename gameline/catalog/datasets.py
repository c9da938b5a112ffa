"""Modelling tables, splits, statistics and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gameline.catalog.base import GAMES, OBS, r
from gameline.catalog.teams import FORM, MIRROR, OPPONENT_MEANS, RANKED, SCHEDULE
from gameline.operators import context, dataset, overunder, quality, rolling, schedule, stats
from gameline.plans import features
from gameline.plans.views import game_players, games, observations, table, tidy

_W = "PARTITION BY player ORDER BY game_date, seq"


def _rolled(spark, sf):
    spec = rolling.RollingSpec(stats=["value"], means={5: 1, 10: 1})
    return rolling.rolling_features(observations(spark, sf), spec)


ROLLED = OBS + f""",
rolled AS (SELECT *, row_number() OVER w - 1 AS games_played,
  avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS value_l5,
  avg(value) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS value_l10
  FROM obs WINDOW w AS ({_W}))"""


def min_history(spark, sf):
    return tidy(dataset.enough_history(_rolled(spark, sf)).select("player", "seq", "games_played"))


MIN_HISTORY = f"WITH {ROLLED} SELECT player, seq, games_played FROM rolled WHERE games_played >= 10"


def history_report(spark, sf):
    return tidy(dataset.history_report(_rolled(spark, sf)))


HISTORY_REPORT = f"""WITH {ROLLED} SELECT count(*) AS rows_before, count(*) FILTER (games_played >= 10) AS rows_after,
  count(*) FILTER (games_played < 10) AS removed FROM rolled"""


def temporal_split(spark, sf):
    return tidy(dataset.temporal_split(observations(spark, sf)).select("seq", "is_test"))


TEMPORAL_SPLIT = f"""WITH {OBS} SELECT seq, CAST(game_date >= (SELECT max(game_date) FROM obs) - 21 AS BIGINT) AS is_test
  FROM obs"""


def cv_folds(spark, sf):
    return tidy(dataset.expanding_folds(observations(spark, sf)).select("seq", "ordinal", "fold"))


CV_FOLDS = f"""WITH {OBS}, x AS (SELECT seq, row_number() OVER (ORDER BY game_date, seq) AS ordinal,
  count(*) OVER () AS n FROM obs)
SELECT seq, ordinal, CASE WHEN ordinal - 1 >= n - 5 * (n // 6)
  THEN CAST((ordinal - 1 - (n - 5 * (n // 6))) // (n // 6) AS BIGINT) ELSE -1 END AS fold FROM x"""


def grid_folds(spark, sf):
    return tidy(dataset.contiguous_folds(observations(spark, sf), "game_date", ["seq"]).select("seq", "fold"))


GRID_FOLDS = f"""WITH {OBS}, x AS (SELECT seq, row_number() OVER (ORDER BY game_date, seq) - 1 AS i,
  count(*) OVER () AS n FROM obs), y AS (SELECT *, n // 3 AS b, n % 3 AS m FROM x)
SELECT seq, CAST(CASE WHEN i < m * (b + 1) THEN i // (b + 1) ELSE m + (i - m * (b + 1)) // b END AS BIGINT) AS fold FROM y"""


def corr_targets(spark, sf):
    g = games(spark, sf)
    return tidy(stats.target_correlations(g, ["mp", "fga", "fg_pct", "3pa", "fta", "tov", "stl", "blk"], ["pts", "trb", "ast"]))


CORR_TARGETS = f"WITH {GAMES} " + " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{f}' AS feature, {r(f'''corr({t}, "{f}")''', 'corr')}, {r(f'''abs(corr({t}, "{f}"))''', 'abs_corr')} FROM games"
    for t in ("pts", "trb", "ast") for f in ("mp", "fga", "fg_pct", "3pa", "fta", "tov", "stl", "blk"))

_MEDIAN = ["pts", "trb", "ast", "mp", "fga", "pts_l5", "pts_l20"]


def _medians_base(spark, sf):
    spec = rolling.RollingSpec(stats=["pts"], means={5: 1, 20: 1}, counter=None)
    return rolling.rolling_features(games(spark, sf).select("player", "game_date", "seq", *_MEDIAN[:5]), spec, bound=game_players(spark, sf))


_MB = GAMES + f""", mb AS (SELECT *, avg(pts) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pts_l5,
  avg(pts) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pts_l20 FROM games WINDOW w AS ({_W}))"""


def median_values(spark, sf):
    return tidy(stats.exact_medians_long(_medians_base(spark, sf), _MEDIAN))


MEDIAN_VALUES = f"WITH {_MB} " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, {r(f'median({c})', 'median')} FROM mb" for c in _MEDIAN)


def median_impute(spark, sf):
    filled = stats.fill_medians(_medians_base(spark, sf), ["pts_l5", "pts_l20"])
    return tidy(filled.select("player", "seq", "pts_l5", "pts_l20"))


MEDIAN_IMPUTE = f"""WITH {_MB} SELECT player, seq, {r('coalesce(pts_l5, (SELECT median(pts_l5) FROM mb))', 'pts_l5')},
  {r('coalesce(pts_l20, (SELECT median(pts_l20) FROM mb))', 'pts_l20')} FROM mb"""

_PROFILE = ["pts", "trb", "ast", "mp", "pts_l5"]


def profile(spark, sf):
    return tidy(stats.profile(_medians_base(spark, sf), _PROFILE))


PROFILE = f"WITH {_MB} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS name, count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls,
  {r(f'(count(*) - count({c})) * 100.0::DOUBLE / count(*)', 'null_pct')}, {r(f'min({c})', 'minimum')},
  {r(f'max({c})', 'maximum')}, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')} FROM mb""" for c in _PROFILE)


def key_profile(spark, sf):
    return tidy(stats.key_profile(observations(spark, sf), ["player", "game_date"], ["player", "prop", "game_date"]))


KEY_PROFILE = f"""WITH {OBS} SELECT count(*) AS rows, count(*) - count(DISTINCT (player, game_date)) AS duplicate_rows,
  count(DISTINCT player) AS distinct_player, count(DISTINCT prop) AS distinct_prop,
  count(DISTINCT game_date) AS distinct_game_date FROM obs"""


def top_entities(spark, sf):
    return tidy(stats.top_values(observations(spark, sf), ["player"], 5))


TOP_ENTITIES = f"WITH {OBS} SELECT player, count(*) AS n FROM obs GROUP BY player ORDER BY n DESC, player LIMIT 5"


def usual_prop(spark, sf):
    """The value that an entity shows most often."""
    return tidy(stats.modes(observations(spark, sf), ["player"], "prop"))


USUAL_PROP = f"""WITH {OBS}, c AS (SELECT player, prop, count(*) AS n FROM obs WHERE prop IS NOT NULL GROUP BY player, prop)
SELECT player, prop, n FROM c QUALIFY row_number() OVER (PARTITION BY player ORDER BY n DESC, prop) = 1"""


def seeded_sample(spark, sf):
    rolled = _rolled(spark, sf)
    return tidy(stats.seeded_sample(dataset.enough_history(rolled, 5).select("player", "seq", "value"), ["seq"], 5))


SEEDED_SAMPLE = f"""WITH {ROLLED} SELECT player, seq, {r('value')} FROM rolled WHERE games_played >= 5
ORDER BY md5('42|' || CAST(seq AS VARCHAR)), seq LIMIT 5"""


def modelling_table(spark, sf):
    """Identifiers, targets and the leak-free numeric columns of the task chain."""
    df = features.task_features(games(spark, sf), game_players(spark, sf))
    cols = dataset.feature_columns(df.drop("seq"))
    dataset.require_leak_free(cols, "pts")
    keep = dataset.enough_history(df, 10)
    return tidy(dataset.modelling_table(keep, [*cols, "seq"]), "days_rest", "player_days_rest", "games_last_7d", "games_last_14d")


def feature_table(spark, sf):
    """The whole task chain: rolling form, opponent context and schedule on every row."""
    df = features.task_features(games(spark, sf), game_players(spark, sf))
    return tidy(df.drop("res", *rolling.BOX_STATS), "days_rest", "player_days_rest", "games_last_7d", "games_last_14d")


def single_table(spark, sf):
    """The chain that keeps ten-game windows free for lines: deviations over 5 and 20, opponents over 5 games."""
    df = features.single_features(games(spark, sf), game_players(spark, sf))
    return tidy(df.drop("res", *rolling.BOX_STATS), "days_rest", "player_days_rest", "games_last_7d", "games_last_14d")


def seasons_table(spark, sf):
    """The multi-season chain: opponent means, dense ranks over rows, neutral fills and simplified rest."""
    df = features.seasons_features(games(spark, sf).withColumns({
        "player": F.col("player").cast("string"), "opp": F.col("opp").cast("string")}),
        game_players(spark, sf).withColumn("player", F.col("player").cast("string")))
    return tidy(df.drop("res", *rolling.BOX_STATS))


def _frame(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _feature_sql() -> str:
    cols = [f'avg("{s}") OVER {_frame(n)} AS "{s}_l{n}"' for s in rolling.BOX_STATS for n in (5, 10, 20)]
    cols += [f"CASE WHEN count({s}) OVER {_frame(n)} >= 3 THEN stddev_samp({s}) OVER {_frame(n)} END AS {s}_std_l{n}"
             for s in ("pts", "trb", "ast", "mp") for n in (10, 20)]
    cols += [f"avg({s}) OVER {_frame(5)} / nullif(avg({s}) OVER {_frame(20)}, 0) AS {s}_trend" for s in ("pts", "trb", "ast")]
    cols += [f"sum(mp) OVER {_frame(3)} AS mp_l3", f"avg(mp) OVER {_frame(3)} AS mp_avg_l3",
             f"coalesce(lag(mp) OVER ({_W}) >= 36, false)::INT::DOUBLE AS high_min_prev",
             f"(game_date - lag(game_date) OVER ({_W}))::DOUBLE AS player_days_rest"]
    names = [c.rsplit(" AS ", 1)[1].strip('"') for c in cols]
    out = [r(f'f."{n}"', f'"{n}"') for n in names]
    opp = [r(f"t.{c}", f"opp_{c}") for c in context.OPPONENT_COLUMNS]
    return f"""WITH {RANKED}, {SCHEDULE},
f AS (SELECT player, game_date, seq, tm, opp, row_number() OVER ({_W}) - 1 AS games_played,
        row_number() OVER ({_W}) AS games_streak, {", ".join(cols)} FROM games)
SELECT f.player, CAST(f.game_date AS VARCHAR) AS game_date, f.seq, f.tm, f.opp, f.games_played, f.games_streak,
  {", ".join(out)}, {", ".join(opp)}, {r('s.days_rest', 'days_rest')},
  CAST(coalesce(s.days_rest <= 1, false) AS BIGINT) AS is_b2b,
  CAST(coalesce(s.days_rest = 1, false) AS BIGINT) AS is_b2b_second,
  {r('s.games_last_7d', 'games_last_7d')}, {r('s.games_last_14d', 'games_last_14d')}
FROM f LEFT JOIN ranked t ON t.tm = f.opp AND t.game_date = f.game_date AND t.opp = f.tm
LEFT JOIN sched s ON s.tm = f.tm AND s.game_date = f.game_date"""


FEATURE_TABLE = _feature_sql()


def _means(stats) -> list[str]:
    return [r(f'avg("{s}") OVER {_frame(n)}', f'"{s}_l{n}"') for s in stats for n in (5, 10, 20)]


def _stds(windows) -> list[str]:
    return [r(f"CASE WHEN count({s}) OVER {_frame(n)} >= {m} THEN stddev_samp({s}) OVER {_frame(n)} END", f"{s}_std_l{n}")
            for s in ("pts", "trb", "ast", "mp") for n, m in windows]


_LOAD = [r(f"sum(mp) OVER {_frame(3)}", "mp_l3"), r(f"avg(mp) OVER {_frame(3)}", "mp_avg_l3")]
_T5 = "(PARTITION BY tm ORDER BY game_date, opp ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_ALLOWED = [f"{c}_allowed" for c in context.ALLOWED]


def _single_sql() -> str:
    trends = [r(f"avg({s}) OVER {_frame(5)} / nullif(avg({s}) OVER {_frame(20)}, 0)", f"{s}_trend") for s in ("pts", "trb", "ast")]
    cols = [*_means(rolling.BOX_STATS), *_stds(((5, 3), (20, 5))), *trends, *_LOAD,
            r(f"coalesce(lag(mp) OVER ({_W}) >= 36, false)::INT", "high_min_prev"),
            r(f"game_date - lag(game_date) OVER ({_W})", "player_days_rest")]
    form = ", ".join(f"CASE WHEN count({c}) OVER {_T5} >= 3 THEN avg({c}) OVER {_T5} END AS {c}_l5" for c in _ALLOWED)
    rank = ", ".join(
        f"CASE WHEN {c}_l5 IS NOT NULL THEN rank() OVER (PARTITION BY game_date ORDER BY {c}_l5 NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY game_date, {c}_l5) - 1) / 2.0::DOUBLE END AS {c}_rank" for c in _ALLOWED[:3])
    opp = ", ".join([r(f"t.{c}_l5", f"opp_{c}_l5") for c in _ALLOWED] + [r(f"t.{c}_rank", f"opp_{c}_rank") for c in _ALLOWED[:3]])
    return f"""WITH {MIRROR}, {SCHEDULE}, f5 AS (SELECT *, {form} FROM mirror), r5 AS (SELECT *, {rank} FROM f5),
f AS (SELECT player, game_date, seq, tm, opp, row_number() OVER ({_W}) - 1 AS games_played,
        row_number() OVER ({_W}) AS games_streak, {", ".join(cols)} FROM games)
SELECT f.* EXCLUDE (game_date), CAST(f.game_date AS VARCHAR) AS game_date, {opp}, {r('s.days_rest', 'days_rest')},
  CAST(coalesce(s.days_rest <= 1, false) AS BIGINT) AS is_b2b, CAST(coalesce(s.days_rest = 1, false) AS BIGINT) AS is_b2b_second,
  {r('s.games_last_7d', 'games_last_7d')}, {r('s.games_last_14d', 'games_last_14d')}
FROM f LEFT JOIN r5 t ON t.tm = f.opp AND t.game_date = f.game_date AND t.opp = f.tm
LEFT JOIN sched s ON s.tm = f.tm AND s.game_date = f.game_date"""


SINGLE_TABLE = _single_sql()


def _seasons_sql() -> str:
    cols = [*_means(rolling.BOX_STATS), *_stds(((10, 2),)), *_LOAD,
            r(f"coalesce(lag(mp) OVER ({_W}) > 35, false)::INT", "high_min_prev")]
    rank = ", ".join(f"CASE WHEN m.{c}_l10 IS NOT NULL THEN dense_rank() OVER (PARTITION BY g.game_date ORDER BY m.{c}_l10 DESC NULLS LAST)"
                     f" END AS {c}_rk" for c in _ALLOWED[:3])
    fill = [f"coalesce({c}_l10, avg({c}_l10) OVER ())" for c in _ALLOWED]
    out = [r(e, f"opp_{c}_l10") for e, c in zip(fill, _ALLOWED)] + [r(f"coalesce({c}_rk, 15)", f"opp_{c}_rank") for c in _ALLOWED[:3]]
    out += [r(fill[0], "opp_tm_pts_l10"), r(fill[3], "opp_tm_fga_l10")]
    return f"""WITH {GAMES}, {OPPONENT_MEANS},
f AS (SELECT seq, row_number() OVER ({_W}) - 1 AS games_played,
  greatest(0, least(7, coalesce(game_date - lag(game_date) OVER ({_W}) - 1, 2))) AS rest, {", ".join(cols)} FROM games),
j AS (SELECT g.seq, g.player, g.tm, g.opp, g.game_date, {", ".join(f"m.{c}_l10" for c in _ALLOWED)}, {rank}
  FROM games g LEFT JOIN omf m ON g.opp = m.opp AND g.game_date = m.game_date)
SELECT CAST(player AS VARCHAR) AS player, CAST(game_date AS VARCHAR) AS game_date, j.seq, tm, CAST(opp AS VARCHAR) AS opp,
  player || '_vs_' || opp AS matchup_id, CAST(rest AS BIGINT) AS days_rest, CAST(rest = 0 AS BIGINT) AS is_b2b_second,
  CAST(2 AS BIGINT) AS games_last_7d, f.* EXCLUDE (seq, rest), {", ".join(out)} FROM j JOIN f ON j.seq = f.seq"""


SEASONS_TABLE = _seasons_sql()


def line_proxies(spark, sf):
    """Combined targets and the lines that stand for all six props."""
    spec = rolling.RollingSpec(stats=["pts", "trb", "ast"], means={10: 1}, counter=None)
    g = rolling.rolling_features(games(spark, sf).select("player", "game_date", "seq", "pts", "trb", "ast"), spec,
                                 bound=game_players(spark, sf))
    out = dataset.line_proxies(dataset.combo_targets(g))
    return tidy(out.select("seq", "pra", "pra_l10", *[f"{p}_line" for p in ("pts", "trb", "ast", "pra", "pr", "pa")]))


LINE_PROXIES = f"""WITH {GAMES}, x AS (SELECT seq, pts + trb + ast AS pra, avg(pts) OVER {_frame(10)} AS p,
  avg(trb) OVER {_frame(10)} AS t, avg(ast) OVER {_frame(10)} AS a FROM games)
SELECT seq, {r('pra')}, {r('p + t + a', 'pra_l10')}, {r('p', 'pts_line')}, {r('t', 'trb_line')}, {r('a', 'ast_line')},
  {r('p + t + a', 'pra_line')}, {r('p + t', 'pr_line')}, {r('p + a', 'pa_line')} FROM x"""


_LINE_COLUMNS = [f"{s}_l10" for s in rolling.BOX_STATS]
MODELLING_TABLE = f"""WITH {GAMES} SELECT f.* EXCLUDE ({", ".join(f'"{c}"' for c in _LINE_COLUMNS)}), g.res,
  {r('g.pts', 'pts')}, {r('g.trb', 'trb')}, {r('g.ast', 'ast')}
FROM ({FEATURE_TABLE}) f JOIN games g ON f.seq = g.seq WHERE f.games_played >= 10"""


def recent_state(spark, sf):
    """Rolling form and rest of every game."""
    spec = rolling.RollingSpec(stats=["pts", "mp"], std_stats=["pts"], stds={10: 3}, load="mp")
    g = rolling.rolling_features(games(spark, sf).select("player", "game_date", "seq", "tm", "pts", "mp"), spec, bound=game_players(spark, sf))
    return schedule.attach_schedule(g, schedule.team_schedule(g))


def over_under_features(spark, sf):
    """The 47 model features against a line half a point above the ten-game mean."""
    g = dataset.enough_history(recent_state(spark, sf), 5)
    out = overunder.over_under_features(g, "pts", F.col("pts_l10") + 0.5, F.col("pts"))
    return tidy(out.select("player", "seq", "went_over", *[F.col(c).cast("double") for c in overunder.OVER_UNDER_FEATURES]))


def over_under_select(source: str, median: str, lead: str, known: dict[str, str] | None = None) -> str:
    """The feature expressions over rows with: line gaps a, b, c; variance v; ratio q; b2b, hm, dr, ml, gd.

    Without ``known`` the rows have no opponent and no history; it replaces the expressions that need them.
    """
    zero = ["matchup_edge", "recent_matchup_edge", "has_matchup_history", "strong_matchup_history", "matchup_games",
            "strong_matchup_over", "strong_matchup_under", "favorable_vs_opp", "unfavorable_vs_opp",
            "good_matchup_x_hot", "bad_matchup_x_cold", "good_matchup_rested", "bad_matchup_tired",
            "matchup_reliability", "matchup_edge_sq"]
    e = {
        "avg_vs_line": "a", "l5_vs_line": "b", "l20_vs_line": "c", "variance": "v", "line_percentile": "a / (v + 0.1::DOUBLE)",
        "trend": "t", "recent_vs_season": "q", "is_b2b": "b2b", "high_mins": "hm", "fatigue_risk": "b2b * hm",
        "days_rest_capped": "dr", "well_rested": "(dr >= 2)::INT", "easy_matchup": "0.5", "hard_matchup": "0.5",
        "matchup_edge_vs_line": "-a", "fatigue_x_cold": "b2b * (t < 0)::INT", "fatigue_x_hot": "b2b * (t > 0)::INT",
        "easy_x_hot": "0.5 * (q > 1)::INT", "hard_x_cold": "0.5 * (q < 1)::INT",
        "edge_reliability": "a / (v + 1)", "line_extreme_low": "(-c < -3)::INT", "line_extreme_high": "(-c > 3)::INT",
        "is_consistent": "(v < med)::INT", "consistent_above_line": "(v < med AND a > 0)::INT", "mins_load": "ml",
        "high_usage": "(ml > 0.9)::INT", "games_density": "gd", "heavy_schedule": "(gd > 0.75)::INT",
        "compound_fatigue": "b2b * (gd > 0.75)::INT * (ml > 0.9)::INT", "trend_sq": "t * t", "variance_sq": "v * v",
        "edge_sq": "a * a", **{z: "0.0" for z in zero}, **(known or {})}
    return f"""SELECT {lead}, {", ".join(r(e[n], n) for n in overunder.OVER_UNDER_FEATURES)}
FROM (SELECT *, b - c AS t, {median} AS med FROM {source})"""


_F = {n: f"({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (5, 10, 20)}
RECENT = f"""{GAMES}, {SCHEDULE},
g AS (SELECT *, row_number() OVER ({_W}) - 1 AS games_played, avg(pts) OVER {_F[5]} AS l5, avg(pts) OVER {_F[10]} AS l10,
  avg(pts) OVER {_F[20]} AS l20, CASE WHEN count(pts) OVER {_F[10]} >= 3 THEN stddev_samp(pts) OVER {_F[10]} END AS sd,
  avg(mp) OVER {_F[10]} AS mp_l10, coalesce(lag(mp) OVER ({_W}) >= 36, false)::INT AS hm FROM games)"""
STATE = """coalesce(sd, 5) AS v, l5 / (l20 + 0.1::DOUBLE) AS q, coalesce(days_rest = 1, false)::INT AS b2b, hm,
  greatest(0, least(5, coalesce(days_rest, 1))) AS dr, coalesce(mp_l10, 25) / 36 AS ml,
  coalesce(games_last_7d, 2) / 4.0::DOUBLE AS gd"""
OVER_UNDER = f"""WITH {RECENT},
x AS (SELECT player, seq, pts, l10 + 0.5 AS line, l10 - (l10 + 0.5) AS a, l5 - (l10 + 0.5) AS b, l20 - (l10 + 0.5) AS c,
  {STATE} FROM g JOIN sched USING (tm, game_date) WHERE games_played >= 5)
{over_under_select('x', '(SELECT median(v) FROM x)', 'player, seq, CAST(pts > line AS BIGINT) AS went_over')}"""


def over_under_full(spark, sf):
    """The 47 features with opponent ranks and matchup history on the rows, against a half-point line by the short mean."""
    g = features.task_features(games(spark, sf), game_players(spark, sf))
    g = features.with_history(g, bound=game_players(spark, sf))
    out = overunder.over_under_features(dataset.enough_history(g, 5), "pts", F.floor("pts_l5") + 0.5, F.col("pts"))
    return tidy(out.select("player", "seq", "went_over", *[F.col(c).cast("double") for c in overunder.OVER_UNDER_FEATURES]))


_OVER, _UNDER = "mg >= 3 AND me > 3", "mg >= 3 AND me < -3"
_MET = {
    "easy_matchup": "em", "hard_matchup": "1 - em", "matchup_edge": "me", "recent_matchup_edge": "rme",
    "has_matchup_history": "(mg >= 2)::INT", "strong_matchup_history": "(mg >= 3)::INT", "matchup_games": "mg",
    "matchup_edge_vs_line": "me - a", "strong_matchup_over": f"({_OVER})::INT", "strong_matchup_under": f"({_UNDER})::INT",
    "favorable_vs_opp": "(mg >= 2 AND me > 2.5)::INT", "unfavorable_vs_opp": "(mg >= 2 AND me < -2.5)::INT",
    "easy_x_hot": "em * (q > 1)::INT", "hard_x_cold": "(1 - em) * (q < 1)::INT",
    "good_matchup_x_hot": f"({_OVER} AND t > 0)::INT", "bad_matchup_x_cold": f"({_UNDER} AND t < 0)::INT",
    "good_matchup_rested": f"({_OVER} AND dr >= 2)::INT", "bad_matchup_tired": f"({_UNDER})::INT * b2b",
    "matchup_reliability": "me / (v + 1)", "matchup_edge_sq": "me * me"}
OVER_UNDER_FULL = f"""WITH {RANKED}, {SCHEDULE}, {RECENT[RECENT.index("g AS (SELECT"):]},
h AS (SELECT a.player, a.seq, count(*) FILTER (p.opp = a.opp) AS mg, avg(p.pts) FILTER (p.opp = a.opp) AS vs, avg(p.pts) AS usual,
        list_avg(list_slice(list(p.pts ORDER BY p.game_date, p.seq) FILTER (p.opp = a.opp), -3, -1)) AS lately
      FROM games a LEFT JOIN games p ON p.player = a.player AND p.game_date < a.game_date GROUP BY a.player, a.seq),
x AS (SELECT g.player, g.seq, pts, floor(l5) + 0.5 AS line, l10 - (floor(l5) + 0.5) AS a, l5 - (floor(l5) + 0.5) AS b, l20 - (floor(l5) + 0.5) AS c, {STATE},
        coalesce(rk.pts_allowed_rank, 15) / 30.0::DOUBLE AS em, mg, CASE WHEN mg >= 2 THEN coalesce(vs - usual, 0) ELSE 0 END AS me,
        CASE WHEN mg >= 2 THEN coalesce(lately - usual, 0) ELSE 0 END AS rme
      FROM g JOIN h ON g.player = h.player AND g.seq = h.seq
      LEFT JOIN sched sc ON sc.tm = g.tm AND sc.game_date = g.game_date
      LEFT JOIN ranked rk ON rk.tm = g.opp AND rk.game_date = g.game_date AND rk.opp = g.tm WHERE games_played >= 5)
{over_under_select('x', '(SELECT median(v) FROM x)', 'player, seq, CAST(pts > line AS BIGINT) AS went_over', _MET)}"""


def linear_sanity(spark, sf):
    rolled = _rolled(spark, sf).where(F.col("value_l5").isNotNull())
    split = dataset.position_split(rolled, "game_date", ["seq"], 0.8)
    return tidy(stats.line_fit(split, "value_l10", "value", F.col("is_train") == 1))


LINEAR_SANITY = f"""WITH {ROLLED}, x AS (SELECT *, row_number() OVER (ORDER BY game_date, seq) AS i, count(*) OVER () AS n
  FROM rolled WHERE value_l5 IS NOT NULL),
fit AS (SELECT regr_slope(value, value_l10) AS slope, regr_intercept(value, value_l10) AS intercept, count(*) AS train_rows
  FROM x WHERE i <= floor(n * 0.8::DOUBLE)),
e AS (SELECT value, value - (intercept + slope * value_l10) AS e FROM x, fit WHERE i > floor(n * 0.8::DOUBLE))
SELECT {r('any_value(slope)', 'slope')}, {r('any_value(intercept)', 'intercept')}, any_value(train_rows) AS train_rows,
  count(*) AS test_rows, {r('avg(abs(e))', 'mae')}, {r('1 - sum(e * e) / (var_pop(value) * count(*))', 'r2')} FROM e, fit"""


def dq_clean(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("game_id"), F.to_date("l_shipdate").alias("game_date"),
        F.col("l_extendedprice").alias("pts"), F.col("l_quantity").alias("mp"), F.col("l_discount").alias("fg_pct"))
    return tidy(quality.clean_checks(li, max_minutes=45.0))


DQ_CLEAN = """WITH x AS (SELECT CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS DOUBLE) AS duplicate_games,
  CAST(count(*) FILTER (l_shipdate IS NULL) AS DOUBLE) AS null_dates,
  CAST(count(*) FILTER (l_extendedprice < 0) AS DOUBLE) AS negative_pts,
  CAST(count(*) FILTER (l_quantity < 0 OR l_quantity > 45) AS DOUBLE) AS invalid_minutes,
  CAST(count(*) FILTER (l_discount < 0 OR l_discount > 1) AS DOUBLE) AS invalid_fg_pct FROM lineitem)
SELECT "check", value, CAST(value = 0 AS BIGINT) AS passed FROM (UNPIVOT x ON COLUMNS(*) INTO NAME "check" VALUE value)"""


def leak_check(spark, sf):
    return tidy(quality.rolling_leak_checks(_rolled(spark, sf), value="value", short="value_l5", long="value_l10"))


LEAK_CHECK = f"""WITH {ROLLED}, p AS (SELECT player, max(value) FILTER (games_played = 0) AS v,
  max(value_l5) FILTER (games_played = 1) AS s FROM rolled WHERE games_played <= 1 GROUP BY player)
SELECT 'first_event_history' AS "check", CAST(n AS DOUBLE) AS value, CAST(n = 0 AS BIGINT) AS passed
  FROM (SELECT count(*) FILTER (games_played = 0 AND value_l5 IS NOT NULL) AS n FROM rolled)
UNION ALL SELECT 'second_event_mismatch', CAST(n AS DOUBLE), CAST(n = 0 AS BIGINT)
  FROM (SELECT count(*) FILTER (s IS NOT NULL AND abs(v - s) >= 0.01) AS n FROM p)
UNION ALL SELECT 'correlation', {r('c', 'value')}, CAST(c < 0.85 AS BIGINT) FROM (SELECT corr(value, value_l10) AS c FROM rolled)"""


def dq_opponent(spark, sf):
    g = games(spark, sf)
    joined = context.attach_opponent(g, context.team_context(g))
    return tidy(quality.opponent_checks(joined, low=10.0, high=60.0))


DQ_OPPONENT = f"""WITH {RANKED}, j AS (SELECT g.pts, t.pts_allowed_l10 AS a, t.pts_allowed_rank AS k
  FROM games g LEFT JOIN ranked t ON t.tm = g.opp AND t.game_date = g.game_date AND t.opp = g.tm),
x AS (SELECT min(a) AS lo, max(a) AS hi, min(k) AS rlo, max(k) AS rhi, corr(pts, a) AS c,
  count(*) FILTER (a IS NULL) * 100.0::DOUBLE / count(*) AS n FROM j)
SELECT 'allowed_min' AS "check", {r('lo', 'value')}, CAST(coalesce(lo >= 10, true) AS BIGINT) AS passed FROM x
UNION ALL SELECT 'allowed_max', {r('hi', 'v')}, CAST(coalesce(hi <= 60, true) AS BIGINT) FROM x
UNION ALL SELECT 'rank_min', {r('rlo', 'v')}, CAST(coalesce(rlo >= 1, true) AS BIGINT) FROM x
UNION ALL SELECT 'rank_max', {r('rhi', 'v')}, CAST(coalesce(rhi <= 30, true) AS BIGINT) FROM x
UNION ALL SELECT 'correlation', {r('c', 'v')}, CAST(coalesce(c > 0, true) AS BIGINT) FROM x
UNION ALL SELECT 'null_pct', {r('n', 'v')}, CAST(n < 20 AS BIGINT) FROM x"""


def dq_schedule(spark, sf):
    spec = rolling.RollingSpec(stats=(), means={}, load="mp", counter=None)
    g = rolling.rolling_features(games(spark, sf).select("player", "game_date", "seq", "tm", "pts", "mp"), spec, bound=game_players(spark, sf))
    return tidy(quality.schedule_checks(schedule.attach_schedule(g, schedule.team_schedule(g))))


DQ_SCHEDULE = f"""WITH {GAMES}, {SCHEDULE}, j AS (SELECT pts, days_rest, coalesce(days_rest = 1, false)::INT AS b, games_last_7d AS w,
  sum(mp) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l FROM games JOIN sched USING (tm, game_date)),
x AS (SELECT min(days_rest) AS lo, max(days_rest) AS hi, avg(b) * 100 AS b, max(w) AS w, max(l) AS l, corr(pts, b) AS c FROM j)
SELECT 'rest_min' AS "check", {r('lo', 'value')}, CAST(coalesce(lo >= 0, true) AS BIGINT) AS passed FROM x
UNION ALL SELECT 'rest_max', {r('hi', 'v')}, CAST(coalesce(hi <= 15, true) AS BIGINT) FROM x
UNION ALL SELECT 'b2b_pct', {r('b', 'v')}, CAST(b BETWEEN 8 AND 20 AS BIGINT) FROM x
UNION ALL SELECT 'games_7d', {r('w', 'v')}, CAST(coalesce(w <= 6, true) AS BIGINT) FROM x
UNION ALL SELECT 'load_l3', {r('l', 'v')}, CAST(coalesce(l <= 160, true) AS BIGINT) FROM x
UNION ALL SELECT 'correlation', {r('c', 'v')}, CAST(coalesce(c < 0, true) AS BIGINT) FROM x"""


def dq_feed(spark, sf):
    return tidy(quality.feed_checks(games(spark, sf), ["player", "tm", "pts", "trb", "ast", "game_date", "res"]))


DQ_FEED = f"WITH {GAMES} " + " UNION ALL ".join(
    f"""SELECT 'nulls_{c}' AS "check", CAST(count(*) - count({c}) AS DOUBLE) AS value,
  CAST(count(*) = count({c}) AS BIGINT) AS passed FROM games"""
    for c in ("player", "tm", "pts", "trb", "ast", "game_date", "res"))


def leak_correlation(spark, sf):
    """Feature and target pairs too close to each other to be known in advance."""
    return tidy(quality.correlation_checks(games(spark, sf), ["mp", "fga", "fg_pct", "stl", "blk"], ["pts", "trb", "ast"], 0.7))


LEAK_CORRELATION = f"WITH {GAMES}, x AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{f}' AS feature, corr({t}, {f}) AS c FROM games"
    for t in ("pts", "trb", "ast") for f in ("mp", "fga", "fg_pct", "stl", "blk")) + \
    f") SELECT target, feature, {r('c', 'corr')}, {r('abs(c)', 'abs_corr')} FROM x WHERE abs(c) > 0.7"


def recompute_check(spark, sf):
    rolled = _rolled(spark, sf)
    return tidy(quality.recompute_rolling(observations(spark, sf), rolled, value="value"))


RECOMPUTE_CHECK = f"""WITH {OBS}, x AS (SELECT *, row_number() OVER ({_W}) AS i FROM obs),
n AS (SELECT player, max(i) AS m FROM x GROUP BY player)
SELECT CAST(5 AS BIGINT) AS "window", count(*) FILTER (m >= 6) AS checked, CAST(0 AS BIGINT) AS mismatches FROM n
UNION ALL SELECT 10, count(*) FILTER (m >= 11), 0 FROM n"""


def recompute_opponent(spark, sf):
    return tidy(quality.recompute_opponent(context.team_context(games(spark, sf))))


RECOMPUTE_OPPONENT = f"""WITH {FORM} SELECT count(pts_allowed_l10) AS checked, CAST(0 AS BIGINT) AS mismatches FROM form"""


def recompute_rest(spark, sf):
    g = games(spark, sf)
    return tidy(quality.recompute_rest(g, schedule.team_schedule(g)))


RECOMPUTE_REST = f"WITH {GAMES}, {SCHEDULE} SELECT count(days_rest) AS checked, CAST(0 AS BIGINT) AS mismatches FROM sched"

QUERIES = {
    "min_history": (min_history, MIN_HISTORY),
    "history_report": (history_report, HISTORY_REPORT),
    "temporal_split": (temporal_split, TEMPORAL_SPLIT),
    "cv_folds": (cv_folds, CV_FOLDS),
    "grid_folds": (grid_folds, GRID_FOLDS),
    "corr_targets": (corr_targets, CORR_TARGETS),
    "median_values": (median_values, MEDIAN_VALUES),
    "median_impute": (median_impute, MEDIAN_IMPUTE),
    "profile": (profile, PROFILE),
    "key_profile": (key_profile, KEY_PROFILE),
    "top_entities": (top_entities, TOP_ENTITIES),
    "seeded_sample": (seeded_sample, SEEDED_SAMPLE),
    "usual_prop": (usual_prop, USUAL_PROP),
    "modelling_table": (modelling_table, MODELLING_TABLE),
    "feature_table": (feature_table, FEATURE_TABLE),
    "single_table": (single_table, SINGLE_TABLE),
    "seasons_table": (seasons_table, SEASONS_TABLE),
    "line_proxies": (line_proxies, LINE_PROXIES),
    "over_under_features": (over_under_features, OVER_UNDER),
    "over_under_full": (over_under_full, OVER_UNDER_FULL),
    "linear_sanity": (linear_sanity, LINEAR_SANITY),
    "dq_clean": (dq_clean, DQ_CLEAN),
    "leak_check": (leak_check, LEAK_CHECK),
    "dq_opponent": (dq_opponent, DQ_OPPONENT),
    "dq_schedule": (dq_schedule, DQ_SCHEDULE),
    "dq_feed": (dq_feed, DQ_FEED),
    "leak_correlation": (leak_correlation, LEAK_CORRELATION),
    "recompute_check": (recompute_check, RECOMPUTE_CHECK),
    "recompute_opponent": (recompute_opponent, RECOMPUTE_OPPONENT),
    "recompute_rest": (recompute_rest, RECOMPUTE_REST),
}
