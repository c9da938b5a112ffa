"""Per-entity windows: rolling form, counters, rest, density and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from gameline.catalog.base import EVENTS, GAMES, OBS, r
from gameline.operators import heat, history, rolling, schedule
from gameline.plans.views import events, game_players, games, observations, tidy

_W = "PARTITION BY player ORDER BY game_date, seq"


def _frame(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def rolling_mean(spark, sf):
    spec = rolling.RollingSpec(stats=["value"])
    out = rolling.rolling_features(observations(spark, sf), spec)
    return tidy(out.select("player", "seq", "games_played", "value_l5", "value_l10", "value_l20"))


ROLLING_MEAN = f"""WITH {OBS} SELECT player, seq, row_number() OVER ({_W}) - 1 AS games_played,
  {", ".join(r(f"avg(value) OVER {_frame(n)}", f"value_l{n}") for n in (5, 10, 20))} FROM obs"""


def rolling_std(spark, sf):
    spec = rolling.RollingSpec(stats=(), means={}, std_stats=["value"], stds={5: 3, 10: 2, 20: 5})
    out = rolling.rolling_features(observations(spark, sf), spec)
    return tidy(out.select("player", "seq", "value_std_l5", "value_std_l10", "value_std_l20"))


ROLLING_STD = f"""WITH {OBS} SELECT player, seq, {", ".join(r(
  f"CASE WHEN count(value) OVER {_frame(n)} >= {m} THEN stddev_samp(value) OVER {_frame(n)} END", f"value_std_l{n}")
  for n, m in ((5, 3), (10, 2), (20, 5)))} FROM obs"""


def rolling_sum3(spark, sf):
    spec = rolling.RollingSpec(stats=(), means={}, load="value")
    out = rolling.rolling_features(observations(spark, sf), spec)
    return tidy(out.select("player", "seq", "value_l3", "value_avg_l3"))


ROLLING_SUM3 = f"""WITH {OBS} SELECT player, seq, {r(f"sum(value) OVER {_frame(3)}", "value_l3")},
  {r(f"avg(value) OVER {_frame(3)}", "value_avg_l3")} FROM obs"""


def prev_high(spark, sf):
    spec = rolling.RollingSpec(stats=(), means={}, load="value")
    strict = rolling.RollingSpec(stats=(), means={}, load="value", high_load=35.0, high_load_inclusive=False, counter=None)
    out = rolling.rolling_features(observations(spark, sf), spec).withColumnRenamed("high_min_prev", "high_prev")
    out = rolling.rolling_features(out, strict).withColumnRenamed("high_min_prev", "high_prev_strict")
    return tidy(out.select("player", "seq", "high_prev", "high_prev_strict"))


PREV_HIGH = f"""WITH {OBS} SELECT player, seq,
  {r(f"coalesce(lag(value) OVER ({_W}) >= 36, false)::INT", "high_prev")},
  {r(f"coalesce(lag(value) OVER ({_W}) > 35, false)::INT", "high_prev_strict")} FROM obs"""


def trend(spark, sf):
    spec = rolling.RollingSpec(stats=["value"], means={5: 1, 20: 1}, trends=["value"])
    out = rolling.rolling_features(observations(spark, sf), spec)
    return tidy(out.select("player", "seq", "value_trend"))


TREND = f"""WITH {OBS} SELECT player, seq,
  {r(f"avg(value) OVER {_frame(5)} / nullif(avg(value) OVER {_frame(20)}, 0)", "value_trend")} FROM obs"""


def next_value(spark, sf):
    spec = rolling.RollingSpec(stats=(), means={}, leads={"next_value": "value"})
    return tidy(rolling.rolling_features(observations(spark, sf), spec).select("player", "seq", "next_value"))


NEXT_VALUE = f"WITH {OBS} SELECT player, seq, {r(f'lead(value) OVER ({_W})', 'next_value')} FROM obs"


def event_counter(spark, sf):
    spec = rolling.RollingSpec(stats=(), means={}, streak=True)
    return tidy(rolling.rolling_features(events(spark, sf), spec).select("player", "seq", "games_played", "games_streak"))


EVENT_COUNTER = f"""WITH {EVENTS} SELECT player, seq, row_number() OVER ({_W}) - 1 AS games_played,
  row_number() OVER ({_W}) AS games_streak FROM ev"""


def nth_event(spark, sf):
    n = rolling.prior_count(observations(spark, sf), ["player"], "game_date", ["seq"])
    return tidy(n.where(F.col("games_played") == 5).select("player", "game_date", "seq", "value"))


NTH_EVENT = f"""WITH {OBS} SELECT player, CAST(game_date AS VARCHAR) AS game_date, seq, {r('value')} FROM obs
  QUALIFY row_number() OVER ({_W}) = 6"""


def range_counts(spark, sf):
    return tidy(schedule.event_density(events(spark, sf), ["player"], "game_date"), "events_last_7d", "events_last_14d")


RANGE_COUNTS = f"""WITH {EVENTS}, days AS (SELECT player, game_date, count(*) AS events FROM ev GROUP BY ALL)
SELECT player, CAST(game_date AS VARCHAR) AS game_date, events,
  {r("sum(events) OVER (PARTITION BY player ORDER BY game_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)", "events_last_7d")},
  {r("sum(events) OVER (PARTITION BY player ORDER BY game_date RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)", "events_last_14d")}
FROM days"""


def days_rest(spark, sf):
    s = schedule.team_schedule(observations(spark, sf), ["player"])
    return tidy(s, "days_rest", "games_last_7d", "games_last_14d")


_DW = "PARTITION BY player ORDER BY game_date"
DAYS_REST = f"""WITH {OBS}, days AS (SELECT DISTINCT player, game_date FROM obs),
x AS (SELECT *, game_date - lag(game_date) OVER ({_DW}) AS rest,
  count(*) OVER ({_DW} RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS n7,
  count(*) OVER ({_DW} RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS n14 FROM days)
SELECT player, CAST(game_date AS VARCHAR) AS game_date, {r('rest', 'days_rest')},
  CAST(coalesce(rest <= 1, false) AS BIGINT) AS is_b2b, CAST(coalesce(rest = 1, false) AS BIGINT) AS is_b2b_second,
  {r('nullif(n7, 0)', 'games_last_7d')}, {r('nullif(n14, 0)', 'games_last_14d')} FROM x"""


def entity_gap(spark, sf):
    spec = rolling.RollingSpec(stats=(), means={}, gap=True, counter=None)
    return tidy(rolling.rolling_features(observations(spark, sf), spec).select("player", "seq", "player_days_rest"),
                "player_days_rest")


ENTITY_GAP = f"""WITH {OBS} SELECT player, seq,
  {r(f"game_date - lag(game_date) OVER ({_W})", "player_days_rest")} FROM obs"""


def simple_schedule(spark, sf):
    spec = rolling.RollingSpec(stats=(), means={}, gap=True, counter=None)
    gaps = rolling.rolling_features(observations(spark, sf), spec)
    return tidy(gaps.select("player", "seq", *[c.alias(n) for n, c in schedule.simple_rest(F.col("player_days_rest")).items()]))


SIMPLE_SCHEDULE = f"""WITH {OBS}, x AS (SELECT player, seq,
  greatest(0, least(7, coalesce(game_date - lag(game_date) OVER ({_W}) - 1, 2))) AS rest FROM obs)
SELECT player, seq, CAST(rest AS BIGINT) AS days_rest, CAST(rest = 0 AS BIGINT) AS is_b2b_second,
  CAST(2 AS BIGINT) AS games_last_7d FROM x"""


def history_edge(spark, sf):
    spec = rolling.RollingSpec(stats=["pts", "trb", "ast"], means={10: 1}, counter=None)
    g = rolling.rolling_features(games(spark, sf).select("player", "game_date", "seq", "opp", "pts", "trb", "ast"), spec, bound=game_players(spark, sf))
    h = history.matchup_history(g, bound=game_players(spark, sf))
    return tidy(h.drop("game_date", "opp", "pts", "trb", "ast", "pts_l10", "trb_l10", "ast_l10"))


def _history_sql() -> str:
    cols = []
    for s, margin in (("pts", 2.5), ("trb", 1.5), ("ast", 1.0)):
        edge = f"(v_{s} - o_{s})"
        cols += [r(f"CASE WHEN n >= 2 THEN {edge} ELSE 0 END", f"{s}_matchup_edge"),
                 r(f"CASE WHEN n >= 2 THEN v_{s} ELSE {s}_l10 END", f"{s}_vs_opp"),
                 r(f"CASE WHEN n >= 2 THEN r_{s} ELSE {s}_l10 END", f"{s}_vs_opp_l3"),
                 r(f"CASE WHEN n >= 2 THEN r_{s} - o_{s} ELSE 0 END", f"{s}_recent_matchup_edge"),
                 f"CAST(n >= 2 AND {edge} > {margin} AS BIGINT) AS {s}_favorable_matchup",
                 f"CAST(n >= 2 AND {edge} < -{margin} AS BIGINT) AS {s}_unfavorable_matchup"]
    stats = ("pts", "trb", "ast")
    l10 = ", ".join(f"avg({s}) OVER {_frame(10)} AS {s}_l10" for s in stats)
    met = ", ".join(f"avg(h.{s}) FILTER (h.opp = g.opp) AS v_{s}, avg(h.{s}) AS o_{s}" for s in stats)
    last = ", ".join(f"list_avg(list_slice(list(h.{s} ORDER BY h.game_date, h.seq) FILTER (h.opp = g.opp), -3, -1)) AS r_{s}"
                     for s in stats)
    return f"""WITH {GAMES}, g AS (SELECT *, {l10} FROM games),
x AS (SELECT g.player, g.seq, any_value(g.pts_l10) AS pts_l10, any_value(g.trb_l10) AS trb_l10,
        any_value(g.ast_l10) AS ast_l10, count(*) FILTER (h.opp = g.opp) AS n, {met}, {last}
      FROM g LEFT JOIN games h ON h.player = g.player AND h.game_date < g.game_date GROUP BY g.player, g.seq)
SELECT player, seq, n AS n_prev_matchups, {", ".join(cols)} FROM x"""


HISTORY_EDGE = _history_sql()


def running_count(spark, sf):
    """Row numbers and running value over all observations in time order."""
    out = heat.running_totals(observations(spark, sf), [], "game_date", ["seq"], {"running_value": "value"}, "position")
    return tidy(out.select("seq", "position", "running_value"))


RUNNING_COUNT = f"""WITH {OBS} SELECT seq, row_number() OVER (ORDER BY game_date, seq) AS position,
  {r("sum(value) OVER (ORDER BY game_date, seq ROWS UNBOUNDED PRECEDING)", "running_value")} FROM obs"""


def box_rolling(spark, sf):
    """All thirteen statistics with the single-file parameters."""
    g = rolling.rolling_features(games(spark, sf), rolling.spec_single(), bound=game_players(spark, sf))
    made = [c for c in g.columns if c.endswith(("_l5", "_l10", "_l20", "_trend", "_l3")) or c in (
        "games_played", "games_streak", "high_min_prev", "player_days_rest")]
    return tidy(g.select("player", "seq", *made), "player_days_rest")


def _box_sql() -> str:
    cols = []
    for s in rolling.BOX_STATS:
        cols += [r(f'avg("{s}") OVER {_frame(n)}', f'"{s}_l{n}"') for n in (5, 10, 20)]
    for s in ("pts", "trb", "ast", "mp"):
        cols += [r(f"CASE WHEN count({s}) OVER {_frame(n)} >= {m} THEN stddev_samp({s}) OVER {_frame(n)} END",
                   f"{s}_std_l{n}") for n, m in ((5, 3), (20, 5))]
    cols += [r(f"avg({s}) OVER {_frame(5)} / nullif(avg({s}) OVER {_frame(20)}, 0)", f"{s}_trend") for s in ("pts", "trb", "ast")]
    return f"""WITH {GAMES} SELECT player, seq, row_number() OVER ({_W}) - 1 AS games_played,
  row_number() OVER ({_W}) AS games_streak, {r(f"game_date - lag(game_date) OVER ({_W})", "player_days_rest")},
  {r(f"coalesce(lag(mp) OVER ({_W}) >= 36, false)::INT", "high_min_prev")},
  {r(f"sum(mp) OVER {_frame(3)}", "mp_l3")}, {r(f"avg(mp) OVER {_frame(3)}", "mp_avg_l3")}, {", ".join(cols)} FROM games"""


BOX_ROLLING = _box_sql()

QUERIES = {
    "rolling_mean": (rolling_mean, ROLLING_MEAN),
    "rolling_std": (rolling_std, ROLLING_STD),
    "rolling_sum3": (rolling_sum3, ROLLING_SUM3),
    "prev_high": (prev_high, PREV_HIGH),
    "trend": (trend, TREND),
    "next_value": (next_value, NEXT_VALUE),
    "event_counter": (event_counter, EVENT_COUNTER),
    "nth_event": (nth_event, NTH_EVENT),
    "range_counts": (range_counts, RANGE_COUNTS),
    "days_rest": (days_rest, DAYS_REST),
    "entity_gap": (entity_gap, ENTITY_GAP),
    "simple_schedule": (simple_schedule, SIMPLE_SCHEDULE),
    "history_edge": (history_edge, HISTORY_EDGE),
    "running_count": (running_count, RUNNING_COUNT),
    "box_rolling": (box_rolling, BOX_ROLLING),
}
