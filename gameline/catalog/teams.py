"""Team totals, opponent context, schedules, rosters and latest state."""

from __future__ import annotations

from pyspark.sql import functions as F

from gameline.catalog.base import GAMES, OBS, r
from gameline.operators import context, latest, rolling, schedule
from gameline.plans.views import game_players, games, observations, tidy

TEAMS = GAMES + """,
teams AS (SELECT tm, game_date, opp, sum(pts) AS tm_pts, sum(trb) AS tm_trb, sum(ast) AS tm_ast, sum(fga) AS tm_fga,
            sum("3pa") AS tm_3pa, sum(tov) AS tm_tov, sum(mp) AS tm_mp, count(player) AS tm_players_used
          FROM games GROUP BY ALL)"""
MIRROR = TEAMS + """,
mirror AS (SELECT a.*, b.tm_pts AS pts_allowed, b.tm_trb AS trb_allowed, b.tm_ast AS ast_allowed,
             b.tm_fga AS fga_allowed
           FROM teams a LEFT JOIN teams b ON a.opp = b.tm AND a.game_date = b.game_date AND a.tm = b.opp)"""
_TF = "(PARTITION BY tm ORDER BY game_date, opp ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
_FORM = ["pts_allowed", "trb_allowed", "ast_allowed", "fga_allowed", "tm_pts", "tm_trb", "tm_ast", "tm_fga"]
FORM = MIRROR + f""",
form AS (SELECT *, {", ".join(f"CASE WHEN count({c}) OVER {_TF} >= 3 THEN avg({c}) OVER {_TF} END AS {c}_l10" for c in _FORM)}
         FROM mirror)"""
RANKED = FORM + f""",
ranked AS (SELECT *, {", ".join(
    f"CASE WHEN {c}_allowed_l10 IS NOT NULL THEN rank() OVER (PARTITION BY game_date ORDER BY {c}_allowed_l10 NULLS LAST)"
    f" + (count(*) OVER (PARTITION BY game_date, {c}_allowed_l10) - 1) / 2.0::DOUBLE END AS {c}_allowed_rank"
    for c in ("pts", "trb", "ast", "fga"))} FROM form)"""


def team_totals(spark, sf):
    return tidy(context.team_totals(games(spark, sf)))


TEAM_TOTALS = f"""WITH {TEAMS} SELECT tm, CAST(game_date AS VARCHAR) AS game_date, opp, tm_players_used,
  {", ".join(r(f"tm_{c}") for c in context.TEAM_SUMS)} FROM teams"""


def mirror_allowed(spark, sf):
    m = context.mirror_allowed(context.team_totals(games(spark, sf)))
    return tidy(m.select("tm", "game_date", "opp", *[f"{c}_allowed" for c in context.ALLOWED]))


MIRROR_ALLOWED = f"""WITH {MIRROR} SELECT tm, CAST(game_date AS VARCHAR) AS game_date, opp,
  {", ".join(r(f"{c}_allowed") for c in context.ALLOWED)} FROM mirror"""


def team_form(spark, sf):
    t = context.team_context(games(spark, sf))
    return tidy(t.select("tm", "game_date", "opp", *[f"{c}_l10" for c in _FORM],
                         *[f"{c}_allowed_rank" for c in context.ALLOWED]))


TEAM_FORM = f"""WITH {RANKED} SELECT tm, CAST(game_date AS VARCHAR) AS game_date, opp,
  {", ".join(r(f"{c}_l10") for c in _FORM)}, {", ".join(r(f"{c}_allowed_rank") for c in context.ALLOWED)} FROM ranked"""


def opponent_context(spark, sf):
    g = games(spark, sf)
    joined = context.attach_opponent(g, context.team_context(g))
    return tidy(joined.select("player", "seq", "tm", "opp", *[f"opp_{c}" for c in context.OPPONENT_COLUMNS]))


OPPONENT_CONTEXT = f"""WITH {RANKED} SELECT g.player, g.seq, g.tm, g.opp,
  {", ".join(r(f"t.{c}", f"opp_{c}") for c in context.OPPONENT_COLUMNS)}
FROM games g LEFT JOIN ranked t ON t.tm = g.opp AND t.game_date = g.game_date AND t.opp = g.tm"""


def avg_rank(spark, sf):
    return tidy(context.average_rank(observations(spark, sf), "value", "value_rank").select("seq", "value", "value_rank"))


AVG_RANK = f"""WITH {OBS} SELECT seq, {r('value')}, {r('''rank() OVER (PARTITION BY game_date ORDER BY value)
  + (count(*) OVER (PARTITION BY game_date, value) - 1) / 2.0''', 'value_rank')} FROM obs"""


def dense_rank_desc(spark, sf):
    return tidy(context.dense_rank_desc(observations(spark, sf), "value", "value_rank").select("seq", "value_rank"))


DENSE_RANK_DESC = f"""WITH {OBS} SELECT seq,
  {r("dense_rank() OVER (PARTITION BY game_date ORDER BY value DESC)", "value_rank")} FROM obs"""

OPPONENT_MEANS = """om AS (SELECT opp, game_date, avg(pts) AS pts_allowed, avg(trb) AS trb_allowed, avg(ast) AS ast_allowed,
  avg(fga) AS fga_allowed FROM games GROUP BY ALL),
omf AS (SELECT *, avg(pts_allowed) OVER w AS pts_allowed_l10, avg(trb_allowed) OVER w AS trb_allowed_l10,
  avg(ast_allowed) OVER w AS ast_allowed_l10, avg(fga_allowed) OVER w AS fga_allowed_l10
  FROM om WINDOW w AS (PARTITION BY opp ORDER BY game_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


def opponent_mean(spark, sf):
    return tidy(context.opponent_means(games(spark, sf)))


OPPONENT_MEAN = f"""WITH {GAMES}, {OPPONENT_MEANS} SELECT opp, CAST(game_date AS VARCHAR) AS game_date,
  {", ".join(r(f"{c}_allowed") + ", " + r(f"{c}_allowed_l10") for c in context.ALLOWED)} FROM omf"""


def neutral_fill(spark, sf):
    g = games(spark, sf)
    m = context.opponent_means(g).select("opp", "game_date", "pts_allowed_l10", "fga_allowed_l10")
    joined = g.select("player", "seq", "opp", "game_date").join(m, ["opp", "game_date"], "left")
    ranked = context.dense_rank_desc(joined, "pts_allowed_l10", "pts_allowed_rank")
    filled = context.neutral_fill(ranked, ["pts_allowed_l10", "fga_allowed_l10"], {"pts_allowed_rank": 15.0})
    return tidy(filled.select("player", "seq", "pts_allowed_l10", "fga_allowed_l10", "pts_allowed_rank"))


NEUTRAL_FILL = f"""WITH {GAMES}, {OPPONENT_MEANS}, j AS (SELECT g.player, g.seq, g.game_date, pts_allowed_l10, fga_allowed_l10,
  CASE WHEN pts_allowed_l10 IS NOT NULL
       THEN dense_rank() OVER (PARTITION BY g.game_date ORDER BY pts_allowed_l10 DESC NULLS LAST) END AS rk
  FROM games g LEFT JOIN omf m ON g.opp = m.opp AND g.game_date = m.game_date)
SELECT player, seq, {r("coalesce(pts_allowed_l10, avg(pts_allowed_l10) OVER ())", "pts_allowed_l10")},
  {r("coalesce(fga_allowed_l10, avg(fga_allowed_l10) OVER ())", "fga_allowed_l10")},
  {r("coalesce(rk, 15)", "pts_allowed_rank")} FROM j"""


def schedule_join(spark, sf):
    g = games(spark, sf).select("player", "seq", "tm", "game_date")
    return tidy(schedule.attach_schedule(g, schedule.team_schedule(g)), "days_rest", "games_last_7d", "games_last_14d")


_DW = "PARTITION BY tm ORDER BY game_date"
SCHEDULE = f"""days AS (SELECT DISTINCT tm, game_date FROM games),
sched AS (SELECT tm, game_date, game_date - lag(game_date) OVER ({_DW}) AS days_rest,
  nullif(count(*) OVER ({_DW} RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS games_last_7d,
  nullif(count(*) OVER ({_DW} RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS games_last_14d
  FROM days)"""
SCHEDULE_JOIN = f"""WITH {GAMES}, {SCHEDULE} SELECT player, seq, tm, CAST(game_date AS VARCHAR) AS game_date,
  {r('days_rest')}, CAST(coalesce(days_rest <= 1, false) AS BIGINT) AS is_b2b,
  CAST(coalesce(days_rest = 1, false) AS BIGINT) AS is_b2b_second, {r('games_last_7d')}, {r('games_last_14d')}
FROM games JOIN sched USING (tm, game_date)"""


def distinct_keys(spark, sf):
    return tidy(schedule.distinct_dates(games(spark, sf)))


DISTINCT_KEYS = f"WITH {GAMES} SELECT DISTINCT tm, CAST(game_date AS VARCHAR) AS game_date FROM games"


def _with_minutes(spark, sf):
    spec = rolling.RollingSpec(stats=["mp"], means={10: 1}, counter=None)
    return rolling.rolling_features(games(spark, sf).select("player", "game_date", "seq", "tm", "opp", "mp"), spec, bound=game_players(spark, sf))


MINUTES = GAMES + """,
m AS (SELECT player, game_date, seq, tm, opp, mp,
        avg(mp) OVER (PARTITION BY player ORDER BY game_date, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mp_l10
      FROM games)"""


def latest_nonnull(spark, sf):
    v = latest.latest_values(_with_minutes(spark, sf), ["player"], ["game_date", "seq"], ["tm", "opp", "mp", "mp_l10"])
    return tidy(v)


LATEST_NONNULL = f"""WITH {MINUTES} SELECT player, max_by(tm, (game_date, seq)) AS tm, max_by(opp, (game_date, seq)) AS opp,
  {r("max_by(mp, (game_date, seq))", "mp")},
  {r("max_by(mp_l10, (game_date, seq)) FILTER (mp_l10 IS NOT NULL)", "mp_l10")} FROM m GROUP BY player"""


def latest_row(spark, sf):
    return tidy(latest.latest_row(_with_minutes(spark, sf), ["player"], ["game_date", "seq"]))


LATEST_ROW = f"""WITH {MINUTES} SELECT player, CAST(game_date AS VARCHAR) AS game_date, seq, tm, opp, {r('mp')},
  {r('mp_l10')} FROM m QUALIFY row_number() OVER (PARTITION BY player ORDER BY game_date DESC, seq DESC) = 1"""


def roster_expand(spark, sf):
    """Rosters of the region pairs that shipped to each other on the newest date."""
    m = _with_minutes(spark, sf)
    fixtures = (m.where(F.col("game_date") == m.agg(F.max("game_date")).scalar())
                .select(F.col("tm").alias("home"), F.col("opp").alias("away")).distinct())
    return tidy(latest.roster_for_games(m, fixtures, min_minutes=15.0))


ROSTER_EXPAND = f"""WITH {MINUTES},
fixtures AS (SELECT DISTINCT tm AS home, opp AS away FROM m WHERE game_date = (SELECT max(game_date) FROM m)),
sides AS (SELECT home AS team, away AS opponent FROM fixtures UNION ALL SELECT away, home FROM fixtures),
dates AS (SELECT tm, game_date FROM (SELECT DISTINCT tm, game_date FROM m)
          QUALIFY row_number() OVER (PARTITION BY tm ORDER BY game_date DESC) <= 5),
roster AS (SELECT tm, player, max_by(mp_l10, (game_date, seq)) FILTER (mp_l10 IS NOT NULL) AS mp_l10
           FROM m JOIN dates USING (tm, game_date) GROUP BY ALL)
SELECT team, opponent, player, {r('mp_l10')} FROM sides JOIN roster ON team = tm WHERE mp_l10 >= 15"""


def recently_active(spark, sf):
    return tidy(latest.recently_active(_with_minutes(spark, sf), min_minutes=15.0, days=30))


RECENTLY_ACTIVE = f"""WITH {MINUTES}, x AS (
  SELECT player, max_by(tm, (game_date, seq)) AS tm, max_by(opp, (game_date, seq)) AS opp,
    max_by(mp_l10, (game_date, seq)) FILTER (mp_l10 IS NOT NULL) AS mp_l10, max(game_date) AS game_date
  FROM m WHERE game_date >= (SELECT max(game_date) FROM m) - 30 GROUP BY player)
SELECT player, tm, opp, {r('mp_l10')}, CAST(game_date AS VARCHAR) AS game_date FROM x WHERE mp_l10 >= 15"""

QUERIES = {
    "team_totals": (team_totals, TEAM_TOTALS),
    "mirror_allowed": (mirror_allowed, MIRROR_ALLOWED),
    "team_form": (team_form, TEAM_FORM),
    "opponent_context": (opponent_context, OPPONENT_CONTEXT),
    "avg_rank": (avg_rank, AVG_RANK),
    "dense_rank_desc": (dense_rank_desc, DENSE_RANK_DESC),
    "opponent_mean": (opponent_mean, OPPONENT_MEAN),
    "neutral_fill": (neutral_fill, NEUTRAL_FILL),
    "schedule_join": (schedule_join, SCHEDULE_JOIN),
    "distinct_keys": (distinct_keys, DISTINCT_KEYS),
    "latest_nonnull": (latest_nonnull, LATEST_NONNULL),
    "latest_row": (latest_row, LATEST_ROW),
    "roster_expand": (roster_expand, ROSTER_EXPAND),
    "recently_active": (recently_active, RECENTLY_ACTIVE),
}
