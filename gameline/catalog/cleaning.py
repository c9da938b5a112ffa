"""Cleaning, keys, feeds and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gameline.catalog.base import GAMES, OBS, r
from gameline.functions import numeric, text
from gameline.operators import dataset, latest, lines, stats
from gameline.plans.views import games, observations, table, tidy
from gameline.sources import feeds


def clean_keys(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("game_date", F.to_date("o_orderdate")).withColumn(
        "res", F.when(F.col("o_orderstatus") == "F", "W").when(F.col("o_orderstatus") == "P", "L"))
    return tidy(o.select(
        "o_orderkey", text.event_key("game_date", "o_orderpriority", "c_name", "res").alias("game_id"),
        text.pair_key("game_date", "c_mktsegment", "o_orderpriority").alias("matchup_id"),
        text.versus_key("c_name", "c_mktsegment").alias("versus_id"), text.won("res").alias("won")))


CLEAN_KEYS = """SELECT o_orderkey,
  strftime(o_orderdate, '%Y%m%d') || '_' || replace(o_orderpriority, ' ', '_') || '_' || c_name || '_' || res AS game_id,
  strftime(o_orderdate, '%Y%m%d') || '_' || least(c_mktsegment, o_orderpriority) || '_'
    || greatest(c_mktsegment, o_orderpriority) AS matchup_id,
  c_name || '_vs_' || c_mktsegment AS versus_id, CAST(coalesce(res = 'W', false) AS BIGINT) AS won
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'W' WHEN 'P' THEN 'L' END AS res
      FROM orders JOIN customer ON o_custkey = c_custkey)"""


def numeric_coerce(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("string")).when(
        F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
    o = table(spark, sf, "orders").withColumn("raw", raw)
    return tidy(o.select("o_orderkey", numeric.coerce("raw").alias("number"),
                         numeric.coerce("raw", 0.0).alias("filled")))


NUMERIC_COERCE = f"""SELECT o_orderkey, {r('try_cast(raw AS DOUBLE)', 'number')},
  {r('coalesce(try_cast(raw AS DOUBLE), 0)', 'filled')}
FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN CAST(o_totalprice AS VARCHAR) WHEN 'P' THEN o_orderpriority END AS raw
      FROM orders)"""


def parse_minutes(spark, sf):
    raw = (F.when(F.col("l_returnflag") == "A", F.concat(
        F.col("l_quantity").cast("int").cast("string"), F.lit(":"),
        F.lpad((F.col("l_linenumber") * 7).cast("string"), 2, "0")))
        .when(F.col("l_returnflag") == "N", F.col("l_linenumber").cast("string")).otherwise(F.col("l_linestatus")))
    li = table(spark, sf, "lineitem").withColumn("raw", raw)
    return tidy(li.select("l_orderkey", "l_linenumber", "raw", text.minutes("raw").alias("minutes")))


PARSE_MINUTES = f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, raw,
  {r('''CASE WHEN contains(raw, ':') THEN coalesce(try_cast(split_part(raw, ':', 1) AS DOUBLE)
        + try_cast(split_part(raw, ':', 2) AS DOUBLE) / 60, 0) ELSE coalesce(try_cast(raw AS DOUBLE), 0) END''', 'minutes')}
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ':'
        || lpad(CAST(l_linenumber * 7 AS VARCHAR), 2, '0')
        WHEN 'N' THEN CAST(l_linenumber AS VARCHAR) ELSE l_linestatus END AS raw FROM lineitem)"""


def score_formula(spark, sf):
    score = numeric.game_score(pts="pts", fg="fga", fga="trb", ft="3pa", fta="fta", orb="ast", drb="mp", stl="stl",
                               ast="ast", blk="blk", pf="tov", tov="tov")
    return tidy(games(spark, sf).select("seq", score.alias("gmsc")))


SCORE_FORMULA = f"""WITH {GAMES} SELECT seq, round(round_even(pts + 0.4 * fga - 0.7 * trb - 0.4 * (fta - "3pa")
  + 0.7 * ast + 0.3 * mp + stl + 0.7 * ast + 0.7 * blk - 0.4 * tov - tov, 1), 6) + 0.0 AS gmsc FROM games"""


def combo_targets(spark, sf):
    g = dataset.combo_targets(games(spark, sf), proxies=None)
    return tidy(g.select("seq", "pra", "pr", "pa"))


COMBO_TARGETS = f"""WITH {GAMES} SELECT seq, {r('pts + trb + ast', 'pra')}, {r('pts + trb', 'pr')},
  {r('pts + ast', 'pa')} FROM games"""


def season_label(spark, sf):
    return tidy(observations(spark, sf).select("seq", text.season("game_date").alias("season")))


_SEASON = """CASE WHEN month(game_date) >= 10 THEN year(game_date) ELSE year(game_date) - 1 END"""
SEASON_LABEL = f"""WITH {OBS} SELECT seq, CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season
  FROM (SELECT seq, {_SEASON} AS y FROM obs)"""


def unpivot_props(spark, sf):
    return tidy(stats.unpivot(games(spark, sf), ["player", "game_date", "seq"], ["pts", "trb", "ast"], "prop", "actual"))


UNPIVOT_PROPS = f"""WITH {GAMES} SELECT player, CAST(game_date AS VARCHAR) AS game_date, seq, prop,
  {r('actual')} FROM (UNPIVOT (SELECT player, game_date, seq, pts, trb, ast FROM games) ON pts, trb, ast
  INTO NAME prop VALUE actual)"""


def upsert_latest(spark, sf):
    old = observations(spark, sf).select("player", "game_date", "seq", "value")
    new = observations(spark, sf).where(F.col("res") == "O").select(
        "player", "game_date", "seq", (F.col("value") + 1).alias("value"))
    return tidy(latest.upsert(old, new, ["player", "game_date"], ["seq"]))


UPSERT_LATEST = f"""WITH {OBS}, tagged AS (
  SELECT 0 AS batch, player, game_date, seq, value FROM obs
  UNION ALL SELECT 1, player, game_date, seq, value + 1 FROM obs WHERE res = 'O')
SELECT player, CAST(game_date AS VARCHAR) AS game_date, seq, {r('value')} FROM tagged
QUALIFY row_number() OVER (PARTITION BY player, game_date ORDER BY batch DESC, seq DESC) = 1"""


def freshness(spark, sf):
    by_day = F.lit("2001-08-03").cast("date")
    return tidy(latest.freshness(observations(spark, sf), by_day))


FRESHNESS = f"""WITH {OBS} SELECT CAST(max(game_date) AS VARCHAR) AS last_date, count(*) AS row_count,
  CAST(DATE '2001-08-03' - max(game_date) AS BIGINT) AS days_old,
  CAST(DATE '2001-08-03' - max(game_date) > 1 AS BIGINT) AS needs_update FROM obs"""


def season_union(spark, sf):
    o = observations(spark, sf).select("player", "game_date", "seq", "value", "prop")
    turn = F.lit("1998-10-01").cast("date")
    return tidy(feeds.union_seasons({
        "early": o.where(F.col("game_date") < turn).drop("prop"), "late": o.where(F.col("game_date") >= turn)})
        .select("player", "game_date", "seq", "value", "prop", "season"))


SEASON_UNION = f"""WITH {OBS} SELECT player, CAST(game_date AS VARCHAR) AS game_date, seq, {r('value')},
  CASE WHEN game_date >= DATE '1998-10-01' THEN prop END AS prop,
  CASE WHEN game_date >= DATE '1998-10-01' THEN 'late' ELSE 'early' END AS season FROM obs"""


def period_breakdown(spark, sf):
    o = observations(spark, sf).withColumn("season", text.season("game_date"))
    return tidy(o.groupBy("season").agg(
        F.count(F.lit(1)).alias("games"), F.countDistinct("player").alias("players"),
        F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date")))


PERIOD_BREAKDOWN = f"""WITH {OBS}, s AS (SELECT *, {_SEASON} AS y FROM obs)
SELECT CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, count(*) AS games,
  count(DISTINCT player) AS players, CAST(min(game_date) AS VARCHAR) AS first_date,
  CAST(max(game_date) AS VARCHAR) AS last_date FROM s GROUP BY y"""


def parse_opponent(spark, sf):
    sep = F.when(F.col("o_orderstatus") == "O", " vs. ").when(F.col("o_orderstatus") == "F", " @ ").otherwise(" ")
    o = (table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
         .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
         .withColumn("matchup", F.concat("n_name", sep, "c_mktsegment")))
    opp, side = text.opponent_side("matchup", "n_name")
    return tidy(o.select("o_orderkey", text.opponent_token("matchup").alias("token"),
                         text.opponent_code("matchup").alias("code"), opp.alias("opp"), side.alias("side"),
                         text.home_flag("matchup").alias("is_home")))


PARSE_OPPONENT = """WITH m AS (
  SELECT o_orderkey, n_name, c_mktsegment, n_name || CASE o_orderstatus WHEN 'O' THEN ' vs. ' WHEN 'F' THEN ' @ '
    ELSE ' ' END || c_mktsegment AS matchup
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT o_orderkey,
  CASE WHEN split_part(replace(matchup, '.', ''), ' ', 2) IN ('vs', '@')
       THEN split_part(replace(matchup, '.', ''), ' ', 3) END AS token,
  nullif(regexp_extract(matchup, '(vs\\.|@)\\s+([A-Z]{3})', 2), '') AS code,
  CASE WHEN contains(matchup, ' vs. ') THEN split_part(matchup, ' vs. ', 2)
       WHEN contains(matchup, ' @ ') THEN split_part(matchup, ' @ ', 2) ELSE 'UNK' END AS opp,
  CASE WHEN contains(matchup, ' vs. ') THEN 'H' WHEN contains(matchup, ' @ ') THEN 'A' ELSE 'U' END AS side,
  CAST(regexp_matches(matchup, 'vs.') AS BIGINT) AS is_home
FROM m"""


def code_map(spark, sf):
    codes = table(spark, sf, "nation").where(F.col("n_regionkey") != 0).select(
        F.col("n_nationkey").cast("string").alias("raw"), F.col("n_name").alias("mapped"))
    c = table(spark, sf, "customer").withColumn("code", F.col("c_nationkey").cast("string"))
    return tidy(lines.map_codes(c, codes, "code", "team").select("c_custkey", "team"))


CODE_MAP = """SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS team FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 0"""


def _log(spark, sf):
    """Orders with lines in the columns of a landed game log."""
    g = games(spark, sf).join(
        table(spark, sf, "nation").select((F.col("n_nationkey")).cast("long").alias("opp"), F.col("n_name")), "opp")
    return g.select(
        F.concat(F.lit("Player "), F.col("player").cast("string")).alias("PLAYER_NAME"),
        F.concat(F.lit("T"), F.col("tm").cast("string")).alias("TEAM_ABBREVIATION"),
        F.concat(F.lit("T"), F.col("tm").cast("string"), F.when(F.col("pts") > 20, " vs. ").otherwise(" @ "),
                 F.col("n_name")).alias("MATCHUP"),
        F.col("game_date").cast("string").alias("GAME_DATE"), F.col("res").alias("WL"),
        F.concat(F.col("mp").cast("int").cast("string"), F.lit(":30")).alias("MIN"),
        F.col("seq").cast("string").alias("GAME_ID"),
        *[F.col(a).cast("string").alias(b) for a, b in (
            ("trb", "FGM"), ("fga", "FGA"), ("fg_pct", "FG_PCT"), ("3pa", "FG3A"), ("3p_pct", "FG3_PCT"), ("stl", "FTM"),
            ("fta", "FTA"), ("ft_pct", "FT_PCT"), ("blk", "OREB"), ("trb", "DREB"), ("trb", "REB"), ("ast", "AST"),
            ("stl", "STL"), ("blk", "BLK"), ("tov", "TOV"), ("tov", "PF"), ("pts", "PTS"))])


def feed_clean(spark, sf):
    c = feeds.clean_log(_log(spark, sf))
    return tidy(c.select("player", "tm", "opp", "game_date", "game_id", "matchup_id", "won", "mp", "pts", "gmsc"))


FEED_CLEAN = f"""WITH {GAMES} SELECT 'Player ' || player AS player, 'T' || tm AS tm, n_name AS opp,
  CAST(game_date AS VARCHAR) AS game_date,
  strftime(game_date, '%Y%m%d') || '_Player_' || player || '_T' || tm AS game_id,
  strftime(game_date, '%Y%m%d') || '_' || least('T' || tm, n_name) || '_' || greatest('T' || tm, n_name) AS matchup_id,
  CAST(coalesce(res = 'W', false) AS BIGINT) AS won, {r('floor(mp) + 0.5', 'mp')}, {r('pts')},
  round(round_even(pts + 0.4 * trb - 0.7 * fga - 0.4 * (fta - stl) + 0.7 * blk + 0.3 * trb + stl + 0.7 * ast
    + 0.7 * blk - 0.4 * tov - tov, 1), 6) + 0.0 AS gmsc
FROM games JOIN nation ON opp = n_nationkey"""


def feed_box(spark, sf):
    b = feeds.clean_box(feeds.box_from_log(_log(spark, sf)).withColumn("MP", F.lit(None).cast("double")))
    return tidy(b.select("player", "tm", "opp", "game_date", "game_id", "won", "fg_pct", "trb", "gmsc"))


FEED_BOX = f"""WITH {GAMES} SELECT 'Player ' || player AS player, 'T' || tm AS tm, n_name AS opp,
  CAST(game_date AS VARCHAR) AS game_date,
  strftime(game_date, '%Y%m%d') || '_Player_' || player || '_T' || tm || '_' || n_name AS game_id,
  CAST(coalesce(res = 'W', false) AS BIGINT) AS won, {r('fg_pct')}, {r('trb')},
  round(round_even(pts + 0.4 * trb - 0.7 * fga - 0.4 * (fta - stl) + 0.7 * blk + 0.3 * trb + stl + 0.7 * ast
    + 0.7 * blk - 0.4 * tov - tov, 1), 6) + 0.0 AS gmsc
FROM games JOIN nation ON opp = n_nationkey"""


def event_json(spark, sf):
    """Event documents built from the events table, read back by date."""
    e = table(spark, sf, "events").select(F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("home_team"),
        F.get_json_object("props", "$.k").alias("away_team"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("commence_time"))).alias("payload"))
    return tidy(feeds.events_on(e, F.lit("2024-01-10").cast("date")))


EVENT_JSON = """SELECT event_type AS home, CAST(props ->> '$.k' AS VARCHAR) AS away, strftime(ts, '%I:%M %p') AS time,
  CAST(event_id AS VARCHAR) AS event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'"""

QUERIES = {
    "clean_keys": (clean_keys, CLEAN_KEYS),
    "numeric_coerce": (numeric_coerce, NUMERIC_COERCE),
    "parse_minutes": (parse_minutes, PARSE_MINUTES),
    "score_formula": (score_formula, SCORE_FORMULA),
    "combo_targets": (combo_targets, COMBO_TARGETS),
    "season_label": (season_label, SEASON_LABEL),
    "unpivot_props": (unpivot_props, UNPIVOT_PROPS),
    "upsert_latest": (upsert_latest, UPSERT_LATEST),
    "freshness": (freshness, FRESHNESS),
    "season_union": (season_union, SEASON_UNION),
    "period_breakdown": (period_breakdown, PERIOD_BREAKDOWN),
    "parse_opponent": (parse_opponent, PARSE_OPPONENT),
    "code_map": (code_map, CODE_MAP),
    "feed_clean": (feed_clean, FEED_CLEAN),
    "feed_box": (feed_box, FEED_BOX),
    "event_json": (event_json, EVENT_JSON),
}
