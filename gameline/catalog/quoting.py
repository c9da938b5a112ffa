"""Quotes and lines: flattening, consolidation and matching names to entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from gameline.catalog.base import OBS, QUOTES, r
from gameline.catalog.datasets import RECENT, STATE, over_under_select, recent_state
from gameline.operators import latest, lines, overunder, rolling
from gameline.plans.views import observations, quotes, table, tidy
from gameline.sources import feeds


def quote_flatten(spark, sf):
    """One nested document per line item, flattened again."""
    li = table(spark, sf, "lineitem")
    over = F.struct(F.lit("Over").alias("name"), F.concat(F.lit("P"), F.col("l_partkey")).alias("description"),
                    F.when(F.col("l_linenumber") == 4, 0.0).otherwise(F.col("l_quantity") + 0.5).alias("point"),
                    F.when(F.col("l_linenumber") == 5, F.lit(None).cast("int")).otherwise(100 + F.col("l_linenumber")).alias("price"))
    under = F.struct(F.lit("Under").alias("name"), over.getField("description").alias("description"),
                     over.getField("point").alias("point"), over.getField("price").alias("price"))
    market = F.struct(F.col("l_returnflag").alias("key"), F.array(over, under).alias("outcomes"))
    book = F.struct(F.concat(F.lit("S"), F.col("l_suppkey")).alias("key"), F.array(market).alias("markets"))
    docs = li.select("l_orderkey", F.to_json(F.struct(
        F.col("l_orderkey").cast("string").alias("id"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("commence_time"),
        F.col("l_linestatus").alias("home_team"), F.array(book).alias("bookmakers"))).alias("payload"))
    q = feeds.flatten_quotes(docs, keep=["l_orderkey"])
    return tidy(q.withColumn("game_time", F.to_date("game_time")))


QUOTE_FLATTEN = f"""SELECT l_orderkey, 'P' || l_partkey AS player, l_returnflag AS market, {r('l_quantity + 0.5', 'line')},
  CAST(CASE WHEN l_linenumber = 5 THEN -110 ELSE 100 + l_linenumber END AS BIGINT) AS odds, 'S' || l_suppkey AS book,
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS game_time, l_linestatus AS home, '' AS away
FROM lineitem WHERE l_linenumber <> 4"""


def quote_consolidate(spark, sf):
    """Mean line and best price per part and flag; ties of the first quote go to the lowest order and supplier."""
    q = quotes(spark, sf).withColumn("pos", F.struct("game_id", "book", "game_time", "home"))
    return tidy(latest.consolidate_quotes(q, "pos", first=["game_time", "home"]))


QUOTE_CONSOLIDATE = f"""WITH {QUOTES} SELECT player, market, {r('avg(line)', 'line')}, CAST(max(odds) AS BIGINT) AS odds,
  CAST(min_by(game_time, (game_id, book, game_time, home)) AS VARCHAR) AS game_time,
  min_by(home, (game_id, book, game_time, home)) AS home FROM quotes GROUP BY player, market"""


def _latest(spark, sf):
    spec = rolling.RollingSpec(stats=["value"], means={5: 1, 10: 1})
    rolled = rolling.rolling_features(observations(spark, sf), spec)
    return latest.latest_values(rolled, ["player"], ["game_date", "seq"], ["value_l5", "value_l10", "games_played"])


LATEST = OBS + """,
rl AS (SELECT *, row_number() OVER w - 1 AS games_played, avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS value_l5,
  avg(value) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS value_l10
  FROM obs WINDOW w AS (PARTITION BY player ORDER BY game_date, seq)),
lt AS (SELECT player, max_by(value_l5, (game_date, seq)) FILTER (value_l5 IS NOT NULL) AS value_l5,
  max_by(value_l10, (game_date, seq)) FILTER (value_l10 IS NOT NULL) AS value_l10, max(games_played) AS games_played
  FROM rl GROUP BY player)"""


def line_match_exact(spark, sf):
    """Consolidated quotes joined to the latest state of the entity with the same key."""
    q = latest.consolidate_quotes(quotes(spark, sf), "game_id", first=[])
    return tidy(lines.match_lines(q, _latest(spark, sf), fuzzy=False).drop("matched"))


LINE_MATCH_EXACT = f"""WITH {LATEST}, {QUOTES}, cq AS (SELECT player, market, avg(line) AS line, max(odds) AS odds
  FROM quotes GROUP BY player, market)
SELECT cq.player, market, {r('line')}, CAST(odds AS BIGINT) AS odds, {r('value_l5')}, {r('value_l10')}, games_played
FROM cq JOIN lt ON cq.player = lt.player"""

_WANTED = """CASE o_orderstatus WHEN 'O' THEN c_name WHEN 'F' THEN 'Buyer #' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
  ELSE 'Buyer ' || CAST(o_custkey AS VARCHAR) END"""


def _named_lines(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_custkey").cast("string")
    wanted = (F.when(F.col("o_orderstatus") == "O", F.col("c_name"))
              .when(F.col("o_orderstatus") == "F", F.concat(F.lit("Buyer #"), F.lpad(key, 9, "0")))
              .otherwise(F.concat(F.lit("Buyer "), key)))
    return o.select(wanted.alias("player"), "o_orderkey", F.floor(F.col("o_totalprice") / 10000).alias("line"))


def line_match_fuzzy(spark, sf):
    """Names spelled three ways against customer names."""
    known = table(spark, sf, "customer").select(F.col("c_name").alias("player"), "c_acctbal")
    return tidy(lines.match_lines(_named_lines(spark, sf), known).select("player", "matched", "how", "o_orderkey", "c_acctbal"))


LINE_MATCH_FUZZY = f"""WITH ln AS (SELECT {_WANTED} AS player, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT DISTINCT player FROM ln), ex AS (SELECT player, player AS matched, 'exact' AS how FROM w WHERE player IN (SELECT c_name FROM customer)),
op AS (SELECT player, lower(regexp_extract(player, '(\\S+)\\s*$', 1)) AS word FROM w WHERE player NOT IN (SELECT c_name FROM customer)),
fz AS (SELECT player, min(c_name) AS matched, 'word' AS how FROM op JOIN customer ON contains(lower(c_name), word)
       GROUP BY player HAVING count(*) = 1)
SELECT ln.player, matched, how, o_orderkey, {r('c_acctbal')} FROM ln
JOIN (SELECT * FROM ex UNION ALL SELECT * FROM fz) m ON ln.player = m.player JOIN customer ON c_name = matched"""


def line_features(spark, sf):
    """The model features at scoring time: quoted lines on the latest state of each entity."""
    state = latest.latest_values(recent_state(spark, sf), ["player"], ["game_date", "seq"])
    q = latest.consolidate_quotes(quotes(spark, sf), "game_id", first=[]).withColumnRenamed("line", "quoted")
    joined = lines.match_lines(q, state.drop("seq", "tm"), fuzzy=False)
    out = overunder.over_under_features(joined, "pts", F.col("quoted"), consistent_below=5.0, missing_to_line=True)
    return tidy(out.select("player", "market", *[F.col(c).cast("double") for c in overunder.OVER_UNDER_FEATURES]))


_LAST = ", ".join(f"max_by({c}, (game_date, seq)) FILTER ({c} IS NOT NULL) AS {c}" for c in (
    "l5", "l10", "l20", "sd", "mp_l10", "hm", "days_rest", "games_last_7d"))
LINE_FEATURES = f"""WITH {RECENT}, {QUOTES}, cq AS (SELECT player, market, avg(line) AS line FROM quotes GROUP BY player, market),
j0 AS (SELECT player, {_LAST} FROM g JOIN sched USING (tm, game_date) GROUP BY player),
j AS (SELECT cq.player, market, line, coalesce(l5, line) AS l5, coalesce(l10, line) AS l10, coalesce(l20, line) AS l20,
  sd, mp_l10, hm, days_rest, games_last_7d FROM cq JOIN j0 USING (player)),
x AS (SELECT player, market, l10 - line AS a, l5 - line AS b, l20 - line AS c, {STATE} FROM j)
{over_under_select('x', '5.0', 'player, market')}"""

QUERIES = {
    "quote_flatten": (quote_flatten, QUOTE_FLATTEN),
    "quote_consolidate": (quote_consolidate, QUOTE_CONSOLIDATE),
    "line_match_exact": (line_match_exact, LINE_MATCH_EXACT),
    "line_match_fuzzy": (line_match_fuzzy, LINE_MATCH_FUZZY),
    "line_features": (line_features, LINE_FEATURES),
}
