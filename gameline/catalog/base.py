"""Shared SQL views of the check queries."""

from __future__ import annotations

OBS = """obs AS (
  SELECT o_custkey AS player, CAST(o_orderdate AS DATE) AS game_date, o_orderkey AS seq,
         CAST(floor(o_totalprice / 10000) AS DOUBLE) AS value, o_orderstatus AS res, o_orderpriority AS prop
  FROM orders)"""

EVENTS = """ev AS (
  SELECT user_id AS player, CAST(ts AS DATE) AS game_date, event_id AS seq, value, event_type AS prop FROM events)"""

GAMES = """by_order AS (
  SELECT l_orderkey, CAST(floor(sum(l_quantity) / 5) AS DOUBLE) AS pts, CAST(count(*) AS DOUBLE) AS trb,
         CAST(sum(l_linenumber) AS DOUBLE) AS ast,
         floor(1.75::DOUBLE * sqrt(CAST(sum(floor(l_extendedprice / 1000)) AS DOUBLE))) AS mp,
         sum(round(l_tax * 100)) AS fga,
         sum(round(l_discount * 100)) AS fg_pct,
         CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS "3pa",
         CAST(count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS DOUBLE) AS "3p_pct",
         CAST(count(*) FILTER (l_returnflag = 'N') AS DOUBLE) AS fta,
         CAST(count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS DOUBLE) AS ft_pct,
         CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS tov,
         CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) AS stl,
         CAST(count(*) FILTER (l_linenumber = 1) AS DOUBLE) AS blk,
         CAST(sum(s_nationkey) AS BIGINT) AS sides
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey),
games AS (
  SELECT o_custkey AS player, CAST(o_orderdate AS DATE) AS game_date, o_orderkey AS seq,
         CAST(c_nationkey % 5 AS BIGINT) AS tm, (c_nationkey % 5 + 1 + sides % 4) % 5 AS opp,
         CASE o_orderstatus WHEN 'F' THEN 'W' WHEN 'P' THEN 'L' END AS res,
         pts, trb, ast, mp, fga, fg_pct, "3pa", "3p_pct", fta, ft_pct, tov, stl, blk
  FROM by_order JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

PREDICTIONS = OBS + """,
rolled AS (
  SELECT *, row_number() OVER w - 1 AS games_played,
         avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS value_l5,
         avg(value) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS value_l10
  FROM obs WINDOW w AS (PARTITION BY player ORDER BY game_date, seq)),
preds AS (
  SELECT player, game_date, seq, prop, value AS actual, value_l5 AS predicted, value_l10 AS line
  FROM rolled WHERE games_played >= 5)"""

BETS = PREDICTIONS + """,
bets AS (
  SELECT *, abs(predicted - line) AS edge, CASE WHEN predicted > line THEN 'OVER' ELSE 'UNDER' END AS direction,
         CASE WHEN (predicted > line AND actual > line) OR (predicted <= line AND actual < line)
              THEN 1 ELSE 0 END AS won,
         CASE WHEN (predicted > line AND actual > line) OR (predicted <= line AND actual < line)
              THEN 100.0::DOUBLE / 110 ELSE -1.0::DOUBLE END AS profit
  FROM preds)"""

QUOTES = """quotes AS (
  SELECT l_partkey AS player, l_returnflag AS market, l_suppkey AS book,
         CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS line,
         CASE l_linenumber WHEN 1 THEN -110 WHEN 2 THEN 120 WHEN 3 THEN -105 ELSE 100 END AS odds,
         l_orderkey AS game_id, l_linestatus AS home, CAST(l_shipdate AS DATE) AS game_time
  FROM lineitem)"""


def metrics(rows: str, by: str = "") -> str:
    """Decision metrics over a relation, optionally by one column."""
    lead = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""SELECT {lead}count(*) AS total_bets, CAST(sum(won) AS BIGINT) AS wins,
  CAST(count(*) - sum(won) AS BIGINT) AS losses, round(avg(won::DOUBLE), 6) + 0.0 AS win_rate,
  round(avg(won::DOUBLE) * 100, 6) + 0.0 AS win_rate_pct, round(sum(profit), 6) + 0.0 AS total_profit,
  round(sum(profit) / count(*) * 100, 6) + 0.0 AS roi, round(avg(edge), 6) + 0.0 AS avg_edge,
  CAST(avg(won::DOUBLE) > 0.5238 AS BIGINT) AS profitable FROM {rows}{tail}"""


def r(expr: str, name: str | None = None) -> str:
    """Rounded double for comparison."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr}"


# an outcome column over a (direction, actual, line) row
def graded(direction: str, actual: str, line: str) -> str:
    return f"""CASE WHEN {actual} = {line} THEN 'PUSH'
  WHEN ({direction} = 'OVER' AND {actual} > {line}) OR ({direction} = 'UNDER' AND {actual} < {line}) THEN 'WIN'
  WHEN {actual} IS NULL OR {line} IS NULL OR {direction} IS NULL THEN NULL ELSE 'LOSS' END"""


def payout(odds: str, result: str, stake: float = 100.0) -> str:
    return f"""CASE {result} WHEN 'WIN' THEN CASE WHEN {odds} > 0 THEN {stake}::DOUBLE * {odds} / 100
  ELSE {stake}::DOUBLE * (100.0::DOUBLE / abs({odds})) END WHEN 'LOSS' THEN -{stake}::DOUBLE WHEN 'PUSH' THEN 0.0 END"""
