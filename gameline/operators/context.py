"""Team totals, what a team allows, opponent ranks and opponent context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gameline.functions.rows import row_of
from gameline.operators.heat import CHUNK_ROWS, by_heat, running_totals
from gameline.operators.rolling import prior_agg

# fixed values: statistics summed to team level, and the ones mirrored as "allowed"
TEAM_SUMS = ["pts", "trb", "ast", "fga", "3pa", "tov", "mp"]
ALLOWED = ["pts", "trb", "ast", "fga"]
OPPONENT_COLUMNS = ["pts_allowed_l10", "trb_allowed_l10", "ast_allowed_l10", "fga_allowed_l10",
                    "pts_allowed_rank", "trb_allowed_rank", "ast_allowed_rank", "tm_pts_l10", "tm_fga_l10"]


def team_totals(df: DataFrame, sums: Sequence[str] = TEAM_SUMS, team="tm", order="game_date", opp="opp",
                entity="player") -> DataFrame:
    """Sum of each statistic per team, date and opponent; a sum over NULLs only is 0."""
    return df.groupBy(team, order, opp).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"tm_{c}") for c in sums],
        F.count(entity).alias("tm_players_used"))


def mirror_allowed(teams: DataFrame, stats: Sequence[str] = ALLOWED, team="tm", order="game_date", opp="opp",
                   same_game: bool = True) -> DataFrame:
    """What each team allowed: the totals of its opponent on that date.

    ``same_game`` also asks the opponent's row to name this team, which keeps one row per game when
    teams meet more than one opponent on a date.
    """
    other = teams.select(F.col(team).alias("_tm"), F.col(order).alias("_d"), F.col(opp).alias("_opp"),
                         *[F.col(f"tm_{c}").alias(f"{c}_allowed") for c in stats])
    cond = (F.col(opp) == F.col("_tm")) & (F.col(order) == F.col("_d"))
    if same_game:
        cond = cond & (F.col(team) == F.col("_opp"))
    return teams.join(other, cond, "left").drop("_tm", "_d", "_opp")


def team_form(teams: DataFrame, stats: Sequence[str], rows: int = 10, min_rows: int = 3, team="tm",
              order="game_date", tie: Sequence[str] = ("opp",)) -> DataFrame:
    """Rolling mean of the last ``rows`` earlier team games.

    The table holds one row per team, date and opponent, so a team's window is bounded by its calendar.
    """
    w = Window.partitionBy(team).orderBy(order, *tie)
    return teams.withColumns({f"{c}_l{rows}": prior_agg(F.avg, c, w, rows, min_rows) for c in stats})


def average_rank(df: DataFrame, column: str, name: str, within: str = "game_date",
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Ascending rank inside each date with ties sharing their mean rank; NULL stays unranked."""
    upto = Window.partitionBy(within).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    shared = F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)
    return _ranked(df, column, name, within, F.col(column), lambda v: v.withColumn("_upto", F.sum("_n").over(upto)),
                   {"_upto": "_n"}, shared, chunk_rows)


def dense_rank_desc(df: DataFrame, column: str, name: str, within: str = "game_date",
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Dense rank inside each date, largest value first; NULL stays unranked."""
    place = F.row_number().over(Window.partitionBy(within).orderBy("_v"))
    return _ranked(df, column, name, within, -F.col(column), lambda v: v.withColumn("_place", place),
                   {}, F.col("_place").cast("double"), chunk_rows)


def _ranked(df: DataFrame, column: str, name: str, within: str, value: Column, windowed, sums: dict[str, str],
            rank: Column, chunk_rows: int) -> DataFrame:
    # rows are counted per distinct value first; a date with very many values is numbered in chunks
    values = (df.where(F.col(column).isNotNull()).groupBy(within, value.alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))

    def hot(v: DataFrame) -> DataFrame:
        return running_totals(v.withColumn("_same", F.lit(0)), [within], "_same", ["_v"], sums, "_place",
                              max(1, chunk_rows // 4)).drop("_same", *([] if not sums else ["_place"]))

    ranks = by_heat(values, [within], windowed, hot, chunk_rows).select(
        F.col(within).alias("_w"), F.col("_v"), rank.alias(name))
    return df.join(ranks, (F.col(within) == F.col("_w")) & (value == F.col("_v")), "left").drop("_w", "_v")


def average_ranks(teams: DataFrame, columns: Mapping[str, str], within: str = "game_date") -> DataFrame:
    """Average-tie ranks of several columns over a table with one row per team and game.

    ``columns`` maps the rank's name to the ranked column.  The windows of all columns share the
    date partitioning, which is bounded by the teams that play on a date.
    """
    out = {}
    for name, c in columns.items():
        w = Window.partitionBy(within).orderBy(F.col(c).asc_nulls_last())
        # rows up to and including the ties: the last place the ties share
        last = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        out[name] = F.when(F.col(c).isNotNull(), (F.rank().over(w) + last) / F.lit(2.0))
    return teams.withColumns(out)


def dense_ranks(means: DataFrame, columns: Mapping[str, str], within: str = "game_date") -> DataFrame:
    """Dense ranks, largest first, of several columns over a table with one row per opponent and date.

    Ranking rows densely by a value their opponent and date decide gives the same ranks, so the ranks
    are made here, where a date holds one row per opponent, and joined to the rows afterwards.
    """
    out = {}
    for name, c in columns.items():
        w = Window.partitionBy(within).orderBy(F.col(c).desc_nulls_last())
        out[name] = F.when(F.col(c).isNotNull(), F.dense_rank().over(w).cast("double"))
    return means.withColumns(out)


def attach_opponent(df: DataFrame, teams: DataFrame, columns: Sequence[str] = OPPONENT_COLUMNS, team="tm",
                    order="game_date", opp="opp", match_game: bool = True) -> DataFrame:
    """Give each row the ``opp_`` features of the team it faces, as known before that date.

    ``match_game`` picks the opponent's game against this row's own team.
    """
    keys = {opp: team, order: order}
    if match_game:
        keys[team] = opp
    right = teams.select(*[F.col(source).alias(f"_k{i}") for i, source in enumerate(keys.values())],
                         *[F.col(c).alias(f"opp_{c}") for c in columns])
    cond = F.lit(True)
    for i, left in enumerate(keys):
        cond = cond & (F.col(left) == F.col(f"_k{i}"))
    return df.join(right, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def team_context(df: DataFrame, rows: int = 10, min_rows: int = 3, ranked: Sequence[str] = ALLOWED,
                 offense: bool = True) -> DataFrame:
    """Team table with allowed statistics, their rolling form and the ranks by date."""
    teams = mirror_allowed(team_totals(df, TEAM_SUMS if offense else ALLOWED))
    form = [f"{c}_allowed" for c in ALLOWED] + ([f"tm_{c}" for c in ALLOWED] if offense else [])
    teams = team_form(teams, form, rows, min_rows)
    return average_ranks(teams, {f"{c}_allowed_rank": f"{c}_allowed_l{rows}" for c in ranked})


def opponent_means(df: DataFrame, stats: Sequence[str] = ALLOWED, rows: int = 10, opp="opp",
                   order="game_date") -> DataFrame:
    """Mean a row's entity scores against each opponent by date, rolled over earlier dates."""
    means = df.groupBy(opp, order).agg(*[F.avg(c).alias(f"{c}_allowed") for c in stats])
    w = Window.partitionBy(opp).orderBy(order)
    return means.withColumns({f"{c}_allowed_l{rows}": prior_agg(F.avg, f"{c}_allowed", w, rows) for c in stats})


def neutral_fill(df: DataFrame, means: Sequence[str], constants: Mapping[str, float]) -> DataFrame:
    """Fill NULL with the column's mean over the table, or with a constant."""
    if means:
        row = row_of(df.agg(*[F.avg(c).alias(c) for c in means]))
        df = df.withColumns({c: F.coalesce(F.col(c), row[c]) for c in means})
    fills: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in constants.items()}
    return df.withColumns(fills) if fills else df
