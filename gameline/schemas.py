"""Declared schemas of landed files and tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_DOUBLE = T.DoubleType()


def _struct(strings=(), doubles=(), extra=()) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in strings] + [T.StructField(n, _DOUBLE) for n in doubles]
    return T.StructType([*fields, *extra])


# fixed values: columns of the raw box score in file order
RAW_BOX_NUMBERS = ["MP", "FG", "FGA", "FG%", "3P", "3PA", "3P%", "FT", "FTA", "FT%", "ORB", "DRB", "TRB", "AST",
                   "STL", "BLK", "TOV", "PF", "PTS", "GmSc"]
RAW_BOX = _struct(["Player", "Tm", "Opp", "Res"], RAW_BOX_NUMBERS, [T.StructField("Data", T.DateType())])
# the same columns as text, for files that may hold bad numbers
RAW_BOX_TEXT = _struct(["Player", "Tm", "Opp", "Res", *RAW_BOX_NUMBERS, "Data"])

# fixed values: columns of the raw game log and their names in the box score
LOG_NAMES = {
    "PLAYER_NAME": "Player", "TEAM_ABBREVIATION": "Tm", "MATCHUP": "matchup_raw", "GAME_DATE": "Data", "WL": "Res",
    "MIN": "MP", "FGM": "FG", "FGA": "FGA", "FG_PCT": "FG%", "FG3M": "3P", "FG3A": "3PA", "FG3_PCT": "3P%",
    "FTM": "FT", "FTA": "FTA", "FT_PCT": "FT%", "OREB": "ORB", "DREB": "DRB", "REB": "TRB", "AST": "AST",
    "STL": "STL", "BLK": "BLK", "TOV": "TOV", "PF": "PF", "PTS": "PTS", "PLUS_MINUS": "plus_minus",
}
LOG_DROPPED = ["SEASON_ID", "PLAYER_ID", "TEAM_ID", "TEAM_NAME", "GAME_ID", "VIDEO_AVAILABLE", "MIN_SEC",
               "NBA_FANTASY_PTS", "DD2", "TD3", "WNBA_FANTASY_PTS", "PLUS_MINUS"]
RAW_LOG = _struct(list(LOG_NAMES))

PREDICTIONS = T.StructType([
    T.StructField("player", T.StringType()), T.StructField("game_date", T.DateType()),
    T.StructField("actual", _DOUBLE), T.StructField("predicted", _DOUBLE), T.StructField("line", _DOUBLE)])

QUOTES_JSON = ("struct<id:string,commence_time:string,home_team:string,away_team:string,bookmakers:array<struct<"
               "key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,description:string,"
               "point:double,price:double>>>>>>>")
EVENT_JSON = "struct<id:string,home_team:string,away_team:string,commence_time:string>"
