"""Landed feeds to typed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gameline import schemas
from gameline.functions import numeric, text


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read parquet, CSV with header, or JSON; text formats need a schema."""
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        if schema is None:
            raise ValueError(f"{fmt} files are read with a declared schema")
        reader = reader.schema(schema).option("mode", "PERMISSIVE")
        if fmt == "csv":
            reader = reader.option("header", "true").option("nanValue", "")
    elif schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_first(spark: SparkSession, paths: Sequence[str], needed: Sequence[str] = ()) -> DataFrame:
    """The first parquet table that exists and has the needed columns."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            df = spark.read.parquet(path)
        except AnalysisException:
            continue
        if set(needed) <= set(df.columns):
            return df
    raise FileNotFoundError(f"none of {list(paths)} is a table with {list(needed)}")


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add the columns that are missing."""
    missing = {c: v for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def read_by_prop(spark: SparkSession, folder: str, props: Sequence[str], schema: T.StructType = schemas.PREDICTIONS,
                 fmt: str = "csv", name: str = "predictions_{}") -> DataFrame:
    """Union of per-prop files with their prop as a column; props without a file are skipped."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    out = None
    for prop in props:
        path = f"{folder}/{name.format(prop)}.{fmt}"
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            continue
        part = read_table(spark, path, schema, fmt).withColumn("prop", F.lit(prop))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"no prediction file in {folder}")
    return out


def union_seasons(seasons: Mapping[str, DataFrame]) -> DataFrame:
    """All seasons in one table with a ``season`` column; columns absent from a season are NULL."""
    out = None
    for label, df in seasons.items():
        part = df.withColumn("season", F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def clean_box(df: DataFrame) -> DataFrame:
    """Raw box score to the clean table: names, dates, keys, outcome and typed numbers."""
    df = df.toDF(*[text.standard_name(c) for c in df.columns])
    numbers = [text.standard_name(c) for c in schemas.RAW_BOX_NUMBERS]
    return df.withColumns({
        "game_date": F.col("game_date").try_cast("date"),
        **{c: numeric.coerce(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("double")
           for c in numbers if c in df.columns},
    }).withColumns({
        "game_id": text.event_key("game_date", "player", "tm", "opp"),
        "matchup_id": text.pair_key("game_date", "tm", "opp"),
        "is_home": F.lit(None).cast("double"),
        "won": text.won("res"),
    })


def clean_log(df: DataFrame, opponent: str = "token") -> DataFrame:
    """Raw game log to the clean table.

    ``opponent`` picks how the matchup text is read: ``token`` (third word), ``code`` (three capitals,
    with a home flag) or ``side`` (the side that is not the own team).
    """
    names = {k: text.standard_name(v) for k, v in schemas.LOG_NAMES.items() if k in df.columns}
    df = df.drop(*schemas.LOG_DROPPED).withColumnsRenamed(names)
    counts = ["pts", "fg", "fga", "ft", "fta", "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pf", "3p", "3pa"]
    shares = [c for c in ("fg_pct", "3p_pct", "ft_pct") if c in df.columns]
    opp = {"token": text.opponent_token("matchup_raw"), "code": text.opponent_code("matchup_raw"),
           "side": text.opponent_side("matchup_raw", "tm")[0]}[opponent]
    home = {"token": F.lit(None).cast("double"), "code": text.home_flag("matchup_raw").cast("double"),
            "side": F.nullif(text.opponent_side("matchup_raw", "tm")[1], F.lit("U"))}[opponent]
    if opponent == "side":
        home = (home == "H").cast("double")
    out = df.withColumns({
        "opp": opp, "is_home": home, "game_date": F.col("game_date").try_cast("date"), "won": text.won("res"),
        "mp": text.minutes("mp"),
        **{c: numeric.coerce(c, 0.0) for c in counts if c in df.columns},
        **{c: numeric.coerce(c, 0.0) for c in shares}})
    return out.withColumns({
        "game_id": text.event_key("game_date", "player", "tm"),
        "matchup_id": text.pair_key("game_date", "tm", "opp"),
        "gmsc": numeric.game_score()})


def box_from_log(df: DataFrame) -> DataFrame:
    """Raw game log in the columns of the raw box score, those that exist, in file order."""
    df = df.withColumnsRenamed({k: v for k, v in schemas.LOG_NAMES.items() if k in df.columns})
    df = df.withColumns({
        "Opp": text.opponent_token("matchup_raw"), "Data": F.col("Data").try_cast("date"),
        **{c: numeric.coerce(c) for c in schemas.RAW_BOX_NUMBERS if c in df.columns}})
    df = df.withColumn("GmSc", numeric.game_score("PTS", "FG", "FGA", "FT", "FTA", "ORB", "DRB", "STL", "AST",
                                                  "BLK", "PF", "TOV"))
    return df.select(*[c for c in schemas.RAW_BOX.fieldNames() if c in df.columns])


def flatten_quotes(df: DataFrame, json: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Nested quotes to one row per player, market and book; only 'Over' outcomes with a player and a line.

    Prices are rounded to whole odds; an absent price counts as -110.  A time that cannot be read is NULL.
    """
    doc = df.select(*keep, F.from_json(json, schemas.QUOTES_JSON).alias("q"))
    books = doc.select(*keep, "q", F.explode("q.bookmakers").alias("b"))
    markets = books.select(*keep, "q", "b", F.explode("b.markets").alias("m"))
    rows = markets.select(*keep, "q", "b", "m", F.explode("m.outcomes").alias("o"))
    return (rows.where((F.col("o.name") == "Over") & (F.coalesce("o.description", F.lit("")) != "")
                       & (F.coalesce("o.point", F.lit(0.0)) != 0.0))
            .select(*keep, F.col("o.description").alias("player"), F.col("m.key").alias("market"),
                    F.col("o.point").alias("line"), F.coalesce(F.round("o.price").try_cast("int"), F.lit(-110)).alias("odds"),
                    F.col("b.key").alias("book"), F.col("q.commence_time").try_cast("timestamp").alias("game_time"),
                    F.coalesce("q.home_team", F.lit("")).alias("home"),
                    F.coalesce("q.away_team", F.lit("")).alias("away")))


def events_on(df: DataFrame, run_date: Column, json: str = "payload") -> DataFrame:
    """Scheduled events of the run date with their local start time as text."""
    e = df.select(F.from_json(json, schemas.EVENT_JSON).alias("e")).withColumn(
        "_t", F.col("e.commence_time").try_cast("timestamp"))
    return (e.where(F.to_date("_t") == run_date)
            .select(F.col("e.home_team").alias("home"), F.col("e.away_team").alias("away"),
                    F.date_format("_t", "hh:mm a").alias("time"), F.col("e.id").alias("event_id")))
