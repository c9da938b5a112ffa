"""The given tables seen as observations, games, bets and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gameline.operators import decisions, rolling


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: an entity's value on a date."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("player"), F.to_date("o_orderdate").alias("game_date"),
        F.col("o_orderkey").alias("seq"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("value"),
        F.col("o_orderstatus").alias("res"), F.col("o_orderpriority").alias("prop"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("player"), F.to_date("ts").alias("game_date"), F.col("event_id").alias("seq"),
        "value", F.col("event_type").alias("prop"))


def games(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with lines: a box score with team and opponent.

    Lines are summed per order before they meet the order, on the key both sides share.  Every figure
    is a whole number, so sums do not depend on the order of addition.
    """
    def number(condition):
        return F.count_if(condition).cast("double")

    line = table(spark, folder, "lineitem").join(
        table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"),
        F.col("l_suppkey") == F.col("s_suppkey"))
    by_order = line.groupBy("l_orderkey").agg(
        F.floor(F.sum("l_quantity") / 5).cast("double").alias("pts"),
        F.count(F.lit(1)).cast("double").alias("trb"),
        F.sum("l_linenumber").cast("double").alias("ast"),
        # seven lines of at most 105 each stay below 48 minutes, so nothing is cut off
        F.floor(1.75 * F.sqrt(F.sum(F.floor(F.col("l_extendedprice") / 1000)))).cast("double").alias("mp"),
        F.sum(F.rint(F.col("l_tax") * 100)).alias("fga"),
        F.sum(F.rint(F.col("l_discount") * 100)).alias("fg_pct"),
        number(F.col("l_returnflag") == "A").alias("3pa"),
        number((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")).alias("3p_pct"),
        number(F.col("l_returnflag") == "N").alias("fta"),
        number((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("ft_pct"),
        number(F.col("l_returnflag") == "R").alias("tov"),
        number(F.col("l_linestatus") == "O").alias("stl"),
        number(F.col("l_linenumber") == 1).alias("blk"),
        F.sum("s_nationkey").alias("_sides"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = (by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(customers, F.col("o_custkey") == F.col("c_custkey")))
    team = (F.col("c_nationkey") % 5).cast("long")
    return joined.select(
        F.col("o_custkey").alias("player"), F.to_date("o_orderdate").alias("game_date"),
        F.col("o_orderkey").alias("seq"), team.alias("tm"),
        ((team + 1 + F.col("_sides") % 4) % 5).alias("opp"),
        F.when(F.col("o_orderstatus") == "F", "W").when(F.col("o_orderstatus") == "P", "L").alias("res"),
        *rolling.BOX_STATS)


def game_players(spark: SparkSession, folder: str) -> DataFrame:
    """The player of every order: at least as many rows per player as there are games."""
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("player"))


def predictions(spark: SparkSession, folder: str, least_games: int = 5) -> DataFrame:
    """Predicted = mean of the last five values, line = mean of the last ten."""
    spec = rolling.RollingSpec(stats=["value"], means={5: 1, 10: 1})
    rolled = rolling.rolling_features(observations(spark, folder), spec)
    return rolled.where(F.col("games_played") >= least_games).select(
        "player", "game_date", "seq", "prop", F.col("value").alias("actual"),
        F.col("value_l5").alias("predicted"), F.col("value_l10").alias("line"))


def bets(spark: SparkSession, folder: str, min_edge: float = 0.0) -> DataFrame:
    return decisions.backtest(predictions(spark, folder), min_edge)


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """One quote per line item."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("player"), F.col("l_returnflag").alias("market"),
        F.col("l_suppkey").alias("book"), F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("line"),
        F.when(F.col("l_linenumber") == 1, -110).when(F.col("l_linenumber") == 2, 120)
        .when(F.col("l_linenumber") == 3, -105).otherwise(100).alias("odds"),
        F.col("l_orderkey").alias("game_id"), F.col("l_linestatus").alias("home"),
        F.to_date("l_shipdate").alias("game_time"))


def six_places(c):
    """Round half away from zero at six places in primitive arithmetic; huge values, infinities and NaN the long way."""
    quick = F.signum(c) * (F.floor(F.abs(c) * 1e6 + 0.5) / F.lit(1e6))
    return F.when(F.abs(c) < 9e12, quick).otherwise(F.round(c, 6)) + F.lit(0.0)


def tidy(df: DataFrame, *as_double: str) -> DataFrame:
    """Portable output types: rounded doubles, long integers, dates as text."""
    def convert(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if f.name in as_double:
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        if f.name in as_double or isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = six_places(c.cast("double"))
        return c.alias(f.name)

    return df.select(*[convert(f) for f in df.schema])
