"""Hot keys take another path with the same result."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gameline.operators import context, heat, history, rolling

COLUMNS = "player long, game_date date, seq long, opp long, pts double, trb double, ast double"


def skewed(spark, one_day: bool):
    """Half of the rows belong to player 1; with ``one_day`` half of those share a date."""
    rows = spark.range(1200).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 37).cast("long").alias("player"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") * 7919 % 97).cast("int")).alias("game_date"),
        F.col("id").alias("seq"), (F.col("id") * 31 % 4).alias("opp"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 101 % 40).cast("double")).alias("pts"),
        (F.col("id") % 9).cast("double").alias("trb"), (F.col("id") * 13 % 7).cast("double").alias("ast"))
    if one_day:
        rows = rows.withColumn("game_date", F.when(F.col("seq") % 4 == 0, F.lit(dt.date(2024, 2, 1))).otherwise(F.col("game_date")))
    return rows


def same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@pytest.mark.parametrize("one_day", [False, True])
@pytest.mark.parametrize("chunk", [4, 25, 300])
def test_chunked_frames(spark, one_day, chunk):
    df = skewed(spark, one_day)

    def build(w):
        return {"a": F.sum("pts").over(w.rowsBetween(-20, -1)), "b": F.lead("seq", 2).over(w),
                "c": F.count("pts").over(w.rowsBetween(-3, -1)), "d": F.lag("seq", 1).over(w)}

    plain = df.withColumns(build(Window.partitionBy("player").orderBy("game_date", "seq")))
    same(heat.with_frames(df, ["player"], "game_date", ["seq"], build, 20, 2, chunk_rows=chunk), plain)


@pytest.mark.parametrize("one_day", [False, True])
def test_chunked_features(spark, one_day):
    df = skewed(spark, one_day)
    spec = rolling.RollingSpec(stats=["pts", "trb"], std_stats=["pts"], stds={10: 3}, trends=["pts"], load="trb",
                               streak=True, gap=True, leads={"next_pts": "pts"})
    plain = rolling.rolling_features(df, spec)
    split = rolling.rolling_features(df, spec, chunk_rows=40)
    same(rounded(split.select(*plain.columns)), rounded(plain))


@pytest.mark.parametrize("one_day", [False, True])
def test_hot_history(spark, one_day):
    df = skewed(spark, one_day)
    plain, split = history.matchup_history(df), history.matchup_history(df, chunk_rows=40)
    same(rounded(split.select(*plain.columns)), rounded(plain))


def test_history_against_brute_force(spark):
    df = skewed(spark, True)
    got = history.matchup_history(df).toPandas().sort_values("seq").reset_index(drop=True)
    base = df.toPandas().sort_values("seq").reset_index(drop=True)
    for i in range(0, len(base), 17):
        row = base.iloc[i]
        before = base[(base.player == row.player) & (base.game_date < row.game_date)]
        met = before[before.opp == row.opp].sort_values(["game_date", "seq"])
        assert got.n_prev_matchups[i] == len(met)
        if len(met) >= 2:
            assert got.pts_matchup_edge[i] == pytest.approx(met.pts.mean() - before.pts.mean(), nan_ok=True)
            assert got.pts_vs_opp_l3[i] == pytest.approx(met.tail(3).pts.mean(), nan_ok=True)


@pytest.mark.parametrize("slot", [3, 50, 100_000])
def test_running_totals(spark, slot):
    df = skewed(spark, True)
    got = heat.running_totals(df, [], "game_date", ["seq"], {"total": "pts"}, "n", slot).toPandas()
    got = got.sort_values(["game_date", "seq"]).reset_index(drop=True)
    assert (got.n == pd.Series(range(1, len(got) + 1))).all()
    assert (got.total == got.pts.fillna(0).cumsum()).all()


def test_running_totals_per_key(spark):
    df = skewed(spark, True)
    got = heat.running_totals(df, ["player"], "game_date", ["seq"], {"total": "trb"}, "n", 10)
    w = Window.partitionBy("player").orderBy("game_date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"n": F.count(F.lit(1)).over(w), "total": F.sum("trb").over(w)})
    same(got.select(*want.columns), want)


def test_null_keys_are_kept(spark):
    df = skewed(spark, False).withColumn("player", F.when(F.col("player") != 1, F.col("player")))
    spec = rolling.RollingSpec(stats=["trb"], means={5: 1})
    plain, split = rolling.rolling_features(df, spec), rolling.rolling_features(df, spec, chunk_rows=50)
    same(rounded(split.select(*plain.columns)), rounded(plain))


def test_bound_may_count_more(spark):
    df = skewed(spark, False)
    spec = rolling.RollingSpec(stats=["pts"], means={5: 1})
    wide = df.select("player").unionAll(df.select("player"))
    same(rolling.rolling_features(df, spec, chunk_rows=700, bound=wide), rolling.rolling_features(df, spec))


def test_no_copy_of_ordinary_rows(spark):
    """Without hot keys the plan is one scan, one shuffle and one window."""
    df = skewed(spark, False)
    out = rolling.rolling_features(df, rolling.RollingSpec(stats=["pts"], means={5: 1}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "Join" not in plan


def test_checkpoint_folder_is_used(spark, tmp_path):
    df = skewed(spark, False)
    spec = rolling.RollingSpec(stats=["pts"], means={5: 1})
    plain = rolling.rolling_features(df, spec)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    split = rolling.rolling_features(df, spec, chunk_rows=50)
    same(rounded(split), rounded(plain))
    assert any(tmp_path.iterdir())


def test_an_event_never_sees_itself(spark):
    """Changing a value changes later rows of the entity only."""
    df = skewed(spark, False)
    spec = rolling.RollingSpec(stats=["pts"], std_stats=["pts"], stds={10: 3}, trends=["pts"])
    changed = df.withColumn("pts", F.when(F.col("seq") == 600, 1000.0).otherwise(F.col("pts")))
    target = df.where("seq = 600").first()
    a = rolling.rolling_features(df, spec).drop("pts")
    b = rolling.rolling_features(changed, spec).drop("pts")
    touched = a.exceptAll(b).collect()
    assert touched
    for r in touched:
        assert r.player == target.player and (r.game_date, r.seq) > (target.game_date, 600)
    h1 = history.matchup_history(df).drop("pts", "pts_vs_opp")
    h2 = history.matchup_history(changed).drop("pts", "pts_vs_opp")
    for r in h1.exceptAll(h2).collect():
        assert r.player == target.player and r.game_date > target.game_date


def test_clustered_ids(spark):
    """One far id must not leave all other rows of a date in one piece."""
    df = skewed(spark, True).withColumn("seq", F.when(F.col("seq") == 0, 10**12).otherwise(F.col("seq")))
    binned = heat._slots(df, ["player"], "game_date", ["seq"], 10)
    assert binned.groupBy("player", "game_date", "_bin").count().agg(F.max("count")).first()[0] <= 20
    w = Window.partitionBy("player").orderBy("game_date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"n": F.count(F.lit(1)).over(w), "total": F.sum("trb").over(w)})
    got = heat.running_totals(df, ["player"], "game_date", ["seq"], {"total": "trb"}, "n", 10)
    same(got.select(*want.columns), want)


@pytest.mark.parametrize("rank", [context.average_rank, context.dense_rank_desc])
def test_hot_dates_are_ranked_in_chunks(spark, rank):
    df = skewed(spark, True).withColumn("v", F.sqrt(F.col("seq") % 401) * F.when(F.col("pts").isNotNull(), 1.0))
    same(rank(df, "v", "r", chunk_rows=20), rank(df, "v", "r"))
    got = rank(df, "v", "r").toPandas()
    kind = {"method": "average"} if rank is context.average_rank else {"method": "dense", "ascending": False}
    want = got.groupby("game_date").v.rank(**kind)
    assert got.r.equals(want)
