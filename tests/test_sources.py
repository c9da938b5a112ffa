"""Feeds in, tables out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gameline import schemas
from gameline.operators import latest, quality
from gameline.plans import daily, features, views
from gameline.sources import feeds, sinks

QUOTES = """{"id": "g1", "commence_time": "2026-01-20T00:30:00Z", "home_team": "Boston Celtics", "away_team": "Utah Jazz",
 "bookmakers": [
  {"key": "b1", "markets": [{"key": "player_points", "outcomes": [
    {"name": "Over", "description": "A B", "point": 20.5, "price": 120},
    {"name": "Under", "description": "A B", "point": 20.5, "price": -140},
    {"name": "Over", "description": "", "point": 3.5, "price": 100},
    {"name": "Over", "description": "C D", "price": 100}]}]},
  {"key": "b2", "markets": [{"key": "player_points", "outcomes": [{"name": "Over", "description": "A B", "point": 21.5}]}]}]}"""


def test_quotes(spark):
    q = feeds.flatten_quotes(spark.createDataFrame([(QUOTES,)], "payload string"))
    rows = q.orderBy("book").collect()
    assert [(r.player, r.market, r.line, r.odds, r.book) for r in rows] == [
        ("A B", "player_points", 20.5, 120, "b1"), ("A B", "player_points", 21.5, -110, "b2")]
    best = latest.consolidate_quotes(q, "book").first()
    assert (best.line, best.odds, best.home) == (21.0, 120, "Boston Celtics")


def test_events_on_the_run_date(spark):
    docs = [('{"id": "1", "home_team": "H", "away_team": "A", "commence_time": "2026-01-20T19:30:00Z"}',),
            ('{"id": "2", "home_team": "H", "away_team": "A", "commence_time": "2026-01-21T19:30:00Z"}',)]
    out = feeds.events_on(spark.createDataFrame(docs, "payload string"), F.lit("2026-01-20").cast("date")).collect()
    assert [(r.home, r.away, r.time, r.event_id) for r in out] == [("H", "A", "07:30 PM", "1")]


def test_box_from_csv(spark, tmp_path):
    head = ",".join(schemas.RAW_BOX_TEXT.fieldNames())
    row = ["Al Horford", "BOS", "ATL", "W", *["1"] * 19, "bad", "2025-01-02"]
    (tmp_path / "box.csv").write_text(head + "\n" + ",".join(row) + "\n")
    df = feeds.clean_box(feeds.read_table(spark, str(tmp_path / "box.csv"), schemas.RAW_BOX_TEXT, "csv"))
    r = df.first()
    assert (r.game_id, r.matchup_id, r.won, r.gmsc, r["3p_pct"]) == (
        "20250102_Al_Horford_BOS_ATL", "20250102_ATL_BOS", 1, None, 1.0)
    assert r.game_date == dt.date(2025, 1, 2) and r.is_home is None
    with pytest.raises(ValueError):
        feeds.read_table(spark, "x", None, "csv")


def test_log_variants(spark):
    row = {c: "4" for c in schemas.RAW_LOG.fieldNames()}
    row.update(PLAYER_NAME="A B", TEAM_ABBREVIATION="LAL", MATCHUP="LAL vs. BOS", GAME_DATE="2025-01-02", WL="L", MIN="30:30", FG_PCT="")
    log = spark.createDataFrame([row], schemas.RAW_LOG)
    for kind, home in (("token", None), ("code", 1.0), ("side", 1.0)):
        r = feeds.clean_log(log, kind).first()
        assert (r.opp, r.mp, r.won, r.is_home, r.fg_pct) == ("BOS", 30.5, 0, home, 0.0)
    box = feeds.box_from_log(log)
    assert box.columns == schemas.RAW_BOX.fieldNames()


def test_prediction_files(spark, tmp_path):
    for prop in ("pts", "ast"):
        (tmp_path / f"predictions_{prop}.csv").write_text("player,game_date,actual,predicted,line\np,2025-01-01,1,2,3\n")
    out = feeds.read_by_prop(spark, str(tmp_path), ["pts", "trb", "ast"])
    assert sorted(r.prop for r in out.collect()) == ["ast", "pts"]
    with pytest.raises(FileNotFoundError):
        feeds.read_by_prop(spark, str(tmp_path), ["blk"])


def test_preferred_table(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "a"))
    spark.range(1).withColumn("pts_matchup_edge", F.lit(1)).write.parquet(str(tmp_path / "b"))
    found = feeds.read_first(spark, [str(tmp_path / "none"), str(tmp_path / "a"), str(tmp_path / "b")], ["pts_matchup_edge"])
    assert "pts_matchup_edge" in found.columns
    assert feeds.with_defaults(spark.range(1), {"x": F.lit(0)}).columns == ["id", "x"]
    with pytest.raises(FileNotFoundError):
        feeds.read_first(spark, [str(tmp_path / "a")], ["x"])


def test_dated_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    for d, n in (("2025-01-01", 1), ("2025-01-02", 2), ("2025-01-02", 3)):
        sinks.write_run(spark.range(n), path, F.lit(d).cast("date"))
    assert spark.read.parquet(path).groupBy("run_date").count().count() == 2
    assert sinks.read_latest_run(spark, path).count() == 3


def test_gated_write(spark, tmp_path):
    df = spark.range(3)
    bad = quality.feed_checks(spark.createDataFrame([(None,)], "a int"), ["a"])
    good = quality.feed_checks(spark.createDataFrame([(1,)], "a int"), ["a"])
    assert not sinks.write_gated(df, bad, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()
    assert sinks.write_gated(df, good, str(tmp_path / "t"))


def test_report(spark, data, tmp_path):
    sinks.write_report(views.bets(spark, data), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "best_threshold")).count() == 1
    assert spark.read.parquet(str(tmp_path / "by_edge")).count() > 3


def test_build_chain(spark, data, tmp_path):
    clean = views.games(spark, data).withColumn("fg_pct", F.lit(0.5))
    assert daily.build_features(clean, str(tmp_path)) == {"clean": True, "features": True, "matchups": True}
    out = spark.read.parquet(str(tmp_path / "matchups"))
    assert out.count() == clean.count() and "pts_matchup_edge" in out.columns
    broken = clean.withColumn("pts", -F.col("pts"))
    assert daily.build_features(broken, str(tmp_path / "broken")) == {"clean": False}


def test_variants(spark, data):
    """The other two chains add their columns to every row once."""
    games = views.games(spark, data)
    n = games.count()
    single = features.single_features(games)
    assert single.count() == n and {"pts_std_l5", "opp_pts_allowed_l5", "opp_ast_allowed_rank"} <= set(single.columns)
    seasons = features.seasons_features(games)
    assert seasons.count() == n
    assert seasons.where(F.col("opp_pts_allowed_l10").isNull() | F.col("opp_pts_allowed_rank").isNull()).isEmpty()


def test_bad_text_and_prices_do_not_stop_a_read(spark):
    quote = ('{"commence_time": "%s", "home_team": "H", "bookmakers": [{"key": "b1", "markets": [{"key": "m1", "outcomes": ['
             '{"name": "Over", "description": "P", "point": 1.5, "price": 150.6}, {"name": "Over", "description": "Q", "point": 2.5},'
             '{"name": "Under", "description": "P", "point": 1.5, "price": 1}]}, {"key": "m2", "outcomes": []}]},'
             '{"key": "b2", "markets": [{"key": "m1", "outcomes": [{"name": "Over", "description": "P", "point": 3.5, "price": -120}]}]}]}')
    docs = spark.createDataFrame([(quote % "2025-01-02T03:04:05Z",), (quote % "soon",)], "payload string")
    got = feeds.flatten_quotes(docs).collect()
    assert sorted((r.player, r.book, r.odds) for r in got) == sorted(2 * [("P", "b1", 151), ("Q", "b1", -110), ("P", "b2", -120)])
    assert sorted(r.game_time is None for r in got) == 3 * [False] + 3 * [True]
    events = spark.createDataFrame([('{"id": "1", "commence_time": "bad"}',), ('{"id": "2", "commence_time": "2025-01-02T03:00:00Z"}',)],
                                   "payload string")
    assert [r.event_id for r in feeds.events_on(events, F.lit("2025-01-02").cast("date")).collect()] == ["2"]


def test_empty_rerun_replaces_the_day(spark, tmp_path):
    path, day = str(tmp_path / "runs"), F.lit("2025-01-02").cast("date")
    sinks.write_run(spark.range(3), path, day)
    sinks.write_run(spark.range(2), path, F.lit("2025-01-01").cast("date"))
    sinks.write_run(spark.range(0), path, day)
    assert spark.read.parquet(path).count() == 2


def test_empty_table_does_not_pass(spark):
    assert not quality.all_passed(quality.row_check(spark.range(0)))
    assert quality.all_passed(quality.row_check(spark.range(1)))
