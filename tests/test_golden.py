"""Small cases with answers worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gameline.functions import metrics, numeric, odds, text
from gameline.operators import context, dataset, decisions, history, latest, lines, rolling, schedule, stats

DAY = dt.date(2025, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n - 1)


def series(spark, values, player="a"):
    return spark.createDataFrame([(player, day(i + 1), i, v) for i, v in enumerate(values)],
                                 "player string, game_date date, seq long, pts double")


def column(df, name, by="seq"):
    return [r[0] for r in df.orderBy(by).select(name).collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_rolling_shift_one(spark):
    spec = rolling.RollingSpec(stats=["pts"], means={5: 1}, std_stats=["pts"], stds={10: 3})
    out = rolling.rolling_features(series(spark, [10.0, 20.0, 30.0, 40.0]), spec)
    assert column(out, "pts_l5") == [None, 10, 15, 20]
    assert column(out, "pts_std_l10") == [None, None, None, 10]
    assert column(out, "games_played") == [0, 1, 2, 3]


def test_rolling_skips_null(spark):
    out = rolling.rolling_features(series(spark, [10.0, None, 30.0, 40.0]), rolling.RollingSpec(stats=["pts"], means={5: 1}))
    assert column(out, "pts_l5") == [None, 10, 10, 20]


def test_trend_on_zero_mean_is_null(spark):
    spec = rolling.RollingSpec(stats=["pts"], means={5: 1, 20: 1}, trends=["pts"])
    out = rolling.rolling_features(series(spark, [0.0, 0.0, 4.0]), spec)
    assert column(out, "pts_trend") == [None, None, None]
    with pytest.raises(ValueError):
        rolling.RollingSpec(stats=["pts"], means={5: 1}, trends=["pts"])


def test_load_columns(spark):
    spec = rolling.RollingSpec(stats=(), means={}, load="pts", streak=True, gap=True)
    out = rolling.rolling_features(series(spark, [36.0, 35.0, 40.0, 1.0, 2.0]), spec)
    assert column(out, "pts_l3") == [None, 36, 71, 111, 76]
    assert column(out, "high_min_prev") == [0, 1, 0, 1, 0]
    assert column(out, "games_streak") == [1, 2, 3, 4, 5]
    assert column(out, "player_days_rest") == [None, 1, 1, 1, 1]


def test_range_counts(spark):
    df = spark.createDataFrame([("t", day(d)) for d in (1, 3, 8, 20)], "tm string, game_date date")
    out = schedule.team_schedule(df)
    assert column(out, "games_last_7d", "game_date") == [None, 1, 2, None]
    zero = df.withColumn("n", schedule.prior_in_days(["tm"], "game_date", 7, empty_as_zero=True))
    assert column(zero, "n", "game_date") == [0, 1, 2, 0]


def test_rest_flags(spark):
    df = spark.createDataFrame([("t", day(d)) for d in (1, 2, 4)], "tm string, game_date date")
    out = schedule.team_schedule(df)
    assert column(out, "days_rest", "game_date") == [None, 1, 2]
    assert column(out, "is_b2b", "game_date") == [0, 1, 0]
    assert column(out, "is_b2b_second", "game_date") == [0, 1, 0]


def test_ranks(spark):
    df = spark.createDataFrame([(1, DAY, 100.0), (2, DAY, 105.0), (3, DAY, 105.0), (4, DAY, None)],
                               "seq int, game_date date, v double")
    assert column(context.average_rank(df, "v", "r"), "r") == [1, 2.5, 2.5, None]
    assert column(context.average_ranks(df, {"r": "v"}), "r") == [1, 2.5, 2.5, None]
    df = spark.createDataFrame([(1, DAY, 105.0), (2, DAY, 100.0), (3, DAY, 105.0), (4, DAY, None)],
                               "seq int, game_date date, v double")
    assert column(context.dense_rank_desc(df, "v", "r"), "r") == [1, 2, 1, None]


def test_mirror(spark):
    teams = spark.createDataFrame([("A", DAY, "B", 110.0), ("B", DAY, "A", 99.0)],
                                  "tm string, game_date date, opp string, tm_pts double")
    out = context.mirror_allowed(teams, ["pts"])
    assert column(out, "pts_allowed", "tm") == [99, 110]


def test_team_sum_of_nulls_is_zero(spark):
    df = spark.createDataFrame([("A", DAY, "B", None, None), ("A", DAY, "B", None, "p")],
                               "tm string, game_date date, opp string, pts double, player string")
    r = context.team_totals(df, ["pts"]).first()
    assert (r.tm_pts, r.tm_players_used) == (0.0, 1)


def meetings(spark, rows):
    return spark.createDataFrame([("p", o, day(d), i, v, v, v, 7.0) for i, (o, d, v) in enumerate(rows)],
                                 "player string, opp string, game_date date, seq long, pts double, trb double,"
                                 " ast double, pts_l10 double")


@pytest.mark.parametrize("chunk", [4_000_000, 1])
def test_matchup_edge(spark, chunk):
    df = meetings(spark, [("X", 1, 20.0), ("Y", 2, 10.0), ("X", 3, 30.0), ("X", 4, 0.0)])
    out = history.matchup_history(df, chunk_rows=chunk).orderBy("seq").collect()
    r = out[3]
    assert (r.n_prev_matchups, r.pts_vs_opp, r.pts_matchup_edge, r.pts_favorable_matchup) == (2, 25, 5, 1)
    assert r.pts_vs_opp_l3 == 25 and r.pts_unfavorable_matchup == 0
    assert (out[2].n_prev_matchups, out[2].pts_matchup_edge, out[2].pts_vs_opp) == (1, 0, 7)


@pytest.mark.parametrize("chunk", [4_000_000, 1])
def test_matchup_history_ignores_the_same_date(spark, chunk):
    df = meetings(spark, [("X", 1, 20.0), ("X", 2, 10.0), ("X", 2, 99.0), ("X", 3, 50.0), ("X", 3, 1.0)])
    out = history.matchup_history(df, chunk_rows=chunk).orderBy("seq").collect()
    assert [r.n_prev_matchups for r in out] == [0, 1, 1, 3, 3]
    assert out[4].pts_vs_opp == 43 and out[4].pts_vs_opp_l3 == 43
    assert out[3].pts_vs_opp_l3 == 43


def test_backtest_rules(spark):
    df = spark.createDataFrame([(1, 26.0, 25.0, 27.0), (2, 26.0, 25.0, 25.0), (3, 25.0, 25.0, 20.0), (4, 26.0, None, 1.0)],
                               "seq int, predicted double, line double, actual double")
    out = decisions.backtest(df).orderBy("seq").collect()
    assert [(r.direction, r.won) for r in out] == [("OVER", 1), ("OVER", 0), ("UNDER", 1)]
    assert out[0].profit == pytest.approx(0.90909, abs=1e-5) and out[1].profit == -1


def test_push_rules(spark):
    def res(push):
        return [one(spark, odds.result(F.lit(s), F.lit(25.0), F.lit(25.0), push)) for s in ("OVER", "UNDER")]

    assert res("push") == ["PUSH", "PUSH"]
    assert res("loss") == ["LOSS", "LOSS"]
    assert res("under") == ["LOSS", "WIN"]
    with pytest.raises(ValueError):
        odds.result(F.lit("OVER"), F.lit(1), F.lit(1), "other")


def test_grading_and_payout(spark):
    bets = spark.createDataFrame(
        [(DAY, "p", str(i), "OVER", 25.0, 150, None, None, None) for i in range(4)],
        "date date, player string, prop string, bet_direction string, vegas_line double, odds int, actual double,"
        " result string, profit double")
    box = spark.createDataFrame([(DAY, "p", "0", 27.0), (DAY, "p", "1", 25.0), (DAY, "p", "2", 24.0)],
                                "date date, player string, prop string, actual double")
    out = decisions.grade(bets, box).orderBy("prop").collect()
    assert [(r.result, r.profit) for r in out] == [("WIN", 150), ("PUSH", 0), ("LOSS", -100), (None, None)]
    assert one(spark, odds.american_profit(F.lit(-110), F.lit("WIN"))) == pytest.approx(90.909, abs=1e-3)


def test_edge_buckets(spark):
    expect = {0.0: None, 0.5: "0-0.5", 0.51: "0.5-1", 5.0: "3-5", 5.01: "5+", 100.1: None}
    got = {v: one(spark, numeric.bucket(F.lit(v), odds.EDGE_EDGES, odds.EDGE_LABELS)) for v in expect}
    assert got == expect


def test_edge_rating(spark):
    df = spark.createDataFrame([(d, 20.0 + d, 20.0, -105, 120) for d in (0.49, 1.49, 1.5, 2.0, 3.0, -3.0)],
                               "d double, predicted double, line double, over_odds int, under_odds int")
    out = {r.d: (r.direction, r.odds, r.label) for r in decisions.rate_edges(df, None).collect()}
    assert out[0.49] == (None, None, "NO EDGE")
    assert out[1.49][2] == "NO BET" and out[1.5][2] == "SLIGHT" and out[2.0][2] == "MODERATE"
    assert out[3.0] == ("OVER", -105, "STRONG") and out[-3.0] == ("UNDER", 120, "STRONG")


def test_confidence_gate(spark):
    df = spark.createDataFrame([(0.60,), (0.40,), (0.5,), (0.7,)], "prob_over double")
    out = {r.prob_over: (r.direction, round(r.confidence, 6), r.tier) for r in decisions.gate_picks(df).collect()}
    assert out == {0.60: ("OVER", 0.6, "MEDIUM"), 0.40: ("UNDER", 0.6, "MEDIUM"), 0.7: ("OVER", 0.7, "HIGH")}


def test_latest_forms(spark):
    df = spark.createDataFrame([("p", day(1), 1, 1.0), ("p", day(2), 2, None)],
                               "player string, game_date date, seq int, x double")
    assert latest.latest_values(df, ["player"], ["game_date", "seq"], ["x"]).first().x == 1
    assert latest.latest_row(df, ["player"], ["game_date", "seq"]).first().x is None


def test_upsert_new_batch_wins(spark):
    schema = "Player string, Data date, Tm string, PTS double"
    old = spark.createDataFrame([("p", DAY, "T", 1.0), ("q", DAY, "T", 2.0)], schema)
    new = spark.createDataFrame([("p", DAY, "T", 9.0)], schema)
    out = latest.upsert(old, new, ["Player", "Data", "Tm"])
    assert {(r.Player, r.PTS) for r in out.collect()} == {("p", 9.0), ("q", 2.0)}


@pytest.mark.parametrize("raw,minutes", [("34:30", 34.5), ("", 0), ("x", 0), ("12", 12), (None, 0), ("1:2:3", 0)])
def test_minutes(spark, raw, minutes):
    df = spark.createDataFrame([(raw,)], "mp string")
    assert df.select(text.minutes("mp").alias("m")).first().m == minutes


@pytest.mark.parametrize("raw,opp", [("LAL vs. BOS", "BOS"), ("LAL @ BOS", "BOS"), ("LAL", None), (None, None)])
def test_opponent(spark, raw, opp):
    df = spark.createDataFrame([(raw,)], "m string")
    r = df.select(text.opponent_token("m").alias("a"), text.opponent_code("m").alias("b")).first()
    assert (r.a, r.b) == (opp, opp)


def test_opponent_side(spark):
    df = spark.createDataFrame([("LAL vs. BOS", "LAL"), ("LAL @ BOS", "BOS"), ("LAL", "LAL")], "m string, t string")
    opp, side = text.opponent_side("m", "t")
    assert [tuple(r) for r in df.select(opp, side).collect()] == [("BOS", "H"), ("LAL", "A"), ("UNK", "U")]


@pytest.mark.parametrize("d,label", [("2025-10-01", "2025-26"), ("2026-01-05", "2025-26"), ("1999-12-01", "1999-00")])
def test_season(spark, d, label):
    assert one(spark, text.season(F.lit(d).cast("date"))) == label


def test_keys_with_null_parts(spark):
    df = spark.createDataFrame([(DAY, "Al Horford", "BOS", "ATL"), (DAY, "Al Horford", "BOS", None)],
                               "d date, p string, t string, o string")
    out = df.select(text.event_key("d", "p", "t", "o").alias("k"), text.pair_key("d", "t", "o").alias("m")).collect()
    assert tuple(out[0]) == ("20250101_Al_Horford_BOS_ATL", "20250101_ATL_BOS") and tuple(out[1]) == (None, None)


def test_empty_metrics_are_zero(spark):
    empty = spark.createDataFrame([], "won int, profit double, edge double")
    r = decisions.overall(empty).first()
    assert (r.total_bets, r.wins, r.win_rate, r.roi, r.avg_edge, r.profitable) == (0, 0, 0, 0, 0, 0)


def test_expected_roi(spark):
    df = spark.createDataFrame([(0.6,), (0.7,)], "confidence double")
    assert df.agg(metrics.expected_roi().alias("x")).first().x == pytest.approx((0.65 - 0.35 * 1.1) * 100)
    low = spark.createDataFrame([(0.5,)], "confidence double")
    assert low.agg(metrics.expected_roi().alias("x")).first().x is None


def test_fuzzy_names(spark):
    known = spark.createDataFrame([("Nikola Jokic", 1), ("Seth Curry", 2), ("Stephen Curry", 3), ("Jusuf Nurkic", 4)],
                                  "player string, f int")
    wanted = spark.createDataFrame([("N. JOKIC",), ("S Curry",), ("Seth Curry",), ("Mr Nurk ",), ("Nobody",), ("Stephen",)],
                                   "player string")
    got = {r.player: (r.matched, r.how) for r in lines.name_matches(wanted, known).collect()}
    assert got == {"N. JOKIC": ("Nikola Jokic", "word"), "Seth Curry": ("Seth Curry", "exact"),
                   "Mr Nurk ": ("Jusuf Nurkic", "word"), "Stephen": ("Stephen Curry", "word")}


def test_medians(spark):
    df = spark.createDataFrame([(1.0, None), (5.0, None), (2.0, 3.0), (100.0, None)], "a double, b double")
    r = stats.exact_medians(df, ["a", "b"]).first()
    assert (r.a, r.b) == (3.5, 3.0)
    assert column(stats.fill_medians(df, ["b"]), "b", "a") == [3, 3, 3, 3]


def test_medians_on_skewed_values(spark):
    df = spark.range(50_001).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pow(F.col("id"), 2)).alias("v"))
    want = df.toPandas().v.median()
    assert stats.exact_medians(df, ["v"], accuracy=100).first().v == want


def test_features_exclude_the_event_itself(spark):
    df = spark.createDataFrame([("p", DAY, 1.0, 2.0, 3.0, 4.0, 5.0)],
                               "player string, game_date date, pts double, pts_l5 double, pts_l10 double, mp_l10 double,"
                               " days_rest double")
    assert dataset.feature_columns(df) == ["days_rest", "pts_l5"]
    assert dataset.feature_columns(df, dataset.KEEP_L10) == ["days_rest", "mp_l10", "pts_l10", "pts_l5"]
    with pytest.raises(ValueError):
        dataset.require_leak_free(["pts_l5", "mp"])
    with pytest.raises(ValueError):
        dataset.require_leak_free(["pts_l10"], "pts")


def test_folds_follow_the_row_order(spark):
    df = spark.range(20).select(F.date_add(F.lit(DAY), (F.col("id") % 5).cast("int")).alias("game_date"), F.col("id").alias("seq"))
    out = dataset.expanding_folds(df, k=5).orderBy("ordinal").collect()
    # 20 rows in 6 parts of 3: five rows only trained on, then 5 folds of three
    assert [r.fold for r in out] == [-1] * 5 + [f for f in range(5) for _ in range(3)]
    grid = dataset.contiguous_folds(df, "game_date", ["seq"], 3).orderBy("game_date", "seq").collect()
    assert [r.fold for r in grid] == [0] * 7 + [1] * 7 + [2] * 6


def test_window_row_order_has_a_tie_break(spark):
    df = spark.createDataFrame([("a", DAY, i, float(i)) for i in range(5)], "player string, game_date date, seq long, pts double")
    out = rolling.rolling_features(df, rolling.RollingSpec(stats=["pts"], means={5: 1}))
    w = Window.partitionBy("player").orderBy("game_date", "seq")
    assert column(out, "games_played") == column(df.withColumn("n", F.row_number().over(w) - 1), "n")
