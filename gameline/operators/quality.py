"""Data-quality and leakage checks; every function returns a table of (check, value, passed) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gameline.functions.numeric import flag
from gameline.operators.stats import pair_correlation, target_correlations


def check_table(row: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Unfold one row of aggregates into check rows; a check on no data passes."""
    cells = F.array(*[F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"),
                               F.coalesce(ok, F.lit(True)).cast("int").alias("passed"))
                      for name, (value, ok) in checks.items()])
    return row.select(F.explode(cells).alias("_cell")).select("_cell.*")


def all_passed(checks: DataFrame) -> bool:
    return checks.where(F.col("passed") == 0).isEmpty()


def row_check(df: DataFrame) -> DataFrame:
    """A table must have rows."""
    return check_table(df.agg(F.count(F.lit(1)).alias("n")), {"rows": (F.col("n"), F.col("n") > 0)})


def clean_checks(df: DataFrame, key: Sequence[str] = ("game_id",), order="game_date", points="pts",
                 minutes="mp", share="fg_pct", max_minutes: float = 70.0) -> DataFrame:
    """Duplicate keys, missing dates, negative points, impossible minutes and percentages."""
    keys = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    dup = keys.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()
    m, s = F.col(minutes), F.col(share)
    row = df.agg(F.count_if(F.col(order).isNull()).alias("dates"), F.count_if(F.col(points) < 0).alias("points"),
                 F.count_if((m < 0) | (m > max_minutes)).alias("minutes"),
                 F.count_if((s < 0) | (s > 1)).alias("share")).withColumn("dup", dup)
    names = {"duplicate_games": "dup", "null_dates": "dates", "negative_pts": "points",
             "invalid_minutes": "minutes", "invalid_fg_pct": "share"}
    return check_table(row, {n: (F.col(c), F.col(c) == 0) for n, c in names.items()})


def rolling_leak_checks(df: DataFrame, entity="player", order="game_date", seq="seq", value="pts",
                        short="pts_l5", long="pts_l10", counter="games_played", max_corr: float = 0.85) -> DataFrame:
    """First events carry no history, second events carry the first value, correlation stays plausible.

    The second check covers every entity: first values are aggregated per entity and met by the
    second rows, so no entity has to be gathered.
    """
    first = F.col(counter) == 0
    pairs = df.where(F.col(counter) <= 1).groupBy(entity).agg(
        F.max(F.when(F.col(counter) == 0, F.col(value))).alias("v"),
        F.max(F.when(F.col(counter) == 1, F.col(short))).alias("s"),
        F.count_if(F.col(counter) == 1).alias("n"))
    off = pairs.agg(F.count_if((F.col("n") > 0) & ~flagged_equal("v", "s"))).scalar()
    row = df.agg(F.count_if(first & F.col(short).isNotNull()).alias("first"),
                 pair_correlation(value, long).alias("corr")).withColumn("second", off)
    return check_table(row, {
        "first_event_history": (F.col("first"), F.col("first") == 0),
        "second_event_mismatch": (F.col("second"), F.col("second") == 0),
        "correlation": (F.round("corr", 6), F.col("corr") < max_corr)})


def flagged_equal(a: str, b: str, within: float = 0.01) -> Column:
    return F.coalesce(F.abs(F.col(a) - F.col(b)) < within, F.col(a).isNull() & F.col(b).isNull())


def opponent_checks(df: DataFrame, allowed="opp_pts_allowed_l10", rank="opp_pts_allowed_rank", value="pts",
                    low=90.0, high=140.0, max_rank=30, max_null_pct=20.0) -> DataFrame:
    a, r = F.col(allowed), F.col(rank)
    row = df.agg(F.min(a).alias("lo"), F.max(a).alias("hi"), F.min(r).alias("rlo"), F.max(r).alias("rhi"),
                 pair_correlation(value, allowed).alias("corr"),
                 F.try_divide(F.count_if(a.isNull()) * F.lit(100.0), F.count(F.lit(1))).alias("nulls"))
    return check_table(row, {
        "allowed_min": (F.round("lo", 6), F.col("lo") >= low), "allowed_max": (F.round("hi", 6), F.col("hi") <= high),
        "rank_min": (F.col("rlo"), F.col("rlo") >= 1), "rank_max": (F.col("rhi"), F.col("rhi") <= max_rank),
        "correlation": (F.round("corr", 6), F.col("corr") > 0),
        "null_pct": (F.round("nulls", 6), F.col("nulls") < max_null_pct)})


def schedule_checks(df: DataFrame, value="pts", rest="days_rest", b2b="is_b2b_second", week="games_last_7d",
                    load="mp_l3", max_rest=15, b2b_low=8.0, b2b_high=20.0, max_week=6, max_load=160.0) -> DataFrame:
    row = df.agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"), (F.avg(b2b) * 100).alias("b2b"),
                 F.max(week).alias("week"), F.max(load).alias("load"), pair_correlation(value, b2b).alias("corr"))
    return check_table(row, {
        "rest_min": (F.col("lo"), F.col("lo") >= 0), "rest_max": (F.col("hi"), F.col("hi") <= max_rest),
        "b2b_pct": (F.round("b2b", 6), F.col("b2b").between(b2b_low, b2b_high)),
        "games_7d": (F.col("week"), F.col("week") <= max_week), "load_l3": (F.col("load"), F.col("load") <= max_load),
        "correlation": (F.round("corr", 6), F.col("corr") < 0)})


def feed_checks(df: DataFrame, critical: Sequence[str]) -> DataFrame:
    """No critical column may hold a NULL."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(critical)])
    return check_table(row, {f"nulls_{c}": (F.col(f"n{i}"), F.col(f"n{i}") == 0) for i, c in enumerate(critical)})


def correlation_checks(df: DataFrame, features: Sequence[str], targets: Sequence[str], limit: float = 0.85) -> DataFrame:
    """Feature-target pairs whose correlation is too high to be known before the event."""
    return target_correlations(df, features, targets).where(F.col("abs_corr") > limit)


def minutes_checks(df: DataFrame, actual="mp", predicted="predicted_minutes", recent="mp_l10") -> DataFrame:
    """Predicted minutes must neither equal the actual ones nor copy the recent mean."""
    row = df.agg(pair_correlation(actual, predicted).alias("a"),
                 pair_correlation(F.col(predicted), F.coalesce(F.col(recent), F.lit(0.0))).alias("r"))
    return check_table(row, {"corr_actual": (F.round("a", 6), F.col("a") <= 0.95),
                             "corr_recent": (F.round("r", 6), F.col("r") <= 0.99)})


# fixed values: plausibility limits of the regression models by target
METRIC_LIMITS = {
    "pts": (3.5, 0.70), "trb": (1.5, 0.65), "ast": (1.0, 0.65), "stl": (0.4, 0.45), "blk": (0.3, 0.50),
    "tov": (0.5, 0.55), "3p": (0.6, 0.55), "pra": (5.0, 0.75), "pr": (4.0, 0.70), "pa": (4.0, 0.70),
}
DEFAULT_LIMITS = (0.3, 0.80)
# fixed values: share of right decisions above which a leak is suspected, and taken for certain
ACCURACY_LIMITS = (0.62, 0.65)


def metric_checks(scores: DataFrame, max_gap: float = 0.15) -> DataFrame:
    """Flag metrics that are too good to be true, with profitability bands by accuracy.

    ``scores``: target, mae, r2, train_r2, accuracy.
    """
    def limit(i: int) -> Column:
        pairs = [F.lit(x) for t, v in METRIC_LIMITS.items() for x in (t, v[i])]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col("target")), F.lit(DEFAULT_LIMITS[i]))

    a = F.col("accuracy")
    return scores.withColumns({
        "r2_too_high": flag(F.col("r2") > limit(1)),
        "mae_too_low": flag(F.col("mae") < limit(0)),
        "overfit": flag(F.col("train_r2") - F.col("r2") > max_gap),
        "accuracy_high": flag(a > ACCURACY_LIMITS[0]),
        "accuracy_impossible": flag(a > ACCURACY_LIMITS[1]),
        "band": F.when(a > 0.60, F.lit("suspicious")).when(a > 0.5238, F.lit("profitable")).otherwise(F.lit("losing")),
    })


def recompute_rolling(raw: DataFrame, features: DataFrame, entity="player", order="game_date", seq="seq",
                      value="pts", windows: Sequence[int] = (5, 10), within: float = 0.01) -> DataFrame:
    """Recompute rolling means at the rows right after the first full window and count differences.

    The first rows of every entity are found again from the raw table by a ranked filter, which is cut
    down before the shuffle, and averaged by aggregation instead of by window frame.
    """
    most = max(windows) + 1
    w = Window.partitionBy(entity).orderBy(order, seq)
    head = (raw.select(entity, order, seq, value).withColumn("_i", F.row_number().over(w))
            .where(F.col("_i") <= most))
    by_hand = head.groupBy(entity).agg(
        F.max("_i").alias("_rows"),
        *[F.avg(F.when(F.col("_i") <= n, F.col(value))).alias(f"_hand{n}") for n in windows],
        *[F.max(F.when(F.col("_i") == n + 1, F.col(seq))).alias(f"_at{n}") for n in windows])
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"_hand{n}").alias("by_hand"),
                                         F.col(f"_at{n}").alias("_at")) for n in windows]))
    hand = by_hand.select(entity, cells.alias("_c")).select(entity, "_c.*").where(F.col("_at").isNotNull())
    made = features.select(F.col(entity).alias("_e"), F.col(seq).alias("_s"),
                           *[F.col(f"{value}_l{n}").alias(f"_made{n}") for n in windows])
    joined = hand.join(made, (F.col(entity) == F.col("_e")) & (F.col("_at") == F.col("_s")), "left")
    value_made = F.lit(None).cast("double")
    for n in windows:
        value_made = F.when(F.col("window") == n, F.col(f"_made{n}")).otherwise(value_made)
    return joined.withColumn("_m", value_made).groupBy("window").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(~F.coalesce(F.abs(F.col("by_hand") - F.col("_m")) < within, F.lit(False))).alias("mismatches"))


def recompute_opponent(teams: DataFrame, value: str = "pts", rows: int = 10, min_rows: int = 3,
                       within: float = 2.0) -> DataFrame:
    """Recompute what a team allowed over its last games by joins and count differences to ``_l10``.

    ``teams`` is a team table; each game is joined to the team's earlier games by number.
    """
    numbered = teams.withColumn("_i", F.row_number().over(Window.partitionBy("tm").orderBy("game_date", "opp")))
    # each game is sent to the numbers of the games it is history for: at most ``rows`` of them
    sent = numbered.select(F.col("tm").alias("_t"), F.col(f"{value}_allowed").alias("_v"),
                           F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + rows)).alias("_for"))
    hand = sent.groupBy("_t", "_for").agg(F.avg("_v").alias("_hand"), F.count("_v").alias("_k"))
    joined = numbered.join(hand, (F.col("tm") == F.col("_t")) & (F.col("_i") == F.col("_for")), "left")
    by_hand = F.when(F.col("_k") >= min_rows, F.col("_hand"))
    made = F.col(f"{value}_allowed_l{rows}")
    return joined.agg(F.count(by_hand).alias("checked"), F.count_if(
        ~F.coalesce(F.abs(by_hand - made) < within, by_hand.isNull() & made.isNull())).alias("mismatches"))


def recompute_rest(df: DataFrame, schedule: DataFrame, group="tm", order="game_date") -> DataFrame:
    """Recompute rest days from raw dates by pairing each date with its number and count differences."""
    dates = df.select(group, order).distinct()
    numbered = dates.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    before = numbered.select(F.col(group).alias("_g"), F.col(order).alias("_d"), (F.col("_i") + 1).alias("_j"))
    hand = (numbered.join(before, (F.col(group) == F.col("_g")) & (F.col("_i") == F.col("_j")), "left")
            .select(group, order, F.datediff(order, "_d").alias("_hand")))
    joined = hand.join(schedule.select(group, order, "days_rest"), [group, order], "left")
    return joined.agg(F.count("_hand").alias("checked"), F.count_if(
        ~F.col("_hand").eqNullSafe(F.col("days_rest"))).alias("mismatches"))
