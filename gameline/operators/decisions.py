"""Bets, backtests, breakdowns, picks, tracking and grading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gameline.functions import metrics, odds
from gameline.functions.metrics import aliased
from gameline.functions.numeric import bucket, round_even

# fixed values: confidence buckets and their labels
CONFIDENCE_BUCKETS = [(0.50, 0.55, "Low (50-55%)"), (0.55, 0.60, "Med (55-60%)"),
                      (0.60, 0.65, "High (60-65%)"), (0.65, 1.00, "Very High (65%+)")]


def backtest(predictions: DataFrame, min_edge: float = 0.0, price: int = odds.STANDARD_ODDS) -> DataFrame:
    """One bet per prediction with known values and enough edge; landing on the line loses."""
    p, line, actual = F.col("predicted"), F.col("line"), F.col("actual")
    side = odds.direction(p, line)
    outcome = odds.result(side, actual, line, push="loss")
    return (predictions.where(p.isNotNull() & line.isNotNull() & actual.isNotNull())
            .withColumns({"direction": side, "edge": F.abs(p - line),
                          "won": (outcome == "WIN").cast("int"),
                          "profit": odds.american_profit(F.lit(price), outcome, stake=1.0)})
            .where(F.col("edge") >= min_edge))


def overall(bets: DataFrame) -> DataFrame:
    return bets.agg(*aliased(metrics.decision_metrics()))


def breakdown(bets: DataFrame, *by: str | Column) -> DataFrame:
    """Decision metrics per group; rows outside every group (NULL) are left out."""
    named = [F.col(b) if isinstance(b, str) else b for b in by]
    out = bets.groupBy(*named).agg(*aliased(metrics.decision_metrics()))
    return out.na.drop(subset=out.columns[: len(by)])


def by_edge_bucket(bets: DataFrame) -> DataFrame:
    return breakdown(bets, bucket(F.col("edge"), odds.EDGE_EDGES, odds.EDGE_LABELS).alias("edge_bucket"))


def by_tier(bets: DataFrame, minutes: DataFrame, entity: str = "player", column: str = "mp_l10") -> DataFrame:
    """Decision metrics by the entity's average of its minutes feature."""
    average = minutes.groupBy(entity).agg(F.avg(column).alias("avg_minutes"))
    # bets are counted per entity first, so a very active entity joins as one row
    parts = bets.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"), F.sum("won").alias("_w"),
                                     F.sum("profit").alias("_p"), F.sum("edge").alias("_e"))
    tier = bucket(F.col("avg_minutes"), odds.TIER_EDGES, odds.TIER_LABELS)
    grouped = (parts.join(average, entity, "left").groupBy(tier.alias("player_tier"))
               .agg(F.sum("_n").alias("total_bets"), F.sum("_w").alias("wins"),
                    F.sum("_p").alias("total_profit"), F.sum("_e").alias("_e"))
               .where(F.col("player_tier").isNotNull()))
    rate = F.col("wins") / F.col("total_bets")
    return grouped.select(
        "player_tier", "total_bets", F.col("wins").cast("long").alias("wins"),
        (F.col("total_bets") - F.col("wins")).cast("long").alias("losses"), rate.alias("win_rate"),
        (rate * 100).alias("win_rate_pct"), "total_profit",
        (F.col("total_profit") / F.col("total_bets") * 100).alias("roi"),
        (F.col("_e") / F.col("total_bets")).alias("avg_edge"), (rate > odds.BREAKEVEN).cast("int").alias("profitable"))


def daily(bets: DataFrame, order: str = "game_date") -> DataFrame:
    """Profit, wins, bets and win rate per date with the running profit; one row per date is windowed."""
    days = bets.groupBy(order).agg(
        F.sum("profit").alias("daily_profit"), F.sum("won").cast("long").alias("daily_wins"),
        F.count(F.lit(1)).alias("daily_bets"))
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumns({
        "daily_win_rate": F.col("daily_wins") / F.col("daily_bets"),
        "cumulative_profit": F.sum("daily_profit").over(w)})


def running(bets: DataFrame, order: str = "game_date", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Running bets, profit and ROI after every bet."""
    from gameline.operators.heat import running_totals

    out = running_totals(bets, [], order, seq, {"cumulative_profit": "profit"}, "cumulative_bets")
    return out.withColumn("cumulative_roi", F.col("cumulative_profit") / F.col("cumulative_bets") * 100)


def threshold_sweep(bets: DataFrame, step: float = 0.25, top: float = 5.0, min_bets: int = 50) -> DataFrame:
    """Metrics of the bets with at least each edge threshold, from one pass over the bets."""
    last = int(round(top / step))
    cell = F.least(F.floor(F.col("edge") / F.lit(step)), F.lit(last)).cast("int")
    cells = bets.groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("won").alias("_w"), F.sum("profit").alias("_p"))
    steps = bets.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("cell"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.join(cells, "cell", "left").select(
        (F.col("cell") * F.lit(step)).alias("threshold"),
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("_n", "_w", "_p")])
    return (sums.where(F.col("_n") >= min_bets)
            .select("threshold", F.col("_n").alias("bets"), (F.col("_w") / F.col("_n") * 100).alias("win_rate"),
                    (F.col("_p") / F.col("_n") * 100).alias("roi"), F.col("_p").alias("profit")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Threshold with the highest ROI, the lowest on a tie."""
    return sweep.agg(F.max_by("threshold", F.struct("roi", -F.col("threshold"))).alias("threshold"),
                     F.max("roi").alias("roi"))


def best_props(bets: DataFrame, min_bets: int = 100) -> DataFrame:
    return breakdown(bets, "prop").where((F.col("total_bets") >= min_bets) & (F.col("roi") > 0))


def confidence_buckets(scored: DataFrame, prob: str = "prob", label: str = "went_over", min_rows: int = 10) -> DataFrame:
    """Accuracy and ROI (+1 / -1.1) by confidence, both tails together."""
    p = F.col(prob)
    tagged = F.lit(None).cast("string")
    low_of = F.lit(None).cast("double")
    for low, high, name in reversed(CONFIDENCE_BUCKETS):
        inside = ((p >= low) & (p < high)) | ((p <= 1 - low) & (p > 1 - high))
        tagged, low_of = F.when(inside, F.lit(name)).otherwise(tagged), F.when(inside, F.lit(low)).otherwise(low_of)
    correct = ((p > 0.5).cast("int") == F.col(label)).cast("int")
    grouped = (scored.groupBy(low_of.alias("low"), tagged.alias("bucket"))
               .agg(F.count(F.lit(1)).alias("n"), F.sum(correct).alias("wins"))
               .where(F.col("bucket").isNotNull() & (F.col("n") >= min_rows)))
    losses = F.col("n") - F.col("wins")
    return grouped.select("low", "bucket", "n", (F.col("wins") / F.col("n")).alias("accuracy"),
                          ((F.col("wins") * F.lit(1.0) - losses * F.lit(1.1)) / F.col("n") * 100).alias("roi"))


def profitable_threshold(buckets: DataFrame, default: float = 0.55) -> DataFrame:
    """Lower end of the first profitable confidence bucket."""
    return buckets.agg(F.coalesce(F.min(F.when(F.col("accuracy") > odds.BREAKEVEN, F.col("low"))),
                                  F.lit(default)).alias("threshold"))


def rate_edges(scored: DataFrame, min_strength: int | None = 1) -> DataFrame:
    """Direction, price and strength for predictions against lines with two prices."""
    out = scored.withColumns(odds.rate_edge(F.col("predicted"), F.col("line"), F.col("over_odds"), F.col("under_odds")))
    return out if min_strength is None else out.where(F.col("strength") >= min_strength)


def wide_scores(latest: DataFrame, scores: Mapping[str, Column], lines: Mapping[str, Column]) -> DataFrame:
    """Per-prop prediction, line, edge and direction as columns of one row per entity."""
    out: dict[str, Column] = {}
    for prop, score in scores.items():
        p, line = F.greatest(score, F.lit(0.0)), round_even(lines[prop], 1)
        out[prop] = round_even(p, 1)
        out[f"{prop}_line"] = line
        out[f"{prop}_edge"] = round_even(p - line, 1)
        out[f"{prop}_direction"] = F.when(line.isNotNull(), odds.direction(p, line))
    return latest.withColumns(out)


def long_scores(wide: DataFrame, ids: Sequence[str], props: Sequence[str]) -> DataFrame:
    """The wide per-prop columns as one row per entity and prop."""
    cells = F.array(*[F.struct(
        F.lit(p).alias("prop"), F.col(p).cast("double").alias("prediction"),
        F.col(f"{p}_line").cast("double").alias("line"), F.col(f"{p}_edge").cast("double").alias("signed_edge"),
        F.col(f"{p}_direction").alias("direction")) for p in props])
    return wide.select(*ids, F.explode(cells).alias("_cell")).select(*ids, "_cell.*")


def opportunities(long: DataFrame, min_edge: float = 1.5, strong_edge: float = 3.0,
                  prefer_unders: bool = True) -> DataFrame:
    """Bets worth listing: enough edge, OVER only where the edge is strong when unders are preferred."""
    size = F.abs("signed_edge")
    keep = size >= min_edge
    if prefer_unders:
        keep = keep & ((F.col("direction") != "OVER") | (size >= strong_edge))
    strength = F.when(size >= strong_edge, F.lit("STRONG")).otherwise(F.lit("MODERATE"))
    return long.where(keep).withColumn("edge", size).withColumn("strength", strength).drop("signed_edge")


def gate_picks(scored: DataFrame, prob: str = "prob_over", minimum: float = 0.60) -> DataFrame:
    """Confident picks only, with direction, confidence and tier."""
    out = scored.withColumns(odds.confidence_gate(F.col(prob), minimum)).where(F.col("direction").isNotNull())
    return out.withColumn("tier", odds.pick_tier(F.col("confidence")))


def lock_bets(edges: DataFrame, locked_at: Column, min_edge: float = 3.0) -> DataFrame:
    """Tracking rows for bets with enough edge; result columns stay NULL until graded."""
    size = F.abs("real_edge")
    return (edges.where(size >= min_edge).select(
        F.to_date(locked_at).alias("date"), locked_at.alias("locked_time"), "player",
        F.col("prop_display").alias("prop"), F.col("real_direction").alias("bet_direction"), "vegas_line",
        "prediction", round_even(F.col("real_edge"), 1).alias("edge"), round_even(size, 1).alias("edge_abs"),
        F.when(size >= 5, F.lit("HIGH")).otherwise(F.lit("MED")).alias("confidence"),
        F.col("bet_odds").alias("odds"), F.lit(None).cast("double").alias("actual"),
        F.lit(None).cast("string").alias("result"), F.lit(None).cast("double").alias("profit")))


def tracking_sheet(bets: DataFrame, run_date: Column) -> DataFrame:
    """Rated bets as tracking rows with a stake of one unit and open results."""
    return bets.select(
        run_date.alias("date"), "player", "prop", "direction", "line", F.col("predicted").alias("pred"), "edge",
        "odds", "strength", "label", F.lit(None).cast("double").alias("actual"),
        F.lit(None).cast("string").alias("result"), F.lit(1.0).alias("units_bet"),
        F.lit(None).cast("double").alias("profit"))


def grade(bets: DataFrame, actuals: DataFrame, on: Sequence[str] = ("date", "player", "prop")) -> DataFrame:
    """Fill actual, result and profit of open bets from long box scores (``on`` columns + ``actual``).

    A bet that already has an actual keeps it; a bet without one in ``actuals`` stays open.
    """
    found = actuals.select(*on, F.col("actual").alias("_actual"))
    done = F.col("actual").isNotNull()
    graded = odds.result(F.col("bet_direction"), F.col("_actual"), F.col("vegas_line"))
    return (bets.join(found, list(on), "left")
            .withColumn("result", F.when(done, F.col("result")).otherwise(graded))
            .withColumn("profit", F.when(done, F.col("profit"))
                        .otherwise(odds.american_profit(F.col("odds"), graded)))
            .withColumn("actual", F.coalesce("actual", "_actual")).drop("_actual"))


def graded_summary(tracking: DataFrame) -> DataFrame:
    """Record and profit overall, by confidence and by prop, from one pass."""
    graded = tracking.where(F.col("result").isin("WIN", "LOSS", "PUSH"))
    sets = graded.groupingSets([[], ["confidence"], ["prop"]], "confidence", "prop")
    return sets.agg(F.grouping_id().alias("_g"), *aliased(metrics.graded_metrics())).select(
        F.when(F.col("_g") == 3, F.lit("overall")).when(F.col("_g") == 1, F.lit("confidence"))
        .otherwise(F.lit("prop")).alias("level"),
        F.when(F.col("_g") == 3, F.lit("all")).when(F.col("_g") == 1, F.col("confidence"))
        .otherwise(F.col("prop")).alias("name"),
        *metrics.graded_metrics())


def direction_split(bets: DataFrame) -> DataFrame:
    """Bets, strength counts and shares by direction."""
    grouped = bets.groupBy("direction").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("strength") == 3).alias("strong"),
        F.count_if(F.col("strength") == 2).alias("moderate"), F.count_if(F.col("strength") == 1).alias("slight"))
    total = bets.agg(F.count(F.lit(1))).scalar()
    return grouped.withColumn("share_pct", F.col("n") / total * 100)


def run_summary(predictions: DataFrame, found: DataFrame, run_date: Column) -> DataFrame:
    """Totals of one run."""
    players = predictions.agg(F.count(F.lit(1))).scalar()
    bets = found.agg(F.count(F.lit(1)).alias("total_opportunities"),
                     F.count_if(F.col("strength") == "STRONG").alias("strong_bets"),
                     F.count_if(F.col("strength") == "MODERATE").alias("moderate_bets"))
    return bets.select(run_date.cast("string").alias("date"), players.alias("total_players"), "*")


def rule_flags(bets: DataFrame) -> DataFrame:
    """What to do next: keep or filter the model, props to focus on or avoid, minimum edge, high edges."""
    total = overall(bets).select(
        F.lit("model").alias("rule"), F.lit("all").alias("subject"),
        F.when(F.col("profitable") == 1, F.lit("keep")).otherwise(F.lit("filter")).alias("advice"),
        F.col("roi").alias("figure"))
    props = breakdown(bets, "prop").select(
        F.lit("prop").alias("rule"), F.col("prop").alias("subject"),
        F.when(F.col("roi") > 0, F.lit("focus")).when(F.col("roi") < -5, F.lit("avoid")).alias("advice"),
        F.col("roi").alias("figure")).where(F.col("advice").isNotNull())
    least = best_threshold(threshold_sweep(bets)).where(F.col("threshold") > 0).select(
        F.lit("edge").alias("rule"), F.lit("minimum").alias("subject"), F.lit("use").alias("advice"),
        F.col("threshold").alias("figure"))
    high = (by_edge_bucket(bets).where(F.col("edge_bucket").isin(*odds.EDGE_LABELS[4:]))
            .agg(F.avg("roi").alias("figure")).where(F.col("figure") > 5)
            .select(F.lit("edge").alias("rule"), F.lit("high").alias("subject"), F.lit("use").alias("advice"), "figure"))
    return total.unionByName(props).unionByName(least).unionByName(high)
