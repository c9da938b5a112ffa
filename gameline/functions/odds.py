"""Decision, payout and grading expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: standard price and the win rate that breaks even at it
STANDARD_ODDS = -110
BREAKEVEN = 0.5238

# fixed values: edge buckets, half-open intervals (low, high]
EDGE_EDGES = [0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 5.0, 100]
EDGE_LABELS = ["0-0.5", "0.5-1", "1-1.5", "1.5-2", "2-2.5", "2.5-3", "3-5", "5+"]

# fixed values: average-minutes tiers, half-open intervals (low, high]
TIER_EDGES = [0, 15, 25, 32, 100]
TIER_LABELS = ["Bench (<15)", "Rotation (15-25)", "Starter (25-32)", "Star (32+)"]


def direction(prediction: Column, line: Column) -> Column:
    """OVER above the line, else UNDER (a tie is UNDER)."""
    return F.when(prediction > line, F.lit("OVER")).otherwise(F.lit("UNDER"))


def result(side: Column, actual: Column, line: Column, push: str = "push") -> Column:
    """WIN, LOSS or PUSH of a decision.

    ``push`` says what landing on the line means: ``push`` keeps it as PUSH, ``loss`` loses it,
    ``under`` counts it as an UNDER outcome.
    """
    if push not in ("push", "loss", "under"):
        raise ValueError(f"unknown push rule {push!r}")
    over = side == "OVER"
    beat = (over & (actual > line)) | (~over & (actual < line))
    tie = actual == line
    on_tie = {"push": F.lit("PUSH"), "loss": F.lit("LOSS"),
              "under": F.when(over, F.lit("LOSS")).otherwise(F.lit("WIN"))}[push]
    return (F.when(side.isNull() | actual.isNull() | line.isNull(), F.lit(None).cast("string"))
            .when(tie, on_tie).when(beat, F.lit("WIN")).otherwise(F.lit("LOSS")))


def american_profit(odds: Column, outcome: Column, stake: float = 100.0) -> Column:
    """Profit of a graded bet at American odds."""
    odds = odds.cast("double")
    win = F.when(odds > 0, F.lit(float(stake)) * odds / 100.0).otherwise(F.lit(float(stake)) * F.try_divide(F.lit(100.0), F.abs(odds)))
    return F.when(outcome == "WIN", win).when(outcome == "LOSS", F.lit(-float(stake))).when(outcome == "PUSH", F.lit(0.0))


def rate_edge(prediction: Column, line: Column, over_odds: Column, under_odds: Column) -> dict[str, Column]:
    """Direction, price, strength and label of the gap between prediction and line."""
    gap = prediction - line
    size = F.abs(gap)
    none = size < 0.5
    return {
        "direction": F.when(none, F.lit(None).cast("string")).when(gap > 0, F.lit("OVER")).otherwise(F.lit("UNDER")),
        "odds": F.when(none, F.lit(None).cast("int")).when(gap > 0, over_odds).otherwise(under_odds),
        "edge": size,
        "strength": F.when(size >= 3.0, 3).when(size >= 2.0, 2).when(size >= 1.5, 1).otherwise(0),
        "label": F.when(none, F.lit("NO EDGE")).when(size >= 3.0, F.lit("STRONG")).when(size >= 2.0, F.lit("MODERATE"))
                  .when(size >= 1.5, F.lit("SLIGHT")).otherwise(F.lit("NO BET")),
    }


def confidence_gate(prob_over: Column, minimum: float = 0.60) -> dict[str, Column]:
    """Direction and confidence where the probability clears the gate on either side, else NULL."""
    over, under = prob_over >= minimum, prob_over <= 1 - minimum
    return {
        "direction": F.when(over, F.lit("OVER")).when(under, F.lit("UNDER")),
        "confidence": F.when(over, prob_over).when(under, 1 - prob_over),
    }


def pick_tier(confidence: Column, high: float = 0.65, medium: float = 0.60) -> Column:
    """HIGH or MEDIUM, NULL below."""
    return F.when(confidence >= high, F.lit("HIGH")).when(confidence >= medium, F.lit("MEDIUM"))
