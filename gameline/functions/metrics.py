"""Aggregate expressions shared by reports and model evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gameline.functions.odds import BREAKEVEN


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def decision_metrics(won: str = "won", profit: str = "profit", edge: str = "edge") -> dict[str, Column]:
    """Bets, wins, losses, win rate, profit, ROI % per bet, mean edge and a profitable flag.

    ``won`` is 0/1.  Over no rows every figure is 0.
    """
    n = F.count(F.lit(1))
    wins = F.coalesce(F.sum(F.col(won)), F.lit(0))
    rate = F.coalesce(F.try_divide(wins.cast("double"), n), F.lit(0.0))
    total = F.coalesce(F.sum(profit), F.lit(0.0))
    return {
        "total_bets": n,
        "wins": wins.cast("long"),
        "losses": (n - wins).cast("long"),
        "win_rate": rate,
        "win_rate_pct": rate * 100,
        "total_profit": total,
        "roi": F.coalesce(F.try_divide(total, n.cast("double")), F.lit(0.0)) * 100,
        "avg_edge": F.coalesce(F.avg(edge), F.lit(0.0)),
        "profitable": (rate > BREAKEVEN).cast("int"),
    }


def regression_metrics(actual: str = "actual", predicted: str = "predicted") -> dict[str, Column]:
    """MAE, RMSE and R² over rows where both are present.

    R² is NULL when the actual values do not vary.
    """
    e = F.col(actual) - F.col(predicted)
    y = F.when(e.isNotNull(), F.col(actual))
    spread = F.var_pop(y) * F.count(y)
    return {
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": 1 - F.try_divide(F.sum(e * e), spread),
    }


def classifier_metrics(label: str = "label", prob: str = "prob") -> dict[str, Column]:
    """Accuracy at 0.5 and Brier score."""
    p, y = F.col(prob), F.col(label)
    return {
        "accuracy": F.avg(((p > 0.5).cast("int") == y).cast("double")),
        "brier": F.avg((p - y) * (p - y)),
    }


def simulated_decisions(actual: str = "actual", predicted: str = "predicted", line: str = "line") -> dict[str, Column]:
    """Accuracy, profit (+1 / -1.1) and ROI of siding with the prediction; landing on the line is UNDER."""
    known = F.col(line).isNotNull()
    correct = (F.col(predicted) > F.col(line)) == (F.col(actual) > F.col(line))
    n = _count(known & correct.isNotNull())
    wins = _count(known & correct)
    losses = _count(known & ~correct)
    profit = wins * F.lit(1.0) - losses * F.lit(1.1)
    accuracy = F.coalesce(F.try_divide(wins.cast("double"), n), F.lit(0.0))
    return {
        "n_bets": n, "wins": wins, "losses": losses, "accuracy": accuracy, "edge": accuracy - 0.5,
        "profit_units": profit, "roi_pct": F.coalesce(F.try_divide(profit, n.cast("double")), F.lit(0.0)) * 100,
    }


def graded_metrics(result: str = "result", profit: str = "profit") -> dict[str, Column]:
    """W-L-P record, win % without pushes, profit and profit per graded bet."""
    wins, losses = _count(F.col(result) == "WIN"), _count(F.col(result) == "LOSS")
    n = F.count(F.lit(1))
    return {
        "graded": n, "wins": wins, "losses": losses, "pushes": _count(F.col(result) == "PUSH"),
        "win_pct": F.coalesce(F.try_divide(wins.cast("double"), wins + losses), F.lit(0.0)) * 100,
        "profit": F.coalesce(F.sum(profit), F.lit(0.0)),
        "profit_per_bet": F.try_divide(F.sum(profit), n.cast("double")),
    }


def expected_roi(confidence: str = "confidence") -> Column:
    """ROI % implied by the mean confidence at standard price, NULL at or below break-even."""
    c = F.avg(confidence)
    return F.when(c > BREAKEVEN, (c - (1 - c) * 1.1) * 100)


def aliased(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]
