"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce(c: str | Column, empty: float | None = None) -> Column:
    """Text to double; bad text becomes NULL, or ``empty`` where one is given."""
    out = F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL on a zero divisor."""
    return top / F.nullif(bottom, F.lit(0.0))


def round_even(c: Column, digits: int = 1) -> Column:
    """Round the scaled double half to even, the rounding of array libraries."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; NULL counts as not holding."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip(c: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def bucket(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the half-open interval (low, high] that holds the value, NULL outside all of them."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((c > low) & (c <= high), F.lit(label)).otherwise(out)
    return out


def game_score(pts="pts", fg="fg", fga="fga", ft="ft", fta="fta", orb="orb", drb="drb", stl="stl",
               ast="ast", blk="blk", pf="pf", tov="tov", rounded: bool = True) -> Column:
    """Linear box-score rating; half-even rounding to one decimal unless switched off."""
    # fixed values: weight of each box-score statistic
    weights = [(pts, 1.0), (fg, 0.4), (fga, -0.7), (fta, -0.4), (ft, 0.4), (orb, 0.7), (drb, 0.3), (stl, 1.0),
               (ast, 0.7), (blk, 0.7), (pf, -0.4), (tov, -1.0)]
    total = F.lit(0.0)
    for name, weight in weights:
        total = total + F.col(name) * F.lit(weight)
    return round_even(total, 1) if rounded else total
