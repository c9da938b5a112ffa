"""Schedule density and rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gameline.functions.numeric import clip, flag


def distinct_dates(df: DataFrame, group: Sequence[str] = ("tm",), order: str = "game_date") -> DataFrame:
    """One row per group and date."""
    return df.select(*group, order).distinct()


def prior_in_days(w_group: Sequence[str], order: str, days: int, count: Column | None = None,
                  empty_as_zero: bool = False) -> Column:
    """Number of earlier rows in [date - days, date); NULL when there is none unless ``empty_as_zero``."""
    w = Window.partitionBy(*w_group).orderBy(F.unix_date(order)).rangeBetween(-days, -1)
    n = F.coalesce(F.sum(count).over(w), F.lit(0)) if count is not None else F.count(F.lit(1)).over(w)
    return n if empty_as_zero else F.nullif(n, F.lit(0))


def team_schedule(df: DataFrame, group: Sequence[str] = ("tm",), order: str = "game_date",
                  spans: Sequence[int] = (7, 14)) -> DataFrame:
    """Rest days, back-to-back flags and games in recent day ranges, per group and date."""
    dates = distinct_dates(df, group, order)
    w = Window.partitionBy(*group).orderBy(order)
    rest = F.datediff(F.col(order), F.lag(order, 1).over(w))
    out = {"days_rest": rest, "is_b2b": flag(rest <= 1), "is_b2b_second": flag(rest == 1)}
    for days in spans:
        out[f"games_last_{days}d"] = prior_in_days(group, order, days)
    return dates.withColumns(out)


def attach_schedule(df: DataFrame, schedule: DataFrame, group: Sequence[str] = ("tm",),
                    order: str = "game_date") -> DataFrame:
    """Give each row the schedule features of its group on that date."""
    return df.join(schedule, [*group, order], "left")


def event_density(df: DataFrame, entity: Sequence[str], order: str, spans: Sequence[int] = (7, 14)) -> DataFrame:
    """Row counts per entity and date with the number of earlier rows in recent day ranges.

    Rows are counted per date first; the range frames run over at most one row per date.
    """
    days = df.groupBy(*entity, order).agg(F.count(F.lit(1)).alias("events"))
    return days.withColumns({f"events_last_{n}d": prior_in_days(entity, order, n, F.col("events")) for n in spans})


def simple_rest(rest_gap: Column) -> dict[str, Column]:
    """Simplified schedule columns from the day gap to the previous event: one less than the gap, unknown as 2."""
    rest = clip(F.coalesce(rest_gap - 1, F.lit(2)), 0, 7).cast("int")
    return {"days_rest": rest, "is_b2b_second": flag(rest == 0), "games_last_7d": F.lit(2)}
