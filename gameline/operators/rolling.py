"""Leak-safe row-frame features: every frame ends one row before the current one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gameline.functions.numeric import flag, ratio
from gameline.operators.heat import CHUNK_ROWS, by_heat, running_totals, with_frames


def prior_agg(agg, c: str, w: WindowSpec, rows: int, min_rows: int = 1) -> Column:
    """Aggregate of the last ``rows`` earlier values, NULL with fewer than ``min_rows`` non-NULL ones."""
    frame = w.rowsBetween(-rows, -1)
    value = agg(c).over(frame)
    return value if min_rows <= 1 else F.when(F.count(c).over(frame) >= min_rows, value)


@dataclass(frozen=True)
class RollingSpec:
    """Which rolling columns to build.

    ``means`` maps a window length to its minimum number of values, ``stds`` likewise.  A trend is the
    ratio of the 5 and 20 row means, NULL on a zero mean.
    """

    stats: Sequence[str]
    means: Mapping[int, int] = field(default_factory=lambda: {5: 1, 10: 1, 20: 1})
    std_stats: Sequence[str] = ()
    stds: Mapping[int, int] = field(default_factory=dict)
    trends: Sequence[str] = ()
    counter: str | None = "games_played"
    load: str | None = None
    high_load: float = 36.0
    high_load_inclusive: bool = True
    streak: bool = False
    gap: bool = False
    leads: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.trends and not (set(self.trends) <= set(self.stats) and {5, 20} <= set(self.means)):
            raise ValueError("a trend needs the 5 and 20 row means of its statistic")

    @property
    def lookback(self) -> int:
        return max([1, 3 if self.load else 1, *self.means, *self.stds])

    def columns(self, w: WindowSpec, order: str) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for stat in self.stats:
            for rows, least in self.means.items():
                out[f"{stat}_l{rows}"] = prior_agg(F.avg, stat, w, rows, least)
        for stat in self.std_stats:
            for rows, least in self.stds.items():
                out[f"{stat}_std_l{rows}"] = prior_agg(F.stddev_samp, stat, w, rows, least)
        if self.load:
            m = self.load
            before = F.lag(m, 1).over(w)
            out[f"{m}_l3"] = prior_agg(F.sum, m, w, 3)
            out[f"{m}_avg_l3"] = prior_agg(F.avg, m, w, 3)
            out["high_min_prev"] = flag(before >= self.high_load if self.high_load_inclusive
                                        else before > self.high_load).cast("double")
        if self.gap:
            out["player_days_rest"] = F.datediff(F.col(order), F.lag(order, 1).over(w))
        for name, source in self.leads.items():
            out[name] = F.lead(source, 1).over(w)
        return out

    def finish(self, df: DataFrame) -> DataFrame:
        """Columns that follow from the window columns."""
        made = {f"{s}_trend": ratio(F.col(f"{s}_l5"), F.col(f"{s}_l20")) for s in self.trends}
        return df.withColumns(made) if made else df


# fixed values: the thirteen box-score statistics that get rolling means
BOX_STATS = ["pts", "trb", "ast", "mp", "fga", "fg_pct", "3pa", "3p_pct", "fta", "ft_pct", "tov", "stl", "blk"]


def spec_task(**extra) -> RollingSpec:
    """Windows 5/10/20, deviations over 10 and 20 with at least 3 values."""
    return RollingSpec(stats=BOX_STATS, std_stats=["pts", "trb", "ast", "mp"], stds={10: 3, 20: 3},
                       trends=["pts", "trb", "ast"], load="mp", streak=True, gap=True, **extra)


def spec_single(**extra) -> RollingSpec:
    """Deviations over 5 (at least 3 values) and 20 (at least 5)."""
    return RollingSpec(stats=BOX_STATS, std_stats=["pts", "trb", "ast", "mp"], stds={5: 3, 20: 5},
                       trends=["pts", "trb", "ast"], load="mp", streak=True, gap=True, **extra)


def spec_seasons(**extra) -> RollingSpec:
    """Deviations over 10 with at least 2 values; high load means strictly above 35."""
    return RollingSpec(stats=BOX_STATS, std_stats=["pts", "trb", "ast", "mp"], stds={10: 2},
                       load="mp", high_load=35.0, high_load_inclusive=False, **extra)


def rolling_features(df: DataFrame, spec: RollingSpec, entity: Sequence[str] = ("player",),
                     order: str = "game_date", seq: Sequence[str] = ("seq",),
                     chunk_rows: int = CHUNK_ROWS, bound: DataFrame | None = None) -> DataFrame:
    """Rolling means, deviations, trends, load and counters in one pass over each entity's rows.

    Row numbers reach back without limit, so hot entities get theirs from running totals.  ``bound`` is an
    optional cheaper frame for the size check.
    """

    def counters(before: Column) -> dict[str, Column]:
        out = {spec.counter: before} if spec.counter else {}
        return {**out, "games_streak": before + 1} if spec.streak else out

    def bounded(w: WindowSpec) -> dict[str, Column]:
        return spec.columns(w, order)

    def ordinary(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*entity).orderBy(order, *seq)
        return rows.withColumns({**bounded(w), **counters(F.row_number().over(w) - 1)})

    def hot(rows: DataFrame) -> DataFrame:
        numbered = running_totals(rows, entity, order, seq, {}, "_ordinal", max(1, chunk_rows // 4))
        framed = with_frames(numbered, entity, order, seq, bounded, spec.lookback,
                             1 if spec.leads else 0, chunk_rows)
        return framed.withColumns(counters((F.col("_ordinal") - 1).cast("int"))).drop("_ordinal")

    return spec.finish(by_heat(df, entity, ordinary, hot, chunk_rows, bound))


def prior_count(df: DataFrame, entity: Sequence[str], order: str, seq: Sequence[str],
                name: str = "games_played", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number of earlier rows of the entity."""
    return rolling_features(df, RollingSpec(stats=(), means={}, counter=name), entity, order, seq, chunk_rows)
