"""Modelling tables: targets, line proxies, feature selection, history filters, splits and folds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gameline.operators.positions import positions

# fixed values: column roles
ID_COLUMNS = {"player", "tm", "opp", "game_date", "game_id", "matchup_id", "matchup_raw", "res"}
TARGETS = {"pts", "trb", "ast"}
CURRENT_GAME = {
    "pts", "trb", "ast", "stl", "blk", "tov", "pf", "mp", "fg", "fga", "fg_pct", "3p", "3pa", "3p_pct",
    "ft", "fta", "ft_pct", "orb", "drb", "gmsc", "won", "is_home", "pra", "pr", "pa", "fantasy_pts",
    "plus_minus", "min", "next_mp",
}
LINE_PROXIES = {"pts_l10", "trb_l10", "ast_l10", "stl_l10", "blk_l10", "tov_l10", "pra_l10", "pr_l10", "pa_l10"}
COMBO_PROXIES = {"pra_l10", "pr_l10", "pa_l10"}
HISTORY_MARKS = ["_l5", "_l10", "_l20", "_l3", "_std_", "_trend", "_allowed", "_rank", "days_rest", "is_b2b",
                 "games_", "opp_", "mp_avg", "high_min", "streak", "player_days"]

# fixed values: combined targets and their parts
COMBOS = {"pra": ("pts", "trb", "ast"), "pr": ("pts", "trb"), "pa": ("pts", "ast")}


def _total(columns: Iterable[str]) -> Column:
    out = None
    for c in columns:
        out = F.col(c) if out is None else out + F.col(c)
    return out


def combo_targets(df: DataFrame, proxies: str | None = "_l10", combos: Mapping[str, Sequence[str]] = COMBOS) -> DataFrame:
    """Combined targets, and their line proxies as the sum of the parts' proxies."""
    out = {name: _total(parts) for name, parts in combos.items()}
    if proxies:
        out.update({f"{name}{proxies}": _total(f"{p}{proxies}" for p in parts) for name, parts in combos.items()})
    return df.withColumns(out)


def line_proxies(df: DataFrame, props: Sequence[str] = ("pts", "trb", "ast"), source: str = "_l10",
                 combos: Mapping[str, Sequence[str]] = COMBOS) -> DataFrame:
    """``*_line`` columns standing in for quoted lines."""
    out = {f"{p}_line": F.col(f"{p}{source}") for p in props}
    out.update({f"{n}_line": _total(f"{p}{source}" for p in parts) for n, parts in combos.items()})
    return df.withColumns(out)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def feature_columns(df: DataFrame, excluded: Iterable[str] = ID_COLUMNS | CURRENT_GAME | LINE_PROXIES) -> list[str]:
    """Numeric columns known before the event, sorted by name."""
    banned = set(excluded)
    strict = bool(LINE_PROXIES & banned - COMBO_PROXIES)

    def is_proxy(c: str) -> bool:
        return strict and c.endswith("_l10") and c[: -len("_l10")] in CURRENT_GAME

    return sorted(c for c in numeric_columns(df) if c not in banned and not is_proxy(c))


# role sets by which the regression models keep single-statistic L10 means as features
KEEP_L10 = ID_COLUMNS | CURRENT_GAME | COMBO_PROXIES


def leak_issues(features: Sequence[str], target: str | None = None) -> list[str]:
    """Reasons why a feature list must not be trained on."""
    issues = [f"current-event column {c}" for c in features if c in CURRENT_GAME]
    issues += [f"identifier {c}" for c in features if c in ID_COLUMNS]
    if target:
        issues += [f"line proxy of the target {c}" for c in features if c == f"{target}_l10"]
    return issues


def require_leak_free(features: Sequence[str], target: str | None = None) -> None:
    issues = leak_issues(features, target)
    if issues:
        raise ValueError("leaking features: " + "; ".join(issues))


def require_low_correlation(train: DataFrame, features: Sequence[str], labels: Mapping[str, str], vector: str = "features",
                            limit: float = 0.85) -> None:
    """Raise where a feature moves with a target so closely that it cannot be known before the event.

    ``vector`` holds the features as they are trained on; ``labels`` maps target names to their columns.  One
    co-moment matrix over vector and labels gives all correlations; it is as wide as there are features.
    """
    rows = train.where(F.lit(True) if not labels else _all_present(labels.values()))
    if not labels or len(rows.take(2)) < 2:
        return
    joined = VectorAssembler(inputCols=[vector, *labels.values()], outputCol="_all").transform(rows)
    matrix = Correlation.corr(joined, "_all").first()[0].toArray()
    n = len(features)
    found = [f"{f} with {t}: {matrix[i, n + j]:.4f}" for j, t in enumerate(labels) for i, f in enumerate(features)
             if abs(matrix[i, n + j]) > limit]  # NaN where a column does not vary
    if found:
        raise ValueError("leaking features by correlation: " + "; ".join(found))


def _all_present(columns: Iterable[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def modelling_table(df: DataFrame, features: Sequence[str], targets: Iterable[str] = TARGETS,
                    ids: Iterable[str] = ID_COLUMNS) -> DataFrame:
    """Identifiers, then targets, then features, each sorted; absent columns are left out."""
    def present(names: Iterable[str]) -> list[str]:
        return sorted(c for c in names if c in df.columns)

    return df.select(*present(ids), *present(targets), *present(features))


def enough_history(df: DataFrame, least: int = 10, counter: str = "games_played") -> DataFrame:
    return df.where(F.col(counter) >= least)


def history_report(df: DataFrame, least: int = 10, counter: str = "games_played") -> DataFrame:
    """Rows before and after the history filter."""
    kept = F.count_if(F.col(counter) >= least)
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows_before"), kept.alias("rows_after"), (n - kept).alias("removed"))


def temporal_split(df: DataFrame, test_days: int = 21, order: str = "game_date") -> DataFrame:
    """Mark rows from the last ``test_days`` days before the newest date: ``is_test`` is 0 or 1."""
    cutoff = df.agg(F.date_sub(F.max(order), test_days)).scalar()
    return df.withColumn("is_test", (F.col(order) >= cutoff).cast("int"))


def expanding_folds(df: DataFrame, order: str = "game_date", seq: Sequence[str] = ("seq",), k: int = 5,
                    ordinal: str = "ordinal") -> DataFrame:
    """Rows in time order with the fold that validates them, -1 for rows that are only trained on.

    With n rows each fold validates ``n // (k + 1)`` consecutive rows and trains on all rows before
    them; the last fold ends at the last row.
    """
    numbered = positions(df, [order, *seq], ordinal, total="_rows")
    rows, position = F.col("_rows"), F.col(ordinal) - 1
    size = F.floor(rows / F.lit(k + 1))
    fold = F.floor((position - (rows - size * k)) / size)
    return numbered.withColumn("fold", F.when(position >= rows - size * k, fold).otherwise(F.lit(-1)).cast("int")).drop("_rows")


def contiguous_folds(df: DataFrame, order: str, seq: Sequence[str], k: int = 3, name: str = "fold") -> DataFrame:
    """Unshuffled folds over the row order; the first ``n % k`` folds hold one row more."""
    numbered = positions(df, [order, *seq], "_ordinal", total="_rows")
    rows, position = F.col("_rows"), F.col("_ordinal") - 1
    base, longer = F.floor(rows / F.lit(k)), rows % k
    edge = longer * (base + 1)
    fold = F.when(position < edge, F.floor(position / (base + 1))).otherwise(longer + F.floor((position - edge) / base))
    return numbered.withColumn(name, fold.cast("int")).drop("_ordinal", "_rows")


def position_split(df: DataFrame, order: str, seq: Sequence[str], share: float = 0.8) -> DataFrame:
    """Mark the first ``share`` of the rows in time order as training rows."""
    numbered = positions(df, [order, *seq], "_ordinal", total="_rows")
    is_train = F.col("_ordinal") <= F.floor(F.col("_rows") * F.lit(share))
    return numbered.withColumn("is_train", is_train.cast("int")).drop("_ordinal", "_rows")
