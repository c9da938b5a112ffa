"""Exact medians, correlations, profiles and other table statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gameline.functions.rows import row_of


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name",
            value: str = "value") -> DataFrame:
    """One row per listed column."""
    return df.unpivot(list(ids), list(columns), name, value)


def exact_medians_long(df: DataFrame, columns: Sequence[str], accuracy: int = 10000, cells: int = 4096) -> DataFrame:
    """Exact median of each column as (name, median) rows, without gathering a column in one task.

    A sketch brackets the middle ranks.  One more pass counts distinct values: everything outside the
    bracket falls into one cell on either side, the inside into ``cells`` equal cells.  Running counts
    over the cells name the one or two cells with the middle, and only their values are ordered.
    """
    near = 3.0 / accuracy
    points = F.array(F.lit(0.5 - near), F.lit(0.5 + near))
    sketch = df.agg(*[F.percentile_approx(F.col(c).cast("double"), points, F.lit(accuracy)).alias(c)
                      for c in columns])
    bounds = sketch.unpivot([], list(columns), "_name", "_bounds")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "name", "value").where(F.col("value").isNotNull())
    v, low, high = F.col("value"), F.col("_bounds")[0], F.col("_bounds")[1]
    inside = F.floor(F.coalesce(F.try_divide(v - low, high - low), F.lit(0.0)) * cells)
    cell = F.when(v < low, F.lit(-1)).when(v > high, F.lit(cells + 1)).otherwise(inside)
    # the bounds hold one row per listed column
    counts = (long.join(F.broadcast(bounds), F.col("name") == F.col("_name"))
              .groupBy("name", cell.alias("cell"), F.when((v >= low) & (v <= high), v).alias("value"))
              .agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy("name")
    first, last = F.floor((F.col("_total") + 1) / F.lit(2)), F.ceil((F.col("_total") + 1) / F.lit(2))
    middle = (counts.groupBy("name", "cell").agg(F.sum("_n").alias("_c"))
              .withColumns({"_total": F.sum("_c").over(w), "_upto": F.sum("_c").over(
                  w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))})
              .withColumns({"_first": first, "_last": last, "_before": F.col("_upto") - F.col("_c")})
              .where((F.col("_upto") >= F.col("_first")) & (F.col("_before") < F.col("_last")))
              .select(F.col("name").alias("_m"), F.col("cell").alias("_k"), "_before", "_first", "_last"))
    # at most two cells per column hold the middle ranks
    picked = counts.join(F.broadcast(middle), (F.col("name") == F.col("_m")) & (F.col("cell") == F.col("_k")))
    upto = F.col("_before") + F.sum("_n").over(
        Window.partitionBy("name", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = picked.withColumn("_rank", upto)
    return ranked.groupBy("name").agg(
        ((F.min(F.when(F.col("_rank") >= F.col("_first"), F.col("value")))
          + F.min(F.when(F.col("_rank") >= F.col("_last"), F.col("value")))) / F.lit(2.0)).alias("median"))


def exact_medians(df: DataFrame, columns: Sequence[str], accuracy: int = 10000) -> DataFrame:
    """One row with the exact median of each column."""
    long = exact_medians_long(df, columns, accuracy)
    return long.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns])


def fill_medians(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Fill NULL with the exact median of ``fitted_on`` (the table itself by default)."""
    row = exact_medians(fitted_on if fitted_on is not None else df, columns)
    medians = row_of(row)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), medians[c]) for c in columns})


def pair_correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over rows where both values are present."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.corr(a.cast("double"), b.cast("double"))


def target_correlations(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Correlation of every feature with every target in one aggregation, as (target, feature, corr) rows."""
    pairs = [(t, f) for t in targets for f in features]
    row = df.agg(*[pair_correlation(f, t).alias(f"c{i}") for i, (t, f) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.col(f"c{i}").alias("corr"))
                      for i, (t, f) in enumerate(pairs)])
    return (row.select(F.explode(cells).alias("_cell")).select("_cell.*")
            .withColumn("abs_corr", F.abs("corr")))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, non-NULL count, NULL share, minimum, maximum, mean and sample deviation of each column."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                 F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    cells = F.array(*[F.struct(
        F.lit(c).alias("name"), F.col("rows"), F.col(f"n{i}").alias("non_null"),
        (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
        F.try_divide((F.col("rows") - F.col(f"n{i}")) * F.lit(100.0), F.col("rows")).alias("null_pct"),
        F.col(f"lo{i}").alias("minimum"), F.col(f"hi{i}").alias("maximum"),
        F.col(f"mean{i}").alias("mean"), F.col(f"sd{i}").alias("std")) for i, c in enumerate(columns)])
    return row.select(F.explode(cells).alias("_cell")).select("_cell.*")


def key_profile(df: DataFrame, key: Sequence[str], distinct: Sequence[str]) -> DataFrame:
    """Rows, rows beyond the first of their key, and distinct counts of the listed columns."""
    keys = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    counts = row_of(df.agg(*[F.countDistinct(c).alias(c) for c in distinct]))
    return keys.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows")).select(
        "rows", "duplicate_rows", *[counts[c].alias(f"distinct_{c}") for c in distinct])


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Most frequent values with their counts; ties go to the smaller value."""
    return (df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), *columns).limit(k))


def modes(df: DataFrame, entity: Sequence[str], column: str) -> DataFrame:
    """Most frequent value of a column for each entity; ties go to the smaller value, NULL does not count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*entity, column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*entity).orderBy(F.desc("n"), column)  # one row per value of an entity
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def seeded_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a seeded hash of their key: the same rows on every run and in every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return df.withColumn("_h", F.md5(text)).orderBy("_h", *key).limit(n).drop("_h")


def line_fit(df: DataFrame, x: str, y: str, train: Column) -> DataFrame:
    """Least-squares line fitted where ``train`` holds, scored on the other rows."""
    part = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_train", train)
    fit = row_of(part.where("_train").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.count(F.lit(1)).alias("train_rows")))
    test = part.where(~F.col("_train")).withColumn("_e", F.col(y) - (fit["intercept"] + fit["slope"] * F.col(x)))
    e = F.col("_e")
    scored = test.agg(F.count(F.lit(1)).alias("test_rows"), F.avg(F.abs(e)).alias("mae"),
                      (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"))
    return scored.select(fit["slope"].alias("slope"), fit["intercept"].alias("intercept"),
                         fit["train_rows"].alias("train_rows"), "test_rows", "mae", "r2")
