"""Positions and running sums in the order of a whole table, by a two-level scan.

The rows are dealt into ranges of the order and sorted inside them.  A range knows the places of its own
rows; the totals of the ranges before it, one row per range, give where it begins.  No task sees more
than a range, and there is no window over the whole table.

Ranges are cut at sampled values, so the dealt rows are fixed before anything is counted: by a reliable
checkpoint where the cluster names a folder, else by keeping them.  Rows with equal order values share a
range, so ``order`` should tell rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gameline.session import use_checkpoint_folder

_RANGE_BITS = 33  # of the ids that Spark gives to rows: the partition stands above these bits


def _dealt(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows in order, with the number of their range and their place in it."""
    at = F.col("_at")
    # the ids are given by place, so they go on after the sort and before anything else
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
              .select(*df.columns, F.shiftright(at, _RANGE_BITS).alias("_range"), at.bitwiseAND((1 << _RANGE_BITS) - 1).alias("_place")))
    return placed.checkpoint() if use_checkpoint_folder(df.sparkSession) else placed.persist()


def positions(df: DataFrame, order: Sequence[str | Column], ordinal: str = "ordinal", total: str | None = None,
              sums: dict[str, str] | None = None) -> DataFrame:
    """Add the 1-based position of each row, the number of all rows as ``total``, and inclusive running sums.

    ``sums`` maps the name of a running sum to the column it adds up; NULL counts as zero.  An empty table
    stays empty.
    """
    rows = _dealt(df, order)
    sums = sums or {}
    own = {f"_t{i}": F.coalesce(F.sum(F.col(c)), F.lit(0)) for i, c in enumerate(sums.values())}
    ranges = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in own.items()])
    found = {r["_range"]: r for r in ranges.collect()}  # one row per range
    last = max(found, default=-1)

    def starts(name: str) -> Column:
        """What the ranges before each one add up to, as a constant array."""
        kind, so_far, out = ranges.schema[name].dataType, 0, []
        for i in range(max(last, 0) + 1):
            out.append(so_far)
            so_far += found[i][name] if i in found else 0
        listed = F.lit(",".join(map(repr if isinstance(kind, (T.DoubleType, T.FloatType)) else str, out)))
        return F.get(F.split(listed, ",").cast(T.ArrayType(kind)), F.col("_range").cast("int"))

    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    out = {ordinal: starts("_n") + F.col("_place") + 1}
    if total:
        out[total] = F.lit(sum(r["_n"] for r in found.values())).cast("long")
    for i, (name, source) in enumerate(sums.items()):
        out[name] = starts(f"_t{i}") + F.coalesce(F.sum(F.col(source)).over(inside), F.lit(0))
    return rows.select(*[c for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])
