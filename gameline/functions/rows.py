"""One-row results as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_of(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct: a scalar subquery, so nothing is joined."""
    return df.select(F.struct("*").alias("_row")).scalar()
