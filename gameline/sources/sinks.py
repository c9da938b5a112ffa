"""Table outputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gameline.operators.latest import upsert


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """Write a table; with partition columns only the partitions in ``df`` are replaced."""
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def write_run(df: DataFrame, path: str, run_date: Column) -> None:
    """Write one run's rows under its date, in place of any earlier rows of that date, also when there are none."""
    day = df.sparkSession.range(1).select(run_date.cast("date").cast("string")).first()[0]
    write_table(df.drop("run_date"), f"{path}/run_date={day}")


def read_latest_run(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest run; the date comes from the folder names, so other runs are not read."""
    runs = spark.read.parquet(path)
    newest = runs.agg(F.max("run_date")).first()[0]
    return runs.where(F.col("run_date") == F.lit(newest))


def write_gated(df: DataFrame, checks: DataFrame, path: str, **options) -> bool:
    """Write only when every check passed; says whether it did."""
    from gameline.operators.quality import all_passed

    if not all_passed(checks):
        return False
    write_table(df, path, **options)
    return True


def merge_table(new: DataFrame, path: str, key: Sequence[str], order: Sequence[str] = (), date: str = "game_date",
                period: str = "MM") -> None:
    """Merge a batch into a table that is stored by period: one row per key, the newest batch winning.

    ``key`` has the date in it, so a row's older versions lie in its own period, and only periods with new
    rows are read and replaced; the files of the others are not touched.  ``period`` is what dates are truncated
    to.  The first batch makes the table.
    """
    spark, part = new.sparkSession, "stored_period"
    if date not in key:
        raise ValueError(f"the key must hold {date}, by which the table is stored")
    fresh = new.withColumn(part, F.trunc(F.col(date).cast("date"), period).cast("string"))
    touched = [r[0] for r in fresh.select(part).distinct().collect()]  # one value for each period of the batch
    if not touched:
        return
    if _exists(spark, path):
        old = spark.read.option("mergeSchema", "true").schema(_stored_schema(spark, path, part)).parquet(path)
        met = F.col(part).isin([t for t in touched if t is not None])
        if None in touched:
            met = F.coalesce(met, F.lit(True))
        merged = upsert(old.where(met), fresh, [*key, part], order)
    else:
        merged = upsert(fresh.limit(0), fresh, [*key, part], order)
    write_table(merged, path, [part])


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``merge_table`` keeps."""
    return spark.read.schema(_stored_schema(spark, path, "stored_period")).parquet(path).drop("stored_period")


def _stored_schema(spark: SparkSession, path: str, part: str) -> T.StructType:
    """The columns of all stored files, the period as text."""
    found = spark.read.option("mergeSchema", "true").parquet(path).schema
    return T.StructType([T.StructField(f.name, T.StringType() if f.name == part else f.dataType) for f in found])


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, system = _file_system(spark, path)
    return system.exists(place)


def publish(df: DataFrame, path: str, checks: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Write a new version of a table beside the others, check it, and only then let readers see it.

    A version is a folder of its own under ``path``; the file ``current`` names the one that counts and is
    replaced by one rename.  A failing write or check leaves the last good version in place.  Says whether
    the new version counts; versions that do not are left for a clean-up by age.
    """
    spark, version = df.sparkSession, f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    if checks is not None:
        from gameline.operators.quality import all_passed

        if not all_passed(checks(spark.read.schema(df.schema).parquet(f"{path}/{version}"))):
            return False
    target, system = _file_system(spark, f"{path}/current")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current-{version}")
    out = system.create(draft)
    out.write(bytearray(version.encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    over = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    files.rename(system.makeQualified(draft), system.makeQualified(target), options)
    return True


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version of a published table that counts."""
    version = spark.read.text(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/{version}")


def write_json(df: DataFrame, path: str) -> None:
    """Small record tables such as run summaries."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_report(bets: DataFrame, folder: str) -> None:
    """Summary export: results by prop, by edge and the best threshold."""
    from gameline.operators import decisions

    sweep = decisions.threshold_sweep(bets)
    write_table(decisions.breakdown(bets, "prop"), f"{folder}/by_prop")
    write_table(decisions.by_edge_bucket(bets), f"{folder}/by_edge")
    write_table(decisions.best_threshold(sweep), f"{folder}/best_threshold")
