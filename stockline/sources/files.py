"""Readers with explicit schemas and writers that replace whole results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Line-delimited JSON; rows that do not fit land in ``_corrupt_record``."""
    full = schema.add("_corrupt_record", T.StringType()) if "_corrupt_record" not in schema.names else schema
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = schema.add("_corrupt_record", T.StringType()) if "_corrupt_record" not in schema.names else schema
    return (
        spark.read.schema(full)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )


def write_months(df: DataFrame, path: str, month: str = "period_month") -> None:
    """Replaces only the months present in ``df``; other months stay as they are.

    Rows are spread by month and a hash of the row so that one large month is
    written by many tasks."""
    spread = F.pmod(F.hash(*df.columns), F.lit(16))
    (
        df.repartition(F.col(month), spread)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(month)
        .parquet(path)
    )


def replace_table(df: DataFrame, path: str, minimum_rows: int = 1) -> int:
    """Writes a computed table beside the old one, checks its size, then swaps.

    The new rows are complete on disk before the old table moves, and nothing
    changes when the check fails. Returns the number of rows."""
    spark = df.sparkSession
    jvm = spark._jvm
    staged, old = f"{path}.staged", f"{path}.previous"
    df.write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged).count()
    if rows < minimum_rows:
        raise ValueError(f"{rows} rows computed, at least {minimum_rows} expected; {path} is unchanged")
    hadoop = spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(hadoop)
    before = jvm.org.apache.hadoop.fs.Path(old)
    staging = jvm.org.apache.hadoop.fs.Path(staged)
    if fs.exists(target):
        # The old table is removed last, when the new one stands in its place.
        if fs.exists(before) and not fs.delete(before, True):
            raise OSError(f"{old} cannot be removed; {path} is unchanged")
        if not fs.rename(target, before):
            raise OSError(f"{path} cannot be moved away and is unchanged")
        if not fs.rename(staging, target):
            back = fs.rename(before, target)
            raise OSError(f"{staged} cannot be moved; {path} is {'unchanged' if back else f'left at {old}'}")
    elif not fs.rename(staging, target):
        raise OSError(f"{staged} cannot be moved to {path}")
    return rows
