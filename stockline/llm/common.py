"""Helpers the operators share: tables, the shared folder, hashing and words."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import checkpointed, prepare, shared_folder

__all__ = ["SPACES", "checkpointed", "discard", "fresh_folder", "keep_where", "numbered", "prepare", "release", "table", "written"]

# The white space that parts words.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: what was computed once stays, whoever is lost."""
    path = fresh_folder(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of ``written`` tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the cluster delete the shuffle files of plans that are done. Spark does so when the
    driver's garbage collector meets such a plan, which a driver with room to spare puts off."""
    spark._jvm.System.gc()


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that is not moved below the columns it reads, which would compute them twice.
    Filters do not pass a projection with a row number."""
    numbered = df.withColumn("__place__", F.monotonically_increasing_id())
    return numbered.filter(condition & (F.col("__place__") >= 0)).drop("__place__")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, group: list[str], order: list[str], what: str) -> DataFrame:
    """``df`` written in order, with ``idx``: a row's place within its group, from 0, gapless.

    Rows are dealt by ranges of (group, order, place in the input), so that neither a hot group
    nor rows that are equal throughout land in one task; the groups' rows are then counted a
    partition, and the counts, not the rows, are summed up in order."""
    by = [*group, *order, "__tie"]
    rows = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = written(rows.drop("__tie").withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33)), what)
    counts = rows.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__at", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    starts = starts.select("__part", "__first", "__at", *[F.col(c).alias(f"__{c}") for c in group])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group]
    placed = rows.alias("r").join(starts.withColumnRenamed("__part", "__p"), reduce(and_, same, F.col("__part") == F.col("__p")))
    return placed.select("r.*", (F.col("__at") + F.col("__row") - F.col("__first")).alias("idx")).drop("__row", "__part")
