"""Event-time rules as Structured Streaming queries.

Functions take and return streaming DataFrames; ``drain`` runs one to the end
of the available files. Watermarks bound every state store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import clients
from ..session import shared_folder

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The events of a folder as a stream; naive times become UTC instants, which
    watermarks need."""
    raw = (
        spark.readStream.schema(EVENTS)
        .option("pathGlobFilter", "events*.parquet")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"))


def drain(stream: DataFrame, run: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available and returns its output table.

    ``run``: a name for output and progress in the shared folder, chosen by the caller for one
    rule, its parameters and its input. A later call of the same name goes on from the last
    finished batch, also in another session. Without it the run is one of its own."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{run or uuid.uuid4().hex}"
    q = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def live_visitors(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Distinct visitors over sliding windows, counted exactly: first each visitor's views
    in a window, which may lie on many tasks, then the visitors of the window. The state
    holds the visitors of the windows that are still open."""
    each = (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window, slide).alias("w"), "user_id")
        .agg(F.count("*").alias("views"))
        .select(F.window_time("w").alias("closed"), "views")
    )
    return (
        each.groupBy(F.window("closed", slide).alias("w"))
        .agg(F.count("*").alias("visitors"), F.sum("views").alias("views"))
        .select(F.col("w.end").alias("until"), "visitors", "views")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Closed sessions with views and the first event's kind."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("views"), F.min_by("event_type", "ts").alias("landing"))
        .select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("closes_at"), "views", "landing")
    )


def delivery_dedupe(pairs: DataFrame, late: str = "48 hours") -> DataFrame:
    """Each (user, event) once within the lookback."""
    return pairs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_id"])


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What has been sent: user_id, event_id, ts, and the batch it lies under."""
    schema = "user_id long, event_id long, ts timestamp, batch string"
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)


def deliver(pairs: DataFrame, ledger: str, run: str) -> None:
    """Sends each (user, event) of ``pairs`` (user_id, event_id, ts, the time of the event) once, for good: what is in
    the ledger is not sent again, however late it comes back.

    A batch writes what it sends under its own name, ``run`` and the batch's number, so a batch
    that is repeated after a failure replaces what it had written and sends nothing twice; it
    does not look at its own rows. Batches are sorted by time, so of the ledger only row groups
    with events of the batch's span are read."""
    spark = pairs.sparkSession

    def send(batch: DataFrame, number: int) -> None:
        name = f"{run}-{number}"
        once = batch.groupBy("user_id", "event_id").agg(F.min("ts").alias("ts"))
        first, last = once.agg(F.min("ts"), F.max("ts")).first()
        sent = read_ledger(spark, ledger).where((F.col("batch") != name) & F.col("ts").between(first, last))
        new = once.join(sent.select("user_id", "event_id"), ["user_id", "event_id"], "left_anti")
        new.sortWithinPartitions("ts").write.mode("overwrite").parquet(f"{ledger}/batch={name}")

    spark.createDataFrame([], "user_id long, event_id long, ts timestamp").write.mode("overwrite").parquet(f"{ledger}/batch=none")
    q = pairs.writeStream.foreachBatch(send).option("checkpointLocation", f"{shared_folder(spark)}/stream-{run}/progress").trigger(availableNow=True).start()
    q.awaitTermination()


def standing_restocks(restocks: DataFrame, sellouts: DataFrame, delay: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Restocks not cancelled by a sell-out of the same key within the delay."""
    r = restocks.select("event_id", F.col("key").alias("r_key"), F.col("ts").alias("r_ts")).withWatermark("r_ts", late)
    o = sellouts.select(F.col("key").alias("o_key"), F.col("ts").alias("o_ts")).withWatermark("o_ts", late)
    cond = F.expr(f"r_key = o_key and o_ts > r_ts and o_ts <= r_ts + interval {delay}")
    return r.join(o, cond, "left_outer").where("o_key is null").select("event_id", F.col("r_key").alias("key"), "r_ts")


def fixed_window_limits(events: DataFrame, limit: int, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Keys over their limit in fixed windows."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.window("ts", window).alias("w"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > limit)
        .select("user_id", F.col("w.start").alias("window_start"), "n")
    )


def circuit_breaker(events: DataFrame, failures: int = 5, window: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Windows with enough failures to stop asking for a while."""
    return (
        events.where("event_type = 'error'")
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window, slide).alias("w"))
        .agg(F.count("*").alias("failures"))
        .where(F.col("failures") >= failures)
        .select(F.col("w.end").alias("until"), "failures")
    )


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("hour"), "event_type", "n")
    )


def zero_filled(counts: DataFrame, kinds: list[str]) -> DataFrame:
    """Hours without events as zeros, when the table is read. Only the span of
    hours and the few kinds are unfolded."""
    span = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour")).withColumn(
        "event_type", F.explode(F.array(*[F.lit(k) for k in kinds]))
    )
    return grid.join(counts, ["hour", "event_type"], "left").fillna(0, ["n"])


def enrich(views: DataFrame, catalog: DataFrame) -> DataFrame:
    """Page views with product facts and attribution; bots and unknown sources out.

    ``views``: (event_id, ts, user_id, csc, agent, token); stateless."""
    facts = catalog.select("csc", "name", "category")
    return (
        views.where(~clients.is_bot("agent"))
        .withColumn("a", clients.attribution("token"))
        .where("a is not null")
        .join(facts, "csc", "left")
        .select("event_id", "ts", "csc", "name", "category", "a.surface", "a.view", clients.device("agent").alias("device"))
    )
