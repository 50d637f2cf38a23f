"""Rules over rows in order of event time, for streams whose files come in any order.

A rule that compares a row with the one before it needs all earlier rows. A row waits, filed by
batch and day, until the watermark (the newest time less ``late``) has passed its day; then the
day's rows go through the rule's batch form together with the last row of each of their keys.
Everything runs in Spark's own operators, so a hot key is split as it is in a batch.

* A batch writes only its own rows, what it releases, and the last rows of the keys it released;
  it reads only days that fall due. Last rows are a log, which is written whole every ``COMPACT``
  batches. Folders carry the batch's number and are replaced if the batch is repeated; the line
  in ``steps`` is written last and makes the batch count.
* Rows of days that are already released are too late; ``steps`` counts them.
* A run has a name chosen by the caller and goes on where it stopped, also after a restart.
  ``ended`` adds what the rule would release at the end of the input, without moving the run:
  files that come later are still in time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..operators import ingest
from ..session import shared_folder

COMPACT = 16
_STEPS = "batch long, newest timestamp_ntz, due date, log_from long, late_rows long"


def _first_at_a_time(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of rows of one key and time the one with the smallest number."""
    one = rows.groupBy(*keys, "seen_at").agg(F.min_by(F.struct(*columns), "seq").alias("r"))
    return one.select("r.*")


def _last(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    one = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("seen_at", "seq")).alias("r"))
    return one.select("r.*")


class Ordered:
    """A run of ``rule`` over rows (keys, seen_at, seq, ...), kept below ``base``. The rule takes
    rows and returns output with created_at, the time of the row that caused it."""

    def __init__(self, obs: DataFrame, keys: list[str], rule: Callable[[DataFrame], DataFrame], base: str, late: str):
        self.spark: SparkSession = obs.sparkSession
        self.obs = obs.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))
        self.keys, self.rule, self.base, self.late = keys, rule, base, late
        self.columns = self.obs.columns
        self.fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.obs.schema.fields)

    def _read(self, what: str, fields: str) -> DataFrame:
        return self.spark.read.schema(f"{fields}, batch long").parquet(f"{self.base}/{what}")

    def _state(self, before: int | None = None) -> Row | None:
        """The last step, of those before a batch that is being made."""
        steps = self.spark.read.schema(_STEPS).parquet(f"{self.base}/steps")
        return steps.where(F.lit(True) if before is None else F.col("batch") < before).orderBy(F.desc("batch")).first()

    def _due(self, since: Row | None, upto: int, until: str | None) -> tuple[DataFrame, DataFrame | None]:
        """Held rows from the days of ``since`` on up to a day, and the last rows of their keys."""
        held = self._read("held", f"{self.fields}, day date").where(F.col("batch") <= upto)
        if since is not None and since["due"] is not None:
            held = held.where(F.col("day") >= F.lit(since["due"]))
        rows = held if until is None else held.where(F.col("day") < F.lit(until))
        rows = _first_at_a_time(rows, self.keys, self.columns)
        if since is None or since["log_from"] is None:
            return rows, None
        log = self._read("last", self.fields).where((F.col("batch") >= since["log_from"]) & (F.col("batch") <= since["batch"]))
        return rows, _last(log, self.keys, self.columns)

    def _ruled(self, rows: DataFrame, last: DataFrame | None, since: Row | None) -> DataFrame:
        """The rule over ``rows`` behind the last rows of their keys, and what ``rows`` caused."""
        if last is None:
            return self.rule(rows)
        known = last.join(rows.select(*self.keys).distinct(), self.keys, "left_semi")
        return self.rule(known.unionByName(rows)).where(F.col("created_at") >= F.lit(since["due"]).cast("timestamp_ntz"))

    def _step(self, batch: DataFrame, number: int) -> None:
        since = self._state(number)
        batch.withColumn("day", F.to_date("seen_at")).write.mode("overwrite").partitionBy("day").parquet(f"{self.base}/held/batch={number}")
        mine = self._read("held", f"{self.fields}, day date").where(F.col("batch") == number)
        was = since["due"] if since else None
        newest, late_rows = mine.agg(F.max("seen_at"), F.count_if(F.col("day") < F.lit(was).cast("date"))).first()
        newest = max((x for x in (newest, since["newest"] if since else None) if x is not None), default=None)
        due = self.spark.sql(f"select to_date(:n - interval {self.late})", args={"n": newest}).first()[0] if newest else None
        due = max((d for d in (due, was) if d is not None), default=None)
        log_from = since["log_from"] if since else None
        if due != was:
            rows, last = self._due(since, number, due.isoformat())
            self._ruled(rows, last, since).write.mode("overwrite").parquet(f"{self.base}/out/batch={number}")
            ends = _last(rows, self.keys, self.columns)
            if log_from is None or number - log_from >= COMPACT:
                log_from = number
                ends = ends if last is None else _last(last.unionByName(ends), self.keys, self.columns)
            ends.write.mode("overwrite").parquet(f"{self.base}/last/batch={number}")
        step = self.spark.createDataFrame([(number, newest, due, log_from, late_rows)], _STEPS)
        step.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/steps/n={number}")

    def run(self, ended: bool) -> DataFrame:
        """Reads what is available; returns all output so far."""
        self.spark.createDataFrame([], _STEPS).write.mode("ignore").parquet(f"{self.base}/steps/n=none")
        self.spark.createDataFrame([], self.obs.schema).write.mode("ignore").parquet(f"{self.base}/held/batch=-1/day=1970-01-01")
        shape = self.rule(self.spark.createDataFrame([], self.obs.schema))
        shape.write.mode("ignore").parquet(f"{self.base}/out/batch=-1")
        q = self.obs.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.base}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
        at = self._state()
        upto = at["batch"] if at else -1
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema.fields)
        out = self._read("out", fields).where(F.col("batch") <= upto).drop("batch")
        if not ended or at is None:
            return out
        rows, last = self._due(at, upto, None)
        return out.unionByName(self._ruled(rows, last, at))


def _run(obs: DataFrame, keys: list[str], rule: Callable[[DataFrame], DataFrame], run: str | None, late: str, ended: bool) -> DataFrame:
    base = f"{shared_folder(obs.sparkSession)}/ordered-{run or uuid.uuid4().hex}"
    return Ordered(obs, keys, rule, base, late).run(ended)


def change_events(obs: DataFrame, max_gap_hours: int = 48, run: str | None = None, late: str = "7 days", ended: bool = False) -> DataFrame:
    """Typed changes of each key against its last known state; after a longer gap the state is
    renewed without events. ``obs``: a stream of (csc, seen_at, seq, store_qty, price)."""
    return _run(obs, ["csc"], lambda rows: ingest.change_events(rows, max_gap_hours), run, late, ended)


def store_restocks(obs: DataFrame, max_age_hours: int = 168, run: str | None = None, late: str = "7 days", ended: bool = False) -> DataFrame:
    """Stores known to be empty, not too long ago, that have stock again.
    ``obs``: a stream of (csc, store_id, seen_at, seq, qty)."""
    return _run(obs, ["csc", "store_id"], lambda rows: ingest.store_restock_events(rows, max_age_hours).drop("prev_checked_at"), run, late, ended)
