"""Delta history, as-of values and intervals.

Observations are ``(csc, seen_at, store_qty, price)`` rows, store observations
``(csc, store_id, seen_at, qty)``; a value holds until the next row of its key.
Unknown is never zero, and outages leave the denominators.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import skew, times
from ..session import checkpointed

OUTAGE_HOURS = 48


def _day(c: str = "seen_at") -> Column:
    """History is cut by calendar day when a key's rows are spread over tasks."""
    return F.to_date(c)


def good_runs(runs: DataFrame, job: str = "catalog") -> DataFrame:
    return runs.where((F.col("job") == job) & F.col("ok") & F.col("finished_at").isNotNull())


def observed_days(runs: DataFrame, since: datetime | None = None, zone: str = times.LOCAL_ZONE) -> DataFrame:
    """Local days with at least one good run, with its first and last finish."""
    good = good_runs(runs)
    if since is not None:
        good = good.where(F.col("finished_at") >= times.ts(since))
    return good.groupBy(times.local_date("finished_at", zone).alias("d")).agg(
        F.min("finished_at").alias("t_first"), F.max("finished_at").alias("t_last")
    )


def state_intervals(obs: DataFrame, delisted: DataFrame | None = None) -> DataFrame:
    """``[t0, t1)`` per observation; ``t1`` is null while the state still holds."""
    nxt = skew.neighbours(obs.select("csc", "seen_at", "store_qty"), ["csc"], ["seen_at"], _day(), next={"next_at": "seen_at"})
    end = F.col("next_at")
    if delisted is not None:
        nxt = nxt.join(delisted.select("csc", "delisted_at"), "csc", "left")
        end = F.least("next_at", "delisted_at")
    return nxt.select(
        "csc", F.col("seen_at").alias("t0"), end.alias("t1"), (F.coalesce("store_qty", F.lit(0)) > 0).alias("on_shelf")
    )


def day_grid(intervals: DataFrame, days: DataFrame, as_of: datetime, zone: str = times.LOCAL_ZONE) -> DataFrame:
    """In stock or not per key and observed day.

    Each interval becomes its calendar days, clipped to the observed span, and
    meets the observed days by equality; no range join is planned.
    """
    span = days.agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("t_first").alias("t_first"))
    d0, d1, start = (span.select(c).scalar() for c in ("d0", "d1", "t_first"))
    open_end = F.least(F.coalesce("t1", times.ts(as_of)), times.ts(as_of))
    exploded = (
        intervals.where(F.col("t1").isNull() | (F.col("t1") > start))
        .select(
            "csc",
            "t0",
            "t1",
            "on_shelf",
            F.greatest(times.local_date("t0", zone), d0).alias("a"),
            F.least(times.local_date(open_end, zone), d1).alias("b"),
        )
        .where("a <= b")
        .select("csc", "t0", "t1", "on_shelf", F.explode(F.sequence("a", "b")).alias("d"))
    )
    return (
        exploded.join(days, "d")
        .where((F.col("t0") <= F.col("t_last")) & (F.col("t1").isNull() | (F.col("t1") > F.col("t_first"))))
        .groupBy("csc", "d")
        .agg(F.bool_or("on_shelf").alias("in_stock"))
    )


def run_gaps(runs: DataFrame, hours: int = OUTAGE_HOURS, job: str = "catalog") -> DataFrame:
    """Pairs of consecutive good runs more than ``hours`` apart."""
    good = runs.where((F.col("job") == job) & F.col("ok")).select("started_at")
    nxt = skew.neighbours(good, [], ["started_at"], _day("started_at"), next={"next_at": "started_at"})
    return nxt.where(F.col("next_at") - F.col("started_at") > F.expr(f"interval {hours} hours")).select(
        F.col("started_at").alias("gap_from"), F.col("next_at").alias("gap_to")
    )


def _gap_array(gaps: DataFrame, *cols: Column) -> Column:
    """Outages as one ordered array. They are at least two days apart, so a
    decade holds fewer than two thousand."""
    return gaps.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("g")).scalar()


def outage_capped_intervals(store_obs: DataFrame, runs: DataFrame, grace_hours: int = 12) -> DataFrame:
    """Store intervals also end at the first outage start at or after ``t0``."""
    starts = _gap_array(
        run_gaps(runs).select((F.col("gap_from") + F.expr(f"interval {grace_hours} hours")).alias("s")), F.col("s")
    )
    nxt = skew.neighbours(
        store_obs.select("csc", "store_id", "seen_at", "qty"), ["csc", "store_id"], ["seen_at"], _day(), next={"next_at": "seen_at"}
    ).withColumn("__gaps", starts)
    cut = F.array_min(F.transform(F.filter("__gaps", lambda g: g["s"] >= F.col("seen_at")), lambda g: g["s"]))
    return nxt.select(
        "csc", "store_id", F.col("seen_at").alias("t0"), F.least("next_at", cut).alias("t1"), (F.col("qty") > 0).alias("pos")
    )


def stores_per_day(
    grid: DataFrame,
    intervals: DataFrame,
    days: DataFrame,
    store_obs: DataFrame,
    as_of: datetime,
    zone: str = times.LOCAL_ZONE,
) -> DataFrame:
    """Distinct stores holding stock on each in-stock day, by a sweep over the days. Days
    before a key's first store check are unknown and absent."""
    known = store_obs.groupBy("csc").agg(F.min("seen_at").alias("first_check"))
    base = (
        grid.where("in_stock")
        .join(days, "d")
        .join(known, "csc")
        .where(F.col("first_check") <= F.col("t_last"))
        .select("csc", "d")
    )
    numbers = day_numbers(days)
    steps = _held_marks(intervals, numbers, as_of, zone)
    asked = base.join(numbers.where("seen").select("d", F.col("after").alias("i")), "d").select("csc", "i", F.lit(0).alias("step"), "d")
    both = asked.unionByName(steps.withColumn("d", F.lit(None).cast("date"))).groupBy("csc", "i").agg(F.sum("step").alias("step"), F.max("d").alias("d"))
    held = skew.running(both, ["csc"], ["i"], F.floor(F.col("i") / 30), {"stores": "step"})
    return held.where(F.col("d").isNotNull()).select("csc", "d", F.col("stores").cast("bigint").alias("stores"))


def day_numbers(days: DataFrame) -> DataFrame:
    """One row per calendar day of the window: whether it was observed, the number of the first
    observed day from it on (``after``) and of the last up to it (``before``)."""
    span = days.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a is not null")
    calendar = span.select(F.explode(F.sequence("a", "b")).alias("d")).join(days.select("d", "t_first", "t_last"), "d", "left")
    seen = F.count("t_first").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))  # a row per day
    numbered = calendar.withColumn("__n", seen).withColumn("seen", F.col("t_first").isNotNull())
    return numbered.select("d", "t_first", "t_last", "seen", (F.col("__n") - F.col("seen").cast("int")).alias("after"), (F.col("__n") - 1).alias("before"))


def _held_marks(intervals: DataFrame, numbers: DataFrame, as_of: datetime, zone: str) -> DataFrame:
    """Marks (csc, i, step): a store begins (+1) or stops (-1) to hold stock with observed day i.
    Summed up in order they are the stores holding stock, without a row per store and day. A
    store's stretches that share a day are joined, so it counts once."""
    stop = F.least(F.coalesce("t1", times.ts(as_of)), times.ts(as_of))
    held = intervals.where("pos").select("csc", "store_id", "t0", "t1", times.local_date("t0", zone).alias("a"), times.local_date(stop, zone).alias("b"))
    first, last = numbers.agg(F.min("d")).scalar(), numbers.agg(F.max("d")).scalar()
    days = numbers.agg(F.max("before") + 1).scalar()
    start = numbers.select(F.col("d").alias("a"), F.col("t_last").alias("a_last"), F.col("seen").alias("a_seen"), F.col("after").alias("a_after"))
    end = numbers.select(F.col("d").alias("b"), F.col("t_first").alias("b_first"), F.col("seen").alias("b_seen"), F.col("before").alias("b_before"))
    # A day that ended before the stretch began, or began after it stopped, is not in it.
    i = F.when(F.col("a") < first, 0).when(F.col("a") > last, days).otherwise(F.col("a_after") + (F.col("a_seen") & (F.col("t0") > F.col("a_last"))).cast("int"))
    over = F.col("b_seen") & F.col("t1").isNotNull() & (F.col("t1") <= F.col("b_first"))
    j = F.when(F.col("b") < first, -1).when(F.col("b") > last, days - 1).otherwise(F.col("b_before") - over.cast("int"))
    spans = held.join(F.broadcast(start), "a", "left").join(F.broadcast(end), "b", "left")  # a row per calendar day
    spans = spans.select("csc", "store_id", "t0", i.alias("i"), j.alias("j")).where("i <= j")
    spans = skew.neighbours(spans, ["csc", "store_id"], ["t0"], F.to_date("t0"), prev={"upto": "j"})
    spans = spans.withColumn("i", F.greatest("i", F.coalesce(F.col("upto") + 1, F.lit(0)))).where("i <= j")
    marks = F.array(F.struct(F.col("i").cast("long").alias("i"), F.lit(1).alias("step")), F.struct((F.col("j") + 1).cast("long").alias("i"), F.lit(-1).alias("step")))
    return spans.select("csc", F.explode(marks).alias("m")).select("csc", "m.i", "m.step")


def coverage_gaps(days: DataFrame) -> DataFrame:
    """One row: observed days, span, missing stretches, any holiday-month day.
    ``days`` holds one row per calendar day of the window."""
    w = Window.orderBy("d")
    steps = days.select("d", (F.datediff(F.lead("d").over(w), "d") - 1).alias("missing"))
    label = F.concat_ws(":", times.text("d"), F.col("missing").cast("string"))
    return steps.agg(
        F.count("*").alias("observed"),
        times.text(F.min("d")).alias("first"),
        times.text(F.max("d")).alias("last"),
        (F.datediff(F.max("d"), F.min("d")) + 1).cast("bigint").alias("span"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("missing") > 0, label))), " ").alias("gaps"),
        F.coalesce(F.bool_or(F.month("d").isin(11, 12)), F.lit(False)).alias("holiday_observed"),
    )


def transitions(grid: DataFrame) -> DataFrame:
    """Observed and in-stock days, restocks and sell-outs between consecutive
    observed days. A key has at most one row per day of the window."""
    prev = F.lag("in_stock").over(Window.partitionBy("csc").orderBy("d"))
    return (
        grid.withColumn("prev", prev)
        .groupBy("csc")
        .agg(
            F.count("*").alias("observed_days"),
            F.count_if("in_stock").alias("in_stock_days"),
            F.count_if(F.expr("in_stock and prev = false")).alias("restocks"),
            F.count_if(F.expr("not in_stock and prev = true")).alias("sellouts"),
        )
    )


def peak_with_carry_in(obs: DataFrame, start: Column) -> DataFrame:
    """Highest count in the window, or the count carried into it."""
    inside = F.col("seen_at") >= start
    return obs.groupBy("csc").agg(
        F.greatest(
            F.max(F.when(inside, F.col("store_qty"))),
            F.max_by("store_qty", F.when(~inside, F.col("seen_at"))),
        ).alias("peak_shelf")
    )


def last_on_shelf(obs: DataFrame, as_of: datetime) -> DataFrame:
    nxt = skew.neighbours(obs.select("csc", "seen_at", "store_qty"), ["csc"], ["seen_at"], _day(), next={"next_at": "seen_at"})
    return (
        nxt.where(F.coalesce("store_qty", F.lit(0)) > 0)
        .groupBy("csc")
        .agg(F.max(F.coalesce("next_at", times.ts(as_of))).alias("last_on_shelf"))
    )


def stores_seen(store_obs: DataFrame, store_now: DataFrame, start: Column) -> DataFrame:
    ever = store_obs.where((F.col("qty") > 0) & (F.col("seen_at") >= start)).select("csc", "store_id")
    now = store_now.where("qty > 0").select("csc", "store_id")
    return ever.unionByName(now).groupBy("csc").agg(F.countDistinct("store_id").alias("stores_seen"))


def stores_now(store_now: DataFrame, as_of: datetime, fresh_hours: int = 168) -> DataFrame:
    fresh = (F.col("qty") > 0) & (F.col("seen_at") > times.ago(as_of, f"{fresh_hours} hours"))
    return store_now.groupBy("csc").agg(F.count_if(fresh).alias("stores_now"))


def presence_percentiles(per_day: DataFrame) -> DataFrame:
    """Median, 10th and 90th percentile of stores per day; at most one value
    per key and day of the window goes into each."""
    return per_day.groupBy("csc").agg(
        F.count("*").alias("store_days"),
        F.expr("percentile_cont(0.5) within group (order by stores)").alias("typical_stores"),
        F.expr("percentile_disc(0.1) within group (order by stores)").cast("bigint").alias("stores_low"),
        F.expr("percentile_disc(0.9) within group (order by stores)").cast("bigint").alias("stores_high"),
    )


def stock_metrics(
    listed: DataFrame,
    obs: DataFrame,
    store_obs: DataFrame,
    store_now: DataFrame,
    runs: DataFrame,
    as_of: datetime,
    since: datetime | None = None,
) -> DataFrame:
    """One row per listed key with every shelf measure.

    The observed days (one row a day) and the day grid are each read by several
    measures, so both are written once instead of being computed again."""
    days = checkpointed(observed_days(runs, since))
    start = days.agg(F.min("t_first")).scalar()
    known = listed.where(F.col("delisted_at").isNull())
    grid = checkpointed(day_grid(state_intervals(obs.join(known.select("csc"), "csc", "left_semi")), days, as_of))
    per_day = stores_per_day(grid, outage_capped_intervals(store_obs, runs), days, store_obs, as_of)
    zero = F.lit(0)
    return (
        known.select("csc", "name", "category", "status", "first_seen", "store_qty")
        .join(transitions(grid), "csc", "left")
        .join(peak_with_carry_in(obs, start), "csc", "left")
        .join(last_on_shelf(obs, as_of), "csc", "left")
        .join(stores_seen(store_obs, store_now, start), "csc", "left")
        .join(stores_now(store_now, as_of), "csc", "left")
        .join(presence_percentiles(per_day), "csc", "left")
        .select(
            "csc",
            "name",
            "category",
            "status",
            "first_seen",
            *[F.coalesce(c, zero).alias(c) for c in ("observed_days", "in_stock_days", "restocks", "sellouts")],
            F.coalesce("stores_seen", zero).alias("stores_seen"),
            F.col("stores_now").isNotNull().alias("has_store_data"),
            F.coalesce("stores_now", zero).alias("stores_now"),
            F.coalesce("store_days", zero).alias("store_days"),
            "typical_stores",
            "stores_low",
            "stores_high",
            "peak_shelf",
            (F.coalesce("store_qty", zero) > 0).alias("in_stock_now"),
            "last_on_shelf",
        )
    )


def unbroken_since(runs: DataFrame, hours: int = OUTAGE_HOURS) -> DataFrame:
    """Start of the current run of passes without a longer gap."""
    good = runs.where("job = 'catalog' and ok").select("started_at")
    prev = skew.neighbours(good, [], ["started_at"], _day("started_at"), prev={"prev_at": "started_at"})
    fresh_start = F.col("prev_at").isNull() | (
        F.col("started_at") - F.col("prev_at") > F.expr(f"interval {hours} hours")
    )
    return prev.where(fresh_start).agg(F.max("started_at").alias("since"))


def returned_after_absence(
    obs: DataFrame,
    runs: DataFrame,
    as_of: datetime,
    absence_hours: float = 30 * 24,
    back_within_days: int = 14,
    gap_hours: int = OUTAGE_HOURS,
) -> DataFrame:
    """Keys whose last confirmed zero stretch was long, watched, and is over.

    The stretch starts where a count falls to zero after being positive and
    ends at the next positive count. It counts when the passes covered all of
    it, one of them shortly before it began.
    """
    flags = obs.select("csc", "seen_at", (F.coalesce("store_qty", F.lit(0)) > 0).alias("pos"))
    turned = skew.neighbours(flags, ["csc"], ["seen_at"], _day(), prev={"was": "pos"})
    stretch = (
        turned.groupBy("csc")
        .agg(
            F.max(F.when(F.expr("not pos and was"), F.col("seen_at"))).alias("out_since"),
            F.max(F.when(F.expr("pos and not was"), F.col("seen_at"))).alias("back_at"),
        )
        .where("back_at > out_since")
        .where(F.col("back_at") > times.ago(as_of, f"{back_within_days} days"))
        .where(times.hours_between("back_at", "out_since") >= absence_hours)
    )
    gaps = _gap_array(run_gaps(runs, gap_hours), F.col("gap_from"), F.col("gap_to"))
    good = runs.where("job = 'catalog' and ok")
    margin = F.expr(f"interval {gap_hours} hours")
    seen = (
        stretch.withColumn("__gaps", gaps)
        .withColumn("__first", good.agg(F.min("started_at")).scalar())
        .withColumn("__last", good.agg(F.max("started_at")).scalar())
    )
    inside = F.exists("__gaps", lambda g: (g["gap_to"] > F.col("out_since")) & (g["gap_from"] < F.col("back_at")))
    before = F.exists(
        "__gaps", lambda g: (g["gap_from"] <= F.col("out_since") - margin) & (g["gap_to"] >= F.col("out_since"))
    )
    watched = (
        (F.col("__first") < F.col("out_since"))
        & ((F.col("__last") >= F.col("out_since")) | (F.col("__last") > F.col("out_since") - margin))
        & ~before
    )
    return seen.where(~inside & watched).select("csc", "out_since", "back_at")


def price_last_change(obs: DataFrame) -> DataFrame:
    """Direction, previous price and time of the last price change, or "same"."""
    priced = obs.where(F.col("price").isNotNull()).select("csc", "seen_at", "price")
    prev = skew.neighbours(priced, ["csc"], ["seen_at"], _day(), prev={"was": "price"})
    moved = F.col("was").isNotNull() & (F.col("was") != F.col("price"))
    rank = F.when(moved, F.col("seen_at"))
    return (
        prev.groupBy("csc")
        .agg(
            F.max_by("price", "seen_at").alias("price"),
            F.max_by("was", rank).alias("previous"),
            F.max(rank).alias("changed_at"),
        )
        .withColumn(
            "direction",
            F.when(F.col("changed_at").isNull(), "same").when(F.col("previous") > F.col("price"), "down").otherwise("up"),
        )
    )


def asof_value(obs: DataFrame, probes: DataFrame, value: str = "store_qty") -> DataFrame:
    """The value holding at each probe ``(csc, seen_at)``; null before the first row."""
    marks = obs.select("csc", "seen_at", F.col(value).alias("v"), F.lit(0).alias("probe"))
    asked = probes.select("csc", "seen_at", F.lit(None).cast(marks.schema["v"].dataType).alias("v"), F.lit(1).alias("probe"))
    both = skew.carry(marks.unionByName(asked), ["csc"], ["seen_at", "probe"], _day(), back={value: "v"})
    return both.where("probe = 1").select("csc", "seen_at", value)


def next_event(changes: DataFrame, first: str = "restock", then: str = "out_of_stock") -> DataFrame:
    """Each ``first`` event with the first later ``then`` event of its key."""
    both = changes.where(F.col("event_type").isin(first, then)).select(
        "csc",
        "event_id",
        "event_type",
        "created_at",
        F.when(F.col("event_type") == then, F.col("created_at")).alias("t"),
    )
    ahead = skew.carry(both, ["csc"], ["created_at", "event_id"], _day("created_at"), ahead={"then_at": "t"})
    return ahead.where(F.col("event_type") == first).select(
        "csc", "event_id", "created_at", "then_at", times.hours_between("then_at", "created_at").alias("hours")
    )


def next_event_duration(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Restocks, how many sold out again, median and lower quartile of hours, by status."""
    rows = pairs.join(products.select("csc", "status"), "csc")
    counts = rows.groupBy("status").agg(F.count("*").alias("restocks"), F.count("then_at").alias("sold_out_again"))
    q = skew.quantiles(rows, ["status"], "hours", {"median_hours": 0.5, "p25_hours": 0.25}, width=1.0)
    return counts.join(q, "status", "left").select(
        "status",
        "restocks",
        "sold_out_again",
        F.round("median_hours", 4).alias("median_hours"),
        F.round("p25_hours", 4).alias("p25_hours"),
    )


def fastest_sellouts(pairs: DataFrame, products: DataFrame, n: int = 20) -> DataFrame:
    return (
        pairs.where("then_at is not null")
        .orderBy("hours", "event_id")
        .limit(n)
        .join(products.select("csc", "name", "status"), "csc")
        .select("csc", "name", "status", "event_id", F.round("hours", 4).alias("hours"))
    )


def rechecks(store_obs: DataFrame) -> DataFrame:
    """Store checks with the previous check of the same store."""
    return skew.neighbours(
        store_obs.select("csc", "store_id", "seen_at", "qty"),
        ["csc", "store_id"],
        ["seen_at"],
        _day(),
        prev={"prev_at": "seen_at", "prev_qty": "qty"},
    )


def recheck_decay(store_obs: DataFrame, sizes: tuple[int, int] = (50, 200)) -> DataFrame:
    """Share of re-checks that found another count, by age and size."""
    low, high = sizes
    age = times.hours_between("seen_at", "prev_at")
    bucket = (
        F.when(age < 6, "a <6h")
        .when(age < 12, "b 6-12h")
        .when(age < 24, "c 12-24h")
        .when(age < 48, "d 24-48h")
        .when(age < 72, "e 48-72h")
        .otherwise("f 72h+")
    )
    size = (
        F.when(F.col("prev_qty") >= high, f"{high}+")
        .when(F.col("prev_qty") >= low, f"{low}-{high - 1}")
        .otherwise(f"1-{low - 1}")
    )
    changed = F.col("qty") != F.col("prev_qty")
    return (
        rechecks(store_obs)
        .where("prev_qty > 0")
        .groupBy(bucket.alias("prev_check_age"), size.alias("size"))
        .agg(
            F.count("*").alias("rechecks"),
            F.round(100.0 * F.count_if(changed) / F.count("*"), 1).alias("pct_changed"),
            F.round(F.sum(F.abs(F.col("qty") - F.col("prev_qty"))) / F.count("*"), 2).alias("avg_change"),
        )
    )


def run_rows(runs: DataFrame, as_of: datetime, killed_minutes: int = 45) -> DataFrame:
    """Each run with its minutes, the hours since the one before, and whether it was killed,
    that is never finished. ``attempted``, ``checked`` and ``failed`` pass where a run has them."""
    prev = skew.neighbours(runs, [], ["started_at"], _day("started_at"), prev={"prev_at": "started_at"})
    counts = [c for c in ("attempted", "checked", "failed") if c in runs.columns]
    return prev.select(
        "started_at",
        "ok",
        (F.col("finished_at").isNull() & (F.col("started_at") < times.ago(as_of, f"{killed_minutes} minutes"))).alias("killed"),
        (times.seconds_between("finished_at", "started_at") / 60).alias("minutes"),
        times.hours_between("started_at", "prev_at").alias("gap_hours"),
        *counts,
    )


def run_gap_stats(runs: DataFrame, as_of: datetime, killed_minutes: int = 45) -> DataFrame:
    """One row: runs, failures, killed, median and longest gap, runs per day; and of the good
    runs that count their items (attempted, checked, failed) the seconds an item, the share that
    failed, and checks per day."""
    rows = run_rows(runs, as_of, killed_minutes)
    q = skew.quantiles(rows, [], "gap_hours", {"gap_hours_median": 0.5}, width=0.25)
    median = q.select("gap_hours_median").scalar()
    days = times.hours_between(F.max("started_at"), F.min("started_at")) / 24
    measures = [
        F.count("*").alias("runs"),
        F.count_if("ok").alias("ok"),
        F.count_if(F.expr("not ok")).alias("failed"),
        F.count_if("killed").alias("killed"),
        F.round(F.max("gap_hours"), 4).alias("gap_hours_max"),
        F.round(F.sum("minutes"), 2).alias("minutes"),
        F.round(F.count("*") / days, 4).alias("runs_per_day"),
    ]
    if "attempted" in rows.columns:
        done = F.col("ok") & (F.col("attempted") > 0)

        def total(c: str) -> Column:
            return F.sum(F.when(done, F.col(c)))

        items = F.nullif(total("attempted"), F.lit(0))
        measures += [
            F.round(total("minutes") * 60 / items, 4).alias("seconds_per_item"),
            F.round(total("failed") / items, 4).alias("failure_rate"),
            F.round(total("checked") / days, 4).alias("checks_per_day"),
        ]
    return rows.agg(*measures).withColumn("gap_hours_median", F.round(median, 4))


def event_to_action_lag(changes: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Delay from event to delivery by event type."""
    rows = deliveries.join(changes.select("event_id", "event_type", "created_at"), "event_id").withColumn(
        "minutes", times.seconds_between("sent_at", "created_at") / 60
    )
    q = skew.quantiles(rows, ["event_type"], "minutes", {"median_min": 0.5, "p90_min": 0.9}, width=1.0)
    return (
        rows.groupBy("event_type")
        .agg(F.count("*").alias("n"))
        .join(q, "event_type")
        .select("event_type", "n", F.round("median_min", 4).alias("median_min"), F.round("p90_min", 4).alias("p90_min"))
    )


def last_n_history_per_event(changes: DataFrame, obs: DataFrame, per_type: int = 4, n: int = 4) -> DataFrame:
    """A stable sample of events per type, each with the last ``n`` counts of its key."""
    pick = Window.partitionBy("event_type").orderBy(F.md5(F.col("event_id").cast("string")), "event_id")
    sample = changes.withColumn("rn", F.row_number().over(pick)).where(F.col("rn") <= per_type)
    recent = (
        obs.withColumn("rn", F.row_number().over(Window.partitionBy("csc").orderBy(F.col("seen_at").desc())))
        .where(F.col("rn") <= n)
        .groupBy("csc")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("rn", "store_qty"))), lambda x: x["store_qty"].cast("string")),
                ",",
            ).alias("last_counts")
        )
    )
    return sample.select("event_type", "event_id", "csc").join(recent, "csc")
