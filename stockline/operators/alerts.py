"""Alerts, interest and the choice of what to check next."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import skew, times


def digest_match(
    changes: DataFrame,
    store_restocks: DataFrame,
    watch: DataFrame,
    homes: DataFrame,
    catalog: DataFrame,
    store_now: DataFrame,
    muted: DataFrame,
    deliveries: DataFrame,
    as_of: datetime,
    lookback_hours: int = 48,
) -> DataFrame:
    """(user, event) pairs to tell: recent changes of watched items since the
    watch began, still true, wanted, and not told before.

    Whether an event was superseded is decided by one aggregate per product,
    the last restock and sell-out, before watchers multiply the rows."""
    edge = times.ago(as_of, f"{lookback_hours} hours")
    recent = changes.where(F.col("created_at") > edge)
    last = recent.groupBy("csc").agg(
        F.max(F.when(F.col("event_type") == "restock", F.col("created_at"))).alias("last_restock"),
        F.max(F.when(F.col("event_type") == "out_of_stock", F.col("created_at"))).alias("last_out"),
    )
    kind, at = F.col("event_type"), F.col("created_at")
    standing = (
        recent.where(~kind.isin("allocated_drop", "store_restock"))
        .join(last, "csc")
        .join(catalog.select("csc", "in_stock"), "csc")
        .where(
            (kind != "restock") | (F.col("in_stock") & ~F.coalesce(F.col("last_out") > at, F.lit(False)))
        )
        .where(
            (kind != "out_of_stock") | (~F.col("in_stock") & ~F.coalesce(F.col("last_restock") > at, F.lit(False)))
        )
        .select("event_id", "csc", "event_type", "created_at")
    )
    started = watch.select("user_id", "csc", F.col("created_at").alias("watched_at"))
    general = standing.join(started, "csc").where("created_at >= watched_at")
    held = store_now.where("qty > 0").select("csc", "store_id")
    local = (
        store_restocks.where(F.col("created_at") > edge)
        .join(held, ["csc", "store_id"], "left_semi")
        .select("event_id", "csc", "store_id", F.lit("store_restock").alias("event_type"), "created_at")
        .join(started, "csc")
        .where("created_at >= watched_at")
        .join(homes.select("user_id", "store_id"), ["user_id", "store_id"], "left_semi")
        .drop("store_id")
    )
    return undelivered(
        general.unionByName(local)
        .join(muted.select("user_id"), "user_id", "left_anti")
        .select("user_id", "event_id", "csc", "event_type", "created_at"),
        deliveries,
    )


def undelivered(matches: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Each (user, event) at most once, across reruns."""
    return matches.dropDuplicates(["user_id", "event_id"]).join(
        deliveries.select("user_id", "event_id"), ["user_id", "event_id"], "left_anti"
    )


def drop_alert_match(drop_events: DataFrame, opted_in: DataFrame, deliveries: DataFrame, as_of: datetime, lookback_hours: int = 48) -> DataFrame:
    """Recent drop events for everyone who asked, minus those told before.

    Lists are posted about once a month, so the recent ones are a handful and
    travel to the users as one array."""
    recent = drop_events.where(F.col("created_at") > times.ago(as_of, f"{lookback_hours} hours"))
    ids = recent.agg(F.array_sort(F.collect_set("event_id"))).scalar()
    told = deliveries.join(recent.select("event_id"), "event_id", "left_semi").groupBy("user_id").agg(
        F.collect_set("event_id").alias("told")
    )
    none = F.array().cast("array<bigint>")
    return (
        opted_in.select("user_id")
        .distinct()
        .join(told, "user_id", "left")
        .withColumn("__ids", ids)
        .select("user_id", F.explode(F.array_except("__ids", F.coalesce("told", none))).alias("event_id"))
    )


def digest_batches(matches: DataFrame, shown: int = 50) -> DataFrame:
    """One message per user: its first events in order, the rest counted, and a
    key that stays the same on a rerun."""
    totals = matches.groupBy("user_id").agg(F.count("*").alias("total"), F.max("event_id").alias("last_id"))
    w = Window.partitionBy("user_id").orderBy("created_at", "event_id")
    first = (
        matches.withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= shown)
        .groupBy("user_id")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("r", "event_id"))), lambda x: x["event_id"].cast("string")), ","
            ).alias("events")
        )
    )
    return totals.join(first, "user_id").select(
        "user_id",
        "events",
        F.greatest(F.col("total") - shown, F.lit(0)).alias("more"),
        F.concat(F.lit("digest/"), F.col("user_id").cast("string"), F.lit("/"), F.col("last_id").cast("string")).alias("message_key"),
    )


def intent_reconcile(requests: DataFrame, watch: DataFrame, products: DataFrame, as_of: datetime, ttl_hours: int = 24, cap: int = 50) -> DataFrame:
    """What becomes of each pending request ``(request_id, user_id, csc,
    created_at, same_email)`` when all are applied in order.

    A user's new keys are numbered in the order asked; those within the room
    left under the cap are added. Repeats of an added key find it there."""
    known = products.select("csc", F.lit(True).alias("known"))
    have = watch.select("user_id", "csc", F.lit(True).alias("has"))
    held = watch.groupBy("user_id").agg(F.count("*").alias("held"))
    expired = F.col("created_at") < times.ago(as_of, f"{ttl_hours} hours")
    r = (
        requests.join(known, "csc", "left")
        .join(have, ["user_id", "csc"], "left")
        .withColumn(
            "early",
            F.when(F.col("known").isNull(), "not_found").when(~F.col("same_email"), "mismatch").when(expired, "expired").when(F.col("has"), "already"),
        )
    )
    new = r.where("early is null")
    firsts = new.groupBy("user_id", "csc").agg(
        F.min(F.struct("created_at", "request_id")).alias("f")
    ).select("user_id", "csc", F.col("f.created_at").alias("asked_at"), F.col("f.request_id").alias("first_id"))
    numbered = skew.running(
        firsts, ["user_id"], ["asked_at", "first_id"], F.to_date("asked_at"), {"nth": F.lit(1)}
    ).join(held, "user_id", "left")
    room = numbered.select(
        "user_id", "csc", "first_id", (F.coalesce("held", F.lit(0)) + F.col("nth") <= cap).alias("fits")
    )
    return r.join(room, ["user_id", "csc"], "left").select(
        "request_id",
        "user_id",
        "csc",
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(~F.col("fits"), "full")
        .when(F.col("request_id") == F.col("first_id"), "added")
        .otherwise("already")
        .alias("status"),
    )


def failure_backoff(checks: DataFrame, restocks: DataFrame, base_hours: float = 3.0, cap_hours: float = 72.0) -> DataFrame:
    """Consecutive failures at the end of each key's checks and the next retry.

    ``checks``: (csc, seen_at, ok). A success resets; a later restock clears the
    wait. Two aggregates, no sort of a key's checks."""
    good = checks.where("ok").groupBy("csc").agg(F.max("seen_at").alias("checked_at"))
    bad = (
        checks.where("not ok")
        .join(good, "csc", "left")
        .where(F.col("checked_at").isNull() | (F.col("seen_at") > F.col("checked_at")))
        .groupBy("csc")
        .agg(F.count("*").alias("failures"), F.max("seen_at").alias("last_failure"))
    )
    cleared = restocks.groupBy("csc").agg(F.max("created_at").alias("restocked_at"))
    wait = F.least(base_hours * F.pow(F.lit(2.0), F.col("failures")), F.lit(cap_hours))
    retry = (times.micros("last_failure") + (wait * 3600 * 1e6).cast("bigint")).alias("us")
    at = F.timestamp_micros(retry).cast("timestamp_ntz")
    return (
        checks.select("csc")
        .distinct()
        .join(good, "csc", "left")
        .join(bad, "csc", "left")
        .join(cleared, "csc", "left")
        .select(
            "csc",
            "checked_at",
            F.coalesce("failures", F.lit(0)).alias("failures"),
            F.when(~F.coalesce(F.col("restocked_at") > F.col("last_failure"), F.lit(False)), at).alias("retry_at"),
        )
    )


def select_targets(
    catalog: DataFrame, state: DataFrame, watch: DataFrame, as_of: datetime, budget: int, watch_share: float = 0.4, recheck_hours: int = 3
) -> DataFrame:
    """The next checks within a budget: watched keys that are due first, then
    the oldest, with head starts; keys waiting after failures are left out and
    failing ones go last.

    ``state``: (csc, checked_at, failures, retry_at)."""
    slots = int(budget * watch_share)
    watched = watch.select("csc").distinct().withColumn("watched", F.lit(True))
    rows = (
        catalog.join(state, "csc", "left")
        .join(watched, "csc", "left")
        .where(F.col("retry_at").isNull() | (F.col("retry_at") <= times.ts(as_of)))
        .select("csc", "status", "in_stock", "checked_at", F.coalesce("failures", F.lit(0)).alias("failures"), F.coalesce("watched", F.lit(False)).alias("watched"))
    )
    due = F.col("checked_at").isNull() | (F.col("checked_at") < times.ago(as_of, f"{recheck_hours} hours"))
    first = rows.where(F.col("watched") & due).orderBy(F.col("checked_at").asc_nulls_first(), "csc").limit(slots)
    head_start = (
        F.when(F.col("watched"), F.expr("interval 3 days"))
        .when(F.col("status").isin("A", "L", "D"), F.expr("interval 1 day"))
        .otherwise(F.expr("interval 0 days"))
    )
    age = F.coalesce("checked_at", F.expr("timestamp_ntz'1970-01-01'")) - head_start
    rest = (
        rows.where("in_stock or watched")
        .join(first.select("csc"), "csc", "left_anti")
        .withColumn("age", age)
        .orderBy("age", "csc")
        .limit(budget)
    )
    taken = first.agg(F.count("*")).scalar()
    rest = rest.withColumn("r", F.row_number().over(Window.orderBy("age", "csc"))).where(F.col("r") <= F.lit(budget) - taken)
    both = first.select("csc", "failures", F.lit("watched").alias("lane")).unionByName(
        rest.select("csc", "failures", F.lit("rotation").alias("lane"))
    )
    return both.withColumn("failing", F.col("failures") > 0).drop("failures")


def pending_signups(signups: DataFrame, accounts: DataFrame) -> DataFrame:
    """Sign-ups without an account, by segment; addresses compare in lower case."""
    have = accounts.select(F.lower("email").alias("e")).distinct()
    left = signups.withColumn("e", F.lower("email")).join(have, "e", "left_anti")
    return left.groupBy(F.coalesce("segment", F.lit("(none)")).alias("segment")).agg(
        F.count("*").alias("pending"), F.countDistinct("e").alias("addresses")
    )


def watch_distribution(watch: DataFrame) -> DataFrame:
    """Users by how much they watch."""
    per = watch.groupBy("user_id").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") <= 3, "2-3").when(F.col("n") <= 10, "4-10").otherwise("11+")
    return per.groupBy(bucket.alias("watches")).agg(F.count("*").alias("users"), F.sum("n").alias("total"))


def most_watched(watch: DataFrame, catalog: DataFrame, resolved: DataFrame, changes: DataFrame, as_of: datetime, n: int = 25, days: int = 60) -> DataFrame:
    per = watch.groupBy("csc").agg(F.count("*").alias("watchers"), times.text(F.max("created_at").cast("date")).alias("latest_add"))
    top = per.join(catalog.select("csc", "name", "status", "in_stock", "store_qty"), "csc").orderBy(F.col("watchers").desc(), "csc").limit(n)
    back = (
        changes.where("event_type = 'restock'")
        .where(F.col("created_at") >= times.ago(as_of, f"{days} days"))
        .join(top.select("csc"), "csc", "left_semi")
        .groupBy("csc")
        .agg(F.count("*").alias("restocks"))
    )
    tiers = resolved.where("published").select("csc", "tier")
    return top.join(tiers, "csc", "left").join(back, "csc", "left").fillna(0, ["restocks"])


def watched_restock_share(watch: DataFrame, changes: DataFrame, store_restocks: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: watched items, any restock, a statewide restock, in stock now."""
    items = watch.select("csc").distinct()
    wide = changes.where("event_type = 'restock'").select("csc").distinct().withColumn("wide", F.lit(True))
    local = store_restocks.select("csc").distinct().withColumn("local", F.lit(True))
    return (
        items.join(wide, "csc", "left")
        .join(local, "csc", "left")
        .join(catalog.select("csc", "in_stock"), "csc", "left")
        .agg(
            F.count("*").alias("watched"),
            F.count_if(F.col("wide").isNotNull() | F.col("local").isNotNull()).alias("any_restock"),
            F.count("wide").alias("statewide_restock"),
            F.count_if("in_stock").alias("in_stock_now"),
        )
    )


def home_stores_chosen(homes: DataFrame, stores: DataFrame, n: int = 15) -> DataFrame:
    per = homes.groupBy("store_id").agg(F.count("*").alias("users"))
    return (
        per.join(stores.select(F.col("id").alias("store_id"), "city", "is_club"), "store_id")
        .orderBy(F.col("users").desc(), "store_id")
        .limit(n)
    )
