"""Quality and market reports: check coverage, jobs, catalog, events, sales."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import skew, times


def age_buckets(state: DataFrame, as_of: datetime) -> DataFrame:
    """Items by age of their last successful check. ``state``: (csc, checked_at, ...)."""
    age = times.hours_between(times.ts(as_of), "checked_at")
    bucket = (
        F.when(F.col("checked_at").isNull(), "never")
        .when(age < 24, "< 1 day")
        .when(age < 72, "1-3 days")
        .when(age < 168, "3-7 days")
        .otherwise("over 7 days")
    )
    return state.groupBy(bucket.alias("age")).agg(F.count("*").alias("products"))


def overdue(state: DataFrame, as_of: datetime, hours: int = 24, n: int = 25) -> DataFrame:
    late = F.col("checked_at").isNull() | (F.col("checked_at") < times.ago(as_of, f"{hours} hours"))
    return state.where(late).orderBy(F.col("checked_at").asc_nulls_first(), "csc").limit(n)


def failing_counts(state: DataFrame, watch: DataFrame, as_of: datetime) -> DataFrame:
    watched = watch.select("csc").distinct().withColumn("watched", F.lit(True))
    return (
        state.where("failures > 0")
        .join(watched, "csc", "left")
        .agg(
            F.count("*").alias("products"),
            F.count("watched").alias("watched"),
            F.count_if(F.col("retry_at") > times.ts(as_of)).alias("backing_off"),
        )
    )


def segment_coverage(catalog: DataFrame, state: DataFrame, watch: DataFrame, resolved: DataFrame, as_of: datetime) -> DataFrame:
    """Overlapping segments of in-stock items and the share checked within each
    age. One pass: every item is unfolded into the segments it belongs to."""
    qty = F.col("store_qty")
    size = F.when(qty >= 1000, "1000+").when(qty >= 200, "200-999").when(qty >= 50, "50-199").otherwise("1-49")
    watched = watch.select("csc").distinct().withColumn("watched", F.lit(True))
    scarce = resolved.where(F.col("shown_tier").isin("scarce", "rare", "unicorn")).select("csc", F.lit(True).alias("scarce"))
    rows = (
        catalog.where("in_stock and delisted_at is null and store_qty > 0")
        .join(state.select("csc", "checked_at"), "csc", "left")
        .join(watched, "csc", "left")
        .join(scarce, "csc", "left")
    )
    segments = F.array_compact(
        F.array(
            F.lit("all"),
            F.concat(F.lit("bottles "), size),
            F.when(F.col("status").isin("A", "L"), "allocated/limited"),
            F.when(F.col("scarce"), "rated scarce+"),
            F.when(F.col("watched"), "watched"),
        )
    )

    def within(hours: int) -> Column:
        hit = F.col("checked_at") > times.ago(as_of, f"{hours} hours")
        return F.round(100.0 * F.count_if(hit) / F.count("*"), 1).alias(f"pct_{hours}h")

    return (
        rows.select("checked_at", F.explode(segments).alias("segment"))
        .groupBy("segment")
        .agg(
            F.count("*").alias("products"),
            *[within(h) for h in (6, 12, 24, 48, 72)],
            F.round(100.0 * F.count_if(F.col("checked_at").isNull()) / F.count("*"), 1).alias("pct_never"),
        )
    )


def check_quality(checks: DataFrame) -> DataFrame:
    """Per source: checks, failures, latency, share that found a change.

    ``checks``: (check_id, source, created_at, ok, ms, error, prev_at, changed)."""
    ok, known = F.col("ok"), F.col("prev_at").isNotNull()
    per = checks.groupBy("source").agg(
        F.count("*").alias("checks"),
        F.count_if(~ok).alias("failed"),
        F.round(100.0 * F.count_if(~ok) / F.count("*"), 1).alias("failed_pct"),
        F.max("ms").alias("ms_max"),
        F.round(100.0 * F.count_if(ok & (F.col("changed") > 0)) / F.nullif(F.count_if(ok & known), F.lit(0)), 1).alias("pct_with_change"),
    )
    q = skew.quantiles(checks, ["source"], "ms", {"ms_p50": 0.5, "ms_p90": 0.9}, width=100.0)
    return per.join(q, "source").withColumns({"ms_p50": F.round("ms_p50", 2), "ms_p90": F.round("ms_p90", 2)})


def checks_by_day(checks: DataFrame, zone: str = times.LOCAL_ZONE) -> DataFrame:
    day = times.text(times.local_date("created_at", zone))
    return checks.groupBy(day.alias("day"), "source").agg(
        F.count("*").alias("checks"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.round(F.avg(F.when(F.col("ok"), F.col("changed"))), 4).alias("avg_changed"),
    )


def recent_errors(checks: DataFrame, n: int = 5) -> DataFrame:
    """Per source its newest errors."""
    w = Window.partitionBy("source").orderBy(F.col("created_at").desc(), F.col("check_id").desc())
    return (
        checks.where(~F.col("ok"))
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= n)
        .groupBy("source")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "error"))), lambda x: x["error"]), "; ").alias("errors"))
    )


def error_counts(checks: DataFrame, width: int = 80, n: int = 10) -> DataFrame:
    """Errors grouped by their opening words, as the report shows them."""
    return (
        checks.where(~F.col("ok"))
        .groupBy(F.substring(F.coalesce("error", F.lit("?")), 1, width).alias("error"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "error")
        .limit(n)
    )


def job_quality(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Per job: runs, outcomes, duration, and the last day's runs and failures."""
    secs = times.seconds_between("finished_at", "started_at")
    rows = runs.withColumn("secs", secs)
    today = F.col("started_at") > times.ago(as_of, "24 hours")
    per = rows.groupBy("job").agg(
        F.count("*").alias("runs"),
        F.count_if("ok").alias("ok"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("finished_at").isNull()).alias("unfinished"),
        F.max("secs").alias("max_secs"),
        F.count_if(today).alias("runs_24h"),
        F.count_if(today & ~F.col("ok")).alias("fails_24h"),
    )
    return per.join(skew.quantiles(rows, ["job"], "secs", {"median_secs": 0.5}, width=10.0), "job", "left")


def catalog_totals(catalog: DataFrame) -> DataFrame:
    shelf = F.col("store_qty").cast("decimal(14,0)") * F.col("current_price").cast("decimal(12,2)")
    return catalog.agg(
        F.count("*").alias("products"),
        F.count_if("in_stock").alias("in_stock"),
        F.count("delisted_at").alias("delisted"),
        F.countDistinct("category").alias("categories"),
        F.sum(F.when(F.col("in_stock"), F.col("store_qty"))).alias("on_shelves"),
        F.sum(F.when(F.col("in_stock"), shelf)).cast("double").alias("shelf_value"),
    )


def catalog_by(catalog: DataFrame, by: str) -> DataFrame:
    price = F.col("current_price").cast("decimal(12,2)")
    return catalog.groupBy(by).agg(
        F.count("*").alias("products"),
        F.count_if("in_stock").alias("in_stock"),
        F.round(F.sum(price).cast("double") / F.count(price), 2).alias("avg_price"),
    )


def catalog_profile(catalog: DataFrame, names: int = 3) -> DataFrame:
    """Per category: totals, median price, and the best-stocked names."""
    listed = catalog.where("delisted_at is null")
    per = listed.groupBy("category").agg(F.count("*").alias("total"), F.count_if("in_stock").alias("in_stock"))
    q = skew.quantiles(listed, ["category"], "current_price", {"median_price": 0.5}, width=25.0)
    w = Window.partitionBy("category").orderBy(F.col("store_qty").desc_nulls_last(), F.col("csc"))
    top = (
        listed.withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= names)
        .groupBy("category")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), "; ").alias("top_names"))
    )
    return per.join(q, "category").join(top, "category").withColumn("median_price", F.round("median_price", 2))


def size_counts(catalog: DataFrame, n: int = 15) -> DataFrame:
    return (
        catalog.where("delisted_at is null")
        .groupBy("size_ml")
        .agg(F.count("*").alias("products"))
        .orderBy(F.col("products").desc(), F.col("size_ml").asc_nulls_last())
        .limit(n)
    )


def event_mix(changes: DataFrame, zone: str = times.LOCAL_ZONE) -> DataFrame:
    """Changes by local week and type."""
    return changes.groupBy(times.text(times.local_week("created_at", zone)).alias("week"), "event_type").agg(F.count("*").alias("n"))


def restock_sizes(changes: DataFrame, n: int = 10) -> DataFrame:
    return (
        changes.where("event_type = 'restock'")
        .groupBy(F.col("new").try_cast("int").alias("qty"))
        .agg(F.count("*").alias("restocks"))
        .orderBy(F.col("restocks").desc(), "qty")
        .limit(n)
    )


def most_restocked(changes: DataFrame, catalog: DataFrame, n: int = 15) -> DataFrame:
    return (
        changes.where("event_type = 'restock'")
        .groupBy("csc")
        .agg(F.count("*").alias("restocks"))
        .join(catalog.select("csc", "name", "status"), "csc")
        .orderBy(F.col("restocks").desc(), "csc")
        .limit(n)
    )


def watchers_affected(changes: DataFrame, watch: DataFrame, as_of: datetime, hours: int = 48) -> DataFrame:
    """Users and pairs touched by recent changes, by type.

    Changes combine per item and type before the watchers join, so a busy item
    does not multiply its watchers."""
    per = changes.where(F.col("created_at") > times.ago(as_of, f"{hours} hours")).groupBy("csc", "event_type").agg(F.count("*").alias("n"))
    return (
        per.join(watch.select("csc", "user_id"), "csc")
        .groupBy("event_type", "user_id")
        .agg(F.sum("n").alias("n"))
        .groupBy("event_type")
        .agg(F.count("*").alias("users"), F.sum("n").alias("pairs"))
    )


def special_share(changes: DataFrame, catalog: DataFrame) -> DataFrame:
    return (
        changes.where("event_type = 'restock'")
        .groupBy("csc")
        .agg(F.count("*").alias("n"))
        .join(catalog.select("csc", "status"), "csc")
        .groupBy((F.col("status") == "S").alias("special_order"))
        .agg(F.sum("n").alias("restocks"))
    )


def new_by_category(changes: DataFrame, catalog: DataFrame, at_least: int = 3, zone: str = times.LOCAL_ZONE) -> DataFrame:
    month = F.date_format(times.local("created_at", zone), "yyyy-MM")
    return (
        changes.where("event_type = 'new_product'")
        .join(catalog.select("csc", "category"), "csc")
        .groupBy(month.alias("month"), "category")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= at_least)
    )


def _moves(changes: DataFrame) -> DataFrame:
    return changes.where("event_type = 'price_change'").select(
        "csc",
        "event_id",
        "created_at",
        F.col("old").cast("decimal(12,2)").alias("was"),
        F.col("new").cast("decimal(12,2)").alias("now"),
    )


def price_change_stats(changes: DataFrame) -> DataFrame:
    """Direction, mean size in dollars and percent."""
    d = F.abs(F.col("now") - F.col("was"))
    share = 100 * d.cast("double") / F.nullif(F.col("was"), F.lit(0)).cast("double")
    return _moves(changes).groupBy(F.when(F.col("now") > F.col("was"), "up").otherwise("down").alias("dir")).agg(
        F.count("*").alias("n"),
        F.round(F.sum(d).cast("double") / F.count("*"), 2).alias("avg_usd"),
        F.round(F.avg(share), 1).alias("avg_pct"),
    )


def biggest_price_changes(changes: DataFrame, n: int = 12) -> DataFrame:
    return (
        _moves(changes)
        .orderBy(F.abs(F.col("now") - F.col("was")).desc(), "event_id")
        .limit(n)
        .select("csc", "event_id", F.col("was").cast("double").alias("was"), F.col("now").cast("double").alias("now"))
    )


def sales_by_class(sales: DataFrame) -> DataFrame:
    """Dollars per class in the newest month and the same month a year before."""
    newest = sales.agg(F.max("period_month")).scalar()
    rows = sales.withColumn("__m", newest).where(
        (F.col("period_month") == F.col("__m")) | (F.col("period_month") == F.add_months("__m", -12))
    )
    cur = F.col("period_month") == F.col("__m")
    return rows.groupBy(F.coalesce("class_name", F.lit("?")).alias("class")).agg(
        F.coalesce(F.sum(F.when(cur, F.col("dollars"))).cast("double"), F.lit(0.0)).alias("current"),
        F.coalesce(F.sum(F.when(~cur, F.col("dollars"))).cast("double"), F.lit(0.0)).alias("year_before"),
    )


def top_sellers(sales: DataFrame, n: int = 20) -> DataFrame:
    newest = sales.agg(F.max("period_month")).scalar()
    return (
        sales.where(F.col("period_month") == newest)
        .groupBy("item_code", "item_name")
        .agg(F.sum("bottles").alias("bottles"), F.sum("dollars").cast("double").alias("dollars"))
        .orderBy(F.col("dollars").desc(), "item_code")
        .limit(n)
    )


def price_bands(sales: DataFrame, steps: tuple[int, ...] = (15, 30, 60, 120)) -> DataFrame:
    """Bottles and dollars of the newest month by price per bottle."""
    newest = sales.agg(F.max("period_month")).scalar()
    each = F.col("dollars").cast("double") / F.col("bottles")
    band = F.lit(f"${steps[-1]}+")
    for low, high in reversed(list(zip((0, *steps), steps))):
        band = F.when(each < high, f"<${high}" if low == 0 else f"${low}-{high}").otherwise(band)
    return (
        sales.where((F.col("period_month") == newest) & (F.col("bottles") > 0))
        .groupBy(band.alias("band"))
        .agg(F.sum("bottles").alias("bottles"), F.sum("dollars").cast("double").alias("dollars"))
    )


def hardest_drawings(draws: DataFrame, n: int = 30) -> DataFrame:
    epb = F.round(F.col("entries") / F.expr("nullif(bottles, 0)"), 1)
    return (
        draws.where("entries is not null")
        .select("drawing", "item_code", "bottles", "entries", epb.alias("entries_per_bottle"))
        .orderBy(F.col("entries_per_bottle").desc_nulls_last(), "drawing", "item_code")
        .limit(n)
    )


def drop_mix(drops: DataFrame, stores: DataFrame) -> DataFrame:
    """Drops by county, month, weekday and store from one pass."""
    rows = drops.join(stores.select(F.col("id").alias("store_id"), "county", "city"), "store_id", "left")
    dims = F.array(
        F.struct(F.lit("county").alias("dimension"), F.coalesce("county", F.lit("?")).alias("value")),
        F.struct(F.lit("month").alias("dimension"), F.date_format("drop_date", "yyyy-MM").alias("value")),
        F.struct(F.lit("weekday").alias("dimension"), (F.dayofweek("drop_date") - 1).cast("string").alias("value")),
        F.struct(F.lit("store").alias("dimension"), F.coalesce("city", F.lit("?")).alias("value")),
    )
    return (
        rows.select("bottle_qty", "product_name", F.explode(dims).alias("d"))
        .groupBy("d.dimension", "d.value")
        .agg(F.count("*").alias("drops"), F.sum("bottle_qty").alias("bottles"), F.countDistinct("product_name").alias("products"))
    )


def table_growth(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, first and last time of each named table."""
    parts = [
        df.agg(F.count("*").alias("rows"), F.min(at).cast("timestamp_ntz").alias("first"), F.max(at).cast("timestamp_ntz").alias("last")).withColumn("name", F.lit(name))
        for name, (df, at) in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rows_per_week(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [
        df.groupBy(times.text(F.to_date(F.date_trunc("week", F.to_date(at)))).alias("week")).agg(F.count("*").alias("rows")).withColumn("name", F.lit(name))
        for name, (df, at) in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
