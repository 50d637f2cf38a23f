"""Sessions, funnels, cohorts and usage reports over page views.

Page views are ``(event_id, visitor_id, user_id, created_at, path, csc,
search_query, ...)``; after ``sessionize`` also ``session_id, is_landing``.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clients, skew, times


def sessionize(pages: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """A new session after an idle gap; its first view is the landing.

    A busy visitor's views are cut by day and numbered across the cuts."""
    day = F.to_date("created_at")
    order = ["created_at", "event_id"]
    gaps = skew.neighbours(pages, ["visitor_id"], order, day, prev={"__prev": "created_at"})
    fresh = F.col("__prev").isNull() | (F.col("created_at") - F.col("__prev") > F.expr(f"interval {gap_minutes} minutes"))
    numbered = skew.running(
        gaps.withColumn("is_landing", fresh), ["visitor_id"], order, day, {"session_no": F.col("is_landing").cast("int")}
    )
    return numbered.drop("__prev").withColumn(
        "session_id", F.concat_ws("-", F.col("visitor_id").cast("string"), F.col("session_no").cast("string"))
    )


def _searched() -> Column:
    return (F.col("path") == "/search") & F.col("search_query").isNotNull()


def per_session(views: DataFrame) -> DataFrame:
    """One row per session."""
    return views.groupBy("session_id").agg(
        F.min("visitor_id").alias("visitor_id"),
        F.min("created_at").alias("started_at"),
        F.count("*").alias("views"),
        F.count("csc").alias("products"),
        F.count_if(_searched()).alias("searches"),
        times.seconds_between(F.max("created_at"), F.min("created_at")).alias("secs"),
        F.max(F.when(F.col("is_landing"), F.col("source"))).alias("source") if "source" in views.columns else F.lit(None).alias("source"),
    )


def kpis(views: DataFrame, signups: DataFrame, watch: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row of headline numbers for ``[start, end)``."""

    def inside(c: str) -> Column:
        return (F.col(c) >= times.ts(start)) & (F.col(c) < times.ts(end))

    e = views.where(inside("created_at"))
    visitors = views.groupBy("visitor_id").agg(
        F.min("created_at").alias("first"), F.count_if(inside("created_at")).alias("n")
    ).where("n > 0")
    v = visitors.agg(
        F.count("*").alias("visitors"), F.sum("n").alias("pageviews"), F.count_if(F.col("first") >= times.ts(start)).alias("new_visitors")
    )
    s = per_session(e).agg(
        F.count("*").alias("sessions"), F.count_if(F.col("views") == 1).alias("bounced"), F.round(F.coalesce(F.avg("secs"), F.lit(0.0)), 4).alias("avg_secs")
    )
    return v.select(
        "*",
        *[s.select(c).scalar().alias(c) for c in ("sessions", "bounced", "avg_secs")],
        e.agg(F.countDistinct("user_id")).scalar().alias("signed_in"),
        signups.where(inside("created_at")).agg(F.count("*")).scalar().alias("signups"),
        watch.where(inside("created_at")).agg(F.count("*")).scalar().alias("watches"),
    )


def period_compare(views: DataFrame, start: datetime, now: datetime) -> DataFrame:
    """The stretch since ``start`` against the equal stretch before, cut at the
    same time of day: (metric, current, previous, delta)."""
    days = timedelta(days=-(-(now - start) // timedelta(days=1)))
    at = F.col("created_at")
    period = F.when((at >= times.ts(start)) & (at < times.ts(now)), "current").when(
        (at >= times.ts(start - days)) & (at < times.ts(now - days)), "previous"
    )
    per = (
        views.withColumn("period", period)
        .where("period is not null")
        .groupBy("period")
        .agg(F.countDistinct("visitor_id").alias("visitors"), F.count("*").alias("pageviews"), F.countDistinct("session_id").alias("sessions"))
    )
    long = per.select("period", F.expr("stack(3, 'visitors', visitors, 'pageviews', pageviews, 'sessions', sessions) as (metric, value)"))
    return (
        long.groupBy("metric")
        .agg(
            F.coalesce(F.sum(F.when(F.col("period") == "current", F.col("value"))), F.lit(0)).alias("current"),
            F.coalesce(F.sum(F.when(F.col("period") == "previous", F.col("value"))), F.lit(0)).alias("previous"),
        )
        .withColumn("delta", F.col("current") - F.col("previous"))
    )


def zero_filled_series(views: DataFrame, signups: DataFrame, start: datetime, now: datetime, unit: str = "hour", zone: str = times.LOCAL_ZONE) -> DataFrame:
    """Local hourly or daily buckets from ``start`` to ``now``, empty ones as zeros."""
    spark = views.sparkSession

    def bucket(c: Column) -> Column:
        return F.date_trunc(unit, times.local(c, zone)).cast("timestamp_ntz")

    edges = spark.range(1).select(
        F.explode(F.sequence(bucket(times.ts(start)), bucket(times.ts(now)), F.expr(f"interval 1 {unit}"))).alias("b")
    )
    pv = (
        views.where(F.col("created_at") >= times.ts(start))
        .groupBy(bucket(F.col("created_at")).alias("b"))
        .agg(F.count("*").alias("pageviews"), F.countDistinct("visitor_id").alias("visitors"))
    )
    su = signups.where(F.col("created_at") >= times.ts(start)).groupBy(bucket(F.col("created_at")).alias("b")).agg(F.count("*").alias("signups"))
    return (
        edges.join(pv, "b", "left")
        .join(su, "b", "left")
        .select("b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("visitors", "pageviews", "signups")])
    )


def live_now(views: DataFrame, as_of: datetime, minutes: int = 5) -> DataFrame:
    """The latest view of each visitor in the last minutes, with how the session began."""
    recent = views.where(F.col("created_at") > times.ago(as_of, f"{minutes} minutes"))
    last = skew.latest(recent.select("visitor_id", "created_at", "event_id", "path", "session_id"), ["visitor_id"], ["created_at", "event_id"])
    landing = views.where("is_landing").select("session_id", F.col("path").alias("landing"))
    return last.join(landing, "session_id", "left").select(
        "visitor_id", "path", "landing", F.round(times.seconds_between(times.ts(as_of), "created_at"), 3).alias("seconds")
    )


def page_type(path: str | Column) -> Column:
    p = times.col(path)
    return (
        F.when(p.startswith("/product/"), "/product/*")
        .when(p.startswith("/store/"), "/store/*")
        .when(p.startswith("/drops"), "/drops*")
        .otherwise(p)
    )


def top_breakdowns(views: DataFrame, n: int = 10, hours: int = 24, zone: str = times.LOCAL_ZONE) -> DataFrame:
    """Views and visitors by many dimensions from one pass: every view is
    unfolded into (dimension, value) pairs, counted, and cut per dimension."""
    landing = F.col("is_landing")
    dims = {
        "page": page_type("path"),
        "landing": F.when(landing, page_type("path")),
        "product": F.col("csc"),
        "source": F.when(landing, F.coalesce("source", F.lit("Direct"))),
        "channel": F.when(landing, clients.channel(F.coalesce("source", F.lit("Direct")))),
        "referrer": F.when(landing, F.col("referrer_host")),
        "campaign": F.when(landing, F.col("utm_source")),
        "device": F.col("device"),
        "browser": F.concat_ws(" / ", "browser", "os"),
        "city": F.col("city"),
        "country": F.coalesce("country", F.lit("Unknown")),
        "hour": F.hour(times.local("created_at", zone)).cast("string"),
    }
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("value")) for d, c in dims.items()])
    counted = (
        views.select("visitor_id", F.explode(pairs).alias("p"))
        .where("p.value is not null")
        .groupBy(F.col("p.dimension").alias("dimension"), F.col("p.value").alias("value"), "visitor_id")
        .agg(F.count("*").alias("n"))
        .groupBy("dimension", "value")
        .agg(F.sum("n").alias("views"), F.count("*").alias("visitors"))
    )
    w = Window.partitionBy("dimension").orderBy(F.col("views").desc(), F.col("value"))
    cut = F.when(F.col("dimension") == "hour", hours).otherwise(n)
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(n, hours)).where(F.col("place") <= cut)


def query_normalised_top(views: DataFrame, n: int = 10, words: str | None = None) -> DataFrame:
    """Typed words grouped without case and apostrophes, labelled by their first spelling."""
    q = F.lower(F.trim("search_query"))
    rows = views.where("search_query is not null and trim(search_query) <> ''")
    if words is not None:
        rows = rows.where(q.rlike(words))
    return (
        rows.groupBy(F.regexp_replace(q, "['’]", "").alias("key"))
        .agg(F.min(q).alias("label"), F.count("*").alias("searches"), F.countDistinct("visitor_id").alias("visitors"))
        .orderBy(F.col("searches").desc(), "key")
        .limit(n)
    )


def account_totals(
    accounts: DataFrame, watch: DataFrame, homes: DataFrame, muted: DataFrame, deliveries: DataFrame, start: datetime, as_of: datetime
) -> DataFrame:
    """One row of account numbers. ``accounts``: (user_id, created_at, last_sign_in_at)."""

    def since(days: int) -> Column:
        return F.col("last_sign_in_at") >= times.ago(as_of, f"{days} days")

    sent = deliveries.where(F.col("sent_at") >= times.ts(start))
    return accounts.agg(
        F.count("*").alias("users"),
        F.count_if(F.col("created_at") >= times.ts(start)).alias("new_users"),
        F.count_if(since(7)).alias("active_7d"),
        F.count_if(since(30)).alias("active_30d"),
    ).select(
        "*",
        watch.agg(F.countDistinct("user_id")).scalar().alias("watchers"),
        watch.agg(F.count("*")).scalar().alias("watch_items"),
        homes.agg(F.countDistinct("user_id")).scalar().alias("with_stores"),
        muted.agg(F.count("*")).scalar().alias("watch_alerts_off"),
        sent.agg(F.count("*")).scalar().alias("alerts_sent"),
        sent.agg(F.countDistinct("user_id")).scalar().alias("alerted_users"),
    )


def latest_signups(accounts: DataFrame, watch: DataFrame, homes: DataFrame, stores: DataFrame, n: int = 12) -> DataFrame:
    """The newest accounts with what they watch and their few home stores."""
    newest = accounts.orderBy(F.col("created_at").desc(), "user_id").limit(n)
    watching = watch.join(newest.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("watching"))
    cities = (
        homes.join(newest.select("user_id"), "user_id", "left_semi")
        .join(stores.select(F.col("id").alias("store_id"), "city"), "store_id")
        .groupBy("user_id")
        .agg(F.array_join(F.array_sort(F.collect_set("city")), ", ").alias("stores"))
    )
    return newest.join(watching, "user_id", "left").join(cities, "user_id", "left").fillna(0, ["watching"])


def accounts_by_month(accounts: DataFrame, zone: str = times.LOCAL_ZONE) -> DataFrame:
    month = F.date_format(times.local("created_at", zone), "yyyy-MM")
    return accounts.groupBy(month.alias("month")).agg(
        F.count("*").alias("users"), F.count_if(F.col("last_sign_in_at") > F.col("created_at")).alias("came_back")
    )


def ratings_effect(views: DataFrame, watch: DataFrame, resolved: DataFrame, start: datetime) -> DataFrame:
    """Viewers and adds per shown tier, over everything viewed or added."""
    viewed = (
        views.where(F.col("csc").isNotNull() & (F.col("created_at") >= times.ts(start)))
        .groupBy("csc")
        .agg(F.countDistinct("visitor_id").alias("viewers"))
    )
    added = watch.where(F.col("created_at") >= times.ts(start)).groupBy("csc").agg(F.count("*").alias("adds"))
    rated = resolved.select("csc", "shown_tier", F.lit(True).alias("card"))
    tier = F.coalesce("shown_tier", F.when(F.col("card").isNull(), "no card").otherwise("not rated"))
    return (
        viewed.join(added, "csc", "full_outer")
        .join(rated, "csc", "left")
        .groupBy(tier.alias("tier"))
        .agg(
            F.count_if(F.col("viewers") > 0).alias("products"),
            F.coalesce(F.sum("viewers"), F.lit(0)).alias("viewers"),
            F.coalesce(F.sum("adds"), F.lit(0)).alias("adds"),
        )
    )


def _since(rows: DataFrame, start: datetime | None) -> DataFrame:
    return rows if start is None else rows.where(F.col("created_at") >= times.ts(start))


def discovery_actions(actions: DataFrame, start: datetime | None = None) -> DataFrame:
    """Clicks, taps, requests and confirmed watches by surface and view, from ``start`` on.

    ``actions``: (event_id, visitor_id, created_at, kind, surface, view, rank, results, query)."""
    kind = F.col("kind")
    return _since(actions, start).where("view is not null").groupBy("surface", "view").agg(
        F.countDistinct(F.when(kind == "click", F.col("visitor_id"))).alias("clickers"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "watch_click").alias("watch_clicks"),
        F.count_if(kind == "watch_request").alias("requests"),
        F.count_if(kind == "watch_added").alias("confirmed"),
        F.count_if(kind == "useful_yes").alias("useful_yes"),
        F.count_if(kind == "useful_no").alias("useful_no"),
    )


def discovery_rollup(actions: DataFrame) -> DataFrame:
    """Shown, shown empty, clicked and judged by view, with a grand total."""
    kind = F.col("kind")
    return actions.rollup("view").agg(
        F.count_if(kind == "shown").alias("shown"),
        F.count_if((kind == "shown") & (F.col("results") == 0)).alias("shown_empty"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "useful_yes").alias("useful"),
        F.count_if(kind == "useful_no").alias("not_useful"),
    )


def discovery_visits(views: DataFrame, path: str = "/search", start: datetime | None = None, home: str = "/") -> DataFrame:
    """Visitors of a page, those who came to it in two or more sessions, and those of the home
    page, from ``start`` on. One pass: both pages are counted by visitor."""
    at = F.col("path")
    per = _since(views, start).where(at.isin(path, home)).groupBy("visitor_id").agg(
        F.countDistinct(F.when(at == path, F.col("session_id"))).alias("sessions"), F.bool_or(at == home).alias("home")
    )
    return per.agg(
        F.count_if(F.col("sessions") >= 1).alias("visitors"), F.count_if(F.col("sessions") >= 2).alias("returning"), F.count_if("home").alias("home_visitors")
    )


def traffic_by_period(views: DataFrame, unit: str = "day", zone: str = times.LOCAL_ZONE) -> DataFrame:
    """Views, visitors and sessions by local day or ISO week."""
    period = times.local_date("created_at", zone) if unit == "day" else times.local_week("created_at", zone)
    return views.groupBy(times.text(period).alias(unit)).agg(
        F.count("*").alias("views"),
        F.countDistinct("visitor_id").alias("visitors"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct(F.when(F.col("user_id").isNotNull(), F.col("session_id"))).alias("signed_in_sessions"),
        F.count_if(_searched()).alias("searches"),
        F.count("csc").alias("product_views"),
    )


def session_funnel(views: DataFrame) -> DataFrame:
    """One row: sessions with a search, a product view, and a product view after
    the first search. The later view is found by comparing two extremes."""
    s = views.groupBy("session_id").agg(
        F.min(F.when(_searched(), F.col("created_at"))).alias("first_search"),
        F.max(F.when(F.col("csc").isNotNull(), F.col("created_at"))).alias("last_product"),
        F.bool_or(F.col("is_landing") & F.col("csc").isNotNull()).alias("landed"),
        F.bool_or(F.col("user_id").isNotNull()).alias("signed_in"),
    )
    return s.agg(
        F.count("*").alias("sessions"),
        F.count("first_search").alias("with_search"),
        F.count("last_product").alias("with_product_view"),
        F.count_if("landed").alias("landed_on_product"),
        F.count_if(F.col("last_product") > F.col("first_search")).alias("search_then_product"),
        F.count_if("signed_in").alias("signed_in_sessions"),
    )


def watch_attribution(
    watch: DataFrame, views: DataFrame, before: str = "2 hours", after: str = "5 minutes", intents: DataFrame | None = None
) -> DataFrame:
    """One row: adds, adds by tracked users, adds near a view of the same item,
    those whose session had searched before, and those asked for while signed out.
    ``intents``: signed-out requests (csc, applied_user), null until applied.

    An equi-join on (user, item) with the time range as a further condition."""
    searched = views.where(_searched()).groupBy("session_id").agg(F.min("created_at").alias("first_search"))
    seen = (
        views.where("csc is not null")
        .join(searched, "session_id", "left")
        .select(
            "user_id", "csc", F.col("created_at").alias("viewed_at"),
            F.coalesce(F.col("first_search") < F.col("created_at"), F.lit(False)).alias("after_search"),
        )
    )
    hits = (
        watch.join(seen, ["user_id", "csc"])
        .where(
            (F.col("viewed_at") >= F.col("created_at") - F.expr(f"interval {before}"))
            & (F.col("viewed_at") <= F.col("created_at") + F.expr(f"interval {after}"))
        )
        .groupBy("user_id", "csc")
        .agg(F.bool_or("after_search").alias("after_search"))
    )
    tracked = views.select("user_id").distinct().withColumn("tracked", F.lit(True))
    if intents is None:
        intents = watch.limit(0).select(F.col("user_id").alias("applied_user"), "csc")
    requested = intents.where("applied_user is not null").select(F.col("applied_user").alias("user_id"), "csc").distinct().withColumn("requested", F.lit(True))
    return (
        watch.join(hits, ["user_id", "csc"], "left")
        .join(tracked, "user_id", "left")
        .join(requested, ["user_id", "csc"], "left")
        .agg(
            F.count("*").alias("adds"),
            F.count("tracked").alias("by_tracked_users"),
            F.count("after_search").alias("after_product_view"),
            F.count_if("after_search").alias("after_search_then_product"),
            F.count("requested").alias("via_signed_out_request"),
            F.countDistinct("user_id").alias("users"),
        )
    )


def intent_funnel(requests: DataFrame, as_of: datetime, ttl_hours: int = 24) -> DataFrame:
    """Watch requests by surface and test address.

    ``requests``: (source, email, created_at, applied_at, store_id)."""
    edge = times.ago(as_of, f"{ttl_hours} hours")
    open_ = F.col("applied_at").isNull()
    surface = F.coalesce(F.split_part("source", F.lit(":"), F.lit(1)), F.lit("unattributed"))
    return requests.groupBy(surface.alias("surface"), clients.is_untracked("email").alias("test_address")).agg(
        F.count("*").alias("requests"),
        F.count("applied_at").alias("applied"),
        F.count_if(F.col("applied_at") < F.col("created_at") + F.expr("interval 1 hour")).alias("applied_within_1h"),
        F.count_if(open_ & (F.col("created_at") < edge)).alias("expired"),
        F.count_if(open_ & (F.col("created_at") >= edge)).alias("pending"),
        F.count("store_id").alias("with_store"),
        F.countDistinct("email").alias("people"),
    )


def list_identity(source: str, params: Column, area: Column, results: Column) -> Column:
    """A hash naming one displayed list: its sorted filters, area and size, as JSON,
    in which different lists never read alike. ``params``: array<struct<k, v>>; empty
    values do not count. ``area``: a struct with label and coordinates, or null."""
    kept = F.array_sort(
        F.filter(
            F.transform(params, lambda p: F.struct(p["k"].alias("k"), F.when(p["k"] == "q", F.trim(p["v"])).otherwise(p["v"]).alias("v"))),
            lambda p: p["v"] != "",
        )
    )
    whole = F.struct(times.col(source).alias("source"), kept.alias("params"), area.alias("area"), results.alias("results"))
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def distinct_lists(shown: DataFrame) -> DataFrame:
    """One impression per visitor and list: the same list shown again is not new."""
    return shown.dropDuplicates(["visitor_id", "list_key"])


def search_impressions(actions: DataFrame) -> DataFrame:
    """Lists shown, empty ones and the median number of results, by view."""
    shown = actions.where("kind = 'shown' and surface = 'search'")
    counts = shown.groupBy("view").agg(
        F.count("*").alias("impressions"),
        F.count_if(F.col("results") == 0).alias("zero_results"),
        F.round(100.0 * F.count_if(F.col("results") == 0) / F.nullif(F.count("*"), F.lit(0)), 1).alias("zero_pct"),
    )
    q = skew.quantiles(shown, ["view"], "results", {"median_results": 0.5}, width=1.0)
    return counts.join(q, "view", "left")


def result_sizes(actions: DataFrame) -> DataFrame:
    n = F.col("results")
    bucket = F.when(n == 0, "0").when(n <= 3, "1-3").when(n <= 20, "4-20").otherwise("21+")
    return actions.where("kind = 'shown' and surface = 'search'").groupBy("view", bucket.alias("results")).agg(
        F.count("*").alias("lists"), F.countDistinct("visitor_id").alias("visitors")
    )


def zero_result_queries(actions: DataFrame, n: int = 40) -> DataFrame:
    return (
        actions.where("kind = 'shown' and surface = 'search' and results = 0 and query is not null")
        .groupBy(F.lower(F.trim("query")).alias("query"))
        .agg(F.countDistinct("visitor_id").alias("visitors"), F.count("*").alias("times"))
        .orderBy(F.col("visitors").desc(), F.col("times").desc(), "query")
        .limit(n)
    )


def clicks_by_rank(actions: DataFrame) -> DataFrame:
    r = F.col("rank")
    bucket = F.when(r <= 3, r.cast("string")).when(r <= 10, "4-10").when(r <= 24, "11-24").otherwise("25+")
    return actions.where("kind = 'click' and surface = 'search' and rank is not null").groupBy(bucket.alias("rank")).agg(
        F.count("*").alias("clicks"), F.min("rank").alias("from_rank")
    )


def loyalty_buckets(views: DataFrame, zone: str = times.LOCAL_ZONE) -> DataFrame:
    v = views.groupBy("visitor_id").agg(
        F.countDistinct(times.local_date("created_at", zone)).alias("days"),
        F.count("*").alias("views"),
        F.bool_or(F.col("user_id").isNotNull()).alias("signed_in"),
    )
    d = F.col("days")
    bucket = F.when(d == 1, "1 day").when(d == 2, "2 days").when(d <= 4, "3-4 days").when(d <= 9, "5-9 days").otherwise("10+ days")
    return v.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("visitors"), F.sum("views").alias("views"), F.count_if("signed_in").alias("signed_in")
    )


def new_vs_returning(views: DataFrame, zone: str = times.LOCAL_ZONE) -> DataFrame:
    """Sessions within half an hour of a visitor's first view, and later ones, by week."""
    first = views.groupBy("visitor_id").agg(F.min("created_at").alias("first_at"))
    s = views.groupBy("session_id", "visitor_id").agg(F.min("created_at").alias("started_at"))
    new = F.col("started_at") <= F.col("first_at") + F.expr("interval 30 minutes")
    return (
        s.join(first, "visitor_id")
        .groupBy(times.text(times.local_week("started_at", zone)).alias("week"))
        .agg(F.count_if(new).alias("new_sessions"), F.count_if(~new).alias("returning_sessions"))
    )


def return_cohorts(views: DataFrame, as_of: datetime, zone: str = times.LOCAL_ZONE) -> DataFrame:
    """First-visit weeks: who came back on a later day, within 7 and 14 days."""
    d = views.select("visitor_id", times.local_date("created_at", zone).alias("day")).distinct()
    first = d.groupBy("visitor_id").agg(F.min("day").alias("first_day"))
    later = F.datediff("day", "first_day")
    v = (
        d.join(first, "visitor_id")
        .groupBy("visitor_id", "first_day")
        .agg(F.min(F.when(later > 0, later)).alias("back_after"))
    )
    week = F.to_date(F.date_trunc("week", "first_day"))
    return v.groupBy(week.alias("w")).agg(
        F.count("*").alias("visitors"),
        F.count_if(F.col("back_after") <= 7).alias("back_within_7d"),
        F.count_if(F.col("back_after") <= 14).alias("back_within_14d"),
        F.count("back_after").alias("back_ever"),
    ).select(
        times.text("w").alias("cohort_week"),
        "visitors",
        "back_within_7d",
        "back_within_14d",
        "back_ever",
        F.datediff(times.ts(as_of).cast("date"), F.col("w")).alias("days_since_start"),
    )


def hour_dow(views: DataFrame, zone: str = times.LOCAL_ZONE) -> DataFrame:
    """Views and sessions by local weekday (0 = Sunday) and hour."""
    at = times.local("created_at", zone)
    return views.groupBy((F.dayofweek(at) - 1).alias("dow"), F.hour(at).alias("hour")).agg(
        F.count("*").alias("views"), F.countDistinct("session_id").alias("sessions")
    )


def geo_device_mix(views: DataFrame, n: int = 20, home_region: str | None = None) -> DataFrame:
    """Sessions and visitors by region, by city (of ``home_region``, if one is given), by client,
    by campaign, and of landing views by referrer; the top of each. ``views`` have country,
    region, city, device, os, browser, referrer_host, utm_source, utm_medium, utm_campaign."""

    def kind(mix: str, *parts: Column, when: Column = F.lit(True)) -> Column:
        return F.when(when, F.struct(F.lit(mix).alias("mix"), F.concat_ws(" / ", *parts).alias("value")))

    def named(column: str, none: str) -> Column:
        return F.coalesce(column, F.lit(none))

    at_home = F.lit(True) if home_region is None else F.coalesce(F.col("region") == home_region, F.lit(False))
    kinds = F.array(
        kind("region", named("country", "?"), named("region", "?")),
        kind("city", named("city", "?"), when=at_home),
        kind("client", F.col("device"), F.col("os"), F.col("browser")),
        kind("campaign", F.col("utm_source"), named("utm_medium", "?"), named("utm_campaign", "?"), when=F.col("utm_source").isNotNull()),
        kind("referrer", named("referrer_host", "(none)"), when=F.col("is_landing")),
    )
    per = (
        views.select("session_id", "visitor_id", F.explode(F.array_compact(kinds)).alias("m"))
        .groupBy("m.mix", "m.value")
        .agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("visitor_id").alias("visitors"))
    )
    w = Window.partitionBy("mix").orderBy(F.col("sessions").desc(), "value")
    return per.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def source_engagement(views: DataFrame) -> DataFrame:
    """Per landing source: views per session, bounce, product and search shares,
    median seconds."""
    s = per_session(views).withColumn("source", F.coalesce("source", F.lit("unknown")))

    def share(cond: Column) -> Column:
        return F.round(100.0 * F.count_if(cond) / F.count("*"), 1)

    per = s.groupBy("source").agg(
        F.count("*").alias("sessions"),
        F.round(F.avg("views"), 2).alias("views_per_session"),
        share(F.col("views") == 1).alias("bounce_pct"),
        share(F.col("products") > 0).alias("saw_product_pct"),
        share(F.col("searches") > 0).alias("searched_pct"),
    )
    q = skew.quantiles(s, ["source"], "secs", {"median_secs": 0.5}, width=60.0)
    return per.join(q, "source").withColumn("median_secs", F.round("median_secs", 3))


def page_type_mix(views: DataFrame) -> DataFrame:
    return views.groupBy(page_type("path").alias("page")).agg(
        F.count("*").alias("views"), F.countDistinct("session_id").alias("sessions"), F.count_if("is_landing").alias("landings")
    )


def session_depth(views: DataFrame) -> DataFrame:
    s = views.groupBy("session_id").agg(F.count("*").alias("n"))
    n = F.col("n")
    bucket = F.when(n == 1, "1").when(n == 2, "2").when(n <= 4, "3-4").when(n <= 9, "5-9").otherwise("10+")
    return s.groupBy(bucket.alias("views")).agg(F.count("*").alias("sessions"))


def viewed_state_mix(views: DataFrame, catalog: DataFrame, resolved: DataFrame) -> DataFrame:
    """Product views by stock state and published tier.

    Views combine per item and visitor before the facts are joined."""
    per = views.where("csc is not null").groupBy("csc", "visitor_id").agg(F.count("*").alias("n"))
    stock = F.when(F.col("in_stock").isNull(), "unknown code").when(F.col("in_stock"), "in stock").otherwise("out of stock")
    tiers = resolved.where("published").select("csc", "tier")
    return (
        per.join(catalog.select("csc", "in_stock"), "csc", "left")
        .join(tiers, "csc", "left")
        .groupBy(stock.alias("stock"), F.coalesce("tier", F.lit("unrated")).alias("tier"))
        .agg(F.sum("n").alias("views"), F.countDistinct("visitor_id").alias("visitors"), F.countDistinct("csc").alias("products"))
    )


def top_viewed(views: DataFrame, catalog: DataFrame, watch: DataFrame, n: int = 25) -> DataFrame:
    per = views.where("csc is not null").groupBy("csc").agg(F.countDistinct("visitor_id").alias("visitors"), F.count("*").alias("views"))
    top = per.orderBy(F.col("visitors").desc(), F.col("views").desc(), "csc").limit(n)
    watchers = watch.join(top.select("csc"), "csc", "left_semi").groupBy("csc").agg(F.count("*").alias("watchers"))
    return top.join(catalog.select("csc", "name", "in_stock"), "csc", "left").join(watchers, "csc", "left").fillna(0, ["watchers"])


def interest_vs_sales_mix(views: DataFrame, catalog: DataFrame, sales: DataFrame) -> DataFrame:
    """Each category's share of visitor-product pairs against its share of the
    newest month's sales."""
    cats = catalog.select("csc", "category")
    pairs = views.where("csc is not null").select("visitor_id", "csc").distinct()
    interest = pairs.join(cats, "csc").groupBy("category").agg(F.count("*").alias("interest"))
    newest = sales.agg(F.max("period_month")).scalar()
    sold = (
        sales.where(F.col("period_month") == newest)
        .groupBy(F.col("item_code").alias("csc"))
        .agg(F.sum("dollars").alias("d"))
        .join(cats, "csc")
        .groupBy("category")
        .agg(F.sum("d").alias("dollars"))
    )
    both = interest.join(sold, "category", "full_outer").fillna(0, ["interest"]).withColumn(
        "dollars", F.coalesce(F.col("dollars").cast("double"), F.lit(0.0))
    )
    whole = Window.partitionBy(F.lit(0))
    return both.select(
        "category",
        F.col("interest").alias("pairs"),
        F.round(100.0 * F.col("interest") / F.nullif(F.sum("interest").over(whole), F.lit(0)), 1).alias("interest_pct"),
        F.round(100.0 * F.col("dollars") / F.nullif(F.sum("dollars").over(whole), F.lit(0.0)), 1).alias("sales_pct"),
    )


def delivery_mix(deliveries: DataFrame, changes: DataFrame, zone: str = times.LOCAL_ZONE) -> DataFrame:
    """Deliveries by local month and event type."""
    month = F.date_format(times.local("sent_at", zone), "yyyy-MM")
    return (
        deliveries.join(changes.select("event_id", "csc", "event_type"), "event_id")
        .groupBy(month.alias("month"), "event_type")
        .agg(F.count("*").alias("deliveries"), F.countDistinct("user_id").alias("users"), F.countDistinct("csc").alias("items"))
    )


def delivered_share(changes: DataFrame, deliveries: DataFrame, as_of: datetime, hours: int = 48) -> DataFrame:
    """Recent events by type and how many reached at least one watcher."""
    told = deliveries.select("event_id").distinct().withColumn("told", F.lit(True))
    return (
        changes.where(F.col("created_at") > times.ago(as_of, f"{hours} hours"))
        .join(told, "event_id", "left")
        .groupBy("event_type")
        .agg(F.count("*").alias("events"), F.count("told").alias("sent"))
    )


def email_sessions(views: DataFrame, zone: str = times.LOCAL_ZONE) -> DataFrame:
    rows = views.where("utm_source = 'email' or source = 'Email'")
    return rows.groupBy(times.text(times.local_date("created_at", zone)).alias("day")).agg(
        F.countDistinct("session_id").alias("sessions"), F.count("*").alias("views")
    )


def returning_behaviour(views: DataFrame, zone: str = times.LOCAL_ZONE, n: int = 10) -> DataFrame:
    """What visitors seen on two or more days look at."""
    back = (
        views.groupBy("visitor_id")
        .agg(F.countDistinct(times.local_date("created_at", zone)).alias("days"))
        .where("days >= 2")
    )
    return (
        views.join(back, "visitor_id", "left_semi")
        .groupBy(page_type("path").alias("page"))
        .agg(F.count("*").alias("views"))
        .orderBy(F.col("views").desc(), "page")
        .limit(n)
    )


def model_call_stats(calls: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """One row: calls, successes, latency percentiles, tokens and cost per call.

    ``calls``: (ms, ok, input_tokens, output_tokens); prices per million tokens."""
    q = skew.quantiles(calls, [], "ms", {"p50_ms": 0.5, "p90_ms": 0.9}, width=10.0)
    cost = (F.sum("input_tokens") * input_price + F.sum("output_tokens") * output_price) / 1e6
    return calls.agg(
        F.count("*").alias("calls"),
        F.count_if("ok").alias("ok"),
        F.max("ms").alias("max_ms"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(cost, 4).alias("cost"),
        F.round(cost / F.nullif(F.count("*"), F.lit(0)), 6).alias("cost_per_call"),
    ).select("*", *[F.round(q.select(c).scalar(), 3).alias(c) for c in ("p50_ms", "p90_ms")])
