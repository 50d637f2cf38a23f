"""Queries over alerts, interest and work selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as a, ingest
from .registry import define, query

define("v_homes", "select distinct user_id, (user_id % 25)::int as store_id from v_watch")
define("v_muted", "select distinct user_id from v_watch where user_id % 7 = 0")
define(
    "o_digest",
    """with e as (select event_id, csc, event_type, created_at from v_changes where created_at > (select t from clock) - interval 48 hour),
       g as (select w.user_id, e.* from e join v_catalog p using (csc) join v_watch w using (csc)
             where e.created_at >= w.created_at
               and (event_type <> 'restock' or (p.in_stock and not exists (select 1 from e l where l.csc = e.csc and l.event_type = 'out_of_stock' and l.created_at > e.created_at)))
               and (event_type <> 'out_of_stock' or (not p.in_stock and not exists (select 1 from e l where l.csc = e.csc and l.event_type = 'restock' and l.created_at > e.created_at)))),
       s as (select w.user_id, r.event_id, r.csc, 'store_restock' as event_type, r.created_at
             from v_store_restocks r join v_watch w using (csc) join v_homes h on h.user_id = w.user_id and h.store_id = r.store_id
             join v_store_now n on n.csc = r.csc and n.store_id = r.store_id and n.qty > 0
             where r.created_at > (select t from clock) - interval 48 hour and r.created_at >= w.created_at)
       select * from (select * from g union all select * from s) m
       where user_id not in (select user_id from v_muted)
         and not exists (select 1 from v_deliveries d where d.user_id = m.user_id and d.event_id = m.event_id)""",
)


def homes(t):
    return t.watch.select("user_id", (F.col("user_id") % 25).cast("int").alias("store_id")).distinct()


def muted(t):
    return t.watch.where("user_id % 7 = 0").select("user_id").distinct()


def digest(t):
    return a.digest_match(
        t.changes, ingest.store_restock_events(t.store_obs), t.watch, homes(t), t.catalog, t.store_now, muted(t), t.deliveries, t.as_of
    )


@query("digest_match", "select * from o_digest")
def _(t):
    return digest(t)


define(
    "v_drop_events",
    "select (epoch(drop_date) // 86400)::bigint as event_id, drop_date::timestamp as created_at from (select distinct drop_date from v_drops)",
)


def drop_events(t):
    return t.drops.select("drop_date").distinct().select(
        F.unix_date("drop_date").cast("bigint").alias("event_id"), F.col("drop_date").cast("timestamp_ntz").alias("created_at")
    )


@query(
    "drop_alert_match",
    """select u.user_id, e.event_id from (select distinct user_id from v_watch where user_id % 7 <> 0) u, v_drop_events e
       where e.created_at > (select max(created_at) from v_drop_events) - interval 96 hour and not (u.user_id % 5 = 0 and e.event_id % 2 = 0)""",
)
def _(t):
    """Told at the time of the newest drop; a fifth of the users know every other one of the last 30 days."""
    users, events = t.watch.where("user_id % 7 <> 0"), drop_events(t)
    newest = events.agg(F.max("created_at")).first()[0]
    known = events.where((F.col("event_id") % 2 == 0) & (F.col("created_at") > F.lit(newest) - F.expr("interval 30 days")))
    ids = known.agg(F.collect_set("event_id")).scalar()  # a day is an event, so 15 at most
    told = users.where("user_id % 5 = 0").select("user_id").distinct().withColumn("event_id", F.explode(ids))
    return a.drop_alert_match(events, users, told, newest, lookback_hours=96)


@query(
    "digest_batches",
    """with m as (select w.user_id, c.event_id, c.created_at from v_changes c join v_watch w using (csc) where c.created_at >= w.created_at),
       r as (select *, row_number() over (partition by user_id order by created_at, event_id) as rn from m)
       select user_id, string_agg(event_id::varchar, ',' order by rn) filter (where rn <= 50) as events, greatest(count(*) - 50, 0) as more,
              'digest/' || user_id || '/' || max(event_id) as message_key from r group by user_id""",
)
def _(t):
    matches = (
        t.changes.select("event_id", "csc", "created_at")
        .join(t.watch.withColumnRenamed("created_at", "watched_at"), "csc")
        .where("created_at >= watched_at")
    )
    return a.digest_batches(matches)


@query(
    "delivery_dedupe",
    """select distinct w.user_id, c.event_id from v_changes c join v_watch w using (csc) where c.created_at >= w.created_at
         and not exists (select 1 from v_deliveries d where d.user_id = w.user_id and d.event_id = c.event_id)""",
)
def _(t):
    rows = (
        t.changes.select("event_id", "csc", "created_at")
        .join(t.watch.withColumnRenamed("created_at", "watched_at"), "csc")
        .where("created_at >= watched_at")
        .select("user_id", "event_id")
    )
    return a.undelivered(rows.unionByName(rows), t.deliveries)


def requests(t):
    return t.events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("request_id"),
        "user_id",
        F.lpad((F.col("k") * 21).cast("string"), 6, "0").alias("csc"),
        F.col("ts").alias("created_at"),
        (F.col("event_id") % 11 != 0).alias("same_email"),
    )


@query(
    "intent_reconcile",
    """with r as (select event_id as request_id, user_id, lpad((k * 21)::varchar, 6, '0') as csc, ts as created_at, event_id % 11 <> 0 as ok
                  from v_events where event_type = 'purchase'),
       e as (select r.*, case when p.csc is null then 'not_found' when not ok then 'mismatch'
                              when r.created_at < (select t from clock) - interval 600 hour then 'expired'
                              when w.csc is not null then 'already' end as early
             from r left join v_products p on p.csc = r.csc left join v_watch w on w.user_id = r.user_id and w.csc = r.csc),
       f as (select user_id, csc, arg_min(request_id, (created_at, request_id)) as first_id, min(created_at) as asked from e where early is null group by 1, 2),
       n as (select f.*, row_number() over (partition by user_id order by asked, first_id) + coalesce((select count(*) from v_watch w where w.user_id = f.user_id), 0) as pos from f)
       select e.request_id, e.user_id, e.csc, case when early is not null then early when n.pos > 18 then 'full'
                when n.first_id = e.request_id then 'added' else 'already' end as status
       from e left join n on n.user_id = e.user_id and n.csc = e.csc""",
)
def _(t):
    return a.intent_reconcile(requests(t), t.watch, t.products, t.as_of, ttl_hours=600, cap=18)


define("v_checks", "select lpad(user_id::varchar, 6, '0') as csc, ts as seen_at, event_type not in ('error', 'signup') as ok from v_events")
define(
    "o_backoff",
    """with g as (select csc, max(seen_at) filter (where ok) as checked_at from v_checks group by 1),
       b as (select c.csc, count(*) as failures, max(c.seen_at) as last_failure from v_checks c join g using (csc)
             where not c.ok and (g.checked_at is null or c.seen_at > g.checked_at) group by 1),
       r as (select csc, max(created_at) as restocked_at from v_changes where event_type = 'restock' group by 1)
       select g.csc, g.checked_at, coalesce(b.failures, 0) as failures,
              case when b.last_failure is not null and not coalesce(r.restocked_at > b.last_failure, false)
                   then b.last_failure + to_microseconds((least(3 * power(2, b.failures), 72) * 3600 * 1000000)::bigint) end as retry_at
       from g left join b using (csc) left join r using (csc)""",
)


def checks(t):
    return t.events.select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("csc"),
        F.col("ts").alias("seen_at"),
        (~F.col("event_type").isin("error", "signup")).alias("ok"),
    )


def backoff(t):
    return a.failure_backoff(checks(t), t.changes.where("event_type = 'restock'"))


@query("failure_backoff", "select * from o_backoff")
def _(t):
    return backoff(t)


define(
    "o_targets",
    """with r as (select c.csc, c.status, c.in_stock, b.checked_at, coalesce(b.failures, 0) as failures, c.csc in (select csc from v_watch) as watched
                  from v_catalog c left join o_backoff b using (csc) where b.retry_at is null or b.retry_at <= (select t from clock)),
       f as (select * from r where watched and (checked_at is null or checked_at < (select t from clock) - interval 3 hour)
             order by checked_at nulls first, csc limit 40),
       s as (select *, row_number() over (order by coalesce(checked_at, timestamp '1970-01-01')
                  - case when watched then interval 3 day when status in ('A', 'L', 'D') then interval 1 day else interval 0 day end, csc) as rn
             from r where (in_stock or watched) and csc not in (select csc from f))
       select csc, 'watched' as lane, failures > 0 as failing from f
       union all select csc, 'rotation', failures > 0 from s where rn <= 100 - (select count(*) from f)""",
)


@query("select_targets", "select * from o_targets")
def _(t):
    return a.select_targets(t.catalog, backoff(t), t.watch, t.as_of, budget=100)


@query(
    "pending_antijoin",
    """select c_mktsegment as segment, count(*) as pending, count(distinct lower(c_name)) as addresses from customer
       where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') group by 1""",
)
def _(t):
    people = t.table("customer")
    signups = people.select(F.concat("c_name", F.lit("@Example.org")).alias("email"), F.col("c_mktsegment").alias("segment"))
    accounts = (
        t.table("orders")
        .where("o_orderstatus = 'F'")
        .join(people, F.col("c_custkey") == F.col("o_custkey"))
        .select(F.upper(F.concat("c_name", F.lit("@example.org"))).alias("email"))
    )
    return a.pending_signups(signups, accounts)


@query(
    "watch_distribution",
    """select case when n = 1 then '1' when n <= 3 then '2-3' when n <= 10 then '4-10' else '11+' end as watches, count(*) as users, sum(n)::bigint as total
       from (select user_id, count(*) as n from v_watch group by 1) group by 1""",
)
def _(t):
    return a.watch_distribution(t.watch)


@query(
    "most_watched",
    """with top as (select csc, count(*) as watchers, max(created_at)::date::varchar as latest_add from v_watch join v_catalog using (csc) group by 1 order by 2 desc, 1 limit 25)
       select t.csc, watchers, latest_add, c.name, c.status, c.in_stock, c.store_qty, r.tier,
              (select count(*) from v_changes e where e.csc = t.csc and e.event_type = 'restock' and e.created_at >= (select t from clock) - interval 60 day) as restocks
       from top t join v_catalog c using (csc) left join o_rated r on r.csc = t.csc and r.published""",
)
def _(t):
    return a.most_watched(t.watch, t.catalog, t.resolved, t.changes, t.as_of)


@query(
    "watched_restock_share",
    """select count(*) as watched, count(*) filter (where csc in (select csc from v_changes where event_type = 'restock') or csc in (select csc from v_store_restocks)) as any_restock,
              count(*) filter (where csc in (select csc from v_changes where event_type = 'restock')) as statewide_restock,
              count(*) filter (where csc in (select csc from v_catalog where in_stock)) as in_stock_now
       from (select distinct csc from v_watch)""",
)
def _(t):
    return a.watched_restock_share(t.watch, t.changes, ingest.store_restock_events(t.store_obs), t.catalog)


@query(
    "home_stores_chosen",
    """select store_id, count(*) as users, any_value(city) as city, any_value(is_club) as is_club from v_homes join v_stores on id = store_id
       group by 1 order by 2 desc, 1 limit 15""",
)
def _(t):
    return a.home_stores_chosen(homes(t), t.stores)
