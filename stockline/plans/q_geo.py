"""Queries over distances, areas and local availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo
from .registry import define, query

MILES = 30.0


def areas(t):
    return geo.area_centroids(t.stores)


def near(t):
    return geo.stores_within(areas(t), t.stores, MILES)


def nearby(t, hours=geo.FRESH_HOURS):
    return geo.nearby_stock(near(t), t.store_now, t.catalog, t.as_of, hours)


def homes(t):
    """Each watcher's home store and area, from the user number."""
    users = t.watch.select("user_id", (F.col("user_id") % 25).cast("int").alias("store_id")).distinct()
    return users.join(t.stores.select(F.col("id").alias("store_id"), F.col("city").alias("area"), "lat", "lng"), "store_id")


@query("stores_within", "select area, id, round(miles, 6) as miles from o_near")
def _(t):
    return near(t).withColumn("miles", F.round("miles", 6))


@query("area_centroids", "select county as area, round(avg(lat), 6) as lat, round(avg(lng), 6) as lng from v_stores group by 1")
def _(t):
    c = geo.area_centroids(t.stores, by="county")
    return c.withColumn("lat", F.round("lat", 6)).withColumn("lng", F.round("lng", 6))


_NEARBY = """
    select n.area, s.csc, count(*) as stores, sum(s.qty)::bigint as units, any_value(k.checked_at) as checked_at,
           any_value(c.store_qty) as statewide_qty, any_value(c.last_seen) as statewide_at
    from v_store_now s join o_near n on n.id = s.store_id
    join (select csc, min(seen_at) as checked_at from v_store_now where seen_at > (select t from clock) - interval {h} hour group by 1) k using (csc)
    join v_catalog c using (csc)
    where s.qty > 0 and s.seen_at > (select t from clock) - interval {h} hour group by 1, 2"""
define("o_nearby", _NEARBY.format(h=168))
define("o_nearby_day", _NEARBY.format(h=24))


@query("nearby_stock", "select * from o_nearby")
def _(t):
    return nearby(t)


@query(
    "nearby_asked",
    """with asked as (select distinct s.city as area, w.csc from v_watch w join v_stores s on s.id = w.user_id % 25),
       checked as (select csc, min(seen_at) as checked_at from v_store_now where seen_at > (select t from clock) - interval 168 hour group by 1)
       select a.area, a.csc, coalesce(n.stores, 0) as stores, coalesce(n.units, 0) as units, k.checked_at, c.store_qty as statewide_qty, c.last_seen as statewide_at
       from asked a join checked k using (csc) join v_catalog c using (csc) left join o_nearby n on n.area = a.area and n.csc = a.csc""",
)
def _(t):
    return geo.nearby_asked(homes(t).join(t.watch.select("user_id", "csc"), "user_id"), near(t), t.store_now, t.catalog, t.as_of)


define(
    "o_held",
    """select s.csc, s.store_id, s.qty, st.lat, st.lng, st.is_club from v_store_now s join v_catalog c using (csc) join v_stores st on st.id = s.store_id
       where s.qty > 0 and not (c.last_seen > s.seen_at and s.qty > coalesce(c.store_qty, 0))""",
)


@query(
    "store_ranking",
    f"""with r as (select w.user_id, w.csc, h.store_id, h.qty, h.is_club, h.store_id = w.user_id % 25 as mine,
                     round(3959 * 2 * asin(least(1, sqrt(pow(sin(radians(h.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(h.lat))
                           * pow(sin(radians(h.lng - a.lng) / 2), 2)))), 6) as d
              from v_watch w join v_stores a on a.id = w.user_id % 25 join o_held h using (csc))
       select user_id, csc, arg_min(store_id, (d, store_id)) filter (where not is_club) as nearest,
              arg_min(store_id, (-qty, store_id)) filter (where not is_club) as most, max(store_id) filter (where mine) as mine
       from r group by 1, 2""",
)
def _(t):
    return geo.store_ranking(t.watch, homes(t).select("user_id", "store_id", "lat", "lng"), t.stores, t.store_now, t.catalog)


@query(
    "freshness_claims",
    """select s.csc, s.store_id, s.seen_at >= (select t from clock) - interval 24 hour as may_claim_none,
              c.last_seen > s.seen_at and coalesce(c.store_qty, 0) <= 0 as none_statewide_since,
              s.qty > 0 and c.last_seen > s.seen_at and s.qty > coalesce(c.store_qty, 0) as exceeds_statewide
       from v_store_now s join v_catalog c using (csc)""",
)
def _(t):
    return geo.freshness_claims(t.store_now, t.catalog, t.as_of)


@query(
    "local_answer",
    """with p as (select csc, max(seen_at) as checked_at, bool_or(qty > 0) as any_stock from v_store_now group by 1),
       l as (select d.area, s.csc, count(*) filter (where not is_club) as stores, coalesce(sum(s.qty) filter (where not is_club), 0)::bigint as units,
                    sum(s.qty) as all_units
             from v_store_now s join o_dist d on d.id = s.store_id and d.miles <= 30 where s.qty > 0 group by 1, 2),
       g as (select a.area, c.csc, c.store_qty, c.last_seen, c.delisted_at, p.checked_at, p.any_stock, coalesce(l.stores, 0) as stores,
                    coalesce(l.units, 0) as units, coalesce(l.all_units, 0) as all_units
             from v_areas a cross join v_catalog c left join p on p.csc = c.csc left join l on l.area = a.area and l.csc = c.csc),
       v as (select *, case when delisted_at is not null then 'delisted'
               when coalesce(store_qty, 0) <= 0 and last_seen is not null and not coalesce(checked_at > last_seen and any_stock, false) then 'statewide-zero'
               when not coalesce(checked_at >= (select t from clock) - interval 168 hour, false) then 'unknown'
               when stores > 0 and last_seen > checked_at and (coalesce(store_qty, 0) <= 0 or all_units > coalesce(store_qty, 0)) then 'disproved'
               when stores > 0 and checked_at >= (select t from clock) - interval 24 hour then 'fresh-positive'
               when stores > 0 then 'stale-positive'
               when checked_at >= (select t from clock) - interval 24 hour then 'fresh-zero' else 'unknown' end as verdict from g)
       select area, csc, verdict, case when verdict like '%positive' then stores end as stores, case when verdict like '%positive' then units end as units,
              verdict in ('stale-positive', 'unknown', 'disproved') as wants_check from v""",
)
def _(t):
    every = geo.stores_within(areas(t), t.stores, MILES, public=False)
    return geo.local_answer(every, t.stores, t.store_now, t.catalog, areas(t), t.as_of)


define("o_checks", "select csc, max(seen_at) as checked_at from v_store_now group by 1")


def checks(t):
    return t.store_now.groupBy("csc").agg(F.max("seen_at").alias("checked_at"))


@query(
    "near_state",
    """select a.area, c.csc, case when n.stores > 0 and n.checked_at >= (select t from clock) - interval 24 hour then 'near'
                               when c.checked_at >= (select t from clock) - interval 24 hour then 'not-near' else 'unknown' end as state
       from v_areas a cross join o_checks c left join o_nearby_day n on n.area = a.area and n.csc = c.csc""",
)
def _(t):
    return geo.near_state(nearby(t, 24), checks(t), areas(t), t.as_of)


@query(
    "watch_summary",
    """select w.user_id, count(*) as watched, count(*) filter (where c.in_stock) as in_stock, count(n.checked_at) as near, min(n.checked_at) as oldest_check
       from v_watch w join v_stores s on s.id = w.user_id % 25 left join v_catalog c using (csc)
       left join o_nearby n on n.area = s.city and n.csc = w.csc
         and not (n.statewide_at > n.checked_at and (coalesce(n.statewide_qty, 0) <= 0 or n.units > coalesce(n.statewide_qty, 0)))
       group by 1""",
)
def _(t):
    return geo.watch_summary(t.watch, homes(t).select("user_id", "area"), nearby(t), t.catalog)


@query(
    "store_breadth",
    """select s.store_id, st.city, st.is_club, count(distinct s.csc) as products, sum(s.qty)::bigint as units,
              count(*) filter (where r.shown_tier in ('scarce', 'rare', 'unicorn')) as scarce
       from v_store_now s join v_stores st on st.id = s.store_id left join o_resolved r using (csc)
       where s.qty > 0 and s.seen_at > (select t from clock) - interval 168 hour group by 1, 2, 3""",
)
def _(t):
    return geo.store_breadth(t.store_now, t.stores, t.as_of, t.resolved)
