"""Queries for the quality and market reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, reports as r
from . import q_alerts
from .registry import define, query


def state(t):
    return t.catalog.select("csc").join(q_alerts.backoff(t), "csc", "left")


define("o_state", "select c.csc, b.checked_at, b.failures, b.retry_at from v_catalog c left join o_backoff b using (csc)")


@query(
    "age_buckets",
    """select case when checked_at is null then 'never' when age < 24 then '< 1 day' when age < 72 then '1-3 days' when age < 168 then '3-7 days' else 'over 7 days' end as age,
              count(*) as products from (select *, (epoch_us((select t from clock)) - epoch_us(checked_at)) / 1e6 / 3600 as age from o_state) s
       group by case when checked_at is null then 'never' when s.age < 24 then '< 1 day' when s.age < 72 then '1-3 days' when s.age < 168 then '3-7 days' else 'over 7 days' end""",
)
def _(t):
    return r.age_buckets(state(t), t.as_of)


@query(
    "overdue_checks",
    "select csc, checked_at from o_state where csc in (select csc from v_watch) and (checked_at is null or checked_at < (select t from clock) - interval 24 hour) order by checked_at nulls first, csc limit 25",
)
def _(t):
    watched = state(t).join(t.watch.select("csc"), "csc", "left_semi")
    return r.overdue(watched, t.as_of).select("csc", "checked_at")


@query(
    "failing_checks",
    """select count(*) as products, count(*) filter (where csc in (select csc from v_watch)) as watched, count(*) filter (where retry_at > (select t from clock)) as backing_off
       from o_state where failures > 0""",
)
def _(t):
    return r.failing_counts(state(t), t.watch, t.as_of)


@query(
    "segment_coverage",
    """with p as (select c.csc, s.checked_at as t, c.store_qty, c.status, o.shown_tier, c.csc in (select csc from v_watch) as watched
                  from v_catalog c left join o_state s using (csc) left join o_resolved o using (csc) where c.in_stock and c.delisted_at is null and c.store_qty > 0),
       g as (select 'all' as segment, * from p
             union all select 'bottles ' || case when store_qty >= 1000 then '1000+' when store_qty >= 200 then '200-999' when store_qty >= 50 then '50-199' else '1-49' end, * from p
             union all select 'allocated/limited', * from p where status in ('A', 'L') union all select 'rated scarce+', * from p where shown_tier in ('scarce', 'rare', 'unicorn')
             union all select 'watched', * from p where watched)
       select segment, count(*) as products, """
    + ", ".join(
        f"round(100.0 * count(*) filter (where t > (select t from clock) - interval {h} hour) / count(*), 1)::double as pct_{h}h" for h in (6, 12, 24, 48, 72)
    ).replace("where t >", "where g.t >")
    + ", round(100.0 * count(*) filter (where g.t is null) / count(*), 1)::double as pct_never from g group by segment",
)
def _(t):
    return r.segment_coverage(t.catalog, state(t), t.watch, t.resolved, t.as_of)


define(
    "v_check_log",
    """select seq as check_id, case store_id % 3 when 0 then 'rotation' when 1 then 'watched' else 'on_demand' end as source, seen_at as created_at,
              e.event_type <> 'error' as ok, floor(e.value * 10)::bigint as ms, case when e.event_type = 'error' then 'page answered ' || (500 + e.k % 4) end as error,
              prev_at, case when prev_qty is not null then (qty <> prev_qty)::int end as changed
       from o_rechecks o join v_events e on e.event_id = o.seq""",
)


def check_log(t):
    near = history.skew.neighbours(
        t.store_obs, ["csc", "store_id"], ["seen_at"], F.to_date("seen_at"), prev={"prev_at": "seen_at", "prev_qty": "qty"}
    )
    e = t.events.select(F.col("event_id").alias("seq"), "event_type", "value", "k")
    return near.join(e, "seq").select(
        F.col("seq").alias("check_id"),
        F.when(F.col("store_id") % 3 == 0, "rotation").when(F.col("store_id") % 3 == 1, "watched").otherwise("on_demand").alias("source"),
        F.col("seen_at").alias("created_at"),
        (F.col("event_type") != "error").alias("ok"),
        F.floor(F.col("value") * 10).alias("ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("page answered "), (500 + F.col("k") % 4).cast("string"))).alias("error"),
        "prev_at",
        F.when(F.col("prev_qty").isNotNull(), (F.col("qty") != F.col("prev_qty")).cast("int")).alias("changed"),
    )


@query(
    "check_quality",
    """select source, count(*) as checks, count(*) filter (where not ok) as failed, round(100.0 * count(*) filter (where not ok) / count(*), 1)::double as failed_pct,
              max(ms) as ms_max, round(100.0 * count(*) filter (where ok and changed > 0) / nullif(count(*) filter (where ok and prev_at is not null), 0), 1)::double as pct_with_change,
              round(quantile_cont(ms, 0.5), 2) as ms_p50, round(quantile_cont(ms, 0.9), 2) as ms_p90 from v_check_log group by 1""",
)
def _(t):
    return r.check_quality(check_log(t))


@query(
    "checks_by_day",
    """select timezone('America/Denver', timezone('UTC', created_at))::date::varchar as day, source, count(*) as checks, count(*) filter (where not ok) as failed,
              round(avg(changed) filter (where ok), 4) as avg_changed from v_check_log group by 1, 2""",
)
def _(t):
    return r.checks_by_day(check_log(t))


@query(
    "recent_errors",
    """select source, string_agg(error, '; ' order by created_at desc, check_id desc) as errors
       from (select * from v_check_log where not ok qualify row_number() over (partition by source order by created_at desc, check_id desc) <= 5) group by 1""",
)
def _(t):
    return r.recent_errors(check_log(t))


@query("error_counts", "select error, count(*) as n from v_check_log where not ok group by 1")
def _(t):
    return r.error_counts(check_log(t))


@query(
    "job_quality",
    """select job, count(*) as runs, count(*) filter (where ok) as ok, count(*) filter (where not ok) as failed, count(*) filter (where finished_at is null) as unfinished,
              max((epoch_us(finished_at) - epoch_us(started_at)) / 1e6) as max_secs,
              count(*) filter (where started_at > (select t from clock) - interval 24 hour) as runs_24h,
              count(*) filter (where started_at > (select t from clock) - interval 24 hour and not ok) as fails_24h,
              quantile_cont((epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 0.5) as median_secs from v_runs group by 1""",
)
def _(t):
    return r.job_quality(t.runs, t.as_of)


@query(
    "catalog_totals",
    """select count(*) as products, count(*) filter (where in_stock) as in_stock, count(delisted_at) as delisted, count(distinct category) as categories,
              sum(store_qty) filter (where in_stock)::bigint as on_shelves, (sum(store_qty::decimal(14,0) * current_price::decimal(12,2)) filter (where in_stock))::double as shelf_value
       from v_catalog""",
)
def _(t):
    return r.catalog_totals(t.catalog)


@query(
    "catalog_by_status",
    """select status, count(*) as products, count(*) filter (where in_stock) as in_stock, round(sum(current_price::decimal(12,2))::double / count(*), 2) as avg_price
       from v_catalog group by 1""",
)
def _(t):
    return r.catalog_by(t.catalog, "status")


@query(
    "catalog_profile",
    """with l as (select *, row_number() over (partition by category order by store_qty desc nulls last, csc) as rn from v_catalog where delisted_at is null)
       select category, count(*) as total, count(*) filter (where in_stock) as in_stock, round(quantile_cont(current_price, 0.5), 2) as median_price,
              string_agg(name, '; ' order by rn) filter (where rn <= 3) as top_names from l group by 1""",
)
def _(t):
    return r.catalog_profile(t.catalog)


@query("size_counts", "select size_ml, count(*) as products from v_catalog where delisted_at is null group by 1 order by 2 desc, 1 nulls last limit 15")
def _(t):
    return r.size_counts(t.catalog)


@query(
    "event_mix",
    "select date_trunc('week', timezone('America/Denver', timezone('UTC', created_at)))::date::varchar as week, event_type, count(*) as n from v_changes group by 1, 2",
)
def _(t):
    return r.event_mix(t.changes)


@query("restock_sizes", """select "new"::int as qty, count(*) as restocks from v_changes where event_type = 'restock' group by 1 order by 2 desc, 1 limit 10""")
def _(t):
    return r.restock_sizes(t.changes)


@query(
    "most_restocked",
    "select csc, name, status, count(*) as restocks from v_changes join v_catalog using (csc) where event_type = 'restock' group by 1, 2, 3 order by 4 desc, 1 limit 15",
)
def _(t):
    return r.most_restocked(t.changes, t.catalog)


@query(
    "watchers_affected",
    """select event_type, count(distinct user_id) as users, count(*) as pairs from v_changes c join v_watch w using (csc)
       where c.created_at > (select t from clock) - interval 48 hour group by 1""",
)
def _(t):
    return r.watchers_affected(t.changes, t.watch, t.as_of)


@query("special_share", "select status = 'S' as special_order, count(*) as restocks from v_changes join v_catalog using (csc) where event_type = 'restock' group by 1")
def _(t):
    return r.special_share(t.changes, t.catalog)


@query(
    "new_by_category",
    """select strftime(timezone('America/Denver', timezone('UTC', created_at)), '%Y-%m') as month, category, count(*) as n from v_changes join v_catalog using (csc)
       where event_type = 'new_product' group by 1, 2 having count(*) >= 3""",
)
def _(t):
    return r.new_by_category(t.changes, t.catalog)


@query(
    "price_change_stats",
    """select case when n > o then 'up' else 'down' end as dir, count(*) as n, round(sum(abs(n - o))::double / count(*), 2) as avg_usd,
              round(avg(100 * abs(n - o)::double / o::double), 1) as avg_pct
       from (select old::decimal(12,2) as o, "new"::decimal(12,2) as n from v_changes where event_type = 'price_change') group by 1""".replace("count(*) as n,", "count(*) as cnt,"),
)
def _(t):
    return r.price_change_stats(t.changes).withColumnRenamed("n", "cnt")


@query(
    "biggest_price_changes",
    """select csc, event_id, old::double as was, "new"::double as now from v_changes where event_type = 'price_change'
       order by abs("new"::decimal(12,2) - old::decimal(12,2)) desc, event_id limit 12""",
)
def _(t):
    return r.biggest_price_changes(t.changes)


@query(
    "sales_mix",
    """with m as (select max(period_month) as c from v_sales)
       select class_name as class, coalesce(sum(dollars) filter (where period_month = m.c), 0)::double as current,
              coalesce(sum(dollars) filter (where period_month = m.c - interval 1 year), 0)::double as year_before
       from v_sales, m where period_month = m.c or period_month = m.c - interval 1 year group by 1""",
)
def _(t):
    return r.sales_by_class(t.sales)


@query(
    "top_sellers",
    """select item_code, item_name, sum(bottles)::bigint as bottles, sum(dollars)::double as dollars from v_sales
       where period_month = (select max(period_month) from v_sales) group by 1, 2 order by 4 desc, 1 limit 20""",
)
def _(t):
    return r.top_sellers(t.sales)


@query(
    "price_bands",
    """select case when e < 1000 then '<$1000' when e < 2000 then '$1000-2000' when e < 3000 then '$2000-3000' when e < 5000 then '$3000-5000' else '$5000+' end as band,
              sum(bottles)::bigint as bottles, sum(dollars)::double as dollars
       from (select *, dollars::double / bottles as e from v_sales where period_month = (select max(period_month) from v_sales) and bottles > 0) group by 1""",
)
def _(t):
    return r.price_bands(t.sales, steps=(1000, 2000, 3000, 5000))


@query(
    "hardest_drawings",
    """select drawing, item_code, bottles, entries, round(entries / nullif(bottles, 0), 1) as entries_per_bottle from v_draws
       order by 5 desc nulls last, 1, 2 limit 30""",
)
def _(t):
    return r.hardest_drawings(t.draws)


@query(
    "drawing_drop_mix",
    """with x as (select bottle_qty, product_name, unnest(['county', 'month', 'weekday', 'store']) as dimension,
                         unnest([county, strftime(drop_date, '%Y-%m'), dayofweek(drop_date)::varchar, city]) as value
                  from v_drops left join v_stores on id = store_id)
       select dimension, value, count(*) as drops, sum(bottle_qty)::bigint as bottles, count(distinct product_name) as products from x group by 1, 2""",
)
def _(t):
    return r.drop_mix(t.drops, t.stores)


def tables(t):
    return {
        "observations": (t.obs, "seen_at"),
        "changes": (t.changes, "created_at"),
        "orders": (t.table("orders"), "o_orderdate"),
        "lines": (t.table("lineitem"), "l_shipdate"),
        "page_views": (t.views, "created_at"),
        "actions": (t.actions, "created_at"),
        "store_checks": (t.store_obs, "seen_at"),
        "deliveries": (t.deliveries, "sent_at"),
        "watches": (t.watch, "created_at"),
        "runs": (t.runs, "started_at"),
        "sales": (t.sales, "period_month"),
    }


_MORE = (("page_views", "v_views", "created_at"), ("actions", "v_actions", "created_at"), ("store_checks", "v_store_obs", "seen_at"), ("deliveries", "v_deliveries", "sent_at"),
         ("watches", "v_watch", "created_at"), ("runs", "v_runs", "started_at"), ("sales", "v_sales", "period_month"))


@query(
    "table_growth",
    """select 'observations' as name, count(*) as rows, min(seen_at) as first, max(seen_at) as last from v_obs
       union all select 'changes', count(*), min(created_at), max(created_at) from v_changes
       union all select 'orders', count(*), min(o_orderdate), max(o_orderdate) from orders
       union all select 'lines', count(*), min(l_shipdate), max(l_shipdate) from lineitem"""
    + "".join(f" union all select '{n}', count(*), min({at}), max({at}) from {v}" for n, v, at in _MORE),
)
def _(t):
    return r.table_growth(tables(t))


@query(
    "rows_per_week",
    """select 'observations' as name, date_trunc('week', seen_at)::date::varchar as week, count(*) as rows from v_obs group by 2
       union all select 'changes', date_trunc('week', created_at)::date::varchar, count(*) from v_changes group by 2
       union all select 'orders', date_trunc('week', o_orderdate)::date::varchar, count(*) from orders group by 2
       union all select 'lines', date_trunc('week', l_shipdate)::date::varchar, count(*) from lineitem group by 2"""
    + "".join(f" union all select '{n}', date_trunc('week', {at})::date::varchar, count(*) from {v} group by 2" for n, v, at in _MORE),
)
def _(t):
    return r.rows_per_week(tables(t))
