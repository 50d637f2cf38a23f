"""Queries over delta history, as-of values and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import history as h
from .registry import define, query

define(
    "o_days",
    """select timezone('America/Denver', timezone('UTC', finished_at))::date as d, min(finished_at) as t_first,
              max(finished_at) as t_last
       from v_runs where ok group by 1""",
)
define(
    "o_intervals",
    """select csc, seen_at as t0, lead(seen_at) over (partition by csc order by seen_at) as t1, coalesce(store_qty, 0) > 0 as on_shelf
       from v_obs""",
)
define(
    "o_listed_intervals",
    """select i.* from o_intervals i join v_catalog c using (csc) where c.delisted_at is null""",
)
define(
    "o_grid",
    """select i.csc, y.d, bool_or(i.on_shelf) as in_stock
       from o_intervals i join o_days y on i.t0 <= y.t_last and (i.t1 is null or i.t1 > y.t_first)
       group by 1, 2""",
)
define(
    "o_listed_grid",
    """select i.csc, y.d, bool_or(i.on_shelf) as in_stock
       from o_listed_intervals i join o_days y on i.t0 <= y.t_last and (i.t1 is null or i.t1 > y.t_first)
       group by 1, 2""",
)
define(
    "o_gaps",
    """select * from (select started_at as gap_from, lead(started_at) over (order by started_at) as gap_to
                      from v_runs where ok)
       where gap_to - gap_from > interval 48 hour""",
)
define(
    "o_store_intervals",
    """select csc, store_id, t0, qty > 0 as pos,
              least(next_at, (select min(gap_from + interval 12 hour) from o_gaps
                              where gap_from + interval 12 hour >= s.t0)) as t1
       from (select csc, store_id, seen_at as t0, qty,
                    lead(seen_at) over (partition by csc, store_id order by seen_at) as next_at from v_store_obs) s""",
)
define(
    "o_transitions",
    """select csc, count(*) as observed_days, count(*) filter (where in_stock) as in_stock_days,
              count(*) filter (where in_stock and prev = false) as restocks,
              count(*) filter (where not in_stock and prev) as sellouts
       from (select *, lag(in_stock) over (partition by csc order by d) as prev from o_grid) group by csc""",
)
_PER_DAY = """
    select g.csc, g.d, count(distinct i.store_id) as stores
    from {grid} g join o_days y using (d)
    join (select csc, min(seen_at) as t from v_store_obs group by 1) f on f.csc = g.csc and f.t <= y.t_last
    left join o_store_intervals i on i.csc = g.csc and i.pos and i.t0 <= y.t_last
                                  and (i.t1 is null or i.t1 > y.t_first)
    where g.in_stock group by 1, 2"""
define("o_per_day", _PER_DAY.format(grid="o_grid"))
define("o_listed_per_day", _PER_DAY.format(grid="o_listed_grid"))


def _days(t):
    return t.days


def _grid(t):
    return h.day_grid(h.state_intervals(t.obs), _days(t), t.as_of)


def _start(t):
    return _days(t).agg(F.min("t_first")).scalar()


@query("observed_days", "select d::varchar as d, t_first, t_last from o_days")
def _(t):
    return _days(t).withColumn("d", times.text("d"))


@query("state_intervals", "select * from o_intervals")
def _(t):
    return h.state_intervals(t.obs)


@query("day_grid", "select csc, d::varchar as d, in_stock from o_grid")
def _(t):
    return _grid(t).withColumn("d", times.text("d"))


@query("outage_capped_intervals", "select csc, store_id, t0, t1, pos from o_store_intervals")
def _(t):
    return h.outage_capped_intervals(t.store_obs, t.runs)


@query("stores_per_day", "select csc, d::varchar as d, stores from o_per_day")
def _(t):
    days = _days(t)
    per = h.stores_per_day(_grid(t), h.outage_capped_intervals(t.store_obs, t.runs), days, t.store_obs, t.as_of)
    return per.withColumn("d", times.text("d"))


@query(
    "coverage_gaps",
    """select count(*) as observed, min(d)::varchar as first, max(d)::varchar as last,
              (max(d) - min(d) + 1)::bigint as span,
              string_agg(d::varchar || ':' || missing, ' ' order by d) filter (where missing > 0) as gaps,
              bool_or(month(d) in (11, 12)) as holiday_observed
       from (select d, lead(d) over (order by d) - d - 1 as missing from o_days)""",
)
def _(t):
    return h.coverage_gaps(_days(t))


@query("transitions", "select * from o_transitions")
def _(t):
    return h.transitions(_grid(t))


define(
    "o_peak",
    """select csc, greatest(max(store_qty) filter (where seen_at >= s), arg_max(store_qty, seen_at) filter (where seen_at < s)) as peak_shelf
       from v_obs, (select min(t_first) as s from o_days) group by csc""",
)
define(
    "o_last_on",
    """select csc, max(coalesce(next_at, (select t from clock))) as last_on_shelf
       from (select *, lead(seen_at) over (partition by csc order by seen_at) as next_at from v_obs)
       where store_qty > 0 group by csc""",
)
define(
    "o_stores_seen",
    """select csc, count(distinct store_id) as stores_seen from (
         select csc, store_id from v_store_obs where qty > 0 and seen_at >= (select min(t_first) from o_days)
         union select csc, store_id from v_store_now where qty > 0) group by csc""",
)
define(
    "o_stores_now",
    """select csc, count(*) filter (where qty > 0 and seen_at > (select t from clock) - interval 7 day) as stores_now
       from v_store_now group by csc""",
)
_PCT = """select csc, count(*) as store_days, quantile_cont(stores, 0.5) as typical_stores,
                 quantile_disc(stores, 0.1) as stores_low, quantile_disc(stores, 0.9) as stores_high
          from {per_day} group by csc"""
define("o_listed_pct", _PCT.format(per_day="o_listed_per_day"))
define(
    "o_stock_metrics",
    """select p.csc, p.name, p.category, p.status, p.first_seen,
              coalesce(a.observed_days, 0) as observed_days, coalesce(a.in_stock_days, 0) as in_stock_days,
              coalesce(a.restocks, 0) as restocks, coalesce(a.sellouts, 0) as sellouts,
              coalesce(ss.stores_seen, 0) as stores_seen, sn.csc is not null as has_store_data,
              coalesce(sn.stores_now, 0) as stores_now, coalesce(sd.store_days, 0) as store_days,
              sd.typical_stores, sd.stores_low, sd.stores_high, k.peak_shelf,
              coalesce(p.store_qty, 0) > 0 as in_stock_now, lo.last_on_shelf
       from v_catalog p
       left join (select csc, count(*) as observed_days, count(*) filter (where in_stock) as in_stock_days,
                         count(*) filter (where in_stock and prev = false) as restocks,
                         count(*) filter (where not in_stock and prev) as sellouts
                  from (select *, lag(in_stock) over (partition by csc order by d) as prev from o_listed_grid)
                  group by csc) a using (csc)
       left join o_peak k using (csc) left join o_last_on lo using (csc) left join o_stores_seen ss using (csc)
       left join o_stores_now sn using (csc) left join o_listed_pct sd using (csc)
       where p.delisted_at is null""",
)


@query("peak_with_carry_in", "select * from o_peak")
def _(t):
    return h.peak_with_carry_in(t.obs, _start(t))


@query("last_on_shelf", "select * from o_last_on")
def _(t):
    return h.last_on_shelf(t.obs, t.as_of)


@query("stores_seen", "select * from o_stores_seen")
def _(t):
    return h.stores_seen(t.store_obs, t.store_now, _start(t))


@query("stores_now", "select * from o_stores_now")
def _(t):
    return h.stores_now(t.store_now, t.as_of)


@query("presence_percentiles", _PCT.format(per_day="o_per_day"))
def _(t):
    days = _days(t)
    per = h.stores_per_day(_grid(t), h.outage_capped_intervals(t.store_obs, t.runs), days, t.store_obs, t.as_of)
    return h.presence_percentiles(per)


def stock(t):
    return h.stock_metrics(t.catalog, t.obs, t.store_obs, t.store_now, t.runs, t.as_of)


@query("stock_metrics", "select * from o_stock_metrics")
def _(t):
    return stock(t)


@query(
    "unbroken_since",
    """select max(started_at) as since
       from (select started_at, lag(started_at) over (order by started_at) as prev from v_runs where ok)
       where prev is null or started_at - prev > interval 48 hour""",
)
def _(t):
    return h.unbroken_since(t.runs)


define(
    "o_returns",
    """with z as (select csc, max(seen_at) as z_last from v_obs where coalesce(store_qty, 0) = 0 group by csc),
       st as (select z.csc, min(o.seen_at) filter (where o.seen_at > z_last and o.store_qty > 0) as back_at,
                     max(o.seen_at) filter (where o.seen_at < z_last and o.store_qty > 0) as prev_in
              from z join v_obs o using (csc) group by z.csc),
       ret as (select st.csc, st.back_at, min(o.seen_at) as out_since
               from st join v_obs o on o.csc = st.csc and o.seen_at > st.prev_in and coalesce(o.store_qty, 0) = 0
               where st.back_at > (select t from clock) - interval 14 day group by 1, 2)
       select csc, out_since, back_at from ret
       where epoch_us(back_at) - epoch_us(out_since) >= 6 * 3600 * 1000000::bigint
         and not exists (select 1 from o_gaps g where g.gap_to > ret.out_since and g.gap_from < ret.back_at)
         and exists (select 1 from v_runs r where r.ok and r.started_at < ret.out_since
                                              and r.started_at > ret.out_since - interval 48 hour)""",
)


def returns(t):
    # The test events span one month, so the registered absence is hours long.
    return h.returned_after_absence(t.obs, t.runs, t.as_of, absence_hours=6)


@query("returned_after_absence", "select * from o_returns")
def _(t):
    return returns(t)


@query(
    "price_last_change",
    """select csc, arg_max(price, seen_at) as price, arg_max(prev, seen_at) filter (where prev <> price) as previous,
              max(seen_at) filter (where prev <> price) as changed_at,
              case when max(seen_at) filter (where prev <> price) is null then 'same'
                   when arg_max(prev, seen_at) filter (where prev <> price) > arg_max(price, seen_at) then 'down' else 'up' end as direction
       from (select *, lag(price) over (partition by csc order by seen_at) as prev from v_obs) group by csc""",
)
def _(t):
    return h.price_last_change(t.obs)


@query(
    "asof_value",
    """with p as (select csc, unnest(generate_series(timestamp '2024-01-01 12:00:00', timestamp '2024-01-30 12:00:00',
                                                     interval 1 day)) as seen_at from (select distinct csc from v_obs))
       select p.csc, p.seen_at, o.store_qty from p asof left join v_obs o on p.csc = o.csc and o.seen_at <= p.seen_at""",
)
def _(t):
    probes = t.obs.select("csc").distinct().select(
        "csc",
        F.explode(
            F.expr("sequence(timestamp_ntz'2024-01-01 12:00:00', timestamp_ntz'2024-01-30 12:00:00', interval 1 day)")
        ).alias("seen_at"),
    )
    return h.asof_value(t.obs, probes)


define(
    "o_next_sellout",
    """select r.csc, r.event_id, r.created_at,
              (select min(x.created_at) from v_changes x where x.csc = r.csc and x.event_type = 'out_of_stock'
                                                           and x.created_at > r.created_at) as then_at
       from v_changes r where r.event_type = 'restock'""",
)


@query(
    "next_event_duration",
    """select status, count(*) as restocks, count(then_at) as sold_out_again,
              round(quantile_cont((epoch_us(then_at) - epoch_us(created_at)) / 1e6 / 3600, 0.5), 4) as median_hours,
              round(quantile_cont((epoch_us(then_at) - epoch_us(created_at)) / 1e6 / 3600, 0.25), 4) as p25_hours
       from o_next_sellout join v_products using (csc) group by status""",
)
def _(t):
    return h.next_event_duration(h.next_event(t.changes), t.products)


@query(
    "fastest_sellouts",
    """select csc, name, status, event_id, round((epoch_us(then_at) - epoch_us(created_at)) / 1e6 / 3600, 4) as hours
       from o_next_sellout join v_products using (csc) where then_at is not null
       order by (epoch_us(then_at) - epoch_us(created_at)), event_id limit 20""",
)
def _(t):
    return h.fastest_sellouts(h.next_event(t.changes), t.products)


define(
    "o_rechecks",
    """select *, lag(seen_at) over w as prev_at, lag(qty) over w as prev_qty from v_store_obs
       window w as (partition by csc, store_id order by seen_at)""",
)


@query(
    "recheck_decay",
    """select case when age < 6 then 'a <6h' when age < 12 then 'b 6-12h' when age < 24 then 'c 12-24h'
                   when age < 48 then 'd 24-48h' when age < 72 then 'e 48-72h' else 'f 72h+' end as prev_check_age,
              case when prev_qty >= 30 then '30+' when prev_qty >= 10 then '10-29' else '1-9' end as size,
              count(*) as rechecks, round(100.0 * count(*) filter (where qty <> prev_qty) / count(*), 1)::double as pct_changed,
              round(sum(abs(qty - prev_qty)) / count(*), 2) as avg_change
       from (select *, (epoch_us(seen_at) - epoch_us(prev_at)) / 1e6 / 3600 as age from o_rechecks) where prev_qty > 0
       group by 1, 2""",
)
def _(t):
    return h.recheck_decay(t.store_obs, sizes=(10, 30))


define(
    "v_counted_runs",
    """select *, 40 + second(started_at) as attempted, 40 + second(started_at) - minute(started_at) % 4 as checked, minute(started_at) % 4 as failed from v_runs""",
)
define(
    "o_run_rows",
    """select *, (epoch_us(started_at) - epoch_us(lag(started_at) over (order by started_at))) / 1e6 / 3600 as gap_hours,
              (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 / 60 as minutes, finished_at is null and started_at < (select t from clock) - interval 45 minute as killed
       from v_counted_runs""",
)


def counted_runs(t):
    tried, failed = F.second("started_at") + 40, F.minute("started_at") % 4
    return t.runs.withColumns({"attempted": tried, "checked": tried - failed, "failed": failed})


@query("run_rows", "select started_at, ok, killed, minutes, round(gap_hours, 6) as gap_hours, attempted::int as attempted, checked::int as checked, failed::int as failed from o_run_rows")
def _(t):
    return h.run_rows(counted_runs(t), t.as_of).withColumn("gap_hours", F.round("gap_hours", 6))


@query(
    "run_gap_stats",
    """select count(*) as runs, count(*) filter (where ok) as ok, count(*) filter (where not ok) as failed, count(*) filter (where killed) as killed,
              round(max(gap_hours), 4) as gap_hours_max, round(sum(minutes), 2) as minutes,
              round(count(*) / ((epoch_us(max(started_at)) - epoch_us(min(started_at))) / 1e6 / 3600 / 24), 4) as runs_per_day,
              round(quantile_cont(gap_hours, 0.5), 4) as gap_hours_median,
              round(sum(minutes) filter (where ok) * 60 / sum(attempted) filter (where ok), 4) as seconds_per_item,
              round(sum(o_run_rows.failed) filter (where ok) / sum(attempted) filter (where ok), 4) as failure_rate,
              round(sum(checked) filter (where ok) / ((epoch_us(max(started_at)) - epoch_us(min(started_at))) / 1e6 / 3600 / 24), 4) as checks_per_day
       from o_run_rows""",
)
def _(t):
    return h.run_gap_stats(counted_runs(t), t.as_of)


@query(
    "event_to_action_lag",
    """select event_type, count(*) as n,
              round(quantile_cont((epoch_us(sent_at) - epoch_us(created_at)) / 1e6 / 60, 0.5), 4) as median_min,
              round(quantile_cont((epoch_us(sent_at) - epoch_us(created_at)) / 1e6 / 60, 0.9), 4) as p90_min
       from v_deliveries join v_changes using (event_id) group by event_type""",
)
def _(t):
    return h.event_to_action_lag(t.changes, t.deliveries)


@query(
    "last_n_history_per_event",
    """with s as (select event_type, event_id, csc from v_changes
                  qualify row_number() over (partition by event_type order by md5(event_id::varchar), event_id) <= 4),
       r as (select csc, string_agg(store_qty::varchar, ',' order by seen_at desc) as last_counts
             from (select * from v_obs qualify row_number() over (partition by csc order by seen_at desc) <= 4) group by csc)
       select * from s join r using (csc)""",
)
def _(t):
    return h.last_n_history_per_event(t.changes, t.obs)
