"""Streaming queries, run over the events table and held against batch SQL.

Streams in append mode emit a window once the watermark has passed it, so the
SQL leaves out windows still open at the end of the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import live as s, ordered
from .registry import define, query
from .standins import AGENTS


def events(t):
    return s.read_events(t.spark, t.folder)


def _naive(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


define("o_slides", "select ts, user_id, event_type, unnest(generate_series(1, 10)) as i from events")


@query(
    "stream_live_visitors",
    """select date_trunc('minute', ts) + to_minutes(i::int) as until, count(distinct user_id) as visitors, count(*) as views from o_slides where i <= 5
       group by 1 having until <= (select t from clock) - interval 10 minute""",
)
def _(t):
    return _naive(s.drain(s.live_visitors(events(t))), "until")


@query(
    "stream_sessions",
    """with f as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minute, true)::int as n from events),
       g as (select *, sum(n) over (partition by user_id order by ts) as sid from f)
       select user_id, min(ts) as started_at, max(ts) + interval 30 minute as closes_at, count(*) as views, arg_min(event_type, ts) as landing from g group by user_id, sid
       having closes_at <= (select t from clock) - interval 1 hour""",
)
def _(t):
    return _naive(s.drain(s.sessions(events(t))), "started_at", "closes_at")


def _obs(e):
    return e.select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("csc"),
        F.col("ts").alias("seen_at"),
        F.col("event_id").alias("seq"),
        (F.col("k") % 25).alias("store_id"),
        F.expr("if(event_type = 'error', 0, cast(floor(value) as int))").alias("store_qty"),
        F.expr("cast(20 + 5 * (k div 25) as double)").alias("price"),
    )


@query(
    "stream_change_events",
    """select c.* from v_changes c join (select seq, seen_at - lag(seen_at) over (partition by csc order by seen_at) as g from v_obs) o on o.seq = c.event_id // 8
       where g is null or g <= interval 48 hour""",
)
def _(t):
    return ordered.change_events(_obs(events(t)).drop("store_id"), ended=True)


@query("stream_gap_suppression", "select event_id, csc, store_id, qty, created_at from v_store_restocks")
def _(t):
    obs = _obs(events(t)).select("csc", "store_id", "seen_at", "seq", F.col("store_qty").alias("qty"))
    return ordered.store_restocks(obs, ended=True)


@query("stream_delivery_dedupe", "select distinct user_id, event_id from events")
def _(t):
    """Delivered from a stream, and once more from a second run over the same files."""
    pairs = events(t).select("user_id", "event_id", "ts")
    again = events(t).select("user_id", "event_id", "ts")
    run = uuid.uuid4().hex
    ledger = f"{shared_folder(t.spark)}/ledger-{run}"
    s.deliver(s.delivery_dedupe(pairs.unionByName(again)), ledger, f"{run}-first")
    s.deliver(pairs, ledger, f"{run}-second")
    return s.read_ledger(t.spark, ledger).select("user_id", "event_id")


@query(
    "stream_superseded_filter",
    """select event_id, user_id as key from events r where event_type = 'signup' and ts < (select least(max(ts) filter (where event_type = 'signup'), max(ts) filter (where event_type = 'error')) from events) - interval 7 hour
         and not exists (select 1 from events o where o.event_type = 'error' and o.user_id = r.user_id and o.ts > r.ts and o.ts <= r.ts + interval 6 hour)""",
)
def _(t):
    e = events(t).withColumn("key", F.col("user_id"))
    o = events(t).withColumn("key", F.col("user_id"))
    out = s.drain(s.standing_restocks(e.where("event_type = 'signup'"), o.where("event_type = 'error'")))
    return out.select("event_id", "key")


@query(
    "stream_fixed_window_limits",
    """select user_id, date_trunc('hour', ts) as window_start, count(*) as n from events group by 1, 2
       having count(*) > 2 and window_start + interval 1 hour <= (select t from clock) - interval 2 hour""",
)
def _(t):
    return _naive(s.drain(s.fixed_window_limits(events(t), limit=2)), "window_start")


@query(
    "stream_circuit_breaker",
    """select date_trunc('minute', ts) + to_minutes(i::int) as until, count(*) as failures from o_slides where event_type = 'error' group by 1
       having count(*) >= 3 and until <= (select max(ts) from events where event_type = 'error') - interval 10 minute""",
)
def _(t):
    return _naive(s.drain(s.circuit_breaker(events(t), failures=3)), "until")


@query(
    "stream_zero_buckets",
    """with c as (select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by 1, 2 having hour + interval 1 hour <= (select t from clock) - interval 1 hour),
       g as (select unnest(generate_series((select min(hour) from c), (select max(hour) from c), interval 1 hour)) as hour)
       select g.hour, k.event_type, coalesce(c.n, 0) as n from g, (select unnest(['view', 'click', 'purchase', 'signup', 'error']) as event_type) k
       left join c on c.hour = g.hour and c.event_type = k.event_type""",
)
def _(t):
    counts = s.drain(s.hourly_counts(events(t)))
    return _naive(s.zero_filled(counts, ["view", "click", "purchase", "signup", "error"]), "hour")


@query(
    "stream_enrich",
    """select e.event_id, e.ts, lpad(e.k::varchar, 6, '0') as csc, p.name, p.category, a.surface, a.view,
              case e.user_id % 8 when 0 then 'mobile' when 3 then 'mobile' when 4 then 'tablet' else 'desktop' end as device
       from v_events e join v_actions a using (event_id) left join v_products p on p.csc = lpad(e.k::varchar, 6, '0') where e.user_id % 8 <> 7""",
)
def _(t):
    k, u = F.col("k"), F.col("user_id")
    view3 = F.when(u % 3 == 0, "scarce").when(u % 3 == 1, "back").otherwise("price")
    token = F.when(k % 4 == 0, F.concat(F.lit("search:"), F.when(u % 3 == 0, "exact").when(u % 3 == 1, "rough").otherwise("browse"))).when(
        k % 4 == 3, "taste:typed"
    ).otherwise(F.concat(F.when(k % 4 == 1, "discover:").otherwise("home:"), view3))
    views = events(t).select(
        "event_id", "ts", "user_id", F.lpad(k.cast("string"), 6, "0").alias("csc"),
        F.get(F.array(*[F.lit(a) for a in AGENTS]), (u % 8).cast("int")).alias("agent"), token.alias("token"),
    )
    return _naive(s.drain(s.enrich(views, t.products)), "ts")
