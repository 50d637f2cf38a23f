"""Queries over discovery views, feeds and demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feeds as f
from . import q_geo, q_history
from .registry import define, query

AREA = "NATION_3"

define(
    "o_eligible",
    """select * from v_catalog where in_stock and store_qty > 0 and current_price is not null
         and last_seen > (select t from clock) - interval 24 hour and delisted_at is null and coalesce(status, '') not in ('S', 'N')
         and not exists (select 1 from v_draws_live d where d.item_code = csc)""",
)
define(
    "o_reused",
    """select item_code as csc from v_sales_live group by 1
       having count(distinct regexp_replace(upper(item_name), '[^A-Z0-9]', '', 'g')) > 1""",
)


def eligible(t):
    return f.eligible_now(t.catalog, t.draws_live, t.as_of)


@query("eligible_now", "select csc, name, current_price, store_qty, last_seen from o_eligible")
def _(t):
    return eligible(t).select("csc", "name", "current_price", "store_qty", "last_seen")


@query("reused_code_antijoin", "select csc from o_eligible where csc not in (select csc from o_reused)")
def _(t):
    return f.without_reused(eligible(t), t.sales_live).select("csc")


define("o_here", "select * from o_nearby_day where area = 'NATION_3'")
define("o_view_scarce", "select e.*, r.shown_tier as tier from o_eligible e join o_resolved r using (csc) where r.shown_tier in ('unicorn', 'rare', 'scarce')")
define("o_view_back", "select e.*, b.out_since, b.back_at from o_eligible e join o_returns b using (csc) where csc not in (select csc from o_reused)")
define(
    "o_view_price",
    """with m as (select csc, event_id, created_at, old::double as old_price, "new"::double as new_price,
                         lag(created_at) over (partition by csc order by created_at, event_id) as prev_change
                  from v_changes where event_type = 'price_change'
                  qualify row_number() over (partition by csc order by created_at desc, event_id desc) = 1)
       select e.*, m.old_price, m.created_at as drop_at from m join o_eligible e using (csc)
       where m.created_at > (select t from clock) - interval 30 day and new_price = current_price and old_price - new_price >= 3
         and old_price - new_price >= old_price * 0.1 and (prev_change is null or prev_change <= m.created_at - interval 4 hour)
         and csc not in (select csc from o_reused)""",
)


def here(t, items):
    return f.with_near(items, q_geo.nearby(t, 24), AREA).join(
        q_geo.checks(t).withColumnRenamed("checked_at", "store_checked_at"), "csc", "left"
    )


def scarce(t):
    return here(t, f.view_scarce(eligible(t), t.resolved))


def back(t):
    return here(t, f.view_back(eligible(t), q_history.returns(t), t.sales_live))


def price(t):
    # Test prices change daily, so the registered hold time is hours.
    return here(t, f.view_price_drops(eligible(t), t.changes, t.sales_live, t.as_of, held_hours=4))


@query("view_scarce", "select v.csc, v.name, v.tier, h.stores as near_stores, h.units as near_units from o_view_scarce v left join o_here h using (csc)")
def _(t):
    return scarce(t).select("csc", "name", "tier", "near_stores", "near_units")


@query("view_back", "select v.csc, v.out_since, v.back_at, h.stores as near_stores from o_view_back v left join o_here h using (csc)")
def _(t):
    return back(t).select("csc", "out_since", "back_at", "near_stores")


@query("view_price_drops", "select v.csc, v.old_price, v.current_price, v.drop_at, h.stores as near_stores from o_view_price v left join o_here h using (csc)")
def _(t):
    return price(t).select("csc", "old_price", "current_price", "drop_at", "near_stores")


define(
    "o_view_rank",
    """with a as (select 'scarce' as view, csc, last_seen, current_price, tier, null::timestamp as out_since, null::timestamp as back_at,
                         null::double as old_price, null::timestamp as drop_at from o_view_scarce
                  union all select 'back', csc, last_seen, current_price, null, out_since, back_at, null, null from o_view_back
                  union all select 'price', csc, last_seen, current_price, null, null, null, old_price, drop_at from o_view_price),
       b as (select a.*, k.checked_at as store_checked_at,
                    coalesce(h.stores > 0 and h.checked_at >= (select t from clock) - interval 24 hour, false) as near
             from a left join o_here h using (csc) left join o_checks k using (csc))
       select view, csc, near, row_number() over (partition by view order by near desc,
                case tier when 'unicorn' then 0 when 'rare' then 1 when 'scarce' then 2 else 9 end,
                back_at desc nulls last, out_since nulls last, (old_price - current_price) / old_price desc nulls last, drop_at desc nulls last,
                store_checked_at desc nulls last, last_seen desc nulls last, csc)::int as place
       from b""",
)


def ranked(t):
    return f.rank_view(f.candidates(scarce(t), back(t), price(t)), t.as_of, has_area=True)


@query("rank_view", "select * from o_view_rank where place <= 60")
def _(t):
    return ranked(t).select("view", "csc", "near", "place")


def _picks(size: int) -> str:
    """The preview as SQL: a block for each pick, which sees those before it."""
    rows = """rows_ as (
        select 0 as pass, view, place, csc from o_view_rank where near and place <= 60
        union all select 1, view, place, csc from o_view_rank where place <= 60)"""
    blocks = [rows, "p0 as (select 0 as n, 0 as pass, '' as view, '' as csc where false)"]
    for k in range(1, size + 1):
        blocks.append(f"""p{k} as (
            select * from p{k - 1} union all (
            select {k}, pass, view, csc from rows_ r where csc not in (select csc from p{k - 1})
            order by pass, (select count(*) from p{k - 1} p where p.pass = r.pass and p.view = r.view),
                     list_position(['scarce', 'back', 'price'], view), place limit 1))""")
    return f"with {', '.join(blocks)} select n::int as place, view, csc from p{size}"


@query("mix_preview", _picks(3))
def _(t):
    return f.mix_preview(ranked(t))


@query(
    "change_feed",
    """select e.event_id, e.csc, e.event_type, e.created_at, c.name from v_changes e left join v_catalog c using (csc)
       where coalesce(c.status, '') not in ('S', 'N') order by e.created_at desc, e.event_id desc limit 100""",
)
def _(t):
    return f.change_feed(t.changes, t.catalog).select("event_id", "csc", "event_type", "created_at", "name")


_NEWS = """
    select e.*, c.name, c.status, c.current_price, c.in_stock from v_changes e join v_catalog c using (csc)
    where c.delisted_at is null and c.status not in ('S', 'N', 'X') and c.current_price >= 20 and c.size_ml >= 375
      and not regexp_matches(lower(c.name), '\\b\\d+ ?pk\\b|variety|\\brtd\\b|\\bcans?\\b|seltzer')"""
define("o_news", _NEWS)
define(
    "o_home",
    """select * from o_news where event_type in ('restock', 'new_product', 'price_change')
         and (event_type <> 'price_change' or "new"::double <= old::double * 0.95) and (event_type <> 'restock' or in_stock)""",
)


@query(
    "home_feed",
    """with w as (select case when count(distinct csc) < 4 then 30 else 7 end as d from o_home where created_at > (select t from clock) - interval 7 day)
       select event_id, csc, event_type, created_at, name from (
         select * from o_home where created_at > (select t from clock) - to_days((select d from w)::int)
         qualify row_number() over (partition by csc order by created_at desc, event_id desc) = 1)
       order by created_at desc, event_id desc limit 12""",
)
def _(t):
    return f.home_feed(t.changes, t.catalog, t.as_of).select("event_id", "csc", "event_type", "created_at", "name")


@query(
    "week_sections",
    """with n as (select o.*, coalesce(case r.tier when 'unicorn' then 5 when 'rare' then 4 when 'scarce' then 3 when 'uncommon' then 2 when 'everyday' then 1 end, 0) as tier_rank,
                         coalesce(w.n, 0) as watchers
                  from o_news o left join o_rated r on r.csc = o.csc and r.published left join (select csc, count(*) as n from v_watch group by 1) w on w.csc = o.csc
                  where o.created_at > (select t from clock) - interval 7 day),
       s as (select *, case when event_type = 'restock' and in_stock then 'restock' when event_type = 'new_product' then 'new_product'
                            when event_type = 'price_change' and "new"::double <= old::double * 0.95 then 'price_drop'
                            when event_type = 'out_of_stock' and not in_stock and (tier_rank >= 3 or status in ('A', 'L')) then 'sold_out' end as section from n),
       l as (select * from s where section is not null qualify row_number() over (partition by section, csc order by created_at desc, event_id desc) = 1)
       select section, row_number() over (partition by section order by tier_rank desc, watchers desc, current_price desc nulls last, created_at desc, event_id)::int as place,
              csc, event_id, tier_rank::int as tier_rank, watchers, count(*) over (partition by section) as total
       from l qualify place <= 10""",
)
def _(t):
    return f.week_sections(t.changes, t.catalog, t.resolved, t.watch, t.as_of)


@query(
    "drops_listing",
    """select drop_date::varchar as drop_date, product_name, count(*) as stores, sum(bottle_qty)::bigint as bottles,
              string_agg(city, ', ' order by bottle_qty desc, city) as cities
       from v_drops left join v_stores on id = store_id group by 1, 2""",
)
def _(t):
    return f.drops_listing(t.drops, t.stores)


@query(
    "drop_sizes",
    "select drop_date::varchar as drop_date, count(distinct product_name) as products, count(*) as rows, count(store_id) as matched from v_drops group by 1",
)
def _(t):
    return f.drop_sizes(t.drops)


@query(
    "exclusion_reasons",
    """with r as (select c.csc, c.name, case when c.csc in (select item_code from v_draws_live) then 'released by drawing' when c.delisted_at is not null then 'delisted'
                    when c.status in ('S', 'N') then 'special order / unavailable' when c.last_seen <= (select t from clock) - interval 24 hour then 'statewide data stale'
                    when c.current_price is null then 'no price' else 'shown' end as outcome
                  from v_catalog c join o_resolved o using (csc) where c.in_stock and c.store_qty > 0 and o.shown_tier in ('unicorn', 'rare', 'scarce'))
       select outcome, count(*) as products, (select string_agg(csc || ' ' || name, '; ' order by csc)
                from (select x.csc, x.name from r x where x.outcome = r.outcome order by csc limit 5)) as examples from r group by outcome""",
)
def _(t):
    return f.exclusion_reasons(t.catalog, t.resolved, t.draws_live, t.as_of)


@query(
    "price_drop_outcomes",
    """with l as (select csc, created_at, old::double as was, "new"::double as now from v_changes where event_type = 'price_change'
                  qualify row_number() over (partition by csc order by created_at desc, event_id desc) = 1)
       select case when now >= was then 'increase' when was - now < 3 or was - now < was * 0.1 then 'drop below threshold'
                   when now <> current_price then 'current price differs' when not in_stock then 'not in stock' else 'other' end as outcome, count(*) as products
       from l join v_catalog using (csc) where created_at > (select t from clock) - interval 30 day group by 1""",
)
def _(t):
    return f.price_drop_outcomes(t.changes, t.catalog, t.as_of)


@query(
    "last_real_change",
    """select csc, coalesce(m, first_seen) as changed_at from v_catalog left join (select csc, max(created_at) as m from v_changes group by 1) using (csc)
       where delisted_at is null""",
)
def _(t):
    return f.last_real_change(t.catalog, t.changes)


define("o_special", "select csc from o_rated where published and tier in ('rare', 'unicorn') union select csc from v_overrides where tier in ('rare', 'unicorn')")
define(
    "o_demand",
    """with r as (select c.csc, c.name, coalesce(v.n, 0) as views, coalesce(w.n, 0) as watches, coalesce(s.b, 0) as sold, coalesce(s.d, 0)::double as dollars,
                         sp.csc is not null as special
                  from v_catalog c
                  left join (select csc, count(distinct visitor_id) as n from v_pages where csc is not null and created_at > (select t from clock) - interval 30 day group by 1) v using (csc)
                  left join (select csc, count(*) as n from v_watch group by 1) w using (csc)
                  left join (select item_code as csc, sum(bottles)::bigint as b, sum(dollars) as d from v_sales_live
                             where period_month >= (select max(period_month) from v_sales_live) - interval 2 month group by 1) s using (csc)
                  left join o_special sp using (csc) where c.delisted_at is null and c.size_ml < 19000),
       i as (select *, watches > 0 or views >= 2 or special as interest from r)
       select *, row_number() over (order by interest desc, case when interest then watches end desc nulls last,
                case when interest then views end desc nulls last, dollars desc, views desc, csc)::int as place
       from i qualify place <= 300""",
)


def demand(t):
    special = t.resolved.where("(published and tier in ('rare', 'unicorn'))").select("csc").unionByName(
        t.overrides.where("tier in ('rare', 'unicorn')").select("csc")
    )
    return f.demand_ranking(t.catalog, t.pages, t.watch, t.sales_live, special, t.as_of)


@query("demand_ranking", "select * from o_demand")
def _(t):
    return demand(t)


@query(
    "topn_coverage",
    """select n as top, sum(views)::bigint as visitors, round(sum(views) / (select count(distinct (visitor_id, csc)) from v_pages
                where csc is not null and created_at > (select t from clock) - interval 30 day), 6) as share
       from o_demand, (values (25), (50), (100), (200), (300)) x(n) where place <= n group by 1""",
)
def _(t):
    return f.topn_coverage(demand(t), t.pages, t.as_of)


define(
    "o_surfaces",
    """select 'discover:scarce' as surface, csc from o_view_scarce union select 'discover:back', csc from o_view_back
       union select 'discover:price', csc from o_view_price union select 'home', csc from o_home
       union select 'new', csc from (select csc from v_changes order by created_at desc, event_id desc limit 100)""",
)
define("o_assets", "select csc from v_products where size_ml % 100 = 0")


def surfaces(t):
    parts = [
        scarce(t).select(F.lit("discover:scarce").alias("surface"), "csc"),
        back(t).select(F.lit("discover:back").alias("surface"), "csc"),
        price(t).select(F.lit("discover:price").alias("surface"), "csc"),
        f._newsworthy(t.changes, t.catalog)
        .where("event_type in ('restock', 'new_product', 'price_change')")
        .where("event_type <> 'price_change' or cast(new as double) <= cast(old as double) * 0.95")
        .where("event_type <> 'restock' or in_stock")
        .select(F.lit("home").alias("surface"), "csc"),
        f.change_feed(t.changes, t.catalog, include_special=True).select(F.lit("new").alias("surface"), "csc"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "surface_coverage",
    "select surface, count(*) as products, count(a.csc) as with_asset from o_surfaces left join o_assets a using (csc) group by 1",
)
def _(t):
    return f.surface_coverage(surfaces(t), t.products.where("size_ml % 100 = 0"))


@query(
    "missing_assets",
    """select s.csc, c.in_stock, string_agg(surface, ',' order by surface) as surfaces,
              max(case when surface like 'discover%' then 10 else 0 end) + count(*) as score
       from o_surfaces s join v_catalog c using (csc) where c.delisted_at is null and csc not in (select csc from o_assets) group by 1, 2""",
)
def _(t):
    return f.missing_assets(surfaces(t), t.products.where("size_ml % 100 = 0"), t.catalog)
