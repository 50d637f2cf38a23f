"""Queries over sales, drawings, drops and the availability rating."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import times
from ..operators import sales as s
from ..session import checkpointed
from . import q_history
from .registry import define, query

# The test events span a month, so the registered rating asks for fewer days.
TH = s.Thresholds(min_observed_days=20, high_observed_days=26)

define(
    "o_sales_months",
    """select item_code, period_month, coalesce(sum(bottles), 0)::bigint as bottles, count(*) as lines, max(class_name) as class_name,
              arg_min(status, line) as status, arg_max(item_name, line) as item_name
       from v_sales_live group by 1, 2""",
)
define(
    "o_month_grid",
    """with c as (select item_code, min(period_month) as first_record from o_sales_months group by 1),
       m as (select period_month, row_number() over (order by period_month) - 1 as i, count(*) over () as n
             from (select distinct period_month from v_sales_live))
       select c.item_code, c.first_record, m.period_month, m.i, m.n, s.bottles, m.period_month >= c.first_record as known
       from c, m left join o_sales_months s on s.item_code = c.item_code and s.period_month = m.period_month""",
)
define(
    "o_history",
    """select h.item_code, count(*) as months, min(period_month) as first_month, sum(h.bottles)::bigint as bottles, sum(h.lines)::bigint as lines,
              arg_max(class_name, period_month) as class_name, arg_max(status, period_month) as status,
              arg_max(item_name, period_month) as item_name, any_value(n.names) as names
       from o_sales_months h
       join (select item_code, count(distinct regexp_replace(upper(item_name), '[^A-Z0-9]', '', 'g')) as names
             from v_sales_live group by 1) n using (item_code) group by 1""",
)
define(
    "o_trailing",
    """select item_code, min(first_record) as first_record, max(period_month) filter (where known and bottles > 0) as last_sold,
              count(*) filter (where r) as record_months12, count(*) filter (where r and bottles > 0) as sold_months12,
              count(*) filter (where r and bottles is null) as not_in_report12, count(*) filter (where r and bottles <= 0) as explicit_zero12,
              coalesce(sum(bottles) filter (where r and bottles > 0), 0)::bigint as bottles12,
              round(count(*) filter (where r and bottles > 0) / nullif(count(*) filter (where r), 0), 6) as sold_share12,
              round(list_sum(list_sort(list(bottles) filter (where r and bottles > 0), 'DESC')[1:2])
                    / nullif(sum(bottles) filter (where r and bottles > 0), 0), 6)::double as top2_share12
       from (select *, known and i >= n - 12 as r from o_month_grid) group by 1""",
)


@query("sales_history", "select * replace (first_month::varchar as first_month) from o_history")
def _(t):
    return s.sales_history(t.sales_live).withColumn("first_month", times.text("first_month"))


@query(
    "sales_trailing12",
    "select * replace (first_record::varchar as first_record, last_sold::varchar as last_sold) from o_trailing",
)
def _(t):
    rows = s.sales_trailing12(t.sales_live)
    return rows.withColumn("first_record", times.text("first_record")).withColumn("last_sold", times.text("last_sold"))


@query(
    "selling_runs",
    """with w as (select *, i - lag(i) over (partition by item_code order by i) - 1 as gap from o_month_grid where known and bottles > 0),
       r as (select *, sum(case when gap is null or gap >= 2 then 1 else 0 end) over (partition by item_code order by i) as run from w),
       g as (select item_code, run, sum(bottles) as b from r group by 1, 2),
       a as (select item_code, sum(b) as t from g group by 1)
       select item_code, max(t)::bigint as bottles_all, count(*) filter (where b >= greatest(6, t * 0.1)) as runs, max(b)::bigint as largest_run
       from g join a using (item_code) group by 1""",
)
def _(t):
    return s.selling_runs(t.sales_live)


@query(
    "month_pattern",
    """select item_code, string_agg(case when bottles is null then '.' when bottles <= 0 then '0' else bottles::varchar end, ' ' order by i) as pattern
       from o_month_grid group by 1""",
)
def _(t):
    return s.month_pattern(t.sales_live)


define(
    "o_season",
    r"""with m as (select item_code, sum(bottles)::bigint as total, coalesce(sum(bottles) filter (where month(period_month) in (11, 12)), 0)::bigint as holiday,
                     coalesce(sum(bottles) filter (where month(period_month) between 5 and 8), 0)::bigint as summer,
                     count(distinct year(period_month)) filter (where month(period_month) between 5 and 8) as summers
              from o_sales_months where bottles > 0 group by 1)
       select item_code, total, holiday, summer,
              case when total < 12 then null
                   when holiday / total >= 0.6 then 'Nov-Dec concentrated (' || floor(holiday / total * 100 + 0.5)::bigint || '%; unconfirmed)'
                   when summer / total >= 0.8 and summers >= 2 then 'summer-concentrated (' || floor(summer / total * 100 + 0.5)::bigint || '% in May-Aug)'
              end as seasonal
       from m""",
)


@query("seasonality", "select * from o_season")
def _(t):
    return s.seasonality(t.sales_live)


define(
    "o_latest_draw",
    r"""select item_code, count(*) over (partition by item_code) as drawings, drawing, bottles, entries,
              floor(entries / nullif(bottles, 0) + 0.5)::bigint as entries_per_bottle
       from v_draws qualify row_number() over (partition by item_code
         order by nullif(regexp_extract(drawing, '(20\d\d)', 1), '')::int desc nulls last, first_seen desc, drawing desc) = 1""",
)


@query("latest_drawing", "select * from o_latest_draw")
def _(t):
    return s.latest_drawing(t.draws)


_NAMES = """
    with d as (select upper(regexp_replace(product_name, '\\s+', ' ', 'g')) as name, drop_date, sum(bottle_qty) as bottles
               from v_drops group by 1, 2),
    names as (select upper(regexp_replace(name, '\\s+', ' ', 'g')) as name, csc as code from v_products
              union select upper(regexp_replace(item_name, '\\s+', ' ', 'g')), item_code from v_sales_live),
    m as (select d.name, count(distinct n.code) as codes, min(n.code) as code
          from (select distinct name from d) d left join names n using (name) group by 1)
    select m.name, case when codes = 1 then code end as code, codes, count(*) as drops, sum(bottles)::bigint as total_bottles,
           max(bottles)::bigint as largest_drop, min(drop_date)::varchar as first_drop, max(drop_date)::varchar as last_drop
    from m join d using (name) group by 1, 2, 3"""
define("o_drop_names", _NAMES)


@query("unique_name_resolution", "select * from o_drop_names")
def _(t):
    return s.unique_name_resolution(t.drops, t.products, t.sales_live)


define(
    "o_watched_months",
    """select date_trunc('month', d)::date as period_month, count(*) as days from o_days
       where date_trunc('month', d)::date in (select period_month from v_sales_live) group by 1 having count(*) >= 15""",
)


@query("watched_months", "select period_month::varchar as period_month, days from o_watched_months")
def _(t):
    return s.watched_months(t.days, t.sales_live).withColumn("period_month", times.text("period_month"))


define(
    "o_universe",
    """select coalesce(k.csc, h.item_code) as csc, k.csc is not null as listed, coalesce(k.name, h.item_name) as name,
              coalesce(h.class_name, k.category) as class_name, case when k.csc is not null then k.status else h.status end as status,
              coalesce(h.names, 0) as names, k.observed_days, k.in_stock_days, k.sellouts, k.stores_now, k.store_days, k.typical_stores,
              k.stores_low, k.stores_high, coalesce(t.record_months12, 0) as record_months12, coalesce(t.bottles12, 0) as bottles12
       from o_stock_metrics k full join o_history h on h.item_code = k.csc left join o_trailing t on t.item_code = h.item_code
       where k.csc is not null or t.bottles12 > 0
          or coalesce(k.csc, h.item_code) in (select item_code from v_draws_live)""",
)
define(
    "o_draw_live",
    r"""select item_code, drawing, bottles, entries from v_draws_live qualify row_number() over (partition by item_code
         order by nullif(regexp_extract(drawing, '(20\d\d)', 1), '')::int desc nulls last, first_seen desc, drawing desc) = 1""",
)
define(
    "o_rated",
    """with u as (
         select u.*, d.drawing, d.bottles as draw_bottles, d.entries as draw_entries, r.total_bottles as drop_bottles, r.drops as drop_count,
                r.first_drop, r.last_drop, w.watched_sold, se.seasonal, in_stock_days / nullif(observed_days, 0) as share
         from o_universe u left join o_draw_live d on d.item_code = u.csc left join o_drop_names r on r.code = u.csc
         left join (select item_code, count(*) as watched_sold from o_sales_months
                    where bottles > 0 and period_month in (select period_month from o_watched_months) group by 1) w on w.item_code = u.csc
         left join o_season se on se.item_code = u.csc),
       f as (select *, not coalesce(seasonal like '%Nov-Dec%', false) or (select bool_or(month(d) in (11, 12)) from o_days) as in_season from u),
       g as (select *, listed and coalesce(observed_days, 0) >= 20 and in_season as enough,
                    coalesce(store_days >= 10 and typical_stores is not null, false) as stores_known from f),
       l as (select *, case when drawing is not null then 'Drawing' when status = 'S' then 'Special order'
                when status in ('D', 'X', 'N', 'U') then 'Being discontinued'
                when drop_bottles is not null and not (enough and coalesce(share >= 0.5, false)) then 'Allocated release'
                when not listed then 'Facts only' when not in_season then 'Not observed in season' when not enough then 'Facts only'
                when share >= 0.8 and not stores_known then 'Facts only'
                when share >= 0.8 and typical_stores >= 10 then 'Widely available' when share >= 0.8 then 'Usually at a few stores'
                when share >= 0.25 then 'Intermittently available'
                when in_stock_days > 0 and (sellouts > 0 or watched_sold > 0) then 'Hard to find' else 'Facts only' end as label from g),
       t as (select *, case when label = 'Drawing' then case when draw_bottles <= 25 then 'unicorn' else 'rare' end
                when label = 'Allocated release' and record_months12 >= 6 and bottles12 > 0 and (not enough or share < 0.25)
                     and drop_bottles <= 100 and bottles12 <= 150 then 'rare'
                when label in ('Allocated release', 'Hard to find') then 'scarce' when label = 'Widely available' then 'everyday'
                when label in ('Usually at a few stores', 'Intermittently available') then 'uncommon' end as tier from l),
       c as (select *, case when tier is null then null when label = 'Drawing' then 'high'
                when label = 'Allocated release' and bottles12 = 0 then 'low'
                when label = 'Allocated release' then case when enough or not listed then 'high' else 'medium' end
                when enough and coalesce(observed_days, 0) >= 26 and stores_known then 'high' when enough and stores_known then 'medium' else 'low' end as confidence,
                case label when 'Drawing' then 'Released through a drawing' when 'Allocated release' then 'Released through allocated drops'
                           when 'Not observed in season' then 'Seasonal'
                           when 'Facts only' then case when listed then 'Not rated yet' else 'Not currently listed' end else label end as headline
             from t),
       b as (select *, case when tier is null then null when names > 1 and tier in ('scarce', 'rare', 'unicorn') then 'code covers ' || names || ' names'
                            when confidence = 'low' then 'low confidence' end as blocked_by from c)
       select *, tier is not null and blocked_by is null as published from b""",
)


def sold(t):
    """The months and the labels of all lines, each written once, as many rules read them."""
    return checkpointed(s.sales_months(t.sales_live)), checkpointed(s.sales_labels(t.sales_live))


def rated(t):
    stock = q_history.stock(t)
    months, labels = sold(t)
    days = t.days
    universe = s.assess_universe(stock, s.sales_history(labels, months), s.sales_trailing12(months, months=months), t.draws_live)
    watched = (
        months.where("bottles > 0")
        .join(s.watched_months(days, months), "period_month", "left_semi")
        .groupBy("item_code")
        .agg(F.count("*").alias("watched_sold"))
    )
    holiday = days.agg(F.bool_or(F.month("d").isin(11, 12))).scalar()
    return s.classify_rarity(
        universe,
        s.latest_drawing(t.draws_live),
        s.unique_name_resolution(t.drops, t.products, labels),
        watched,
        s.seasonality(labels, months=months),
        holiday,
        TH,
    )


@query("assess_universe", "select * from o_universe")
def _(t):
    months, labels = sold(t)
    return s.assess_universe(q_history.stock(t), s.sales_history(labels, months), s.sales_trailing12(months, months=months), t.draws_live)


@query("classify_rarity", "select csc, label, tier, confidence, headline from o_rated")
def _(t):
    return t.rated.select("csc", "label", "tier", "confidence", "headline")


_STOCKED = "'in stock ' || floor(100 * share + 0.5)::bigint || '%'"
_DROPPED = "case when drop_bottles is not null then ' (also in allocated drops)' else '' end"
_STORES = r"regexp_replace(round(typical_stores, 1)::varchar, '\.0$', '')"


@query(
    "rating_reasons",
    f"""select csc, coalesce(case
         when label = 'Drawing' then 'latest drawing ' || coalesce(draw_bottles::varchar, '?') || ' bottles (' || case when tier = 'unicorn' then 'at most' else 'over' end || ' 25)'
         when label in ('Special order', 'Being discontinued') then 'status ' || status
         when label = 'Allocated release' and bottles12 = 0 then 'newly observed: drops total ' || drop_bottles || ' bottles, no recorded sales yet'
         when label = 'Allocated release' then 'drops total ' || drop_bottles || ' bottles, sales ' || bottles12 || ' in 12 months over ' || record_months12 || ' months, '
              || case when enough then {_STOCKED} else 'shelf data thin' end || ': ' || tier
         when label = 'Not observed in season' then 'holiday product; no observed November or December day (' || seasonal || ')'
         when label = 'Facts only' and not listed then 'not in the current catalog; no drawing or drop'
         when label = 'Facts only' and not enough then 'only ' || coalesce(observed_days, 0) || ' observed days'
         when label = 'Facts only' and share >= 0.8 then {_STOCKED} || ', store coverage unknown'
         when label = 'Widely available' then {_STOCKED} || ', typically ' || {_STORES} || ' stores' || {_DROPPED}
         when label = 'Usually at a few stores' then {_STOCKED} || ', typically ' || {_STORES} || ' stores (range ' || stores_low || '-' || stores_high || ')' || {_DROPPED}
         when label = 'Intermittently available' then {_STOCKED} || {_DROPPED}
         when label = 'Hard to find' then {_STOCKED} || case when sellouts > 0 then ', ' || sellouts || ' sellouts' else '' end
              || case when watched_sold > 0 then ', sales in ' || watched_sold || ' watched months' else '' end || {_DROPPED}
         else {_STOCKED} || case when in_stock_days = 0 then '; never seen in stock' else '; no sellout or sales while watched' end end, '') as reason,
         label || case when label in ('Usually at a few stores') and stores_high >= 10 then ' restocks' when label = 'Allocated release' and bottles12 = 0 then ' new'
                       when label = 'Allocated release' and tier = 'rare' then ' rare' when label = 'Facts only' then case when not listed then ' unlisted' when not enough then ' short' when share >= 0.8 then ' stores' else ' seldom' end else '' end as kind
       from o_rated""",
)
def _(t):
    """The reason of each rating; the explanation by the kind of sentence it is."""
    sentences = {
        "Ordered on request": "Special order", "It is being phased out": "Being discontinued", "New in allocated": "Allocated release new", "Only ": "Allocated release rare",
        "Sold through": "Allocated release", "It is not listed": "Facts only unlisted", "No full season": "Not observed in season", "It has not been": "Facts only short",
        "More checks": "Facts only stores", "In stock on most days checked, usually": "Widely available", "At a few stores": "Usually at a few stores restocks",
        "In stock on most days checked, but": "Usually at a few stores", "In stock somewhere on only": "Hard to find", "In stock somewhere on ": "Intermittently available", "It is seldom": "Facts only seldom",
    }
    kind = F.when(F.contains("explanation", F.lit("in this drawing")), "Drawing")
    for start, name in sentences.items():
        kind = kind.when(F.startswith("explanation", F.lit(start)), name)
    return t.rated.select("csc", F.coalesce("reason", F.lit("")).alias("reason"), kind.alias("kind"))


@query("publish_gate", "select csc, tier, confidence, names, blocked_by, published from o_rated")
def _(t):
    return t.rated.select("csc", "tier", "confidence", "names", "blocked_by", "published")


define(
    "o_facts",
    """select csc, concat_ws(' | ',
         case when drawing is not null then 'Drawing (' || drawing || '): ' || format('{:,}', draw_bottles) || ' bottles, ' || format('{:,}', draw_entries)
              || ' entries, about ' || format('{:,}', floor(draw_entries / draw_bottles + 0.5)::bigint) || ' per bottle' end,
         case when drop_bottles is not null then 'In ' || drop_count || case when drop_count = 1 then ' drop' else ' drops' end || ' since ' || first_drop
              || ': ' || format('{:,}', drop_bottles) || ' bottles (last ' || last_drop || ')' end,
         case when observed_days > 0 then 'In stock on ' || in_stock_days || ' of ' || observed_days || ' days checked' end,
         case when stores_known and observed_days > 0 then 'Usually at ' || floor(typical_stores + 0.5)::bigint
              || case when floor(typical_stores + 0.5) = 1 then ' store' else ' stores' end
              || case when stores_high > stores_low then ' (range ' || stores_low || '-' || stores_high || ')' else '' end end,
         case when bottles12 > 0 then format('{:,}', bottles12) || ' bottles sold in 12 months' else 'No sales recorded in 12 months' end) as evidence
       from o_rated""",
)


@query("evidence_facts", "select * from o_facts")
def _(t):
    return s.evidence_facts(t.rated).withColumn("evidence", F.array_join("evidence", " | "))


@query(
    "tier_counts",
    """select label, coalesce(tier, 'none') as tier,
              case when published then 'published' when tier is not null then 'blocked' else 'no badge' end as state, count(*) as codes
       from o_rated group by 1, 2, 3""",
)
def _(t):
    return s.tier_counts(t.rated)


define(
    "o_resolved",
    """select r.*, o.csc is not null as manual, case when o.csc is not null then o.tier when r.published then r.tier end as shown_tier
       from o_rated r left join v_overrides o using (csc)""",
)


@query("override_resolve", "select csc, tier, published, manual, shown_tier from o_resolved")
def _(t):
    return t.resolved.select("csc", "tier", "published", "manual", "shown_tier")


@query("price_percentile",
       """select csc, category, round(percent_rank() over (partition by category order by current_price) * 100, 2) as price_percentile
          from v_products where current_price is not null and category is not null""")
def _(t):
    return s.price_percentile(t.products)


_CLOCK = datetime(2001, 8, 2)
define(
    "o_odds",
    r"""with meta as (select drawing, min(first_seen) as d_first, max(last_seen) as d_last from v_draws group by 1),
       m as (select *, coalesce(nullif(regexp_extract(drawing, '(20\d\d)', 1), '')::int, year(d_first)::int) as year,
                    case when d_last >= timestamp '2001-08-02' - interval 3 day then 'current' else 'past' end as section from meta),
       p as (select *, row_number() over (order by section, year desc, d_first desc, drawing) as place from m),
       r as (select d.*, p.year, p.section, p.place, p.d_first,
                    case when bottles > 0 and entries is not null then
                         case when entries <= bottles then 1 else floor(entries / bottles + 0.5)::bigint end end as one_in
             from v_draws d join p using (drawing))
       select a.drawing, a.item_code, a.year, a.section, a.bottles, a.entries, a.one_in, e.drawing as prev_drawing, e.year as prev_year,
              e.one_in as prev_one_in, e.entries as prev_entries
       from r a left join r e on e.item_code = a.item_code and e.place > a.place and (e.year < a.year or e.d_first < a.d_first)
       qualify row_number() over (partition by a.drawing, a.item_code order by e.place nulls last) = 1""",
)


@query("drawing_odds", "select * from o_odds")
def _(t):
    return s.drawing_odds(t.draws, _CLOCK)


@query(
    "drawing_totals",
    """select drawing, year, section, count(*) as items, sum(bottles)::bigint as bottles, max(one_in) as hardest_one_in,
              sum(entries) filter (where prev_entries is not null)::bigint as entries_now, sum(prev_entries)::bigint as entries_before
       from o_odds group by 1, 2, 3""",
)
def _(t):
    return s.drawing_totals(s.drawing_odds(t.draws, _CLOCK))


@query(
    "hash_sample_review",
    """select category, csc, row_number() over (partition by category order by md5(category || csc), csc)::int as place
       from v_products qualify place <= 12""",
)
def _(t):
    return s.hash_sample(t.products, "category", "csc")


@query(
    "review_flags",
    """select flag, count(*) as codes from (
         select case when published and tier in ('everyday', 'uncommon') and status = 'A' then 'common but allocated' end as flag from o_rated
         union all select case when published and tier in ('scarce', 'rare', 'unicorn') and bottles12 >= 1000 then 'scarce but many sold' end from o_rated
         union all select case when published and tier in ('scarce', 'rare', 'unicorn') and coalesce(stores_now, 0) >= 10 then 'scarce but at many stores' end from o_rated
         union all select case when tier in ('scarce', 'rare', 'unicorn') and blocked_by like 'code covers%' then 'reused code' end from o_rated)
       where flag is not null group by 1""",
)
def _(t):
    return s.review_flags(t.rated)
