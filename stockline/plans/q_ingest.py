"""Queries over ingest, change capture and current state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import ingest as g, places
from ..sources import html
from .registry import define, query

_SPLIT = "timestamp_ntz'2024-01-20'"


def _batch(t):
    """Latest state of every key before and after a cut, as previous and batch."""
    status = t.products.select("csc", "status")

    def state(rows):
        return (
            rows.groupBy("csc")
            .agg(F.max_by("price", "seen_at").alias("price"), F.max_by("store_qty", "seen_at").alias("store_qty"))
            .join(status, "csc")
        )

    return state(t.obs.where(f"seen_at < {_SPLIT}")), state(t.obs.where(f"seen_at >= {_SPLIT}"))


define(
    "o_prev_state",
    """select csc, arg_max(price, seen_at) as price, arg_max(store_qty, seen_at) as store_qty
       from v_obs where seen_at < timestamp '2024-01-20' group by csc""",
)
define(
    "o_batch_state",
    """select csc, arg_max(price, seen_at) as price, arg_max(store_qty, seen_at) as store_qty
       from v_obs where seen_at >= timestamp '2024-01-20' group by csc""",
)


@query(
    "normalize_catalog",
    r"""select lpad(p_partkey::varchar, 6, '0') as csc,
              p_brand || ' ' || p_name || ' ' || case when p_size % 2 = 0 then p_size * 50 || 'ml' else p_size || '.75L' end as name,
              p_type as category, substr('1ADLSU', (p_partkey % 6)::int + 1, 1) as status,
              case when p_size % 2 = 0 then p_size * 50 else p_size * 1000 + 750 end::int as size_ml,
              (p_partkey % 7)::int as store_qty, p_partkey % 7 > 0 as in_stock
       from part""",
)
def _(t):
    raw = t.table("part").select(
        F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("sku"),
        F.concat(
            F.lit("  "), "p_brand", F.lit("   "), "p_name", F.lit(" "),
            F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") * 50).cast("string"), F.lit("ml"))).otherwise(
                F.concat(F.col("p_size").cast("string"), F.lit(".75L"))
            ),
        ).alias("name"),
        F.concat(F.lit(" "), "p_type").alias("display_group"),
        F.concat(F.expr("substr('1ADLSU', cast(p_partkey % 6 as int) + 1, 1)"), F.lit("  Some label")).alias("status"),
        (F.col("p_partkey") % 7).cast("int").alias("store_qty"),
        F.lit(None).cast("boolean").alias("in_stock"),
    )
    return g.normalize_catalog(raw)


@query(
    "dedup_source_rows",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax
       from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber
         order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_discount desc,
                  l_tax desc) = 1""",
)
def _(t):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return g.dedup_source_rows(
        t.table("lineitem").select("l_orderkey", "l_linenumber", *order), ["l_orderkey", "l_linenumber"], order
    ).drop("l_shipdate")


@query(
    "batch_quality_gate",
    """select *, case when fetched < 140 * 0.95 then 'reject: too few rows' when empty_keys > 0 then 'reject: empty keys'
                      when duplicate_keys > 0 then 'reject: duplicate keys'
                      when drops_to_zero > drop_limit then 'reject: too many drops to zero' else 'accept' end as verdict
       from (select count(*) as fetched, count(*) filter (where coalesce(p.store_qty, 0) > 0) as previously_in_stock,
                    count(*) filter (where coalesce(p.store_qty, 0) > 0 and coalesce(b.store_qty, 0) = 0) as drops_to_zero,
                    count(*) filter (where b.csc is null or b.csc = '') as empty_keys,
                    count(b.csc) - count(distinct b.csc) as duplicate_keys,
                    greatest(10.0::double, 0.02::double * count(*) filter (where coalesce(p.store_qty, 0) > 0)) as drop_limit
             from o_batch_state b left join o_prev_state p using (csc))""",
)
def _(t):
    previous, batch = _batch(t)
    return g.batch_quality_gate(previous, batch, expected=140, max_drops=10)


@query(
    "snapshot_diff_events",
    """with j as (select b.csc, b.price, b.store_qty as q, p.price as pp, p.store_qty as pq, p.csc is not null as known
                  from o_batch_state b left join o_prev_state p using (csc))
       select csc, 'new_product' as event_type, null as old, price::varchar as "new" from j where not known
       union all select csc, 'price_change', pp::varchar, price::varchar from j where known and pp <> price
       union all select csc, 'restock', pq::varchar, q::varchar from j where known and pq = 0 and q > 0
       union all select csc, 'out_of_stock', pq::varchar, q::varchar from j where known and pq > 0 and q = 0""",
)
def _(t):
    return g.snapshot_diff_events(*_batch(t))


@query("change_events", "select * from v_changes")
def _(t):
    return t.changes


@query(
    "suppress_after_gap",
    """select c.* from v_changes c
       where c.created_at >= timestamp '2024-01-13' and c.created_at < timestamp '2024-01-14'
         and (select max(finished_at) from v_runs where ok and finished_at < timestamp '2024-01-14')
             >= timestamp '2024-01-14' - interval 48 hour""",
)
def _(t):
    from datetime import datetime

    batch = t.changes.where("created_at >= timestamp_ntz'2024-01-13' and created_at < timestamp_ntz'2024-01-14'")
    return g.suppress_after_gap(batch, t.runs, datetime(2024, 1, 14))


@query(
    "suppress_after_gap_outage",
    """select c.* from v_changes c
       where c.created_at >= timestamp '2024-01-12' and c.created_at < timestamp '2024-01-13'
         and (select max(finished_at) from v_runs where ok and finished_at < timestamp '2024-01-13')
             >= timestamp '2024-01-13' - interval 48 hour""",
)
def _(t):
    from datetime import datetime

    batch = t.changes.where("created_at >= timestamp_ntz'2024-01-12' and created_at < timestamp_ntz'2024-01-13'")
    return g.suppress_after_gap(batch, t.runs, datetime(2024, 1, 13))


@query(
    "delta_encode",
    """select csc, seen_at, in_stock, price from (
         select csc, seen_at, store_qty > 0 as in_stock, price,
                lag(store_qty > 0) over w as pi, lag(price) over w as pp, row_number() over w as rn
         from v_obs window w as (partition by csc order by seen_at))
       where rn = 1 or pi is distinct from in_stock or pp is distinct from price""",
)
def _(t):
    rows = t.obs.select("csc", "seen_at", (F.col("store_qty") > 0).alias("in_stock"), "price")
    return g.delta_encode(rows, ["csc"], "seen_at", ["in_stock", "price"])


@query(
    "upsert_latest",
    """select coalesce(p.csc, o.csc) as csc, case when o.csc is not null then o.store_qty end as store_qty,
              coalesce(p.size_ml, o.store_qty) as size_ml, coalesce(o.price, p.current_price) as price
       from v_products p full join v_latest o on p.csc = o.csc""",
)
def _(t):
    current = t.products.select("csc", F.lit(None).cast("int").alias("store_qty"), "size_ml", F.col("current_price").alias("price"))
    incoming = t.latest.select("csc", "store_qty", F.col("store_qty").alias("size_ml"), "price")
    return g.upsert_latest(current, incoming, "csc", ["store_qty"], ["size_ml"], ["price"])


@query("soft_delete_absent", "select csc, last_seen, in_stock, delisted_at from v_catalog where last_seen is not null")
def _(t):
    return t.catalog.where("last_seen is not null").select("csc", "last_seen", "in_stock", "delisted_at")


@query(
    "remove_missing",
    """select c_custkey, case when not exists (select 1 from orders where o_custkey = c_custkey) then (select t from clock) end as removed_at
       from customer""",
)
def _(t):
    registry = t.table("customer").select("c_custkey", F.lit(None).cast("timestamp_ntz").alias("removed_at"))
    pull = t.table("orders").select(F.col("o_custkey").alias("c_custkey"))
    return g.remove_missing(registry, pull, "c_custkey", t.as_of)


def _pages_of_day(t):
    """Store pages read on the last day: one row per store listed."""
    last = t.store_obs.where("seen_at >= timestamp_ntz'2024-01-30'")
    before = t.store_obs.where("seen_at < timestamp_ntz'2024-01-30'")
    now = before.groupBy("csc", "store_id").agg(F.max("seen_at").alias("seen_at"), F.max_by("qty", "seen_at").alias("qty"))
    page = last.groupBy("csc", "store_id").agg(F.max("seen_at").alias("checked_at"), F.max_by("qty", "seen_at").alias("qty"))
    return now, page


define(
    "o_store_before",
    """select csc, store_id, max(seen_at) as seen_at, arg_max(qty, seen_at) as qty from v_store_obs
       where seen_at < timestamp '2024-01-30' group by 1, 2""",
)
define(
    "o_page",
    """select csc, store_id, max(seen_at) as checked_at, arg_max(qty, seen_at) as qty from v_store_obs
       where seen_at >= timestamp '2024-01-30' group by 1, 2""",
)


@query(
    "zero_missing_children",
    """select s.csc, s.store_id, (select max(checked_at) from o_page x where x.csc = s.csc) as seen_at, 0 as qty
       from o_store_before s where s.qty > 0 and s.csc in (select csc from o_page)
         and not exists (select 1 from o_page p where p.csc = s.csc and p.store_id = s.store_id)""",
)
def _(t):
    return g.zero_missing_children(*_pages_of_day(t))


@query(
    "recheck_change_count",
    """with d as (select p.csc, count(*) as n from o_page p join o_store_before s using (csc, store_id)
                  where p.qty is distinct from s.qty group by 1),
            v as (select s.csc, count(*) as n from o_store_before s where s.qty > 0
                    and not exists (select 1 from o_page p where p.csc = s.csc and p.store_id = s.store_id) group by 1)
       select c.csc, coalesce(d.n, 0) + coalesce(v.n, 0) as changed
       from (select distinct csc from o_page) c left join d using (csc) left join v using (csc)""",
)
def _(t):
    now, page = _pages_of_day(t)
    return g.recheck_change_count(now, page)


define(
    "v_store_restocks",
    """select seq * 8 + 6 as event_id, csc, store_id, qty, seen_at as created_at, prev_at as prev_checked_at
       from (select *, lag(qty) over w as prev_qty, lag(seen_at) over w as prev_at from v_store_obs
             window w as (partition by csc, store_id order by seen_at))
       where prev_qty = 0 and qty > 0 and prev_at > seen_at - interval 7 day""",
)


@query("store_restock_events", "select * from v_store_restocks")
def _(t):
    return g.store_restock_events(t.store_obs)


define(
    "o_glitch",
    """select * from (select *, lag(store_qty) over w as pq, lead(store_qty) over w as nq, lead(seen_at) over w as na,
                             lead(seq) over w as ns from v_obs window w as (partition by csc order by seen_at))
       where store_qty = 0 and pq > 0 and nq > 0 and na <= seen_at + interval 120 minute""",
)


@query("repair_glitch", "select * from v_obs where seq not in (select seq from o_glitch)")
def _(t):
    return g.repair_glitch(t.obs, 120)


@query("drop_false_restocks", "select * from v_changes where event_id not in (select ns * 8 + 4 from o_glitch)")
def _(t):
    return g.drop_false_restocks(t.changes, t.obs, 120)


def _links(t):
    """Report links as posted: one month in ten names a wrong file, one a wrong total."""
    per = t.sales.groupBy("period_month").agg(F.sum("dollars").cast("double").alias("d"))
    month = F.date_format("period_month", "yyyy-MM")
    odd = F.month("period_month")
    return per.select(
        "period_month",
        month.alias("link_month"),
        F.when(odd == 3, F.lit("1990-01")).otherwise(month).alias("file_month"),
        month.alias("title_month"),
        g.fiscal_to_month(g.fiscal_label("period_month")).alias("fiscal_month"),
        F.when(odd == 5, F.col("d") + 10).otherwise(F.col("d")).alias("reported_dollars"),
    )


def _verdicts(t):
    manifest = g.month_manifest(t.sales)
    stored = manifest.where("year(period_month) < 2000").select("period_month", "content_hash")
    return g.import_verdicts(manifest, _links(t), stored)


@query(
    "import_monthly_facts",
    """with m as (select period_month, row_number() over (order by period_month desc) as rn
                  from (select distinct period_month from v_sales))
       select period_month::varchar as period_month,
              case when month(period_month) = 3 then 'problem: link and file name differ'
                   when year(period_month) < 2000 and rn > 2 then 'skip'
                   when year(period_month) < 2000 then 'unchanged'
                   when month(period_month) = 5 then 'problem: lines do not add up' else 'import' end as verdict
       from m""",
)
def _(t):
    return _verdicts(t)


@query(
    "months_to_write",
    """select period_month::varchar as period_month, count(*) as lines, sum(bottles)::bigint as bottles,
              sum(dollars)::double as dollars
       from v_sales where year(period_month) >= 2000 and month(period_month) not in (3, 5) group by 1""",
)
def _(t):
    return (
        g.months_to_write(t.sales, _verdicts(t))
        .groupBy("period_month")
        .agg(F.count("*").alias("lines"), F.sum("bottles").alias("bottles"), F.sum("dollars").cast("double").alias("dollars"))
        .withColumn("period_month", times.text("period_month"))
    )


@query(
    "fiscal_to_month",
    """select o_orderkey, 'FY' || lpad(((year(o_orderdate) + (month(o_orderdate) >= 7)::int) % 100)::varchar, 2, '0') || ' P'
                || ((month(o_orderdate) + 5) % 12 + 1) as label,
              case when year(o_orderdate) + (month(o_orderdate) >= 7)::int >= 2000 then strftime(o_orderdate, '%Y-%m')
                   else (year(o_orderdate) + 100) || strftime(o_orderdate, '-%m') end as month,
              strftime(o_orderdate, '%Y-%m') as text_month
       from orders""",
)
def _(t):
    rows = t.table("orders").select(
        "o_orderkey",
        g.fiscal_label("o_orderdate").alias("label"),
        F.date_format("o_orderdate", "MMMM yyyy").alias("words"),
    )
    return rows.select(
        "o_orderkey", "label", g.fiscal_to_month("label").alias("month"), g.text_to_month("words").alias("text_month")
    )


@query(
    "unmatched_codes",
    """with l as (select item_code, arg_min(item_name, line) as item_name from v_sales
                  where period_month = (select max(period_month) from v_sales) and item_code not in
                    (select csc from v_products where status <> 'S') group by 1)
       select (select count(*) from l) as codes,
              (select string_agg(item_code || ' ' || item_name, '; ' order by item_code)
               from (select * from l order by item_code limit 5)) as sample""",
)
def _(t):
    return g.unmatched_codes(t.sales, t.products.where("status <> 'S'"))


@query(
    "reused_codes",
    """select period_month::varchar as period_month, count(*) as codes, count(*) filter (where n > 1) as reused
       from (select period_month, item_code, count(*) as n from v_sales group by 1, 2) group by 1""",
)
def _(t):
    return g.reused_codes(t.sales)


@query(
    "list_change_detect",
    """select drop_date::varchar as drop_date, rows, list_hash, list_hash is distinct from lag(list_hash) over (order by drop_date) as changed
       from (select drop_date, count(*) as rows,
                    sum(('0x' || substr(h, 1, 15))::bigint)::varchar || '-' || sum(('0x' || substr(h, 16, 15))::bigint)::varchar as list_hash
             from (select *, sha256(upper(product_name || '|' || store_id || '|' || bottle_qty)) as h from v_drops) group by 1)""",
)
def _(t):
    return g.list_hashes(t.drops, "drop_date").withColumn("drop_date", times.text("drop_date"))


@query(
    "new_drop_products",
    """select drop_date::varchar as drop_date, count(distinct product_name) as new_products, min(product_name) as first_product
       from v_drops where store_id % 2 = 1 and drop_date >= date '1999-01-01' group by 1""",
)
def _(t):
    stored = t.drops.where("store_id % 2 = 0")
    return g.new_drop_products(stored, t.drops, F.lit("1999-01-01").cast("date")).withColumn("drop_date", times.text("drop_date"))


@query(
    "third_saturday_calendar",
    """with d as (select distinct o_orderdate as day from orders),
       s as (select day, (date_trunc('month', day) + to_days(((13 - dayofweek(date_trunc('month', day))) % 7 + 14)::int))::date as this,
                    (date_trunc('month', day) + interval 1 month) as nm from d),
       x as (select day, this, (nm + to_days(((13 - dayofweek(nm)) % 7 + 14)::int))::date as nxt from s)
       select day, this::varchar as third_saturday,
              (case when day > this + interval 1 day then nxt else this end)::date::varchar as next_drop,
              (case when day <= this + interval 7 day then this else nxt end)::date::varchar as current_drop from x""",
)
def _(t):
    days = t.table("orders").select(F.col("o_orderdate").alias("day")).distinct()
    return g.drop_calendar(days, "day")


@query(
    "regex_line_records",
    """select lpad(o_custkey::varchar, 6, '0') as item_code, o_orderpriority || ' lot ' || o_orderkey as product_name,
              round(o_totalprice, 2) as price, case when o_orderkey % 3 > 0 then (o_orderkey % 90 + 1)::int end as bottles,
              case when o_orderkey % 3 = 2 then (o_orderkey % 7000 + 1)::int end as entries
       from orders where o_orderkey % 5 > 0""",
)
def _(t):
    o = F.col("o_orderkey")
    line = F.concat(
        F.lit("  "), "o_orderpriority", F.lit("  lot "), o.cast("string"), F.lit(" - "),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(" - $"), F.format_number("o_totalprice", 2),
        F.when(o % 3 > 0, F.concat(F.lit(" - "), (o % 90 + 1).cast("string"), F.lit(" Bottles"))).otherwise(""),
        F.when(o % 3 == 2, F.concat(F.lit(" - "), F.format_number(o % 7000 + 1, 0), F.lit(" Entries"))).otherwise(""),
    )
    lines = t.table("orders").select(F.when(o % 5 > 0, line).otherwise("no record here").alias("line"))
    return g.regex_line_records(lines, "line")


@query(
    "unpack_columnar_json",
    """select doc_id, 0 as "column", unnest(generate_series(0, len(l) - 1))::int as "row", unnest([nullif(x, '') for x in l]) as value
       from (select doc_id, string_split(text, chr(10)) as l from documents)""",
)
def _(t):
    lines = F.split("text", "\n")
    body = F.concat(
        F.lit(")]}'\n"),
        F.to_json(
            F.struct(
                F.size(lines).alias("totalCount"),
                F.array(
                    F.struct(
                        F.filter(
                            F.transform(lines, lambda x, i: F.when(x == "", i).otherwise(-1)), lambda i: i >= 0
                        ).alias("nullIndex"),
                        F.struct(F.filter(lines, lambda x: x != "").alias("values")).alias("stringColumn"),
                    )
                ).alias("column"),
            )
        ),
    )
    return g.unpack_columnar(t.table("documents").select("doc_id", body.alias("body")), "doc_id", "body")


@query("page_fact_paragraphs")
def _(t):
    return html.page_fact_paragraphs(t.table("pages"))


def _addresses(t):
    """Addresses as typed, and the registry that spells them in full."""
    n = t.table("nation")
    people = t.table("customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    number = (100 + F.col("c_custkey") % 900).cast("string")
    typed = people.select(
        "c_custkey",
        F.concat(number, F.lit(" W. "), F.regexp_replace("n_name", "_", " "), F.lit(" Street, "), F.regexp_replace("n_name", "_", " ")).alias("text"),
    )
    stores = n.select(
        F.col("n_nationkey").alias("id"),
        F.concat(
            (100 + F.col("n_nationkey") * 37 % 900).cast("string"), F.lit(" WEST "), F.regexp_replace("n_name", "_", " "), F.lit(" ST")
        ).alias("address"),
        F.regexp_replace("n_name", "_", " ").alias("city"),
    )
    return typed, stores


@query(
    "address_store_match",
    """select distinct (100 + c_custkey % 900) || ' W. ' || replace(n_name, '_', ' ') || ' Street, ' || replace(n_name, '_', ' ') as text,
              n_nationkey as store_id
       from customer join nation on n_nationkey = c_nationkey""",
)
def _(t):
    typed, stores = _addresses(t)
    return places.address_store_match(typed, "text", stores)


@query(
    "licence_registry_clean",
    """select 'L-' || c_custkey as license_number, c_mktsegment as type,
              upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Pub' as business_name,
              c_custkey || ' N MAIN ST, ' || c_mktsegment || ' TOWN (X CO), UT 84000' as address,
              upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as city, n_name as county,
              case when c_custkey % 4 > 0 then '2003-11-20' end as issued,
              case c_custkey % 3 when 0 then true when 1 then false end as conditional,
              c_custkey % 2 = 0 as is_new, c_custkey || ' N MAIN ST' as address_key
       from customer join nation on n_nationkey = c_nationkey""",
)
def _(t):
    return places.licence_registry_clean(_licences(t))


def _licences(t):
    k = F.col("c_custkey")
    return (
        t.table("customer")
        .join(t.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .select(
            F.concat(F.lit("L-"), k.cast("string")).alias("license_number"),
            F.col("c_mktsegment").alias("type"),
            F.concat("c_mktsegment", F.lit(" PUB (CBN-2-003)")).alias("business_name"),
            F.concat(k.cast("string"), F.lit(" N MAIN ST, "), "c_mktsegment", F.lit(" TOWN (X CO), UT 84000")).alias("address"),
            F.col("n_name").alias("county"),
            F.when(k % 4 > 0, "2003-11-20").otherwise("n/a").alias("issued"),
            F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "No").otherwise("").alias("conditional"),
            F.when(k % 2 == 0, "New").otherwise("").alias("is_new"),
        )
    )


@query(
    "maker_at_address",
    """select 'L-' || c_custkey as license_number, 'maker ' || s_suppkey as maker
       from customer join supplier on s_suppkey = c_custkey and s_suppkey % 2 = 0""",
)
def _(t):
    k = F.col("s_suppkey")
    city = t.table("customer").select(F.col("c_custkey").alias("s_suppkey"), places.title_case("c_mktsegment").alias("city"))
    makers = (
        t.table("supplier").where(k % 2 == 0).join(city, "s_suppkey")
        .select(F.concat(F.lit("maker "), k.cast("string")).alias("maker"), F.concat(k.cast("string"), F.lit(" N. Main St")).alias("address"), "city")
    )
    return places.maker_at(places.licence_registry_clean(_licences(t)), makers)


@query(
    "bar_groups",
    """with l as (select n_name as county, c_custkey % 2 = 0 as is_new, c_mktsegment,
                         upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as city,
                         case c_mktsegment when 'BUILDING' then 'bar' when 'MACHINERY' then 'bar' when 'FURNITURE' then 'tavern' end as grp
                  from customer join nation on n_nationkey = c_nationkey
                  where c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE'))
       select dimension, value, count(*) as licences, count(*) filter (where is_new) as new_this_month
       from (select 'group' as dimension, grp as value, is_new from l union all select 'county', county, is_new from l
             union all select 'city', city, is_new from l) group by 1, 2""",
)
def _(t):
    groups = t.spark.createDataFrame(
        [("BUILDING", "bar"), ("MACHINERY", "bar"), ("FURNITURE", "tavern")], "type string, grp string"
    )
    return places.bar_groups(places.licence_registry_clean(_licences(t)), groups)


@query(
    "run_log_freshness",
    """with b(job, max_age_hours) as (values ('catalog', 12), ('store_inventory', 12), ('allocated', 24), ('digest', 8)),
       l as (select job, max(finished_at) filter (where ok) as last_ok from v_runs group by job)
       select job, max_age_hours, last_ok, round((epoch_us((select t from clock)) - epoch_us(last_ok)) / 1e6 / 3600, 4) as age_hours,
              coalesce((epoch_us((select t from clock)) - epoch_us(last_ok)) / 1e6 / 3600 > max_age_hours, true) as stale
       from b left join l using (job)""",
)
def _(t):
    budgets = t.spark.createDataFrame(
        [("catalog", 12), ("store_inventory", 12), ("allocated", 24), ("digest", 8)], "job string, max_age_hours int"
    )
    return g.run_log_freshness(t.runs, budgets, t.as_of)


@query(
    "apply_swap_rows",
    """select csc, name, true as listed from v_products where status <> 'U'
       union all select item_code, 'Item ' || item_code, false from (select distinct item_code from v_draws)
       where item_code not in (select csc from v_products where status <> 'U')""",
)
def _(t):
    return g.with_placeholders(t.products.where("status <> 'U'"), t.draws.select(F.col("item_code").alias("csc")))
