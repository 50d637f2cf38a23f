"""Queries over search keys, matching, ranking and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import textkeys as k
from ..operators import geo, sales, search
from .registry import define, query

# An equivalent of the key without lookaround: dots between digits are parked
# twice (runs such as 1.2.3 overlap), initials are joined word by word.
_PARK = r"regexp_replace({x}, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g')"


def key_sql(x: str) -> str:
    aliases = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in k.ALIASES.items()) + "}"
    s = f"regexp_replace(lower(coalesce({x}, '')), '[''’`]', '', 'g')"
    s = _PARK.format(x=_PARK.format(x=s))
    s = f"replace(replace({s}, '.', ' '), chr(1), '.')"
    s = f"regexp_replace({s}, '[^a-z0-9.]+', ' ', 'g')"
    s = rf"regexp_replace({s}, '([a-z])([0-9])', '\1 \2', 'g')"
    s = rf"regexp_replace({s}, '([0-9])([a-z])', '\1 \2', 'g')"
    words = f"string_split(trim({s}), ' ')"
    glue = (
        "list_transform({w}, lambda x, i: x || case when regexp_full_match(x, '[a-z]') "
        "and regexp_full_match(coalesce({w}[i + 1], ''), '[a-z]') then '' else ' ' end)"
    ).format(w=words)
    joined = f"string_split(trim(array_to_string({glue}, '')), ' ')"
    return f"array_to_string(list_transform({joined}, lambda w: coalesce({aliases}[w], w)), ' ')"


@query("search_key", f"select doc_id, {key_sql('text')} as search_key from documents")
def _(t):
    return t.table("documents").select("doc_id", k.search_key("text").alias("search_key"))


@query(
    "search_name",
    """select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) as search_name
       from documents""",
)
def _(t):
    return t.table("documents").select("doc_id", k.search_name("text").alias("search_name"))


@query(
    "query_tokens",
    """select p_partkey, array_to_string(list_distinct_in_order, ';') as tokens from (
         select p_partkey, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || 's|' || split_part(p_name, ' ', 2)]
                || [p_size::varchar, 'yr'] as list_distinct_in_order from part)""",
)
def _(t):
    typed = F.concat(F.initcap("p_name"), F.lit("'s "), F.col("p_size").cast("string"), F.lit("YR old, "), "p_name", F.lit("'s"))
    rows = t.table("part").select("p_partkey", k.query_tokens(typed).alias("t"))
    return rows.select(
        "p_partkey", F.array_join(F.transform("t", lambda x: F.array_join(x["alts"], "|")), ";").alias("tokens")
    )


define("o_keyed", f"select *, {key_sql('name')} as search_key, "
       "trim(regexp_replace(regexp_replace(lower(name), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) as search_name from v_catalog")
define(
    "v_queries",
    """select distinct unnest([p_name, substr(split_part(p_name, ' ', 1), 1, 3) || ' ' || split_part(p_name, ' ', 2),
                              substr(p_name, 2), lower(p_type) || ' ' || split_part(p_name, ' ', 2)]) as q from part""",
)


def queries_of(t):
    """Typed names as a visitor may put them: whole, cut short, cut in front,
    and with the category in place of the first word."""
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    forms = F.array(
        F.col("p_name"),
        F.concat(F.substring(first, 1, 3), F.lit(" "), second),
        F.substr("p_name", F.lit(2)),
        F.concat(F.lower("p_type"), F.lit(" "), second),
    )
    return t.table("part").select("p_name", "p_type").distinct().select(F.explode(forms).alias("q")).distinct()


define(
    "o_tokens",
    "select q, unnest(string_split(q, ' ')) as tok, unnest(generate_series(1, len(string_split(q, ' ')))) as i from v_queries",
)
define(
    "o_texts",
    """with f as (select false as in_category, search_key as text from o_keyed union all select true, lower(coalesce(category, '')) from o_keyed)
       select in_category, text, count(*) as n from f where text <> '' group by 1, 2""",
)
define(
    "o_match",
    r"""with h as (
         select t.q, k.csc, t.i,
                max((regexp_matches(k.search_key, '\b' || t.tok || '\b') or regexp_matches(lower(k.category), '\b' || t.tok || '\b'))::int) as whole,
                max((regexp_matches(k.search_key, '\b' || t.tok) or regexp_matches(lower(k.category), '\b' || t.tok))::int) as starts
         from o_tokens t join o_keyed k on contains(k.search_key, t.tok) or contains(lower(k.category), t.tok) group by 1, 2, 3)
       select q, csc, (case when min(whole) = 1 then 0 when min(starts) = 1 then 1 else 2 end)::int as tier
       from h group by q, csc having count(*) = len(string_split(q, ' '))""",
)


def listed(t):
    """The catalog with its search columns. The table is small and the columns are not, so its
    rows are dealt out to the tasks before."""
    return search.keyed(t.catalog.repartition("csc"))


_INDEXES: dict[tuple[str, str], search.SearchIndex] = {}


def standing(t) -> search.SearchIndex:
    """The index of the catalog, written once per session as the job that keeps it would."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _INDEXES:
        _INDEXES[key] = search.SearchIndex.build(listed(t))
    return _INDEXES[key]


@query("token_match", "select q, csc from o_match")
def _(t):
    return search.token_match(listed(t), queries_of(t), index=standing(t)).select("q", "csc")


@query("index_refresh", "select in_category, count(*) as texts, sum(length(text))::bigint as grams, sum(n)::bigint as members from o_texts group by 1")
def _(t):
    """An index of the in-stock items, brought up to the whole catalog: what it then holds."""
    items = search.keyed(t.catalog)
    index = search.SearchIndex.build(items.where("in_stock")).refresh(items)
    members = index.members.groupBy("tid").agg(F.count("*").alias("n"))
    return index.texts.join(members, "tid").groupBy("in_category").agg(
        F.count("*").alias("texts"), F.sum(F.length("text")).alias("grams"), F.sum("n").alias("members")
    )


@query("match_tier", "select q, tier, count(*) as items, min(csc) as first_item from o_match group by 1, 2")
def _(t):
    hits = search.token_match(listed(t), queries_of(t), index=standing(t))
    return hits.groupBy("q", "tier").agg(F.count("*").alias("items"), F.min("csc").alias("first_item"))


define(
    "o_near_keys",
    """select distinct csc from v_store_now join o_near on o_near.id = store_id
       where area = 'NATION_3' and qty > 0 and seen_at > (select t from clock) - interval 168 hour""",
)
define(
    "o_ranked",
    """select m.q, row_number() over (partition by m.q order by m.tier,
                (delisted_at is not null or status in ('N', 'S') or (status in ('U', 'X') and not in_stock)), in_stock desc,
                (n.csc is not null) desc, starts_with(search_key, m.q) desc, store_qty desc nulls last, search_name, m.csc)::int as place,
              m.csc, k.name, m.tier, count(*) over (partition by m.q) as total
       from o_match m join o_keyed k using (csc) left join o_near_keys n using (csc)""",
)


def ranked(t):
    near = geo.stores_within(geo.area_centroids(t.stores).where("area = 'NATION_3'"), t.stores, 30.0)
    keys = (
        t.store_now.where("qty > 0")
        .join(near.select(F.col("id").alias("store_id")), "store_id")
        .where(F.col("seen_at") > geo.times.ago(t.as_of, "168 hours"))
        .select("csc")
        .distinct()
    )
    return search.search_ranked(listed(t), queries_of(t), near=keys, index=standing(t))


@query("search_ranked", "select * from o_ranked where place <= 50")
def _(t):
    return ranked(t)


@query(
    "search_sorted",
    """select q, row_number() over (partition by q order by current_price nulls last, csc)::int as place, csc, name, tier,
              count(*) over (partition by q) as total from o_match join o_keyed using (csc) where in_stock qualify place <= 50""",
)
def _(t):
    return search.search_ranked(listed(t), queries_of(t), filters=F.col("in_stock"), sort="price_asc", index=standing(t))


@query(
    "search_regression",
    """with c as (select q, min(csc) as lo, max(csc) as hi from o_match group by q),
       r as (select o.q, any_value(lo) as lo, max(csc) filter (where place = 1) as first, count(*) filter (where csc = lo and place <= 5) as inc,
                    count(*) filter (where csc = hi and place <= 20) as exc from o_ranked o join c using (q) where place <= 50 group by 1)
       select q, first = lo as top_ok, inc = 1 as includes_ok, exc = 0 as excludes_ok, first = lo and inc = 1 and exc = 0 as passed
       from r""",
)
def _(t):
    hits = search.token_match(listed(t), queries_of(t), index=standing(t))
    cases = hits.groupBy("q").agg(F.min("csc").alias("lo"), F.max("csc").alias("hi")).select(
        "q", F.col("lo").alias("top"), F.array("lo").alias("includes"), F.lit(5).alias("within"), F.array("hi").alias("excludes")
    )
    return search.search_regression(ranked(t), cases)


# Categories as the source writes them, for the six part types.
CATEGORIES = {
    "PROMO": "VODKA - IMPORTED",
    "STANDARD": "FRENCH RED - BORDEAUX",
    "SMALL": "SPARKLING WINE - PROSECCO",
    "LARGE": "WHITE VARIETAL - CHARDONNAY",
    "MEDIUM": "WHISKEY - BOURBON & TENNESSEE",
    "ECONOMY": "ALLOCATED WINE - RED",
}
_CAT = "case category " + " ".join(f"when '{a}' then '{b}'" for a, b in CATEGORIES.items()) + " end"


@query(
    "category_group",
    """select csc, case category when 'PROMO' then 'vodka' when 'STANDARD' then 'red-wine' when 'SMALL' then 'sparkling' when 'LARGE' then 'white-wine'
                     when 'MEDIUM' then 'whiskey' else 'offers' end as grp,
              case category when 'PROMO' then 'Imported vodka' when 'STANDARD' then 'French · Bordeaux' when 'SMALL' then 'Prosecco' when 'LARGE' then 'Chardonnay'
                     when 'MEDIUM' then 'Bourbon & Tennessee' else 'Allocated Wine · Red' end as label from v_products""",
)
def _(t):
    c = k.lookup(CATEGORIES, F.col("category"))
    return t.products.select("csc", k.category_group(c).alias("grp"), k.subcategory_label(c).alias("label"))


@query(
    "category_menu",
    """select distinct m.position::int as position, m.grp, m.title, m.value, m.label, m.chosen, 1 as place from v_products join (values
         ('PROMO', 2, 'vodka', 'Vodka', 'VODKA - IMPORTED', 'Imported vodka', 'Imported vodka'), ('STANDARD', 8, 'red-wine', 'Red wine', 'FRENCH RED - BORDEAUX', 'French · Bordeaux', 'Red wine · French · Bordeaux'),
         ('SMALL', 11, 'sparkling', 'Sparkling wine', 'SPARKLING WINE - PROSECCO', 'Prosecco', 'Sparkling wine · Prosecco'),
         ('LARGE', 9, 'white-wine', 'White wine', 'WHITE VARIETAL - CHARDONNAY', 'Chardonnay', 'White wine · Chardonnay'),
         ('MEDIUM', 1, 'whiskey', 'Whiskey', 'WHISKEY - BOURBON & TENNESSEE', 'Bourbon & Tennessee', 'Whiskey · Bourbon & Tennessee'),
         ('ECONOMY', 18, 'offers', 'Offers & allocated', 'ALLOCATED WINE - RED', 'Allocated Wine · Red', 'Offers & allocated · Allocated Wine · Red')) m(category, position, grp, title, value, label, chosen) using (category)""",
)
def _(t):
    return search.category_menu(t.products.select(k.lookup(CATEGORIES, F.col("category")).alias("category")))


@query(
    "shortcut_counts",
    """select count(*) filter (where category = 'PROMO' and current_price <= 30) as promo_cheap, count(*) filter (where category = 'SMALL') as small,
              count(*) filter (where current_price <= 25) as cheap, count(*) filter (where status = 'A') as allocated
       from v_catalog where in_stock and delisted_at is null""",
)
def _(t):
    return search.shortcut_counts(
        t.catalog,
        {
            "promo_cheap": F.expr("category = 'PROMO' and current_price <= 30"),
            "small": F.expr("category = 'SMALL'"),
            "cheap": F.expr("current_price <= 25"),
            "allocated": F.expr("status = 'A'"),
        },
    )


FILTER = search.Filter(
    categories=("SMALL", "PROMO", "LARGE", "NO SUCH CATEGORY"), name_terms=("ring",), price_min=20.0, price_tier="above_median",
    limit=20, known=tuple(CATEGORIES),
)
LOCAL = search.Filter(categories=("SMALL", "LARGE", "STANDARD"), price_max=35.0, limit=5)


def _priced(t):
    keyed = search.keyed(t.catalog)
    return sales.skew.percent_rank(
        keyed.where("current_price is not null"), ["category"], "current_price", "__r", 25.0
    ).withColumn("price_percentile", F.round(F.col("__r") * 100, 2))


define(
    "o_priced",
    "select *, round(percent_rank() over (partition by category order by current_price) * 100, 2) as price_percentile from o_keyed",
)


@query(
    "structured_search",
    """select csc, name, price_percentile from o_priced where category in ('SMALL', 'PROMO', 'LARGE') and contains(search_key, 'ring')
         and current_price >= 20 and price_percentile >= 50 order by price_percentile desc, store_qty desc nulls last, csc limit 20""",
)
def _(t):
    return search.structured_search(_priced(t), FILTER).select("csc", "name", "price_percentile")


define("v_areas", "select city as area, round(avg(lat), 9) as lat, round(avg(lng), 9) as lng from v_stores group by 1")
_D = """3959 * 2 * asin(least(1, sqrt(pow(sin(radians(s.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(s.lat))
        * pow(sin(radians(s.lng - a.lng) / 2), 2))))"""
define("o_dist", f"select a.area, s.id, s.is_club, {_D} as miles from v_areas a, v_stores s")
define("o_near", "select area, id, miles from o_dist where not is_club and miles <= 30")


@query(
    "nearest_k_top_n",
    """with n as (select area, id, row_number() over (partition by area order by miles, id) as r from o_dist where not is_club qualify r <= 3),
       p as (select s.store_id, p.csc, row_number() over (partition by s.store_id order by price_percentile desc, p.store_qty desc nulls last, p.csc)::int as place
             from v_store_now s join o_priced p using (csc)
             where s.qty > 0 and s.seen_at > (select t from clock) - interval 168 hour and p.category in ('SMALL', 'LARGE', 'STANDARD') and p.current_price <= 35
             qualify place <= 5)
       select n.area, 'stores' as mode, p.store_id, p.csc, p.place from n join p on p.store_id = n.id""",
)
def _(t):
    return search.nearest_k_top_n(_priced(t), t.stores, t.store_now, geo.area_centroids(t.stores), LOCAL, t.as_of)


@query(
    "querylog_structuring",
    """select distinct p_size || ' ' || p_name || ' under $' || (p_size * 2) || ' allocated' as q, true as question,
              array_to_string(list_filter(string_split(p_name, ' '), lambda w: w not in ('old')), ' ') as keywords, (p_size * 2)::bigint as max_price, 'A' as status
       from part union all select distinct p_name, false, array_to_string(list_filter(string_split(p_name, ' '), lambda w: w not in ('old')), ' '), null::bigint, null
       from part""",
)
def _(t):
    p = t.table("part")
    asked = p.select(
        F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit(" under $"), (F.col("p_size") * 2).cast("string"), F.lit(" allocated")).alias("q")
    ).unionByName(p.select(F.col("p_name").alias("q")))
    return search.querylog_structuring(asked.distinct())


define(
    "v_makers",
    """select distinct 'm' || (regexp_extract(p_brand, '(\\d+)', 1)) as maker, 'vendor' as kind, regexp_extract(p_brand, '(\\d+)', 1) as value
       from part where p_size < 10
       union select distinct 'b' || regexp_extract(p_brand, '(\\d+)', 1), 'prefix', upper(p_brand || ' ' || split_part(p_name, ' ', 1)) from part where p_size > 45""",
)


def _makers(t):
    p = t.table("part")
    n = F.regexp_extract("p_brand", r"(\d+)", 1)
    vendors = p.where("p_size < 10").select(F.concat(F.lit("m"), n).alias("maker"), F.lit("vendor").alias("kind"), n.alias("value"))
    prefixes = p.where("p_size > 45").select(
        F.concat(F.lit("b"), n).alias("maker"),
        F.lit("prefix").alias("kind"),
        F.upper(F.concat_ws(" ", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("value"),
    )
    return vendors.unionByName(prefixes).distinct()


define(
    "o_maker_match",
    """select distinct m.maker, p.csc from v_makers m join v_products p
         on (m.kind = 'vendor' and p.vendor_code = m.value) or (m.kind = 'prefix' and starts_with(p.name, m.value))
       where not (m.maker = 'm1' and p.category = 'PROMO')""",
)


def _matches(t):
    excluded = t.products.where("category = 'PROMO'").select(F.lit("m1").alias("maker"), "csc")
    return search.maker_match(t.products, _makers(t), excluded)


@query("maker_match", "select * from o_maker_match")
def _(t):
    return _matches(t)


@query(
    "maker_shelf",
    """select maker, count(*) filter (where l) as listed, count(*) filter (where not l) as other,
              count(*) filter (where in_stock and coalesce(store_qty, 0) > 0) as on_shelves
       from (select m.maker, c.*, c.in_stock or (c.delisted_at is null and c.status not in ('N', 'S', 'U', 'X')) as l
             from o_maker_match m join v_catalog c using (csc)) group by 1""",
)
def _(t):
    return search.maker_shelf(_matches(t), t.catalog)


@query(
    "display_labels",
    f"""select csc, 'Brand#' || vendor_code || ' ' || upper(substr(b, 1, 1)) || substr(b, 2) || ' ' || upper(substr(c, 1, 1)) || substr(c, 2) as title,
              case when category = 'MEDIUM' then 'spirit' else 'wine' end as kind,
              'bottles' as unit
       from (select *, lower(split_part(name, ' ', 2)) as b, lower(split_part(name, ' ', 3)) as c from v_products)""",
)
def _(t):
    sized = t.products.select(
        "csc",
        F.concat("name", F.lit(" "), F.col("size_ml").cast("string"), F.lit("ML")).alias("name"),
        k.lookup(CATEGORIES, F.col("category")).alias("category"),
        "size_ml",
    )
    return search.display_labels(sized)


@query(
    "label_families",
    """with l as (select csc, regexp_replace(lower(name), '#', ' ') as label, category, name from v_products),
       f as (select label, count(*) as sizes, min(csc) filter (where category = 'SMALL') as n from l group by 1)
       select l.csc, l.label, f.sizes, coalesce('note of ' || f.n, case when l.category <> 'LARGE' then 'Listing of ' || l.name end) as text,
              f.n is not null as ours
       from l join f using (label)""",
)
def _(t):
    items = t.products.select(
        "csc",
        F.concat("name", F.lit(" "), F.col("size_ml").cast("string"), F.lit("ml")).alias("name"),
        F.when(F.col("category") == "LARGE", "A larger bottle of the same").otherwise(F.concat(F.lit(" Listing of "), "name")).alias("description"),
    )
    notes = t.products.where("category = 'SMALL'").select("csc", F.concat(F.lit("note of "), "csc").alias("note"))
    return search.label_families(items, notes)
