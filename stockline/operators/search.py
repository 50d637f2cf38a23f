"""Search over names: keys, matching, ranking, structured filters, makers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import textkeys as k
from ..functions import times
from ..session import checkpointed
from . import geo
from .search_index import SearchIndex, match, tokens_of

__all__ = ["SearchIndex", "tokens_of"]


def keyed(items: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``search_key`` and ``search_name``."""
    return items.withColumn("search_key", k.search_key(name)).withColumn("search_name", k.search_name(name))


def token_match(items: DataFrame, queries: DataFrame, key: str = "csc", q: str = "q", index: SearchIndex | None = None) -> DataFrame:
    """Items holding every token of a query, with the match tier: 0 whole words,
    1 word starts, 2 substrings. ``index``: a standing index of ``items``; without it one is
    built for this call."""
    return match(index or SearchIndex.build(items, key), queries, key, q)


def search_ranked(
    catalog: DataFrame,
    queries: DataFrame,
    near: DataFrame | None = None,
    filters: Column | None = None,
    sort: str | None = None,
    page: int = 1,
    page_size: int = 50,
    index: SearchIndex | None = None,
) -> DataFrame:
    """One page of ranked results per query, with the total number of matches.

    ``near``: keys with fresh stock near the visitor, when an area is chosen. ``index``: a
    standing index of ``catalog``.
    The matches are read twice, to rank and to count them, so they are written
    once; ranking cuts each query to its page before the shuffle.
    """
    items = catalog if filters is None else catalog.where(filters)
    # A code may stand for several items; each of them is a result and counts.
    listed = items.groupBy("csc").agg(F.count("*").alias("listed"))
    matched = checkpointed(token_match(catalog, queries, index=index).join(listed, "csc"))
    hits = matched.drop("listed").join(items, "csc")
    totals = matched.groupBy("q").agg(F.sum("listed").alias("total"))
    if near is not None:
        hits = hits.join(near.select("csc", F.lit(1).alias("near")), "csc", "left").fillna(0, ["near"])
    else:
        hits = hits.withColumn("near", F.lit(0))
    status, category = F.coalesce("status", F.lit("")), F.coalesce("category", F.lit(""))
    special = (
        F.col("delisted_at").isNotNull()
        | status.isin("N", "S")
        | category.like("SPECIAL ORDERS%")
        | (status.isin("U", "X") & ~F.col("in_stock"))
    )
    orders = {
        "price_asc": [F.col("current_price").asc_nulls_last()],
        "price_desc": [F.col("current_price").desc_nulls_last()],
        "qty": [F.col("store_qty").desc_nulls_last()],
        "name": [F.col("search_name").asc()],
        None: [
            F.col("tier").asc(),
            special.asc(),
            F.col("in_stock").desc(),
            F.col("near").desc(),
            F.startswith("search_key", F.col("phrase")).desc(),
            F.col("store_qty").desc_nulls_last(),
            F.col("search_name").asc(),
        ],
    }
    w = Window.partitionBy("q").orderBy(*orders[sort], F.col("csc").asc())
    place = F.row_number().over(w)
    return (
        hits.withColumn("place", place)
        .where(F.col("place") <= page * page_size)
        .where(F.col("place") > (page - 1) * page_size)
        .join(totals, "q")
        .select("q", "place", "csc", "name", "tier", "total")
    )


def search_regression(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """Pass or fail per case. ``cases``: (q, top, includes, within, excludes); a
    case fails when its first, an included or an excluded key is off."""
    found = (
        ranked.join(cases, "q")
        .groupBy("q")
        .agg(
            F.max(F.when(F.col("place") == 1, F.col("csc"))).alias("first"),
            F.count_if(F.array_contains("includes", F.col("csc")) & (F.col("place") <= F.col("within"))).alias("included"),
            F.count_if(F.array_contains("excludes", F.col("csc")) & (F.col("place") <= 20)).alias("excluded"),
        )
    )
    c = cases.join(found, "q", "left")
    return c.select(
        "q",
        F.coalesce(F.col("top").isNull() | (F.col("first") == F.col("top")), F.lit(False)).alias("top_ok"),
        (F.coalesce("included", F.lit(0)) == F.size("includes")).alias("includes_ok"),
        (F.coalesce("excluded", F.lit(0)) == 0).alias("excludes_ok"),
    ).withColumn("passed", F.expr("top_ok and includes_ok and excludes_ok"))


def category_menu(items: DataFrame, category: str = "category") -> DataFrame:
    """The picker: groups in menu order, each group's categories by label. One row a category."""
    order = F.create_map(*[F.lit(x) for i, g in enumerate(k.GROUP_LABELS, 1) for x in (g, i)])
    each = items.where(F.col(category).isNotNull()).select(F.col(category).alias("value")).distinct()
    named = each.select("value", k.category_group("value").alias("grp"), k.subcategory_label("value").alias("label"), k.filter_label("value").alias("chosen"))
    by = Window.partitionBy("grp").orderBy(F.lower("label"), "label", "value")
    return named.select(
        F.try_element_at(order, F.col("grp")).alias("position"), "grp", k.lookup(k.GROUP_LABELS, F.col("grp")).alias("title"), "value", "label", "chosen",
        F.row_number().over(by).alias("place"),
    )


def shortcut_counts(catalog: DataFrame, shortcuts: Mapping[str, Column]) -> DataFrame:
    """Many conditional counts of listed in-stock items in one pass."""
    return catalog.where("in_stock and delisted_at is null").agg(
        *[F.count_if(cond).alias(name) for name, cond in shortcuts.items()]
    )


@dataclass(frozen=True)
class Filter:
    """A structured search; unknown categories are dropped, never guessed."""

    categories: Sequence[str] = ()
    name_terms: Sequence[str] = ()
    price_min: float | None = None
    price_max: float | None = None
    price_tier: str | None = None
    status: str | None = None
    sort: str | None = None
    limit: int = 20
    known: Sequence[str] = field(default=())


# Price tiers as bounds on the price percentile.
PRICE_TIERS = {
    "top_quartile": "price_percentile >= 75",
    "above_median": "price_percentile >= 50",
    "below_median": "price_percentile < 50",
    "bottom_quartile": "price_percentile < 25",
}
STATUS_FILTERS = {
    "in_stock": "in_stock",
    "discontinued_clearance": "status = 'D' and store_qty > 0",
    "allocated": "status in ('A', 'L')",
}


def _filtered(items: DataFrame, f: Filter) -> DataFrame:
    out = items.where("category is not null and category not like 'SPECIAL ORDERS%'")
    wanted = [c for c in f.categories if not f.known or c in f.known]
    if wanted:
        out = out.where(F.col("category").isin(*wanted))
    for term in f.name_terms:
        out = out.where(F.contains("search_key", k.search_key(F.lit(term))))
    if f.price_min is not None:
        out = out.where(F.col("current_price") >= f.price_min)
    if f.price_max is not None:
        out = out.where(F.col("current_price") <= f.price_max)
    if f.price_tier in PRICE_TIERS:
        out = out.where(PRICE_TIERS[f.price_tier])
    if f.status in STATUS_FILTERS:
        out = out.where(STATUS_FILTERS[f.status])
    return out


def _filter_order(f: Filter) -> list[Column]:
    return {
        "price_asc": [F.col("current_price").asc_nulls_last()],
        "price_desc": [F.col("current_price").desc_nulls_last()],
        "qty": [F.col("store_qty").desc_nulls_last()],
    }.get(f.sort, [F.coalesce("price_percentile", F.lit(50.0)).desc(), F.col("store_qty").desc_nulls_last()])


def structured_search(items: DataFrame, f: Filter) -> DataFrame:
    """The filter's first ``limit`` items; ``items`` carry search_key and price_percentile."""
    return _filtered(items, f).orderBy(*_filter_order(f), "csc").limit(f.limit)


def nearest_k_top_n(
    items: DataFrame, stores: DataFrame, store_now: DataFrame, points: DataFrame, f: Filter, as_of: datetime, nearest: int = 3, fresh_hours: int = 168
) -> DataFrame:
    """For each point its nearest public stores, and the filter's top items in
    each; points whose stores are all empty fall back to the statewide list."""
    pairs = geo.nearest_stores(points, stores, nearest)
    fresh = store_now.where((F.col("qty") > 0) & (F.col("seen_at") > times.ago(as_of, f"{fresh_hours} hours")))
    kept = _filtered(items, f)
    per_store = Window.partitionBy("id").orderBy(*_filter_order(f), F.col("csc"))
    stocked = (
        fresh.select(F.col("store_id").alias("id"), "csc", "qty")
        .join(kept, "csc")
        .withColumn("place", F.row_number().over(per_store))
        .where(F.col("place") <= f.limit)
        .select("id", "csc", "qty", "place")
    )
    local = pairs.join(stocked, "id").select(
        "area", F.lit("stores").alias("mode"), F.col("id").alias("store_id"), "csc", "place"
    )
    empty = points.join(local.select("area").distinct(), "area", "left_anti")
    wide = structured_search(items, f).withColumn(
        "place", F.row_number().over(Window.orderBy(*_filter_order(f), F.col("csc")))
    )
    listed = wide.select(F.struct("csc", "place").alias("x")).agg(F.collect_list("x").alias("xs")).select("xs").scalar()
    statewide = (
        empty.withColumn("__xs", listed)
        .select("area", F.explode("__xs").alias("x"))
        .select("area", F.lit("statewide").alias("mode"), F.lit(None).cast("int").alias("store_id"), "x.csc", "x.place")
    )
    return local.unionByName(statewide)


def maker_match(products: DataFrame, makers: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(maker, csc) by vendor code or by a reviewed name prefix.

    ``makers``: (maker, kind 'vendor' | 'prefix', value). The two kinds are
    separate equi-joins: a name offers its leading parts only in the lengths
    that some prefix has, so no pattern is tried on every product."""
    vendor = makers.where("kind = 'vendor'").select("maker", F.col("value").alias("vendor_code"))
    by_vendor = products.select("csc", "vendor_code").join(vendor, "vendor_code").select("maker", "csc")
    prefix = makers.where("kind = 'prefix'").select("maker", F.upper("value").alias("lead"))
    lengths = prefix.agg(F.collect_set(F.length("lead"))).scalar()
    name = F.upper("name")
    leads = (
        products.select("csc", name.alias("name"))
        .withColumn("__n", F.explode(lengths))
        .where(F.length("name") >= F.col("__n"))
        .select("csc", F.substr("name", F.lit(1), F.col("__n")).alias("lead"))
    )
    found = by_vendor.unionByName(leads.join(prefix, "lead").select("maker", "csc")).distinct()
    return found if excluded is None else found.join(excluded, ["maker", "csc"], "left_anti")


def maker_shelf(matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per maker: listed items, other items, and items on shelves now."""
    status = F.coalesce("status", F.lit(""))
    regular = (
        F.col("delisted_at").isNull()
        & ~F.coalesce("category", F.lit("")).like("SPECIAL ORDERS%")
        & ~status.isin("N", "S", "U", "X")
    )
    listed = F.col("in_stock") | regular
    return (
        matches.join(catalog, "csc")
        .groupBy("maker")
        .agg(
            F.count_if(listed).alias("listed"),
            F.count_if(~listed).alias("other"),
            F.count_if(F.col("in_stock") & (F.coalesce("store_qty", F.lit(0)) > 0)).alias("on_shelves"),
        )
    )


def display_labels(items: DataFrame) -> DataFrame:
    """Readable title, kind and unit word for each item."""
    kind = k.product_kind("category", "size_ml")
    return items.select(
        "csc", k.product_title("name", "size_ml").alias("title"), kind.alias("kind"), k.unit_word(kind).alias("unit")
    )


def label_key(name: str | Column) -> Column:
    """One key for all sizes of a label: sizes stripped, abbreviations spelled out."""
    n = F.regexp_replace(times.col(name), r"(?i)\s*\d+(\.\d+)?\s*(ml|m|l)$", "")
    n = F.regexp_replace(n, r"(?i)\b\d+(\.\d+)?\s?(ml|l)\b", "")
    return k.search_key(n)


_SIZE_BLURB = r"(?i)^(a |an )?(larger|large|extra-large|big|jumbo|full-size|full-sized|standard|mid-size|compact)( size)? bottle"


def label_families(items: DataFrame, notes: DataFrame) -> DataFrame:
    """The text to show per item: its label's first note, else the listing text
    unless that only speaks of the size. ``notes``: (csc, note)."""
    labelled = items.withColumn("label", label_key("name"))
    first = (
        labelled.select("csc", "label")
        .join(notes, "csc")
        .groupBy("label")
        .agg(F.min_by("note", "csc").alias("note"), F.count("*").alias("notes"))
    )
    family = labelled.groupBy("label").agg(F.count("*").alias("sizes"))
    text = F.trim("description")
    own = F.when((text != "") & ~text.rlike(_SIZE_BLURB), text)
    return (
        labelled.join(family, "label")
        .join(first, "label", "left")
        .select("csc", "label", "sizes", F.coalesce("note", own).alias("text"), F.col("note").isNotNull().alias("ours"))
    )


# Describing words of a question, and words that say nothing.
QUESTION_WORDS = [
    "under", "over", "below", "above", "less", "more", "than", "around", "near", "nearby", "me",
    "cheap", "cheapest", "best", "good", "great", "high", "end", "for", "with", "like", "similar",
    "something", "gift", "smooth", "peaty", "sweet", "dry", "bold", "light", "stock",
]
FILLER_WORDS = [
    "allocated", "limited", "a", "an", "the", "in", "of", "and", "or", "to", "is", "any", "some",
    "year", "years", "yr", "old", "aged", "bottle", "bottles",
]


def querylog_structuring(log: DataFrame, q: str = "q") -> DataFrame:
    """Typed queries -> question or name, rough keywords, price cap, status."""
    text = F.lower(F.col(q))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, "[^a-z]", ""))
    describing = F.size(F.filter(bare, lambda w: w.isin(QUESTION_WORDS)))
    question = text.rlike(r"\$\s?\d") | ((F.size(words) >= 3) & (describing >= 1))
    price = F.regexp_extract(text, r"(?:under|below|less than|<)\s*\$?\s?(\d+)", 1).try_cast("bigint")
    status = F.when(text.rlike(r"\ballocated\b"), "A").when(text.rlike(r"\blimited\b"), "L")
    rough = F.filter(
        F.transform(F.split(F.regexp_replace(text, r"\$\s?\d+(\.\d+)?", " "), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9']", "")),
        lambda w: (w != "") & ~w.isin(QUESTION_WORDS) & ~w.rlike(r"^\d+$") & ~w.isin(FILLER_WORDS),
    )
    colour = F.exists(rough, lambda w: w.isin("red", "white", "rose", "rosé", "sparkling"))
    kept = F.when(colour, F.filter(rough, lambda w: w != "wine")).otherwise(rough)
    return log.select(
        q, question.alias("question"), F.array_join(kept, " ").alias("keywords"), price.alias("max_price"), status.alias("status")
    )
