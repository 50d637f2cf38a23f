"""Discovery views, change feeds and demand rankings.

A catalog row is ``(csc, name, category, size_ml, status, current_price,
store_qty, in_stock, first_seen, last_seen, delisted_at)``; a change is
``(event_id, csc, event_type, old, new, created_at)``.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import skew, textkeys, times

# Tiers from scarcest to commonest.
TIER_RANK = {"unicorn": 0, "rare": 1, "scarce": 2, "uncommon": 3, "everyday": 4}
SCARCE = ("unicorn", "rare", "scarce")
VIEWS = ("scarce", "back", "price")
NOISE = r"\b\d+ ?pk\b|variety|\brtd\b|\bcans?\b|seltzer"


def special_order() -> Column:
    return F.coalesce("category", F.lit("")).like("SPECIAL ORDERS%")


def eligible_now(catalog: DataFrame, draws: DataFrame, as_of: datetime, max_age_hours: int = 24) -> DataFrame:
    """In stock, priced, seen within a day, listed, a regular listing, and not
    released by drawing."""
    return (
        catalog.where("in_stock and store_qty > 0 and current_price is not null and delisted_at is null")
        .where(F.col("last_seen") > times.ago(as_of, f"{max_age_hours} hours"))
        .where(~F.coalesce("status", F.lit("")).isin("S", "N") & ~special_order())
        .join(draws.select(F.col("item_code").alias("csc")), "csc", "left_anti")
    )


def reused_names(sales: DataFrame) -> DataFrame:
    """Codes sold under more than one name."""
    key = F.regexp_replace(F.upper("item_name"), "[^A-Z0-9]", "")
    return (
        sales.groupBy(F.col("item_code").alias("csc"))
        .agg(F.countDistinct(key).alias("names"))
        .where("names > 1")
        .select("csc")
    )


def without_reused(items: DataFrame, sales: DataFrame) -> DataFrame:
    return items.join(reused_names(sales), "csc", "left_anti")


def with_near(items: DataFrame, nearby: DataFrame | None, area: str | None) -> DataFrame:
    """Adds near columns for one visitor's area; null without one."""
    if nearby is None or area is None:
        return items.withColumns(
            {
                "near_stores": F.lit(None).cast("bigint"),
                "near_units": F.lit(None).cast("bigint"),
                "near_checked_at": F.lit(None).cast("timestamp_ntz"),
            }
        )
    here = nearby.where(F.col("area") == area).select(
        "csc", F.col("stores").alias("near_stores"), F.col("units").alias("near_units"), F.col("checked_at").alias("near_checked_at")
    )
    return items.join(here, "csc", "left")


def view_scarce(eligible: DataFrame, resolved: DataFrame) -> DataFrame:
    tiers = resolved.where(F.col("shown_tier").isin(*SCARCE)).select("csc", F.col("shown_tier").alias("tier"))
    return eligible.join(tiers, "csc")


def view_back(eligible: DataFrame, returns: DataFrame, sales: DataFrame) -> DataFrame:
    return without_reused(eligible.join(returns, "csc"), sales)


def view_price_drops(
    eligible: DataFrame,
    changes: DataFrame,
    sales: DataFrame,
    as_of: datetime,
    min_share: float = 0.1,
    min_drop: float = 3.0,
    within_days: int = 30,
    held_hours: int = 7 * 24,
) -> DataFrame:
    """The latest price change is a real drop that still stands, from a price
    that had held."""
    moves = changes.where("event_type = 'price_change'").select(
        "csc",
        "event_id",
        "created_at",
        F.col("old").cast("double").alias("old_price"),
        F.col("new").cast("double").alias("new_price"),
    )
    held = skew.neighbours(
        moves, ["csc"], ["created_at", "event_id"], F.to_date("created_at"), prev={"prev_change": "created_at"}
    )
    last = skew.latest(held, ["csc"], ["created_at", "event_id"])
    drop = F.col("old_price") - F.col("new_price")
    kept = last.where(
        (F.col("created_at") > times.ago(as_of, f"{within_days} days"))
        & (drop >= min_drop)
        & (drop >= F.col("old_price") * min_share)
        & (
            F.col("prev_change").isNull()
            | (F.col("prev_change") <= F.col("created_at") - F.expr(f"interval {held_hours} hours"))
        )
    )
    joined = eligible.join(kept.select("csc", "old_price", "new_price", F.col("created_at").alias("drop_at")), "csc")
    return without_reused(joined.where("new_price = current_price").drop("new_price"), sales)


def candidates(scarce: DataFrame, back: DataFrame, price: DataFrame) -> DataFrame:
    """The three views under one schema."""
    common = ["csc", "name", "current_price", "last_seen", "store_checked_at", "near_stores", "near_checked_at"]
    parts = []
    for view, df in zip(VIEWS, (scarce, back, price)):
        extra = {"tier": "string", "out_since": "timestamp_ntz", "back_at": "timestamp_ntz", "old_price": "double", "drop_at": "timestamp_ntz"}
        parts.append(
            df.select(
                F.lit(view).alias("view"),
                *common,
                *[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in extra.items()],
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rank_view(items: DataFrame, as_of: datetime, has_area: bool, nearby_only: bool = False, most: int = 60, near_hours: int = 24) -> DataFrame:
    """Order within each view: near first, the view's own signal, fresher checks,
    then the code; the first ``most`` are shown."""
    near = F.coalesce(
        (F.col("near_stores") > 0) & (F.col("near_checked_at") >= times.ago(as_of, f"{near_hours} hours")), F.lit(False)
    )
    items = items.withColumn("near", near if has_area else F.lit(False))
    if nearby_only:
        items = items.where("near")
    rank = F.coalesce(textkeys.lookup({k: str(v) for k, v in TIER_RANK.items()}, F.col("tier")).cast("int"), F.lit(9))
    drop = F.coalesce((F.col("old_price") - F.col("current_price")) / F.expr("nullif(old_price, 0)"), F.lit(0.0))
    view = F.col("view")
    signal = [
        F.when(view == "scarce", rank).asc_nulls_last(),
        F.when(view == "back", F.col("back_at")).desc_nulls_last(),
        F.when(view == "back", F.col("out_since")).asc_nulls_last(),
        F.when(view == "price", drop).desc_nulls_last(),
        F.when(view == "price", F.col("drop_at")).desc_nulls_last(),
    ]
    w = Window.partitionBy("view").orderBy(
        F.col("near").desc(), *signal, F.col("store_checked_at").desc_nulls_last(), F.col("last_seen").desc_nulls_last(), F.col("csc")
    )
    return items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def mix_preview(ranked: DataFrame, size: int = 3, has_area: bool = True) -> DataFrame:
    """A few different items taken from the views in turn, near ones first.

    The next pick is the smallest of (near or not, picks its view has had, view, place)
    over the items not picked yet. No more than twice ``size`` rows of a view, near or not,
    can matter; these few dozen are folded into the picks within one row."""
    near_rank = F.row_number().over(Window.partitionBy("view", "near").orderBy("place"))
    top = ranked.withColumn("r", near_rank).where(F.col("r") <= 2 * size)
    order = F.array_position(F.array(*map(F.lit, VIEWS)), F.col("view")).cast("int")
    rounds = F.when(F.col("near"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))) if has_area else F.array(F.lit(1))
    rows = top.select(F.explode(rounds).alias("pass"), order.alias("turn"), "place", "view", "csc")
    held = rows.agg(F.collect_list(F.struct("pass", "turn", "place", "view", "csc")).alias("rows"))
    pick = "struct<pass:int,had:int,turn:int,place:int,view:string,csc:string>"

    def take(picks: Column, _: Column) -> Column:
        free = F.filter("rows", lambda r: ~F.exists(picks, lambda p: p["csc"] == r["csc"]))
        had = lambda r: F.size(F.filter(picks, lambda p: (p["pass"] == r["pass"]) & (p["view"] == r["view"])))
        keyed = F.transform(free, lambda r: F.struct(r["pass"], had(r).alias("had"), r["turn"], r["place"], r["view"], r["csc"]).cast(pick))
        return F.array_compact(F.concat(picks, F.array(F.array_min(keyed))))

    picks = F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.array().cast(f"array<{pick}>"), take)
    return held.select(F.posexplode(picks).alias("at", "p")).select((F.col("at") + 1).alias("place"), "p.view", "p.csc")


def change_feed(changes: DataFrame, catalog: DataFrame, kinds: Iterable[str] | None = None, n: int = 100, include_special: bool = False) -> DataFrame:
    """The newest changes; store restocks only when asked for by type."""
    rows = changes.where(F.col("event_type").isin(*kinds)) if kinds else changes.where("event_type <> 'store_restock'")
    rows = rows.join(catalog.select("csc", "name", "category", "status", "in_stock"), "csc", "left")
    if not include_special:
        rows = rows.where(~F.coalesce("status", F.lit("")).isin("S", "N") & ~special_order())
    return rows.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(n)


def _newsworthy(changes: DataFrame, catalog: DataFrame, min_price: float = 20.0, min_size: int = 375) -> DataFrame:
    """Changes of listed items people can buy, without packs, cans and minis."""
    items = catalog.where("delisted_at is null").where(
        ~F.coalesce("status", F.lit("")).isin("S", "N", "X")
        & ~special_order()
        & (F.coalesce("current_price", F.lit(0.0)) >= min_price)
        & (F.coalesce("size_ml", F.lit(750)) >= min_size)
        & ~textkeys.search_name("name").rlike(NOISE)
    )
    return changes.join(items.select("csc", "name", "status", "current_price", "in_stock"), "csc")


def _real_drop() -> Column:
    return F.col("new").try_cast("double") <= F.col("old").try_cast("double") * 0.95


def home_feed(changes: DataFrame, catalog: DataFrame, as_of: datetime, n: int = 12, days: tuple[int, int] = (7, 30), enough: int = 4) -> DataFrame:
    """The latest real change per item; a quiet week widens the window."""
    kind = F.col("event_type")
    news = _newsworthy(changes, catalog).where(
        kind.isin("restock", "new_product", "price_change", "status_change")
        & ((kind != "price_change") | _real_drop())
        & ((kind != "status_change") | F.col("new").isin("D", "A", "L"))
        & ((kind != "restock") | F.col("in_stock"))
    )
    short, long = (news.where(F.col("created_at") > times.ago(as_of, f"{d} days")) for d in days)
    few = short.agg(F.countDistinct("csc") < enough).scalar()
    edge = F.when(few, times.ago(as_of, f"{days[1]} days")).otherwise(times.ago(as_of, f"{days[0]} days"))
    latest = skew.latest(long.where(F.col("created_at") > edge), ["csc"], ["created_at", "event_id"])
    return latest.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(n)


def week_sections(changes: DataFrame, catalog: DataFrame, resolved: DataFrame, watch: DataFrame, as_of: datetime, n: int = 10, days: int = 7) -> DataFrame:
    """Five sections of the week, the latest change per item, best first, with
    the number of items before the cut."""
    tier = textkeys.lookup({k: str(5 - v) for k, v in TIER_RANK.items()}, F.col("tier")).cast("int")
    ranks = resolved.where("published").select("csc", tier.alias("tier_rank"))
    watchers = watch.groupBy("csc").agg(F.count("*").alias("watchers"))
    news = (
        _newsworthy(changes, catalog)
        .where(F.col("created_at") > times.ago(as_of, f"{days} days"))
        .join(ranks, "csc", "left")
        .join(watchers, "csc", "left")
        .fillna(0, ["tier_rank", "watchers"])
    )
    kind = F.col("event_type")
    section = (
        F.when((kind == "restock") & F.col("in_stock"), "restock")
        .when(kind == "new_product", "new_product")
        .when((kind == "price_change") & _real_drop(), "price_drop")
        .when((kind == "status_change") & F.col("new").isin("A", "L", "D"), "status")
        .when((kind == "out_of_stock") & ~F.col("in_stock") & ((F.col("tier_rank") >= 3) | F.col("status").isin("A", "L")), "sold_out")
    )
    tagged = news.withColumn("section", section).where("section is not null")
    latest = skew.latest(tagged, ["section", "csc"], ["created_at", "event_id"])
    totals = latest.groupBy("section").agg(F.count("*").alias("total"))
    w = Window.partitionBy("section").orderBy(
        F.col("tier_rank").desc(), F.col("watchers").desc(), F.col("current_price").desc_nulls_last(), F.col("created_at").desc(), F.col("event_id")
    )
    return (
        latest.withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= n)
        .join(totals, "section")
        .select("section", "place", "csc", "event_id", "tier_rank", "watchers", "total")
    )


def drops_listing(drops: DataFrame, stores: DataFrame) -> DataFrame:
    """Drops grouped by date and product with their stores, most bottles first.
    A product has one entry per store."""
    rows = drops.join(stores.select(F.col("id").alias("store_id"), "city"), "store_id", "left")
    entry = F.struct((-F.coalesce("bottle_qty", F.lit(0))).alias("q"), F.coalesce("city", F.lit("?")).alias("city"))
    per = rows.groupBy("drop_date", "product_name").agg(
        F.count("*").alias("stores"),
        F.sum("bottle_qty").alias("bottles"),
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["city"]), ", ").alias("cities"),
    )
    return per.withColumn("drop_date", times.text("drop_date"))


def drop_sizes(drops: DataFrame) -> DataFrame:
    """Per date: distinct products, rows, and rows matched to a store."""
    return (
        drops.groupBy("drop_date")
        .agg(F.countDistinct("product_name").alias("products"), F.count("*").alias("rows"), F.count("store_id").alias("matched"))
        .withColumn("drop_date", times.text("drop_date"))
    )


def exclusion_reasons(catalog: DataFrame, resolved: DataFrame, draws: DataFrame, as_of: datetime, examples: int = 5, max_age_hours: int = 24) -> DataFrame:
    """Why in-stock scarce items are left out: first reason, count, examples."""
    drawn = draws.select(F.col("item_code").alias("csc")).distinct().withColumn("drawn", F.lit(True))
    tiers = resolved.where(F.col("shown_tier").isin(*SCARCE)).select("csc")
    rows = (
        catalog.where("in_stock and store_qty > 0")
        .join(tiers, "csc", "left_semi")
        .join(drawn, "csc", "left")
        .withColumn(
            "outcome",
            F.when(F.col("drawn"), "released by drawing")
            .when(F.col("delisted_at").isNotNull(), "delisted")
            .when(F.coalesce("status", F.lit("")).isin("S", "N") | special_order(), "special order / unavailable")
            .when(F.col("last_seen") <= times.ago(as_of, f"{max_age_hours} hours"), "statewide data stale")
            .when(F.col("current_price").isNull(), "no price")
            .otherwise("shown"),
        )
    )
    return _with_examples(rows, "outcome", F.concat_ws(" ", "csc", "name"), "csc", examples)


def _with_examples(rows: DataFrame, group: str, label: Column, order: str, n: int) -> DataFrame:
    counts = rows.groupBy(group).agg(F.count("*").alias("products"))
    first = (
        rows.select(group, order, label.alias("label"))
        .withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(order)))
        .where(F.col("r") <= n)
        .groupBy(group)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]), "; ").alias("examples"))
    )
    return counts.join(first, group)


def price_drop_outcomes(changes: DataFrame, catalog: DataFrame, as_of: datetime, min_share: float = 0.1, min_drop: float = 3.0, within_days: int = 30) -> DataFrame:
    """What became of each item's latest price change."""
    moves = changes.where("event_type = 'price_change'").select(
        "csc", "event_id", "created_at", F.col("old").cast("double").alias("was"), F.col("new").cast("double").alias("now")
    )
    last = skew.latest(moves, ["csc"], ["created_at", "event_id"]).where(
        F.col("created_at") > times.ago(as_of, f"{within_days} days")
    )
    drop = F.col("was") - F.col("now")
    outcome = (
        F.when(F.col("now") >= F.col("was"), "increase")
        .when((drop < min_drop) | (drop < F.col("was") * min_share), "drop below threshold")
        .when(F.col("now") != F.col("current_price"), "current price differs")
        .when(~F.col("in_stock"), "not in stock")
        .otherwise("other")
    )
    return last.join(catalog.select("csc", "current_price", "in_stock"), "csc").groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("products")
    )


def last_real_change(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest change per listed product, else when it was first seen."""
    last = changes.where("event_type <> 'store_restock'").groupBy("csc").agg(F.max("created_at").alias("changed_at"))
    return (
        catalog.where("delisted_at is null")
        .join(last, "csc", "left")
        .select("csc", F.coalesce("changed_at", "first_seen").alias("changed_at"))
    )


def demand_ranking(
    catalog: DataFrame, pages: DataFrame, watch: DataFrame, sales: DataFrame, special: DataFrame, as_of: datetime, n: int = 300, days: int = 30, keg_ml: int = 19000
) -> DataFrame:
    """Listed items by interest (watched, viewed twice, special), then dollars."""
    views = (
        pages.where("csc is not null")
        .where(F.col("created_at") > times.ago(as_of, f"{days} days"))
        .groupBy("csc")
        .agg(F.countDistinct("visitor_id").alias("views"))
    )
    watches = watch.groupBy("csc").agg(F.count("*").alias("watches"))
    newest = sales.agg(F.max("period_month")).scalar()
    sold = (
        sales.where(F.col("period_month") >= F.add_months(newest, -2))
        .groupBy(F.col("item_code").alias("csc"))
        .agg(F.sum("bottles").alias("sold"), F.sum("dollars").cast("double").alias("dollars"))
    )
    rows = (
        catalog.where("delisted_at is null")
        .where(F.coalesce("size_ml", F.lit(0)) < keg_ml)
        .select("csc", "name")
        .join(views, "csc", "left")
        .join(watches, "csc", "left")
        .join(sold, "csc", "left")
        .join(special.select("csc").distinct().withColumn("special", F.lit(True)), "csc", "left")
        .fillna(0, ["views", "watches", "sold", "dollars"])
        .fillna(False, ["special"])
        .withColumn("interest", F.expr("watches > 0 or views >= 2 or special"))
    )
    order = [
        F.col("interest").desc(),
        F.when(F.col("interest"), F.col("watches")).desc_nulls_last(),
        F.when(F.col("interest"), F.col("views")).desc_nulls_last(),
        F.col("dollars").desc(),
        F.col("views").desc(),
        F.col("csc").asc(),
    ]
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def topn_coverage(ranking: DataFrame, pages: DataFrame, as_of: datetime, steps: tuple[int, ...] = (25, 50, 100, 200, 300), days: int = 30) -> DataFrame:
    """Share of visitor-product pairs the top N cover. ``ranking`` is the top list."""
    total = (
        pages.where("csc is not null")
        .where(F.col("created_at") > times.ago(as_of, f"{days} days"))
        .agg(F.countDistinct("visitor_id", "csc"))
        .scalar()
    )
    return (
        ranking.select("place", "views", F.explode(F.array(*[F.lit(s) for s in steps])).alias("top"))
        .where(F.col("place") <= F.col("top"))
        .groupBy("top")
        .agg(F.sum("views").alias("visitors"))
        .withColumn("share", F.round(F.col("visitors") / F.nullif(total, F.lit(0)), 6))
    )


def surface_coverage(surfaces: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct keys per surface and how many have an asset. ``surfaces``: (surface, csc)."""
    has = assets.select("csc").distinct().withColumn("has", F.lit(True))
    return (
        surfaces.distinct()
        .join(has, "csc", "left")
        .groupBy("surface")
        .agg(F.count("*").alias("products"), F.count("has").alias("with_asset"))
    )


def missing_assets(surfaces: DataFrame, assets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Listed keys on a surface without an asset, discovery surfaces first.
    A key lies on at most as many surfaces as there are."""
    return (
        surfaces.distinct()
        .join(assets.select("csc"), "csc", "left_anti")
        .join(catalog.where("delisted_at is null").select("csc", "in_stock"), "csc")
        .groupBy("csc", "in_stock")
        .agg(
            F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("surfaces"),
            (F.max(F.when(F.col("surface").startswith("discover"), 10).otherwise(0)) + F.count("*")).alias("score"),
        )
    )
