"""Distances, areas and what can honestly be said about stock nearby.

Stores and areas are dimension tables; product facts are not. Distances are
found through grid cells, so that a point meets only stores of its own and the
adjoining cells.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import times

EARTH_MILES = 3959.0
NEAR_MILES = 10.0
FRESH_HOURS = 168
NONE_HOURS = 24
_MILES_PER_DEGREE = 69.0


def miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lng2 - lng1) / 2), 2
    )
    return EARTH_MILES * 2 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _cells_around(row: Column, high: float, radius: float) -> Column:
    """Number of equal cells that circle the globe in a row of latitude ``high`` degrees high.

    A cell is at least as wide as the longitudes that ``radius`` can span from a
    point in this row or the next; where that circles the pole, one cell is all."""
    top = (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * high
    share = math.sin(min(radius / EARTH_MILES, math.pi / 2)) / F.cos(F.radians(F.least(top, F.lit(89.999))))
    cells = F.floor(360 / (F.degrees(F.asin(F.least(share, F.lit(1.0)))) * 1.01))
    return F.when((top >= 89.9) | (share >= 1), F.lit(1)).otherwise(F.greatest(cells, F.lit(1))).cast("int")


def stores_within(areas: DataFrame, stores: DataFrame, radius: float = NEAR_MILES, public: bool = True) -> DataFrame:
    """(area, id, miles) of located stores within ``radius`` of each area.

    ``areas``: (area, lat, lng). Rows of latitude are as high as the radius and
    are cut into cells as wide as it, more degrees towards the poles; cells
    close the circle at 180 degrees. Every store in reach lies in one of the
    three cells around the area in its own row or the rows beside it."""
    high = radius / _MILES_PER_DEGREE * 1.01
    placed = stores.where("lat is not null and lng is not null")
    if public:
        placed = placed.where("not is_club")

    def cell(lng: str, cells: Column) -> Column:
        return F.pmod(F.floor((F.col(lng) + 180) / 360 * cells), cells.cast("long"))

    cells = placed.select("id", "lat", "lng", F.floor(F.col("lat") / high).cast("int").alias("cy"))
    cells = cells.withColumn("__n", _cells_around(F.col("cy"), high, radius)).withColumn("cx", cell("lng", F.col("__n"))).drop("__n")
    asked = (
        areas.select("area", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
        .withColumn("dy", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .withColumn("cy", (F.floor(F.col("a_lat") / high) + F.col("dy")).cast("int"))
        .withColumn("__n", _cells_around(F.col("cy"), high, radius))
    )
    here, n = cell("a_lng", F.col("__n")), F.col("__n").cast("long")
    beside = F.array_distinct(F.array(F.pmod(here - 1, n), here, F.pmod(here + 1, n)))
    asked = asked.select("area", "a_lat", "a_lng", "cy", F.explode(beside).alias("cx"))
    d = miles(F.col("a_lat"), F.col("a_lng"), F.col("lat"), F.col("lng"))
    return asked.join(cells, ["cy", "cx"]).withColumn("miles", d).where(F.col("miles") <= radius).select("area", "id", "miles")


def area_centroids(stores: DataFrame, by: str = "city") -> DataFrame:
    """Mean position of the located stores of each city."""
    return (
        stores.where("lat is not null and lng is not null")
        .where(F.col(by).isNotNull())
        .groupBy(F.col(by).alias("area"))
        .agg(F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lng"), 9).alias("lng"))
    )


def nearest_stores(points: DataFrame, stores: DataFrame, n: int = 3, start: float = 200.0, globe: float = 12800.0) -> DataFrame:
    """The ``n`` nearest public stores of each point.

    A first circle serves nearly every point. Points that found fewer stores look
    again in a circle eight times as wide, and so on up to the whole globe, so no
    point is left short."""
    usable = stores.where("lat is not null and lng is not null and not is_club")
    enough = F.least(F.lit(n), usable.agg(F.count("*")).scalar())
    by_distance = Window.partitionBy("area").orderBy("miles", "id")
    radii = [start]
    while radii[-1] < globe:
        radii.append(min(radii[-1] * 8, globe))
    served, left = None, points
    for radius in radii:
        near = stores_within(left, usable, radius)
        top = near.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= n)
        if radius < globe:
            top = top.withColumn("__found", F.count("*").over(Window.partitionBy("area"))).where(F.col("__found") >= enough).drop("__found")
            left = left.join(top.select("area").distinct(), "area", "left_anti")
        served = top if served is None else served.unionByName(top)
    return served


def can_claim_none(checked_at: str | Column, as_of: datetime, hours: int = NONE_HOURS) -> Column:
    """May "none here" be said from a check made then? Never without one."""
    return F.coalesce(times.col(checked_at) >= times.ago(as_of, f"{hours} hours"), F.lit(False))


def is_fresh(checked_at: str | Column, as_of: datetime, hours: int = FRESH_HOURS) -> Column:
    return F.coalesce(times.col(checked_at) >= times.ago(as_of, f"{hours} hours"), F.lit(False))


def _newer(statewide_at: Column, checked_at: Column) -> Column:
    return F.coalesce(statewide_at > checked_at, F.lit(False))


def none_statewide_since(qty: str | Column, at: str | Column, checked_at: str | Column) -> Column:
    """A later statewide count of zero disproves older store counts."""
    return _newer(times.col(at), times.col(checked_at)) & (F.coalesce(times.col(qty), F.lit(0)) <= 0)


def exceeds_statewide(held: str | Column, qty: str | Column, at: str | Column, checked_at: str | Column) -> Column:
    """A store cannot hold more than a later statewide count."""
    held = times.col(held)
    return (held > 0) & _newer(times.col(at), times.col(checked_at)) & (held > F.coalesce(times.col(qty), F.lit(0)))


def nearby_stock(near: DataFrame, store_now: DataFrame, catalog: DataFrame, as_of: datetime, hours: int = FRESH_HOURS) -> DataFrame:
    """Per area and product: near stores with stock, units, oldest check, and the
    statewide count. Stale rows are unknown and absent.

    ``near``: (area, id). Store rows meet areas by store id; counts combine
    before the shuffle."""
    fresh = store_now.where(F.col("seen_at") > times.ago(as_of, f"{hours} hours"))
    checked = fresh.groupBy("csc").agg(F.min("seen_at").alias("checked_at"))
    local = (
        fresh.where("qty > 0")
        .join(near.select("area", F.col("id").alias("store_id")), "store_id")
        .groupBy("area", "csc")
        .agg(F.count("*").alias("stores"), F.sum("qty").alias("units"))
    )
    return (
        local.join(checked, "csc")
        .join(catalog.select("csc", F.col("store_qty").alias("statewide_qty"), F.col("last_seen").alias("statewide_at")), "csc")
        .select("area", "csc", "stores", "units", "checked_at", "statewide_qty", "statewide_at")
    )


def nearby_asked(asked: DataFrame, near: DataFrame, store_now: DataFrame, catalog: DataFrame, as_of: datetime, hours: int = FRESH_HOURS) -> DataFrame:
    """The near stock of each asked pair (area, csc) whose product was checked
    lately. None near is a zero with the time of the check; a pair whose product
    was not checked is unknown and absent."""
    asked = asked.select("area", "csc").distinct()
    local = nearby_stock(near, store_now, catalog, as_of, hours).select("area", "csc", "stores", "units")
    checked = store_now.where(F.col("seen_at") > times.ago(as_of, f"{hours} hours")).groupBy("csc").agg(F.min("seen_at").alias("checked_at"))
    wide = catalog.select("csc", F.col("store_qty").alias("statewide_qty"), F.col("last_seen").alias("statewide_at"))
    return (
        asked.join(checked, "csc")
        .join(wide, "csc")
        .join(local, ["area", "csc"], "left")
        .fillna(0, ["stores", "units"])
        .select("area", "csc", "stores", "units", "checked_at", "statewide_qty", "statewide_at")
    )


def freshness_claims(store_now: DataFrame, catalog: DataFrame, as_of: datetime) -> DataFrame:
    """The three claims for every store count."""
    wide = catalog.select("csc", F.col("store_qty").alias("w_qty"), F.col("last_seen").alias("w_at"))
    return store_now.join(wide, "csc").select(
        "csc",
        "store_id",
        can_claim_none("seen_at", as_of).alias("may_claim_none"),
        none_statewide_since("w_qty", "w_at", "seen_at").alias("none_statewide_since"),
        exceeds_statewide("qty", "w_qty", "w_at", "seen_at").alias("exceeds_statewide"),
    )


def local_answer(near_all: DataFrame, stores: DataFrame, store_now: DataFrame, catalog: DataFrame, areas: DataFrame, as_of: datetime) -> DataFrame:
    """One verdict per product and area.

    ``near_all``: (area, id) including club stores, which count towards ruling
    out a statewide figure but never as stock for a shopper. Areas are few and
    travel as one array; products stay distributed."""
    names = areas.agg(F.array_sort(F.collect_set("area"))).scalar()
    per = store_now.groupBy("csc").agg(
        F.max("seen_at").alias("checked_at"), F.bool_or(F.col("qty") > 0).alias("any_stock")
    )
    local = (
        store_now.where("qty > 0")
        .join(near_all.select("area", F.col("id").alias("store_id")), "store_id")
        .join(stores.select(F.col("id").alias("store_id"), "is_club"), "store_id")
        .groupBy("area", "csc")
        .agg(
            F.count_if(~F.col("is_club")).alias("stores"),
            F.coalesce(F.sum(F.when(~F.col("is_club"), F.col("qty"))), F.lit(0)).alias("units"),
            F.sum("qty").alias("all_units"),
        )
    )
    grid = (
        catalog.select("csc", "store_qty", "last_seen", F.col("delisted_at").isNotNull().alias("delisted"))
        .join(per, "csc", "left")
        .withColumn("__areas", names)
        .select("*", F.explode("__areas").alias("area"))
        .drop("__areas")
        .join(local, ["area", "csc"], "left")
        .fillna(0, ["stores", "units", "all_units"])
    )
    zero_now = F.coalesce("store_qty", F.lit(0)) <= 0
    newer_stock = F.coalesce((F.col("checked_at") > F.col("last_seen")) & F.col("any_stock"), F.lit(False))
    disproved = none_statewide_since("store_qty", "last_seen", "checked_at") | exceeds_statewide(
        "all_units", "store_qty", "last_seen", "checked_at"
    )
    verdict = (
        F.when(F.col("delisted"), "delisted")
        .when(zero_now & ~newer_stock & F.col("last_seen").isNotNull(), "statewide-zero")
        .when(~is_fresh("checked_at", as_of), "unknown")
        .when((F.col("stores") > 0) & disproved, "disproved")
        .when((F.col("stores") > 0) & can_claim_none("checked_at", as_of), "fresh-positive")
        .when(F.col("stores") > 0, "stale-positive")
        .when(can_claim_none("checked_at", as_of), "fresh-zero")
        .otherwise("unknown")
    )
    positive = F.col("verdict").isin("fresh-positive", "stale-positive")
    return grid.withColumn("verdict", verdict).select(
        "area",
        "csc",
        "verdict",
        F.when(positive, F.col("stores")).alias("stores"),
        F.when(positive, F.col("units")).alias("units"),
        F.col("verdict").isin("stale-positive", "unknown", "disproved").alias("wants_check"),
    )


def near_state(nearby: DataFrame, catalog_checks: DataFrame, areas: DataFrame, as_of: datetime, hours: int = NONE_HOURS) -> DataFrame:
    """near / not-near / unknown per product and area, within a day.

    ``catalog_checks``: (csc, checked_at), the last successful store check."""
    names = areas.agg(F.array_sort(F.collect_set("area"))).scalar()
    grid = catalog_checks.withColumn("__areas", names).select(
        "csc", F.col("checked_at").alias("store_checked_at"), F.explode("__areas").alias("area")
    )
    j = grid.join(nearby.select("area", "csc", "stores", "checked_at"), ["area", "csc"], "left")
    edge = times.ago(as_of, f"{hours} hours")
    state = (
        F.when(F.coalesce((F.col("stores") > 0) & (F.col("checked_at") >= edge), F.lit(False)), "near")
        .when(F.coalesce(F.col("store_checked_at") >= edge, F.lit(False)), "not-near")
        .otherwise("unknown")
    )
    return j.select("area", "csc", state.alias("state"))


def watch_summary(watch: DataFrame, homes: DataFrame, nearby: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per user: watched, in stock, and watched items near home with the oldest
    check; counts a later statewide figure disproves are left out.

    ``homes``: (user_id, area)."""
    off = none_statewide_since("statewide_qty", "statewide_at", "checked_at") | exceeds_statewide(
        "units", "statewide_qty", "statewide_at", "checked_at"
    )
    good = nearby.where(~off).select("area", "csc", "checked_at")
    rows = (
        watch.join(homes, "user_id")
        .join(catalog.select("csc", "in_stock"), "csc", "left")
        .join(good, ["area", "csc"], "left")
    )
    return rows.groupBy("user_id").agg(
        F.count("*").alias("watched"),
        F.count_if("in_stock").alias("in_stock"),
        F.count("checked_at").alias("near"),
        F.min("checked_at").alias("oldest_check"),
    )


def store_ranking(watch: DataFrame, homes: DataFrame, stores: DataFrame, store_now: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each watched item of a user: the nearest store, the one with most
    bottles, and the own store with stock. Club stores are never suggested.

    ``homes``: (user_id, store_id, lat, lng). A product has at most one row per
    store; the picks are aggregates, not sorts."""
    wide = catalog.select("csc", F.col("store_qty").alias("w_qty"), F.col("last_seen").alias("w_at"))
    held = (
        store_now.where("qty > 0")
        .join(wide, "csc")
        .where(~exceeds_statewide("qty", "w_qty", "w_at", "seen_at"))
        .join(stores.select(F.col("id").alias("store_id"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), "is_club"), "store_id")
        .select("csc", "store_id", "qty", "s_lat", "s_lng", "is_club")
    )
    d = F.round(miles(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng")), 6)
    rows = (
        watch.select("user_id", "csc")
        .join(homes.withColumnRenamed("store_id", "home"), "user_id")
        .join(held, "csc")
        .withColumn("d", d)
    )
    public, mine = ~F.col("is_club"), F.col("store_id") == F.col("home")
    return rows.groupBy("user_id", "csc").agg(
        F.min_by("store_id", F.when(public, F.struct("d", "store_id"))).alias("nearest"),
        F.min_by("store_id", F.when(public, F.struct((-F.col("qty")).alias("q"), F.col("store_id")))).alias("most"),
        F.max(F.when(mine, F.col("store_id"))).alias("mine"),
    )


def store_breadth(store_now: DataFrame, stores: DataFrame, as_of: datetime, tiers: DataFrame | None = None, hours: int = FRESH_HOURS) -> DataFrame:
    """Per store: distinct stocked products, units, and scarce ones on the shelf."""
    fresh = store_now.where((F.col("qty") > 0) & (F.col("seen_at") > times.ago(as_of, f"{hours} hours")))
    if tiers is not None:
        fresh = fresh.join(
            tiers.where(F.col("shown_tier").isin("scarce", "rare", "unicorn")).select("csc", F.lit(True).alias("scarce")), "csc", "left"
        )
    else:
        fresh = fresh.withColumn("scarce", F.lit(None).cast("boolean"))
    per = fresh.groupBy("store_id").agg(
        F.countDistinct("csc").alias("products"), F.sum("qty").alias("units"), F.count_if(F.coalesce("scarce", F.lit(False))).alias("scarce")
    )
    return per.join(stores.select(F.col("id").alias("store_id"), "city", "is_club"), "store_id")
