"""Monthly sales, drawings, drops and the availability rating.

Sales lines are ``(period_month, item_code, item_name, class_name, bottles,
dollars, status, line)``. A code missing from a month's report is unknown, not
zero. Report months are few (twelve a year), so arrays and windows over months
of one code stay small however many lines the code has.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import skew, times

TIERS = ["everyday", "uncommon", "scarce", "rare", "unicorn"]
# Status codes of items being phased out.
WINDING_DOWN = ["D", "X", "N", "U"]
# Words that mark a season or a limited pack.
HOLIDAY_WORDS = r"(?i)\b(NOG|EGGNOG|HOLIDAY|CHRISTMAS|XMAS|WINTER|PEPPERMINT|SANTA|MISTLETOE|GLOGG|ADVENT|NOUVEAU|GIFT SET|VAP)\b"
AUTUMN_WORDS = r"(?i)\b(OKTOBERFEST|PUMPKIN|HARVEST|FALL)\b"
SUMMER_WORDS = r"(?i)\b(SUMMER|ROSE|ROSÉ|SHANDY|RADLER)\b"


@dataclass(frozen=True)
class Thresholds:
    """The rating's thresholds."""

    trailing_months: int = 12
    consistently: float = 0.8
    hard_to_find: float = 0.25
    wide_stores: int = 10
    min_observed_days: int = 30
    high_observed_days: int = 45
    min_store_days: int = 10
    unicorn_bottles: int = 25
    rare_drop_bottles: int = 100
    rare_max_sales: int = 150
    established_months: int = 6
    shelf_decides: float = 0.5
    run_gap_months: int = 2
    min_run_bottles: int = 6
    min_run_share: float = 0.1
    watched_days: int = 15


DEFAULTS = Thresholds()


def name_key(c: str | Column) -> Column:
    """Names that differ only in case, spacing or punctuation are the same."""
    return F.regexp_replace(F.upper(times.col(c)), "[^A-Z0-9]", "")


def pct(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("bigint").cast("string"), F.lit("%"))


def report_months(sales: DataFrame) -> Column:
    """All report months in order, as one array."""
    return (
        sales.select("period_month").distinct().agg(F.array_sort(F.collect_list("period_month")).alias("m")).scalar()
    )


def sales_months(sales: DataFrame) -> DataFrame:
    return sales.groupBy("item_code", "period_month").agg(
        F.coalesce(F.sum("bottles"), F.lit(0)).alias("bottles"),
        F.count("*").alias("lines"),
        F.max("class_name").alias("class_name"),
        F.min_by("status", "line").alias("status"),
        F.max_by("item_name", "line").alias("item_name"),
    )


def sales_labels(sales: DataFrame) -> DataFrame:
    """The names and classes a code was sold under, each once: all that rules over names need."""
    return sales.select("item_code", "item_name", "class_name").distinct()


def sales_history(sales: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Per code: months, totals, distinct names, newest known class and status.

    ``months``: the ``sales_months``, where they stand; then ``sales`` may be the labels."""
    months = sales_months(sales) if months is None else months
    names = sales.groupBy("item_code").agg(F.countDistinct(name_key("item_name")).alias("names"))

    def newest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("period_month"))).alias(c)

    per = months.groupBy("item_code").agg(
        F.count("*").alias("months"),
        F.min("period_month").alias("first_month"),
        F.sum("bottles").alias("bottles"),
        F.sum("lines").alias("lines"),
        newest("class_name"),
        newest("status"),
        newest("item_name"),
    )
    return per.join(names, "item_code")


def _month_grid(sales: DataFrame, catalog_first: DataFrame | None = None) -> DataFrame:
    """Every report month of every code, from its first record on (``known``)."""
    months = sales_months(sales)
    codes = months.groupBy("item_code").agg(F.min("period_month").alias("first_record"))
    if catalog_first is not None:
        codes = codes.join(catalog_first.select("item_code", "catalog_month"), "item_code", "full_outer").select(
            "item_code", F.least("first_record", "catalog_month").alias("first_record")
        )
    grid = codes.withColumn("__m", report_months(sales)).select(
        "item_code", "first_record", F.posexplode("__m").alias("i", "period_month"), F.size("__m").alias("n")
    )
    return grid.join(
        months.select("item_code", "period_month", "bottles"), ["item_code", "period_month"], "left"
    ).withColumn("known", F.col("period_month") >= F.col("first_record"))


def sales_trailing12(
    sales: DataFrame, catalog_first: DataFrame | None = None, th: Thresholds = DEFAULTS, months: DataFrame | None = None
) -> DataFrame:
    """Eligible, sold, missing and zero months of the trailing window.

    Only the months a code has are rows; those it lacks follow from their number.
    ``months``: the ``sales_months``, where they stand; then ``sales`` is read for nothing else."""
    months = sales_months(sales) if months is None else months
    # A line without a code is of no code: its months count as missing.
    met = F.col("item_code").isNotNull()
    window = F.slice(F.reverse(report_months(months)), 1, th.trailing_months)
    rows = months.select("item_code", "period_month", F.when(met, F.col("bottles")).alias("bottles")).withColumn("__w", window)
    recent = F.array_contains("__w", F.col("period_month")) & F.col("bottles").isNotNull()
    sold = recent & (F.col("bottles") > 0)
    best = F.slice(F.sort_array(F.collect_list(F.when(sold, F.col("bottles"))), asc=False), 1, 2)
    rows = rows.groupBy("item_code").agg(
        F.min("period_month").alias("first_record"),
        F.max(F.when(F.col("bottles") > 0, F.col("period_month"))).alias("last_sold"),
        F.count_if(recent).alias("reported12"),
        F.count_if(sold).alias("sold_months12"),
        F.count_if(recent & (F.col("bottles") <= 0)).alias("explicit_zero12"),
        F.coalesce(F.sum(F.when(sold, F.col("bottles"))), F.lit(0)).alias("bottles12"),
        F.aggregate(best, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("top2"),
    )
    if catalog_first is not None:
        first = catalog_first.groupBy("item_code").agg(F.min("catalog_month").alias("catalog_month"))
        rows = rows.join(first, "item_code", "full_outer").withColumn("first_record", F.least("first_record", "catalog_month"))
        rows = rows.fillna(0, ["reported12", "sold_months12", "explicit_zero12", "bottles12", "top2"])
    eligible = F.size(F.filter("__w", lambda m: m >= F.col("first_record"))).cast("bigint")
    rows = rows.withColumn("__w", window).withColumn("record_months12", eligible)
    rows = rows.withColumn("not_in_report12", F.col("record_months12") - F.col("reported12"))
    return rows.select(
        "item_code",
        "first_record",
        "last_sold",
        "record_months12",
        "sold_months12",
        "not_in_report12",
        "explicit_zero12",
        "bottles12",
        F.round(F.col("sold_months12") / F.expr("nullif(record_months12, 0)"), 6).alias("sold_share12"),
        F.round(F.col("top2") / F.expr("nullif(bottles12, 0)"), 6).alias("top2_share12"),
    )


def selling_runs(sales: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Selling runs split by empty months; tiny runs do not count."""
    sold = _month_grid(sales).where(F.col("known") & (F.col("bottles") > 0))
    w = Window.partitionBy("item_code").orderBy("i")
    fresh = F.coalesce(F.col("i") - F.lag("i").over(w) - 1 >= th.run_gap_months, F.lit(True))
    runs = (
        sold.withColumn("fresh", fresh.cast("int"))
        .withColumn("run", F.sum("fresh").over(w))
        .groupBy("item_code", "run")
        .agg(F.sum("bottles").alias("bottles"))
    )
    all_bottles = runs.groupBy("item_code").agg(F.sum("bottles").alias("bottles_all"))
    counts = F.col("bottles") >= F.greatest(F.lit(float(th.min_run_bottles)), F.col("bottles_all") * th.min_run_share)
    return (
        runs.join(all_bottles, "item_code")
        .groupBy("item_code")
        .agg(F.max("bottles_all").alias("bottles_all"), F.count_if(counts).alias("runs"), F.max("bottles").alias("largest_run"))
    )


def month_pattern(sales: DataFrame) -> DataFrame:
    """Bottles month by month: "." without a line, "0" for an explicit zero."""
    cell = (
        F.when(F.col("bottles").isNull(), ".").when(F.col("bottles") <= 0, "0").otherwise(F.col("bottles").cast("string"))
    )
    cells = F.array_sort(F.collect_list(F.struct("i", cell.alias("c"))))
    return (
        _month_grid(sales)
        .groupBy("item_code")
        .agg(F.array_join(F.transform(cells, lambda x: x["c"]), " ").alias("pattern"))
    )


def seasonality(sales: DataFrame, min_bottles: int = 12, months: DataFrame | None = None) -> DataFrame:
    """Season as an attribute, from months of sale and words in the names.

    ``months``: the ``sales_months``, where they stand; then ``sales`` may be the labels."""
    months = (sales_months(sales) if months is None else months).where("bottles > 0")
    m = F.month("period_month")
    summer = m.between(5, 8)
    per = months.groupBy("item_code").agg(
        F.sum("bottles").alias("total"),
        F.coalesce(F.sum(F.when(m.isin(11, 12), F.col("bottles"))), F.lit(0)).alias("holiday"),
        F.coalesce(F.sum(F.when(summer, F.col("bottles"))), F.lit(0)).alias("summer"),
        F.countDistinct(F.when(summer, F.year("period_month"))).alias("summers"),
    )
    text = F.concat_ws(" ", "item_name", "class_name")
    words = (
        sales.select("item_code", "item_name", "class_name")
        .groupBy("item_code")
        .agg(
            F.bool_or(F.coalesce(text.rlike(HOLIDAY_WORDS), F.lit(False))).alias("w_holiday"),
            F.bool_or(F.coalesce(text.rlike(SUMMER_WORDS), F.lit(False))).alias("w_summer"),
            F.bool_or(F.coalesce(text.rlike(AUTUMN_WORDS), F.lit(False))).alias("w_autumn"),
        )
    )
    h, s = F.col("holiday") / F.col("total"), F.col("summer") / F.col("total")
    label = (
        F.when(F.col("total") < min_bottles, F.lit(None))
        .when((h >= 0.6) & F.col("w_holiday"), F.concat(F.lit("holiday product ("), pct(h), F.lit(" of sales in Nov-Dec)")))
        .when(h >= 0.6, F.concat(F.lit("Nov-Dec concentrated ("), pct(h), F.lit("; unconfirmed)")))
        .when(
            (s >= 0.8) & (F.col("summers") >= 2),
            F.concat(
                F.lit("summer-concentrated ("), pct(s), F.lit(" in May-Aug"),
                F.when(F.col("w_summer"), "; name fits)").otherwise(")"),
            ),
        )
        .when(F.col("w_autumn"), "autumn product (name only)")
    )
    return per.join(words, "item_code").select("item_code", "total", "holiday", "summer", label.alias("seasonal"))


def drawing_year(drawing: str | Column) -> Column:
    return F.regexp_extract(times.col(drawing), r"(20\d\d)", 1).try_cast("int")


def latest_drawing(draws: DataFrame) -> DataFrame:
    """The drawing that decides: newest year in its title (none sorts last),
    then newest first sight. Ties go to the last name."""
    rank = F.struct(F.coalesce(drawing_year("drawing"), F.lit(0)).alias("y"), "first_seen", "drawing")
    per = draws.groupBy("item_code").agg(
        F.count("*").alias("drawings"), F.max_by(F.struct("drawing", "bottles", "entries"), rank).alias("d")
    )
    return per.select(
        "item_code",
        "drawings",
        "d.drawing",
        "d.bottles",
        "d.entries",
        F.floor(F.col("d.entries") / F.expr("nullif(d.bottles, 0)") + 0.5).cast("bigint").alias("entries_per_bottle"),
    )


def one_in(bottles: str | Column, entries: str | Column) -> Column:
    """"1 in N": entries per bottle, 1 when there were bottles for everyone."""
    b, e = times.col(bottles), times.col(entries)
    odds = F.when(e <= b, F.lit(1)).otherwise(F.floor(e / F.nullif(b, F.lit(0)) + 0.5))
    return F.when((b > 0) & e.isNotNull(), odds.cast("bigint"))


def drawing_order(draws: DataFrame, as_of: datetime, grace_days: int = 3) -> DataFrame:
    """One row per drawing: year, open or past, and its place, newest first."""
    meta = draws.groupBy("drawing").agg(
        F.min("first_seen").alias("d_first"), F.max("last_seen").alias("d_last"), F.sum("bottles").alias("d_bottles")
    )
    open_ = F.col("d_last") >= times.ago(as_of, f"{grace_days} days")
    meta = meta.withColumn("year", F.coalesce(drawing_year("drawing"), F.year("d_first"))).withColumn(
        "section", F.when(open_, "current").otherwise("past")
    )
    w = Window.orderBy(F.col("section"), F.col("year").desc(), F.col("d_first").desc(), F.col("drawing"))
    return meta.withColumn("place", F.row_number().over(w))


def drawing_odds(draws: DataFrame, as_of: datetime) -> DataFrame:
    """Odds per item and the same code in the latest earlier drawing.

    A code's drawings are at most the drawings ever held; only they are
    compared with each other."""
    meta = drawing_order(draws, as_of)
    rows = draws.join(meta, "drawing").withColumn("odds", one_in("bottles", "entries"))
    past = rows.groupBy("item_code").agg(
        F.array_sort(
            F.collect_list(F.struct("place", "year", "d_first", "drawing", F.col("odds").alias("odds"), "entries"))
        ).alias("all")
    )
    earlier = F.get(
        F.filter(
            "all",
            lambda e: (e["place"] > F.col("place"))
            & ((e["year"] < F.col("year")) | (e["d_first"] < F.col("d_first"))),
        ),
        F.lit(0),
    )
    return (
        rows.join(past, "item_code")
        .withColumn("prev", earlier)
        .select(
            "drawing",
            "item_code",
            "year",
            "section",
            "bottles",
            "entries",
            F.col("odds").alias("one_in"),
            F.col("prev.drawing").alias("prev_drawing"),
            F.col("prev.year").alias("prev_year"),
            F.col("prev.odds").alias("prev_one_in"),
            F.col("prev.entries").alias("prev_entries"),
        )
    )


def drawing_totals(odds: DataFrame) -> DataFrame:
    """Per drawing: items, bottles, hardest odds, entries now and then for
    codes drawn before."""
    both = F.col("entries").isNotNull() & F.col("prev_entries").isNotNull()
    return odds.groupBy("drawing", "year", "section").agg(
        F.count("*").alias("items"),
        F.sum("bottles").alias("bottles"),
        F.max("one_in").alias("hardest_one_in"),
        F.sum(F.when(both, F.col("entries"))).alias("entries_now"),
        F.sum(F.when(both, F.col("prev_entries"))).alias("entries_before"),
    )


def spaced_name(c: str | Column) -> Column:
    return F.upper(F.regexp_replace(times.col(c), r"\s+", " "))


def unique_name_resolution(drops: DataFrame, products: DataFrame, sales: DataFrame) -> DataFrame:
    """Dropped names with their code when exactly one code carries the name."""
    names = (
        products.select(spaced_name("name").alias("name"), F.col("csc").alias("code"))
        .unionByName(sales.select(spaced_name("item_name").alias("name"), F.col("item_code").alias("code")))
        .groupBy("name")
        .agg(F.countDistinct("code").alias("codes"), F.min("code").alias("code"))
    )
    per_date = drops.groupBy(spaced_name("product_name").alias("name"), "drop_date").agg(
        F.sum(F.coalesce("bottle_qty", F.lit(0))).alias("bottles")
    )
    d = per_date.groupBy("name").agg(
        F.count("*").alias("drops"),
        F.sum("bottles").alias("total_bottles"),
        F.max("bottles").alias("largest_drop"),
        times.text(F.min("drop_date")).alias("first_drop"),
        times.text(F.max("drop_date")).alias("last_drop"),
    )
    return d.join(names, "name", "left").select(
        "name",
        F.when(F.col("codes") == 1, F.col("code")).alias("code"),
        F.coalesce("codes", F.lit(0)).alias("codes"),
        "drops",
        "total_bottles",
        "largest_drop",
        "first_drop",
        "last_drop",
    )


def watched_months(days: DataFrame, sales: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Report months with enough observed days."""
    months = (
        days.groupBy(F.to_date(F.date_trunc("month", "d")).alias("period_month"))
        .agg(F.count("*").alias("days"))
        .where(F.col("days") >= th.watched_days)
    )
    return months.join(sales.select("period_month").distinct(), "period_month", "left_semi")


def assess_universe(stock: DataFrame, history: DataFrame, trailing: DataFrame, draws: DataFrame) -> DataFrame:
    """Listed keys plus unlisted codes with recent sales or a drawing."""
    sold = history.select(
        F.col("item_code").alias("csc"), "names", "class_name", F.col("status").alias("s_status"), "item_name"
    ).join(trailing.withColumnRenamed("item_code", "csc"), "csc", "left")
    drawn = draws.select(F.col("item_code").alias("csc")).distinct().withColumn("drawn", F.lit(True))
    listed = stock.withColumn("listed", F.lit(True))
    both = listed.join(sold, "csc", "full_outer").join(drawn, "csc", "left")
    keep = F.col("listed").isNotNull() | (F.col("bottles12") > 0) | F.col("drawn")
    return both.where(keep).select(
        "csc",
        F.coalesce("listed", F.lit(False)).alias("listed"),
        F.coalesce("name", "item_name").alias("name"),
        F.coalesce("class_name", "category").alias("class_name"),
        F.when(F.col("listed"), F.col("status")).otherwise(F.col("s_status")).alias("status"),
        F.coalesce("names", F.lit(0)).alias("names"),
        "observed_days",
        "in_stock_days",
        "sellouts",
        "stores_now",
        "store_days",
        "typical_stores",
        "stores_low",
        "stores_high",
        F.coalesce("record_months12", F.lit(0)).alias("record_months12"),
        F.coalesce("bottles12", F.lit(0)).alias("bottles12"),
    )


def classify_rarity(
    universe: DataFrame,
    drawing: DataFrame,
    drops: DataFrame,
    watched_sales: DataFrame,
    seasonal: DataFrame,
    holiday_observed: Column,
    th: Thresholds = DEFAULTS,
) -> DataFrame:
    """The rating: ordered rules over shelf, sales, drawing and drop evidence.

    ``drawing``: latest_drawing; ``drops``: resolved drops; ``watched_sales``:
    (item_code, watched_sold), sales months while watched. One pass of column
    expressions after equi-joins on the code; publishing is gated at the end.
    """
    u = (
        universe.join(
            drawing.select(F.col("item_code").alias("csc"), "drawing", F.col("bottles").alias("draw_bottles"), F.col("entries").alias("draw_entries")),
            "csc",
            "left",
        )
        .join(
            drops.where("code is not null").select(
                F.col("code").alias("csc"), F.col("total_bottles").alias("drop_bottles"), F.col("drops").alias("drop_count"),
                "first_drop", "last_drop",
            ),
            "csc",
            "left",
        )
        .join(watched_sales.select(F.col("item_code").alias("csc"), "watched_sold"), "csc", "left")
        .join(seasonal.select(F.col("item_code").alias("csc"), "seasonal"), "csc", "left")
        .withColumn("__holiday_seen", holiday_observed)
    )
    observed = F.coalesce("observed_days", F.lit(0))
    share = F.col("in_stock_days") / F.expr("nullif(observed_days, 0)")
    holiday_item = F.coalesce(F.col("seasonal").rlike("holiday product|Nov-Dec"), F.lit(False))
    u = (
        u.withColumn("share", share)
        .withColumn("in_season", ~holiday_item | F.col("__holiday_seen"))
        .withColumn("enough", F.col("listed") & (observed >= th.min_observed_days) & F.col("in_season"))
        .withColumn("stores_known", F.coalesce((F.col("store_days") >= th.min_store_days) & F.col("typical_stores").isNotNull(), F.lit(False)))
        .withColumn("allocated", F.col("drop_bottles").isNotNull() & ~(F.col("enough") & F.coalesce(F.col("share") >= th.shelf_decides, F.lit(False))))
    )
    seen = (F.coalesce("in_stock_days", F.lit(0)) > 0) & (
        (F.coalesce("sellouts", F.lit(0)) > 0) | (F.coalesce("watched_sold", F.lit(0)) > 0)
    )
    label = (
        F.when(F.col("drawing").isNotNull(), "Drawing")
        .when(F.col("status") == "S", "Special order")
        .when(F.col("status").isin(WINDING_DOWN), "Being discontinued")
        .when(F.col("allocated"), "Allocated release")
        .when(~F.col("listed"), "Facts only")
        .when(~F.col("in_season"), "Not observed in season")
        .when(~F.col("enough"), "Facts only")
        .when((F.col("share") >= th.consistently) & ~F.col("stores_known"), "Facts only")
        .when((F.col("share") >= th.consistently) & (F.col("typical_stores") >= th.wide_stores), "Widely available")
        .when(F.col("share") >= th.consistently, "Usually at a few stores")
        .when(F.col("share") >= th.hard_to_find, "Intermittently available")
        .when(seen, "Hard to find")
        .otherwise("Facts only")
    )
    rare_drop = (
        (F.col("record_months12") >= th.established_months)
        & (F.col("bottles12") > 0)
        & (~F.col("enough") | (F.col("share") < th.hard_to_find))
        & (F.col("drop_bottles") <= th.rare_drop_bottles)
        & (F.col("bottles12") <= th.rare_max_sales)
    )
    u = u.withColumn("label", label)
    tier = (
        F.when((F.col("label") == "Drawing") & (F.col("draw_bottles") <= th.unicorn_bottles), "unicorn")
        .when(F.col("label") == "Drawing", "rare")
        .when((F.col("label") == "Allocated release") & rare_drop, "rare")
        .when(F.col("label").isin("Allocated release", "Hard to find"), "scarce")
        .when(F.col("label") == "Widely available", "everyday")
        .when(F.col("label").isin("Usually at a few stores", "Intermittently available"), "uncommon")
    )
    shelf = (
        F.when(F.col("enough") & (observed >= th.high_observed_days) & F.col("stores_known"), "high")
        .when(F.col("enough") & F.col("stores_known"), "medium")
        .otherwise("low")
    )
    u = u.withColumn("tier", tier)
    confidence = (
        F.when(F.col("tier").isNull(), F.lit(None))
        .when(F.col("label") == "Drawing", "high")
        .when((F.col("label") == "Allocated release") & (F.col("bottles12") == 0), "low")
        .when(F.col("label") == "Allocated release", F.when(F.col("enough") | ~F.col("listed"), "high").otherwise("medium"))
        .otherwise(shelf)
    )
    headline = (
        F.when(F.col("label") == "Drawing", "Released through a drawing")
        .when(F.col("label") == "Allocated release", "Released through allocated drops")
        .when(F.col("label") == "Not observed in season", "Seasonal")
        .when((F.col("label") == "Facts only") & ~F.col("listed"), "Not currently listed")
        .when(F.col("label") == "Facts only", "Not rated yet")
        .otherwise(F.col("label"))
    )
    return publish_gate(with_reasons(u.withColumn("confidence", confidence).withColumn("headline", headline), th))


def _plain(x: Column) -> Column:
    """A number to one place, whole ones without it."""
    return F.regexp_replace(F.round(x, 1).cast("string"), r"\.0$", "")


def with_reasons(rated: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Adds the ``reason`` of each rating, with the numbers it rests on, and the
    ``explanation`` a shopper reads."""

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts])

    def when(condition: Column, *parts: str | Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), text(*parts)).otherwise("")

    def many(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))

    c = F.col
    label, of_days = c("label"), F.concat(F.floor(100 * c("share") + 0.5).cast("string"), F.lit("%"))
    in_stock = F.concat(F.lit("in stock "), of_days)
    stores, usual = _plain(c("typical_stores")), F.floor(c("typical_stores") + 0.5)
    dropped = when(c("drop_bottles").isNotNull(), " (also in allocated drops)")
    few, watched = label == "Usually at a few stores", F.coalesce("watched_sold", F.lit(0))
    facts = label == "Facts only"
    no_stores = facts & (c("share") >= th.consistently)
    reason = (
        F.when(label == "Drawing", text("latest drawing ", c("draw_bottles"), " bottles (", F.when(c("tier") == "unicorn", "at most ").otherwise("over "), f"{th.unicorn_bottles})"))
        .when(label.isin("Special order", "Being discontinued"), text("status ", c("status")))
        .when((label == "Allocated release") & (c("bottles12") == 0), text("newly observed: drops total ", c("drop_bottles"), " bottles, no recorded sales yet"))
        .when(
            label == "Allocated release",
            text("drops total ", c("drop_bottles"), " bottles, sales ", c("bottles12"), " in 12 months over ", c("record_months12"), " months, ", F.when(c("enough"), in_stock).otherwise("shelf data thin"), ": ", c("tier")),
        )
        .when(facts & ~c("listed"), F.lit("not in the current catalog; no drawing or drop"))
        .when(label == "Not observed in season", text("holiday product; no observed November or December day (", c("seasonal"), ")"))
        .when(facts & ~c("enough"), text("only ", F.coalesce("observed_days", F.lit(0)), " observed days"))
        .when(no_stores, text(in_stock, ", store coverage unknown"))
        .when(label == "Widely available", text(in_stock, ", typically ", stores, " stores", dropped))
        .when(few, text(in_stock, ", typically ", stores, " stores (range ", c("stores_low"), "-", c("stores_high"), ")", dropped))
        .when(label == "Intermittently available", text(in_stock, dropped))
        .when(
            label == "Hard to find",
            text(in_stock, when(c("sellouts") > 0, ", ", c("sellouts"), " sellouts"), when(watched > 0, ", sales in ", watched, " watched months"), dropped),
        )
        .otherwise(text(in_stock, F.when(c("in_stock_days") == 0, "; never seen in stock").otherwise("; no sellout or sales while watched")))
    )
    explanation = (
        F.when(label == "Drawing", text(F.coalesce(many(c("draw_bottles"), "bottle"), F.lit("A few bottles")), " in this drawing (", F.initcap("drawing"), "), not all that came in."))
        .when(label == "Special order", F.lit("Ordered on request, not kept on shelves."))
        .when(label == "Being discontinued", F.lit("It is being phased out."))
        .when((label == "Allocated release") & (c("bottles12") == 0), F.lit("New in allocated drops; without sales it is not rated."))
        .when((label == "Allocated release") & (c("tier") == "rare"), text("Only ", F.format_number("drop_bottles", 0), " bottles came with allocated drops, and shelves rarely have it."))
        .when(label == "Allocated release", text("Sold through monthly allocated drops", when(c("enough"), " and on shelves on ", of_days, " of the days checked"), "."))
        .when(facts & ~c("listed"), F.lit("It is not listed now."))
        .when(label == "Not observed in season", F.lit("No full season of it has been watched."))
        .when(facts & ~c("enough"), F.lit("It has not been watched long enough."))
        .when(no_stores, F.lit("More checks of single stores are needed."))
        .when(label == "Widely available", text("In stock on most days checked, usually at about ", usual, " stores."))
        .when(few & (c("stores_high") >= th.wide_stores), text("At a few stores between wider restocks (", c("stores_low"), "-", c("stores_high"), " stores)."))
        .when(few, text("In stock on most days checked, but usually at only ", many(usual, "store"), "."))
        .when(label == "Intermittently available", text("In stock somewhere on ", of_days, " of the days checked."))
        .when(label == "Hard to find", text("In stock somewhere on only ", of_days, " of the days checked", when(c("sellouts") > 0, ", and seen to sell out"), "."))
        .otherwise(F.lit("It is seldom or never seen on shelves."))
    )
    return rated.withColumn("reason", reason).withColumn("explanation", explanation)


def publish_gate(rated: DataFrame) -> DataFrame:
    """A tier is published unless one code carries several names (claims of
    scarcity only) or the confidence is low."""
    reused = (F.col("names") > 1) & F.col("tier").isin("scarce", "rare", "unicorn")
    blocked = (
        F.when(F.col("tier").isNull(), F.lit(None))
        .when(reused, F.concat(F.lit("code covers "), F.col("names").cast("string"), F.lit(" names")))
        .when(F.col("confidence") == "low", "low confidence")
    )
    return rated.withColumn("blocked_by", blocked).withColumn(
        "published", F.col("tier").isNotNull() & F.col("blocked_by").isNull()
    )


def evidence_facts(rated: DataFrame) -> DataFrame:
    """Display facts per code, each with its numbers, in a fixed order."""

    def n(c: str) -> Column:
        return F.format_number(F.col(c), 0)

    typical = F.floor(F.col("typical_stores") + 0.5).cast("bigint")
    span = F.when(
        F.col("stores_high") > F.col("stores_low"),
        F.concat(F.lit(" (range "), F.col("stores_low").cast("string"), F.lit("-"), F.col("stores_high").cast("string"), F.lit(")")),
    ).otherwise("")
    epb = F.floor(F.col("draw_entries") / F.expr("nullif(draw_bottles, 0)") + 0.5)
    facts = F.array(
        F.when(
            F.col("drawing").isNotNull(),
            F.concat(
                F.lit("Drawing ("), "drawing", F.lit("): "), n("draw_bottles"), F.lit(" bottles, "), n("draw_entries"),
                F.lit(" entries, about "), F.format_number(epb, 0), F.lit(" per bottle"),
            ),
        ),
        F.when(
            F.col("drop_bottles").isNotNull(),
            F.concat(
                F.lit("In "), F.col("drop_count").cast("string"), F.when(F.col("drop_count") == 1, " drop").otherwise(" drops"),
                F.lit(" since "), "first_drop", F.lit(": "), n("drop_bottles"), F.lit(" bottles (last "), "last_drop", F.lit(")"),
            ),
        ),
        F.when(
            F.col("observed_days") > 0,
            F.concat(
                F.lit("In stock on "), F.col("in_stock_days").cast("string"), F.lit(" of "),
                F.col("observed_days").cast("string"), F.lit(" days checked"),
            ),
        ),
        F.when(
            F.col("stores_known") & (F.col("observed_days") > 0),
            F.concat(F.lit("Usually at "), typical.cast("string"), F.when(typical == 1, " store").otherwise(" stores"), span),
        ),
        F.when(F.col("bottles12") > 0, F.concat(n("bottles12"), F.lit(" bottles sold in 12 months"))).otherwise(
            "No sales recorded in 12 months"
        ),
    )
    return rated.select("csc", F.array_compact(facts).alias("evidence"))


def override_resolve(rated: DataFrame, overrides: DataFrame) -> DataFrame:
    """The tier to show: a manual row wins and a manual null hides."""
    manual = overrides.select("csc", F.col("tier").alias("o_tier"), F.lit(True).alias("manual"))
    return (
        rated.join(manual, "csc", "left")
        .withColumn("shown_tier", F.when(F.col("manual"), F.col("o_tier")).when(F.col("published"), F.col("tier")))
        .drop("o_tier")
        .withColumn("manual", F.coalesce("manual", F.lit(False)))
    )


def tier_counts(rated: DataFrame) -> DataFrame:
    state = F.when(F.col("published"), "published").when(F.col("tier").isNotNull(), "blocked").otherwise("no badge")
    return rated.groupBy("label", F.coalesce("tier", F.lit("none")).alias("tier"), state.alias("state")).agg(
        F.count("*").alias("codes")
    )


def review_flags(rated: DataFrame, many_sold: int = 1000, many_stores: int = 10) -> DataFrame:
    """Contradictions to look at, counted in one pass."""
    scarce = F.col("tier").isin("scarce", "rare", "unicorn")
    flags = F.array_compact(
        F.array(
            F.when(F.col("published") & F.col("tier").isin("everyday", "uncommon") & ((F.col("status") == "A") | F.col("class_name").rlike("(?i)ALLOCATED")), "common but allocated"),
            F.when(F.col("published") & scarce & (F.col("bottles12") >= many_sold), "scarce but many sold"),
            F.when(F.col("published") & scarce & (F.coalesce("stores_now", F.lit(0)) >= many_stores), "scarce but at many stores"),
            F.when(scarce & F.col("blocked_by").startswith("code covers"), "reused code"),
        )
    )
    return rated.select("csc", F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("codes"))


def hash_sample(rows: DataFrame, group: str, key: str, n: int = 12) -> DataFrame:
    """The same ``n`` keys of each group on every run, in hash order."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(F.col(group), F.col(key))), key)
    return rows.select(group, key, F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def price_percentile(products: DataFrame, width: float = 25.0) -> DataFrame:
    """Percent rank of the price within the category, two places."""
    priced = products.where("current_price is not null and category is not null").select("csc", "category", "current_price")
    ranked = skew.percent_rank(priced, ["category"], "current_price", "r", width)
    return ranked.select("csc", "category", F.round(F.col("r") * 100, 2).alias("price_percentile"))
