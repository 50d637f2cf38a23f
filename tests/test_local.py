"""What may be said about stock nearby."""

from pyspark.sql import functions as F

from stockline.operators import geo, sales, taste

from helpers import NOW, ago, rows

AREAS = "area string, lat double, lng double"
STORES = "id int, city string, lat double, lng double, is_club boolean"


def _answers(spark, held, catalog):
    areas = spark.createDataFrame([("here", 40.0, -111.0)], AREAS)
    stores = spark.createDataFrame([(1, "here", 40.01, -111.0, False), (2, "here", 40.02, -111.0, True), (3, "far", 45.0, -100.0, False)], STORES)
    near = geo.stores_within(areas, stores, 10.0, public=False)
    now = spark.createDataFrame(held, "csc string, store_id int, seen_at timestamp_ntz, qty int")
    cat = spark.createDataFrame(catalog, "csc string, store_qty int, last_seen timestamp_ntz, delisted_at timestamp_ntz")
    return dict(rows(geo.local_answer(near, stores, now, cat, areas, NOW), "csc", "verdict"))


def test_verdicts(spark):
    held = [
        ("fresh", 1, ago(3), 4), ("stale", 1, ago(40), 4), ("old", 1, ago(24 * 9), 4), ("club", 2, ago(3), 4), ("zero", 1, ago(3), 0),
        ("off", 1, ago(30), 20), ("none", 1, ago(30), 2), ("newer", 1, ago(1), 2),
    ]
    wide = [
        ("fresh", 9, ago(2), None), ("stale", 9, ago(2), None), ("old", 9, ago(2), None), ("club", 9, ago(5), None), ("zero", 9, ago(2), None),
        ("off", 14, ago(2), None), ("none", 0, ago(2), None), ("newer", 0, ago(5), None), ("never", 5, ago(2), None), ("gone", 5, ago(90), ago(1)),
    ]
    assert _answers(spark, held, wide) == {
        "fresh": "fresh-positive", "stale": "stale-positive", "old": "unknown", "club": "fresh-zero", "zero": "fresh-zero", "off": "disproved",
        "none": "statewide-zero", "newer": "fresh-positive", "never": "unknown", "gone": "delisted",
    }


def test_claims(spark):
    df = spark.createDataFrame(
        [(1, 20, 14, ago(3), ago(30)), (2, 14, 14, ago(3), ago(30)), (3, 20, 14, ago(6), ago(2)), (4, 5, None, ago(3), None), (5, 5, None, ago(3), ago(30))],
        "i int, held int, qty int, wide_at timestamp_ntz, at timestamp_ntz",
    )
    got = rows(
        df.select("i", geo.exceeds_statewide("held", "qty", "wide_at", "at"), geo.none_statewide_since("qty", "wide_at", "at"), geo.can_claim_none("at", NOW))
    )
    assert got == [(1, True, False, False), (2, False, False, False), (3, False, False, True), (4, False, False, False), (5, True, True, False)]


def test_cells_find_every_store_in_reach(spark):
    import random

    rng = random.Random(3)
    pts = [(f"a{i}", rng.uniform(-55, 55), rng.uniform(-170, 170)) for i in range(20)]
    st = [(i, "c", a[1] + rng.uniform(-1, 1), a[2] + rng.uniform(-1, 1), False) for i, a in enumerate(pts * 20)]
    areas, stores = spark.createDataFrame(pts, AREAS), spark.createDataFrame(st, STORES)
    got = rows(geo.stores_within(areas, stores, 50.0), "area", "id")
    d = geo.miles(F.col("a.lat"), F.col("a.lng"), F.col("s.lat"), F.col("s.lng"))
    want = rows(areas.alias("a").join(stores.alias("s"), d <= 50.0).select("area", "id"))
    assert got == want


def test_sales_months_unknown_is_not_zero(spark):
    from datetime import date

    s = "period_month date, item_code string, item_name string, class_name string, bottles int, dollars decimal(14,2), status string, line long"
    data = [(date(2024, m, 1), "x", "X", "C", 5, None, "1", m) for m in range(1, 13)]
    data += [(date(2024, 1, 1), "a", "A", "C", 10, None, "1", 20), (date(2024, 2, 1), "a", "A", "C", 0, None, "1", 21), (date(2024, 6, 1), "a", "A", "C", 8, None, "1", 22)]
    sold = spark.createDataFrame(data, s)
    row = sales.sales_trailing12(sold).where("item_code = 'a'").first()
    assert (row["record_months12"], row["sold_months12"], row["explicit_zero12"], row["not_in_report12"]) == (12, 2, 1, 9)
    assert sales.selling_runs(sold).where("item_code = 'a'").first()["runs"] == 2
    assert sales.month_pattern(sold).where("item_code = 'a'").first()["pattern"].startswith("10 0 . . . 8 .")


def test_trailing_months_without_a_row_for_each_month(spark):
    """A code's missing months are counted, not made; labels and months stand for the lines."""
    lines = [(f"2024-{m:02d}-01", c, f"{c} {m % 2}", "K", b, 1.0, "A", i) for i, (c, m, b) in enumerate(
        [("a", 1, 5), ("a", 3, 0), ("a", 3, 7), ("b", 2, 0), ("c", 4, 2), ("c", 4, 1), (None, 2, 3)])]
    sold = spark.createDataFrame(lines, "m string, item_code string, item_name string, class_name string, bottles int, dollars double, status string, line long")
    sold = sold.selectExpr("to_date(m) as period_month", "* except (m)")
    trailing = sales.sales_trailing12(sold)
    cols = ["item_code", "record_months12", "sold_months12", "not_in_report12", "explicit_zero12", "bottles12", "sold_share12", "top2_share12"]
    want = [("a", 4, 2, 2, 0, 12, 0.5, 1.0), ("b", 3, 0, 2, 1, 0, 0.0, None), ("c", 1, 1, 0, 0, 3, 1.0, 1.0), (None, 3, 0, 3, 0, 0, 0.0, None)]
    assert rows(trailing, *cols) == sorted(want, key=repr)
    first = spark.createDataFrame([("b", "2024-01-01"), ("d", "2024-03-01")], "item_code string, m string").selectExpr("item_code", "to_date(m) as catalog_month")
    got = rows(sales.sales_trailing12(sold, first).where("item_code in ('b', 'd')"), *cols)
    assert got == [("b", 4, 0, 3, 1, 0, 0.0, None), ("d", 2, 0, 2, 0, 0, 0.0, None)]
    assert "Generate" not in trailing._jdf.queryExecution().optimizedPlan().toString()
    months, labels = sales.sales_months(sold), sales.sales_labels(sold)
    assert rows(sales.sales_trailing12(months, months=months)) == rows(trailing)
    assert rows(sales.sales_history(labels, months)) == rows(sales.sales_history(sold))
    assert rows(sales.seasonality(labels, 1, months)) == rows(sales.seasonality(sold, 1))


def test_texts_are_dealt_out(spark):
    items = spark.createDataFrame([(1, "RED", "RED VARIETAL - MALBEC", "Dry.", False)], "key long, name string, category string, description string, generic boolean").coalesce(1)
    assert "RepartitionByExpression [key" in taste.attribute_extract(items)._jdf.queryExecution().optimizedPlan().toString()
