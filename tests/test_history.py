from datetime import timedelta

from stockline.operators import alerts, history, ingest

from helpers import NOW, ago, rows


def _runs(spark, start, end, step_hours=8, skip=None):
    out, at = [], start
    while at <= end:
        if not (skip and skip[0] <= at < skip[1]):
            out.append(("catalog", at, at + timedelta(minutes=2), True))
        at += timedelta(hours=step_hours)
    return spark.createDataFrame(out, "job string, started_at timestamp_ntz, finished_at timestamp_ntz, ok boolean")


def _obs(spark, data):
    return spark.createDataFrame(
        [(c, at, i, q, p) for i, (c, at, q, p) in enumerate(data)],
        "csc string, seen_at timestamp_ntz, seq long, store_qty int, price double",
    )


def test_absence_is_confirmed_only_when_watched(spark):
    obs = _obs(
        spark,
        [
            ("watched", ago(24 * 60), 5, 20.0), ("watched", ago(24 * 50), 0, 20.0), ("watched", ago(24 * 3), 4, 20.0),
            ("first", ago(24 * 50), 0, 20.0), ("first", ago(24 * 3), 4, 20.0),
            ("short", ago(24 * 60), 5, 20.0), ("short", ago(24 * 10), 0, 20.0), ("short", ago(24 * 3), 4, 20.0),
        ],
    )
    runs = _runs(spark, ago(24 * 100), NOW)
    assert rows(history.returned_after_absence(obs, runs, NOW), "csc") == [("watched",)]
    outage = _runs(spark, ago(24 * 100), NOW, skip=(ago(24 * 30), ago(24 * 26)))
    assert rows(history.returned_after_absence(obs, outage, NOW), "csc") == []


def test_unbroken_since_restarts_after_outage(spark):
    runs = _runs(spark, ago(24 * 40), NOW, skip=(ago(24 * 20), ago(24 * 15)))
    since = history.unbroken_since(runs).first()["since"]
    assert ago(24 * 15) <= since <= ago(24 * 14)


def test_outage_ends_store_intervals(spark):
    runs = _runs(spark, ago(24 * 20), NOW, skip=(ago(24 * 10), ago(24 * 5)))
    store = spark.createDataFrame([("a", 1, ago(24 * 12), 3)], "csc string, store_id int, seen_at timestamp_ntz, qty int")
    t1 = history.outage_capped_intervals(store, runs).first()["t1"]
    assert t1 is not None and ago(24 * 10.5) <= t1 <= ago(24 * 9)


def test_days_before_first_check_are_unknown(spark):
    runs = _runs(spark, ago(24 * 6), NOW)
    days = history.observed_days(runs)
    obs = _obs(spark, [("a", ago(24 * 6), 5, 20.0)])
    store = spark.createDataFrame([("a", 1, ago(24 * 2), 3)], "csc string, store_id int, seen_at timestamp_ntz, qty int")
    grid = history.day_grid(history.state_intervals(obs), days, NOW)
    per = history.stores_per_day(grid, history.outage_capped_intervals(store, runs), days, store, NOW)
    assert grid.count() == days.count()
    assert 2 <= per.count() <= 3 and {r["stores"] for r in per.collect()} == {1}


def test_glitch_is_dropped_with_its_restock(spark):
    obs = _obs(spark, [("a", ago(10), 5, 20.0), ("a", ago(9), 0, 20.0), ("a", ago(8.5), 5, 20.0), ("a", ago(2), 0, 20.0)])
    assert ingest.repair_glitch(obs, 60).count() == 3
    kept = ingest.drop_false_restocks(ingest.change_events(obs), obs, 60)
    assert rows(kept.where("event_type = 'restock'")) == []


def test_store_restock_needs_a_recent_zero(spark):
    s = "csc string, store_id int, seen_at timestamp_ntz, seq long, qty int"
    obs = spark.createDataFrame(
        [("a", 1, ago(24 * 20), 1, 0), ("a", 1, ago(1), 2, 4), ("a", 2, ago(30), 3, 0), ("a", 2, ago(1), 4, 4), ("a", 3, ago(1), 5, 9)], s
    )
    assert rows(ingest.store_restock_events(obs), "store_id") == [(2,)]


def test_backoff_doubles_resets_and_clears(spark):
    checks = spark.createDataFrame(
        [("a", ago(9), True), ("a", ago(5), False), ("a", ago(4), False), ("b", ago(3), False), ("b", ago(2), True), ("c", ago(3), False)],
        "csc string, seen_at timestamp_ntz, ok boolean",
    )
    restock = spark.createDataFrame([("c", ago(1))], "csc string, created_at timestamp_ntz")
    got = {r["csc"]: r for r in alerts.failure_backoff(checks, restock).collect()}
    assert got["a"]["failures"] == 2 and got["a"]["retry_at"] == ago(4) + timedelta(hours=12)
    assert got["b"]["failures"] == 0 and got["b"]["retry_at"] is None
    assert got["c"]["failures"] == 1 and got["c"]["retry_at"] is None


def test_digest_skips_superseded_and_delivered(spark):
    e = "event_id long, csc string, event_type string, old string, new string, created_at timestamp_ntz"
    changes = spark.createDataFrame(
        [
            (1, "gone", "restock", None, None, ago(5)), (2, "gone", "out_of_stock", None, None, ago(2)),
            (3, "here", "restock", None, None, ago(5)), (4, "here", "price_change", None, None, ago(60)),
        ],
        e,
    )
    restocks = spark.createDataFrame([(9, "here", 7, ago(3)), (10, "here", 8, ago(3))], "event_id long, csc string, store_id int, created_at timestamp_ntz")
    watch = spark.createDataFrame([(1, "gone", ago(90)), (1, "here", ago(90)), (2, "here", ago(4))], "user_id long, csc string, created_at timestamp_ntz")
    homes = spark.createDataFrame([(1, 7)], "user_id long, store_id int")
    catalog = spark.createDataFrame([("gone", False), ("here", True)], "csc string, in_stock boolean")
    now = spark.createDataFrame([("here", 7, 2), ("here", 8, 0)], "csc string, store_id int, qty int")
    none = spark.createDataFrame([], "user_id long")
    sent = spark.createDataFrame([], "user_id long, event_id long")
    args = (changes, restocks, watch, homes, catalog, now, none)
    first = alerts.digest_match(*args, sent, NOW)
    assert rows(first, "user_id", "event_id") == [(1, 2), (1, 3), (1, 9)]
    again = alerts.digest_match(*args, first.select("user_id", "event_id"), NOW)
    assert again.count() == 0


def test_intents_fill_up_expire_and_repeat(spark):
    watch = spark.createDataFrame([(1, "a", ago(90))], "user_id long, csc string, created_at timestamp_ntz")
    products = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "csc string")
    asked = spark.createDataFrame(
        [(1, 1, "a", ago(5), True), (2, 1, "b", ago(4), True), (3, 1, "b", ago(3), True), (4, 1, "c", ago(2), True), (5, 1, "d", ago(30), True),
         (6, 1, "zz", ago(1), True), (7, 1, "d", ago(1), False)],
        "request_id long, user_id long, csc string, created_at timestamp_ntz, same_email boolean",
    )
    got = dict(rows(alerts.intent_reconcile(asked, watch, products, NOW, cap=2), "request_id", "status"))
    assert got == {1: "already", 2: "added", 3: "already", 4: "full", 5: "expired", 6: "not_found", 7: "mismatch"}
