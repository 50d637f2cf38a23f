"""Continuous rules over files that are not in order of event time."""

import os
import uuid
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stockline.streaming import live, ordered


DAYS = [(0, 0.0), (5, 2.0), (2, 3.0), (1, 0.0), (4, 0.0), (3, 0.0)]


def put(spark, folder, days, first=0):
    """A file for each of one key's daily rows, read in the order they are given."""
    for n, (d, qty) in enumerate(days, first):
        row = (d, datetime(2024, 1, 1) + timedelta(days=d), 1, "view", qty, '{"k": 1}')
        file = spark.createDataFrame([row], live.EVENTS).toPandas()
        file["ts"] = file["ts"].astype("datetime64[us]")
        path = folder / f"events{n}.parquet"
        file.to_parquet(path)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def read(spark, folder):
    return live.read_events(spark, str(folder), files_per_batch=1)


def obs(events):
    qty = F.col("value").cast("int")
    return events.select(F.col("user_id").cast("string").alias("csc"), F.lit(7).alias("store_id"), F.col("ts").alias("seen_at"), F.col("event_id").alias("seq"), qty.alias("store_qty"), qty.alias("qty"), F.lit(5.0).alias("price"))


def changes(spark, folder, **more):
    out = ordered.change_events(obs(read(spark, folder)).select("csc", "seen_at", "seq", "store_qty", "price"), max_gap_hours=90 * 24, **more)
    return rows(out.select((F.col("event_id") / 8).cast("int"), "event_type", "created_at"))


def dated(want):
    return sorted(((d, kind, datetime(2024, 1, 1) + timedelta(days=d)) for d, kind in want), key=repr)


def test_changes_over_shuffled_files(spark, tmp_path):
    put(spark, tmp_path, DAYS)
    assert changes(spark, tmp_path, ended=True) == dated([(0, "new_product"), (2, "restock"), (3, "out_of_stock"), (5, "restock")])


def test_restocks_over_shuffled_files(spark, tmp_path):
    put(spark, tmp_path, DAYS)
    out = ordered.store_restocks(obs(read(spark, tmp_path)).select("csc", "store_id", "seen_at", "seq", "qty"), ended=True)
    assert rows(out.select((F.col("event_id") / 8).cast("int"), "qty")) == [(2, 3), (5, 2)]


def test_a_run_goes_on_and_its_end_moves_nothing(spark, tmp_path):
    run = uuid.uuid4().hex
    put(spark, tmp_path, DAYS[:3])
    assert changes(spark, tmp_path, run=run) == []  # all within the 7 days that rows may be late
    assert changes(spark, tmp_path, run=run, ended=True) == dated([(0, "new_product"), (2, "restock")])
    put(spark, tmp_path, DAYS[3:], 3)  # older than rows that were shown at the end
    all_ = dated([(0, "new_product"), (2, "restock"), (3, "out_of_stock"), (5, "restock")])
    assert changes(spark, tmp_path, run=run, ended=True) == all_
    put(spark, tmp_path, [(12, 0.0), (10, 2.0), (70, 1.0)], 6)  # the last releases all before it
    assert changes(spark, tmp_path, run=run) == sorted(all_ + dated([(12, "out_of_stock")]), key=repr)
    put(spark, tmp_path, [(20, 5.0), (71, 1.0), (90, 0.0)], 9)  # day 20 is too late
    assert changes(spark, tmp_path, run=run, ended=True) == sorted(all_ + dated([(12, "out_of_stock"), (70, "restock"), (90, "out_of_stock")]), key=repr)


def test_a_repeated_batch_replaces_itself(spark, tmp_path, monkeypatch):
    """A step that fails behind its writes is made again and counts once, over a compacted log."""
    monkeypatch.setattr(ordered, "COMPACT", 2)
    data = [(0, 0.0), (20, 1.0), (40, 0.0), (60, 2.0), (80, 0.0), (100, 1.0)]
    put(spark, tmp_path, data)
    run = uuid.uuid4().hex
    step, failed = ordered.Ordered._step, []

    def once(self, batch, number):
        step(self, batch, number)
        if number == 3 and not failed:
            failed.append(number)
            raise RuntimeError("lost behind its writes")

    monkeypatch.setattr(ordered.Ordered, "_step", once)
    with pytest.raises(Exception, match="lost behind"):
        changes(spark, tmp_path, run=run)
    want = [(0, "new_product"), (20, "restock"), (40, "out_of_stock"), (60, "restock"), (80, "out_of_stock"), (100, "restock")]
    assert changes(spark, tmp_path, run=run, ended=True) == dated(want) and failed


def test_nothing_is_sent_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(spark, tmp_path / "in", DAYS)
    pairs = read(spark, tmp_path / "in").select("user_id", "event_id", "ts")
    ledger, run = str(tmp_path / "ledger"), uuid.uuid4().hex
    live.deliver(pairs, ledger, run)
    sent = rows(live.read_ledger(spark, ledger), "user_id", "event_id")
    assert sent == [(1, d) for d in range(6)]
    put(spark, tmp_path / "in", [(0, 0.0), (90, 1.0), (2, 3.0)], 6)  # two come back long after the newest
    live.deliver(read(spark, tmp_path / "in").select("user_id", "event_id", "ts"), ledger, run)
    live.deliver(read(spark, tmp_path / "in").select("user_id", "event_id", "ts"), ledger, uuid.uuid4().hex)  # all batches again
    assert rows(live.read_ledger(spark, ledger), "user_id", "event_id") == sorted([*sent, (1, 90)], key=repr)
