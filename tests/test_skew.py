"""Bucketed windows give what plain windows give, also for one hot key."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Window, functions as F

from stockline.functions import skew

from helpers import rows


def _events(spark, n=600):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    data = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(8)}"
        data.append((key, start + timedelta(minutes=i * 37), i, rng.choice([None, 0, 1, 2, 5]), rng.random() * 100))
    return spark.createDataFrame(data, "key string, at timestamp_ntz, i int, v int, x double")


def test_neighbours_match_lag_and_lead(spark):
    df = _events(spark)
    w = Window.partitionBy("key").orderBy("at")
    want = df.select("i", F.lag("v").over(w).alias("p"), F.lead("at").over(w).alias("n"))
    got = skew.neighbours(df, ["key"], ["at"], F.to_date("at"), prev={"p": "v"}, next={"n": "at"}).select("i", "p", "n")
    assert rows(got) == rows(want)


def test_carry_matches_fill(spark):
    df = _events(spark)
    w = Window.partitionBy("key").orderBy("at")
    want = df.select(
        "i",
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("b"),
        F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("a"),
    )
    got = skew.carry(df, ["key"], ["at"], F.to_date("at"), back={"b": "v"}, ahead={"a": "v"}).select("i", "b", "a")
    assert rows(got) == rows(want)


def test_running_and_ntile(spark):
    df = _events(spark)
    w = Window.partitionBy("key").orderBy("at")
    want = df.select("i", F.row_number().over(w).alias("rn"), F.ntile(3).over(w).alias("t"))
    got = skew.running(df, ["key"], ["at"], F.to_date("at"), {"rn": F.lit(1)})
    got = skew.ntile(got, ["key"], ["at"], F.to_date("at"), 3, "t").select("i", F.col("rn").cast("int").alias("rn"), "t")
    assert rows(got) == rows(want)


def test_quantiles_match_numpy(spark):
    df = _events(spark)
    got = {r["key"]: r for r in skew.quantiles(df, ["key"], "x", {"m": 0.5, "p": 0.9}, width=7.0).collect()}
    data = df.toPandas()
    for key, part in data.groupby("key"):
        assert abs(got[key]["m"] - np.percentile(part["x"], 50)) < 1e-9
        assert abs(got[key]["p"] - np.percentile(part["x"], 90)) < 1e-9


def test_percent_rank(spark):
    df = _events(spark)
    w = Window.partitionBy("key").orderBy("v")
    want = df.where("v is not null").select("i", F.round(F.percent_rank().over(w), 9).alias("r"))
    got = skew.percent_rank(df.where("v is not null"), ["key"], "v", "r", 2.0).select("i", F.round("r", 9).alias("r"))
    assert rows(got) == rows(want)
