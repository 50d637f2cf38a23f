"""Distributed union-find: the components of links, in DataFrame functions only.

Each node carries the smallest node it has heard of. A round takes the smallest label of the
neighbours, tells it to the node's former label too, and then follows the label's own label, so
long paths join in few rounds. Nodes of a label that no link leaves are a whole component: they
take no part in later rounds, which read what is still open and not all nodes again. The minimum
is combined before the shuffle and the joins are plain equi-joins, whose hot keys Spark splits.
Rounds go on until nothing is open; each is cut off by a checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, component): the smallest node reachable. Nodes without a link
    to another are not listed."""
    both = links.filter("a <> b").select("a", "b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(both.distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    done = []
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        met = labels.join(heard.withColumnRenamed("a", "node"), "node")
        met = met.select("node", F.col("label").alias("was"), F.least("label", "low").alias("via"), F.expr("label <> low or label <> high").alias("open"))
        met = checkpointed(met)
        open_ = checkpointed(met.filter("open").select("was").distinct())
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, [*done, met.select("node", F.col("was").alias("component"))])
        done.append(met.join(open_, "was", "left_anti").select("node", F.col("was").alias("component")))
        met = met.join(open_, "was", "left_semi")
        told = met.select("node", "via").unionByName(met.select(F.col("was").alias("node"), "via")).groupBy("node").agg(F.min("via").alias("via"))
        up = met.select(F.col("node").alias("via"), F.col("via").alias("up"))
        labels = checkpointed(told.join(up, "via").select("node", F.least("via", "up").alias("label")))
        both = checkpointed(both.join(labels.select(F.col("node").alias("a")), "a", "left_semi"))
