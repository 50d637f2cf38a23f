"""Recommendations by threshold over an index of items, without meeting every item.

How well an item suits a request depends on few things: its attributes, how they are known, and
whether it is near. Items that agree in these are a class. The index holds the ``classes``, the
``items`` of each class in bands of price, and a ``head`` for each class and band: the number of
items, their least and greatest price, and the first few in order.

A request is scored against classes, with numbers only. Heads are taken in the order of their
classes; those behind ``most`` items that are sure to be eligible cannot bring one into the list
and are not opened. A head gives its first items; only the one band that a request's least price
cuts is read in full. Sentences are written for the items of the list and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_folder
from .taste import Request, evidence_count, evidence_score, request_table

BANDS = 64
_CLASS = (
    "grp", "sweetness", "body", "tags", "fizz", "less_common", "rarity_tier", "grapes", "evidence_count", "near_area", "near_stores", "checked_recently",
)


def _bare(a: Column) -> Column:
    """An attribute without the words that only a sentence needs."""
    none = F.lit(None).cast("string")
    return F.struct(a["value"].alias("value"), a["evidence"].alias("evidence"), none.alias("source"), none.alias("quote"), a["confidence"].alias("confidence"), none.alias("note"))


@dataclass
class PickIndex:
    profiles: DataFrame
    classes: DataFrame
    items: DataFrame
    heads: DataFrame
    key: str
    most: int

    @classmethod
    def build(cls, profiles: DataFrame, key: str = "key", most: int = 6, folder: str | None = None) -> PickIndex:
        """``profiles`` carry grp, price, near_area, near_stores, checked_recently, less_common,
        rarity_tier and excluded; one row a key. The tables are written below ``folder``."""
        folder = folder or f"{shared_folder(profiles.sparkSession)}/picks-{uuid.uuid4().hex}"

        def stored(df: DataFrame, what: str) -> DataFrame:
            df.write.parquet(f"{folder}/{what}")
            return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{what}")

        usable = profiles.where("not excluded").where(F.col("price").isNotNull())
        parts = {
            "grp": F.coalesce("grp", F.lit("")),
            "sweetness": _bare(F.col("sweetness")),
            "body": _bare(F.col("body")),
            "tags": F.transform("tags", _bare),
            "fizz": _bare(F.col("fizz")),
            "less_common": F.when(F.col("less_common").isNotNull(), F.lit("")),
            "rarity_tier": F.col("rarity_tier"),
            "grapes": F.transform("grapes.value", lambda x: F.lower(x)),
            "evidence_count": evidence_count(),
            "near_area": F.col("near_area"),
            "near_stores": F.col("near_stores"),
            "checked_recently": F.col("checked_recently"),
        }
        named = usable.select(F.col(key).alias("key"), "price", F.struct(*[c.alias(n) for n, c in parts.items()]).alias("c"))
        named = stored(named.withColumn("class_id", F.unhex(F.md5(F.to_json("c").cast("binary")))), "named")
        classes = stored(named.groupBy("class_id").agg(F.first("c").alias("c")).select("class_id", "c.*"), "classes")
        edges = named.agg(F.percentile_approx("price", [i / BANDS for i in range(1, BANDS)], 10_000)).first()[0] or []
        cuts = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]).cast("array<double>")
        items = stored(named.select("class_id", F.size(F.filter(cuts, lambda e: e < F.col("price"))).alias("band"), "price", "key"), "items")
        in_order = Window.partitionBy("class_id", "band").orderBy("price", "key")
        first = items.withColumn("i", F.row_number().over(in_order)).where(F.col("i") <= most).groupBy("class_id", "band")
        first = first.agg(F.sort_array(F.collect_list(F.struct("price", "key"))).alias("first"))
        sizes = items.groupBy("class_id", "band").agg(F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"))
        return cls(profiles, classes, items, stored(sizes.join(first, ["class_id", "band"]), "heads"), key, most)

    def scored(self, requests: DataFrame | Sequence[Request]) -> DataFrame:
        """Each request against the classes of its group: q (the request), class_id, points,
        contradicted, unknowns, supports, wishes, near (in its area), level (its place in order)."""
        if not isinstance(requests, DataFrame):
            requests = request_table(self.profiles.sparkSession, requests)
        groups = self.classes.agg(F.collect_set("grp")).scalar()
        asked = requests.select(F.struct(*requests.columns).alias("q"))
        asked = asked.withColumn("grp", F.explode(F.when(F.col("q.type").isNull(), groups).otherwise(F.array(F.col("q.type")))))
        q = F.col("q")
        points, against, unknowns, parts = evidence_score(q)
        grape = q["grape"].isNull() | F.coalesce(F.array_contains("grapes", F.lower(q["grape"])), F.lit(False))
        near = F.coalesce((F.col("near_area") == q["area"]) & (F.col("near_stores") > 0), F.lit(False))
        wishes = q["sweet"].isNotNull() | q["body"].isNotNull() | (F.coalesce(F.size(q["tags"]), F.lit(0)) > 0) | q["novelty"].isNotNull()
        return self.classes.join(asked, "grp").where(grape).select(
            "q", "class_id", F.round(points, 6).alias("points"), F.coalesce(against, F.lit(False)).alias("contradicted"), unknowns.alias("unknowns"),
            F.size(parts).alias("supports"), wishes.alias("wishes"), near.alias("near"), "checked_recently", "evidence_count",
            F.when(q["area"].isNotNull(), F.col("near_stores")).otherwise(0).alias("near_stores"),
        )


def _in_price(price: str = "price") -> Column:
    q = F.col("q")
    return (q["max_price"].isNull() | (F.col(price) <= q["max_price"])) & (q["min_price"].isNull() | (F.col(price) >= q["min_price"]))


def _whole() -> Column:
    """All items of a head are within the request's prices."""
    return _in_price("lo") & _in_price("hi")


def _touched() -> Column:
    q = F.col("q")
    return (q["max_price"].isNull() | (F.col("lo") <= q["max_price"])) & (q["min_price"].isNull() | (F.col("hi") >= q["min_price"]))


def scores(index: PickIndex, requests: DataFrame | Sequence[Request]) -> DataFrame:
    """request, key, points, contradicted of every item a request may show: computed by class,
    and dealt out to its items."""
    met = index.scored(requests).join(index.items, "class_id").where(_in_price())
    return met.select(F.col("q.id").alias("request"), F.col("key").alias(index.key), "points", "contradicted")


def recommend(index: PickIndex, requests: DataFrame | Sequence[Request]) -> DataFrame:
    """The best supported ``index.most`` items of each request.

    Nothing its own listing contradicts is shown, and a wish needs some support."""
    most = index.most
    fit = index.scored(requests).where(F.col("q.area").isNull() | F.col("near"))
    fit = fit.where(~F.col("wishes") | ((F.col("points") > 0) & ~F.col("contradicted")))
    order = [F.col("points").desc(), F.col("near_stores").desc(), F.col("evidence_count").desc()]
    request = F.col("q.id")
    heads = fit.join(index.heads, "class_id").where(_touched()).withColumn("request", request)
    # Items that are sure to stand in front: those of whole heads of better classes.
    level = ["request", "points", "near_stores", "evidence_count"]
    sure = heads.groupBy(*level).agg(F.sum(F.when(_whole(), F.col("n")).otherwise(0)).alias("sure"))
    front = Window.partitionBy("request").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    opened = sure.withColumn("front", F.coalesce(F.sum("sure").over(front), F.lit(0))).where(F.col("front") < most).drop("sure", "front")
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"o.{c}")) for c in level]
    heads = heads.alias("h").join(opened.alias("o"), same).select("h.*")
    cut = F.coalesce(F.col("lo") < F.col("q.min_price"), F.lit(False))
    listed = heads.where(~cut).withColumn("x", F.explode("first")).select("*", "x.price", "x.key")
    read = heads.where(cut).join(index.items, ["class_id", "band"])
    columns = ["request", "q", "points", "near_stores", "evidence_count", "unknowns", "price", "key"]
    found = listed.select(columns).unionByName(read.select(columns)).where(_in_price())
    ranked = Window.partitionBy("request").orderBy(*order, F.col("price"), F.col("key"))
    # A few rows a request: from here on whole profiles may be read.
    best = found.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= most)
    profiles = index.profiles.withColumnRenamed(index.key, "key").drop("price")
    parts = evidence_score(F.col("q"))[3]
    first = F.get(F.array_sort(parts, lambda a, b: F.when(a["points"] > b["points"], -1).when(a["points"] < b["points"], 1).otherwise(0)), F.lit(0))
    return best.join(profiles.drop("request", "q", "points", "near_stores", "evidence_count", "unknowns", "place"), "key").select(
        "request", "place", F.col("key").alias(index.key), "points", "price", "unknowns", first["reason"].alias("reason")
    )


def eligibility_counts(index: PickIndex, requests: DataFrame | Sequence[Request]) -> DataFrame:
    """Per request: eligible, not near, unknown near, and without information. Whole heads are
    counted by their numbers, those that a price cuts by their items."""
    heads = index.scored(requests).join(index.heads, "class_id").where(_touched())
    whole = heads.where(_whole()).select("q", "class_id", "n", "near", "checked_recently", "wishes", "supports")
    read = heads.where(~_whole()).drop("n").join(index.items, ["class_id", "band"]).where(_in_price())
    rows = whole.unionByName(read.select("q", "class_id", F.lit(1).cast("long").alias("n"), "near", "checked_recently", "wishes", "supports"))
    asked, near = F.col("q.area").isNotNull(), F.col("near")
    here = ~asked | near

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0))

    return rows.groupBy(F.col("q.id").alias("request")).agg(
        total(here).alias("eligible"),
        total(asked & ~near & ~F.col("checked_recently")).alias("unknown_near"),
        total(asked & ~near & F.col("checked_recently")).alias("not_near"),
        total(here & F.col("wishes") & (F.col("supports") == 0)).alias("no_info"),
    )
