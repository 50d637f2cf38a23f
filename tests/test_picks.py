"""The index of items against meeting every item."""

import random

from helpers import rows
from pyspark.sql import Window, functions as F

from stockline.operators import picks, taste as T

ATTR = "struct<value string, evidence string, source string, quote string, confidence string, note string>"
SCHEMA = (
    f"key long, price double, grp string, sweetness {ATTR}, body {ATTR}, fizz {ATTR}, region {ATTR}, tags array<{ATTR}>, "
    "grapes struct<value array<string>, evidence string, source string, quote string, confidence string, note string>, "
    "less_common string, rarity_tier string, near_area string, near_stores long, checked_recently boolean, excluded boolean"
)


def _attr(rng, values):
    v, kind = rng.choice([None, *values]), rng.choice([("product", "high"), ("product", "low"), ("style", "medium"), ("manual", "high")])
    return (v, kind[0] if v else "none", "name" if v else None, None, kind[1] if v else None, None)


def _profiles(spark, n, prices, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        grapes = rng.choice([None, ["Riesling"], ["Malbec", "Merlot"]])
        near = rng.choice([None, "A", "B"])
        common = rng.random() < 0.5  # half of all items are alike
        tags = [] if common else [_attr(rng, [x]) for x in ("crisp", "oaky") if rng.random() < 0.4]
        plain = (None, "none", None, None, None, None)
        out.append(
            (i, rng.choice(prices), rng.choice(["red", "white", None]), plain if common else _attr(rng, ["dry", "sweet"]), plain if common else _attr(rng, ["light", "full"]),
             (rng.choice(["still", "sparkling"]), "product", "category", None, "high", None), _attr(rng, ["Napa"]), [t for t in tags if t[0]],
             (grapes, "product" if grapes else "none", "name", None, "high", None), rng.choice([None, None, f"Less common {i}"]), rng.choice([None, "scarce", "rare"]),
             near, rng.choice([0, 1, 3]) if near else None, rng.random() < 0.5, rng.random() < 0.1)
        )
    return spark.createDataFrame(out, SCHEMA)


REQUESTS = [
    T.Request("all"), T.Request("dry", sweet="dry"), T.Request("cheap", max_price=11.0), T.Request("between", min_price=9.5, max_price=30.25, body="full"),
    T.Request("dear", min_price=31.0, type="red"), T.Request("near", area="A", tags=("crisp", "refreshing")), T.Request("far", area="C", sweet="sweet"),
    T.Request("grape", grape="riesling", novelty="ask"), T.Request("scarce", novelty="scarce", body="light", area="B", min_price=20.0), T.Request("none", type="beer"),
]


def test_lists_and_counts_are_those_of_meeting_every_item(spark):
    for seed, prices in ((1, [5.0 + k / 4 for k in range(200)]), (2, [9.99, 9.99, 9.99, 20.0, 31.0]), (3, [12.0])):
        p = _profiles(spark, 500, prices, seed)
        index = picks.PickIndex.build(p, most=4)
        q = F.col("q")
        points, against, unknowns, parts = T.evidence_score(q)
        met = p.where("not excluded").join(T.request_table(spark, REQUESTS).select(F.struct("*").alias("q")))
        met = met.where((q["type"].isNull() | (q["type"] == F.col("grp"))) & (q["grape"].isNull() | F.array_contains(F.transform("grapes.value", F.lower), F.lower(q["grape"]))))
        met = met.where((q["min_price"].isNull() | (F.col("price") >= q["min_price"])) & (q["max_price"].isNull() | (F.col("price") <= q["max_price"])))
        near = F.coalesce((F.col("near_area") == q["area"]) & (F.col("near_stores") > 0), F.lit(False))
        wishes = q["sweet"].isNotNull() | q["body"].isNotNull() | (F.size(q["tags"]) > 0) | q["novelty"].isNotNull()
        met = met.select(
            q["id"].alias("request"), "key", F.round(points, 6).alias("points"), F.coalesce(against, F.lit(False)).alias("against"), unknowns.alias("unknowns"), F.size(parts).alias("supports"),
            "price", T.evidence_count().alias("ev"), near.alias("near"), wishes.alias("wishes"), q["area"].isNotNull().alias("asked"), "near_stores", "checked_recently",
        ).cache()
        assert rows(picks.scores(index, REQUESTS)) == rows(met, "request", "key", "points", "against")
        w = Window.partitionBy("request").orderBy(F.desc("points"), F.when(F.col("asked"), F.col("near_stores")).otherwise(0).desc(), F.desc("ev"), "price", "key")
        want = met.where("(not asked or near) and (not wishes or (points > 0 and not against))").withColumn("place", F.row_number().over(w)).where("place <= 4")
        got = picks.recommend(index, REQUESTS)
        assert rows(got, "request", "place", "key", "points", "price", "unknowns") == rows(want, "request", "place", "key", "points", "price", "unknowns")
        assert got.where("reason is null and points > 0").count() == 0
        here = "(not asked or near)"
        counts = met.groupBy("request").agg(
            F.expr(f"count_if({here})"), F.expr("count_if(asked and not near and not checked_recently)"), F.expr("count_if(asked and not near and checked_recently)"),
            F.expr(f"count_if({here} and wishes and supports = 0)"),
        )
        assert rows(picks.eligibility_counts(index, REQUESTS)) == rows(counts)


def test_no_items_or_no_requests(spark):
    p = _profiles(spark, 20, [5.0], 4)
    assert picks.recommend(picks.PickIndex.build(p.limit(0)), REQUESTS).count() == 0
    assert picks.recommend(picks.PickIndex.build(p), T.request_table(spark, [])).count() == 0
