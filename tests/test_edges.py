"""Cases that once lost rows or gave wrong values."""

import math

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stockline.operators import geo, ingest, places, web
from stockline.sources import files

STORES = "id int, city string, county string, lat double, lng double, is_club boolean"


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return geo.EARTH_MILES * 2 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [10.0, 300.0, 5000.0])
def test_circles_close_over_the_date_line_and_the_poles(spark, radius):
    spots = [(lat, lng) for lat in (-89.95, -70, -20.01, 0, 45.3, 69.9, 70.02, 89.99) for lng in (-179.98, -90, 0.02, 0.2, 90, 179.99)]
    stores = spark.createDataFrame([(i, "c", "c", float(a), float(b), False) for i, (a, b) in enumerate(spots)], STORES)
    areas = spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(spots)], "area string, lat double, lng double")
    want = sorted((str(i), j) for i, (a, b) in enumerate(spots) for j, (c, d) in enumerate(spots) if haversine(a, b, c, d) <= radius)
    assert sorted(rows(geo.stores_within(areas, stores, radius), "area", "id")) == want


def test_far_points_find_their_nearest_stores(spark):
    stores = spark.createDataFrame([(i, "c", "c", 40.0, -110.0 - i, False) for i in range(5)], STORES)
    points = spark.createDataFrame([("near", 40.0, -110.0), ("far", -40.0, 70.0), ("mid", 30.0, -100.0)], "area string, lat double, lng double")
    got = rows(geo.nearest_stores(points, stores, 3), "area", "rank", "id")
    spots = {"near": (40.0, -110.0), "far": (-40.0, 70.0), "mid": (30.0, -100.0)}
    want = [(a, k + 1, i) for a, p in spots.items() for k, i in enumerate(sorted(range(5), key=lambda i: haversine(*p, 40.0, -110.0 - i))[:3])]
    assert sorted(got) == sorted(want)


def test_title_case(spark):
    names = ["COCA-COLA PUB", "O'NEIL/SMITH", "(THE BAR)", "THE BAR AT THE LAKE", "GRACIE'S", "Mixed BAR", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(places.title_case("n").alias("t"))
    assert [r.t for r in df.collect()] == ["Coca-Cola Pub", "O'neil/Smith", "(the Bar)", "The Bar at the Lake", "Gracie's", "Mixed BAR", "", None]


def test_long_addresses_keep_their_ends(spark):
    street = "7 " + " ".join(f"part{i}" for i in range(120))
    stores = spark.createDataFrame([(1, street + " one", "PROVO"), (2, street + " two", "PROVO")], "id int, address string, city string")
    typed = spark.createDataFrame([("8 " + street[2:] + " two, Provo",)], "text string")
    assert rows(places.address_store_match(typed, "text", stores), "store_id") == [(2,)]


def test_columns_that_do_not_add_up_fail(spark):
    body = '{"totalCount":2,"column":[{"nullIndex":[],"stringColumn":{"values":["a"]}}]}'
    answers = spark.createDataFrame([(1, ")]}'\n" + body)], "k int, body string")
    with pytest.raises(Exception, match="does not add up"):
        ingest.unpack_columnar(answers, "k", "body").collect()


def test_lists_that_differ_have_different_names(spark):
    def name(q, sort, lat=40.0, label="Near you"):
        pair = lambda k, v: F.struct(F.lit(k).alias("k"), F.lit(v).cast("string").alias("v"))
        area = F.lit(None).cast("struct<label:string,lat:double>") if label is None else F.struct(F.lit(label).alias("label"), F.lit(lat).alias("lat"))
        return web.list_identity("s", F.array(pair("q", q), pair("sort", sort)), area, F.lit(3))

    cases = [("a&sort=b", ""), ("a", "b"), ("a", ""), ("a", "", 41.0), ("a", "", 40.0, None), ("a", "", 40.0, "null")]
    df = spark.range(1).select(F.lit("x").alias("s")).select(*[name(*c).alias(f"n{i}") for i, c in enumerate(cases)], name(" a ", "").alias("same"))
    r = df.first()
    assert len({r[f"n{i}"] for i in range(len(cases))}) == len(cases) and r.same == r.n2


def test_month_hashes_hold_both_halves(spark):
    df = spark.sql("select date '2024-01-01' as period_month, id as line, cast(id as string) as item_code, 1 as bottles, 2.0 as dollars from range(5)")
    assert len(ingest.month_manifest(df).first().content_hash.split("-")) == 2


def test_a_failed_check_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert files.replace_table(spark.range(3), path) == 3
    with pytest.raises(ValueError, match="unchanged"):
        files.replace_table(spark.range(0), path)
    assert spark.read.parquet(path).count() == 3
    assert files.replace_table(spark.range(5), path) == 5 and spark.read.parquet(path).count() == 5
