import re

from pyspark.sql import functions as F

from stockline.functions import clients, textkeys as k
from stockline.operators import feeds, ingest, places, search, taste
from stockline.sources import files, html

import pytest

from helpers import rows


def _one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f("t").alias("r")).first()["r"]


@pytest.mark.parametrize(
    "name,key",
    [
        ("BLANTON'S GOLD SBS BARREL 750ml", "blanton gold sbs barrel 750 ml"),
        ("E.H. TAYLOR STRAIGHT RYE", "eh taylor straight rye"),
        ("E H TAYLOR SMALL BATCH", "eh taylor small batch"),
        ("WELLER 12YR", "weller 12 yr"),
        ("TITOS HANDMADE VODKA 1.75L", "titos handmade vodka 1.75 l"),
        ("josh cab", "josh cabernet"),
        ("", ""),
        (None, ""),
    ],
)
def test_search_key(spark, name, key):
    assert _one(spark, name, k.search_key) == key


def test_query_tokens(spark):
    def raws(q):
        return [t["raw"] for t in _one(spark, q, k.query_tokens)]

    assert _one(spark, "Weller's", k.query_tokens)[0]["alts"] == ["wellers", "weller"]
    assert _one(spark, "titos", k.query_tokens)[0]["alts"] == ["titos"]
    assert raws("weller 12 year old") == ["weller", "12", "yr"]
    assert raws("old forester") == ["old", "forester"]
    assert raws("  !!  ") == []


def test_categories(spark):
    def pair(c):
        return _one(spark, c, k.category_group), _one(spark, c, k.subcategory_label)

    assert pair("VODKA - IMPORTED") == ("vodka", "Imported vodka")
    assert pair("FRENCH RED - BORDEAUX") == ("red-wine", "French · Bordeaux")
    assert pair("ALLOCATED WINE - RED")[0] == "offers"
    assert pair("SOMETHING ELSE")[0] == "other"


def test_display_names(spark):
    assert _one(spark, "MAKER'S MARK 46 750ML", k.display_name) == "Maker's Mark 46 750ml"
    assert _one(spark, "D'USSE VSOP COGNAC", k.display_name) == "D'Usse VSOP Cognac"


def test_sizes_status_vendor(spark):
    assert _one(spark, "ABSOLUT VODKA  750ml", ingest.size_ml) == 750
    assert _one(spark, "TITOS 1.75L", ingest.size_ml) == 1750
    assert _one(spark, "NO SIZE", ingest.size_ml) is None
    assert _one(spark, "1  General Distribution", ingest.status_code) == "1"
    assert _one(spark, "VC0000200479", lambda c: ingest.vendor_code(c, F.lit(""))) == "200479"
    assert _one(spark, "FY27 P2", ingest.fiscal_to_month) == "2026-08"
    assert _one(spark, "FY27 P12", ingest.fiscal_to_month) == "2027-06"
    assert _one(spark, "Sept 2025", ingest.text_to_month) == "2025-09"


def test_addresses(spark):
    stores = spark.createDataFrame(
        [
            (6, "75 W 400 N", "Logan"), (10, "433 N MAIN ST", "Tooele"), (24, "1160 PATTERSON AVE", "Ogden"), (39, "161 N 900 E", "Saint George"),
            (41, "300 W HARRIS AVE", "Salt Lake City"), (47, "865 W ANTELOPE DR", "SYRACUSE"), (53, "1115 W 12th St", "MARRIOTT-SLATERVILLE"),
        ],
        "id int, address string, city string",
    )
    want = {
        "280 W Harris Ave, SLC 84115": 41, "1160 Patterson, Ogden 84403": 24, "161 N 900 E, St George 84770": 39, "865 W. Antelope Dr, Syracuse 84075": 47,
        "75 W 4TH N, Logan 84321": 6, "433 N Main, Tooele 84074": 10, "999 W Nowhere Rd, Ogden 84403": None, "280 W Harris Ave, Provo 84601": None,
        "280 W Harris Ave": None,
    }
    texts = spark.createDataFrame([(x,) for x in want], "text string")
    assert dict(rows(places.address_store_match(texts, "text", stores))) == want
    assert _one(spark, "1115 W 12th St", places.street_tokens) == ["1115", "W", "12TH", "ST"]
    assert _one(spark, "5432 High Market Drive, Suite F", places.street_tokens) == ["5432", "HIGH", "MARKET", "DR"]


@pytest.mark.parametrize(
    "address,city",
    [
        ("3920 W TERMINAL DR, SALT LAKE CITY, UT 84122", "Salt Lake City"), ("221 S MAIN ST, MOAB CITY, UT 84532", "Moab"),
        ("625 MAIN ST, PARK CITY (SUMMIT CO), UT 84060", "Park City"), ("123 RD, Unit 400, CITY OF HOLLADAY, UT 84121", "Holladay"),
        ("1 X ST, WEST VALLEY CITY, UT 84119", "West Valley City"), ("785 E MAIN ST, UT 84078", None), ("1 X ST, Wasatch County, UT 84032", None), ("", None),
    ],
)
def test_cities(spark, address, city):
    assert _one(spark, address, places.city_from_address) == city


def test_sources(spark):
    assert _one(spark, "https://www.google.com/search?q=x", lambda c: clients.referrer_host(c, "own.com")) == "google.com"
    assert _one(spark, "https://shop.own.com/a", lambda c: clients.referrer_host(c, "www.own.com")) is None
    assert _one(spark, "search:exact", clients.attribution)["view"] == "exact"
    assert _one(spark, "search:price", clients.attribution) is None
    assert _one(spark, "me+test2@x.org", clients.is_untracked) is True


def test_a_preview_takes_each_item_once(spark):
    ranked = spark.createDataFrame(
        [("scarce", "a", False, 2), ("scarce", "b", True, 1), ("back", "b", True, 1), ("back", "c", True, 2), ("price", "d", False, 1)],
        "view string, csc string, near boolean, place int",
    )
    got = lambda n, area: [tuple(r) for r in feeds.mix_preview(ranked, n, area).orderBy("place").select("view", "csc").collect()]
    assert got(3, True) == [("scarce", "b"), ("back", "c"), ("scarce", "a")]
    swapped = ranked.withColumn("place", 3 - ranked["place"]).where("view = 'scarce'").unionByName(ranked.where("view <> 'scarce'"))
    ranked = swapped
    assert got(4, False) == [("scarce", "a"), ("back", "b"), ("price", "d"), ("back", "c")]
    assert got(9, False) == [("scarce", "a"), ("back", "b"), ("price", "d"), ("back", "c")]
    ranked = swapped.limit(0)
    assert got(3, True) == []


def test_blocks_skip_navigation():
    page = "<html><nav><p>menu</p></nav><p>A  nose of <b>oak</b></p><script>x</script><ul><li>aged 12 years</li></ul></html>"
    assert html.blocks(page) == ["A nose of oak", "aged 12 years"]


def test_facts_of_pages(spark):
    long = "The palate shows oak and vanilla, aged twelve years in barrel. " * 3
    page = f"<p>{long}</p><p>{long}</p><p>short oak</p><footer><p>{long}</p></footer>"
    got = html.page_fact_paragraphs(spark.createDataFrame([(1, page), (2, "<p>nothing</p>")], "page_id long, html string")).collect()
    assert [(r["page_id"], r["paragraphs"]) for r in got] == [(1, 1)]


def test_token_match_against_brute_force(spark):
    items = spark.createDataFrame([("1", "SMALL RING", "GIN"), ("2", "RINGER BOLT", "RUM"), ("3", "OLD BOLT", "SMALL")], "csc string, name string, category string")
    q = spark.createDataFrame([("ring",), ("small",), ("sma rin",), ("olt",), ("zzz",)], "q string")
    got = rows(search.token_match(search.keyed(items), q), "q", "csc", "tier")
    assert got == [("olt", "2", 2), ("olt", "3", 2), ("ring", "1", 0), ("ring", "2", 1), ("sma rin", "1", 1), ("small", "1", 0), ("small", "3", 0)]


def test_items_that_share_a_code(spark):
    """A code holds what any of its items holds; each of them is a result."""
    items = spark.createDataFrame(
        [("1", "SMALL RING", "GIN"), ("1", "RINGER", "GIN"), ("1", "SMALL BOLT", "GIN"), ("2", "BOLT", "SMALL"), (None, "RING", None)], "csc string, name string, category string"
    )
    q = spark.createDataFrame([("ring",), ("ringer bolt",), ("small gin",)], "q string")
    got = rows(search.token_match(search.keyed(items), q).where("csc is not null"), "q", "csc", "tier")
    assert got == [("ring", "1", 0), ("ringer bolt", "1", 0), ("small gin", "1", 0)]
    full = search.keyed(items).selectExpr("*", "1.0D as current_price", "'A' as status", "1 as store_qty", "csc = '1' as in_stock", "cast(null as timestamp) as delisted_at")
    found = rows(search.search_ranked(full, q, filters=F.col("name") != "RINGER"), "q", "place", "csc", "total")
    assert found == sorted((x, i, "1", 2) for x in ("ring", "ringer bolt", "small gin") for i in (1, 2))


def test_index_follows_the_items_and_holds_what_a_scan_holds(spark, tmp_path):
    words = ["ab", "abc", "bcd", "a", "bc.5", "cab", "x", "abcabc", "dd"]
    items = [(str(i), " ".join(words[j % 9] for j in range(i % 7, i % 7 + i % 4)) or None, words[i % 3] if i % 5 else None) for i in range(60)]
    schema = "csc string, name string, category string"
    old, new = items[:40], [(c, n if int(c) % 4 else "DD NEW", g) for c, n, g in items[10:]]
    q = [(x,) for x in ["a", "ab", "b", "ab a", "abc bcd", "dd new", "c", "bc.5", "zz", "", "x's", "5", "cab dd x"]]
    queries = spark.createDataFrame(q, "q string")
    index = search.SearchIndex.build(search.keyed(spark.createDataFrame(old, schema)), folder=str(tmp_path / "index"))
    grown = index.refresh(search.keyed(spark.createDataFrame(new, schema)))
    assert grown.texts.count() == len({*rows(index.texts, "tid"), *rows(grown.texts, "tid")}) > index.texts.count()
    for at, data in ((index, old), (grown, new)):
        frame = search.keyed(spark.createDataFrame(data, schema))
        want = []
        tokens = {}
        for r in search.tokens_of(queries).collect():
            tokens.setdefault(r.q, []).append((r.raw, r.alts))
        for c, key, group in frame.select("csc", "search_key", F.lower(F.coalesce("category", F.lit("")))).collect():
            for text, parts in tokens.items():
                levels = []
                for raw, alts in parts:
                    found = [(key, a) for a in alts if a in key] + [(group, raw)] * (raw in group)
                    whole = [0 if re.search(rf"\b{re.escape(a)}\b", t) else 1 if re.search(rf"\b{re.escape(a)}", t) else 2 for t, a in found]
                    levels.append(min(whole, default=None))
                if None not in levels:
                    want.append((text, c, max(levels)))
        got = rows(search.token_match(frame, queries, index=at), "q", "csc", "tier")
        assert got == sorted(want, key=repr) and len(want) > 60


def test_category_menu(spark):
    names = ["VODKA - IMPORTED", "VODKA", "FRENCH RED - BORDEAUX", "RED VARIETAL - MALBEC", "SPECIAL ORDERS", "SAKE", "ODD THING - MISC", "WHISKEY - SCOTCH", None, "VODKA"]
    menu = search.category_menu(spark.createDataFrame([(n,) for n in names], "category string"))
    got = {r["value"]: (r["position"], r["title"], r["label"], r["chosen"], r["place"]) for r in menu.collect()}
    assert len(got) == 8 and got["VODKA"] == (2, "Vodka", "Vodka", "Vodka", 2) and got["VODKA - IMPORTED"][2:] == ("Imported vodka", "Imported vodka", 1)
    assert got["FRENCH RED - BORDEAUX"][:4] == (8, "Red wine", "French · Bordeaux", "Red wine · French · Bordeaux") and got["WHISKEY - SCOTCH"][3] == "Whiskey · Scotch"
    assert got["ODD THING - MISC"] == (20, "Other", "Odd Thing · Other", "Odd Thing · Other", 1)


def _profile(spark, name, category, text):
    from stockline import session

    df = spark.createDataFrame([(1, name, category, text, False)], "key long, name string, category string, description string, generic boolean")
    with session.many_rules(spark):
        return taste.attribute_extract(df).first()


def test_taste_rules(spark):
    p = _profile(spark, "HOUSE RED 750ml", "RED GENERIC - TABLE", "Full-bodied with sweet tannins. Notes of pepper.")
    assert p["sweetness"]["value"] is None and p["body"]["value"] == "full" and [t["value"] for t in p["tags"]] == ["spicy"]
    assert p["body"]["quote"] == "Full-bodied with sweet tannins."
    p = _profile(spark, "HOUSE RIESLING", "WHITE VARIETAL - RIESLING", None)
    assert p["grapes"]["value"] == ["Riesling"] and p["sweetness"]["evidence"] == "none"
    p = _profile(spark, "VILLA MOSCATO D'ASTI", "SPARKLING WINE - OTHER", "Not too sweet.")
    assert p["sweetness"]["value"] == "dry" and p["body"]["source"] == "style:moscato-asti"


def test_replace_table_and_months(spark, tmp_path):
    path = str(tmp_path / "table")
    assert files.replace_table(spark.range(5), path) == 5
    with pytest.raises(ValueError):
        files.replace_table(spark.range(0), path, minimum_rows=1)
    assert spark.read.parquet(path).count() == 5
    months = str(tmp_path / "months")
    frame = spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "period_month string, v int")
    files.write_months(frame, months)
    files.write_months(frame.where("v = 2").withColumn("v", F.lit(9)), months)
    assert rows(spark.read.parquet(months), "v") == [(1,), (9,)]
