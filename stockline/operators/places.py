"""Addresses and licences: store matching, city names, registry clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import times

# Address words and their standard forms.
ADDRESS_WORDS = {
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
    "ROAD": "RD", "AVENUE": "AVE", "AV": "AVE", "STREET": "ST", "DRIVE": "DR", "LANE": "LN", "BOULEVARD": "BLVD",
    "CENTER": "CTR", "CANYON": "CYN", "PARKWAY": "PKWY", "CIRCLE": "CIR", "COURT": "CT", "HIGHWAY": "HWY",
}
STREET_SUFFIXES = ["RD", "AVE", "ST", "DR", "LN", "BLVD", "CTR", "PKWY", "CIR", "CT", "WAY", "HWY"]
CITY_ALIASES = {"SLC": "SALT LAKE CITY", "ST GEORGE": "SAINT GEORGE"}
# Places whose name really ends in "City", and spellings to mend.
REAL_CITY_NAMES = [
    "SALT LAKE CITY", "PARK CITY", "CEDAR CITY", "BRIGHAM CITY", "HEBER CITY", "GARDEN CITY",
    "BRYCE CANYON CITY", "SPRING CITY", "BEAR RIVER CITY", "WEST VALLEY CITY",
]
CITY_FIXES = {
    "PARKCITY": "Park City", "SLC": "Salt Lake City", "SOUTH ODGEN": "South Ogden", "ST GEORGE": "St. George",
    "SOUTH SALT LAKE": "South Salt Lake", "LA VERKIN": "La Verkin", "MARRIOTT-SLATERVILLE": "Marriott-Slaterville",
}
# Fixed value: a word with the marks it may hold, or what stands between words.
WORD_OR_GAP = "[a-z0-9][a-z0-9'’.]*|[^a-z0-9]+"
SMALL_WORDS = ["of", "and", "the", "at", "on", "in", "a", "de", "la", "el"]


def mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _mapped(pairs: dict[str, str], c: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping(pairs), c), c)


def street_tokens(address: str | Column) -> Column:
    """Upper case, no punctuation or suite, standard words, "4TH N" -> "400 N"."""
    s = F.upper(times.col(address))
    s = F.regexp_replace(s, r"\s+-\s+.*$", "")
    s = F.regexp_replace(s, r",?\s*\b(SUITE|STE|UNIT|PO BOX)\b.*$", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[.,#]", " "), r"\s+", " "))
    words = F.transform(F.filter(F.split(s, " "), lambda w: w != ""), lambda w: _mapped(ADDRESS_WORDS, w))

    def grid(w: Column, i: Column) -> Column:
        number = F.regexp_extract(w, r"^(\d+)(ST|ND|RD|TH)$", 1)
        heading = F.coalesce(F.get(words, i + 1), F.lit("")).rlike("^[NSEW]$")
        return F.when((number != "") & heading, (number.try_cast("bigint") * 100).cast("string")).otherwise(w)

    return F.transform(words, grid)


def _bare(tokens: Column) -> Column:
    """Without a closing street suffix."""
    last = F.try_element_at(tokens, F.lit(-1))
    return F.when(
        (F.size(tokens) > 2) & last.isin(STREET_SUFFIXES), F.slice(tokens, 1, F.size(tokens) - 1)
    ).otherwise(tokens)


def city_key(city: str | Column) -> Column:
    c = F.upper(F.coalesce(times.col(city), F.lit("")))
    c = F.regexp_replace(F.regexp_replace(c, r"[.,]", " "), r"\b\d{5}\b", "")
    return _mapped(CITY_ALIASES, F.trim(F.regexp_replace(c, r"\s+", " ")))


def _rest(a: Column) -> Column:
    """All but the first."""
    return F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(0)))


def _keys(df: DataFrame, street: Column, city: Column, keep: list[str]) -> DataFrame:
    tokens = street_tokens(street)
    df = df.select(*keep, tokens.alias("__t"), city.alias("city_key"))
    bare = _bare(F.col("__t"))
    numbered = F.coalesce(F.get(F.col("__t"), F.lit(0)), F.lit("")).rlike(r"^\d+$")
    return df.select(
        *keep,
        "city_key",
        F.array_join("__t", " ").alias("full_key"),
        F.array_join(bare, " ").alias("bare_key"),
        F.when(numbered, F.array_join(_rest(bare), " ")).alias("street_key"),
    )


def address_store_match(texts: DataFrame, text: str, stores: DataFrame) -> DataFrame:
    """Store id for each distinct free-typed address, null when ambiguous.

    Stages: equal tokens, equal without suffix (several hits: the only one in
    the named city), then the only store on that street of that city. Each
    stage is an equi-join on a derived key."""
    parts = F.filter(F.transform(F.split(F.col(text), ","), lambda p: F.trim(p)), lambda p: p != "")
    named = F.filter(F.transform(_rest(parts), city_key), lambda c: c != "")
    asked = _keys(
        texts.select(text).distinct(), F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.coalesce(F.get(named, F.lit(0)), F.lit("")), [text]
    )
    places = _keys(
        stores.where("address is not null"), F.col("address"), city_key("city"), ["id"]
    ).select("id", F.col("city_key").alias("s_city"), "full_key", "bare_key", "street_key")

    def stage(key: str, name: str) -> DataFrame:
        hits = asked.select(text, "city_key", key).where(F.col(key) != "").join(places.select("id", "s_city", key), key)
        per = hits.groupBy(text).agg(
            F.count("*").alias("n"),
            F.min("id").alias("any_id"),
            F.count_if(F.col("s_city") == F.col("city_key")).alias("n_city"),
            F.min(F.when(F.col("s_city") == F.col("city_key"), F.col("id"))).alias("city_id"),
        )
        return per.select(text, *[F.col(c).alias(f"{name}_{c}") for c in ("n", "any_id", "n_city", "city_id")])

    joined = asked.join(stage("full_key", "f"), text, "left").join(stage("bare_key", "b"), text, "left").join(
        stage("street_key", "s"), text, "left"
    )

    def exact(p: str) -> Column:
        return F.when(F.col(f"{p}_n") == 1, F.col(f"{p}_any_id")).when(F.col(f"{p}_n_city") == 1, F.col(f"{p}_city_id"))

    by_street = F.when((F.col("city_key") != "") & (F.col("s_n_city") == 1), F.col("s_city_id"))
    return joined.select(
        text,
        F.when(F.col("f_n") > 0, exact("f")).when(F.col("b_n") > 0, exact("b")).otherwise(by_street).alias("store_id"),
    )


def title_case(c: str | Column) -> Column:
    """"BEERHIVE PUB" -> "Beerhive Pub"; mixed case is kept.

    The text falls into words (letters, digits, and the marks within them) and what
    stands between; small words stay small unless the text begins with them."""
    c = times.col(c)
    parts = F.regexp_extract_all(F.lower(c), F.lit(WORD_OR_GAP), F.lit(0))

    def cap(w: Column, i: Column) -> Column:
        plain = ~w.rlike("^[a-z0-9]") | ((i > 0) & w.isin(SMALL_WORDS))
        return F.when(plain, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))

    return F.when(c != F.upper(c), c).otherwise(F.array_join(F.transform(parts, cap), ""))


def city_from_address(address: str | Column) -> Column:
    """The municipality before the state, in its usual spelling; null if unclear."""
    parts = F.transform(F.split(F.coalesce(times.col(address), F.lit("")), ","), lambda p: F.trim(p))
    marks = F.transform(parts, lambda p, i: F.when(p.rlike(r"(?i)^(UT|UTAH)\b"), i).otherwise(-1))
    raw = F.when(F.array_max(marks) >= 1, F.get(parts, F.array_max(marks) - 1))
    c = F.trim(F.regexp_replace(F.upper(raw), r"\s*\(.*\)\s*$", ""))
    ok = (c != "") & ~c.rlike(r"\d") & ~c.rlike(r"^UNIT\b") & ~c.rlike(r" COUNTY$")
    c = F.regexp_replace(c, r"^CITY OF\s+", "")
    c = F.when(c.isin(REAL_CITY_NAMES), c).otherwise(F.regexp_replace(c, r"\s+(CITY|TOWN|TOWNSHIP)$", ""))
    return F.when(ok, F.coalesce(F.try_element_at(mapping(CITY_FIXES), c), title_case(c)))


def business_name(c: str | Column) -> Column:
    """Without a trailing licence code in parentheses, title-cased."""
    c = times.col(c)
    cut = F.trim(F.regexp_replace(c, r"\s*\((?:[A-Z]{2,3}|[A-Z0-9/-]*\d[A-Z0-9/-]*)\)\s*$", ""))
    return title_case(F.when(cut != "", cut).otherwise(F.trim(c)))


def yes_no(c: str | Column) -> Column:
    """Three-valued: "Yes", "No", anything else unknown."""
    c = times.col(c)
    return F.when(c == "Yes", True).when(c == "No", False)


def address_key(address: str | Column) -> Column:
    """House number and street, for matching places by address."""
    s = F.regexp_replace(F.regexp_replace(F.upper(times.col(address)), r"\.", ""), r"\s+", " ")
    return F.array_join(F.slice(F.split(F.trim(F.get(F.split(s, ","), F.lit(0))), " "), 1, 4), " ")


def licence_registry_clean(raw: DataFrame) -> DataFrame:
    """Registry rows ``(license_number, type, business_name, address, county,
    issued, conditional, is_new)`` -> typed, readable rows."""
    issued = F.col("issued")
    return raw.select(
        "license_number",
        "type",
        business_name("business_name").alias("business_name"),
        "address",
        city_from_address("address").alias("city"),
        "county",
        F.when(issued.rlike(r"^\d{4}-\d{2}-\d{2}$"), issued).alias("issued"),
        yes_no("conditional").alias("conditional"),
        (F.col("is_new") == "New").alias("is_new"),
        address_key("address").alias("address_key"),
    )


def maker_at(licences: DataFrame, makers: DataFrame) -> DataFrame:
    """Licences at a maker's listed address: equal address key and city."""
    keyed = makers.select("maker", address_key("address").alias("address_key"), "city").distinct()
    return licences.join(keyed, ["address_key", "city"]).select("license_number", "maker")


def bar_groups(licences: DataFrame, groups: DataFrame) -> DataFrame:
    """Licence counts by group, county and city: one pass over exploded filters.

    ``groups``: (type, grp)."""
    rows = licences.join(groups, "type")
    tags = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(c), F.lit("?")).alias("value"))
            for d, c in (("group", "grp"), ("county", "county"), ("city", "city"))
        ]
    )
    return (
        rows.select("is_new", F.explode(tags).alias("t"))
        .groupBy("t.dimension", "t.value")
        .agg(F.count("*").alias("licences"), F.count_if("is_new").alias("new_this_month"))
    )
