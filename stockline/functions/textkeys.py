"""Column functions for names: search keys, query tokens, display labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .times import col

# Abbreviations and spellings, and the word they stand for.
ALIASES = {
    "sngl": "single", "sgl": "single", "brrl": "barrel", "brl": "barrel", "bbl": "barrel",
    "brbn": "bourbon", "bbn": "bourbon", "whsky": "whiskey", "whisky": "whiskey",
    "yrs": "yr", "year": "yr", "years": "yr", "rsv": "reserve", "rsrv": "reserve",
    "blnc": "blanc", "sauv": "sauvignon", "cab": "cabernet", "chard": "chardonnay",
    "slct": "select", "blnd": "blend", "dbl": "double", "dble": "double",
    "ltd": "limited", "edtn": "edition", "prf": "proof", "teq": "tequila",
    "spcl": "special", "zin": "zinfandel", "repo": "reposado", "liq": "liqueur",
    "orig": "original", "btch": "batch", "blantons": "blanton",
    "macallen": "macallan", "mcallen": "macallan", "glendronaugh": "glendronach",
    "meszcal": "mezcal", "iichika": "iichiko", "franciscorta": "franciacorta",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    # One literal, folded to a map once: a map of columns would be a plan of its own.
    pairs = F.lit("\x01".join(f"{a}\x02{b}" for a, b in table.items()))
    return F.try_element_at(F.str_to_map(pairs, F.lit("\x01"), F.lit("\x02")), key)


def search_key(text: str | Column) -> Column:
    """Lower case, apostrophes gone, dots only inside numbers, letters and digits
    apart, initials joined, abbreviations spelled out. Null gives ""."""
    s = F.lower(F.coalesce(col(text), F.lit("")))
    for pattern, to in (
        (r"['’`]", ""),
        (r"(?<![0-9])\.|\.(?![0-9])", " "),
        (r"[^a-z0-9.]+", " "),
        (r"([a-z])([0-9])", "$1 $2"),
        (r"([0-9])([a-z])", "$1 $2"),
    ):
        s = F.regexp_replace(s, pattern, to)
    s = F.regexp_replace(F.trim(s), r"\b([a-z]) (?=[a-z]\b)", "$1")
    return F.array_join(F.transform(F.split(s, " "), lambda w: F.coalesce(lookup(ALIASES, w), w)), " ")


def search_name(text: str | Column) -> Column:
    """Lower case, apostrophes gone, other punctuation as spaces."""
    s = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "['’]", "")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def query_words(key: Column) -> Column:
    """The words of a search key."""
    return F.filter(F.split(key, " "), lambda w: w != "")


def possessive_stems(text: str | Column) -> Column:
    """Search keys of the words that stand before an 's."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"([a-z0-9]+)['’]s\b"), F.lit(1)), search_key)


def tokens_from(words: Column, stems: Column, most: int = 8) -> Column:
    """array<struct<raw, alts>> of a query's words; see ``query_tokens``."""
    before = F.concat(F.array(F.lit("")), words)
    kept = F.filter(words, lambda w, i: ~((w == "old") & (F.get(before, i) == "yr")))

    def alternatives(w: Column) -> Column:
        stem = F.substr(w, F.lit(1), F.length(w) - 1)
        possessive = w.endswith("s") & F.array_contains(stems, stem)
        return F.when(possessive, F.array(w, stem)).otherwise(F.array(w))

    return F.transform(F.slice(F.array_distinct(kept), 1, most), lambda w: F.struct(w.alias("raw"), alternatives(w).alias("alts")))


def query_tokens(text: str | Column, most: int = 8) -> Column:
    """array<struct<raw, alts>>: up to ``most`` distinct tokens. A possessive also
    matches its stem; "old" right after "yr" is dropped."""
    return tokens_from(query_words(search_key(text)), possessive_stems(text), most)


def display_name(name: str | Column) -> Column:
    """Title case for shouted names: "MAKER'S MARK 750ML" -> "Maker's Mark 750ml"."""
    pieces = F.regexp_extract_all(F.lower(col(name)), F.lit(r"[a-z0-9'’]+|[^a-z0-9'’]+"), F.lit(0))

    def cap(w: Column) -> Column:
        first = F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
        named = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1), F.upper(F.substring(w, 3, 1)), F.substr(w, F.lit(4)))
        return F.when(w.rlike(r"^[do]['’][a-z]"), named).when(w.rlike("^[a-z]"), first).otherwise(w)

    s = F.array_join(F.transform(pieces, cap), "")
    s = F.regexp_replace(s, r"(?i)\b(\d+)\s?Ml\b", "$1ml")
    s = F.regexp_replace(s, r"(?i)\b(\d+(?:\.\d+)?)\s?l\b", "$1L")
    for word in ("Ipa", "Dipa", "Rtd", "Esb", "Nv", "Vsop", "Xo"):
        s = F.regexp_replace(s, rf"\b{word}\b", word.upper())
    return F.regexp_replace(s, r"\bDble\b", "Double")


def product_title(name: str | Column, size_ml: str | Column) -> Column:
    """Display name without a closing size that is known as data, also where the
    name is long enough for the size to have been cut off."""
    n, size = F.trim(F.coalesce(col(name), F.lit(""))), col(size_ml)
    litres = F.regexp_replace((size / 1000).cast("string"), r"\.0$", "")
    ends = F.concat(
        F.lit(r"(?i)\s*\b(?:"), size.cast("string"), F.lit("|"), F.regexp_replace(litres, r"\.", r"\\."),
        F.lit(r")\s?(?:ml|m|l|ltr|liter)?\.?$"),
    )
    partial = F.regexp_extract(n, r"(?i)\s+(\d{1,4})\s?(?:ml|m)?$", 1)
    cut = (
        F.when(size.isNull() | (size == 0), n)
        .when(F.regexp_like(n, ends), F.regexp_replace(n, ends, F.lit("")))
        .when(
            (partial != "") & F.startswith(size.cast("string"), partial) & (F.length(n) >= 38),
            F.regexp_replace(n, r"(?i)\s+(\d{1,4})\s?(?:ml|m)?$", ""),
        )
        .otherwise(n)
    )
    return F.trim(F.regexp_replace(display_name(cut), r"\s{2,}", " "))


def product_kind(category: str | Column, size_ml: str | Column) -> Column:
    """can, wine or spirit: the category decides, then a can's size."""
    c = F.upper(F.coalesce(col(category), F.lit("")))
    wine = (
        r"WINE|VARIETAL|GENERIC|RED\b|WHITE\b|ROSE|BLUSH|PORT|SHERRY|MADEIRA|MADIERA|MARSALA|VERMOUTH|SANGRIA|LATE HARVEST|"
        r"CHAMPAGNE|PROSECCO|SPARKLING|BORDEAUX|BURGUNDY|RHONE|RIOJA|TUSCANY|PIEDMONT|MALBEC"
    )
    return (
        F.when(c.rlike(r"BEER|ALE\b|LAGER|CIDER|MALT BEVERAGE|PREMIXED|COOLER|SELTZER"), "can")
        .when(c.rlike(wine), "wine")
        .when(col(size_ml).isin(355, 473, 330), "can")
        .otherwise("spirit")
    )


def unit_word(kind: str | Column) -> Column:
    return F.when(col(kind) == "can", "units").otherwise("bottles")


# Category heads (before " - ") and the group they belong to.
GROUP_HEADS = {
    "whiskey": ["WHISKEY"],
    "vodka": ["VODKA"],
    "tequila": ["TEQUILA"],
    "rum": ["RUM"],
    "gin": ["GIN"],
    "brandy": ["BRANDY"],
    "liqueurs": ["LIQUEURS", "SCHNAPPS"],
    "rose": ["ROSE WINE", "BLUSH WINE"],
    "sparkling": ["SPARKLING WINE"],
    "fortified": ["PORT", "SHERRY", "MADEIRA", "MADIERA", "MARSALA", "LATE HARVEST", "VERMOUTH"],
    "other-wine": ["SAKE", "ORANGE WINE", "WINE"],
    "beer": ["ALE", "LAGER", "BEER", "DOMESTIC BEER", "IMPORTED BEER"],
    "cider": ["CIDER", "FLAVORED MALT BEVERAGES"],
    "premixed": ["PREMIXED"],
    "gift-sets": ["GIFT SETS"],
    "offers": ["ALLOCATED SPIRIT", "ALLOCATED WINE", "ALLOCATED BEER", "SPIRIT OFFER", "WINE OFFER", "BEER OFFER"],
    "special-orders": ["SPECIAL ORDERS"],
}
GROUP_NOUNS = {
    "whiskey": "whiskey", "vodka": "vodka", "tequila": "tequila", "rum": "rum", "gin": "gin", "brandy": "brandy",
    "liqueurs": "liqueurs", "sparkling": "sparkling", "beer": "beer", "cider": "cider",
}
# The groups in the order of the menu, with the names shown.
GROUP_LABELS = {
    "whiskey": "Whiskey", "vodka": "Vodka", "tequila": "Tequila & mezcal", "rum": "Rum", "gin": "Gin", "brandy": "Brandy & cognac",
    "liqueurs": "Liqueurs & schnapps", "red-wine": "Red wine", "white-wine": "White wine", "rose": "Rosé & blush", "sparkling": "Sparkling wine",
    "fortified": "Port, sherry & dessert wine", "other-wine": "Sake, orange & fruit wine", "beer": "Beer", "cider": "Cider & malt drinks",
    "premixed": "Premixed cocktails", "gift-sets": "Gift sets", "offers": "Offers & allocated", "special-orders": "Special orders", "other": "Other",
}
IMPLIED_HEADS = {
    "whiskey": "WHISKEY", "vodka": "VODKA", "tequila": "TEQUILA", "rum": "RUM", "gin": "GIN", "brandy": "BRANDY",
    "liqueurs": "LIQUEURS", "sparkling": "SPARKLING WINE", "beer": "BEER", "cider": "CIDER", "premixed": "PREMIXED",
    "gift-sets": "GIFT SETS", "special-orders": "SPECIAL ORDERS",
}
GENERIC_TAILS = ["Imported", "Domestic", "Basic", "Flavored", "Other", "Generic"]


def category_head(category: str | Column) -> Column:
    return F.upper(F.trim(F.split(col(category), r"\s+-\s+")[0]))


def category_group(category: str | Column) -> Column:
    """The menu group of a category; the first match wins."""
    h = category_head(category)
    heads = {x: g for g, xs in GROUP_HEADS.items() for x in xs}
    exact = lookup(heads, h)
    early = exact.isin("whiskey", "vodka", "tequila", "rum", "gin", "brandy", "liqueurs")
    return (
        F.when(h.isNull(), F.lit(None))
        .when(early, exact)
        .when(h.rlike(r"\bRED\b") & ~h.rlike("ALLOCATED|OFFER"), "red-wine")
        .when(h.rlike(r"\bWHITE\b"), "white-wine")
        .otherwise(F.coalesce(exact, F.lit("other")))
    )


def _tidy(text: Column) -> Column:
    s = display_name(text)
    for word, to in (
        ("Misc", "Other"), ("Doc", "DOC"), ("Aoc", "AOC"), ("Ba, Tba", "BA, TBA"), ("And", "&"), ("Dsd", "Small packages"),
        ("Rose", "Rosé"), ("Portugese", "Portuguese"), ("Madiera", "Madeira"),
    ):
        s = F.regexp_replace(s, rf"\b{word}\b", to)
    return F.regexp_replace(s, r"\s*-\s+|\s+-\s*", " – ")


def subcategory_label(category: str | Column) -> Column:
    """"VODKA - IMPORTED" -> "Imported vodka", "FRENCH RED - BORDEAUX" -> "French · Bordeaux"."""
    c = col(category)
    group, h = category_group(c), category_head(c)
    rest = F.regexp_extract(c, r"^.*?\s+-\s+(.*)$", 1)
    tail = F.when(rest != "", _tidy(rest)).otherwise("")
    noun = lookup(GROUP_NOUNS, group)
    tidy_head = _tidy(h)
    cap_noun = F.concat(F.upper(F.substring(noun, 1, 1)), F.substr(noun, F.lit(2)))
    implied = lookup(IMPLIED_HEADS, group) == h
    in_group = (
        F.when(tail == "", F.coalesce(cap_noun, tidy_head))
        .when(noun.isNotNull() & tail.isin(GENERIC_TAILS), F.concat(tail, F.lit(" "), noun))
        .otherwise(tail)
    )
    bare = F.trim(F.regexp_replace(F.regexp_replace(h, r"\b(RED|WHITE)\b", ""), r"\s+", " "))
    lead = (
        F.when(bare == "VARIETAL", "")
        .when(bare == "GENERIC", "Blends")
        .when(bare == "SMALL PACKAGE WINE", "Small packages")
        .otherwise(_tidy(bare))
    )
    wine_tail = F.when(lead == "Small packages", "").otherwise(tail)
    wine = (
        F.when(lead == "", F.when(wine_tail == "Other", "Other grapes").otherwise(wine_tail))
        .when(wine_tail != "", F.concat(lead, F.lit(" · "), wine_tail))
        .otherwise(lead)
    )
    plain = F.when(tidy_head == "Rosé Wine", "Rosé").when(tidy_head == "Blush Wine", "Blush").when(
        tidy_head == "Orange Wine", "Orange wine"
    ).otherwise(tidy_head)
    other = F.when(tail != "", F.concat(plain, F.lit(" · "), tail)).otherwise(plain)
    return F.when(implied, in_group).when(group.isin("red-wine", "white-wine"), wine).otherwise(other)


def filter_label(category: str | Column) -> Column:
    """What a chosen category is called: "Red wine · French · Bordeaux", "Imported vodka"."""
    c = col(category)
    group, label = category_group(c), subcategory_label(c)
    noun = lookup(GROUP_NOUNS, group)
    bare = group.isNull() | (group == "other") | F.coalesce(F.contains(F.lower(label), noun), F.lit(False))
    return F.when(bare, label).otherwise(F.concat(lookup(GROUP_LABELS, group), F.lit(" · "), label))
