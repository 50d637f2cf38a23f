"""Attributes read from text, and recommendations ranked by their evidence.

An item is ``(key, name, category, description, ...)``. An attribute is a
struct of value, kind of evidence, source, quote, confidence and note. Rules
are data (``functions/taste_rules``); they become column expressions, so the
extraction is one pass over the items without Python.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import skew, taste_rules as R
from ..functions.textkeys import lookup
from ..functions.times import col

_ACCENTS = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "AAAAAACEEEEIIIINOOOOOUUUUY")
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def plain_upper(c: str | Column) -> Column:
    """Upper case without accents."""
    return F.translate(F.upper(F.coalesce(col(c), F.lit(""))), *_ACCENTS)


def ascii_words(pattern: str) -> str:
    """Word edges that, as in most engines, treat accented letters as edges."""
    return pattern.replace(r"\b", _EDGE)


def _attr(value, evidence, source, quote=None, confidence=None, note=None) -> Column:
    def c(x):
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")

    parts = zip(("value", "evidence", "source", "quote", "confidence", "note"), (value, evidence, source, quote, confidence, note))
    return F.struct(*[c(x).alias(n) for n, x in parts])


def _unknown() -> Column:
    return _attr(None, "none", None)


def _first(parts: Sequence[Column]) -> Column:
    return F.coalesce(*parts)


def _text(value: str) -> str:
    """A raw SQL string; the rules hold no double quotes."""
    return f'r"{value}"'


def _rule(pattern: str, text: str, folded: str | None = None) -> str:
    """SQL: the text matches the pattern; plain words are looked for first.
    ``folded``: the text in lower case, when the pattern ignores case."""
    hit = f"rlike({text}, {_text(pattern if folded is None else _folded(pattern))})"
    words = anchors(pattern)
    if words is None:
        return hit
    where = text if folded is None else folded
    some = " or ".join(f"contains({where}, {_text(w if folded is None else w.lower())})" for w in dict.fromkeys(words))
    return f"(({some}) and {hit})"


def _hits(text: str, patterns: Sequence[str], folded: str | None = None) -> Column:
    """Which patterns match the column ``text``, in rule order, as one array.

    The rules run inside a lambda: hundreds of patterns would otherwise be
    generated as Java code, which takes far longer than running them."""
    rules = ", ".join(_rule(p, "x.t", "x.f" if folded else None) for p in patterns)
    return F.expr(f"transform(array(named_struct('t', {text}, 'f', {folded or text})), x -> array({rules}))[0]")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _first_hit(hits: Column) -> Column:
    """Index of the first rule that matched, null without one."""
    return F.nullif(F.array_position(hits, True), F.lit(0)).cast("int") - 1


def _named(values: Column, hits: Column) -> Column:
    """The values whose rule matched. The hits are an argument, not part of the
    lambda, so that every pattern runs once."""
    return F.array_compact(F.zip_with(values, hits, lambda v, h: F.when(h, v)))


def find_grapes(*texts: str) -> Column:
    """For each of the columns ``texts`` all grapes it names, in rule order."""
    hits = []
    for grape, pattern in R.GRAPES:
        hit = _rule(pattern, "x")
        if grape == "Cabernet Sauvignon":
            sauv = f"rlike(x, {_text(chr(92) + 'bCAB(?:ERNET)?[.]? SAUV')})"
            other = f"rlike(regexp_replace(x, {_text('CAB(?:ERNET)?[.]? FRANC')}, ''), {_text(chr(92) + 'bCABERNET' + chr(92) + 'b(?! FRANC)')})"
            franc = _rule(R.GRAPES[0][1], "x")
            hit = f"({hit} and (not {franc} or {sauv} or {other}))"
        hits.append(hit)
    names = ", ".join(_text(g) for g, _ in R.GRAPES)
    found = f"array_compact(zip_with(array({names}), array({', '.join(hits)}), (v, h) -> if(h, v, null)))"
    return F.expr(f"transform(array({', '.join(texts)}), x -> {found})")


def clean_quote(c: Column) -> Column:
    """Without rating and award lines."""
    s = F.regexp_replace(F.regexp_replace(c, R.RATINGS, ""), R.RATING_CODES, "")
    return F.trim(F.regexp_replace(s, r"\s{2,}", " "))


def trim_quote(c: Column, most: int = 140) -> Column:
    """At most ``most`` characters, cut at a word."""
    cut = F.concat(F.regexp_replace(F.substring(c, 1, most - 3), r"\s+\S*$", ""), F.lit("…"))
    return F.when(F.length(c) <= most, c).otherwise(cut)


def quote_around(text: Column, pattern: Column) -> Column:
    """The sentence in which the match starts, cleaned and trimmed."""
    at = F.greatest(F.regexp_instr(text, pattern), F.lit(1))
    head = F.regexp_replace(F.substr(text, F.lit(1), at), r"(?s)^.*(?:[.!;]\s+|\.(?=[A-Z]))", "")
    tail = F.regexp_extract(F.substr(text, at + 1), r"(?s)^.*?(?:[.!;](?=\s)|\.(?=[A-Z])|$)", 0)
    return trim_quote(clean_quote(F.concat(head, tail)))


def anchors(pattern: str) -> list[str] | None:
    """Plain words one of which every match of the pattern contains, if they can
    be told from its text; looking for them first spares most regex runs."""

    def split(p: str) -> list[str]:
        parts, depth, cur = [], 0, ""
        for ch in p:
            depth += (ch == "(") - (ch == ")")
            if ch == "|" and depth == 0:
                parts.append(cur)
                cur = ""
            else:
                cur += ch
        return [*parts, cur]

    out: list[str] = []
    for alt in split(pattern):
        p = re.sub(r"\(\?(?:<?[=!])[^)]*\)", "\0", alt)
        p = re.sub(r"\(\?:[^()]*\)\?", "\0", p)
        groups = re.findall(r"\(\?:([^()]*)\)", p)
        p = re.sub(r"\(\?:[^()]*\)", "\0", p)
        p = re.sub(r"\\b|[\^$]", "", p)
        p = re.sub(r"\[[^\]]*\][?+*]?", "\0", p)
        p = re.sub(r"\\?.[?*+]", "\0", p)
        p = re.sub(r"\\.", "\0", p)
        best = max(p.split("\0"), key=len)
        if len(best) >= 2:
            out.append(best)
            continue
        inner = [anchors(g) for g in groups]
        usable = [g for g in inner if g]
        if not usable:
            return None
        out.extend(usable[0])
    return out


def _folded(pattern: str) -> str:
    return "(?i)" + ascii_words(pattern)


def _text_attr(rules: Sequence[tuple[str, str, str]], hit: Column, text: Column, generic: Column) -> Column:
    """The attribute of the rule at index ``hit``; text shared with other items
    counts for less."""
    stated = F.get(_strings([r[2] for r in rules]), hit)
    lowered = F.when(stated == "high", "medium").otherwise("low")
    quote = quote_around(text, F.get(_strings([_folded(r[1]) for r in rules]), hit))
    return _attr(F.get(_strings([r[0] for r in rules]), hit), "product", "listing_text", quote, F.when(generic, lowered).otherwise(stated))


def _sweet_hits(text: str, folded: str) -> Column:
    """Sweetness rules that match words about the taste, not about an aroma."""
    parts = []
    for _, pattern, _ in R.TEXT_SWEETNESS:
        near = f"lower(substr(x.t, greatest(regexp_instr(x.t, {_text(_folded(pattern))}), 1), 40))"
        parts.append(f"({_rule(pattern, 'x.t', 'x.f')} and not rlike({near}, {_text(R.NOT_SWEET)}))")
    return F.expr(f"transform(array(named_struct('t', {text}, 'f', {folded})), x -> array({', '.join(parts)}))[0]")


def color_of(category: str | Column) -> Column:
    c = F.upper(F.coalesce(col(category), F.lit("")))
    return (
        F.when(c.rlike("^ROSE WINE|^BLUSH WINE|BLANC DE NOIRS & ROSE"), "rose")
        .when(c.rlike(r"\bWHITE\b|^SPARKLING WINE"), "white")
        .when(c.rlike(r"\bRED\b"), "red")
    )


def style_group(category: str | Column) -> Column:
    """The style group of a category; red and white look before the dash only."""
    c = col(category)
    h = F.split_part(c, F.lit(" - "), F.lit(1))
    return (
        F.when(c.startswith("SPARKLING WINE"), "sparkling")
        .when(c.startswith("ROSE WINE") | c.startswith("BLUSH WINE"), "rose")
        .when(h.rlike(r"\bWHITE\b"), "white")
        .when(h.rlike(r"\bRED\b") & ~c.rlike("ALLOCATED|OFFER"), "red")
    )


def duplicate_text_flag(items: DataFrame, key: str, text: str, at_least: int = 2) -> DataFrame:
    """Whether each item's text is shared word for word.

    Texts are compared by hash; copies are counted before the shuffle, and only
    the repeated hashes come back to the rows."""
    hashed = items.select(key, F.sha2(F.col(text), 256).alias("h"))
    repeated = hashed.where("h is not null").groupBy("h").agg(F.count("*").alias("copies")).where(F.col("copies") >= at_least)
    return hashed.join(repeated, "h", "left").select(key, F.col("copies").isNotNull().alias("generic"), F.coalesce("copies", F.lit(1)).alias("copies"))


def identity_flags(items: DataFrame, key: str, name: str, reused: DataFrame | None = None) -> DataFrame:
    """Items whose code cannot be pinned to one product, and why."""
    n = F.col(name)
    why = F.when(n.rlike(r"'\d{2}\s*/\s*\d{2}\b"), "several vintages in one name").when(
        n.rlike(r"(?i)\(USE \d{5,6}\)"), "name points to another code"
    )
    rows = items.select(key, why.alias("note"))
    if reused is not None:
        rows = rows.join(reused.select(key, F.lit("code used for several names").alias("r")), key, "left").select(
            key, F.coalesce("note", "r").alias("note")
        )
    return rows.withColumn("status", F.when(F.col("note").isNull(), "ok").otherwise("ambiguous"))


def attribute_extract(items: DataFrame, key: str = "key") -> DataFrame:
    """Profiles for items ``(key, name, category, description, generic)``.

    Hundreds of patterns meet each text, so the items are dealt out to the tasks first, however
    few parts their file has."""
    items = items.repartition(key)
    keep = [c for c in items.columns if c not in ("description", "generic")]
    base = items.select(
        *keep,
        plain_upper("name").alias("__n"),
        F.upper(F.coalesce("category", F.lit(""))).alias("__c"),
        F.trim(F.coalesce("description", F.lit(""))).alias("__d"),
        plain_upper(F.trim(F.coalesce("description", F.lit("")))).alias("__u"),
        F.lower(F.trim(F.coalesce("description", F.lit("")))).alias("__l"),
        F.coalesce("generic", F.lit(False)).alias("__g"),
    )
    n, c, d, g = (F.col(x) for x in ("__n", "__c", "__d", "__g"))
    name, category = F.col("name"), F.col("category")
    color = color_of(category)
    blend_text = F.regexp_extract(d, r"((?:\d{1,3}\s?%\s?[A-Za-zÀ-ÿ' .-]+?(?:,|\band\b|$|\s(?=\d)))+)", 1)
    varietal = F.regexp_extract(c, r"^(?:RED|WHITE) VARIETAL - (.+)$", 1)
    base = base.select(
        "*",
        F.regexp_replace(F.trim(blend_text), r"[,\s]+$", "").alias("__blend"),
        plain_upper(blend_text).alias("__bt"),
        F.when(varietal.rlike("MISC"), "").otherwise(varietal).alias("__vt"),
    )
    found = base.select(
        "*",
        _first_hit(_hits("__d", [r[1] for r in R.TEXT_FIZZ], "__l")).alias("__f"),
        _first_hit(_sweet_hits("__d", "__l")).alias("__s"),
        _first_hit(_hits("__d", [r[1] for r in R.TEXT_BODY], "__l")).alias("__b"),
        _named(F.expr(f"sequence(0, {len(R.TEXT_TAGS) - 1})"), _hits("__d", [r[1] for r in R.TEXT_TAGS], "__l")).alias("__t"),
        _first_hit(_hits("__n", [p for p, _ in R.LABEL_SWEETNESS])).alias("__l1"),
        _first_hit(_hits("__n", [p for p, _ in R.NAME_REGIONS])).alias("__r1"),
        _first_hit(_hits("__u", [p for p, _ in R.NAME_REGIONS])).alias("__r2"),
        _first_hit(_hits("__c", [p for p, _ in R.CATEGORY_REGIONS])).alias("__r3"),
        _first_hit(_hits("__n", [p for p, _, _ in R.APPELLATIONS])).alias("__a"),
        find_grapes("__bt", "__n", "__vt", "__u").alias("__g4"),
    ).select("*", *[F.get(F.col("__g4"), F.lit(i)).alias(x) for i, x in enumerate(("__gb", "__gn", "__gc", "__gd"))])
    label = F.get(_strings([p for p, _ in R.LABEL_SWEETNESS]), F.col("__l1"))
    places = _strings([r for _, r in R.NAME_REGIONS])
    step = found.select(
        "*",
        F.when(color.isNotNull(), _attr(color, "product", "category", category, "high")).otherwise(_unknown()).alias("color"),
        F.when(c.rlike("^SPARKLING WINE"), _attr("sparkling", "product", "category", category, "high"))
        .when(n.rlike(r"\bFRIZZANTE\b|\bPETILLANT\b|\bMOSCATO D'ASTI\b"), _attr("lightly sparkling", "product", "name", name, "high"))
        .when(
            n.rlike(r"\bSPARKLING\b|\bSPUMANTE\b|\bPROSECCO\b|\bCAVA\b|\bCHAMPAGNE\b|\bCREMANT\b"),
            _attr("sparkling", "product", "name", name, "high"),
        )
        .when(F.col("__f").isNotNull(), _text_attr(R.TEXT_FIZZ, F.col("__f"), d, g))
        .otherwise(_attr("still", "product", "category", category, "medium"))
        .alias("fizz"),
        F.when(F.col("__r1").isNotNull(), _attr(F.get(places, F.col("__r1")), "product", "name", name, "high"))
        .when(
            F.col("__r2").isNotNull(),
            _attr(
                F.get(places, F.col("__r2")), "product", "listing_text",
                quote_around(d, F.get(_strings(["(?i)" + p for p, _ in R.NAME_REGIONS]), F.col("__r2"))),
                F.when(g, "low").otherwise("high"),
            ),
        )
        .when(
            F.col("__r3").isNotNull(),
            _attr(F.get(_strings([r for _, r in R.CATEGORY_REGIONS]), F.col("__r3")), "product", "category", category, "high"),
        )
        .otherwise(_unknown())
        .alias("region"),
        F.when(
            F.col("__l1").isNotNull(),
            _attr(
                F.get(_strings([v for _, v in R.LABEL_SWEETNESS]), F.col("__l1")), "product", "name", name, "high",
                F.concat(F.lit("labeled "), F.initcap(F.regexp_substr(n, label))),
            ),
        )
        .when(F.col("__s").isNotNull(), _text_attr(R.TEXT_SWEETNESS, F.col("__s"), d, g))
        .alias("__sweet"),
        F.when(F.col("__b").isNotNull(), _text_attr(R.TEXT_BODY, F.col("__b"), d, g)).alias("__body"),
        F.transform("__t", lambda i: _text_attr(R.TEXT_TAGS, i, d, g)).alias("__tags"),
        F.when(
            F.col("__a").isNotNull(),
            F.struct(
                F.get(_strings([x for _, x, _ in R.APPELLATIONS]), F.col("__a")).alias("grape"),
                F.get(_strings([x for _, _, x in R.APPELLATIONS]), F.col("__a")).alias("note"),
            ),
        ).alias("__ap"),
    )

    def grapes(value: Column, source: str, quote: Column, confidence, note=None) -> Column:
        return F.struct(
            value.alias("value"),
            F.lit("product").alias("evidence"),
            F.lit(source).alias("source"),
            quote.alias("quote"),
            (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"),
            (note if isinstance(note, Column) else F.lit(note)).cast("string").alias("note"),
        )

    none = F.lit(None)
    g_col = _first(
        [
            F.when(F.size("__gb") > 0, grapes(F.col("__gb"), "listing_text", F.col("__blend"), F.when(g, "medium").otherwise("high"))),
            F.when(F.size("__gn") > 0, grapes(F.col("__gn"), "name", name, "high")),
            F.when(F.col("__ap").isNotNull(), grapes(F.array("__ap.grape"), "name", name, "high", F.col("__ap.note"))),
            F.when(F.size("__gc") == 1, grapes(F.col("__gc"), "category", category, "medium")),
            F.when(
                F.size("__gd") == 1, grapes(F.col("__gd"), "listing_text", trim_quote(clean_quote(d)), F.when(g, "low").otherwise("medium"))
            ),
            F.struct(
                none.cast("array<string>").alias("value"), F.lit("none").alias("evidence"), none.cast("string").alias("source"),
                none.cast("string").alias("quote"), none.cast("string").alias("confidence"), none.cast("string").alias("note"),
            ),
        ]
    )
    step = step.withColumn("grapes", g_col)
    flat = step.select(
        "*",
        F.when(F.size("grapes.value") == 1, F.get(F.col("grapes.value"), F.lit(0))).alias("one_grape"),
        F.coalesce(F.array_contains("grapes.value", "Moscato"), F.lit(False)).alias("has_moscato"),
        *[n.rlike(p).alias(f) for f, p in R.NAME_FLAGS.items()],
    )
    cond = F.struct(
        F.col("color.value").alias("color"), F.col("fizz.value").alias("fizz"), F.col("region.value").alias("region"),
        "one_grape", "has_moscato", *R.NAME_FLAGS,
    )
    flat = flat.withColumn("__k", cond)
    names = ["color", "fizz", "region", "one_grape", "has_moscato", *R.NAME_FLAGS]

    def applies(sql: str) -> Column:
        return F.coalesce(F.expr(re.sub(r"'[^']*'|\b(" + "|".join(names) + r")\b", lambda m: f"__k.{m[1]}" if m[1] else m[0], sql)), F.lit(False))

    holding = F.array(*[applies(rule[1]) for rule in R.STYLE_RULES])
    flat = flat.withColumn("__style", _named(F.expr(f"sequence(0, {len(R.STYLE_RULES) - 1})"), holding))

    def style(part: int) -> Column:
        """What the first style rule that holds says about one attribute."""
        says = F.array(*[F.lit(rule[part]).cast("string") for rule in R.STYLE_RULES])
        i = F.get(F.filter("__style", lambda i: F.get(says, i).isNotNull()), F.lit(0))
        return F.when(i.isNotNull(), _style_attr(F.get(says, i), i))

    said = F.transform("__tags", lambda t: t["value"])
    tag_of = F.array(*[F.lit(rule[4]).cast("string") for rule in R.STYLE_RULES])
    fresh = F.array_except(F.array_compact(F.transform("__style", lambda i: F.get(tag_of, i))), said)
    styled = F.transform(
        fresh, lambda tag: _style_attr(tag, F.get(F.filter("__style", lambda i: F.get(tag_of, i) == tag), F.lit(0)))
    )
    return flat.select(
        *keep,
        "color",
        "grapes",
        "region",
        "fizz",
        _first([F.col("__sweet"), style(2), _unknown()]).alias("sweetness"),
        _first([F.col("__body"), style(3), _unknown()]).alias("body"),
        F.concat("__tags", styled).alias("tags"),
    )


def _style_attr(value: Column, rule: Column) -> Column:
    def part(i: int, prefix: str = "") -> Column:
        return F.get(_strings([prefix + r[i] for r in R.STYLE_RULES]), rule)

    return _attr(value, "style", part(0, "style:"), None, part(5), part(6))


def input_hash(items: DataFrame, fields: Sequence[str]) -> Column:
    """Changes when the rules or an input field change."""
    return F.sha1(F.concat_ws("␟", F.lit(R.VERSION), *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))


def incremental_extract(items: DataFrame, stored: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Only the items whose inputs differ from the stored hash ``(key, input_hash)``."""
    hashed = items.withColumn("input_hash", input_hash(items, fields))
    return hashed.join(stored.select(key, "input_hash"), [key, "input_hash"], "left_anti")


def override_map(overrides: DataFrame, key: str = "key") -> DataFrame:
    """One map per key: attribute -> (value, note, reviewed_on). A key has at most
    one row per attribute."""
    entry = F.struct("attribute", F.struct("value", "note", "reviewed_on"))
    return overrides.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("overrides"))


def override_map_merge(profiles: DataFrame, overrides: DataFrame, key: str = "key") -> DataFrame:
    """Profiles with reviewed corrections: a value replaces, null means unknown,
    ``tag:x`` adds or removes a tag."""
    m = profiles.join(override_map(overrides, key), key, "left")

    def merged(attr: str) -> Column:
        o = F.try_element_at("overrides", F.lit(attr))
        manual = _attr(o["value"], "manual", F.concat(F.lit("override:"), o["reviewed_on"]), None, F.when(o["value"].isNotNull(), "high"), o["note"])
        return F.when(o.isNotNull(), manual).otherwise(F.col(attr)).alias(attr)

    keys = F.coalesce(F.map_keys("overrides"), F.array().cast("array<string>"))
    named = F.filter(keys, lambda x: x.startswith("tag:"))
    kept = F.filter("tags", lambda t: ~F.array_contains(named, F.concat(F.lit("tag:"), t["value"])))
    o = lambda x: F.try_element_at("overrides", x)
    added = F.transform(
        F.filter(F.array_sort(named), lambda x: o(x)["value"] == "true"),
        lambda x: _attr(F.substr(x, F.lit(5)), "manual", F.concat(F.lit("override:"), o(x)["reviewed_on"]), None, "high", o(x)["note"]),
    )
    gv = F.try_element_at("overrides", F.lit("grapes"))
    grapes = F.when(
        gv.isNotNull(),
        F.struct(
            F.when(gv["value"].isNotNull(), F.split(gv["value"], r"\|")).alias("value"),
            F.lit("manual").alias("evidence"),
            F.concat(F.lit("override:"), gv["reviewed_on"]).alias("source"),
            F.lit(None).cast("string").alias("quote"),
            F.when(gv["value"].isNotNull(), "high").alias("confidence"),
            gv["note"].alias("note"),
        ),
    ).otherwise(F.col("grapes"))
    excluded = F.coalesce(F.try_element_at("overrides", F.lit("exclude"))["value"] == "true", F.lit(False))
    simple = ["color", "region", "fizz", "sweetness", "body"]
    keep = [c for c in profiles.columns if c not in (*simple, "grapes", "tags")]
    return m.select(
        *keep, *[merged(a) for a in simple], grapes.alias("grapes"), F.concat(kept, added).alias("tags"), excluded.alias("excluded")
    )


@dataclass(frozen=True)
class Request:
    """What a visitor asks for. ``area`` stands for having chosen one."""

    id: str
    type: str | None = None
    grape: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    sweet: str | None = None
    body: str | None = None
    tags: tuple[str, ...] = field(default=())
    novelty: str | None = None
    area: str | None = None


REQUESTS = (
    "id string, type string, grape string, min_price double, max_price double, sweet string, body string, "
    "tags array<string>, novelty string, area string"
)


def request_table(spark: SparkSession, requests: Sequence[Request]) -> DataFrame:
    """Requests as rows, as the scoring takes them."""
    rows = [(r.id, r.type, r.grape, r.min_price, r.max_price, r.sweet, r.body, list(r.tags), r.novelty, r.area) for r in requests]
    return spark.createDataFrame(rows, REQUESTS)


def _weight(a: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in R.WEIGHTS.items() for x in kv])
    manual = F.when(a["evidence"] == "manual", F.lit(1.0))
    return F.coalesce(manual, F.try_element_at(table, F.concat_ws(" ", a["evidence"], a["confidence"])), F.lit(0.0))


def _points(table: Mapping[str, Mapping[str, float]], wish: Column, value: Column) -> Column:
    flat = F.create_map(*[F.lit(x) for w, row in table.items() for v, p in row.items() for x in (f"{w} {v}", p)])
    return F.when(wish.isNotNull(), F.try_element_at(flat, F.concat_ws(" ", wish, value)))


def evidence_score(r: Column) -> tuple[Column, Column, Column, Column]:
    """Points, contradiction, number of unknowns, and the contributions of a request
    ``r`` (a struct as in ``REQUESTS``) over a profile with ``less_common`` and ``rarity_tier``."""

    def contribution(attribute: Column, points: Column, reason: Column) -> Column:
        return F.struct(attribute.alias("attribute"), points.cast("double").alias("points"), reason.alias("reason"))

    parts: list[Column] = []
    unknowns, contradicted = F.lit(0), F.lit(False)
    for attr, wish, table, limit in (("sweetness", "sweet", R.SWEET_POINTS, -3.0), ("body", "body", R.BODY_POINTS, -2.0)):
        a = F.col(attr)
        raw = _points(table, r[wish], a["value"])
        parts.append(F.when(raw.isNotNull(), contribution(F.lit(attr), raw * _weight(a), describe(F.lit(attr), a))))
        unknowns = unknowns + (r[wish].isNotNull() & a["value"].isNull()).cast("int")
        contradicted = contradicted | F.coalesce((raw <= limit) & a["evidence"].isin("product", "manual"), F.lit(False))

    def for_tag(tag: Column) -> Column:
        t = F.get(F.filter("tags", lambda x: x["value"] == tag), F.lit(0))
        name = F.concat(F.lit("tag:"), tag)
        fizzy = (tag == "refreshing") & F.col("fizz.value").isNotNull() & (F.col("fizz.value") != "still")
        return F.when(t.isNotNull(), contribution(name, 1.5 * _weight(t), describe(tag, t))).when(
            fizzy, contribution(name, F.lit(0.5), F.concat(F.lit("It is "), F.col("fizz.value")))
        )

    common = r["novelty"].isin("style", "ask") & F.col("less_common").isNotNull()
    scarce = (r["novelty"] == "scarce") & F.col("rarity_tier").isin("uncommon", "scarce")
    new = F.when(common, contribution(F.lit("novelty"), F.when(r["novelty"] == "ask", 1.5).otherwise(2.0), F.col("less_common"))).when(
        scarce, contribution(F.lit("novelty"), F.lit(2.0), F.concat(F.lit("Rated "), F.col("rarity_tier")))
    )
    tags = F.transform(F.coalesce(r["tags"], F.array().cast("array<string>")), for_tag)
    contributions = F.array_compact(F.concat(F.array(*parts), tags, F.array(new)))
    total = F.aggregate(contributions, F.lit(0.0), lambda s, x: s + x["points"]) - 0.5 * unknowns
    return total, contradicted, unknowns, contributions


def describe(label: Column, a: Column) -> Column:
    """One sentence about an attribute, worded by its evidence."""
    title = F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2)))
    return (
        F.when(a["evidence"] == "manual", F.concat(title, F.lit(": "), a["value"], F.lit(" (reviewed).")))
        .when(a["evidence"] == "style", F.concat(F.lit("Style note: "), F.coalesce(a["note"], a["value"]), F.lit(" (general).")))
        .when(a["source"] == "listing_text", F.concat(F.lit("The listing describes it as "), a["value"], F.lit(": “"), a["quote"], F.lit("”")))
        .when(a["source"] == "name", F.concat(F.lit("Its name says "), a["value"], F.lit(".")))
        .otherwise(F.concat(title, F.lit(": "), a["value"], F.lit(".")))
    )


def evidence_count() -> Column:
    """How many main attributes rest on the product itself."""
    return reduce(
        lambda a, b: a + b,
        [F.col(f"{x}.evidence").isin("product", "manual").cast("int") for x in ("sweetness", "body", "grapes", "region")],
    )


def grape_shares(items: DataFrame, group: str, grapes: str) -> DataFrame:
    """Each single grape's share of its group, and whether it is less common."""
    one = items.where((F.size(grapes) == 1) & F.col(group).isNotNull()).select(
        F.col(group).alias("grp"), F.get(F.col(grapes), F.lit(0)).alias("grape")
    )
    counts = one.groupBy("grp", "grape").agg(F.count("*").alias("n"))
    totals = counts.groupBy("grp").agg(F.sum("n").alias("total"))
    return counts.join(totals, "grp").withColumn("share", F.round(F.col("n") / F.col("total"), 6))


def with_less_common(profiles: DataFrame, shares: DataFrame, limit: float = 0.04, at_least: int = 50) -> DataFrame:
    """Adds the "less common here" line where a grape's share is low enough."""
    rare = shares.where((F.col("n") / F.col("total") < limit) & (F.col("total") >= at_least)).select(
        "grp",
        F.col("grape").alias("one_grape"),
        F.concat(
            F.lit("Less common here: "), "grape", F.lit(" is "), F.col("n").cast("string"), F.lit(" of "),
            F.format_number("total", 0), F.lit(" of its kind"),
        ).alias("less_common"),
    )
    one = F.when((F.size("grapes.value") == 1) & (F.col("grapes.evidence") != "none"), F.get(F.col("grapes.value"), F.lit(0)))
    return profiles.withColumn("one_grape", one).join(rare, ["grp", "one_grape"], "left").drop("one_grape")


def evidence_crosstab(profiles: DataFrame) -> DataFrame:
    """Attribute by kind of evidence, source and confidence."""
    kinds = [F.struct(F.lit(a).alias("attribute"), F.col(f"{a}.evidence").alias("evidence"), F.col(f"{a}.source").alias("source"), F.col(f"{a}.confidence").alias("confidence")) for a in ("sweetness", "body", "grapes", "region")]
    return (
        profiles.select(F.explode(F.array(*kinds)).alias("x"))
        .groupBy("x.attribute", "x.evidence", "x.source", "x.confidence")
        .agg(F.count("*").alias("items"))
    )


def tag_crosstab(profiles: DataFrame) -> DataFrame:
    return (
        profiles.select(F.explode("tags").alias("t")).groupBy(F.col("t.value").alias("tag"), F.col("t.evidence").alias("evidence")).agg(F.count("*").alias("items"))
    )


def group_totals(profiles: DataFrame) -> DataFrame:
    """Profiles per style group, with a grand total."""
    return profiles.rollup("grp").agg(
        F.count("*").alias("items"),
        F.count_if("generic").alias("generic_text"),
        F.count_if(F.col("identity") != "ok").alias("ambiguous"),
        F.count_if("checked_recently").alias("checked"),
    )


def values_struct(prefix: str = "") -> Column:
    """The values of a profile, for comparing a review with the present."""
    return F.struct(
        *[F.col(f"{prefix}{a}.value").alias(a) for a in ("grapes", "region", "fizz", "sweetness", "body")],
        F.transform(F.col(f"{prefix}tags"), lambda t: t["value"]).alias("tags"),
    )


def review_drift(reviews: DataFrame, profiles: DataFrame, key: str = "key") -> DataFrame:
    """Per verdict: reviewed profiles and those that changed since.

    ``reviews``: (key, verdict, reviewed), reviewed as ``values_struct``."""
    now = profiles.select(key, values_struct().alias("now"))
    return (
        reviews.join(now, key)
        .groupBy("verdict")
        .agg(F.count("*").alias("profiles"), F.count_if(~F.col("reviewed").eqNullSafe(F.col("now"))).alias("changed"))
    )


def evidence_lines(profiles: DataFrame, key: str = "key") -> DataFrame:
    """Everything behind a profile, in a fixed order: attribute, text, kind, source."""
    labels = {"listing_text": "Listing text", "name": "Product name", "category": "Category"}

    def source(a: Column) -> Column:
        return (
            F.when(a["evidence"] == "manual", F.concat(F.lit("Reviewed correction ("), F.regexp_replace(a["source"], "override:", ""), F.lit(")")))
            .when(a["evidence"] == "style", "General style knowledge")
            .otherwise(F.coalesce(lookup(labels, a["source"]), F.lit("Listing")))
        )

    def line(attribute: str, text: Column, a: Column, when: Column) -> Column:
        return F.when(
            when & (a["evidence"] != "none"),
            F.struct(F.lit(attribute).alias("attribute"), text.alias("text"), a["evidence"].alias("kind"), source(a).alias("source")),
        )

    def worded(a: Column) -> Column:
        return (
            F.when(a["evidence"] == "style", F.concat(F.lit("usually "), a["value"], F.lit(": "), a["note"]))
            .when(a["quote"].isNotNull() & (a["source"] == "listing_text"), F.concat(a["value"], F.lit(" (“"), a["quote"], F.lit("”)")))
            .otherwise(a["value"])
        )

    g, r, f, s, b = (F.col(x) for x in ("grapes", "region", "fizz", "sweetness", "body"))
    missing = F.struct(
        F.lit("Sweetness").alias("attribute"), F.lit("not stated, and no general rule for this style").alias("text"),
        F.lit("unknown").alias("kind"), F.lit("Unknown").alias("source"),
    )
    main = F.array(
        line("Grape", F.array_join(g["value"], ", "), g, F.size(g["value"]) > 0),
        line("Region", r["value"], r, r["value"].isNotNull()),
        line("Style", f["value"], f, f["value"] != "still"),
        F.coalesce(line("Sweetness", worded(s), s, s["value"].isNotNull()), missing),
        line("Body", worded(b), b, b["value"].isNotNull()),
    )
    tags = F.transform(
        "tags", lambda t: F.struct(F.lit("Described as").alias("attribute"), worded(t).alias("text"), t["evidence"].alias("kind"), source(t).alias("source"))
    )
    return profiles.select(key, F.concat(F.array_compact(main), tags).alias("lines"))


def stratified_sample(
    items: DataFrame, group: str, key: str, price: str, stock: str, listed: str, quotas: Mapping[str, int], price_step: float = 25.0, stock_step: float = 10.0
) -> DataFrame:
    """A stable sample spread over price and stock thirds of each group.

    Within a cell, read items come first, then hash order; cells take turns
    until the group's quota is met. Thirds come from running counts over price
    and stock steps, so a large group is never sorted in one task."""
    rows = items.select(group, key, price, F.coalesce(F.col(stock), F.lit(-1)).alias("__s"), listed)
    rows = skew.ntile(rows, [group], [price, key], F.floor(F.col(price) / price_step), 3, "price_third")
    # Items of unknown stock are all tied, so they are cut along the key that breaks ties.
    number = not isinstance(items.schema[key].dataType, T.StringType)
    along = F.floor(F.col(key) / 1000) if number else F.substring(key, 1, 4)
    steps = F.struct(F.floor(F.col("__s") / stock_step).alias("step"), F.when(F.col("__s") == -1, along).alias("part"))
    rows = skew.ntile(rows, [group], ["__s", key], steps, 3, "stock_third")
    quota = lookup({g: str(q) for g, q in quotas.items()}, F.col(group)).cast("int")
    cell = Window.partitionBy(group, "price_third", "stock_third").orderBy(F.col(listed).desc(), F.md5(F.col(key).cast("string")), F.col(key))
    most = max(quotas.values())
    ranked = rows.withColumn("rn", F.row_number().over(cell)).where(F.col("rn") <= most)
    turn = Window.partitionBy(group).orderBy("rn", "price_third", "stock_third")
    return (
        ranked.withColumn("place", F.row_number().over(turn))
        .where(F.col("place") <= most)
        .where(F.col("place") <= F.coalesce(quota, F.lit(0)))
        .select(group, key, "price_third", "stock_third", "place")
    )


def parse_requests(log: DataFrame, areas: Sequence[str] = (), q: str = "q") -> DataFrame:
    """Typed wishes -> structured requests: type, grape, prices, area, sweetness,
    body, up to four tags, novelty, the words no rule used, and whether the text
    asks for taste picks."""
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(q)), "[’‘]", "'"), r"\s+", " ")), F.lit(" "))
    t = F.col("t")
    near = r"\b(?:near|around|close to|by|in)\s+(me|here|my area|[a-z][a-z .'-]{1,30}?)(?=[,.;!?]| under| below| for| with| and| that| which| $)"
    nearby = r"\bnearby\b|\bclose by\b"
    span = r"\$?\s?(\d{1,4})\s?(?:-|–|to|and)\s?\$?\s?(\d{1,4})\b"
    under = r"\b(?:under|below|less than|up to|max(?:imum)?|no more than|at most|<)\s*\$?\s?(\d{1,4})\b"
    about = r"\b(?:around|about|roughly|~)\s*\$\s?(\d{1,4})\b"
    plain = r"\$\s?(\d{1,4})\b"
    cheap = r"\b(?:cheap|inexpensive|budget|affordable|bargain)\b"
    white_zin = r"\bwhite zin(?:fandel)?\b"
    tables = {"grape": R.ASK_GRAPES, "type": R.ASK_TYPES, "sweet": R.ASK_SWEET, "body": R.ASK_BODY, "novelty": R.ASK_NOVELTY}

    # Each rule is tried once: the place of the first hit in its table is kept.
    first = {
        name: F.array_position(F.array(*[t.rlike(ascii_words(rule[0])) for rule in rules]), True).cast("int")
        for name, rules in tables.items()
    }
    found = log.select(q, text.alias("t")).select(
        q,
        "t",
        *[c.alias(f"i_{name}") for name, c in first.items()],
        F.trim(F.regexp_extract(t, near, 1)).alias("place"),
        *[t.rlike(p).alias(n) for n, p in (("h_under", under), ("h_span", span), ("h_about", about), ("h_plain", plain), ("h_cheap", cheap), ("zin", white_zin), ("summer", R.ASK_SUMMER), ("h_nearby", nearby))],
        t.rlike(r"\$|between|dollars|bucks").alias("money"),
        F.array(*[t.rlike(p) for p, _ in R.ASK_TAGS]).alias("h_tags"),
    )

    def table(name: str, i: int) -> Column:
        """Column ``i`` of the rule that hit, null without one."""
        return F.get(F.array(*[F.lit(rule[i]).cast("string") for rule in tables[name]]), F.col(f"i_{name}") - 1)

    def num(pattern: str, i: int = 1) -> Column:
        return F.regexp_extract(t, pattern, i).try_cast("double")

    known = lookup({a.lower(): a for a in areas}, F.col("place")) if areas else F.lit(None).cast("string")
    chosen = (
        found.withColumn("i_grape", F.when(F.col("zin"), 0).otherwise(F.col("i_grape")))
        .withColumn("implied", F.when(F.col("zin"), "rose").otherwise(table("grape", 2)))
        .withColumn("i_type", F.when(F.col("implied").isNotNull(), 0).otherwise(F.col("i_type")))
        .withColumn("near_area", F.when(F.col("place").rlike("^(me|here|my area)$"), "me").otherwise(known))
        .withColumn("by_span", F.expr("h_span and money and not h_under"))
        .withColumn("by_about", F.expr("h_about and not h_under and not by_span"))
        .withColumn("by_plain", F.expr("h_plain and not h_under and not by_span and not by_about"))
        .withColumn(
            "stated",
            F.when(F.col("h_under"), num(under))
            .when(F.col("by_span"), F.greatest(num(span, 1), num(span, 2)))
            .when(F.col("by_about"), F.floor(num(about) * 1.2 + 0.5).cast("double"))
            .when(F.col("by_plain"), num(plain)),
        )
        .withColumn("by_cheap", F.expr("h_cheap and stated is null"))
    )

    # Used words are blanked in place, by the positions they have in the text.
    def place_of(pattern: Column, when: Column) -> tuple[Column, Column]:
        on = F.coalesce(when, F.lit(False))
        return F.regexp_instr(t, pattern), F.when(on, F.length(F.regexp_substr(t, pattern))).otherwise(0)

    used = [
        place_of(F.lit(near), F.col("near_area").isNotNull()),
        place_of(F.lit(nearby), F.expr("h_nearby and near_area is null")),
        place_of(F.lit(under), F.col("h_under")),
        place_of(F.lit(span), F.col("by_span")),
        place_of(F.lit(about), F.col("by_about")),
        place_of(F.lit(plain), F.col("by_plain")),
        place_of(F.lit(cheap), F.col("by_cheap")),
        place_of(F.lit(white_zin), F.col("zin")),
        *[
            place_of(F.get(F.array(*[F.lit(ascii_words(rule[0])) for rule in rules]), F.col(f"i_{name}") - 1), F.col(f"i_{name}") > 0)
            for name, rules in tables.items()
        ],
        *[place_of(F.lit(p), F.get(F.col("h_tags"), F.lit(i))) for i, (p, _) in enumerate(R.ASK_TAGS)],
    ]
    blank = t
    for i, n in used:
        n = F.coalesce(n, F.lit(0))
        blank = F.overlay(blank, F.repeat(F.lit(" "), n), F.greatest(F.coalesce(i, F.lit(1)), F.lit(1)), n)
    blank = F.regexp_replace(blank, R.ASK_SUMMER, " ")
    words = F.transform(
        F.regexp_extract_all(blank, F.lit(r"[a-z][a-z'-]*"), F.lit(0)), lambda w: F.regexp_replace(w, r"'s$", "")
    )
    stated_tags = F.array_compact(F.array(*[F.when(F.get(F.col("h_tags"), F.lit(i)), tag) for i, (_, tag) in enumerate(R.ASK_TAGS)]))
    tags = F.when(
        F.col("summer"), F.array_distinct(F.concat(stated_tags, F.array(F.lit("refreshing"), F.lit("crisp"))))
    ).otherwise(stated_tags)
    parsed = chosen.select(
        q,
        "t",
        F.coalesce("implied", table("type", 1)).alias("type"),
        table("grape", 1).alias("grape"),
        F.when(F.col("by_span"), F.least(num(span, 1), num(span, 2))).alias("min_price"),
        F.when(F.col("by_cheap"), 15.0).otherwise(F.col("stated")).alias("max_price"),
        F.coalesce("near_area", F.when(F.col("h_nearby"), "me")).alias("area"),
        table("sweet", 1).alias("sweet"),
        F.coalesce(table("body", 1), F.when(F.col("summer"), "light")).alias("body"),
        F.slice(tags, 1, 4).alias("tags"),
        table("novelty", 1).alias("novelty"),
        F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(R.ASK_STOP))).alias("unused"),
    )
    wineish = F.col("type").isNotNull() | F.col("grape").isNotNull() | F.col("t").rlike(r"\bwines?\b|\bvino\b")
    wish = F.col("sweet").isNotNull() | F.col("body").isNotNull() | (F.size("tags") > 0) | F.col("novelty").isNotNull()
    return parsed.withColumn("is_taste", wineish & wish).drop("t")
