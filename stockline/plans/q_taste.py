"""Queries over text attributes and recommendations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import session
from ..functions import taste_rules as R
from ..operators import picks as P, taste as T
from .registry import define, query

# Names, categories and opening sentences dealt out to documents.
NAMES = [
    "HOUSE RIESLING 750ml", "OLD MILL PINOT NOIR", "CASA BRUT NATURE", "DOMAINE CHABLIS '21/23", "VILLA MOSCATO D'ASTI", "NAPA CAB SAUV RESERVE",
    "RIVER CABERNET FRANC", "ESTATE DEMI-SEC", "QUINTA VINHO VERDE", "LODI ZIN OLD VINE", "TABLE WINE (USE 460445)", "SONOMA GRENACHE ROSE",
]
WINE_CATEGORIES = [
    "WHITE VARIETAL - RIESLING", "RED VARIETAL - PINOT NOIR", "SPARKLING WINE - PROSECCO", "FRENCH WHITE - BURGUNDY", "ROSE WINE - DOMESTIC",
    "AUSTRALIAN RED - SHIRAZ", "RED VARIETAL - MALBEC",
]
OPENINGS = [
    "A light-bodied wine, not too sweet. Crisp and refreshing.", "Full-bodied with sweet tannins and vanilla.", "Off-dry, with a hint of sweetness and floral notes.",
    "Bone-dry and flinty; bright acidity. 92 points Wine Spectator.", "Juicy, fruity and smooth.", "Blend: 91% Riesling, 9% Muscat.", "A bold red with pepper and oak.",
    "Dessert wine, lusciously sweet.", "Medium-bodied, earthy and velvety.", "Grown in Marlborough. Delicate, lightly sparkling.",
]


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


define("v_generic", "select sha256(text) as h, count(*) as copies from documents group by 1 having count(*) >= 2")
define(
    "v_wines",
    f"""select doc_id as key, ({_list(NAMES)})[doc_id % {len(NAMES)} + 1] as name, ({_list(WINE_CATEGORIES)})[doc_id % {len(WINE_CATEGORIES)} + 1] as category,
              ({_list(OPENINGS)})[doc_id % {len(OPENINGS)} + 1] || ' ' || text as description, g.h is not null as generic, (5 + n_chars % 60)::double as price,
              text as body_text, source, n_chars
       from documents left join v_generic g on g.h = sha256(text)""",
)


def wines(t):
    """Documents as listings: an opening sentence, then the whole text."""
    d = t.table("documents")
    key = F.col("doc_id")
    flags = T.duplicate_text_flag(d, "doc_id", "text").select("doc_id", "generic")
    return d.join(flags, "doc_id").select(
        key.alias("key"),
        _pick(NAMES, key % len(NAMES)).alias("name"),
        _pick(WINE_CATEGORIES, key % len(WINE_CATEGORIES)).alias("category"),
        F.concat(_pick(OPENINGS, key % len(OPENINGS)), F.lit(" "), "text").alias("description"),
        "generic",
        (5 + F.col("n_chars") % 60).cast("double").alias("price"),
    )


# The oracle has no lookaround: words after which a match does not count are
# taken out first, words that must follow are written out.
_CUT = {
    "Cabernet Sauvignon": ("CABERNET FRANC|CAB FRANC", r"\bCABERNET\b|\bCAB\b"),
    "Syrah": ("PETITE SYRAH", r"\bSYRAH\b|\bSHIRAZ\b"),
    "Grenache": ("GRENACHE BLANC|GARNACHA BLANCA", r"\bGRENACHE\b|\bGARNACHA\b"),
}


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _re(text: str, pattern: str, fold: bool = False) -> str:
    pattern = pattern.replace(r"\bPN\b(?=.*\bPINOT\b)", r"\bPN\b.*\bPINOT\b").replace(r"\bRR\b(?=.*PINOT)", r"\bRR\b.*PINOT")
    pattern = re.sub(r"\(\?!\[a-z\]\)", "([^a-z]|$)", pattern)
    if "(?! CREEK)" in pattern:
        pattern, text = pattern.replace("(?! CREEK)", ""), f"replace({text}, 'DRY CREEK', '')"
    return f"regexp_matches({text}, {_q(('(?i)' if fold else '') + pattern)})"


def _grapes(text: str) -> str:
    parts = []
    for grape, pattern in R.GRAPES:
        if grape in _CUT:
            cut, rest = _CUT[grape]
            hit = _re(f"regexp_replace({text}, '{cut}', '~', 'g')", rest)
            if grape == "Cabernet Sauvignon":
                sauv = _re(text, r"\bCAB(?:ERNET)?\.? SAUV(?:IGNON)?\b")
                other = f"({_re(text, 'CAB(?:ERNET)?[.]? SAUV')} or {_re(f'''regexp_replace({text}, 'CAB(?:ERNET)?[.]? FRANC', '', 'g')''', chr(92) + 'bCABERNET' + chr(92) + 'b')})"
                hit = f"(({hit} or {sauv}) and (not {_re(text, r'CAB(?:ERNET)?[.]? FRANC')} or {other}))"
        else:
            hit = _re(text, pattern)
        parts.append(f"case when {hit} then {_q(grape)} end")
    return f"list_filter([{', '.join(parts)}], lambda x: x is not null)"


def _case(rules, text: str, fold: bool = False) -> str:
    return "case " + " ".join(f"when {_re(text, p, fold)} then {_q(v)}" for p, v in rules) + " end"


_UP = "translate(upper({x}), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'AAAAAACEEEEIIIINOOOOOUUUUY')"
define("o_w0", f"select *, {_UP.format(x='name')} as n, upper(category) as c, trim(description) as d, {_UP.format(x='trim(description)')} as u from v_wines")
define(
    "o_w1",
    f"""select *, {_grapes('n')} as gn, {_grapes('u')} as gd, {_grapes("regexp_extract(c, '^(?:RED|WHITE) VARIETAL - (.+)$', 1)")} as gc,
              case when d like 'Blend: 91\\% Riesling, 9\\% Muscat.%' escape '\\' then ['Riesling'] end as gb,
              {_case([(p, a) for p, a, _ in R.APPELLATIONS], 'n')} as ap,
              coalesce({_case(R.NAME_REGIONS, 'n')}, {_case(R.NAME_REGIONS, 'u')}, {_case(R.CATEGORY_REGIONS, 'c')}) as region,
              case when regexp_matches(c, '^ROSE WINE|^BLUSH WINE') then 'rose' when regexp_matches(c, '\\bWHITE\\b|^SPARKLING WINE') then 'white'
                   when regexp_matches(c, '\\bRED\\b') then 'red' end as color,
              case when c like 'SPARKLING WINE%' then 'sparkling' when regexp_matches(n, 'MOSCATO D''ASTI') then 'lightly sparkling'
                   when {_re('d', R.TEXT_FIZZ[0][1], True)} then 'lightly sparkling' else 'still' end as fizz,
              coalesce({_case(R.LABEL_SWEETNESS, 'n')}, {_case([(p, v) for v, p, _ in R.TEXT_SWEETNESS], 'd', True)}) as sw,
              {_case([(p, v) for v, p, _ in R.TEXT_BODY], 'd', True)} as bo,
              list_filter([{', '.join(f"case when {_re('d', p, True)} then '{v}' end" for v, p, _ in R.TEXT_TAGS)}], lambda x: x is not null) as tg,
              {', '.join(f"{_re('n', p)} as {f}" for f, p in R.NAME_FLAGS.items())}
       from o_w0""",
)
define(
    "o_w2",
    """select *, case when gb is not null then gb when len(gn) > 0 then gn when ap is not null then [ap] when len(gc) = 1 then gc when len(gd) = 1 then gd end as grapes
       from o_w1""",
)
define("o_w3", "select *, case when len(grapes) = 1 then grapes[1] end as one_grape, coalesce(list_contains(grapes, 'Moscato'), false) as has_moscato from o_w2")


def _styles(i: int) -> str:
    return "case " + " ".join(f"when {r[1]} then '{r[i]}'" for r in R.STYLE_RULES if r[i]) + " end"


# What a confidence counts for: a style rule's own, or that of a text, less if others share the text.
_OF_RULE = {"medium": 0.6, "low": 0.4}


def _rule_weight(i: int) -> str:
    return "case " + " ".join(f"when {r[1]} then {_OF_RULE[r[5]]}" for r in R.STYLE_RULES if r[i]) + " end"


def _text_weight(rules) -> str:
    stated = {"high": "case when generic then 0.8 else 1.0 end", "medium": "case when generic then 0.5 else 0.8 end"}
    return "case " + " ".join(f"when {_re('d', p, True)} then {stated[sure]}" for _, p, sure in rules) + " end"


_TAG_WEIGHT = "case " + " ".join(f"when tag = '{r[4]}' and coalesce({r[1]}, false) then {_OF_RULE[r[5]]}" for r in R.STYLE_RULES if r[4]) + " end"
_STYLE_TAGS = "[" + ", ".join(
    "case when (" + " or ".join(f"coalesce({r[1]}, false)" for r in R.STYLE_RULES if r[4] == tag) + f") and not list_contains(tg, '{tag}') then '{tag}' end"
    for tag in dict.fromkeys(r[4] for r in R.STYLE_RULES if r[4])
) + "]"
define(
    "o_profiles",
    f"""select key, name, category, generic, price, color, grapes, region, fizz, coalesce(sw, {_styles(2)}) as sweetness, coalesce(bo, {_styles(3)}) as body,
              case when sw is not null then 'product' when {_styles(2)} is not null then 'style' else 'none' end as sweet_evidence,
              case when bo is not null then 'product' when {_styles(3)} is not null then 'style' else 'none' end as body_evidence,
              list_concat(tg, list_filter({_STYLE_TAGS}, lambda x: x is not null)) as tags, len(tg) as text_tags,
              case when {_case(R.LABEL_SWEETNESS, 'n')} is not null then 1.0 when sw is not null then {_text_weight(R.TEXT_SWEETNESS)} else {_rule_weight(2)} end as sweet_weight,
              case when bo is not null then {_text_weight(R.TEXT_BODY)} else {_rule_weight(3)} end as body_weight,
              list_transform(list_concat(tg, list_filter({_STYLE_TAGS}, lambda x: x is not null)),
                lambda tag: case when list_contains(tg, tag) then case when generic then 0.8 else 1.0 end else {_TAG_WEIGHT} end) as tag_weights
       from o_w3""",
)


_PROFILES: dict = {}


def profiles(t):
    """The profile of every listing, written once per session as the job that
    extracts them would, and read by everything that ranks or reports."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _PROFILES:
        with session.many_rules(t.spark):
            _PROFILES[key] = session.checkpointed(T.attribute_extract(wines(t)))
    return _PROFILES[key]


@query(
    "attribute_extract",
    """select key, color, array_to_string(grapes, '|') as grapes, region, fizz, sweetness, sweet_evidence, body, body_evidence, array_to_string(tags, '|') as tags
       from o_profiles""",
)
def _(t):
    return profiles(t).select(
        "key",
        F.col("color.value").alias("color"),
        F.array_join("grapes.value", "|").alias("grapes"),
        F.col("region.value").alias("region"),
        F.col("fizz.value").alias("fizz"),
        F.col("sweetness.value").alias("sweetness"),
        F.col("sweetness.evidence").alias("sweet_evidence"),
        F.col("body.value").alias("body"),
        F.col("body.evidence").alias("body_evidence"),
        F.array_join(F.transform("tags", lambda x: x["value"]), "|").alias("tags"),
    )


@query("quote_clean")
def _(t):
    """Evidence quotes of sweetness and body: a sentence, no rating lines."""
    p = profiles(t)
    return p.where("sweetness.quote is not null or body.quote is not null").select(
        "key", F.col("sweetness.quote").alias("sweet_quote"), F.col("body.quote").alias("body_quote")
    )


@query("duplicate_text_flag", "select doc_id, g.h is not null as generic, coalesce(g.copies, 1) as copies from documents left join v_generic g on g.h = sha256(text)")
def _(t):
    return T.duplicate_text_flag(t.table("documents"), "doc_id", "text")


@query(
    "identity_flags",
    """select key, case when name like '%''21/23%' then 'several vintages in one name' when name like '%(USE %' then 'name points to another code' end as note,
              case when name like '%''21/23%' or name like '%(USE %' then 'ambiguous' else 'ok' end as status from v_wines""",
)
def _(t):
    return T.identity_flags(wines(t), "key", "name")


@query(
    "incremental_extract",
    "select key, sha1(concat_ws('␟', '1', name, category, price::varchar, description)) as input_hash from v_wines where key % 3 <> 0 or price > 30",
)
def _(t):
    rows = wines(t)
    fields = ["name", "category", "price", "description"]
    before = rows.where("key % 3 = 0").withColumn("price", F.when(F.col("price") > 30, F.col("price") + 1).otherwise(F.col("price")))
    stored = before.select("key", T.input_hash(before, fields).alias("input_hash"))
    return T.incremental_extract(rows, stored, "key", fields).select("key", "input_hash")


define(
    "v_attr_overrides",
    """select doc_id as key, 'sweetness' as attribute, case when toxic = 0 then 'dry' end as value from labels where quality = 0
       union all select doc_id, 'tag:smooth', (quality = 1)::varchar from labels
       union all select doc_id, 'exclude', 'true' from labels where toxic = 1""",
)


def attr_overrides(t):
    l = t.table("labels")
    extra = [F.lit("checked").alias("note"), F.lit("2024-01-15").alias("reviewed_on")]
    key = F.col("doc_id").alias("key")
    return (
        l.where("quality = 0").select(key, F.lit("sweetness").alias("attribute"), F.when(F.col("toxic") == 0, "dry").alias("value"), *extra)
        .unionByName(l.select(key, F.lit("tag:smooth").alias("attribute"), (F.col("quality") == 1).cast("string").alias("value"), *extra))
        .unionByName(l.where("toxic = 1").select(key, F.lit("exclude").alias("attribute"), F.lit("true").alias("value"), *extra))
    )


define(
    "o_merged",
    """select p.* replace (case when s.key is not null then s.value else p.sweetness end as sweetness, case when s.key is not null then 'manual' else p.sweet_evidence end as sweet_evidence,
                           case when s.key is not null then 1.0 else p.sweet_weight end as sweet_weight,
                           list_concat(case when m.key is not null then list_filter(p.tags, lambda x: x <> 'smooth') else p.tags end,
                                       case when m.value = 'true' then ['smooth'] else [] end) as tags,
                           list_concat(case when m.key is not null then list_filter(p.tag_weights, lambda x, i: p.tags[i] <> 'smooth') else p.tag_weights end,
                                       case when m.value = 'true' then [1.0] else [] end) as tag_weights),
              coalesce(e.value = 'true', false) as excluded
       from o_profiles p left join v_attr_overrides s on s.key = p.key and s.attribute = 'sweetness'
       left join v_attr_overrides m on m.key = p.key and m.attribute = 'tag:smooth' left join v_attr_overrides e on e.key = p.key and e.attribute = 'exclude'""",
)


def merged(t):
    return T.override_map_merge(profiles(t), attr_overrides(t))


@query("override_map_merge", "select key, sweetness, sweet_evidence, array_to_string(tags, '|') as tags, excluded from o_merged")
def _(t):
    return merged(t).select(
        "key", F.col("sweetness.value").alias("sweetness"), F.col("sweetness.evidence").alias("sweet_evidence"),
        F.array_join(F.transform("tags", lambda x: x["value"]), "|").alias("tags"), "excluded",
    )


_GROUP = """case when category like 'SPARKLING WINE%' then 'sparkling' when category like 'ROSE WINE%' or category like 'BLUSH WINE%' then 'rose'
                 when regexp_matches(split_part(category, ' - ', 1), '\\bWHITE\\b') then 'white' when regexp_matches(split_part(category, ' - ', 1), '\\bRED\\b') then 'red' end"""
define(
    "o_shares",
    f"""with g as (select {_GROUP} as grp, grapes[1] as grape from o_profiles where len(grapes) = 1), c as (select grp, grape, count(*) as n from g where grp is not null group by 1, 2)
        select grp, grape, n, sum(n) over (partition by grp)::bigint as total, round(n / sum(n) over (partition by grp), 6) as share from c""",
)


@query("grape_shares", "select * from o_shares")
def _(t):
    p = profiles(t)
    return T.grape_shares(p.withColumn("grp", T.style_group("category")).withColumn("g", F.col("grapes.value")), "grp", "g")


AREA = "NATION_3"
REQUESTS = (
    T.Request("dry-white", type="white", sweet="dry", max_price=40.0),
    T.Request("light-crisp", body="light", tags=("crisp", "refreshing")),
    T.Request("full-red", type="red", body="full", tags=("oaky", "spicy"), max_price=60.0),
    T.Request("sweet-near", sweet="sweet", area=AREA),
    T.Request("riesling", grape="Riesling", min_price=10.0),
    T.Request("other-red", type="red", novelty="style", min_price=7.5, max_price=52.5),
    T.Request("scarce-smooth", tags=("smooth",), novelty="scarce", min_price=20.0, area=AREA),
)


def ready(t):
    """Merged profiles with everything a request looks at."""
    key = F.col("key")
    p = merged(t).withColumn("grp", T.style_group("category"))
    shares = T.grape_shares(p.withColumn("g", F.col("grapes.value")), "grp", "g")
    return (
        T.with_less_common(p, shares)
        .withColumn("near_area", F.when(key % 3 == 0, AREA))
        .withColumn("near_stores", F.when(key % 3 == 0, (key % 4 + 1).cast("bigint")))
        .withColumn("checked_recently", key % 2 == 0)
        .withColumn("rarity_tier", F.when(key % 11 == 0, "scarce").when(key % 11 == 1, "uncommon").when(key % 11 == 2, "rare"))
    )


_PICKS: dict = {}


def picks(t):
    """The index of all listings, written once per session as the job that keeps it would."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _PICKS:
        _PICKS[key] = P.PickIndex.build(session.checkpointed(ready(t)))
    return _PICKS[key]


def _points_sql(table, wish: str, value: str) -> str:
    return "case " + " ".join(f"when {wish} = '{w}' and {value} = '{v}' then {p}" for w, row in table.items() for v, p in row.items()) + " end"


define(
    "v_asked_wines",
    "select * from (values "
    + ", ".join(
        "(" + ", ".join([*["null" if x is None else f"'{x}'" for x in (r.id, r.type, r.grape)], *["null::double" if x is None else f"{x}::double" for x in (r.min_price, r.max_price)],
                         *["null" if x is None else f"'{x}'" for x in (r.sweet, r.body)], f"{list(r.tags)}::varchar[]", *["null" if x is None else f"'{x}'" for x in (r.novelty, r.area)]]) + ")"
        for r in REQUESTS
    )
    + ") t(request, type, grape, min_price, max_price, sweet, body, wanted, novelty, area)",
)
# Points of every request over every listing, each part by its definition.
define(
    "o_scored",
    f"""with rare as (select grp, grape from o_shares where n / total < 0.04 and total >= 50),
       p as (select m.*, {_GROUP} as grp from o_merged m where not excluded),
       b as (select r.*, p.*, p.sweetness as tastes, p.body as feels, (x.grape is not null) as less_common,
                    {_points_sql(R.SWEET_POINTS, 'r.sweet', 'p.sweetness')} as s, {_points_sql(R.BODY_POINTS, 'r.body', 'p.body')} as o,
                    list_transform(wanted, lambda w: case when list_contains(tags, w) then 1.5 * tag_weights[list_position(tags, w)]
                      when w = 'refreshing' and fizz <> 'still' then 0.5 end) as found,
                    case when novelty in ('style', 'ask') and x.grape is not null then case novelty when 'ask' then 1.5 else 2.0 end
                         when novelty = 'scarce' and key % 11 in (0, 1) then 2.0 end as new
             from p join v_asked_wines r on (r.type is null or r.type = p.grp) and (r.grape is null or list_contains(p.grapes, r.grape))
               and (r.min_price is null or p.price >= r.min_price) and (r.max_price is null or p.price <= r.max_price)
             left join rare x on x.grp = p.grp and len(p.grapes) = 1 and x.grape = p.grapes[1])
       select request, key, price, area, sweet is not null or columns_body or len(wanted) > 0 or novelty is not null as wishes,
              (sweet is not null and tastes is null)::int + (columns_body and feels is null)::int as unknowns,
              round(coalesce(s * sweet_weight, 0) + coalesce(o * body_weight, 0) + coalesce(list_sum(found), 0) + coalesce(new, 0)
                - 0.5 * ((sweet is not null and tastes is null)::int + (columns_body and feels is null)::int), 6)::double as points,
              coalesce(s <= -3 and sweet_evidence in ('product', 'manual'), false) or coalesce(o <= -2 and body_evidence in ('product', 'manual'), false) as against,
              s is not null or o is not null or len(list_filter(found, lambda x: x is not null)) > 0 or new is not null as support,
              (sweet_evidence in ('product', 'manual'))::int + (body_evidence in ('product', 'manual'))::int + (grapes is not null)::int + (region is not null)::int as ev
       from (select *, o is not null or request in ({", ".join(repr(r.id) for r in REQUESTS if r.body)}) as columns_body from b)""",
)


@query("evidence_score", "select request, key, points, against as contradicted from o_scored")
def _(t):
    return P.scores(picks(t), REQUESTS)


_RANKED = """select request, key, row_number() over (partition by request order by points desc, case when area is not null then key % 4 + 1 else 0 end desc, ev desc, price, key)::int as place,
              points, price{more} from o_scored where (area is null or key % 3 = 0) and (not wishes or (points > 0 and not against)) qualify place <= 6"""


@query("recommend", _RANKED.format(more=""))
def _(t):
    return P.recommend(picks(t), REQUESTS).select("request", "key", "place", "points", "price")


@query("recommend_all", _RANKED.format(more=", unknowns, support as has_reason"))
def _(t):
    """With what is not known of each item, and whether there is a sentence for it."""
    return P.recommend(picks(t), REQUESTS).select("request", "key", "place", "points", "price", "unknowns", F.col("reason").isNotNull().alias("has_reason"))


@query(
    "eligibility_counts",
    """select request, count(*) filter (where area is null or key % 3 = 0) as eligible, count(*) filter (where area is not null and key % 3 <> 0 and key % 2 <> 0) as unknown_near,
              count(*) filter (where area is not null and key % 3 <> 0 and key % 2 = 0) as not_near, count(*) filter (where (area is null or key % 3 = 0) and wishes and not support) as no_info
       from o_scored group by 1""",
)
def _(t):
    return P.eligibility_counts(picks(t), REQUESTS)


@query(
    "evidence_crosstab",
    """select 'sweetness' as attribute, sweet_evidence as evidence, count(*) as items from o_profiles group by 2
       union all select 'body', body_evidence, count(*) from o_profiles group by 2
       union all select 'grapes', case when grapes is null then 'none' else 'product' end, count(*) from o_profiles group by 2
       union all select 'region', case when region is null then 'none' else 'product' end, count(*) from o_profiles group by 2""",
)
def _(t):
    return T.evidence_crosstab(profiles(t)).groupBy("attribute", "evidence").agg(F.sum("items").alias("items"))


@query(
    "tag_crosstab",
    """select tag, case when i <= text_tags then 'product' else 'style' end as evidence, count(*) as items
       from (select unnest(tags) as tag, unnest(generate_series(1, len(tags))) as i, text_tags from o_profiles) group by 1, 2""",
)
def _(t):
    return T.tag_crosstab(profiles(t))


@query(
    "pilot_totals",
    f"""select grp, count(*) as items, count(*) filter (where generic) as generic_text, count(*) filter (where name like '%''21/23%' or name like '%(USE %') as ambiguous,
              count(*) filter (where key % 2 = 0) as checked from (select *, {_GROUP} as grp from v_wines) group by rollup (grp)""",
)
def _(t):
    w = wines(t)
    flags = T.identity_flags(w, "key", "name").select("key", F.col("status").alias("identity"))
    return T.group_totals(
        w.join(flags, "key").withColumn("grp", T.style_group("category")).withColumn("checked_recently", F.col("key") % 2 == 0)
    )


@query(
    "review_drift",
    """with j as (select l.quality, p.key, p.sweetness as was, p.sweet_evidence, p.tags as wt, m.sweetness as now, m.tags as nt from labels l join o_profiles p on p.key = l.doc_id join o_merged m on m.key = p.key)
       select case quality when 1 then 'good' else 'fix' end as verdict, count(*) as profiles, count(*) filter (where was is distinct from now or wt <> nt) as changed from j group by 1""",
)
def _(t):
    reviewed = (
        profiles(t)
        .join(t.table("labels").select(F.col("doc_id").alias("key"), "quality"), "key")
        .select("key", F.when(F.col("quality") == 1, "good").otherwise("fix").alias("verdict"), T.values_struct().alias("reviewed"))
    )
    return T.review_drift(reviewed, merged(t))


@query(
    "evidence_lines",
    """select key, (case when grapes is not null then 1 else 0 end + case when region is not null then 1 else 0 end + case when fizz <> 'still' then 1 else 0 end + 1
              + case when body is not null then 1 else 0 end + len(tags))::int as lines, case when sweetness is null then 'unknown' else sweet_evidence end as sweet_kind from o_profiles""",
)
def _(t):
    rows = T.evidence_lines(profiles(t))
    return rows.select(
        "key", F.size("lines").alias("lines"), F.get(F.filter("lines", lambda x: x["attribute"] == "Sweetness"), F.lit(0))["kind"].alias("sweet_kind")
    )


QUOTAS = {"SMALL": 95, "MEDIUM": 85, "LARGE": 35, "PROMO": 45}


@query(
    "stratified_sample",
    """with c as (select *, ntile(3) over (partition by category order by current_price, csc)::int as price_third,
                         ntile(3) over (partition by category order by coalesce(store_qty, -1), csc)::int as stock_third, store_qty is not null as listed from v_catalog),
       r as (select *, row_number() over (partition by category, price_third, stock_third order by listed desc, md5(csc), csc) as rn from c)
       select category, csc, price_third, stock_third, row_number() over (partition by category order by rn, price_third, stock_third)::int as place from r
       qualify place <= case category when 'SMALL' then 95 when 'MEDIUM' then 85 when 'LARGE' then 35 when 'PROMO' then 45 else 0 end""",
)
def _(t):
    items = t.catalog.withColumn("listed", F.col("store_qty").isNotNull())
    return T.stratified_sample(items, "category", "csc", "current_price", "store_qty", "listed", QUOTAS)


# Parts of typed wishes with what they mean.
ASK_KINDS = [("white wine", "white"), ("bubbly", "sparkling"), ("rosé", "rose"), ("red", "red")]
ASK_SWEETS = [("not too sweet", "dry"), ("off-dry", "offdry"), ("sweet", "sweet"), ("bone-dry", "dry"), ("", None)]
ASK_BODIES = [("light", "light"), ("full-bodied", "full"), ("", None)]


def _opt(pairs, i):
    return "[" + ", ".join("null" if p[i] is None else "'" + p[i] + "'" for p in pairs) + "]"


@query(
    "taste_requests",
    f"""with x as (select p_partkey, p_size, ({_opt(ASK_KINDS, 1)})[p_partkey % 4 + 1] as type, ({_opt(ASK_SWEETS, 1)})[p_partkey % 5 + 1] as sweet, ({_opt(ASK_BODIES, 1)})[p_partkey % 3 + 1] as body,
                          ({_opt(ASK_KINDS, 0)})[p_partkey % 4 + 1] as k, ({_opt(ASK_SWEETS, 0)})[p_partkey % 5 + 1] as s, ({_opt(ASK_BODIES, 0)})[p_partkey % 3 + 1] as b, split_part(p_name, ' ', 2) as noun from part)
       select distinct 'Find me a ' || b || ' ' || k || ' ' || s || ' crisp for the ' || noun || ' under $' || p_size || ' near Alpha Town' as q, type, sweet, body, p_size::double as max_price, 'Alpha Town' as area,
              'crisp' as tags, noun as unused, true as is_taste from x""",
)
def _(t):
    n = F.col("p_partkey")
    parts = [_pick([p[0] for p in pairs], n % len(pairs)) for pairs in (ASK_BODIES, ASK_KINDS, ASK_SWEETS)]
    b, k, s = parts
    q = F.concat(
        F.lit("Find me a "), b, F.lit(" "), k, F.lit(" "), s, F.lit(" crisp for the "), F.split_part("p_name", F.lit(" "), F.lit(2)),
        F.lit(" under $"), F.col("p_size").cast("string"), F.lit(" near Alpha Town"),
    )
    parsed = T.parse_requests(t.table("part").select(q.alias("q")).distinct(), ["Alpha Town"])
    return parsed.select(
        "q", "type", "sweet", "body", "max_price", "area", F.array_join("tags", "|").alias("tags"), F.array_join("unused", "|").alias("unused"), "is_taste"
    )
