"""Line-first quality rules, in DataFrame functions only.

Each line is held against three rules; lines that fail go. A document is rejected if it
breaks a base rule (too few words, too much repetition) or loses too much of its text.

* ``navigation``: separators between short items (``Home | About | Help``);
* ``boilerplate``: a short line with a stock phrase (rights, licences, cookies);
* ``punctuation``: a line of fewer than ``min_open_words`` words that ends without
  punctuation, or a line that shouts (a ``!!`` for each third word).

Null and empty texts have no words and are rejected. Lines without words are kept as they
are. Repeated rows are judged one by one. Other columns pass through, whatever their names:
the working columns live in a struct of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, WORD, keep_where

# Separators of menus, stock phrases, and ends of sentences.
SEPARATORS = "|<>»•·"
STOCK = (
    "all rights reserved|licensed under|general public license|creative commons|terms of (use|service)|privacy policy"
    "|cookie|javascript|subscribe|sign (in|up)|log ?in|click here|copyright|©"
)
LINE_END = "[.!?…:;,\"'”’»)\\]][ \\t\\x0b\\x0c\\r]*$"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_percent: int = 50
    stock_words: int = 20
    min_open_words: int = 4


def _count(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def _words_in(line: Column) -> Column:
    """Number of words: each begins after white space or at the start."""
    return F.regexp_count(line, F.lit(WORD))


def line_passes(line: Column, rules: Rules = Rules()) -> Column:
    """Whether a line stays."""
    words = _words_in(line)
    separators = _count(line, SEPARATORS)
    shouts = F.regexp_count(line, F.lit("!!"))
    fails = (
        ((separators >= 2) & (separators * 4 >= words))
        | (F.lower(line).rlike(STOCK) & (words <= rules.stock_words))
        | ((shouts >= 2) & (shouts * 3 >= words))
        | (~line.rlike(LINE_END) & (words < rules.min_open_words))
    )
    return (words == 0) | ~fails


def judged(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """A struct ``row`` with the columns of ``docs``, and a struct ``rules_``: the contract's counts,
    ``clean`` (the text of the lines kept), ``lines_removed``, ``base_failed`` and ``kept``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.struct("*").alias("row"), raw.alias("t"))
    base = base.select(
        "row",
        "t",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("ws"),
        F.split("t", "\n", -1).alias("all_lines"),
    )
    base = base.select(
        "row",
        "t",
        "ws",
        "all_lines",
        F.size("ws").alias("n"),
        F.filter("all_lines", lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("full"),
        F.filter("all_lines", lambda x: line_passes(x, rules)).alias("stay"),
    )
    # A window of three words is its hash; the next column has each window's first place.
    base = base.withColumn(
        "windows",
        F.transform(F.slice("ws", F.lit(1), F.greatest(F.col("n") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("ws", i + 1), F.get("ws", i + 2))),
    ).drop("ws")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    base = base.withColumn("placed", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    again = F.transform(
        "placed",
        lambda e, j: F.when((F.get("placed", j - 1)["h"] == e["h"]) | (F.get("placed", j + 1)["h"] == e["h"]), e["i"]),
    )
    base = base.withColumn("at", F.sort_array(F.array_compact(again))).drop("placed")
    covered = F.aggregate(
        F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    clean = F.array_join("stay", "\n")
    measured = base.select(
        "row",
        "n",
        F.length(F.translate("t", SPACES, "")).cast("long").alias("chars"),
        _count(F.col("t"), SYMBOLS).cast("long").alias("symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("dups"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("rep"),
        clean.alias("clean"),
        (F.size("all_lines") - F.size("stay")).cast("long").alias("gone"),
    )
    failed = (F.col("n") < rules.min_words) | (F.col("rep") * 100 > F.col("n") * rules.max_repeat_percent)
    lost = F.col("chars") - F.length(F.translate("clean", SPACES, ""))
    return measured.select(
        "row",
        F.struct(
            F.col("n").cast("long").alias("n_words"),
            F.col("chars").alias("word_chars"),
            F.col("symbols").alias("n_symbols"),
            F.col("dups").alias("n_dup_lines"),
            F.col("rep").alias("n_repeat_words"),
            F.col("clean"),
            F.col("gone").alias("lines_removed"),
            failed.alias("base_failed"),
            (~failed & (lost * 100 <= F.col("chars") * rules.max_lost_percent)).alias("kept"),
        ).alias("rules_"),
    )


def quality_digest(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document with its counts and verdict."""
    r = judged(docs.select("doc_id", "text"), rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed"]
    return r.select("row.doc_id", *[F.col(f"rules_.{x}").alias(x) for x in names])


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, their failing lines removed."""
    r = keep_where(judged(docs, rules), F.col("rules_.kept"))
    new = {"text": F.col("rules_.clean"), "n_chars": F.length("rules_.clean").cast("long")}
    return r.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def oracle_ctes() -> str:
    """DuckDB: table ``judged`` with the counts, the cleaned text and the verdict."""
    ws = "[^\\x20\\x09-\\x0D]+"
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    stock, end = STOCK.replace("'", "''"), LINE_END.replace("'", "''")
    return f"""
    src as (select row_number() over () as rid, * from documents),
    txt as (select rid, coalesce(text, '') as t from src),
    parts as (
        select rid, t, regexp_extract_all(t, '{ws}') as ws, string_split(t, chr(10)) as ls from txt),
    lined as (
        select rid, unnest(ls) as l, generate_subscripts(ls, 1) as k from parts),
    facts as (
        select rid, l, k, len(regexp_extract_all(l, '{ws}')) as words,
               length(l) - length(translate(l, '{SEPARATORS}', '')) as seps,
               len(regexp_extract_all(l, '!!')) as shouts
        from lined),
    marked as (
        select *, words = 0 or not (
                   (seps >= 2 and seps * 4 >= words)
                or (regexp_matches(lower(l), '{stock}') and words <= 20)
                or (shouts >= 2 and shouts * 3 >= words)
                or (not regexp_matches(l, '{end}') and words < 4)) as stay
        from facts),
    cleaned as (
        select rid, coalesce(string_agg(l, chr(10) order by k) filter (where stay), '') as clean,
               count(*) filter (where not stay) as lines_removed,
               count(*) filter (where words > 0) - count(distinct l) filter (where words > 0) as n_dup_lines
        from marked group by rid),
    w as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as p from parts),
    tri as (
        select rid, p, w, lead(w) over s as w2, lead(w, 2) over s as w3
        from w window s as (partition by rid order by p)),
    dup as (
        select rid, p from (
            select rid, p, count(*) over (partition by rid, w, w2, w3) as c from tri where w3 is not null)
        where c > 1),
    rep as (
        select rid, count(distinct q) as n from (
            select rid, unnest([p, p + 1, p + 2]) as q from dup) group by rid),
    counted as (
        select p.rid, len(ws)::bigint as n_words, length(translate(t, {blank}, ''))::bigint as word_chars,
               (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols,
               n_dup_lines::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
               lines_removed::bigint as lines_removed, clean
        from parts p join cleaned using (rid) left join rep using (rid)),
    judged as (
        select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
               and (word_chars - length(translate(clean, {blank}, ''))) * 100 <= word_chars * 50 as kept
        from counted)"""


ORACLE = f"""with {oracle_ctes()}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines_removed
from judged join src using (rid)"""
