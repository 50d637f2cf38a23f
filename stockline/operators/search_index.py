"""A written inverted index over names and categories, and matching by it.

The index holds each distinct text once: ``texts`` (tid, in_category, text), ``postings``
(gram, in_category, tid) of all three-character grams, the last ones padded, ``counts`` of texts
per gram, and ``members`` (key, in_category, tid). A category that a third of all items share is
one text with one set of postings. A refresh adds postings for texts it has not seen and rewrites
members only; texts nobody refers to any more match nothing.

Matching is by distinct term, not by query: a term takes the rarest of its grams, reads that
gram's postings, and is looked for in the texts they name. A query then starts from the items of
its rarest token and asks each whether it holds the other tokens' terms; items carry the terms
they hold, so a query's other postings are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import textkeys as k
from ..session import checkpointed, shared_folder

GRAM = 3
PAD = "\x00"


def tokens_of(queries: DataFrame, q: str = "q") -> DataFrame:
    """One row per query token: (q, tok, n_tokens, phrase, raw, alts)."""
    # In steps, so that each is an expression of a column and not a copy of the whole before it.
    t = queries.select(q, k.query_words(k.search_key(q)).alias("words"), k.possessive_stems(q).alias("stems"))
    t = t.select(q, k.tokens_from(F.col("words"), F.col("stems")).alias("tokens"))
    phrase = F.array_join(F.transform("tokens", lambda x: F.element_at(x["alts"], -1)), " ")
    return t.select(q, F.size("tokens").alias("n_tokens"), phrase.alias("phrase"), F.posexplode("tokens").alias("tok", "t")).select(
        q, "tok", "n_tokens", "phrase", F.col("t.raw").alias("raw"), F.col("t.alts").alias("alts")
    )


def _grams(text: Column) -> Column:
    """The distinct grams that start at each character of a text."""
    padded = F.concat(text, F.lit(PAD * (GRAM - 1)))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(padded, i, F.lit(GRAM))))


def _fields(items: DataFrame, key: str) -> DataFrame:
    """key, in_category, text, tid; the search key and the category of each item."""
    both = F.array(
        F.struct(F.lit(False).alias("in_category"), F.col("search_key").alias("text")),
        F.struct(F.lit(True).alias("in_category"), F.lower(F.coalesce("category", F.lit(""))).alias("text")),
    )
    named = items.select(F.col(key).alias("key"), F.explode(both).alias("f")).select("key", "f.in_category", "f.text")
    return named.where("text <> ''").withColumn("tid", F.unhex(F.md5(F.concat(F.col("in_category").cast("string"), F.lit(":"), F.col("text")).cast("binary"))))


@dataclass
class SearchIndex:
    spark: SparkSession
    folder: str
    #: Folders with the texts and postings of each refresh, and the members of the last.
    parts: list[str] = field(default_factory=list)
    members_at: str | None = None

    @classmethod
    def build(cls, items: DataFrame, key: str = "csc", folder: str | None = None) -> SearchIndex:
        spark = items.sparkSession
        return cls(spark, folder or f"{shared_folder(spark)}/search-{uuid.uuid4().hex}").refresh(items, key)

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{p}/{what}" for p in self.parts])

    @property
    def texts(self) -> DataFrame:
        return self._read("texts")

    @property
    def postings(self) -> DataFrame:
        return self._read("postings")

    @property
    def counts(self) -> DataFrame:
        return self._read("counts").groupBy("in_category", "gram").agg(F.sum("n").alias("n"))

    @property
    def members(self) -> DataFrame:
        return self.spark.read.parquet(self.members_at)

    def refresh(self, items: DataFrame, key: str = "csc") -> SearchIndex:
        """The index of ``items`` as they are now. Only new texts get postings."""
        part = f"{self.folder}/{uuid.uuid4().hex}"
        _fields(items, key).write.parquet(f"{part}/members")
        texts = self.spark.read.parquet(f"{part}/members").groupBy("tid").agg(F.first("in_category").alias("in_category"), F.first("text").alias("text"))
        if self.parts:
            texts = texts.join(self.texts.select("tid"), "tid", "left_anti")
        texts.write.parquet(f"{part}/texts")
        new = self.spark.read.parquet(f"{part}/texts")
        # Sorted by gram, so that a reader of a few grams skips most row groups.
        grams = new.select("in_category", "tid", F.explode(_grams(F.col("text"))).alias("gram"))
        grams.repartitionByRange("in_category", "gram", "tid").sortWithinPartitions("in_category", "gram").write.parquet(f"{part}/postings")
        self.spark.read.parquet(f"{part}/postings").groupBy("in_category", "gram").agg(F.count("*").alias("n")).write.parquet(f"{part}/counts")
        return SearchIndex(self.spark, self.folder, [*self.parts, part], f"{part}/members")

    def held(self, terms: DataFrame) -> DataFrame:
        """(key, held) for ``terms`` (id, in_category, alt): the terms that an item's texts hold,
        id -> level; 0 as a whole word, 1 at a word's start, 2 within a word. A key that several
        items share has one row, with the best level of each term."""
        counts = self.counts
        # A long term takes the rarest of its grams; one shorter than a gram all grams it starts.
        inner = F.transform(F.sequence(F.lit(1), F.length("alt") - GRAM + 1), lambda i: F.substr("alt", i, F.lit(GRAM)))
        long = terms.where(F.length("alt") >= GRAM).select("id", "in_category", F.explode(F.array_distinct(inner)).alias("gram"))
        best = long.join(counts, ["in_category", "gram"]).groupBy("id").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
        short = terms.where((F.length("alt") < GRAM) & (F.length("alt") > 0)).select("id", "in_category", "alt", F.length("alt").alias("len"))
        heads = counts.select("in_category", "gram", F.explode(F.array(*map(F.lit, range(1, GRAM)))).alias("len"))
        heads = heads.withColumn("alt", F.substr("gram", F.lit(1), F.col("len")))
        asked = best.unionByName(short.join(heads, ["in_category", "alt", "len"]).select("id", "gram"))
        asked = asked.join(terms, "id").select("id", "in_category", "alt", "gram")
        near = asked.join(self.postings, ["in_category", "gram"]).select("id", "alt", "tid").distinct()
        found = near.join(self.texts.select("tid", "text"), "tid").where(F.contains("text", F.col("alt")))
        word = F.concat(F.lit(r"\b"), F.regexp_replace("alt", r"\.", r"\\."))
        level = F.when(F.regexp_like("text", F.concat(word, F.lit(r"\b"))), 0).when(F.regexp_like("text", word), 1).otherwise(2)
        # Few texts may stand for all items: their terms come to the members, which are many.
        of_text = found.groupBy("tid").agg(F.collect_list(F.struct("id", level.alias("level"))).alias("terms"))
        met = self.members.select("key", "tid").repartition("key", "tid").join(of_text, "tid").select("key", F.explode("terms").alias("t"))
        best = met.groupBy("key", "t.id").agg(F.min("t.level").alias("level"))
        return best.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("id", "level"))).alias("held"))


def _term_id() -> Column:
    """A term's name: where it is looked for, and what."""
    return F.concat(F.when(F.col("a.in_category"), "c").otherwise("n"), F.col("a.alt")).alias("id")


def match(index: SearchIndex, queries: DataFrame, key: str = "csc", q: str = "q") -> DataFrame:
    """(q, key, tier, phrase): the items that hold every token of a query. A token is held by
    the name through any of its alternatives, or by the category as typed. The tier is the worst
    level of a token, a token's level the best of its terms."""
    tokens = tokens_of(queries, q)
    alts = F.concat(
        F.transform("alts", lambda a: F.struct(F.lit(False).alias("in_category"), a.alias("alt"))),
        F.array(F.struct(F.lit(True).alias("in_category"), F.col("raw").alias("alt"))),
    )
    asked = tokens.select(F.col(q).alias("q"), "tok", "n_tokens", "phrase", F.explode(alts).alias("a")).select("q", "tok", "n_tokens", "phrase", "a.*", _term_id())
    terms = asked.select("id", "in_category", "alt").distinct()
    held = checkpointed(index.held(terms))
    each = held.select("key", "held", F.explode(F.map_keys("held")).alias("id"))
    sizes = each.groupBy("id").agg(F.count("*").alias("n"))

    by_token = asked.join(sizes, "id").groupBy("q", "tok").agg(
        F.max("n_tokens").alias("n_tokens"), F.max("phrase").alias("phrase"), F.sum("n").alias("n"), F.sort_array(F.collect_set("id")).alias("ids")
    )
    # Tokens from the rarest on; a query with a token that nothing holds has fewer rows and goes.
    need = by_token.groupBy("q").agg(
        F.max("n_tokens").alias("n_tokens"), F.max("phrase").alias("phrase"), F.sort_array(F.collect_list(F.struct("n", "tok", "ids"))).alias("need")
    )
    need = need.where(F.size("need") == F.col("n_tokens")).select("q", "phrase", F.transform("need", lambda t: t["ids"]).alias("need"))
    leads = need.select("*", F.explode(F.col("need")[0]).alias("id"))

    # The first of the rarest token's terms that an item holds brings it to the query, once.
    second = F.get("need", F.lit(1))
    has = lambda i: F.map_contains_key("held", i)
    quick = F.coalesce((F.size(second) > 1) | has(F.get(second, F.lit(0))), F.lit(True))
    both = each.join(leads, "id").where(quick)
    both = both.where(F.forall("need", lambda ids: F.exists(ids, has)))
    both = both.where(F.get(F.filter(F.col("need")[0], has), F.lit(0)) == F.col("id"))
    levels = F.transform("need", lambda ids: F.array_min(F.transform(ids, lambda i: F.try_element_at("held", i))))
    return both.select(F.col("q").alias(q), F.col("key").alias(key), F.array_max(levels).alias("tier"), "phrase")
