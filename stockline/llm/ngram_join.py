"""Grouped prefix join: documents whose sets of five-word shingles have a Jaccard similarity
of 0.8 or more, and the groups that such links form.

1. Shingles that several documents of a task share are counted over all tasks; the most
   frequent come last in the order of shingles, all others stand by their hash. The list is
   bounded, and any order gives the same links: it only decides how many candidates there are.
2. Documents with equal sets are one class; classes with equal prefix (the first
   ``n - ceil(0.8 n) + 1`` shingles) and size are one group. A group's shingles are dealt out
   once. Two sets that are linked share a shingle within the first ``n - o + 1`` places of
   each, ``o`` being the overlap that their sizes ask for.
3. In each bucket (groups that share a prefix shingle) every member is held against the
   leader; candidates are expanded to classes and their sets are intersected.
4. Members that this did not join to the leader's component are held against all members of
   the bucket in other components. Pairs within a component need no check, so a group of n
   near copies takes about n checks, and no link between components is missed.

Sets hold 62-bit numbers of shingles. A null or empty text has no shingles and is linked with
nothing. Repeated rows and equal sets fall into one class. Memory is bounded by
``SLICE_BYTES`` of text or one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bytewords import BY_SPACE, mix, slices, words
from .common import written
from .components import components

SHINGLE = 5
SLICE_BYTES = 2 << 20
COUNTED = 2_000_000
MOST_FREQUENT = 1 << 20
FREQUENT_FROM = 4
SLOTS = 1 << 23
_TOP = 1 << 62
_U = np.uint64


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: their numbers, and the text of each, sorted by both."""
    w = words(texts, BY_SPACE)
    n, count = len(w.hashes), np.diff(w.first)
    code = w.hashes.copy()
    for j in range(1, SHINGLE):
        code[: n - j] = mix(code[: n - j] * _U(31) + w.hashes[j:]) if n > j else code[: n - j]
    doc = np.repeat(np.arange(len(texts)), count)
    place = np.arange(n) - w.first[doc]
    whole = place <= count[doc] - SHINGLE
    # Fewer words: all of them, folded one after another, are the only shingle.
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    total = count[few].astype(_U)
    for j in range(SHINGLE - 1):
        has = count[few] > j
        total[has] = mix(total[has] * _U(31) + w.hashes[w.first[few[has]] + j])
    code, doc = np.append(code[whole], total) >> _U(2), np.append(doc[whole], few)
    order = np.lexsort((code, doc))
    code, doc = code[order].astype(np.int64), doc[order]
    first = np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])) if len(code) else np.zeros(0, bool)
    return code[first], doc[first]


def _signature(code: np.ndarray, edges: np.ndarray, seed: int) -> np.ndarray:
    """A number of each set: the sum of its mixed members."""
    total = np.append(_U(0), np.cumsum(mix(code.astype(_U) * _U(2) + _U(seed))))
    return mix(total[edges[1:]] - total[edges[:-1]]).astype(np.int64)


def _needed_overlap(size: Column, other: Column) -> Column:
    """Least intersection of linked sets: 100 i >= 80 (x + y - i)."""
    return F.ceil((size + other) * 4 / 9)


def _within(pos: Column, size: Column, other: Column) -> Column:
    return pos <= size - _needed_overlap(size, other) + 1


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The shingles that stand out most, the least frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(code[n > 1]), pa.array(n[n > 1])], names=["code", "n"])

        for batch in batches:
            for a, b in slices(batch.column(0), SLICE_BYTES):
                held.append(_shingles(batch.column(0).slice(a, b - a))[0])
                if sum(map(len, held)) >= COUNTED:
                    yield counted()
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "code").limit(MOST_FREQUENT)
    return top.select("code").toArrow()["code"].to_numpy()[::-1].copy()


def _scan(docs: DataFrame, frequent: np.ndarray, columns: list[str], schema: str, emit: Callable) -> DataFrame:
    """Calls ``emit(batch slice, numbers of shingles in their order, edges)`` for runs of documents."""
    sent = docs.sparkSession.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent) + _TOP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = sent.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b in slices(batch.column(at), SLICE_BYTES):
                code, doc = _shingles(batch.column(at).slice(a, b - a))
                if len(known):
                    where = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    code = np.where(known[where] == code, last[where], code)
                    order = np.lexsort((code, doc))
                    code, doc = code[order], doc[order]
                yield emit(batch.slice(a, b - a), code, np.searchsorted(doc, np.arange(b - a + 1)))

    return docs.select(*columns).mapInArrow(run, schema)


def _profiles(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, text_hash, size n, signatures of set (c1, c2) and prefix (g1, g2), prefix, and a number of the row."""

    def emit(batch: pa.RecordBatch, code: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        n = np.diff(edges)
        keep = np.where(n > 0, n + 4 * n // -5 + 1, 0)  # n - ceil(0.8 n) + 1
        cut = np.append(0, np.cumsum(keep))
        prefix = code[np.arange(cut[-1]) + np.repeat(edges[:-1] - cut[:-1], keep)]
        return pa.record_batch(
            [
                batch.column(0),
                batch.column(1),
                pa.array(n, pa.int32()),
                *[pa.array(_signature(code, edges, s)) for s in (1, 2)],
                *[pa.array(_signature(prefix, cut, s)) for s in (3, 4)],
                pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(prefix)),
            ],
            names=["doc_id", "text_hash", "n", "c1", "c2", "g1", "g2", "prefix"],
        )

    base = docs.select(docs["doc_id"].cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    rows = _scan(base, frequent, ["doc_id", "text_hash", "text"], "doc_id long, text_hash long, n int, c1 long, c2 long, g1 long, g2 long, prefix array<long>", emit)
    return written(rows.withColumn("place", F.monotonically_increasing_id()), "ngram-profiles")


def _sets(docs: DataFrame, frequent: np.ndarray, wanted: DataFrame) -> DataFrame:
    """cls and set of the classes ``wanted`` (cls, c1, c2, n). A bitmap of fixed size keeps most
    other documents' sets from being dealt out; the join is exact."""
    slot = F.pmod(F.col("c1"), F.lit(SLOTS))
    bits = wanted.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(c1, {SLOTS}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(SLOTS // 64, np.int64)
    bitmap[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def emit(batch: pa.RecordBatch, code: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        c1, c2 = (_signature(code, edges, s) for s in (1, 2))
        at = np.mod(c1, SLOTS)
        n = np.diff(edges)
        rows = np.flatnonzero(((sent.value[at >> 6] >> (at & 63)) & 1 == 1) & (n > 0))
        sets = [code[edges[i] : edges[i + 1]].tobytes() for i in rows]
        return pa.record_batch([pa.array(c1[rows]), pa.array(c2[rows]), pa.array(n[rows], pa.int32()), pa.array(sets, pa.binary())], names=["c1", "c2", "n", "set"])

    rows = _scan(docs, frequent, ["text"], "c1 long, c2 long, n int, set binary", emit)
    once = rows.groupBy("c1", "c2", "n").agg(F.first("set").alias("set"))
    return written(once.join(wanted, ["c1", "c2", "n"]).select("cls", "set"), "ngram-sets")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.int64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("cls").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("set").alias("y"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "ngram-links")


def similar_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_hash, place, n_shingles,
    component_id (the smallest doc_id reachable by links), and comp, a number of the group, which
    also tells groups apart that share an id."""
    frequent = frequent_shingles(docs)
    rows = _profiles(docs, frequent)
    full = rows.filter("n > 0")
    classes = full.groupBy("c1", "c2", "n", "g1", "g2").agg(F.min("place").alias("cls"), F.min("doc_id").alias("low"))
    classes = written(classes, "ngram-classes")
    groups = classes.groupBy("g1", "g2", "n").agg(F.min("cls").alias("grp"), F.count("*").alias("m"))
    members = written(classes.join(groups, ["g1", "g2", "n"]).select("cls", "c1", "c2", "n", "grp", "low", "m"), "ngram-members")
    # A group's prefix is that of its first row.
    heads = members.filter("cls = grp").select(F.col("cls").alias("place"), "grp", "m")
    at = (F.col("n").cast("long") * (1 << 32) + F.col("pos") + 1).alias("at")
    entries = rows.select("place", "n", "prefix").join(heads, "place").select("grp", "n", "m", F.posexplode("prefix").alias("pos", "tok")).select("tok", "grp", at, "m")
    leads = entries.groupBy("tok").agg(F.min("grp").alias("l_grp"), F.sum("m").alias("m")).filter("m > 1").drop("m")
    shared = entries.drop("m").join(leads, "tok")
    shared = written(shared.select("tok", "grp", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"), "l_grp"), "ngram-shared")
    leader = shared.filter("grp = l_grp").select("tok", F.col("n").alias("l_n"), F.col("pos").alias("l_pos"))
    buckets = written(shared.join(leader, "tok"), "ngram-buckets")

    def wanted(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        return members.join(ids, "cls", "left_semi").select("cls", "c1", "c2", "n")

    # Each member against the leader; the leader's group stands for its first class.
    n, l_n = F.col("n"), F.col("l_n")
    near = buckets.filter(_within(F.col("pos"), n, l_n) & _within(F.col("l_pos"), l_n, n)).select(F.col("l_grp").alias("a"), "grp").distinct()
    star = near.join(members.select("grp", F.col("cls").alias("b")), "grp").filter("a <> b").select("a", "b")
    star = written(star, "ngram-star")
    links = _linked(star, _sets(docs, frequent, wanted(star)))
    joined = components(links)

    # Members elsewhere against all of their bucket that are in other components.
    labelled = members.join(joined.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "grp", F.coalesce("component", "cls").alias("comp"))
    labelled = written(labelled, "ngram-labels")
    lead = labelled.filter("cls = grp").select(F.col("grp").alias("l_grp"), F.col("comp").alias("l_comp"))
    spread = labelled.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    minor = buckets.join(spread, "grp").join(lead, "l_grp").filter("lo <> l_comp or hi <> l_comp").select("tok", "grp", "n", "pos", "l_comp")
    minor = minor.join(labelled, "grp").filter("comp <> l_comp").select("tok", "cls", "comp", "n", "pos", "l_comp")
    minor = written(minor, "ngram-minor")
    open_ = minor.select("tok").distinct()
    others = buckets.join(open_, "tok", "left_semi").join(labelled, "grp")
    others = others.select("tok", F.col("cls").alias("cls2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    n2 = F.col("n2")
    rest = minor.join(others, "tok").filter(
        (F.col("comp") != F.col("comp2"))
        & ((F.col("comp2") == F.col("l_comp")) | (F.col("cls") < F.col("cls2")))
        & _within(F.col("pos"), n, n2)
        & _within(F.col("pos2"), n2, n)
    )
    rest = rest.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()
    rest = written(rest, "ngram-rest")
    links = links.unionByName(_linked(rest, _sets(docs, frequent, wanted(rest))))

    final = members.join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
    lows = final.groupBy("comp").agg(F.min("low").alias("component_id"))
    found = final.join(lows, "comp").select("c1", "c2", "n", "component_id", "comp")
    return rows.join(found, ["c1", "c2", "n"], "left").select(
        "doc_id",
        "text_hash",
        "place",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "comp",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: its first by doc_id. Documents without words stay."""
    groups = similar_groups(docs)
    first = groups.filter("n_shingles > 0").groupBy("comp").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    kept = groups.join(first.select(F.col("first.place").alias("place")), "place", "left_semi").unionByName(groups.filter("n_shingles = 0"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id")
    kept = kept.groupBy(name, F.col("text_hash").alias("th")).agg(F.count("*").alias("copies"))
    # Of equal rows, as many stay as were chosen.
    d = docs.select(F.struct("*").alias("row"), name, F.xxhash64("text").alias("th"))
    turn = F.row_number().over(Window.partitionBy("id", "th").orderBy("copies"))
    return d.join(kept, ["id", "th"]).withColumn("turn", turn).filter("turn <= copies").select("row.*")
