"""Benchmark decontamination with an FM-index per shard of the training texts.

A task cuts its documents into shards of about ``SHARD_BYTES`` bytes and indexes the words of
each shard. The alphabet is that of the benchmark: words that occur in no phrase share one
symbol, of which no phrase has any, so runs of them are one place; documents are parted by it
too. Every window of the benchmark is searched backward through the wavelet ranks, its
occurrences are located by sampled suffix positions, and the occurrences are merged into
spans, which the general operator removes. Located words are compared by their 64-bit
hashes, as in the search.

The benchmark's windows go to all tasks; their number is checked against ``MOST_WINDOWS``
first. The documents are not shuffled. Null and empty texts have no words and nothing to
remove; items without words have no windows; repeated items and rows count each by itself;
empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytewords import ALNUM, slices, words
from .fm_index import FMIndex

WINDOW = 10
SHARD_BYTES = 8 << 20
MOST_WINDOWS = 20_000_000
OTHER = 1


@dataclass
class Phrases:
    """Distinct windows as symbols, and the items each stands in."""

    vocabulary: np.ndarray  # sorted hashes; the symbol is the place plus 2
    windows: np.ndarray
    lengths: np.ndarray
    items_first: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases_of(texts: pa.Array, names: list[str], window: int = WINDOW) -> Phrases:
    w = words(texts, ALNUM)
    vocabulary = np.unique(w.hashes)
    symbols = np.searchsorted(vocabulary, w.hashes) + 2
    count = np.diff(w.first)
    number = np.where(count == 0, 0, np.maximum(count - window + 1, 1))
    item = np.repeat(np.arange(len(count)), number)
    start = np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number) + w.first[item]
    length = np.minimum(count[item], window)
    place = np.arange(window)
    padded = np.append(symbols, np.zeros(window, np.int64))
    table = np.where(place < length[:, None], padded[start[:, None] + place], 0)
    distinct, which = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
    pairs = np.unique(np.stack([which.reshape(-1), item], 1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return Phrases(vocabulary, distinct, (distinct > 0).sum(1), first, pairs[:, 1], names)


def benchmark_phrases(benchmark: DataFrame, window: int = WINDOW) -> Phrases:
    """The windows of ``benchmark`` (item_id, text), whose size is checked before they are read."""
    bound = benchmark.agg(F.sum(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    if bound > MOST_WINDOWS:
        raise ValueError(f"{bound} benchmark words; search at most {MOST_WINDOWS} at a time")
    t = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").toArrow()
    return phrases_of(pa.concat_arrays([*t["text"].chunks, pa.array([], t["text"].type)]), t["item_id"].to_pylist(), window)


@dataclass
class Found:
    """Of some documents: numbers of words and hit words, (document, item) pairs, and the
    merged spans as (document, first byte, byte after) within its text."""

    n_words: np.ndarray
    n_hit: np.ndarray
    pairs: np.ndarray
    spans: np.ndarray


def search_shard(texts: pa.Array, p: Phrases) -> Found:
    w = words(texts, ALNUM)
    n = len(w.hashes)
    nothing = np.zeros((0, 2), np.int64)
    if not n or not len(p.windows):
        return Found(np.diff(w.first), np.zeros(len(texts), np.int64), nothing, np.zeros((0, 3), np.int64))
    at = np.minimum(np.searchsorted(p.vocabulary, w.hashes), len(p.vocabulary) - 1)
    symbols = np.where(p.vocabulary[at] == w.hashes, at + 2, OTHER)
    # A parting place before each document but the first, then one place for a run of others.
    edges = np.unique(w.first[1:-1])
    sequence = np.insert(symbols, edges, OTHER)
    word = np.insert(np.arange(n), edges, -1)
    kept = np.append(True, (sequence[1:] != OTHER) | (sequence[:-1] != OTHER))
    sequence, word = sequence[kept], word[kept]
    index = FMIndex(sequence, len(p.vocabulary) + 2)
    lo, hi = index.search(p.windows, p.lengths)
    found = hi - lo
    window = np.repeat(np.arange(len(lo)), found)
    rows = np.arange(len(window)) - np.repeat(np.cumsum(found) - found, found) + lo[window]
    start = word[index.locate(rows)]
    marks = np.bincount(start, minlength=n + 1) - np.bincount(start + p.lengths[window], minlength=n + 1)
    hit = np.cumsum(marks)[:n] > 0
    total = np.append(0, np.cumsum(hit))
    doc = np.searchsorted(w.first, np.arange(n), "right") - 1
    # Items by document: each distinct (document, window) once.
    here = np.unique(np.stack([doc[start], window], 1), axis=0) if len(start) else nothing
    many = np.diff(p.items_first)[here[:, 1]]
    item = p.items[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(p.items_first[here[:, 1]], many)]
    pairs = np.unique(np.stack([np.repeat(here[:, 0], many), item], 1), axis=0)
    # Hit words that follow each other in a document are one span.
    follows = np.append(False, hit[:-1] & (doc[1:] == doc[:-1]))
    begins = np.flatnonzero(hit & ~follows)
    ends = np.flatnonzero(hit & ~np.append(hit[1:] & follows[1:], False))
    spans = np.stack([doc[begins], w.starts[begins] - w.offsets[doc[begins]], w.ends[ends] - w.offsets[doc[begins]]], 1)
    return Found(np.diff(w.first), total[w.first[1:]] - total[w.first[:-1]], pairs, spans)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its words, hits and items."""
    phrases = docs.sparkSession.sparkContext.broadcast(benchmark_phrases(benchmark, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        for batch in batches:
            for a, b in slices(batch.column(1), SHARD_BYTES):
                f = search_shard(batch.column(1).slice(a, b - a), p)
                names: list[list[str]] = [[] for _ in range(b - a)]
                for doc, item in f.pairs.tolist():
                    names[doc].append(p.names[item])
                names = [sorted(set(x)) for x in names]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(f.n_words),
                        pa.array(f.n_hit),
                        pa.array([len(x) for x in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                        pa.array(f.n_hit > 0),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the spans cut out of ``text``; other columns pass as they are. Documents
    that had words and are left with none go."""
    phrases = docs.sparkSession.sparkContext.broadcast(benchmark_phrases(benchmark, window))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        for batch in batches:
            for a, b in slices(batch.column(at), SHARD_BYTES):
                part = batch.slice(a, b - a)
                texts = part.column(at)
                f = search_shard(texts, p)
                cut = texts.to_pylist()
                by_doc: dict[int, list[tuple[int, int]]] = {}
                for doc, first, last in f.spans.tolist():
                    by_doc.setdefault(doc, []).append((first, last))
                for doc, spans in by_doc.items():
                    raw, upto, kept = cut[doc].encode(), 0, []
                    for first, last in spans:
                        kept.append(raw[upto:first])
                        upto = last
                    cut[doc] = b"".join([*kept, raw[upto:]]).decode()
                part = part.set_column(at, part.schema.field(at), pa.array(cut, texts.type))
                yield part.filter(pa.array((f.n_hit == 0) | (f.n_hit < f.n_words)))

    return docs.mapInArrow(run, docs.schema)
