"""Nearest neighbours by inner product over randomly rotated one-bit codes.

* Index. A vector less the center has a length and a direction. The direction is turned by a
  random rotation into ``EXPAND`` times as many dimensions, and only the signs are kept, packed
  into bits, with two correction scalars: the length, and the inner product of the direction
  with its code. The center is the mean of a bounded sample (``SAMPLE`` rows); the rotation
  depends on a fixed seed and the number of dimensions alone. Every row is coded.
* Estimate. The inner product with a query is that with the center plus the length times that
  with the direction, which the code's product with the turned query divided by the second
  scalar estimates without bias. Its error has a known scale, so ``SIGMAS`` of it above and
  below bound the product.
* Rerank. A row whose upper bound reaches the k-th best so far is measured on its vector, which
  lies beside its code, so no vector travels. Until k are known, the rows with the highest
  estimates are measured for a first k-th best, which is far above the k-th largest lower bound.

Queries go in blocks of bounded size to all tasks; a task passes over its rows once a block,
keeps k rows a query, and Spark ranks those of all tasks. Every query meets every row's code in a
matrix product, which is queries times rows; the measured pairs, which cost most, grow less, since
the k-th best rises with the rows. The shuffle is queries times tasks.

Rows with null, zero or empty vectors, or with null or non-finite components, take no part. A
row meets queries with as many components as it has. A row is left out of its own query only;
others of the same id take part. Equal scores go by id, null ids last. Of equal vectors in a
batch only the k + 1 with the smallest ids can be among the k nearest, so no more are measured.
A null id asks no query. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh_folder, numbered, written

EXPAND = 2
SIGMAS = 2.5
SAMPLE = 1024
LIKELY = 8
QUERY_BYTES = 1 << 24
# So few pairs that their vectors stay in a core's cache.
ROWS, QUERIES, PAIRS = 4096, 512, 1 << 10


def width(dims: int) -> int:
    """Bits of a code, whole bytes."""
    return -(-max(EXPAND * dims, 8) // 8) * 8


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """Orthonormal columns, one a dimension: a random turn into ``width(dims)`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((width(dims), dims)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths, and products of direction and code of the rows of ``x``."""
    apart = x - center
    length = np.sqrt((apart * apart).sum(axis=1))
    turned = apart @ rotation(x.shape[1]).T
    turned /= np.where(length > 0, length, 1)[:, None]
    product = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, product, 1)


class Block:
    """Queries of one number of dimensions, and the k best rows of each so far."""

    def __init__(self, places: np.ndarray, x: np.ndarray, center: np.ndarray, k: int):
        self.places, self.x, self.k = places, x, k
        self.norm = np.sqrt((x * x).sum(axis=1))
        # One product gives upper bounds: code, error and center side by side.
        self.right = np.concatenate([x @ rotation(x.shape[1]).T, self.norm[:, None], (x @ center)[:, None]], axis=1).astype(np.float32).T.copy()
        n = len(x)
        self.floor = np.full(n, -np.inf, np.float32)
        self.found = {"q": np.zeros(0, np.int64), "score": np.zeros(0), "none": np.zeros(0, bool), "id": np.zeros(0, np.int64), "place": np.zeros(0, np.int64)}

    def _measured(self, x: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Inner products, added up from the first component on, so that equal vectors get equal scores."""
        out = np.zeros(len(q))
        for a in range(0, len(q), PAIRS):
            left, right = self.x[q[a : a + PAIRS]], x[r[a : a + PAIRS]]
            for i in range(x.shape[1]):
                out[a : a + PAIRS] += left[:, i] * right[:, i]
        return out

    def _keep(self, new: dict[str, np.ndarray]) -> None:
        both = {c: np.concatenate([self.found[c], new[c]]) for c in self.found}
        order = np.lexsort((both["place"], both["id"], both["none"], -both["score"], both["q"]))
        q = both["q"][order]
        first = np.searchsorted(q, q)
        kept = order[np.arange(len(q)) - first < self.k]
        self.found = {c: v[kept] for c, v in both.items()}
        q = self.found["q"]
        full = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1)
        self._raise(q[full], self.found["score"][full])

    def _raise(self, q: np.ndarray, score: np.ndarray) -> None:
        """Rows below a k-th best ``score`` are of no more use to the queries ``q``."""
        # A little below the k-th score: bounds have single precision.
        self.floor[q] = np.maximum(self.floor[q], score - 1e-5 * (np.abs(score) + self.norm[q]))

    def _first_floor(self, x: np.ndarray, guess: np.ndarray, a: int, b: int, places: np.ndarray) -> int:
        """Floors from the rows with the highest estimates: ``guess``, queries from b on by rows from a on.
        Returns how many pairs were measured."""
        # Estimates have errors, so the k-th best of just k of them would be low.
        most = min(LIKELY * self.k + 1, guess.shape[1])
        r = np.argpartition(guess, -most, axis=1)[:, -most:].ravel() + a
        q = np.repeat(np.arange(b, b + len(guess)), most)
        score = np.where(places[r] == self.places[q], -np.inf, self._measured(x, q, r)).reshape(len(guess), most)
        self._raise(np.arange(b, b + len(guess)), np.partition(score, -self.k, axis=1)[:, -self.k])
        return len(q)

    def meet(self, x: np.ndarray, codes: np.ndarray, length: np.ndarray, product: np.ndarray, ids: np.ndarray, none: np.ndarray, places: np.ndarray) -> int:
        """Takes rows in; returns how many pairs were measured."""
        measured = 0
        bits = width(x.shape[1])
        scale = length / (product * np.sqrt(bits))
        error = length * np.sqrt(np.maximum(0, 1 - product**2)) / product * (SIGMAS / np.sqrt(bits - 1))
        for a in range(0, len(x), ROWS):
            rows = slice(a, a + ROWS)
            signs = np.unpackbits(codes[rows], axis=1).astype(np.float32) * 2 - 1
            left = np.concatenate([signs * scale[rows, None], error[rows, None], np.ones((len(signs), 1))], axis=1).astype(np.float32)
            for b in range(0, len(self.x), QUERIES):
                asked = slice(b, b + QUERIES)
                upper = left @ self.right[:, asked]
                if len(upper) > self.k and np.isinf(self.floor[asked]).any():
                    guess = upper.T - np.outer(self.norm[asked], error[rows]).astype(np.float32)
                    measured += self._first_floor(x, guess, a, b, places)
                r, q = np.nonzero(~(upper < self.floor[asked]))
                r, q = r + a, q + b
                other = places[r] != self.places[q]
                r, q = r[other], q[other]
                measured += len(q)
                score = self._measured(x, q, r)
                high = score >= self.floor[q]
                r, q = r[high], q[high]
                self._keep({"q": q, "score": score[high], "none": none[r], "id": ids[r], "place": places[r]})
        return measured


def _first_of_equals(x: np.ndarray, ids: np.ndarray, none: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Rows but those with ``most`` equal rows of smaller ids."""
    _, same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_inverse=True)
    order = np.lexsort((places, ids, none, same))
    first = np.searchsorted(same[order], same[order])
    return np.sort(order[np.arange(len(order)) - first < most])


def _by_size(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each number of components."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, np.array(lists.take(pa.array(at)).flatten(), np.float64).reshape(len(at), int(d))


def build_index(vectors: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``vectors`` (vec_id, embedding) coded and written: vec_id, place (a row's own number),
    embedding, code, length, product. And the center for each number of components sampled."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    e = F.col("embedding").cast("array<double>")
    base = vectors.select(vectors["vec_id"].cast("long"), F.monotonically_increasing_id().alias("place"), e.alias("embedding"))
    base = written(base.filter((F.size("embedding") > 0) & F.forall("embedding", fine) & F.exists("embedding", lambda v: v != 0)), "bit-vectors")
    centers: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("place")).limit(SAMPLE).select("embedding").collect():
        centers.setdefault(len(r[0]), []).append(r[0])
    middle = {d: np.mean(np.array(v), axis=0) for d, v in centers.items()}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_size(b.column(2)):
                codes, length, product = encode(x, middle.get(x.shape[1], np.zeros(x.shape[1])))
                rows = b.take(pa.array(at))
                columns = [*rows.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(product)]
                yield pa.record_batch(columns, names=["vec_id", "place", "embedding", "code", "length", "product"])

    schema = "vec_id long, place long, embedding array<double>, code binary, length double, product double"
    return written(base.mapInArrow(coded, schema), "bit-index"), middle


def search(index: DataFrame, centers: dict[int, np.ndarray], queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows of ``index`` for each row of ``queries`` (rows of the index):
    query_id, rank, vec_id, score."""
    spark = index.sparkSession
    asked = written(numbered(queries.select("vec_id", "place", "embedding"), [], [], "bit-queries"), "bit-queries")
    n, dims = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    most = max(1, QUERY_BYTES // (8 * dims))
    folder = fresh_folder(spark, "bit-nearest")
    out = "place long, vec_id long, other long, score double"
    for block in range(max(1, -(-n // most))):
        held = asked.filter(F.floor(F.col("idx") / most) == block).select("vec_id", "place", "embedding")
        lists = held.toArrow().combine_chunks()  # at most QUERY_BYTES of vectors
        at, vectors = np.array(lists["place"]), lists["embedding"].combine_chunks()
        sent = spark.sparkContext.broadcast([(at[i], x) for i, x in _by_size(vectors)] if len(at) else [])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = {x.shape[1]: Block(p, x, centers.get(x.shape[1], np.zeros(x.shape[1])), k) for p, x in sent.value}
            for b in batches:
                for rows, x in _by_size(b.column(2)):
                    if x.shape[1] not in blocks:
                        continue
                    b_ = b.take(pa.array(rows))
                    none = np.array(b_.column(0).is_null())
                    ids, places = np.array(b_.column(0).fill_null(0)), np.array(b_.column(1))
                    stay = _first_of_equals(x, ids, none, places, k + 1)
                    codes = np.frombuffer(b"".join(b_.column(3).to_pylist()), np.uint8).reshape(len(x), -1)
                    blocks[x.shape[1]].meet(x[stay], codes[stay], np.array(b_.column(4))[stay], np.array(b_.column(5))[stay], ids[stay], none[stay], places[stay])
            for q in blocks.values():
                f = q.found
                yield pa.record_batch(
                    [pa.array(q.places[f["q"]]), pa.array(f["id"], mask=f["none"]), pa.array(f["place"]), pa.array(f["score"])],
                    names=["place", "vec_id", "other", "score"],
                )

        near = index.mapInArrow(scan, out)
        by = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
        best = near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        named = held.select(F.col("vec_id").alias("query_id"), "place")
        best.join(named, "place").select("query_id", "rank", "vec_id", "score").write.parquet(f"{folder}/block={block}")
        sent.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score double").parquet(*[f"{folder}/block={b}" for b in range(max(1, -(-n // most)))])


def nearest_by_ids(embeddings: DataFrame, step: int = 20, k: int = 20) -> DataFrame:
    """For each row whose vec_id is divisible by ``step``: its ``k`` nearest rows by inner product."""
    index, centers = build_index(embeddings)
    return search(index, centers, index.filter(F.col("vec_id") % step == 0), k)
