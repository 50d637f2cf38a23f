"""Quality classifier: random-indexing word vectors and a small calibrated network.

Terms: each word stands as its lower-cased self and as its shape (runs of letters, capitals,
digits and each other character), and once more marked when it repeats the word before it.
Terms fall into ``BUCKETS`` hash buckets. A bucket has a sparse ternary index vector; its
context vector is the sum of its neighbours' index vectors over the labelled sample. A word
vector is the index vector and the scaled context vector; a document is the mean over its
words, with its length. A network of two layers, in numpy, is fitted to the sample; a
temperature found on a fifth of the sample held back from fitting calibrates its scores.

The sample is bounded by ``SAMPLE`` documents, taken in the order of a hash of the id among the
labelled ones whose crc32(doc_id) mod 4 is not 2. Only vectors, never texts, reach the driver.
Labels, language, source and id are no inputs. Null and empty texts have the score of a
document without words. A document with several labels counts as 1 if most are 1; null labels
do not count. Without both labels in the sample, every score is the share of ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bytewords import BY_SPACE, mix, slices, words
from .common import written

SAMPLE = 20_000
BUCKETS = 1 << 14
DIMENSIONS = 32
SLICE_BYTES = 1 << 20
THRESHOLD = 0.7
_U = np.uint64

# Classes of bytes in shapes: a letter (also of other scripts), a capital, a digit, or itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def _index_vectors() -> np.ndarray:
    """Sparse ternary vectors of all buckets, from hashes."""
    v = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    bucket = np.arange(BUCKETS)
    for k in range(4):
        h = mix(bucket.astype(_U) * _U(4) + _U(k))
        v[bucket, (h % _U(DIMENSIONS)).astype(int)] += np.where(h >> _U(63) == 1, 1, -1)
    return v


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and of its shape, and the number of each text's first word."""
    w = words(texts, BY_SPACE)
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.first
    shape = _SHAPE[w.data]
    new = np.append(True, shape[1:] != shape[:-1])
    new[w.starts] = True
    # A sum over the first byte of each run, weighted by the run's number in the word.
    runs = np.cumsum(new)
    span = np.diff(np.append(w.starts, len(w.data)))
    runs[w.starts[0] :] -= np.repeat(runs[w.starts], span)
    runs = np.minimum(runs, 15)
    weight = mix(shape.astype(_U) * _U(16) + runs.astype(_U)) * new
    total = np.append(_U(0), np.cumsum(weight))
    shapes = mix(total[w.ends] - total[w.starts])
    again = np.append(False, w.hashes[1:] == w.hashes[:-1])
    again[w.first[:-1][w.first[:-1] < n]] = False
    half = _U(BUCKETS // 2)
    shapes = mix(shapes + again.astype(_U)) % half + half
    return (w.hashes % half).astype(np.int64), shapes.astype(np.int64), w.first


def _context(texts: pa.Array, index: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors by bucket."""
    out = np.zeros_like(index)
    word, shape, first = _terms(texts)
    inner = np.ones(max(len(word) - 1, 0), bool)
    edge = first[1:-1]
    inner[edge[(edge > 0) & (edge < len(word))] - 1] = False
    at = np.flatnonzero(inner)
    for a in (word, shape):
        for b in (word, shape):
            for x, y in ((a[at], b[at + 1]), (b[at + 1], a[at])):
                pairs, n = np.unique(x * BUCKETS + y, return_counts=True)
                np.add.at(out, pairs // BUCKETS, index[pairs % BUCKETS] * n[:, None].astype(np.float32))
    return out


def _pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row per text: the mean vectors of its words and shapes, and its length."""
    word, shape, first = _terms(texts)
    n = np.diff(first)
    out = np.zeros((len(n), 2 * vectors.shape[1] + 1), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        d = vectors.shape[1]
        for k, codes in enumerate((word, shape)):
            for a in range(0, len(full), 64):
                rows = full[a : a + 64]
                lo, hi = first[rows[0]], first[rows[-1] + 1]
                for c in range(lo, hi, 1 << 18):  # long texts in parts
                    part = vectors[codes[c : min(c + (1 << 18), hi)]]
                    inside = rows[(first[rows] < c + len(part)) & (first[rows + 1] > c)]
                    out[inside, k * d : (k + 1) * d] += np.add.reduceat(part, np.maximum(first[inside] - c, 0), axis=0)
        out[full, : 2 * d] /= n[full, None]
    out[:, -1] = np.log1p(n)
    return out


class Network:
    """Standardised inputs, one hidden layer, one logit, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, seed: int = 7):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        x, y = x[order].astype(np.float64), y[order].astype(np.float64)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.fitted = len(np.unique(y)) == 2 and len(y) >= 20
        if not self.fitted:
            return
        held = max(4, len(x) // 5)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        fx, fy = x[held:], y[held:]
        d = x.shape[1]
        self.p = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(rounds):
            turn = rng.permutation(len(fx))
            for a in range(0, len(turn), 256):
                bx, by = fx[turn[a : a + 256]], fy[turn[a : a + 256]]
                h = np.maximum(bx @ self.p[0] + self.p[1], 0)
                err = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - by) / len(by)
                back = np.outer(err, self.p[2]) * (h > 0)
                grads = [bx.T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ err + 1e-4 * self.p[2], np.array([err.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        logit, hy = self._logit(x[:held]), y[:held]
        warm = np.geomspace(0.25, 8, 120)
        loss = [np.mean(np.logaddexp(0, np.where(hy > 0.5, -1, 1) * logit / w)) for w in warm]
        self.temperature = float(warm[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors and network from at most ``most`` labelled documents."""
    sc = docs.sparkSession.sparkContext
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(target) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select(docs["doc_id"].cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("text", "y")
    sample = written(sample.repartition(8), "quality-sample")  # bounded by ``most`` documents
    index = _index_vectors()
    sent = sc.broadcast(index)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIMENSIONS), np.float32)
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE_BYTES):
                total += _context(batch.column(0).slice(a, b - a), sent.value)
        yield pa.record_batch([pa.array([total.tobytes()])], names=["total"])

    parts = sample.select("text").mapInArrow(contexts, "total binary").toArrow()["total"]
    context = np.sum([np.zeros((BUCKETS, DIMENSIONS)), *[np.frombuffer(x.as_py(), np.float32).reshape(BUCKETS, DIMENSIONS) for x in parts]], 0)
    context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-9
    vectors = np.hstack([index / 2, context]).astype(np.float32)
    known_vectors = sc.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE_BYTES):
                x = _pooled(batch.column(0).slice(a, b - a), known_vectors.value)
                yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(a, b - a)], names=["x", "y"])

    got = sample.mapInArrow(pooled, "x binary, y int").orderBy("x", "y").toArrow()  # vectors of the bounded sample
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, 4 * DIMENSIONS + 1)
    return vectors, Network(x, got["y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): held_out, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = sent.value
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                s = network.score(_pooled(batch.column(1).slice(a, b - a), vectors))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(s)], names=["doc_id", "score"])

    scored = docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
