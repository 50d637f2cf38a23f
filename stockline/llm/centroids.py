"""Exact clustering around centroids, with Ptolemaic bounds in place of most distances.

Vectors and centroids are integers and distances are squared Euclidean, so every sum, mean and
tie is exact and no result depends on the number of tasks. In Euclidean space four points obey
Ptolemy's inequality; for a vector x, a centroid c and pivots p and s it says

    d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|

The pivots stay the same in all rounds, so a vector's distances from them are computed once and
written with it, and a round computes those of the centroids only. Each pair of pivots bounds
the distance of every vector from every centroid; the largest bound counts. Bounds are floating
numbers and rounded down by more than their error. A vector meets its centroids in the order of
their bounds, is measured exactly, and stops when the next bound is above the least distance.

A round returns a task's sums by cluster; Spark adds them up and ``k`` centroids come back.

Vectors that are null, have another number of components, or hold nulls or non-finite numbers
take no part. Equal vectors and repeated ids count each time; a null id is a row like any other
and comes last where first centroids are chosen, equal ids by their components. Fewer vectors
than ``k`` give as many centroids, none an empty table. Components beyond ``LIMIT`` would not
leave distances in 64 bits and are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written

LIMIT = 1 << 27
SLACK = 1e-11
ROWS = 4096


@dataclass
class Bounds:
    """Ptolemaic lower bounds over all pairs of ``pivots``."""

    pivots: np.ndarray
    pairs: list[tuple[int, int, float]] = field(init=False)

    def __post_init__(self):
        d = self.to_pivots(self.pivots)
        n = len(self.pivots)
        self.pairs = [(p, s, d[p, s]) for p in range(n) for s in range(p) if d[p, s] > 0]

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances from each pivot."""
        columns = [np.sqrt(np.einsum("ij,ij->i", x - p, x - p).astype(np.float64)) for p in self.pivots]
        return np.stack(columns, axis=1) if columns else np.zeros((len(x), 0))

    def below(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Squared lower bounds between rows whose distances from the pivots are ``x`` and ``c``."""
        best = np.zeros((len(x), len(c)))
        for p, s, apart in self.pairs:
            a, b = np.outer(x[:, p], c[:, s]), np.outer(x[:, s], c[:, p])
            np.maximum(best, (np.abs(a - b) - SLACK * (a + b)) * ((1 - SLACK) / apart), out=best)
        return best * best * (1 - SLACK)


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``x``, each the farthest from those before it."""
    chosen = [0] if len(x) else []
    near = np.full(len(x), np.iinfo(np.int64).max)
    while chosen and len(chosen) < min(n, len(x)):
        d = x - x[chosen[-1]]
        near = np.minimum(near, np.einsum("ij,ij->i", d, d))
        chosen.append(int(near.argmax()))
    return x[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, ties to the smaller number;
    and how many distances were computed."""
    of = bounds.to_pivots(centroids)
    which, best, checked = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max), 0
    for a in range(0, len(x), ROWS):
        b = min(a + ROWS, len(x))
        low = bounds.below(to_pivots[a:b], of)
        order = np.argsort(low, axis=1, kind="stable")
        active = np.arange(b - a)
        for t in range(len(centroids)):
            c = order[active, t]
            stay = low[active, c] <= best[a + active]
            active, c = active[stay], c[stay]
            if not len(active):
                break
            d = x[a + active] - centroids[c]
            d = np.einsum("ij,ij->i", d, d)
            checked += len(d)
            now, had = best[a + active], which[a + active]
            better = (d < now) | ((d == now) & (c < had))
            at = a + active[better]
            best[at], which[at] = d[better], c[better]
    return which, best, checked


def whole(vectors: DataFrame, column: str, size: int, scale: int) -> DataFrame:
    """vec_id and x: the components as integers, floor of ``scale`` times each."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    e = F.col(column).cast("array<double>")
    kept = vectors.select(vectors["vec_id"].cast("long"), e.alias("e")).filter((F.size("e") == size) & F.forall("e", fine))
    scaled = F.transform("e", lambda v: F.floor(v * scale))
    too_far = F.exists("x", lambda v: F.abs(v) > LIMIT)
    x = F.when(too_far, F.raise_error(F.lit(f"a component is beyond {LIMIT}"))).otherwise(F.transform("x", lambda v: v.cast("int")))
    return kept.select("vec_id", scaled.alias("x")).select("vec_id", x.alias("x"))


def first_centroids(x: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors whose ids have the smallest digests."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = x.select(h.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v, kind) for v in column.to_pylist()])


@dataclass
class Clusters:
    """rows: vec_id, cluster, distance; centroids: the last ones."""

    rows: DataFrame
    centroids: np.ndarray


def cluster(x: DataFrame, k: int, rounds: int, seed: str, pivots: int = 8) -> Clusters:
    """``x`` (vec_id, x) around ``k`` centroids after ``rounds`` of moving them."""
    x = written(x, "vectors")
    centroids = first_centroids(x, k, seed)
    bounds = Bounds(farthest_first(centroids, pivots))

    def cached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.array(b.column(1).flatten()).reshape(b.num_rows, -1)
                d = bounds.to_pivots(v.astype(np.int64))
                columns = [b.column(0), pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in d], pa.binary())]
                yield pa.record_batch(columns, names=["vec_id", "x", "d"])

    table = written(x.mapInArrow(cached, "vec_id long, x binary, d binary"), "vectors-pivots")

    def assigned(batches: Iterator[pa.RecordBatch], now: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1), "<i4").astype(np.int64)
                yield b.column(0), v, *nearest(v, _matrix(b.column(2), np.float64), now, bounds)[:2]

    for _ in range(rounds if len(centroids) else 0):

        def summed(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
            for _, v, which, _ in assigned(batches, now):
                order = np.argsort(which, kind="stable")
                there, first = np.unique(which[order], return_index=True)
                total[there] += np.add.reduceat(v[order], first, axis=0)
                n += np.bincount(which, minlength=len(now))
            c, at = np.nonzero(np.repeat(n[:, None] > 0, now.shape[1], axis=1))
            yield pa.record_batch([pa.array(a) for a in (c, at, n[c], total[c, at])], names=["cluster", "at", "n", "s"])

        sums = table.mapInArrow(summed, "cluster long, at long, n long, s long").groupBy("cluster", "at")
        centroids = centroids.copy()
        for r in sums.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k rows a component
            centroids[r["cluster"], r["at"]] = int(r["s"]) // r["n"]

    def last(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for ids, _, which, d in assigned(batches, now):
            yield pa.record_batch([ids, pa.array(which.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    rows = written(table.mapInArrow(last, "vec_id long, cluster int, distance long"), "vectors-clusters")
    return Clusters(rows, centroids)


def cluster_digest(embeddings: DataFrame, size: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, the inertia of the cluster and of all, the centroid's digest."""
    found = cluster(whole(embeddings, "embedding", size, scale), k, rounds, seed)
    per = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia"))
    named = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(found.centroids)]
    spark = embeddings.sparkSession
    names = spark.createDataFrame(named, "cluster int, centroid_sha256 string")  # k rows
    per = per.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(per.agg(F.sum("cluster_inertia").alias("inertia"))))  # one row
    return found.rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    d = "cast(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) as bigint)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select rid, min({{'d': {d}, 'c': c.c}}) as m from v cross join c{r} c group by rid)")
        if r < rounds:
            # The remainder is taken off first, so that division rounds down below zero too.
            mean = f"(select c, list((s - ((s % n) + n) % n) // n order by i) as x from (select m.c as c, i, sum(x[i]) as s, count(*) as n from a{r} join v using (rid), range(1, 65) t(i) group by all) group by c)"
            steps.append(f"c{r + 1} as materialized (select o.c, coalesce(m.x, o.x) as x from c{r} o left join {mean} m on m.c = o.c)")
    return f"""
with v as materialized (
  select row_number() over () as rid, vec_id, [cast(floor(256 * cast(e as double)) as bigint) for e in embedding] as x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id) nulls last, x) - 1 as c, x from v qualify c < {k}
), {", ".join(steps)}
select vec_id, cast(m.c as integer) as cluster, m.d as distance, cast(sum(m.d) over (partition by m.c) as bigint) as cluster_inertia,
  cast(sum(m.d) over () as bigint) as inertia, sha256(list_aggregate(c.x, 'string_agg', ',')) as centroid_sha256
from a{rounds} join v using (rid) join c{rounds} c on c.c = m.c"""


ORACLE = _sql()
