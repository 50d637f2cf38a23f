"""Centroid clustering, one-bit codes and the Merkle manifest against plain versions."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from hypothesis import given, settings, strategies as st
from samples import SF

from stockline.llm import bit_codes, centroids, merkle, queries

NAMES = "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
PROVED = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Hot copies, ties, repeated and null ids, and vectors that take no part; clashing names."""
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=64).tolist()) for i in range(-40, 160)]
    hot = [(200 + i, [0.5] * 64) for i in range(90)]
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [math.nan] + [1.0] * 63), (304, [None] + [1.0] * 63), (305, [math.inf] + [0.0] * 63), (320, [0.0] * 64)]
    again = [(20, good[3][1]), (20, good[3][1]), (None, good[5][1]), (None, [-0.25] * 64), (340, [2.0, 1.0]), (360, [1.0, -1.0]), (341, [2.0, 1.0])]
    data = good + hot + odd + again
    frame = spark.createDataFrame([(i, e, *["x"] * 8) for i, e in data], "vec_id long, embedding array<double>, " + ", ".join(f"{c} string" for c in ("x", "e", "d", "n", "place", "code", "cluster", "rank")))
    return frame.repartition(5), data


def test_clusters_are_those_of_plain_sums(spark, odd_vectors):
    frame, data = odd_vectors
    assert sorted(rows(centroids.cluster_digest(frame), *NAMES), key=str) == plain.kmeans(data)
    sf = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert sorted(rows(queries.op11_centroid_clusters(spark, SF), *NAMES), key=str) == plain.kmeans(rows(sf, "vec_id", "embedding"))
    few = frame.filter("vec_id between 3 and 9")
    assert sorted(rows(centroids.cluster_digest(few), *NAMES), key=str) == plain.kmeans([x for x in data if x[0] in range(3, 10)])
    assert centroids.cluster_digest(frame.limit(0)).count() == 0


def test_vectors_too_large_for_exact_distances_are_an_error(spark):
    far = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_digest(far).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 12), st.sampled_from([2, 1000, centroids.LIMIT]))
def test_bounds_are_never_above_the_distance(seed, dims, most):
    rng = np.random.default_rng(seed)
    x, c = (rng.integers(-most, most + 1, (n, dims)) for n in (30, 9))
    b = centroids.Bounds(centroids.farthest_first(c, 5))
    low = b.below(b.to_pivots(x), b.to_pivots(c))
    exact = ((x[:, None] - c) ** 2).sum(axis=2)
    assert (low <= exact).all()
    which, best, checked = centroids.nearest(x, b.to_pivots(x), c, b)
    assert (which == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and checked <= exact.size


def test_bounds_save_distances():
    rng = np.random.default_rng(2)
    centers = rng.integers(-300, 300, (40, 64))
    x = np.repeat(centers, 50, axis=0) + rng.integers(-9, 10, (2000, 64))
    b = centroids.Bounds(centroids.farthest_first(centers, 8))
    assert centroids.nearest(x, b.to_pivots(x), centers, b)[2] < 0.3 * 2000 * 40


def recall(got, want, data):
    hit = sum(len(w) for w in want.values())
    mine = defaultdict(Counter)
    for q, _, v, s in got:
        mine[q][v, s] += 1
    wanted = defaultdict(Counter)
    for p, w in want.items():
        for s, v in w:
            wanted[data[p][0]][v, s] += 1
    return sum((mine[q] & wanted[q]).total() for q in wanted) / hit


def test_nearest_vectors(spark, odd_vectors):
    frame, data = odd_vectors
    want = plain.nearest(data)
    got = rows(bit_codes.nearest_by_ids(frame), "query_id", "rank", "vec_id", "score")
    assert len(got) == sum(map(len, want.values())) and recall(got, want, data) >= 0.98
    per = defaultdict(list)
    for q, rank, v, s in sorted(got, key=lambda r: (r[0], r[1])):
        per[q].append((rank, v, s))
    for q, found in per.items():
        if q != 20:  # three rows have this id
            assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
            assert found == sorted(found, key=lambda x: (-x[2], x[1] is None, x[1] or 0))
    assert [v for _, v, _ in per[360]] == [340, 341] and per[340][0][1] == 341
    assert [v for _, v, _ in per[200]][:5] == [201, 202, 203, 204, 205] or per[200][0][2] > 16
    assert bit_codes.nearest_by_ids(frame.limit(0)).count() == 0


def test_nearest_vectors_of_the_table(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    data = rows(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")
    want = plain.nearest(data)
    assert recall(rows(queries.op12_nearest_vectors(spark, sf)), want, data) >= 0.98
    monkeypatch.setattr(bit_codes, "QUERY_BYTES", 8 * 64 * 7)  # several blocks of queries
    assert recall(rows(queries.op12_nearest_vectors(spark, sf)), want, data) >= 0.98


def test_few_rows_are_measured():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked, center, places = np.arange(0, 8000, 40), x[:1024].mean(axis=0), np.arange(8000)
    block = bit_codes.Block(asked, x[asked], center, 20)
    measured = block.meet(x, *bit_codes.encode(x, center), places, np.zeros(8000, bool), places)
    assert measured < 0.19 * len(x) * len(asked)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = {(i, r) for i, s in enumerate(score) for r in np.argsort(-s)[:20].tolist()}
    got = set(zip(block.found["q"].tolist(), block.found["id"].tolist()))
    assert len(got) == len(want) and len(got & want) >= 0.98 * len(want)


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(4000, 64)) + 0.5, rng.normal(size=(20, 64))
    center = x.mean(axis=0)
    codes, length, product = bit_codes.encode(x, center)
    signs = np.unpackbits(codes, axis=1) * 2.0 - 1
    bits = signs.shape[1]
    turned = q @ bit_codes.rotation(64).T
    estimate = (q @ center)[:, None] + ((signs @ turned.T) * (length / product / np.sqrt(bits))[:, None]).T
    error = np.outer(np.linalg.norm(q, axis=1), length * np.sqrt(1 - product**2) / product / np.sqrt(bits - 1))
    off = (q @ x.T - estimate) / error
    assert abs(off.mean()) < 0.05 and 0.8 < off.std() < 1.2 and (np.abs(off) > bit_codes.SIGMAS).mean() < 0.03


def test_manifest(spark, docs, edges, nothing):
    columns = "doc_id", "source", "lang", "n_chars", "text"
    assert sorted(rows(queries.op13_merkle_manifest(spark, SF), *PROVED), key=str) == plain.merkle(rows(docs, *columns))
    assert sorted(rows(merkle.tamper_check(edges), *PROVED), key=str) == plain.merkle(rows(edges, *columns))
    assert merkle.tamper_check(nothing).count() == 0


def test_a_source_of_many_blocks_and_many_sources(spark):
    data = [(i % 2000 if i % 3 else None, "hot", None, 1, f"a\n{i % 700}") for i in range(2500)]
    data += [(i, None if i % 50 == 0 else f"s{i % 40}é", "en", None, None if i % 7 == 0 else f"t{i}") for i in range(300)]
    data += [(i, f"only{i}", None, None, "x\ny") for i in range(250)]
    frame = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    got = sorted(rows(merkle.tamper_check(frame), *PROVED), key=str)
    want = plain.merkle(data)
    assert got == want and any(r[-1] for r in got) and not all(r[-1] for r in got)
    one = spark.createDataFrame(data[:1], frame.schema)
    assert rows(merkle.tamper_check(one), *PROVED) == plain.merkle(data[:1])


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 900))
def test_positions_are_those_of_a_log_written_in_order(n):
    log, open_ = [], [[] for _ in range(merkle.height(n) + 1)]
    for i in range(n):
        level, j = 0, i
        while True:
            log.append((level, j))
            open_[level].append(j)
            last = j + 1 == merkle.width(n, level)
            if level == merkle.height(n) or not (len(open_[level]) == merkle.FAN or last):
                break
            open_[level].clear()
            level, j = level + 1, j // merkle.FAN
    assert all(merkle.position(n, level, j) == at for at, (level, j) in enumerate(log))
    # Aligned builders, each on its own, fill the same log.
    names, base, filled = {j: f"leaf{j}" for j in range(n)}, 0, {}
    while base == 0 or merkle.FAN**base < n:
        tops = {}
        for first in range(0, len(names), merkle.BLOCK):
            b = merkle.Builder(n, base, first)
            for j in range(first, min(first + merkle.BLOCK, len(names))):
                if base == 0:
                    filled[merkle.position(n, 0, j)] = names[j]
                made = b.add(names[j])
                for up, node in enumerate(made, 1):
                    filled[merkle.position(n, base + up, j // merkle.FAN**up)] = node
            tops[first // merkle.BLOCK] = made[-1] if made else names[j]
        names, base = tops, base + merkle.LEVELS
    assert sorted(filled) == list(range(len(log)))
    nodes = [f"leaf{j}" for j in range(n)]
    for level in itertools.count():
        assert all(filled[merkle.position(n, level, j)] == x for j, x in enumerate(nodes))
        if len(nodes) == 1:
            break
        nodes = [merkle.digest(nodes[i : i + merkle.FAN]) for i in range(0, len(nodes), merkle.FAN)]
