import numpy as np
import pytest
from pyspark.sql import functions as F

from linescan.llm import voronoi


def brute(vectors, k):
    out = {}
    for q in vectors:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(vectors[q], x)), i) for i, x in vectors.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, x array<long>, score double")
    got = {}
    for r in sorted(voronoi.top_k_join(df, F.col("vec_id") % 50 == 0, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("block", [(512, 4096), (4, 30)])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(voronoi, "BLOCK_QUERIES", block[0])
    monkeypatch.setattr(voronoi, "BLOCK_ROWS", block[1])
    rng = np.random.default_rng(0)
    centers = rng.integers(-300, 300, (8, 12))
    vectors = {i: (centers[i % 8] + rng.integers(-9, 9, 12)).tolist() for i in range(700)}
    for i in range(200, 260):
        vectors[i] = vectors[200]  # ties
    assert run(spark, list(vectors.items()), pivots=16) == brute(vectors, 5)


def test_pruning_sends_less(spark):
    """Clusters in some directions: under a fifth of the pairs of vectors and query cells meet, and none that counts is lost."""
    rng = np.random.default_rng(1)
    vectors = {i: (np.eye(16)[i % 16] * 1000 + rng.integers(-5, 5, 16)).astype(int).tolist() for i in range(1600)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, x array<long>")
    sent = []
    kept = voronoi.keep

    def watched(table, label):
        if label == "sent":
            sent.append(table.agg(F.sum(F.size("groups")), F.max(F.array_max("groups")) + 1).first())
        return kept(table, label)

    voronoi.keep, block = watched, voronoi.BLOCK_QUERIES
    try:
        voronoi.BLOCK_QUERIES = 1
        rows = voronoi.top_k_join(df, F.col("vec_id") % 50 == 0).collect()
    finally:
        voronoi.keep, voronoi.BLOCK_QUERIES = kept, block
    total, groups = sent[0]
    assert groups >= 8 and total < 0.2 * groups * len(vectors)
    want = {(q, v, s) for q, found in brute(vectors, 5).items() for v, s in found}
    assert {(r.query_id, r.vec_id, r.score) for r in rows} == want


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (400, 6)).astype(float)
    pivots = x[:20]
    far = np.sqrt(((x[:, None] - pivots) ** 2).sum(2))
    cell, distance = far.argmin(1), far.min(1)
    nearest = np.full((20, 6), np.inf)
    for c in range(20):
        own = np.sort(distance[cell == c])[:6]
        nearest[c, : len(own)] = own
    low = voronoi.least_scores(x, pivots, nearest, 5)
    dots = x @ x.T
    np.fill_diagonal(dots, -np.inf)
    fifth = np.sort(dots, axis=1)[:, -5]
    assert (low <= fifth).all() and np.isfinite(low).all()
    radius = np.array([distance[cell == c].max() for c in range(20)])
    least = np.array([low[cell == c].min() for c in range(20)])
    meets = voronoi.may_meet(pivots, np.arange(20), radius, least, radius)
    counts = dots >= fifth[:, None]
    for q, d in zip(*np.nonzero(counts)):
        assert meets[cell[d], cell[q]]


def test_edge_rows(spark):
    rows = [(0, [1, 2]), (50, [3]), (1, None), (2, [1, None]), (None, [1, 1]), (3, [5, 5]), (4, [])]
    vectors = {0: [1, 2], 50: [3, 0], 3: [5, 5], 4: [0, 0]}
    assert run(spark, rows) == brute(vectors, 5)
    assert run(spark, []) == {} and run(spark, [(1, [1])]) == {} and run(spark, [(0, [1])]) == {} and run(spark, [(0, []), (1, [])]) == {0: [(1, 0)]}


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1, 2]), (0, [7, 7]), (3, [5, 5]), (3, [5, 5]), (3, [1, 0])]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in voronoi.top_k_join(df, F.col("vec_id") % 50 == 0).collect())
    one = [(0, 1, 0, 21), (0, 2, 3, 15), (0, 3, 3, 15), (0, 4, 3, 1)]
    other = [(0, 1, 3, 70), (0, 2, 3, 70), (0, 3, 0, 21), (0, 4, 3, 7)]
    assert got == sorted(one + other)


def test_large_numbers():
    big = np.array([[2.0**30, 1.0]])
    assert voronoi.scores(big, big)[0, 0] == 2**60 + 1
    wide = np.array([[2**60 + 1, 3], [-(2**62), 1]])
    assert voronoi.scores(wide, np.array([[1, 0], [2**40, 1]])).tolist() == [[2**60 + 1, voronoi.TOP], [-(2**62), -voronoi.TOP]]
    s = np.array([[5, 5, 7, 5], [1, 2, 3, 4]])
    assert voronoi.best(s, 2).tolist() == [[2, 0], [3, 2]] and voronoi.best(s * 2**60 // 8, 2).tolist() == [[2, 0], [3, 2]]


def test_non_finite_vectors_take_no_part(spark, tmp_path):
    df = spark.createDataFrame([(0, [0.5, 0.1]), (1, [float("nan"), 0.1]), (2, [float("inf"), 0.1]), (3, [-0.3, 0.7]), (4, None)], "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = voronoi.op5_voronoi_top_k(spark, str(tmp_path)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 3, 128 * -77 + 25 * 179)]
