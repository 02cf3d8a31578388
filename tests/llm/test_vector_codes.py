import hashlib
import itertools
import math

import numpy as np
import pytest

from linescan.llm import vector_codes

FIELDS = "vec_id long, embedding array<double>, label int, code string, error string"


def brute(rows):
    """The contract with Python's integers; rows are (vec_id, embedding, label)."""
    whole = [r for r in rows if r[1] and not any(v is None or not math.isfinite(v) for v in r[1])]
    if not whole:
        return []
    ys = [[math.floor(1024 * v) for v in r[1]] for r in whole]
    own = len(ys[0]) // 4
    order = sorted(range(len(whole)), key=lambda i: (whole[i][0] is None, whole[i][0] or 0, i))[:256]
    codes, errors, books = [[] for _ in whole], [0] * len(whole), []
    for p in range(4):
        parts = [y[p * own : (p + 1) * own] for y in ys]
        book = [list(parts[i]) for i in order]

        def nearest(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

        for _ in range(4):
            at = [nearest(x)[1] for x in parts]
            for k in set(at):
                mine = [x for x, a in zip(parts, at) if a == k]
                book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        for i, x in enumerate(parts):
            d, k = nearest(x)
            codes[i].append(f"{k:02x}")
            errors[i] += d
        books.append(book)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    by_label = {}
    for r, e in zip(whole, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(((r[0], "".join(c), min(e, 2**63 - 1), min(by_label[r[2]], 2**63 - 1), digest) for r, c, e in zip(whole, codes, errors)), key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], FIELDS)
    return sorted((tuple(r) for r in vector_codes.vector_codes(frame).collect()), key=str)


def test_hilbert_curve():
    """All cells of a grid: each has its own place, and neighbours on the curve are neighbours in the grid."""
    for width, bits in ((2, 3), (3, 2), (1, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=width)))
        keys = [bytes(k) for k in vector_codes.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlists_lose_no_entry():
    rng = np.random.default_rng(0)
    short = 0
    for _ in range(200):
        points = rng.integers(-50, 50, 4) + rng.integers(-9, 10, (20, 4)).astype(float)
        entries = rng.integers(-60, 60, (30, 4)).astype(float)
        near = vector_codes.shortlist(points.min(0), points.max(0), entries)
        at, error = vector_codes.kernel(points, entries[near])
        d = ((points[:, None] - entries) ** 2).sum(2)
        assert (near[at] == d.argmin(1)).all() and (error == d.min(1)).all()
        short += len(near) < 15
    assert short > 100


def test_kernel_is_exact_beyond_doubles():
    points = np.array([[2.0**60, 0.0], [2.0**60, 3.0]])
    at, error = vector_codes.kernel(points, np.array([[2.0**60, 2.0], [2.0**60, 1.0], [0.0, 0.0]]))
    assert at.tolist() == [1, 0] and list(error) == [1, 1]
    assert vector_codes.kernel(points, np.array([[0.0, 0.0]]))[1].tolist() == [2**120, 2**120 + 9]


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e13])
def test_against_brute_force(spark, scale):
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 1, (9, 8))
    rows = [(int(i) * 3 % 901, (scale * (centers[i % 9] + rng.normal(0, 0.05, 8))).tolist(), [1, 2, None][i % 3]) for i in range(500)]
    rows += [(901 + i, rows[0][1], 1) for i in range(150)]  # a common vector
    rows += [(2000, None, 1), (2001, [1.0, None] * 4, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, None), (2004, [], 1), (None, rows[7][1], 2), rows[9], rows[9]]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    rows = [(5, [0.1, 0.2, 0.3, -0.4], None), (4, [0.1, 0.2, 0.3, 0.4], None), (3, [-0.001, 0.2, 0.3, 0.4], 7)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []
    with pytest.raises(ValueError, match="another length"):
        run(spark, [*rows, (6, [1.0] * 8, 1)])
