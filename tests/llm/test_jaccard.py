import random
from collections import Counter, defaultdict

import pytest

from linescan.llm import jaccard
from linescan.llm.components import components


def shingles(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows):
    """{doc_id: (class_id, n_links)} for distinct doc_ids."""
    sets = {i: shingles(t) for i, t in rows}
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def corpus(seed, groups=12, size=6, words=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(3000)]
    shared = [rng.choice(vocabulary) for _ in range(30)]  # a passage in many documents
    rows, i = [], 0
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words + g)]
        if g % 2:
            base[10:40] = shared
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((i, " ".join(own)))
            i += 1
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cid string")
    return jaccard.jaccard_join(df, **kw).collect()


@pytest.mark.parametrize("block", [1024, 5])
def test_groups(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    rows = corpus(1) + [(1000, "Same words"), (1001, "same  WORDS"), (1002, "same words here"), (1003, "lonely"), (1004, "x " * 3000)]
    rows += corpus(2, groups=1, size=60)[0:0] + [(2000 + i, t) for i, t in corpus(3, groups=1, size=60)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in run(spark, rows)}
    assert got == brute(rows)


def test_shuffled_candidates(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = corpus(4, groups=4)
    assert {r.doc_id: (r.class_id, r.n_links) for r in run(spark, rows)} == brute(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (6, "other text of seven words and more"), (6, "a b c d e f")]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in run(spark, rows))
    assert got == Counter({(1, 1, 0): 1, (2, 2, 0): 1, (3, 3, 0): 1, (4, 4, 3): 1, (5, 4, 3): 1, (None, 4, 3): 1, (6, 6, 0): 1, (6, 4, 3): 1})
    assert run(spark, []) == []


def test_prefix_length():
    assert jaccard.prefix_length(0.8, 16, 8, 0.9995) == 4
    assert jaccard.prefix_length(0.9, 16, 8, 0.9995) == 8
    with pytest.raises(ValueError):
        jaccard.prefix_length(0.5, 2, 4, 0.999)


def test_paths_are_shortened_no_more_than_recall_asks():
    import math

    def miss(depths):
        return math.prod(1 - 0.8**d for d in depths)

    alone = jaccard.chosen_depths([], 16, 4, 8, 0.8, 0.9995)
    assert alone == [4] * 16
    # One crowded tree, in which longer prefixes leave few: it stays long, for the others pay nothing.
    crowded = [(3, d, n) for d, n in zip(range(4, 9), (9000, 500, 40, 5, 2))]
    depths = jaccard.chosen_depths(crowded, 16, 4, 8, 0.8, 0.9995)
    assert depths[3] > 4 and set(depths[:3] + depths[4:]) == {4} and miss(depths) <= 0.0005
    rng = random.Random(1)
    for _ in range(50):
        sizes = []
        for t in range(16):
            n = 4000
            for d in range(4, 9):
                sizes.append((t, d, n))
                n = rng.randint(1, n)
        depths = jaccard.chosen_depths(sizes, 16, 4, 8, 0.8, 0.9995)
        assert miss(depths) <= 0.0005 and set(depths) - {4}
    assert jaccard.chosen_depths([(t, d, 10) for t in range(16) for d in range(4, 9)], 16, 4, 8, 0.8, 1 - 1e-9) == [4] * 16


@pytest.mark.parametrize("longest", [4, 8])
def test_longest_prefix(spark, longest):
    rows = corpus(7, groups=6, size=8, words=60)
    assert {r.doc_id: (r.class_id, r.n_links) for r in run(spark, rows, longest=longest)} == brute(rows)


def test_crowded_nodes(spark):
    """Many texts about as alike as the threshold, among them pairs that stop at unlike depths."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.choice([3, 8, 12, 25])):
            own[rng.randrange(400)] = f"c{rng.randrange(5000)}"
        rows.append((i, " ".join(own)))
    got, want = {r.doc_id: (r.class_id, r.n_links) for r in run(spark, rows)}, brute(rows)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(n for _, n in got.values()) >= 0.9985 * sum(n for _, n in want.values())


def test_a_hub_is_dealt_out(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(30)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {i: 0 for i in range(3000)} | {5000 + i: 5000 for i in range(31)}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(7, 7)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen = {}
    for start in sorted(near):
        stack = [start] if start not in seen else []
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = start
                stack += near[x]
    alone = {x for x in near if near[x] == {x}}
    assert got == {k: v for k, v in seen.items() if k not in alone}
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0
