import numpy as np

from linescan.llm import gru
from linescan.llm import toxicity as T
from tests.conftest import DATA


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.new_parameters(6).items()}
    chars, offsets = gru.char_ngrams(["abc", "loser", "x", "hello", "worlds", "moron"])
    windows = np.array([[0, 1, 2, 3], [4, 5, -1, -1], [2, 1, 0, -1]])
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    inputs = gru.word_inputs(p, np.array([1, 2, 0, 3, 4, 5]), chars, offsets)
    g, d_inputs, _ = gru.gradients(p, inputs, windows, y, w)

    def loss():
        logits = gru.forward(p, inputs, windows)
        return ((np.logaddexp(0, logits) - y * logits) * w).sum() / w.sum()

    for values, slopes in [(p[k], g[k]) for k in g] + [(inputs, d_inputs)]:
        for _ in range(3):
            i = np.unravel_index(rng.integers(values.size), values.shape)
            kept, e = values[i], 1e-3
            values[i] = kept + e
            up = loss()
            values[i] = kept - e
            slope = (up - loss()) / (2 * e)
            values[i] = kept
            assert abs(slope - slopes[i]) < 1e-5 + 1e-3 * abs(slope)


def test_ngrams_and_sums():
    flat, offsets = gru.char_ngrams(["ab", "", "abcd"])
    # ^ab$: two of 3, one of 4; ^$: none; ^abcd$: four of 3, three of 4, two of 5
    assert gru.CHAR_ORDERS == (3, 4, 5) and np.diff(offsets).tolist() == [3, 0, 9]
    assert (gru.segment_means(np.arange(12.0)[:, None], offsets)[:, 0] == [1, 0, 7]).all()
    assert gru.summed_at(np.array([2, 0, 2]), np.array([[1.0], [2], [3]]), 4)[:, 0].tolist() == [2, 0, 4, 0]


def test_windows_cover_everything():
    for n in (1, 5, 16, 31, 32, 33, 48, 49, 100, 1000):
        windows = T.windows_over(np.arange(n))
        assert set(windows[windows >= 0].tolist()) == set(range(n))
        pairs = {(a, b) for w in windows for a, b in zip(w, w[1:]) if b >= 0}
        assert pairs == {(i, i + 1) for i in range(n - 1)}


def sample():
    rng = np.random.default_rng(0)
    clean = [f"{a}{b}" for a in "ka ti no ro lu me".split() for b in "ra sol min ten".split()]
    rows = []
    for i in range(300):
        words = rng.choice(clean, rng.integers(5, 150)).tolist()
        if i % 3 == 0:
            for _ in range(3):
                words[rng.integers(len(words))] = "vequ" + rng.choice(clean)
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def test_learns_stems_and_handles_edges(spark):
    model = T.fit(sample(), 1 / 3)
    long_clean = "kara tisol " * 40_000
    rows = [(1, "kara vequxyz, tisol nomin!", 0.0), (2, "kara tisol nomin", 0.0), (3, None, 0.0), (4, "", 0.0), (5, " !? ", 0.0), (6, long_clean, 0.0), (7, long_clean + "vequnew", 0.0), (7, long_clean + "vequnew", 0.0), (None, "tisol", 0.0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, score double")
    got = {r.doc_id: r.score for r in T.with_toxicity(df, model, ["doc_id", "score"]).collect()}
    assert got[1] > 0.7 and got[7] > 0.7 and max(got[2], got[6], got[None]) < 0.5
    assert got[3] == got[4] == got[5] < 0.01
    assert T.with_toxicity(df, model, ["doc_id"]).count() == 9 and T.with_toxicity(df.where("false"), model, ["doc_id"]).count() == 0


def test_one_class_and_none():
    assert T.fit([], 0.0).scores(["x", None]).tolist() == T.fit([("a", 0)], 0.0).scores(["x", None]).tolist()
    assert T.fit([("a", 0)], 0.0).scores(["x"])[0] < 0.01 < 0.99 < T.fit([("a", 1)], 1.0).scores(["x"])[0]


def test_held_out_ranking(spark):
    data = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = T.op8_toxicity(spark, data).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    toxic, clean = ([r.score for r in held if r.toxic == k] for k in (1, 0))
    assert np.mean([t > c for t in toxic for c in clean]) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def slow_logit(p, words, x):
    """The network of one window in scalars: gates one unit at a time, from either end, then attention."""
    from math import exp, tanh

    h = gru.HIDDEN
    sig = lambda v: 1 / (1 + exp(-v))
    sides = []
    for s in "fb":
        W, U, b = p[f"W{s}"], p[f"U{s}"], p[f"b{s}"]
        state, states = [0.0] * h, {}
        for t in range(words) if s == "f" else range(words - 1, -1, -1):
            own = [sum(x[t][i] * W[i][j] for i in range(len(x[t]))) + b[j] for j in range(3 * h)]
            inner = [sum(state[i] * U[i][j] for i in range(h)) for j in range(3 * h)]
            z = [sig(own[j] + inner[j]) for j in range(h)]
            r = [sig(own[h + j] + inner[h + j]) for j in range(h)]
            new = [tanh(own[2 * h + j] + r[j] * inner[2 * h + j]) for j in range(h)]
            state = [z[j] * state[j] + (1 - z[j]) * new[j] for j in range(h)]
            states[t] = state
        sides.append(states)
    both = [sides[0][t] + sides[1][t] for t in range(words)]
    energy = [sum(tanh(sum(v[i] * p["A"][i][j] for i in range(2 * h))) * p["a"][j] for j in range(h)) for v in both]
    weight = [exp(e - max(energy)) for e in energy]
    pooled = [sum(w * v[i] for w, v in zip(weight, both)) / sum(weight) for i in range(2 * h)]
    return sum(a * b for a, b in zip(pooled, p["o"])) + p["c"][0]


def test_scores_against_a_scalar_network():
    """Whole texts scored window by window and unit by unit."""
    rng = np.random.default_rng(4)
    vocabulary = {w: i + 1 for i, w in enumerate(["kara", "tisol", "nomin"])}
    p = {k: v + rng.normal(size=v.shape).astype(np.float32) * 0.3 for k, v in gru.new_parameters(4, 3).items()}
    model = T.ToxicityModel(p, vocabulary, 1.3, -0.2)
    texts = ["kara tisol", "x", " ".join(rng.choice(["kara", "tisol", "luné", "nomin,"], 70)), ""]
    got = model.scores(texts)
    for text, score in zip(texts, got):
        words = T.words_of(text)
        x = []
        for w in words:
            raw = b"^" + w.encode() + b"$"
            grams, offsets = gru.char_ngrams([w])
            assert len(grams) == offsets[-1] == sum(max(0, len(raw) - n + 1) for n in gru.CHAR_ORDERS)
            char = [sum(float(p["char"][g][d]) for g in grams) / max(1, len(grams)) for d in range(gru.CHAR_DIM)]
            x.append([float(v) for v in p["word"][vocabulary.get(w, 0)]] + char)
        starts = range(0, max(len(words) - T.WINDOW + T.STRIDE, 1), T.STRIDE)
        logits = [slow_logit(p, len(x[a : a + T.WINDOW]), x[a : a + T.WINDOW]) for a in starts] if words else [(-8 - model.shift) / model.slope]
        assert abs(score - 1 / (1 + np.exp(-(model.slope * max(logits) + model.shift)))) < 1e-4, text


def test_ties_in_the_sample(spark):
    """Of a doc_id with several texts the least one is sampled, whatever the order of the rows."""
    rows = [(1, "b"), (1, "a"), (1, "c"), (2, "z"), (2, "z")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
        assert sorted(T.sample_texts(docs, labels, (5, 5))[0]) == [("a", 1), ("z", 0)]
