"""The gated recurrent network's scores against loops over windows, words and units."""

import math

import numpy as np
import pyarrow as pa

from fernglas.llm import toxicity as tox
from fernglas.llm.textkit import mix64


def sigmoid(v):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))


def dot(a, b):
    return sum(float(x) * float(y) for x, y in zip(a, b))


def states(p, side, rows):
    """A hidden state for each row, in the order that they are read."""
    n, out = tox.HIDDEN, []
    h = [0.0] * n
    for row in rows:
        gate = [dot(row, p[f"{side}_in"][:, j]) + float(p[f"{side}_bias"][j]) for j in range(3 * n)]
        z = [sigmoid(gate[j] + dot(h, p[f"{side}_zr"][:, j])) for j in range(n)]
        r = [sigmoid(gate[n + j] + dot(h, p[f"{side}_zr"][:, n + j])) for j in range(n)]
        reset = [a * b for a, b in zip(r, h)]
        new = [math.tanh(gate[2 * n + j] + dot(reset, p[f"{side}_new"][:, j])) for j in range(n)]
        h = [c + a * (b - c) for a, b, c in zip(z, h, new)]
        out.append(h)
    return out


def window_logit(p, rows):
    if not len(rows):  # no word: states stay zero
        both = [[0.0] * (2 * tox.HIDDEN)]
    else:
        both = [f + b for f, b in zip(states(p, "f", rows), states(p, "b", rows[::-1])[::-1])]
    hidden = [[math.tanh(dot(s, p["att_in"][:, j]) + float(p["att_bias"][j])) for j in range(tox.HIDDEN)] for s in both]
    weight = [dot(h, p["att_out"]) for h in hidden]
    weight = [math.exp(v - max(weight)) for v in weight]
    pooled = [sum(w * s[j] for w, s in zip(weight, both)) / sum(weight) for j in range(2 * tox.HIDDEN)]
    return dot(pooled, p["out"]) + float(p["out_bias"][0])


def plain_score(model, text):
    """The highest of all overlapping windows."""
    words = tox.words_of(pa.array([text], pa.large_string()))
    rows = model.inputs(*model.plain_inputs(words, np.arange(words.hashes.size)))
    own = [rows[k] for k in words.which.tolist()]
    starts, at = [0], 0
    while at + tox.WINDOW < len(own):
        at += tox.STRIDE
        starts.append(at)
    return 1 / (1 + math.exp(-max(window_logit(model.p, own[a : a + tox.WINDOW]) for a in starts)))


def test_scores_equal_loops():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)]
    lengths = [0, 1, 2, 15, 16, 17, 31, 32, 33, 47, 48, 49, 64, 65, 130]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in lengths] + ["Aé, ß! 日本 x", "  ", "same " * 100]
    known = tox.words_of(pa.array([" ".join(vocabulary[:40])], pa.large_string())).hashes
    odds = tox.Odds(np.sort(known[:20]), rng.normal(size=20).astype(np.float32))
    p = tox.initial(rng, known.size)
    p = {k: (v + 0.2 * rng.normal(size=v.shape)).astype(np.float32) for k, v in p.items()}
    model = tox.Model(odds, tox.Odds(np.sort(mix64(np.arange(5, dtype=np.uint64))), np.ones(5, dtype=np.float32)), np.sort(known), p)
    got = model.scores(pa.array(texts, pa.large_string()))
    want = [plain_score(model, t) for t in texts]
    assert np.allclose(got, want, rtol=0, atol=2e-5)
    assert len({round(x, 4) for x in want}) > 10


def test_scores_of_a_trained_model():
    rng = np.random.default_rng(5)
    words, bad = [f"plain{k}" for k in range(80)], ["vile", "scum", "filth"]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    texts = [t if k % 2 else t + " " + " ".join(rng.choice(bad, 4)) for k, t in enumerate(texts)]
    model = tox.train(texts, [1 - k % 2 for k in range(60)])
    got = model.scores(pa.array(texts[:8], pa.large_string()))
    assert np.allclose(got, [plain_score(model, t) for t in texts[:8]], rtol=0, atol=2e-5)
    assert got[0::2].min() > got[1::2].max()
