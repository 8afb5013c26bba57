"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is its learned vector (frequent words), the mean of learned vectors of its character trigrams, and how much
more often it, and its character 3- to 5-grams, come in toxic than in other training texts. Windows of WINDOW words that
overlap by half cover the whole text; the forward and backward states of a window are pooled by attention, and a text's
score is that of its most toxic window.

Training takes at most POSITIVE and NEGATIVE labelled texts of at most LONGEST_SAMPLE bytes, chosen by a hash of their ids. Word and n-gram statistics of
one half of them are used as inputs for the other half, so that the network learns how far to trust them. Of each text the
window that scores highest is trained on. Nothing but the text is an input of a score.

Null and empty texts are one window without words and get that window's score. Equal texts get equal scores. An empty
table gives no rows; other columns of the input stay as they are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches
from .textkit import blocks, mix64, powers, release, text_bytes, word_hashes, word_spans

POSITIVE, NEGATIVE, LONGEST_SAMPLE = 1000, 2300, 60_000
WINDOW, STRIDE, HIDDEN = 32, 16, 8
WORDS, WORD_DIMS, TRIGRAMS, TRIGRAM_DIMS = 2048, 4, 4096, 4
INPUT = 4 + WORD_DIMS + TRIGRAM_DIMS
EPOCHS, BATCH, RATE = 12, 128, 0.02
REMEMBERED = 200_000
#: Weight decay of the network and of the learned vectors.
DECAY = 0.01, 1.0
#: A word's or n-gram's toxic share is smoothed with as many texts as the toxic ones over PRIOR_PART, within PRIOR_RANGE.
PRIOR_PART, PRIOR_RANGE = 60, (5, 20)

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_U = np.uint64


@dataclass
class Words:
    """The words of a block of texts: each one's distinct word, where each text's begin, and the distinct ones."""

    which: np.ndarray
    at: np.ndarray
    hashes: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words_of(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    start, end, at = word_spans(data, offsets, _IS_WORD)
    hashes, first, which = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
    return Words(which, at, hashes, data, start[first], end[first])


def gather_words(texts: pa.Array) -> Words:
    """words_of() for more texts than a block: only the bytes of distinct words are kept."""
    sequence, counts, hashes, raw, sizes = [], [], [], [np.zeros(0, dtype=np.uint8)], []
    known = np.zeros(0, dtype=np.uint64)
    for part in blocks(texts):
        w = words_of(part)
        sequence.append(w.hashes[w.which])
        counts.append(np.diff(w.at))
        new = np.flatnonzero(~np.isin(w.hashes, known))
        size = (w.end - w.start)[new]
        raw.append(w.data[np.repeat(w.start[new] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))])
        sizes.append(size)
        hashes.append(w.hashes[new])
        known = np.union1d(known, w.hashes[new])
    size = np.concatenate(sizes)
    end = np.cumsum(size)
    order = np.argsort(np.concatenate(hashes))
    return Words(np.searchsorted(known, np.concatenate(sequence)).astype(np.int32), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), known, np.concatenate(raw), (end - size)[order], end[order])


def gram_parts(w: Words) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """grams_of() all distinct words, some at a time, each with the number of its first word."""
    for a in range(0, w.hashes.size, 1 << 13):
        yield a, grams_of(w, np.arange(a, min(a + (1 << 13), w.hashes.size)))


def grams_of(w: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Character n-grams (3 to 5 bytes, word edges marked) of the distinct words ``rows``: hashes and owners of all, and
    trigram buckets with their owners."""
    size = (w.end - w.start)[rows] + 2
    to = np.cumsum(size)
    place = np.arange(int(to[-1]) if size.size else 0)
    owner = np.repeat(np.arange(rows.size), size)
    inner = place - (to - size)[owner]
    source = np.clip(w.start[rows][owner] + inner - 1, 0, max(0, w.data.size - 1))
    raw = w.data[source].astype(np.uint64) if w.data.size else np.zeros(0, dtype=np.uint64)
    raw = np.where((raw >= 65) & (raw <= 90), raw + _U(32), raw)
    raw[(inner == 0) | (inner == size[owner] - 1)] = 1
    up, down = powers(raw.size)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(raw * up * _U(0xD6E8FEB86659FD93))])
    hashes, owners = [], []
    for n in (3, 4, 5):
        begin = np.flatnonzero(inner + n <= size[owner])
        hashes.append(mix64((sums[begin + n] - sums[begin]) * down[begin] + _U(n)))
        owners.append(owner[begin])
    return np.concatenate(hashes), np.concatenate(owners), (hashes[0] % _U(TRIGRAMS)).astype(np.int64), owners[0]


@dataclass
class Odds:
    """Smoothed log ratios: how much likelier than at random a text with this hash is toxic. Sorted by hash."""

    hashes: np.ndarray
    values: np.ndarray

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.hashes.size:
            return np.zeros(wanted.size, dtype=np.float32), np.zeros(wanted.size, dtype=bool)
        at = np.minimum(np.searchsorted(self.hashes, wanted), self.hashes.size - 1)
        known = self.hashes[at] == wanted
        return np.where(known, self.values[at], 0).astype(np.float32), known


def _odds(hashes: np.ndarray, n: np.ndarray, t: np.ndarray, share: float, least: int, prior: float) -> Odds:
    """Of sorted hashes that n texts have, t of them toxic."""
    value = np.log((t + prior * share) / (n + prior)) - np.log(share)
    keep = (n >= least) & (np.abs(value) > 0.15)
    return Odds(hashes[keep], value[keep].astype(np.float32))


@dataclass
class Model:
    word_odds: Odds
    gram_odds: Odds
    vocabulary: np.ndarray  # sorted hashes of words that have a learned vector
    p: dict[str, np.ndarray]
    memo_hash: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    memo_row: np.ndarray = field(default_factory=lambda: np.zeros((0, INPUT), dtype=np.float32))

    def plain_inputs(self, w: Words, rows: np.ndarray, odds: tuple[Odds, Odds] | None = None) -> tuple:
        """The inputs that aren't learned (4 columns), each word's vocabulary number (0: none) and its trigrams."""
        word_odds, gram_odds = odds or (self.word_odds, self.gram_odds)
        grams, owner, tri, tri_owner = grams_of(w, rows)
        out = np.zeros((rows.size, 4), dtype=np.float32)
        out[:, 0], known = word_odds.of(w.hashes[rows])
        out[:, 1] = known
        value, _ = gram_odds.of(grams)
        np.maximum.at(out[:, 2], owner, value)
        out[:, 3] = np.bincount(owner, weights=value, minlength=rows.size) / np.maximum(1, np.bincount(owner, minlength=rows.size))
        at = np.minimum(np.searchsorted(self.vocabulary, w.hashes[rows]), max(0, self.vocabulary.size - 1))
        number = np.where(self.vocabulary[at] == w.hashes[rows], at + 1, 0) if self.vocabulary.size else np.zeros(rows.size, dtype=np.int64)
        return out, number, tri, tri_owner

    def inputs(self, plain: np.ndarray, number: np.ndarray, tri: np.ndarray, tri_owner: np.ndarray) -> np.ndarray:
        count = np.maximum(1, np.bincount(tri_owner, minlength=len(plain)))
        mean = np.stack([np.bincount(tri_owner, weights=self.p["trigram"][tri, k], minlength=len(plain)) / count for k in range(TRIGRAM_DIMS)], axis=1)
        return np.concatenate([plain, self.p["word"][number], mean.astype(np.float32)], axis=1)

    def remembered_inputs(self, w: Words) -> np.ndarray:
        """Inputs of all distinct words of a block; those of words seen before are kept, up to REMEMBERED."""
        at = np.minimum(np.searchsorted(self.memo_hash, w.hashes), max(0, self.memo_hash.size - 1))
        known = self.memo_hash[at] == w.hashes if self.memo_hash.size else np.zeros(w.hashes.size, dtype=bool)
        out = np.zeros((w.hashes.size, INPUT), dtype=np.float32)
        out[known] = self.memo_row[at[known]]
        new = np.flatnonzero(~known)
        if new.size:
            out[new] = self.inputs(*self.plain_inputs(w, new))
            if self.memo_hash.size < REMEMBERED:
                hashes = np.concatenate([self.memo_hash, w.hashes[new]])
                order = np.argsort(hashes)
                self.memo_hash, self.memo_row = hashes[order], np.concatenate([self.memo_row, out[new]])[order]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The highest window score of each text, as a probability."""
        w = words_of(texts)
        begin, size, owner = windows_of(w.at)
        logits = np.empty(begin.size, dtype=np.float32)
        x = self.remembered_inputs(w)
        for a in range(0, begin.size, 2048):
            b = slice(a, a + 2048)
            logits[b] = forward(self.p, x, window_words(w.which, begin[b], size[b]), size[b])[0]
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logits)
        return 1 / (1 + np.exp(-best))

    def __getstate__(self) -> dict:
        return {"word_odds": self.word_odds, "gram_odds": self.gram_odds, "vocabulary": self.vocabulary, "p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)


def windows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of all windows; a text without words has one empty window."""
    n = np.diff(at)
    count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(n.size), count)
    inner = (np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return at[:-1][owner] + inner, np.minimum(WINDOW, n[owner] - inner), owner


def window_words(which: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(WINDOW x windows): distinct word numbers; -1 beyond a window's end."""
    place = np.arange(WINDOW)[:, None]
    inside = place < size
    if not which.size:
        return np.full(inside.shape, -1)
    return np.where(inside, which[np.minimum(begin + place, which.size - 1)], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, words: np.ndarray, size: np.ndarray, keep: bool = False) -> tuple:
    """Logits of windows; with ``keep``, also what backward() needs."""
    steps, n = words.shape
    states, saved = [], []
    for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        gates = np.concatenate([x @ p[f"{side}_in"] + p[f"{side}_bias"], np.zeros((1, 3 * HIDDEN), dtype=np.float32)])
        h, all_h = np.zeros((n, HIDDEN), dtype=np.float32), np.empty((steps, n, HIDDEN), dtype=np.float32)
        for t in order:
            g, live = gates[words[t]], (words[t] >= 0)[:, None]
            zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ p[f"{side}_zr"])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ p[f"{side}_new"])
            if keep:
                saved.append((side, t, h, z, r, new, live))
            h = np.where(live, new + z * (h - new), h)
            all_h[t] = h
        states.append(all_h)
    both = np.concatenate(states, axis=2)
    hidden = np.tanh(both @ p["att_in"] + p["att_bias"])
    weight = hidden @ p["att_out"]
    weight = np.where(np.arange(steps)[:, None] < np.maximum(1, size), weight, -1e9)
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = (both * weight[:, :, None]).sum(0)
    logits = pooled @ p["out"] + p["out_bias"]
    return (logits, both, hidden, weight, pooled, saved) if keep else (logits,)


def backward(p: dict[str, np.ndarray], x: np.ndarray, words: np.ndarray, kept: tuple, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters and of the inputs x; slope: the loss by each logit."""
    _, both, hidden, weight, pooled, saved = kept
    g = {"out": pooled.T @ slope, "out_bias": slope.sum(keepdims=True)}
    d_pooled = slope[:, None] * p["out"]
    d_weight = (both * d_pooled).sum(2)
    d_both = weight[:, :, None] * d_pooled
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    g["att_out"] = (hidden * d_score[:, :, None]).sum((0, 1))
    d_hidden = d_score[:, :, None] * p["att_out"] * (1 - hidden**2)
    g["att_in"], g["att_bias"] = np.einsum("tni,tnj->ij", both, d_hidden), d_hidden.sum((0, 1))
    d_both = d_both + d_hidden @ p["att_in"].T
    d_x = np.zeros_like(x)
    flows = {"f": 0.0, "b": 0.0}
    for side in "fb":
        g |= {f"{side}_{k}": np.zeros_like(p[f"{side}_{k}"]) for k in ("in", "bias", "zr", "new")}
    for side, t, h, z, r, new, live in reversed(saved):
        d_h = d_both[t][:, :HIDDEN] if side == "f" else d_both[t][:, HIDDEN:]
        d_h = d_h + flows[side]
        d_live = np.where(live, d_h, 0)
        d_new = d_live * (1 - z) * (1 - new**2)
        d_rh = d_new @ p[f"{side}_new"].T
        d_zr = np.concatenate([d_live * (h - new) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
        g[f"{side}_new"] += (r * h).T @ d_new
        g[f"{side}_zr"] += h.T @ d_zr
        d_gate = np.concatenate([d_zr, d_new], axis=1)
        rows = words[t][live[:, 0]]
        d_gate = d_gate[live[:, 0]]
        g[f"{side}_in"] += x[rows].T @ d_gate
        g[f"{side}_bias"] += d_gate.sum(0)
        np.add.at(d_x, rows, d_gate @ p[f"{side}_in"].T)
        flows[side] = np.where(live, d_live * z + d_rh * r + d_zr @ p[f"{side}_zr"].T, d_h)
    return g, d_x


def initial(rng: np.random.Generator, words: int) -> dict[str, np.ndarray]:
    draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    p = {"word": draw(words + 1, WORD_DIMS) * 0.1, "trigram": draw(TRIGRAMS, TRIGRAM_DIMS) * 0.1}
    for side in "fb":
        p |= {f"{side}_in": draw(INPUT, 3 * HIDDEN), f"{side}_bias": np.zeros(3 * HIDDEN, dtype=np.float32), f"{side}_zr": draw(HIDDEN, 2 * HIDDEN), f"{side}_new": draw(HIDDEN, HIDDEN)}
    return p | {"att_in": draw(2 * HIDDEN, HIDDEN), "att_bias": np.zeros(HIDDEN, dtype=np.float32), "att_out": draw(HIDDEN), "out": draw(2 * HIDDEN), "out_bias": np.full(1, -1.0, dtype=np.float32)}


def train(texts: list[str] | pa.Array, toxic: list[int], seed: int = 11) -> Model:
    """Fit on labelled texts; without both labels every score is the share of toxic ones."""
    rng = np.random.default_rng(seed)
    y = np.array(toxic, dtype=np.float32)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if y.size else 1e-3
    none = Odds(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32))
    if not 0 < y.sum() < y.size:
        p = initial(rng, 0)
        p["out"][:], p["out_bias"][:] = 0, np.log(share / (1 - share))
        return Model(none, none, np.zeros(0, dtype=np.uint64), p)
    w = gather_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    del texts
    doc = np.repeat(np.arange(y.size), np.diff(w.at))
    pair = np.unique(doc * w.hashes.size + w.which)  # a text and one of its words
    pair = (pair // w.hashes.size).astype(np.int32), (pair % w.hashes.size).astype(np.int32)
    del doc
    release()
    rows = np.arange(w.hashes.size)
    tri_parts = [(found[2].astype(np.int32), (found[3] + a).astype(np.int32)) for a, found in gram_parts(w)]
    tri, tri_owner = (np.concatenate(x) for x in zip(*tri_parts))
    del tri_parts
    half = rng.permutation(y.size) % 2
    prior = float(np.clip(y.sum() / PRIOR_PART, *PRIOR_RANGE))

    def odds(wanted: list[tuple[np.ndarray, int]]) -> list[tuple[Odds, Odds]]:
        """For each set of texts (and least number of them): odds of words by texts; of n-grams by pairs of a text and a
        word that has them, a range of hashes at a time, so that never all n-grams are held."""
        sums, found = [], []
        for texts_in, least in wanted:
            own = texts_in[pair[0]]
            n = np.bincount(pair[1][own], minlength=rows.size)
            t = np.bincount(pair[1][own], weights=y[pair[0][own]], minlength=rows.size)
            mean = float(np.clip(y[texts_in].mean(), 1e-3, 1 - 1e-3))
            sums.append((n, t, mean, least))
            found.append((_odds(w.hashes, n, t, mean, least, prior), []))
        for k in range(8):
            parts = [(g[0][some], (g[1][some] + a).astype(np.int32)) for a, g in gram_parts(w) for some in [g[0] >> _U(61) == _U(k)]]
            kinds, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            owner = np.concatenate([p[1] for p in parts])
            for (n, t, mean, least), (_, grams) in zip(sums, found):
                of_kind = [np.bincount(which, weights=x[owner], minlength=kinds.size) for x in (n, t)]
                grams.append(_odds(kinds, *of_kind, mean, least, prior))
        return [(words, Odds(np.concatenate([o.hashes for o in grams]), np.concatenate([o.values for o in grams]))) for words, grams in found]

    every_text = np.ones(y.size, dtype=bool)
    of_all, *of_others = odds([(every_text, 3), (half != 0, 2), (half != 1, 2)])
    seen = np.bincount(pair[1], minlength=w.hashes.size)
    vocabulary = np.sort(w.hashes[np.argsort(-seen, kind="stable")[:WORDS]])
    model = Model(*of_all, vocabulary, initial(rng, vocabulary.size))
    halves = []  # inputs of half k come from statistics of the other
    for other in of_others:
        parts = [model.plain_inputs(w, rows[a : a + (1 << 13)], other)[:2] for a in range(0, rows.size, 1 << 13)]
        halves.append([np.concatenate(x) for x in zip(*parts)])
    del of_others
    release()
    begin, size, owner = windows_of(w.at)
    number = np.concatenate([halves[0][1], halves[1][1]])
    plain = np.concatenate([halves[0][0], halves[1][0]])
    shift = half * rows.size  # words of half 1 have rows of their own

    def words_in(some: np.ndarray) -> np.ndarray:
        out = window_words(w.which, begin[some], size[some])
        return np.where(out >= 0, out + shift[owner[some]], -1)

    def best_windows(score: np.ndarray) -> np.ndarray:
        order = np.lexsort((np.arange(owner.size), -score, owner))
        return order[np.searchsorted(owner[order], np.arange(y.size))]

    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    hint = plain[:, 0] + plain[:, 2]
    score = np.concatenate([np.where((v := words_in(np.arange(a, min(a + 65536, owner.size)))) >= 0, hint[v], -9).max(0) for a in range(0, owner.size, 65536)])
    weight = np.where(y > 0, min(2.0, np.sqrt((1 - share) / share)), 1.0).astype(np.float32)
    tri_first = np.searchsorted(tri_owner, np.arange(rows.size + 1))  # owners ascend

    def learned_inputs(words: np.ndarray) -> tuple:
        """Inputs of the words that windows hold, the windows by rows of these, and what the inputs are made of."""
        used, local = np.unique(words, return_inverse=True)
        local = local.reshape(words.shape)
        if used.size and used[0] < 0:
            used, local = used[1:], local - 1
        first = tri_first[used % rows.size]
        n_tri = tri_first[used % rows.size + 1] - first
        own_tri = tri[np.repeat(first - np.cumsum(n_tri) + n_tri, n_tri) + np.arange(int(n_tri.sum()))]
        own_owner = np.repeat(np.arange(used.size), n_tri)
        return model.inputs(plain[used], number[used], own_tri, own_owner), local, used, n_tri, own_tri, own_owner

    def window_scores(a: int) -> np.ndarray:
        some = np.arange(a, min(a + 2048, owner.size))
        x, local, *_ = learned_inputs(words_in(some))
        return forward(model.p, x, local, size[some])[0]

    for epoch in range(EPOCHS):
        if epoch in (2, 3, 5, 7, 9):
            score = np.concatenate([window_scores(a) for a in range(0, owner.size, 2048)])
        chosen = best_windows(score)
        extra = rng.permutation(np.flatnonzero(y[owner] == 0))[: y.size // 2]  # windows of harmless texts
        every, target = np.concatenate([chosen, extra]), np.concatenate([y, np.zeros(extra.size, dtype=np.float32)])
        worth = np.concatenate([weight, weight[owner[extra]]])
        for some in np.array_split(rng.permutation(every.size), max(1, every.size // BATCH)):
            x, local, used, n_tri, own_tri, own_owner = learned_inputs(words_in(every[some]))
            kept = forward(model.p, x, local, size[every[some]], keep=True)
            slope = ((_sigmoid(kept[0]) - target[some]) * worth[some] / some.size).astype(np.float32)
            g, d_x = backward(model.p, x, local, kept, slope)
            g["word"], g["trigram"] = np.zeros_like(model.p["word"]), np.zeros_like(model.p["trigram"])
            np.add.at(g["word"], number[used], d_x[:, 4 : 4 + WORD_DIMS])
            np.add.at(g["trigram"], own_tri, (d_x[:, 4 + WORD_DIMS :] / np.maximum(1, n_tri)[:, None])[own_owner])
            g["word"][0] = 0
            step += 1
            rate = RATE * min(1.0, 2 * (1 - epoch / EPOCHS))
            for k, v in g.items():
                a, b = state[k]
                a += 0.1 * (v - a)
                b += 0.01 * (v * v - b)
                model.p[k] *= 1 - rate * DECAY[k in ("word", "trigram")]
                model.p[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positive: int = POSITIVE, negative: int = NEGATIVE, longest: int = LONGEST_SAMPLE) -> Model:
    """Train on a bounded sample of the labelled rows whose crc32(id as text) mod 5 is not 0: at most ``positive`` and
    ``negative`` texts of at most ``longest`` bytes each, so that one task holds them. Longer texts never train; they are
    scored like all others. Rows of ``labels`` without id or label are left out; an id labelled twice is toxic if any row
    says so; of rows that repeat an id in ``docs`` one trains. Empty tables give a model that scores every text alike."""
    spark = docs.sparkSession
    bound_batches(spark)
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    marked = marked.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    usable = texts.select("id").distinct().join(marked, "id")
    chosen = []
    for label, most in ((1, positive), (0, negative)):
        chosen += [(r["id"], label) for r in usable.where(F.col("toxic") == label).select("id").orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    picked = spark.createDataFrame(chosen, "id long, toxic int")  # at most positive + negative rows
    found = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (some := list(batches)):
            return
        found = pa.Table.from_batches(some).sort_by("id")  # one row an id
        del some
        texts, labels = found["text"].cast(pa.large_string()).combine_chunks(), found["toxic"].to_pylist()
        del found
        release()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        model = train(texts, labels)
        release()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task holds the bounded sample; the driver gets the model alone; without rows there may be no task
    made = found.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else train([], [])


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1. An existing column of that name is replaced."""

    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for column in columns:
            parts = [own.scores(part) for part in blocks(column.fill_null(""))]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        own.memo_hash, own.memo_row = np.zeros(0, dtype=np.uint64), np.zeros((0, INPUT), dtype=np.float32)
        release()

    return docs.withColumn(out_col, run(F.col(text_col)))
