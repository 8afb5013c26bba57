"""The k best rows of a task for a block of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Products that are held at once (rows of a step times queries), rows of a batch of hits, and pairs whose vectors are held at once.
STEP, HITS_BATCH, PAIRS = 1 << 20, 1 << 16, 1 << 15


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of paired rows, summed from the first component to the last, so that a score is the same on every machine."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[:, d]
    return out


def _parts(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of components of each vector (-1: null) and all components; a vector is a list, or binary of 16 bits each."""
    if pa.types.is_binary(vectors.type):
        lengths = pc.binary_length(vectors).fill_null(-2).to_numpy(zero_copy_only=False)
        raw = b"".join(x for x in vectors.to_pylist() if x is not None)
        return np.where(lengths % 2 == 0, lengths // 2, -3), np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<f2")
    return vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), vectors.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False)


def usable(vectors: pa.Array, dims: int) -> np.ndarray:
    """Which vectors have ``dims`` components, all of them finite numbers."""
    lengths, values = _parts(vectors)
    good = lengths == dims
    if (lengths == -3).any():  # an odd number of bytes: nothing after it can be told by its place
        return np.array([bool(g) and bool(np.isfinite(np.frombuffer(x, dtype="<f2")).all()) for g, x in zip(good, vectors.to_pylist())], dtype=bool)
    bad = ~np.isfinite(values)
    if bad.any():
        good[np.unique(np.repeat(np.arange(len(vectors)), np.maximum(lengths, 0))[bad])] = False
    return good


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Usable vectors as rows of doubles."""
    return _parts(vectors)[1].astype(np.float64).reshape(-1, dims)


def finite(vectors: list, dims: int | None = None) -> np.ndarray:
    """Which of a list of vectors hold finite numbers only, ``dims`` of them (of the first such one, if not given)."""
    good = np.array([v is not None and len(v) > 0 and all(x is not None for x in v) and bool(np.isfinite(np.asarray(v, dtype=np.float64)).all()) for v in vectors], dtype=bool)
    if dims is None and good.any():
        dims = len(vectors[int(np.flatnonzero(good)[0])])
    return good & np.array([v is not None and len(v) == dims for v in vectors], dtype=bool)


class Best:
    """The k best rows so far for each query, by score, then id."""

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.k, self.scored = q, k, 0
        self.of, self.score, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object)
        self.least = np.full(len(q), -np.inf)  # the k-th score, once there are k
        self._longest = np.abs(q).max(initial=0.0) * max(1, q.shape[1])

    def add(self, ids: pa.Array, x: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """Rows with their vectors; allowed: (queries x rows)."""
        margin = 1e-9 * (1 + np.abs(x).max(initial=0.0) * self._longest)
        step = max(1, STEP // max(1, len(x)))
        for a in range(0, len(self.q), step):
            near = self.q[a : a + step] @ x.T  # fast, but its last digits depend on the machine: only for choosing
            if allowed is not None:
                near = np.where(allowed[a : a + step], near, -np.inf)
            self.scored += near.size if allowed is None else int(np.count_nonzero(allowed[a : a + step]))
            floor = self.least[a : a + step]
            if self.k < len(x):
                floor = np.maximum(floor, np.partition(near, len(x) - self.k, axis=1)[:, len(x) - self.k])
            of, row = np.nonzero((near >= floor[:, None] - margin) & (near > -np.inf))
            for p in range(0, of.size, PAIRS):  # copies of a row tie, so pairs may be many more than k a query
                some, at = of[p : p + PAIRS] + a, row[p : p + PAIRS]
                self.put(some, inner_products(x[at], self.q[some]), np.array(ids.take(pa.array(at)).to_pylist(), dtype=object))

    def put(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scored rows of some queries; what is no longer among a query's k best goes."""
        again = np.isin(self.of, of)
        of, score, ids = (np.concatenate([old[again], new]) for old, new in ((self.of, of), (self.score, score), (self.ids, ids)))
        place = np.empty(ids.size, dtype=np.int64)
        place[np.array(sorted(range(ids.size), key=ids.__getitem__), dtype=np.int64)] = np.arange(ids.size)
        order = np.lexsort((place, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        nth = np.arange(of.size) - np.searchsorted(of, of, side="left")
        self.least[of[nth == self.k - 1]] = score[nth == self.k - 1]
        kept = nth < self.k
        self.of, self.score, self.ids = (np.concatenate([old[~again], new[kept]]) for old, new in ((self.of, of), (self.score, score), (self.ids, ids)))

    def hits(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """(query_id, photo_id, score) of what is left."""
        for a in range(0, self.of.size, HITS_BATCH):
            part = slice(a, a + HITS_BATCH)
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.of[part])), pa.array(self.ids[part], pa.string()), pa.array(self.score[part])], names=["query_id", "photo_id", "score"])


def scanner(query_ids: list[str], q: np.ndarray, k: int, probes: np.ndarray | None = None):
    """For mapInArrow over (id, vector) or, with probes (queries x clusters), over (id, vector, cluster): the k best rows of
    each task as (query_id, photo_id, score). Vectors that are null, of another length or hold nulls, NaNs or infinities take no
    part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(q, k)
        for batch in batches:
            good = usable(batch.column(1), q.shape[1])
            if not good.any():
                continue
            kept = batch if good.all() else batch.filter(pa.array(good))
            best.add(kept.column(0), matrix(kept.column(1), q.shape[1]), None if probes is None else probes[:, kept.column(2).to_numpy()])
        yield from best.hits(pa.array(query_ids, pa.string()))

    return run


HITS = "query_id string, photo_id string, score double"
