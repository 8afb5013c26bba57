"""Maximum inner product search over score-aware (anisotropic) product quantisation.

Vectors are cut into pairs of dimensions; each pair has a codebook of 16 centres, so a code has four bits a pair. The
loss weighs the residual parallel to the vector ETA times the rest, because that part moves large inner products; codes
and centres are both fitted to that loss (coordinate descent; closed-form centres). A query's products with all centres
are its tables; scanning a row adds up table entries by its code, two codes a byte. The best REFINE rows of each scanned
batch are then scored exactly on the original vectors in double precision, and the best k of them kept.

Codebooks are fitted on SAMPLE rows, chosen by a hash of their ids; every row is indexed. Queries go to the executors in
blocks of QUERY_BLOCK, so what is broadcast has a fixed size; each block is one pass over the index, SCAN_ROWS rows at a
time. With more than one block, each one's result is written to the shared folder and its broadcast removed before the next.

Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components take no
part. Null ids take no part; a repeated id is a row like others, but never found for its own query. An empty table gives no
rows; other columns are not read. Ties go to the smaller id; a scan's copies of one vector beyond the k + 1 of smallest id
cannot be among the best k and are left out before the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

SAMPLE, QUERY_BLOCK, REFINE, SCAN_ROWS = 16_384, 32_768, 200, 8192
#: Inner products of at least this share of the norms are those whose error counts.
SCORE_THRESHOLD = 0.2
_CENTRES, _ROUNDS = 16, 8


@dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray  # pairs x 16 x 2
    dims: int
    eta: float

    def _pairs(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), 2 * len(self.centres)))
        wide[:, : self.dims] = x
        return wide.reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, codes: np.ndarray | None = None, rounds: int = 3) -> np.ndarray:
        """Codes (rows x pairs) that minimise the weighted loss, one pair after another."""
        pairs, n = self._pairs(x), len(x)
        unit = pairs / np.linalg.norm(x, axis=1)[:, None, None]
        every = np.arange(n)
        if codes is None:
            codes = np.stack([((pairs[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1) for m in range(len(self.centres))], axis=1)
        else:
            codes = codes.copy()
        along = sum(((pairs[:, m] - self.centres[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(len(self.centres)))
        for _ in range(rounds):
            for m, centres in enumerate(self.centres):
                residual = pairs[:, m, None] - centres
                part = (residual * unit[:, m, None]).sum(2)
                rest = along - part[every, codes[:, m]]
                codes[:, m] = ((residual**2).sum(2) + (self.eta - 1) * (rest[:, None] + part) ** 2).argmin(1)
                along = rest + part[every, codes[:, m]]
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes of a code x 256 x queries): what each byte adds to each query's score."""
        products = np.einsum("qmd,mcd->mcq", self._pairs(queries), self.centres)
        if len(products) % 2:
            products = np.concatenate([products, np.zeros_like(products[:1])])
        return (products[0::2, :, None, :] + products[1::2, None, :, :]).reshape(len(products) // 2, 256, -1).astype(np.float32)

    @staticmethod
    def to_bytes(codes: np.ndarray) -> np.ndarray:
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), dtype=codes.dtype)], axis=1)
        return (codes[:, 0::2] * _CENTRES + codes[:, 1::2]).astype(np.uint8)


def fit(x: np.ndarray, seed: int = 7) -> Quantiser:
    """Codebooks for the rows of x, which are finite and not zero."""
    n, dims = x.shape
    rng = np.random.default_rng(seed)
    share = SCORE_THRESHOLD**2
    eta = max(1.0, (dims - 1) * share / (1 - share))
    start = Quantiser(np.zeros(((dims + 1) // 2, _CENTRES, 2)), dims, eta)
    pairs = start._pairs(x)
    centres = np.stack([pairs[rng.choice(n, _CENTRES, replace=n < _CENTRES), m] for m in range(pairs.shape[1])])
    unit = pairs / np.linalg.norm(x, axis=1)[:, None, None]
    codes = None
    for _ in range(_ROUNDS):
        model = Quantiser(centres, dims, eta)
        codes = model.encode(x, codes, 1)
        along = sum(((pairs[:, m] - centres[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(len(centres)))
        centres = centres.copy()
        for m in range(len(centres)):
            u, p, k = unit[:, m], pairs[:, m], codes[:, m]
            rest = along - ((p - centres[m][k]) * u).sum(1)
            target = p + (eta - 1) * u * (rest + (p * u).sum(1))[:, None]
            left = np.zeros((_CENTRES, 2, 2))
            right = np.zeros((_CENTRES, 2))
            np.add.at(left, k, np.eye(2) + (eta - 1) * u[:, :, None] * u[:, None, :])
            np.add.at(right, k, target)
            used = np.bincount(k, minlength=_CENTRES) > 0
            centres[m][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            centres[m][~used] = p[rng.integers(0, n, int((~used).sum()))]
            codes[:, m] = np.where(used[k], k, 0)
            along = rest + ((p - centres[m][k]) * u).sum(1)
    return Quantiser(centres, dims, eta)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


@dataclass(frozen=True)
class Index:
    model: Quantiser | None
    rows: DataFrame  # vec_id, code, vector (binary, doubles)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """Fit on a bounded sample and encode every usable row into a table in the shared folder."""
    usable = _usable(vectors, id_col, vector_col)
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    if not sample:
        return Index(None, usable.select("vec_id", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("binary").alias("vector")))
    lengths = [len(r["vector"]) for r in sample]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), -n))
    model = fit(np.array([r["vector"] for r in sample if len(r["vector"]) == dims]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)
                code = model.to_bytes(model.encode(x))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "code", "vector"])

    rows = usable.where(F.size("vector") == dims).mapInArrow(run, "vec_id long, code binary, vector binary")
    return Index(model, materialise(rows, "ann-index"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def search(index: Index, queries: DataFrame, k: int = 20, refine: int = REFINE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query (id, vector), but the
    query's own id. ``queries`` has columns vec_id and vector like the index's rows."""
    spark = queries.sparkSession
    found, last, model = [], None, index.model
    while model is not None:
        more = queries if last is None else queries.where(F.col("vec_id") > last)
        block = more.orderBy("vec_id").limit(QUERY_BLOCK).collect()  # bounded by QUERY_BLOCK
        if not block:
            break
        last = block[-1]["vec_id"]
        sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in block]), np.stack([np.frombuffer(r["vector"]) for r in block])))
        hits = _ranked(index.rows.mapInArrow(_scan(model, sent, k, refine), "query_id long, vec_id long, score double"), k)
        if found or len(block) == QUERY_BLOCK:
            hits = materialise(hits, "ann-hits")
            sent.unpersist(True)
        found.append(hits)
        if len(block) < QUERY_BLOCK:
            break
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = found[0]
    for other in found[1:]:
        every = every.union(other)
    return every


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _inner_products(x: np.ndarray, near: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(queries, near): summed from the first component to the last, so that a score is the same on every machine."""
    out = np.zeros(near.shape)
    for d in range(x.shape[1]):
        out += x[:, d][near] * queries[:, d, None]
    return out


def _regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows, the last one of fewer, whatever the session's batches are."""
    some, n = [], 0
    for b in batches:
        while len(b):
            part = b.slice(0, rows - n)
            b = b.slice(len(part))
            some.append(part)
            n += len(part)
            if n == rows:
                yield pa.Table.from_batches(some)
                some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


def _scan(model: Quantiser, sent, k: int, refine: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = sent.value
        top_ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        top_scores = np.full((len(query_ids), k), -np.inf)
        for batch in _regrouped(batches, SCAN_ROWS):
            ids = batch.column(0).to_numpy()
            x = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(ids.size, -1)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(ids.size, -1)
            _, kind = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)
            order = np.lexsort((ids, kind))
            first = np.searchsorted(kind[order], kind[order], side="left")
            order = np.sort(order[np.arange(ids.size) - first <= k])
            ids, x, code = ids[order], x[order], code[order]
            take = min(refine, ids.size)
            for a in range(0, len(query_ids), 128):
                own, q = query_ids[a : a + 128], queries[a : a + 128]
                tables = model.tables(q)
                scores = np.zeros((ids.size, len(own)), dtype=np.float32)
                for m in range(code.shape[1]):
                    scores += tables[m][code[:, m]]
                near = np.argpartition(-scores.T, take - 1, axis=1)[:, :take] if take < ids.size else np.tile(np.arange(ids.size), (len(own), 1))
                exact = _inner_products(x, near, q)
                exact[ids[near] == own[:, None]] = -np.inf
                b = slice(a, a + len(own))
                top_ids[b], top_scores[b] = _best(np.concatenate([top_ids[b], ids[near]], 1), np.concatenate([top_scores[b], exact], 1), k)
        real = top_scores > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, k)[real.ravel()]), pa.array(top_ids[real]), pa.array(top_scores[real])], names=["query_id", "vec_id", "score"])

    return run
