"""The graph store: a navigable small-world graph over each part of the corpus, kept as an adjacency table, searched by beam.

Rows are dealt out by a hash of their ids into parts of about PART_ROWS, so parts are even and each is built by one task in
bounded memory: every node's nearest NEAR rows come from a blockwise product, of them those stay that are nearer to the node than
to a neighbour already kept, links are made both ways and cut to DEGREE, and a few long ones by chance keep the graph connected.

A search scores the part's seeds (about the square root of its rows), then expands, for all queries at once, the best node that
isn't expanded yet, until the best ``beam`` nodes all are. Rows that a filter rejects are walked through, but are no hits; where
fewer than k hits were met, all rows of the part that pass are scored, so a search returns k rows if there are k. Scores are exact.
Rows of unusable vectors (null, of another length than most, not finite) stay out, as no search finds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nearest import HITS, Best, finite, matrix
from ..sources.readers import exists
from .filters import FilterSpec
from .search import ID, VECTOR, top_k, with_display
from .store import probed_blocks, sampled, usable_rows

PART_ROWS, NEAR, DEGREE, LONG_LINKS = 20_000, 32, 24, 2
#: Scores of a block of queries that are held at once; a build holds a quarter as many numbers of each kind.
HELD = 1 << 23
_WORK = "query_id string, part int, scored long, rows long"


def build_links(x: np.ndarray, near: int = NEAR, degree: int = DEGREE, seed: int = 11) -> np.ndarray:
    """(n, degree) neighbours of each row, -1 where there are fewer."""
    n = len(x)
    if n < 2:
        return np.full((n, degree), -1, dtype=np.int32)
    near, rng = min(near, n - 1), np.random.default_rng(seed)
    kept = np.full((n, near), -1, dtype=np.int64)
    for a in range(0, n, step := max(1, min(HELD // 4 // n, HELD // 4 // (near * x.shape[1])))):
        own = np.arange(a, min(n, a + step))
        scores = x[own] @ x.T
        scores[np.arange(own.size), own] = -np.inf
        best = np.argpartition(-scores, near - 1, axis=1)[:, :near]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, axis=1), axis=1, kind="stable"), axis=1)
        there = x[best]
        away = np.linalg.norm(there - x[own][:, None], axis=2)
        stays = np.zeros(best.shape, dtype=bool)
        for j in range(near):  # nearer to the node than to any that stays
            gap = np.linalg.norm(there - there[:, j][:, None], axis=2)
            stays[:, j] = ~(stays & (gap < away[:, j][:, None])).any(1)
        kept[own] = np.where(stays, best, -1)
    long = rng.integers(0, n, (n, LONG_LINKS))
    start = np.repeat(np.arange(n), near + LONG_LINKS)
    end = np.concatenate([kept, long], axis=1).ravel()
    good = (end >= 0) & (end != start)
    start, end = start[good], end[good]
    pairs = np.unique(np.concatenate([start * n + end, end * n + start]))
    start, end = pairs // n, pairs % n
    step = max(1, HELD // 4 // x.shape[1])
    score = np.concatenate([(x[start[a : a + step]] * x[end[a : a + step]]).sum(1) for a in range(0, start.size, step)])
    wide = rng.random(start.size) < 0.05  # a few far ones stay among each node's
    order = np.lexsort((-np.where(wide, np.inf, score), start))
    start, end = start[order], end[order]
    nth = np.arange(start.size) - np.searchsorted(start, start, side="left")
    out = np.full((n, degree), -1, dtype=np.int32)
    out[start[nth < degree], nth[nth < degree]] = end[nth < degree]
    return out


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, beam: int, seed: int = 11) -> np.ndarray:
    """(queries, rows): the score of each row that was met, -inf for the others."""
    n, m = len(x), len(q)
    scores = np.full((m, n), -np.inf)
    seeds = np.sort(np.random.default_rng(seed).choice(n, min(n, max(1, round(n**0.5))), replace=False))
    scores[:, seeds] = q @ x[seeds].T
    width = min(beam, seeds.size)
    pool = seeds[np.argpartition(-scores[:, seeds], width - 1, axis=1)[:, :width]]
    pool = np.concatenate([pool, np.full((m, beam - width), -1)], axis=1)
    value = np.where(pool >= 0, np.take_along_axis(scores, np.maximum(pool, 0), axis=1), -np.inf)
    done = pool < 0
    live = np.arange(m)
    while live.size:
        open_value = np.where(done[live], -np.inf, value[live])
        at = open_value.argmax(1)
        some = open_value[np.arange(live.size), at] > -np.inf
        live, at = live[some], at[some]
        if not live.size:
            break
        done[live, at] = True
        next_to = links[pool[live, at]]
        new = (next_to >= 0) & (scores[live[:, None], np.maximum(next_to, 0)] == -np.inf)
        of, col = np.nonzero(new)
        nodes = next_to[of, col]
        got = np.einsum("ij,ij->i", q[live[of]], x[nodes])
        scores[live[of], nodes] = got
        more = np.full(new.shape, -np.inf)
        more[of, col] = got
        both = np.concatenate([value[live], more], axis=1)
        best = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        value[live] = np.take_along_axis(both, best, axis=1)
        pool[live] = np.take_along_axis(np.concatenate([pool[live], np.where(new, next_to, -1)], axis=1), best, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], axis=1), best, axis=1)
    return scores


@dataclass(frozen=True)
class GraphStore:
    nodes: DataFrame  # the corpus' columns, part, node, links
    dims: int

    @classmethod
    def build(cls, corpus: DataFrame, path: str, part_rows: int = PART_ROWS) -> GraphStore:
        spark = corpus.sparkSession
        sample = sampled(corpus, 1000)
        rows = usable_rows(corpus, sample.shape[1])
        parts = max(1, -(-rows.count() // part_rows))
        rows = rows.withColumn("part", F.pmod(F.xxhash64(ID), F.lit(parts)).cast("int"))

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, ids, x in _by_part(batches, sample.shape[1]):
                made = build_links(x)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), made.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, dtype=np.int32)), ids, pa.array(np.arange(len(ids), dtype=np.int32)), lists], names=["part", ID, "node", "links"])

        dealt = rows.select("part", ID, VECTOR).repartition(parts, "part").sortWithinPartitions("part", ID)
        links = dealt.mapInArrow(link, f"part int, {ID} string, node int, links array<int>")
        rows.join(links, ["part", ID]).repartition(parts, "part").sortWithinPartitions("part", "node").write.mode("overwrite").partitionBy("part").parquet(f"{path}/nodes")
        spark.createDataFrame([(sample.shape[1],)], "dims int").coalesce(1).write.mode("overwrite").parquet(f"{path}/graph")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark, path: str) -> GraphStore:
        """A store that was built before; FileNotFoundError names what is missing."""
        for part in ("nodes", "graph"):
            if not exists(spark, f"{path}/{part}"):
                raise FileNotFoundError(f"no graph store at {path}: {part} is missing")
        dims = spark.read.parquet(f"{path}/graph").first()["dims"]
        if not dims:  # an empty corpus leaves no files
            return cls(spark.createDataFrame([], f"{ID} string, {VECTOR} array<float>, part int, node int, links array<int>"), 0)
        return cls(spark.read.parquet(f"{path}/nodes"), dims)

    def _scan(self, ids: list[str], q: np.ndarray, k: int, beam: int, spec: FilterSpec, leave_out: str | None, work: bool) -> DataFrame:
        passes = spec.column()
        passes = F.lit(True) if passes is None else F.coalesce(passes, F.lit(False))
        if leave_out is not None:
            passes = passes & (F.col(ID) != leave_out)
        dims, beam = self.dims, max(beam, k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.array(ids, pa.string())
            for part, own, x, links, allowed in _by_part(batches, dims, True):
                best, counted = Best(q, k), []
                for a in range(0, len(q), step := max(1, HELD // len(x))):
                    some = q[a : a + step]
                    scores = beam_search(x, links, some, beam)
                    met = (scores > -np.inf) & allowed
                    scored = (scores > -np.inf).sum(1)
                    short = np.flatnonzero(met.sum(1) < min(k, int(allowed.sum())))
                    met[short] = allowed  # a selective filter: its rows are scored instead
                    scored[short] += int(allowed.sum())
                    counted += scored.tolist()
                    for b, row in enumerate(met):
                        if row.any():
                            pick = np.flatnonzero(row)
                            if pick.size > k and b not in short:
                                pick = pick[np.argpartition(-scores[b, pick], k)[: k + 1]]
                                pick = np.flatnonzero(row & (scores[b] >= scores[b, pick].min() - 1e-9))
                            one = Best(some[b : b + 1], k)
                            one.add(own.take(pa.array(pick)), x[pick])
                            best.put(one.of + a + b, one.score, one.ids)
                if work:
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(counted, pa.int64()), pa.array(np.full(len(ids), len(x)))], names=["query_id", "part", "scored", "rows"])
                else:
                    yield from best.hits(names)

        # a part's files are read by as many tasks as they fill, so its rows are brought together again
        read = self.nodes.select("part", ID, VECTOR, "node", "links", passes.alias("passes")).repartition("part").sortWithinPartitions("part", "node")
        return read.mapInArrow(run, _WORK if work else HITS)

    def hits(self, query, k: int, filters: FilterSpec | None = None, beam: int = 32, leave_out: str | None = None) -> DataFrame:
        """(photo_id, score)."""
        if not finite([query])[0]:
            raise ValueError("a query vector holds finite numbers only")
        q = np.asarray([query], dtype=np.float64)
        if q.shape[1] != self.dims:
            return self.nodes.sparkSession.createDataFrame([], HITS).select(ID, "score")
        return top_k(self._scan([""], q, max(1, k), beam, filters or FilterSpec(), leave_out, False).select(ID, "score"), k)

    def search(self, query, k: int = 12, filters: FilterSpec | None = None, beam: int = 32, leave_out: str | None = None) -> DataFrame:
        """Hits with their display rows."""
        return with_display(self.hits(query, k, filters, beam, leave_out), self.nodes.drop("part", "node", "links"), k)

    def search_many(self, queries: DataFrame, k: int, filters: FilterSpec | None = None, beam: int = 32) -> DataFrame:
        """(query_id, rank, photo_id, score)."""
        return probed_blocks(queries, k, self.dims, lambda ids, q: self._scan(ids, q, k, beam, filters or FilterSpec(), None, False))

    def work(self, queries: DataFrame, k: int, filters: FilterSpec | None = None, beam: int = 32) -> DataFrame:
        """(query_id, part, scored, rows): how many of a part's rows a search scores."""
        from .search import query_blocks

        found = None
        for ids, q, _ in query_blocks(queries, k):
            some = self._scan(ids, q, k, beam, filters or FilterSpec(), None, True)
            found = some if found is None else found.union(some)
        return found


def _by_part(batches: Iterator[pa.RecordBatch], dims: int, linked: bool = False) -> Iterator[tuple]:
    """Whole parts of sorted rows (part, id, vector[, node, links, passes])."""
    waiting: list[pa.RecordBatch] = []

    def whole() -> tuple:
        table = pa.Table.from_batches(waiting).combine_chunks()
        waiting.clear()
        ids, x = table[ID].chunk(0), matrix(table[VECTOR].chunk(0), dims)
        if not linked:
            return table["part"][0].as_py(), ids, x
        links = table["links"].chunk(0).flatten().to_numpy().reshape(len(ids), -1)
        return table["part"][0].as_py(), ids, x, links, table["passes"].to_numpy()

    now = None
    for batch in batches:
        part = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                if part[a] != now and waiting:
                    yield whole()
                now = part[a]
                waiting.append(batch.slice(a, b - a))
    if waiting:
        yield whole()
