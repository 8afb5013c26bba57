"""The approximate store: rows partitioned by their nearest centroid, and a probe of clusters that goes on until it has enough.

Centroids come from k-means on a bounded sample of usable vectors; every usable row is assigned to one, the others stay out, as
no search finds them. For each cluster a zone is kept: rows, the largest distance from the centroid, least and greatest numbers
and the makes. A search probes clusters in the order of their centroids' products with the query, leaves out those whose zone
can't meet the filter, and reads what is left with partitions pruned statically. It ends when it has probed ``probe`` clusters
and found k rows. With certain=True it goes on while a cluster may hold a better row: none of its rows can score more than
q . centroid + |q| * largest distance, so the hits are those of exact search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from ..functions.nearest import HITS, STEP, finite, matrix, scanner, usable
from ..sources.readers import exists
from ..sources.scratch import materialise
from .filters import FilterSpec
from .search import ID, VECTOR, query_blocks, ranked, search_many, top_k, with_display

#: Sampled vectors for each centroid, and the most centroids, which the driver holds. Makes that a zone lists.
SAMPLE_EACH, MOST_CLUSTERS, MOST_MAKES = 64, 4096, 64
LEAST_SAMPLE, FEW_HITS = 20_000, 1000
_NUMBERS = ("aperture", "iso", "focal_length")


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of largest product for each row; at most STEP products are held, however many centres there are."""
    step = max(1, STEP // max(1, len(centres)))
    return np.concatenate([np.zeros(0, dtype=np.int64), *((x[a : a + step] @ centres.T).argmax(1) for a in range(0, len(x), step))])


def kmeans(x: np.ndarray, clusters: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids by cosine."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(clusters, len(x)), replace=False)]
    for _ in range(rounds):
        near = closest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def usable_rows(corpus: DataFrame, dims: int) -> DataFrame:
    """Rows whose vector has ``dims`` components, all finite."""
    bad = F.exists(F.col(VECTOR), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return corpus.where((F.size(VECTOR) == dims) & ~bad)


def sampled(corpus: DataFrame, n: int) -> np.ndarray:
    """At most n usable vectors, of the length that most of the sampled ones have, picked by a hash of their ids."""
    column = corpus.where(F.size(VECTOR) > 0).select(F.xxhash64(ID).alias("h"), VECTOR).orderBy("h", ID).limit(n).select(VECTOR).toArrow().column(0).combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if not lengths.size:
        return np.zeros((0, 0))
    dims = int(np.bincount(lengths).argmax())
    return matrix(column.filter(pa.array(usable(column, dims))), dims)


def _zones(rows: DataFrame) -> DataFrame:
    """What is known of each cluster."""
    numbers = [f(c).cast("double").alias(f"{n}_{c}") for c in _NUMBERS if c in rows.columns for n, f in (("least", F.min), ("greatest", F.max))]
    zones = rows.groupBy("cluster").agg(F.count("*").alias("rows"), F.max("distance").alias("radius"), *numbers)
    if "camera_make" not in rows.columns:
        return zones
    makes = rows.select("cluster", F.lower("camera_make").alias("make")).where("make is not null").distinct()
    few = makes.groupBy("cluster").agg(F.count("*").alias("n_makes")).withColumn("listed", F.col("n_makes") <= MOST_MAKES)
    listed = makes.join(few.where("listed"), "cluster").groupBy("cluster").agg(F.sort_array(F.collect_list("make")).alias("makes"))  # at most MOST_MAKES
    zones = zones.join(few, "cluster", "left").join(listed, "cluster", "left")
    return zones.withColumn("makes", F.when(F.col("n_makes").isNull(), F.array().cast("array<string>")).otherwise(F.col("makes"))).drop("n_makes", "listed")


def _may_match(zone: dict, spec: FilterSpec) -> bool:
    """Whether a row of the zone can meet the conditions."""
    for name, op, value in spec.clauses():
        if op == "$eq":
            if zone.get("makes", None) is not None and value not in zone["makes"]:
                return False
        elif f"least_{name}" in zone:
            edge = zone[f"least_{name}" if op == "$lte" else f"greatest_{name}"]
            if edge is None or (edge > value if op == "$lte" else edge < value):
                return False
    return True


@dataclass(frozen=True)
class ClusteredStore:
    rows: DataFrame  # with columns cluster and distance
    zones: list[dict]  # a dict a cluster, with its centre
    centres: np.ndarray

    @classmethod
    def build(cls, corpus: DataFrame, clusters: int | None = None, path: str | None = None) -> ClusteredStore:
        """clusters: by default the square root of the number of rows, at most MOST_CLUSTERS. Without a path the rows stay a
        plan, and only their zones are computed."""
        spark = corpus.sparkSession
        clusters = clusters or min(MOST_CLUSTERS, max(1, round(corpus.count() ** 0.5)))
        sample = sampled(corpus, max(LEAST_SAMPLE, SAMPLE_EACH * clusters))
        centres = kmeans(sample, clusters) if len(sample) else np.zeros((0, 0))

        @F.arrow_udf("cluster int, distance double")
        def nearest(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for c in columns:
                x = matrix(c, centres.shape[1])
                near = closest(x, centres)
                away = np.linalg.norm(x - centres[near], axis=1)
                yield pa.StructArray.from_arrays([pa.array(near.astype(np.int32)), pa.array(away)], names=["cluster", "distance"])

        if len(centres):
            rows = usable_rows(corpus, centres.shape[1]).withColumn("near", nearest(F.col(VECTOR))).withColumns({"cluster": F.col("near.cluster"), "distance": F.col("near.distance")}).drop("near")
        else:
            rows = corpus.limit(0).withColumns({"cluster": F.lit(0), "distance": F.lit(0.0)})
        if path is None:
            return cls._of(rows, _zones(rows).collect(), centres)
        # rebalanced, so that a cluster that holds a third of all rows is split over tasks and files
        rows.hint("rebalance", "cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/rows")
        stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
        table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cluster int, centre array<double>")
        table.join(_zones(stored), "cluster", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return cls.open(spark, path)

    @classmethod
    def _of(cls, rows: DataFrame, zones: list, centres: np.ndarray) -> ClusteredStore:
        known = {z["cluster"]: z.asDict() for z in zones}
        return cls(rows, [known.get(k, {"rows": None}) for k in range(len(centres))], centres)

    @classmethod
    def open(cls, spark, path: str) -> ClusteredStore:
        """A store that was built before; FileNotFoundError names what is missing."""
        for part in ("rows", "centres"):
            if not exists(spark, f"{path}/{part}"):
                raise FileNotFoundError(f"no clustered store at {path}: {part} is missing")
        centres = spark.read.parquet(f"{path}/centres").orderBy("cluster").collect()  # as many as clusters
        rows = spark.read.parquet(f"{path}/rows") if centres else spark.createDataFrame([], f"{ID} string, {VECTOR} array<float>, cluster int, distance double")
        return cls._of(rows, centres, np.array([r["centre"] for r in centres]) if centres else np.zeros((0, 0)))

    @classmethod
    def get_or_create(cls, corpus: DataFrame, path: str, clusters: int | None = None) -> ClusteredStore:
        """The store at ``path``, built from ``corpus`` if there is none yet."""
        spark = corpus.sparkSession
        return cls.open(spark, path) if exists(spark, f"{path}/centres") else cls.build(corpus, clusters, path)

    def _plan(self, q: np.ndarray, spec: FilterSpec) -> tuple[np.ndarray, np.ndarray]:
        """For each query the clusters that may match, nearest first, and the most that a row of each can score."""
        may = np.array([k for k, z in enumerate(self.zones) if z["rows"] and _may_match(z, spec)], dtype=np.int64)
        if not may.size:
            return np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0))
        near = q @ self.centres[may].T
        radius = np.array([self.zones[k]["radius"] for k in may])
        bound = near + np.linalg.norm(q, axis=1)[:, None] * radius + 1e-9
        order = np.argsort(-near, axis=1, kind="stable")
        return may[order], np.take_along_axis(bound, order, axis=1)

    def _probed(self, ids: list[str], q: np.ndarray, k: int, spec: FilterSpec, probe: int, certain: bool, leave_out: str | None = None) -> DataFrame:
        """(query_id, photo_id, score): in rounds, each over the next clusters of the queries that aren't done, twice as many
        as before. What the driver gets of a round is a count and a score a query."""
        rows = spec.apply(self.rows)
        if leave_out is not None:
            rows = rows.where(F.col(ID) != leave_out)
        order, bound = self._plan(q, spec)
        rest = np.maximum.accumulate(bound[:, ::-1], axis=1)[:, ::-1] if bound.size else bound  # the most of this cluster and all after it
        live, at, found = np.arange(len(q)), 0, None
        while live.size and at < order.shape[1]:
            to = min(order.shape[1], max(probe, 2 * at, 1))
            probes = np.zeros((live.size, len(self.centres)), dtype=bool)
            np.put_along_axis(probes, order[live, at:to], True, axis=1)
            read = rows.where(F.col("cluster").isin(np.flatnonzero(probes.any(0)).tolist())).select(ID, VECTOR, "cluster")
            some = read.mapInArrow(scanner([ids[i] for i in live], q[live], k, probes), HITS)
            at = to
            if found is None and at == order.shape[1]:
                return some
            some = ranked(some if found is None else some.union(found), k).drop("rank")
            found = materialise(some, "probed")
            if at < order.shape[1]:
                state = {r["query_id"]: (r["n"], r["least"]) for r in found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect()}  # a block of queries
                had = [state.get(ids[i], (0, 0.0)) for i in live]
                live = live[[n < k or (certain and least <= rest[i, at]) for i, (n, least) in zip(live, had)]]
        return found if found is not None else self.rows.sparkSession.createDataFrame([], HITS)

    def hits(self, query, k: int, filters: FilterSpec | None = None, probe: int = 8, certain: bool = False, leave_out: str | None = None) -> DataFrame:
        """(photo_id, score)."""
        if not finite([query])[0]:
            raise ValueError("a query vector holds finite numbers only")
        q = np.asarray([query], dtype=np.float64)
        if not len(self.centres) or q.shape[1] != self.centres.shape[1]:
            return self.rows.sparkSession.createDataFrame([], HITS).select(ID, "score")
        return top_k(self._probed([""], q, max(1, k), filters or FilterSpec(), probe, certain, leave_out).select(ID, "score"), k)

    def search(self, query, k: int = 12, filters: FilterSpec | None = None, probe: int = 8, leave_out: str | None = None, certain: bool = False) -> DataFrame:
        """Hits with their display rows."""
        found = materialise(self.hits(query, k, filters, probe, certain, leave_out), "hits")
        shown = self.rows.drop("cluster", "distance")
        if k <= FEW_HITS:  # ids that reach the scan
            shown = shown.where(F.col(ID).isin([r[0] for r in found.select(ID).collect()]))
        return with_display(found, shown, k)

    def search_many(self, queries: DataFrame, k: int, filters: FilterSpec | None = None, probe: int = 8, certain: bool = False) -> DataFrame:
        """(query_id, rank, photo_id, score) over the clusters that each query needs. Clusters that no query of a block
        probes are not read."""
        return probed_blocks(queries, k, self.centres.shape[1] if len(self.centres) else 0, lambda ids, q: self._probed(ids, q, k, filters or FilterSpec(), probe, certain))


def probed_blocks(queries: DataFrame, k: int, dims: int, scan: Callable[[list[str], np.ndarray], DataFrame]) -> DataFrame:
    """Ranked hits of all queries of ``dims`` components; the others find nothing."""
    found = None
    for ids, q, more in query_blocks(queries, k):
        if q.shape[1] != dims:
            continue
        best = ranked(scan(ids, q), k)
        if found is not None or more:
            best = materialise(best, "hits")
        found = best if found is None else found.union(best)
    return found if found is not None else queries.sparkSession.createDataFrame([], "query_id string, rank int, photo_id string, score double")


#: What a store may differ from exact search in scores, and how much of the first hits it must share.
MAX_GAP, LEAST_OVERLAP = 1e-4, 0.85


def verify(store, corpus: DataFrame, probes: DataFrame, filters: list[FilterSpec], k: int = 10, *effort) -> DataFrame:
    """A clustered or a graph store against exact search, every probe under every filter: largest gap of a shared hit's scores,
    mean overlap, and whether both gates hold. effort: the store's own (clusters probed, or width of the beam)."""
    from .evaluate import parity

    def named(found: DataFrame, n: int) -> DataFrame:
        return found.select(F.concat(F.lit(f"{n}:"), "query_id").alias("probe"), ID, "score")

    exact = approximate = None
    for n, spec in enumerate(filters):
        a, b = named(search_many(corpus, probes, k, spec), n), named(store.search_many(probes, k, spec, *effort), n)
        exact, approximate = (a, b) if exact is None else (exact.union(a), approximate.union(b))
    return parity(exact, approximate).withColumn("passed", (F.col("max_gap") <= MAX_GAP) & (F.col("mean_overlap") >= LEAST_OVERLAP))


def random_probes(spark, dims: int, n: int = 40, seed: int = 20260729) -> DataFrame:
    """n random unit vectors (query_id, query), the same for the same seed."""
    x = np.random.default_rng(seed).normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(f"{k:06d}", v.tolist()) for k, v in enumerate(x)], "query_id string, query array<double>")


def check_half_precision(corpus: DataFrame, probes: DataFrame, k: int = 10) -> DataFrame:
    """What storage in 16 bits changes: the vectors are stored as such and searched as they are. Largest score difference of the
    first k hits and largest norm error, probes with the same first k in the same order. All probes are taken, in the blocks of
    ``search_many``."""
    halved = materialise(corpus.select(ID, vector.pack_half(F.col(VECTOR)).alias(VECTOR)), "halves")
    norms = halved.agg(F.max(vector.norm_error(vector.unpack_half(F.col(VECTOR)))).alias("max_norm_error"))
    a, b = search_many(corpus, probes, k), search_many(halved, probes, k)
    order = lambda t, n: t.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", ID))), lambda x: x[ID]).alias(n))  # noqa: E731  k a probe
    delta = a.join(b.select("query_id", ID, F.col("score").alias("half")), ["query_id", ID]).agg(F.max(F.abs(F.col("score") - F.col("half"))).alias("max_delta"))
    same = order(a, "a").join(order(b, "b"), "query_id")
    return delta.crossJoin(norms).crossJoin(same.agg(F.count_if(F.col("a") == F.col("b")).alias("same_order"), F.count("*").alias("probes")))  # one row each
