"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Sketch. Each text's set of word shingles gives its size, a 128-bit key of the set and the hashes of its BANDS bands of
   ROWS minimum hashes each. Texts with equal sets are one vertex, named by the smallest id, from here on.
2. Candidates. In each band bucket every vertex is tied to the bucket's smallest one (the minimum is pre-aggregated, so a
   hot bucket costs no more than its rows). The connected groups of these ties hold all pairs that share a band.
3. Verification. A group's texts meet in one task; a group too large for one is cut into blocks, a task each, and every
   block gets the group's smallest text as well. For each text, the others that share a band, differ in component so far
   and fit in size are compared by signature, batch after batch: a pair goes when, given the agreements seen and a uniform
   prior, the posterior chance that it reaches the similarity falls under MISS. Survivors are verified on the full sets.
   Pairs whose ends are connected already need no test; what leaves a task is at most one link a text, never all pairs.
4. Open buckets. Of the groups of several blocks, the buckets that still hold texts of different components are grouped
   again. The texts of such a group's largest component are compared with its other texts, and those with each other, in
   pairs of blocks, so no group is capped; two texts of the largest component never are. A group whose blocks were all
   connected through its smallest text has no open bucket left and costs one pass over its texts.
5. Components of the links.

A pair exactly at the similarity 0.8 shares no band with probability (1 - 0.8**5)**40 < 2e-7.

Texts are lower-cased in A-Z; words are ``[^\\x20\\x09-\\x0D]+``. A text with fewer words than a shingle takes has its
whole word sequence as the only one. Null or wordless texts have no shingles and are linked with nothing. Rows of null id
take no part: their component is null and they are kept. Rows that repeat an id count as one vertex. An empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, components, materialise, spread_join
from .textkit import blocks, mix64, release, shingle_sets

ROWS, BANDS = 5, 40
#: Chance at which a pair that reaches the similarity may be pruned, for each batch.
MISS = 1e-6
BATCH = 40
#: Shingles (and 256 a text) that a block of a large group holds; bounds a task's memory.
BLOCK_SHINGLES = 1_500_000
#: Bytes (PLACE_BYTES a row) of where texts go that are broadcast to the texts; beyond it both meet in a shuffle.
BROADCAST_BYTES, PLACE_BYTES = 32 << 20, 64

_SEEDS = np.random.default_rng(90210)
_FACTOR = (_SEEDS.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_SHIFT = _SEEDS.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """The minimum hashes of a non-empty set."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = None
    for at in range(0, x.size, 256):
        least = (x[at : at + 256, None] * _FACTOR + _SHIFT).min(0)
        out = least if out is None else np.minimum(out, least)
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS): the bucket of each band, the band's number mixed in."""
    cut = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for r in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return out.view(np.int64)


def least_matches(similarity: float, miss: float = MISS) -> dict[int, int]:
    """For each number of compared hashes, the least agreements with which a pair stays: with a uniform prior, the
    posterior chance of at least this similarity, P(Bin(n + 1, similarity) <= agreements), is not under ``miss``."""
    found = {}
    for n in range(BATCH, ROWS * BANDS + 1, BATCH):
        chance, m = 0.0, 0
        while (chance := chance + comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)) < miss:
            m += 1
        found[n] = m
    return found


def links(ids: list, sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, across: bool, percent: int, keep: dict[int, int]) -> list[tuple]:
    """Links that connect all texts of a group which the verified pairs connect, beyond those of equal label, which are
    connected already. across: only pairs of different side."""
    n = len(ids)
    if n < 2:
        return []
    signatures = np.stack([signature(s) for s in sets])
    bands = band_hashes(signatures)
    size = np.array([s.size for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(size)])
    local = [local[a:b] for a, b in zip(ends[:-1], ends[1:])]
    mark = np.zeros(int(ends[-1]), dtype=bool)
    group, out = np.unique(label, return_inverse=True)[1], []
    for a in range(n - 1):
        rest = np.arange(a + 1, n)
        smaller, larger = np.minimum(size[rest], size[a]), np.maximum(size[rest], size[a])
        rest = rest[(group[rest] != group[a]) & (100 * smaller >= percent * larger) & ((side[rest] != side[a]) | (not across))]
        rest = rest[(bands[rest] == bands[a]).any(1)] if rest.size else rest
        agree = np.zeros(rest.size, dtype=np.int64)
        for done, least in keep.items():
            if not rest.size:
                break
            agree += (signatures[rest, done - BATCH : done] == signatures[a, done - BATCH : done]).sum(1)
            stay = agree >= least
            rest, agree = rest[stay], agree[stay]
        if not rest.size:
            continue
        mark[local[a]] = True
        starts = np.concatenate([[0], np.cumsum(size[rest])[:-1]])
        common = np.add.reduceat(mark[np.concatenate([local[b] for b in rest])].astype(np.int64), starts)
        mark[local[a]] = False
        for b in rest[100 * common >= percent * (size[a] + size[rest] - common)].tolist():
            if group[b] != group[a]:
                group[group == group[b]] = group[a]
                out.append((ids[a], ids[b]))
    return out


def _open_buckets(members: DataFrame, buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Where the texts go which share a bucket with one of another component: (doc_id, component, side, label, others).
    Sides from 0 are blocks of the texts outside a group's largest component (label), which meet each other and all
    blocks of the largest one; those come after them and meet the former only."""
    labels = members.join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left")
    labels = materialise(labels.select("doc_id", "n", F.coalesce("label", "doc_id").alias("label")), "labels")
    theirs = buckets.join(labels, "doc_id").select("bucket", "doc_id", "label")
    still = theirs.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("doc_id").alias("leader")).where("low < high")
    groups = components(theirs.join(still.select("bucket", "leader"), "bucket").select("leader", "doc_id").distinct(), "leader", "doc_id")
    rows = labels.join(groups.withColumnRenamed("node", "doc_id"), "doc_id").withColumn("weight", F.col("n") + 256)
    weights = rows.groupBy("component", "label").agg(F.sum("weight").alias("weight")).groupBy("component")
    weights = weights.agg(F.max_by("label", F.struct("weight", "label")).alias("largest"), F.max("weight").alias("most"), F.sum("weight").alias("whole"))
    blocks_of = weights.select("component", "largest", F.ceil((F.col("whole") - F.col("most")) / BLOCK_SHINGLES).cast("int").alias("rest"), F.ceil(F.col("most") / BLOCK_SHINGLES).cast("int").alias("main"))
    rows = rows.join(blocks_of, "component").withColumn("is_main", F.col("label") == F.col("largest"))
    side = F.expr("cast(if(is_main, rest + pmod(xxhash64(doc_id), main), pmod(xxhash64(doc_id), rest)) as int)")
    last = F.when(F.col("is_main"), F.col("rest")).otherwise(F.col("rest") + F.col("main")) - 1
    return rows.select("doc_id", "component", side.alias("side"), "label", F.sequence(F.lit(0), last).alias("others"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: texts whose sets of ``words``-word shingles have
    100 * intersection >= percent * union are linked; component_id is the smallest id reachable, kept: doc_id is it.
    with_hash adds text_hash, Spark's xxhash64 of the text, which tells rows of one id apart."""
    bound_batches(docs.sparkSession)
    keep = least_matches(percent / 100)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in blocks(batch.column(1).fill_null("")):
                flat, at = shingle_sets(part, words)
                sets = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
                some = np.array([s.size > 0 for s in sets], dtype=bool)
                bands = band_hashes(np.stack([signature(s) for s in sets if s.size])) if some.any() else np.zeros((0, BANDS), dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(bands.ravel()))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(np.diff(at)), pa.array(keys, pa.binary()), lists, batch.column(2).slice(done, len(part))], names=["doc_id", "n_shingles", "set_key", "bands", "text_hash"])
                done += len(part)
        release()

    sketches = materialise(hashed.mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, bands array<bigint>, text_hash long"), "sketches")
    one = sketches.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("vertex"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
    one = materialise(one, "vertices")
    buckets = sketches.join(one.select("set_key", F.col("vertex").alias("doc_id")), ["set_key", "doc_id"]).select("doc_id", F.explode("bands").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("most"), F.count("*").alias("rows")).where("leader < most").drop("most")
    ties = spread_join(buckets, materialise(leaders, "leaders"), ["bucket"], "rows", ["leader"], ["doc_id"])
    groups = materialise(components(ties.where("leader <> doc_id").select("leader", "doc_id").distinct(), "leader", "doc_id"), "groups")

    parts = groups.join(one, F.col("node") == F.col("vertex")).groupBy("component").agg(F.ceil(F.sum(F.col("n") + 256) / BLOCK_SHINGLES).cast("int").alias("parts"), F.count("*").alias("rows"))
    members = spread_join(groups, materialise(parts, "parts"), ["component"], "rows", ["parts"], ["node"])
    members = materialise(members.join(one, F.col("node") == F.col("vertex")).select(F.col("node").alias("doc_id"), "component", "parts", "n"), "members")
    members = members.withColumn("side", F.expr("cast(pmod(xxhash64(doc_id), parts) as int)"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, sides, labels = None, [], [], [], []

        def finish() -> list[tuple]:
            found = links(ids, sets, np.array(sides), np.array(labels), now[1] != now[2], percent, keep) if ids else []
            ids.clear(), sets.clear(), sides.clear(), labels.clear()
            return found

        for batch in batches:
            out, done = [], 0
            for part in blocks(batch.column(6).fill_null("")):
                flat, at = shingle_sets(part, words)
                component, i, j, side, label, doc = (batch.column(k).slice(done, len(part)).to_pylist() for k in range(6))
                done += len(part)
                for k, key in enumerate(zip(component, i, j)):
                    if key != now:
                        out += finish()
                        now = key
                    if at[k + 1] > at[k]:
                        ids.append(doc[k])
                        sets.append(flat[at[k] : at[k + 1]].copy())
                        sides.append(side[k])
                        labels.append(label[k])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        out = finish()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        release()

    def verified(placed: DataFrame) -> DataFrame:
        """Links of ``placed`` (doc_id, component, side, label, others): each text goes to the tasks (side, other)."""
        placed = materialise(placed, "places")
        small = placed.count() * PLACE_BYTES <= BROADCAST_BYTES
        sent = texts.join(F.broadcast(placed) if small else placed.hint("shuffle_merge"), "doc_id").withColumn("other", F.explode("others"))
        sent = sent.select("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "label", "doc_id", "text")
        sent = sent.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "doc_id")
        return sent.mapInArrow(verify, "a long, b long")

    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    root = F.when(F.col("doc_id") == F.col("component"), everywhere).otherwise(F.array("side"))
    placed = members.select("doc_id", "component", F.explode(root).alias("side"), F.col("doc_id").alias("label"))
    found = components(verified(placed.withColumn("others", F.array("side"))), "a", "b")
    if not parts.where("parts > 1").isEmpty():
        placed = _open_buckets(members.where("parts > 1"), buckets, found)
        found = components(found.select("node", "component").union(verified(placed)), "node", "component")
    label = one.join(found, F.col("vertex") == F.col("node"), "left").select("set_key", "rows", F.coalesce("component", "vertex").alias("component_id"))
    hashes = ["text_hash"] if with_hash else []
    linked = sketches.where("set_key is not null and doc_id is not null").select("doc_id", "n_shingles", "set_key", *hashes)
    linked = spread_join(linked, materialise(label, "labels"), ["set_key"], "rows", ["component_id"], ["doc_id"]).select("doc_id", "n_shingles", "component_id", *hashes)
    alone = sketches.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *hashes)
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
