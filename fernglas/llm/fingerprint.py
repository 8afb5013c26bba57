"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each 5-word shingle is hashed once: the high bits choose one of BINS bins, the rest is its value, and a bin keeps its
least value. An empty bin takes the value of the first filled bin in a fixed random order of its own, which makes empty
bins of two documents agree as often as filled ones. Of each bin's value, mixed with the bin's number, the lowest BITS
bits are kept; the likeness of two
fingerprints is the share of agreeing bins, corrected for agreement by chance.

A null text counts as an empty one. A text without words has the fingerprint ''; it is like another such text (1) and
unlike all others (0). Equal texts have equal fingerprints. Texts are hashed whole, whatever their length, in blocks; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import blocks, mix64, shingles

BINS, BITS, WORDS = 512, 2, 5
#: Bytes of input files for each range of documents, and the most ranges, whose bounds (8 bytes each) the driver holds: from 4 TB
#: of files on a range grows, to about 400 MB at 100 TB, which a task sorts on disk.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 262_144
_EMPTY = np.uint64((1 << 64) - 1)
_ORDERS: list[np.ndarray] = []


def _orders() -> np.ndarray:
    """Row i: the order in which empty bin i looks at the bins."""
    if not _ORDERS:
        _ORDERS.append(np.random.default_rng(512).permuted(np.tile(np.arange(BINS, dtype=np.int64), (BINS, 1)), axis=1))
    return _ORDERS[0]


def codes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x BINS) low-order bits as uint8, and which texts have any words."""
    flat, at = shingles(texts, words)
    n = len(texts)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    shift = np.uint64(64 - BINS.bit_length() + 1)
    least = np.full(n * BINS, _EMPTY, dtype=np.uint64)
    np.minimum.at(least, owner * BINS + (flat >> shift).astype(np.int64), flat & ((np.uint64(1) << shift) - np.uint64(1)))
    least = least.reshape(n, BINS)
    filled = least != _EMPTY
    some = filled.any(1)
    doc, gap = np.nonzero(~filled & some[:, None])
    orders, step = _orders(), 0
    while doc.size:
        source = orders[gap, step]
        hit = filled[doc, source]
        least[doc[hit], gap[hit]] = least[doc[hit], source[hit]]
        doc, gap, step = doc[~hit], gap[~hit], step + 1
    salted = mix64(least ^ (np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))  # a value in two bins: unrelated bits
    return (salted & np.uint64((1 << BITS) - 1)).astype(np.uint8), some


def pack(code: np.ndarray, some: np.ndarray) -> list[str]:
    """Each row's bits as lowercase hex; '' for a text without words."""
    bits = ((code[:, :, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint8)) & 1).reshape(len(code), -1)
    return [row.tobytes().hex() if s else "" for row, s in zip(np.packbits(bits, axis=1), some.tolist())]


def likeness(a: np.ndarray, b: np.ndarray, a_some: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """The estimated Jaccard similarity of rows, 0 to 1."""
    chance = 1.0 / (1 << BITS)
    same = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_some & b_some, same, np.where(a_some | b_some, 0.0, 1.0))


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The packed fingerprint of a text column."""

    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            column = column.fill_null("")
            yield pa.array([x for part in blocks(column) for x in pack(*codes(part, words))], pa.string())

    return run(text)


def _bucketed(docs: DataFrame, buckets: int) -> tuple[DataFrame, list[int]]:
    """``docs`` (doc_id, text) with a bucket by ranges of doc_id; at most ``buckets`` bounds are held."""
    shares = [k / buckets for k in range(1, buckets)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * buckets)).alias("b")).first()["b"] if shares else None
    bounds = np.array(sorted(set(found or [])), dtype=np.int64)

    @F.arrow_udf("long")
    def bucket(column: pa.Array) -> pa.Array:
        ids = column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(np.searchsorted(bounds, ids, side="left"))

    return docs.withColumn("bucket", bucket("doc_id")), bounds.tolist()


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document, by descending doc_id; after the last comes the first. Rows of equal id follow by their text; null ids come
    last. Documents are dealt out by ranges of doc_id, so that neighbours meet in one task with a single shuffle; each
    range also gets a copy of the first document of the range that follows.
    """
    spark = docs.sparkSession
    if buckets is None:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files, without a scan
        known = size < 1 << 60  # rows that come from no file have no size
        buckets = min(max(8, size // BUCKET_BYTES if known else 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_BUCKETS)
    own, _ = _bucketed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), buckets)
    ids = own.select("bucket", "doc_id")
    heads = sorted((r["bucket"], r["head"]) for r in ids.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())  # a number a bucket
    before = {b: heads[(k + 1) % len(heads)][0] for k, (b, _) in enumerate(heads)}
    first = spark.createDataFrame([(b, h, before[b]) for b, h in heads], "bucket long, head long, goes_before long")
    sent = own.join(F.broadcast(first), "bucket")
    copied = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("copy")), F.struct(F.col("goes_before").alias("at"), F.lit(True).alias("copy"))))
    sent = sent.select(F.explode(F.coalesce(copied, F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("copy"))))).alias("to"), "doc_id", "text").select("to.at", "to.copy", "doc_id", "text")
    sent = sent.repartition(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "at").sortWithinPartitions("at", "copy", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last document, whose next is not known yet
        for batch in batches:
            done = 0
            for part in blocks(batch.column(3)):
                at, copy, doc = (batch.column(k).slice(done, len(part)).to_pylist() for k in range(3))
                done += len(part)
                code, some = codes(part)
                rows = list(zip(at, copy, doc, part.to_pylist(), pack(code, some), code, some.tolist()))
                if waiting is not None:
                    rows.insert(0, waiting)
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
                waiting = rows[-1]
                if not pairs:
                    continue
                edited = []
                for x, y in pairs:
                    cut = len(x[3]) // 3
                    edited.append(x[3][: len(x[3]) - cut] + y[3][:cut])
                other, other_some = codes(pa.array(edited, pa.large_string()))
                mine, mine_some = np.stack([x[5] for x, _ in pairs]), np.array([x[6] for x, _ in pairs])
                theirs, theirs_some = np.stack([y[5] for _, y in pairs]), np.array([y[6] for _, y in pairs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in pairs], pa.int64()),
                        pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                        pa.array([x[4] for x, _ in pairs], pa.string()),
                        pa.array(pack(other, other_some), pa.string()),
                        pa.array(likeness(mine, other, mine_some, other_some)),
                        pa.array(likeness(mine, theirs, mine_some, theirs_some)),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return sent.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
