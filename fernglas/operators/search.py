"""Exact filtered top-k similarity search. Order is always score descending, then id.

Rows are filtered in the scan, and id and vector alone go to the Python workers in Arrow batches, where one matrix product
scores a batch for all queries; a task keeps the best k rows a query over all its batches, and only they leave it. Display
columns are joined to the rows that are left. Many queries go block by block, of at most QUERIES_BLOCK rows and HITS_BLOCK hits
a task, so that what is sent and held stays bounded whatever the number of queries.

Vectors that are null, of another length than the query or hold nulls, NaNs or infinities are never found. A query vector must
be finite; of many queries those that aren't, or whose length is not that of most of their block, find nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nearest import HITS, finite, scanner
from ..functions.text import photographer
from ..schema import EXIF, RESULT
from ..sources.collection import Collection
from ..sources.scratch import materialise
from .filters import FilterSpec, has_any_number, has_exif

QUERIES_BLOCK, HITS_BLOCK = 4096, 1 << 20
#: Rows up to which hits are broadcast to the rows they are shown with.
HITS_BROADCAST = 10_000
ID, VECTOR = "photo_id", "embedding"


def result_columns(score: str | Column = "score") -> list[Column]:
    """The 16 fields of a result."""
    renamed = {"photographer": photographer(None, F.col("photographer_first_name"), F.col("photographer_last_name")), "width": F.col("photo_width"), "height": F.col("photo_height"), "description": F.col("photo_description"), "score": F.col(score) if isinstance(score, str) else score}
    return [renamed.get(name, F.col(name)).alias(name) for name in RESULT]


def top_k(rows: DataFrame, k: int, score: str = "score", *ties: str) -> DataFrame:
    """The k best; none for k <= 0."""
    return rows.orderBy(F.col(score).desc(), *(ties or (ID,))).limit(max(0, k))


def search(corpus: DataFrame, query, k: int = 12, filters: FilterSpec | None = None, leave_out: str | None = None) -> DataFrame:
    """Results for one query vector. Rows are filtered before they are scored; leave_out: an id that never comes back."""
    rows = (filters or FilterSpec()).apply(corpus)
    if leave_out is not None:
        rows = rows.where(F.col(ID) != leave_out)
    return with_display(hits(rows, query, k), corpus, k)


def hits(rows: DataFrame, query, k: int) -> DataFrame:
    """(photo_id, score) of the k best rows."""
    if not finite([query])[0]:
        raise ValueError("a query vector holds finite numbers only")
    found = rows.select(ID, VECTOR).mapInArrow(scanner([""], np.asarray([query], dtype=np.float64), max(1, k)), HITS)
    return top_k(found.select(ID, "score"), k)


def with_display(hits: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Display columns of the k hits; hits without a row are skipped."""
    found = F.broadcast(hits) if k <= HITS_BROADCAST else hits
    return corpus.drop(VECTOR).join(found, ID).select(*result_columns()).orderBy(F.col("score").desc(), ID)


def stored_vector(corpus: DataFrame | Collection, photo_id: str) -> list[float] | None:
    """The vector of an item; unknown or without a vector: None. Of a collection one file is read, of a table all."""
    row = corpus.lookup(photo_id) if isinstance(corpus, Collection) else corpus.where(F.col(ID) == photo_id).select(VECTOR).first()
    return None if row is None or row[VECTOR] is None else list(row[VECTOR])


def similar(corpus: DataFrame, photo_id: str, k: int = 12, filters: FilterSpec | None = None, stored: Collection | None = None) -> DataFrame | None:
    """Neighbours of a stored item, itself left out by id; unknown: None. Filters hold for neighbours, not for the item.
    stored: a collection of the same rows, from which the item's vector is looked up."""
    found = stored_vector(corpus if stored is None else stored, photo_id)
    return None if found is None else search(corpus, found, k, filters, photo_id)


def query_blocks(queries: DataFrame, k: int) -> Iterator[tuple[list[str], np.ndarray, bool]]:
    """The queries (query_id, query) in order of their ids, in blocks that the driver holds one at a time; whether more
    may come."""
    most, last = max(1, min(QUERIES_BLOCK, HITS_BLOCK // max(1, k))), None
    while True:
        more = queries if last is None else queries.where(F.col("query_id") > last)
        block = more.select("query_id", "query").where("query_id is not null").orderBy("query_id").limit(most).collect()  # at most QUERIES_BLOCK
        lengths = Counter(len(r[1]) for r in block if r[1])
        good = finite([r[1] for r in block], lengths.most_common(1)[0][0] if lengths else 0)
        if good.any():
            yield [r[0] for r, g in zip(block, good) if g], np.array([r[1] for r, g in zip(block, good) if g], dtype=np.float64), len(block) == most
        if len(block) < most:
            return
        last = block[-1][0]


def search_many(corpus: DataFrame, queries: DataFrame, k: int, filters: FilterSpec | None = None) -> DataFrame:
    """(query_id, rank, photo_id, score) for all rows of ``queries`` (query_id, query), whose ids are distinct. With more
    than one block, each one's hits are a table in the shared folder before the next block is sent."""
    rows = (filters or FilterSpec()).apply(corpus).select(ID, VECTOR)
    return ranked_blocks(queries, k, lambda ids, q: rows.mapInArrow(scanner(ids, q, k), HITS))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their ranks."""
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), ID)
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", ID, "score")


def ranked_blocks(queries: DataFrame, k: int, scan: Callable[[list[str], np.ndarray], DataFrame]) -> DataFrame:
    found = None
    for ids, q, more in query_blocks(queries, k):
        best = ranked(scan(ids, q), k)
        if found is not None or more:
            best = materialise(best, "hits")
        found = best if found is None else found.union(best)
    return found if found is not None else queries.sparkSession.createDataFrame([], "query_id string, rank int, photo_id string, score double")


def best_image_per_text(scored: DataFrame, text: str, image: str, score: str = "score") -> DataFrame:
    """The given pairs with the best image of each text marked."""
    best = Window.partitionBy(text).orderBy(F.col(score).desc(), image)
    return scored.withColumn("best", F.row_number().over(best) == 1)


def counts(corpus: DataFrame) -> DataFrame:
    """Rows, rows with a filterable number, rows with any camera field."""
    return corpus.agg(F.count("*").alias("indexed"), F.count_if(has_any_number()).alias("exif_count"), F.count_if(has_exif()).alias("metadata_count"))


def integrity(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """Key agreement of two tables: rows on one side only, and repeated keys. All zero: aligned."""
    a, b = (t.groupBy(key).agg(F.count("*").alias(n)) for t, n in ((left, "a"), (right, "b")))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("b").isNull()).alias("only_left"),
        F.count_if(F.col("a").isNull()).alias("only_right"),
        F.coalesce(F.sum(F.greatest(F.col("a") - 1, F.lit(0))), F.lit(0)).alias("repeated_left"),
        F.coalesce(F.sum(F.greatest(F.col("b") - 1, F.lit(0))), F.lit(0)).alias("repeated_right"),
    )


def assert_aligned(left: DataFrame, right: DataFrame, key: str = ID) -> None:
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"length mismatch: {n} and {m} rows")
    if any(integrity(left, right, key).first()):
        raise ValueError("row alignment broken: the keys differ")


def sequence_hash(rows: DataFrame, position: str, *columns: str) -> DataFrame:
    """(rows, one, two): a digest of a sequence that is a sum over its rows, so tasks' sums add up in any order and nothing is
    sorted; it changes when a row changes, moves, goes or comes twice. Nulls count as values."""
    of = lambda seed: F.sum(F.xxhash64(F.lit(seed), position, *(F.xxhash64(F.col(c).isNull(), c) for c in columns)).cast("decimal(38,0)"))
    zero = F.lit(0).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(of(1), zero).alias("one"), F.coalesce(of(2), zero).alias("two"))


def same_sequence(a: DataFrame, b: DataFrame, position: str, *columns: str) -> bool:
    """Whether two tables hold the same rows at the same positions (of another number type or not), but for a chance of 2 ** -64
    and less."""
    first, second = (sequence_hash(t.withColumn(position, F.col(position).cast("long")), position, *columns).first() for t in (a, b))
    return tuple(first) == tuple(second)


def same_order(a: Column, b: Column) -> Column:
    """Whether two lists hold the same items in the same order; a missing list is like no other."""
    return F.coalesce(a == b, F.lit(False))


def metadata(corpus: DataFrame) -> DataFrame:
    """A sparse map of the camera fields that are there, and has_exif."""
    values = {"aperture": F.col("aperture").cast("string"), "iso": F.col("iso").cast("string"), "focal_length": F.col("focal_length").cast("string"), "exposure_s": F.col("exposure_s").cast("string"), "camera_make": F.lower(F.trim("camera_make")), "camera_model": F.trim("camera_model")}
    pairs = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
    return corpus.select(ID, F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("fields"), has_exif().alias("has_exif"))


def quality_report(photos: DataFrame) -> DataFrame:
    """For each camera field: values, their share of rows in percent, least and greatest number."""
    n = F.count("*")
    numbers = ["aperture", "focal_length", "exposure_s", "iso"]
    made = [n.alias("n"), F.count_if(F.col("aperture") <= 1.8).alias("wide")]
    for c in EXIF:
        made += [F.count(c).alias(f"n_{c}")]
        made += [f(F.col(c).cast("double")).alias(f"{p}_{c}") for f, p in ((F.min, "min"), (F.max, "max"))] if c in numbers else [F.lit(None).cast("double").alias(f"{p}_{c}") for p in ("min", "max")]
    one = photos.agg(*made)
    stack = ", ".join(f"'{c}', n_{c}, min_{c}, max_{c}" for c in EXIF)
    return one.selectExpr("n", "wide", f"stack({len(EXIF)}, {stack}) as (field, filled, least, greatest)").select("field", "filled", F.round(F.try_divide(F.col("filled") * 100.0, "n"), 4).alias("percent"), "least", "greatest", F.when(F.col("field") == "aperture", F.col("wide")).alias("at_most_1_8"))
