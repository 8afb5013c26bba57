"""The photo corpus, captions and files that stand in the test tables, as views. The raw view's expressions are plain SQL
that Spark and an oracle both read; everything typed is made of it by this package's functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import caption, photo_id_for
from ..operators import bm25
from ..operators.graph import GraphStore
from ..operators.library import coerce_manifest
from ..operators.store import ClusteredStore
from ..sources.collection import Collection
from ..sources.prepare import parse_exif
from ..sources.readers import exists
from ..sources.scratch import made_once, read_known, scratch

#: Columns of the raw corpus over embeddings left join part on p_partkey = vec_id.
RAW = {
    "photo_id": "cast(vec_id as varchar(20))",
    "vec_id": "vec_id",
    "embedding": "embedding",
    "label": "label",
    "photo_image_url": "'https://img.example/' || cast(vec_id as varchar(20)) || case when vec_id % 2 = 0 then '?a=1' else '' end",
    "photo_url": "'https://page.example/' || cast(vec_id as varchar(20))",
    "photographer_first_name": "case when vec_id % 9 = 0 then '  ' when vec_id % 10 = 0 then null else ' N' || cast(label as varchar(20)) end",
    "photographer_last_name": "case when vec_id % 4 = 0 then null when vec_id % 18 = 9 then ' ' else 'L' || cast(vec_id as varchar(20)) || ' ' end",
    "photo_width": "4000",
    "photo_height": "case when vec_id % 3 = 0 then 9000 when vec_id % 3 = 1 then 3000 else 1000 end",
    "blur_hash": "cast(null as varchar(20))",
    "photo_description": "p_name",
    "ai_description": "p_type",
    "exif_aperture_value": "case when vec_id % 8 = 0 then null when vec_id % 23 = 0 then 'n/a' when vec_id % 29 = 0 then 'f/0' else 'f/' || cast(1 + p_size % 21 as varchar(20)) || '.' || cast(vec_id % 10 as varchar(20)) end",
    "exif_focal_length": "case when vec_id % 8 = 0 then null when vec_id % 3 = 0 then cast(p_size as varchar(20)) || '.0mm' when vec_id % 31 = 0 then 'mm' else ' ' || cast(p_size * 2 as varchar(20)) || ' mm' end",
    "exif_exposure_time": "case when vec_id % 8 = 0 then null when vec_id % 5 = 0 then '1/0' when vec_id % 7 = 0 then '2' when vec_id % 11 = 0 then 'abc' when vec_id % 13 = 0 then '0.5' when vec_id % 17 = 0 then '1/250 sec' else '1/' || cast(p_size * 10 as varchar(20)) || ' s' end",
    "exif_iso": "case when vec_id % 8 = 0 then null when vec_id % 13 = 0 then '0.4' when vec_id % 2 = 0 then cast(p_size * 100 as varchar(20)) else cast(p_size as varchar(20)) || '.5' end",
    "exif_camera_make": "case when vec_id % 8 = 0 then null when vec_id % 19 = 0 then ' ' else '  ' || upper(p_brand) || '   o''neil-CORP ' end",
    "exif_camera_model": "case when vec_id % 8 = 0 then null else ' ' || p_type || '  Mk2 ' end",
}
#: The rows of embeddings that are queries: a set that grows with the table.
ASKED = "vec_id % 50 = 0"
#: Files over documents.
PATH = "'/root/' || source || '/' || cast(doc_id as varchar(20)) || '.jpg'"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_known(spark, f"{sf_dir}/{name}.parquet")


def corpus_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    joined = _read(spark, sf_dir, "embeddings").join(part, F.col("p_partkey") == F.col("vec_id"), "left")
    return joined.selectExpr(*(f"{sql} as {name}" for name, sql in RAW.items()))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed corpus, a table of its own, so that filters reach the scan and camera strings are parsed once."""
    return made_once(spark, "corpus", [f"{sf_dir}/embeddings.parquet", f"{sf_dir}/part.parquet"], lambda: parse_exif(corpus_raw(spark, sf_dir)))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors that stand for encoded texts."""
    return _read(spark, sf_dir, "embeddings").where(ASKED).selectExpr("cast(vec_id as string) as query_id", "concat('b', label) as bucket", "label", "embedding as query")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant: the query's label, not the query itself; queries of label 7 have none."""
    rows = corpus(spark, sf_dir).select("photo_id", "label")
    queries = query_vectors(spark, sf_dir).where("label <> 7").select("query_id", "label")
    return rows.join(queries, "label").where("photo_id <> query_id").select("query_id", "photo_id")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def text_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """BM25 over documents."""
    paths = [f"{sf_dir}/documents.parquet"]
    return bm25.build_index(captions(spark, sf_dir), "doc_id", F.col("text"), lambda name, make: made_once(spark, f"text-{name}", paths, make))


def photo_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("photo_id", caption(F.col("ai_description"), F.col("photo_description")).alias("caption"))


def caption_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """BM25 over the photos' captions."""
    paths = [f"{sf_dir}/embeddings.parquet", f"{sf_dir}/part.parquet"]
    return bm25.build_index(photo_captions(spark, sf_dir), "photo_id", F.col("caption"), lambda name, make: made_once(spark, f"caption-{name}", paths, make))


def caption_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query photos' own captions stand for the texts that were encoded."""
    return photo_captions(spark, sf_dir).join(query_vectors(spark, sf_dir).select("query_id"), F.col("photo_id") == F.col("query_id")).select("query_id", F.col("caption").alias("query"))


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").selectExpr("cast(item_id as string) as query_id", "text as query")


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _read(spark, sf_dir, "documents").where("doc_id % 10 <> 3").selectExpr(f"{PATH} as path", "cast(doc_id as double) as mtime", "n_chars as size")
    return files.withColumn("photo_id", photo_id_for(F.col("path")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").where("doc_id % 10 <> 4")
    rows = docs.selectExpr(f"{PATH} as path", "cast(doc_id as double) + case when doc_id % 10 = 5 then 5 when doc_id % 10 = 6 then 0.0005 else 0 end as mtime", "n_chars + case when doc_id % 10 = 7 then 12 else 0 end as size")
    other = docs.where("doc_id % 50 = 1").selectExpr("'/rooted/' || cast(doc_id as string) || '.jpg' as path", "1.0D as mtime", "1L as size")
    return rows.union(other).withColumn("photo_id", photo_id_for(F.col("path")))


def clustered_store(spark: SparkSession, sf_dir: str, clusters: int | None = None) -> ClusteredStore:
    """The corpus in a partitioned table, built once."""
    return ClusteredStore.get_or_create(corpus(spark, sf_dir), _folder(spark, "store", sf_dir, clusters), clusters)


def graph_store(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The corpus with links between near rows, built once."""
    path = _folder(spark, "graph", sf_dir)
    return GraphStore.open(spark, path) if exists(spark, f"{path}/graph") else GraphStore.build(corpus(spark, sf_dir), path)


def photo_collection(spark: SparkSession, sf_dir: str) -> Collection:
    """The corpus as a collection, filled once."""
    rows = corpus(spark, sf_dir)
    made = Collection.open_or_create(spark, _folder(spark, "collection", sf_dir), rows.schema)
    if not made.entry()["version"]:
        made.upsert(rows)
        made.compact()
    return made


def manifest_collection(spark: SparkSession, sf_dir: str) -> Collection:
    """A new collection that holds the manifest."""
    rows = coerce_manifest(manifest(spark, sf_dir))
    made = Collection.create(spark, scratch(spark, "manifest"), rows.schema)
    made.upsert(rows)
    return made


def odd_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with vectors that can't be searched among the others: NaN, infinite and null components, short ones, none."""
    n, v = F.col("vec_id"), F.col("embedding")
    with_first = lambda x: F.concat(F.array(F.lit(x).cast("float")), F.slice(v, 2, 1000))
    odd = F.when(n % 11 == 3, with_first(float("nan"))).when(n % 13 == 5, with_first(float("inf"))).when(n % 17 == 7, with_first(None)).when(n % 19 == 9, F.slice(v, 1, 5)).when(n % 23 == 4, None).otherwise(v)
    return corpus(spark, sf_dir).withColumn("embedding", odd)


def _folder(spark: SparkSession, name: str, sf_dir: str, *more) -> str:
    key = (spark.sparkContext.applicationId, name, sf_dir, *more)
    if key not in _STORES:
        _STORES[key] = scratch(spark, name)
    return _STORES[key]


_STORES: dict[tuple, str] = {}
