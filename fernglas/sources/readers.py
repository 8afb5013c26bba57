"""Scans. Paths go through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import photo_id_for
from ..schema import JUDGMENTS, QUERIES, RAW_PHOTOS
from .scratch import remove, stored

#: Image suffixes of the recursive and of the flat scan, and the size of the corpus that a good read has.
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "gif", "heic", "heif")
FLAT_IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "gif")
EXPECTED_ROWS = (24_000, 26_000)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that is there (put full precision first); the error names all."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of these is there: {', '.join(paths)}")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus in ``folder``: the full vectors if they are there, else those in 16 bits, which are searched alike."""
    return spark.read.parquet(first_existing(spark, [f"{folder.rstrip('/')}/{name}" for name in ("full", "half")]))


def read_tsv(spark: SparkSession, path: str, schema=RAW_PHOTOS, expected: tuple[int, int] = EXPECTED_ROWS) -> DataFrame:
    """Tab-separated text with quoting; read again without quoting if the number of rows is out of range, which means
    that stray quotes swallowed lines. Columns are matched by the header's names. The rows are a table in the shared folder, so
    the file is parsed once, and its rows are counted there."""

    def read(quote: str) -> DataFrame:
        options = {"sep": "\t", "header": True, "multiLine": quote != "", "quote": quote, "escape": quote or "\\", "enforceSchema": False}
        found = spark.read.options(**options).csv(path)
        return found.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))

    rows, path_of_rows = stored(read('"'), "tsv")
    if expected[0] <= rows.count() <= expected[1]:
        return rows
    remove(spark, path_of_rows)
    return stored(read(""), "tsv")[0]


def sample(spark: SparkSession, path: str, n: int, key: str = "photo_id") -> DataFrame:
    """The first n rows by key."""
    return spark.read.parquet(path).orderBy(key).limit(n)


def random_sample(rows: DataFrame, n: int, seed: int, key: str = "photo_id") -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of judgments -> (query_id, query, bucket, judged, relevant); no file: no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "query_id string, query string, bucket string, judged array<string>, relevant array<string>")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", JUDGMENTS).alias("j"))
    return whole.select(F.explode("j").alias("query_id", "v")).select("query_id", "v.*")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(QUERIES).json(path)


def scan_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, mtime, size, photo_id) of the images under a folder, hidden parts and stored thumbnails left out. Contents
    are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", "modificationTime", "length")
    path = F.regexp_replace("path", "^file:/*", "/")
    base = root.removeprefix("file://").rstrip("/")
    inner = F.substr(path, F.lit(len(base) + 1))
    kept = F.lower(path).rlike(rf"\.({'|'.join(IMAGES if recursive else FLAT_IMAGES)})$") & ~inner.rlike(r"(^|/)\.") & ~F.contains(path, F.lit("/library/thumbs/"))
    return files.where(kept).select(path.alias("path"), F.round(F.unix_millis("modificationTime") / 1000.0, 3).alias("mtime"), F.col("length").alias("size"), photo_id_for(path).alias("photo_id")).orderBy("path")


def read_file(path: str) -> bytes:
    """The bytes of a file in a folder that all executors see, by address or absolute path."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name, compression=None) as f:
        return f.read()


def http_get(address: str, timeout: float = 15.0) -> bytes:
    """The body of a web address; an error after ``timeout`` seconds without an answer."""
    with urllib.request.urlopen(address, timeout=timeout) as answer:
        return answer.read()


#: Requests that a task has in flight.
IN_FLIGHT = 12


def fetch(rows: DataFrame, url: str, get: Callable[[str], bytes] = http_get, attempts: int = 2, in_flight: int = IN_FLIGHT) -> DataFrame:
    """``rows`` with a binary column ``content``; a fetch that fails ``attempts`` times gives NULL, as a null address does. Each
    task keeps ``in_flight`` requests running over all its batches, so one dead host holds up one of them; contents come back in
    the order of the rows."""

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(address: str | None) -> bytes | None:
            for _ in range(attempts if address is not None else 0):
                try:
                    return get(address)
                except Exception:  # noqa: BLE001  a dead link is data here
                    continue
            return None

        with ThreadPoolExecutor(in_flight) as pool:
            for part in parts:
                running, out = deque(), []
                for address in part.to_pylist():
                    if len(running) >= 2 * in_flight:  # contents that wait for an earlier one are held, no more than these
                        out.append(running.popleft().result())
                    running.append(pool.submit(one, address))
                yield pa.array(out + [r.result() for r in running], pa.binary())

    return rows.withColumn("content", run(F.col(url)))


def decode(content: Column, decoder: Callable[[bytes], dict], schema: str) -> Column:
    """Structs made by an image decoder (which must read tags before it turns the picture); NULL where it raises."""

    @F.pandas_udf(schema)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for data in part:
                try:
                    rows.append(decoder(bytes(data)))
                except Exception:  # noqa: BLE001  an unreadable file is data here
                    rows.append({})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(",")], dtype=object)

    return run(content)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All finished chunks of a resumable build, in order."""
    return spark.read.parquet(folder).orderBy("chunk_id", "position")
