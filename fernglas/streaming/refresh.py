"""A stream of files into an index: each micro-batch is one upsert of a collection. Deletions need the snapshot difference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import photo_id_for
from ..operators.library import coerce_manifest, library_rows
from ..sources.collection import Collection


def follow_files(spark: SparkSession, root: str) -> DataFrame:
    """New files as (path, mtime, size, photo_id)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(path.alias("path"), (F.unix_millis("modificationTime") / 1000.0).alias("mtime"), F.col("length").alias("size"), photo_id_for(path).alias("photo_id"))


def refresh(stream: DataFrame, manifest: Collection, checkpoint: str, load: Callable[[DataFrame], DataFrame] = library_rows):
    """Keep the collection ``manifest`` up to date: each micro-batch is one change of it, of the batch's size. A batch that is run
    again after a failure changes nothing more."""

    def merge(batch: DataFrame, number: int) -> None:
        manifest.upsert(coerce_manifest(load(batch.dropDuplicates(["photo_id"]))), f"{checkpoint} {number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
