"""Sinks. A table is never overwritten while it is read: new states go to a new path that is then swapped in."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import exists
from .scratch import materialise

CHUNK = 500


def write_table(rows: DataFrame, path: str) -> None:
    """Overwrite through a new folder, so that ``rows`` may read from ``path``. The old table is moved aside and removed only
    when the new one is in its place; a crash leaves at least one of them."""
    spark = rows.sparkSession
    mark = uuid.uuid4().hex
    made, old = (f"{path.rstrip('/')}.{kind}-{mark}" for kind in ("new", "old"))
    rows.write.parquet(made)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    system = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = system.exists(path_of(path)) and system.rename(path_of(path), path_of(old))
    if not system.rename(path_of(made), path_of(path)):
        if aside:
            system.rename(path_of(old), path_of(path))
        raise OSError(f"could not move {made} to {path}")
    if aside:
        system.delete(path_of(old), True)
    spark.catalog.refreshByPath(path)


def chunk_ids(rows: DataFrame, key: str = "photo_id", size: int = CHUNK) -> DataFrame:
    """Adds position and chunk_id = floor(position / size), by key. Positions are counted range by range: only the
    ranges' sizes meet on the driver."""
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id())
    sizes = {r["__part"]: r["n"] for r in ordered.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    first, before = [], 0
    for part in sorted(sizes):
        first.append((part, before))
        before += sizes[part]
    starts = rows.sparkSession.createDataFrame(first, "__part int, __first long")
    within = Window.partitionBy("__part").orderBy(key)
    out = ordered.join(F.broadcast(starts), "__part").withColumn("position", F.col("__first") + F.row_number().over(within) - 1)
    return out.withColumn("chunk_id", F.floor(F.col("position") / size)).drop("__part", "__first")


def build_in_chunks(rows: DataFrame, folder: str, process: Callable[[DataFrame], DataFrame], key: str = "photo_id", size: int = CHUNK, chunks_a_job: int = 64, log: Callable[[str], None] = lambda line: None) -> tuple[DataFrame, DataFrame]:
    """Process rows chunk by chunk into ``folder``, ``chunks_a_job`` chunks a job, so that a crash keeps the jobs before it.
    Rows whose key is in the folder are done, whatever rows came since; the others get chunk numbers after those that are
    there. Returns the rows that succeeded (embedding not NULL) and those that failed."""
    spark = rows.sparkSession
    first, todo = 0, rows
    if exists(spark, folder):
        done = spark.read.parquet(folder)
        first = (done.agg(F.max("chunk_id")).first()[0] or 0) + 1
        todo = rows.join(done.select(key), key, "left_anti")
    todo = materialise(chunk_ids(todo, key, size).withColumn("chunk_id", F.col("chunk_id") + first), "chunks")
    last = todo.agg(F.max("chunk_id")).first()[0]
    if last is None:
        made = process(todo)  # nothing to do
        done = spark.read.parquet(folder) if made.count() == 0 and exists(spark, folder) else made
    else:
        for a in range(first, last + 1, chunks_a_job):
            process(todo.where(F.col("chunk_id").between(a, a + chunks_a_job - 1))).write.mode("append").partitionBy("chunk_id").parquet(folder)
            log(f"chunks to {min(last, a + chunks_a_job - 1)} of {last} done")
        done = spark.read.parquet(folder)
    return done.where("embedding is not null"), done.where("embedding is null")


def write_failed(failed: DataFrame, path: str, key: str = "photo_id") -> None:
    failed.select(F.col(key).cast("string")).orderBy(key).write.mode("overwrite").text(path)


def ingest(rows: DataFrame, path: str, reset: bool = False) -> bool:
    """Fill a collection once: False and nothing done if it has rows and ``reset`` isn't set. Checks the count after."""
    spark = rows.sparkSession
    if not reset and exists(spark, path) and spark.read.parquet(path).limit(1).count():
        return False
    write_table(rows, path)
    if (there := spark.read.parquet(path).count()) != (given := rows.count()):
        raise ValueError(f"{there} rows stored of {given}")
    return True


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_judgments(judgments: DataFrame, path: str) -> None:
    """One JSON object keyed by query, as ``read_judgments`` takes it. Judgments are made by hand, so one task holds them;
    ``judgments`` may read from ``path``."""
    fields = [F.col(c) if c in judgments.columns else F.lit(None).cast("string").alias(c) for c in ("query", "bucket")]
    entry = F.struct("query_id", F.struct(*fields, "judged", "relevant"))
    one = judgments.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))
    materialise(one, "judgments").coalesce(1).write.mode("overwrite").text(path)
