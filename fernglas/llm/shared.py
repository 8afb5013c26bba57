"""Small DataFrame helpers of the operators; tables in the shared folder are those of ``fernglas.sources.scratch``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise, remove, scratch, shared_dir, stored

__all__ = ["bound_batches", "components", "materialise", "numbered", "scratch", "shared_dir", "spread_join"]

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20
#: Keys of one row in HOT_KEYS or more are hot.
HOT_KEYS = 4096
#: Nodes (of three numbers) whose minima are broadcast.
BROADCAST_NODES = 1 << 18
#: Bytes of a table's files for each range of `numbered`.
RANGE_BYTES = 32 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session end at BATCH_BYTES: their size in the JVM and in Python workers then doesn't
    depend on how long the texts are. A smaller setting stays. It is left so, as results are computed after an operator has
    returned; no result depends on it."""
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph as (node, component), component being the smallest node.

    Alternating large-star and small-star rounds: each is one aggregation, with partial sums on the map side, and one join:
    up to BROADCAST_NODES nodes their minima are broadcast, beyond it the rows of hot nodes are spread. Neighbours' minima and edges are tables in the shared folder, and those of a star
    are removed when the next one is written. Null ends are dropped; loops and repeated edges do no harm; without edges the
    result is empty.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    now, old = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    total = 2 * now.count()  # neither star has more rows than twice the edges

    def star(rows: DataFrame, least: DataFrame, name: str, large: bool) -> tuple[DataFrame, str]:
        where = None
        if total <= BROADCAST_NODES:  # as many nodes at most
            met = rows.join(F.broadcast(least), "u")
        else:
            least, where = stored(least, "minima")
            met = spread_join(rows, least, ["u"], "n", ["m"], ["v"], total)
        met = (met.where("v > u") if large else met).select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = stored(met.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
        if where:
            remove(spark, where)
        return made

    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        large, next_to = star(both, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "large-star", True)
        remove(spark, old)
        now, old = star(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small-star", False)
        remove(spark, next_to)
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1))).groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        edges, not_yet = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
        total = 2 * edges
        if not not_yet:  # every node has one edge, to a node that has none itself
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def numbered(rows: DataFrame, group: list[str], order: list[str], at: str = "at", total: str = "n") -> DataFrame:
    """``rows`` with their place from 0 in their group by ``order`` (nulls first) and the group's number of rows.

    Rows are dealt out by ranges of (group, order), so a group of any size is spread over as many tasks as it fills; a place
    is the rank within the range plus the counts of the group's ranges before. What meets in one task is a range, or the
    counts of one group's ranges. ``rows`` is read three times, so it should be a table; its group columns hold no nulls.
    """
    spark = rows.sparkSession
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files, without a scan
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES if size < 1 << 60 else 0)
    dealt = rows.repartitionByRange(ranges, *(F.col(c).asc_nulls_first() for c in [*group, *order])).withColumn("range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    counts = dealt.groupBy(*group, "range").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy(*group)).alias(total))
    rank = F.row_number().over(Window.partitionBy(*group, "range").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    found = dealt.withColumn("rank", rank).join(counts, [*group, "range"])
    return found.select(*rows.columns, (F.col("rank") - 1 + F.col("before")).alias(at), F.col(total))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, columns: list[str], by: list[str], total: int | None = None) -> DataFrame:
    """``rows`` with ``columns`` of ``table``, which has one row a key and, in ``weight``, how many of ``rows`` have the key;
    null where it has none. Keys of at least a HOT_KEYS-th of those rows (``total``, or the sum of the weights), of which there are
    at most HOT_KEYS, are broadcast
    and their rows are dealt out over all tasks by the columns ``by`` (no random number, which would differ when a task is run
    again); the others meet in a shuffle. ``table`` is read three times, so it should be a table; keys hold no nulls."""
    total = total if total is not None else table.agg(F.sum(weight)).first()[0] or 0
    least = max(1, -(-total // HOT_KEYS))
    hot = table.where(F.col(weight) >= least).select(*keys, F.lit(True).alias("is_hot"), *(F.col(c).alias(f"hot_{c}") for c in columns))
    spread = rows.join(F.broadcast(hot), keys, "left")
    spread = spread.withColumn("spread", F.when(F.col("is_hot"), 1 + F.pmod(F.xxhash64(*by), F.lit(HOT_KEYS)).cast("int")).otherwise(0))
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")  # a constant would be taken out of the join's keys, and the spreading with it
    rest = table.where(F.col(weight) < least).select(*keys, zero.alias("spread"), *columns)
    met = spread.join(rest, [*keys, "spread"], "left")
    return met.select(*rows.columns, *(F.coalesce(F.col(f"hot_{c}"), F.col(c)).alias(c) for c in columns))
