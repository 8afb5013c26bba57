"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

A group is all rows of equal text; it goes to one shard as a whole. A group starts as a partial partition whose first
part is its bytes and whose other parts are empty. Differencing takes the two partial partitions of largest spread, joins
them in opposite order (largest part with smallest) and puts the result back, until one is left.

It runs in two levels. Groups are dealt out by hash and each task differences them, GROUPS at a time, so its memory doesn't
grow with the data; that leaves one partial partition, ``shards`` sums, for as many groups. Those sums (in all the number
of groups / GROUPS x shards numbers, not rows) are differenced on the driver, which gives the parts their shards. The heavy
tables hold no texts: id, size, checksum and a 32-byte group key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, spread_join

#: Groups that a task differences at once.
GROUPS = 200_000


def difference(sums: np.ndarray) -> np.ndarray:
    """``sums`` (n, k): the part sums of n partial partitions. Returns (n, k): the final part of each one's parts.

    Ties go to the earlier one, so the result depends on the order of rows alone.
    """
    n, k = sums.shape
    if not n:
        return np.zeros((0, k), dtype=np.int64)
    node: list[tuple[int, int, list[int], list[int]] | None] = [None] * n
    start = np.argsort(-sums, axis=1, kind="stable")
    heap: list[tuple[int, int, list[int]]] = []
    for i in range(n):
        own = sums[i][start[i]].tolist()
        heap.append((own[-1] - own[0], i, own))
    heapq.heapify(heap)
    backwards = range(k - 1, -1, -1)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        both = [x + y for x, y in zip(a, reversed(b))]
        order = sorted(range(k), key=both.__getitem__, reverse=True)
        made = [both[p] for p in order]
        node.append((i, j, order, [k - 1 - p for p in order]))
        heapq.heappush(heap, (made[-1] - made[0], len(node) - 1, made))
    place = np.zeros((len(node), k), dtype=np.int64)  # of each node's parts, in its own order
    place[heap[0][1]] = np.arange(k)
    for m in range(len(node) - 1, n - 1, -1):
        i, j, left, right = node[m]
        place[i, left], place[j, right] = place[m], place[m]
    out = np.empty((n, k), dtype=np.int64)
    np.put_along_axis(out, start, place[:n], axis=1)
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): ``shards`` shards of nearly equal bytes, equal texts together.

    size is the UTF-8 bytes of the text plus 1; a null text counts as an empty one, in size, checksum and group. slot
    numbers a shard's rows from 0 without gaps. Null ids and repeated rows are rows like others; an empty table gives
    none. A group larger than a shard's fair share can't be divided, so its shard is as large as it. Other columns of
    ``docs``, whatever their names, are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("text_key"))
    rows = materialise(rows, "shard-rows")
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32

        def differenced(some: list[pa.RecordBatch], run: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(some).combine_chunks()
            size = table["bytes"].to_numpy().astype(np.int64)
            order = np.argsort(-size, kind="stable")
            sums = np.zeros((size.size, shards), dtype=np.int64)
            sums[:, 0] = size[order]
            part = np.empty(size.size, dtype=np.int64)
            part[order] = difference(sums)[:, 0]
            return pa.RecordBatch.from_arrays([*(c.chunk(0) for c in table.columns), pa.array(np.full(size.size, task + run)), pa.array(part)], names=["text_key", "bytes", "rows", "task", "part"])

        some, run = [], 0
        for b in batches:
            for at in range(0, len(b), GROUPS):
                some.append(b.slice(at, GROUPS))
                if sum(map(len, some)) >= GROUPS:
                    yield differenced(some, run)
                    some, run = [], run + 1
        if sum(map(len, some)):
            yield differenced(some, run)

    local = materialise(groups.mapInArrow(parts, "text_key binary, bytes long, rows long, task long, part long"), "shard-parts")
    found = local.groupBy("task", "part").agg(F.sum("bytes").alias("bytes")).toArrow()  # groups / GROUPS x shards numbers
    tasks, row = np.unique(found["task"].to_numpy(), return_inverse=True)
    sums = np.zeros((tasks.size, shards), dtype=np.int64)
    sums[row, found["part"].to_numpy()] = found["bytes"].to_numpy()
    final = difference(sums)
    of_part = spark.createDataFrame([(t, p, int(final[k, p])) for k, t in enumerate(tasks.tolist()) for p in range(shards)], "task long, part long, shard int")
    shard_of = materialise(local.join(F.broadcast(of_part), ["task", "part"]).select("text_key", "rows", "shard"), "shard-of-text")
    sharded = spread_join(rows, shard_of, ["text_key"], "rows", ["shard"], ["doc_id"])
    return number_slots(sharded.drop("text_key"), "shard")


def number_slots(rows: DataFrame, shard: str) -> DataFrame:
    """Adds slot: each shard's rows numbered from 0 without gaps, without bringing a shard into one task. Rows are
    numbered within their task as they are written; then each task's first number, a sum over the tasks before it, is
    added (tasks x shards numbers)."""
    spark, names = rows.sparkSession, rows.columns

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            of = b.column(names.index(shard)).to_numpy()
            local = np.empty(of.size, dtype=np.int64)
            for s in np.unique(of).tolist():
                own = of == s
                local[own] = seen.get(s, 0) + np.arange(int(own.sum()))
                seen[s] = seen.get(s, 0) + int(own.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(of.size, task)), pa.array(local)], names=[*names, "slot_task", "slot_local"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", slot_task long, slot_local long"
    written = materialise(rows.mapInArrow(within, schema), "slots")
    before: dict[int, int] = {}
    first = []
    for r in written.groupBy("slot_task", shard).agg(F.count("*").alias("n")).orderBy("slot_task").collect():
        first.append((r["slot_task"], r[shard], before.get(r[shard], 0)))
        before[r[shard]] = before.get(r[shard], 0) + r["n"]
    starts = spark.createDataFrame(first, f"slot_task long, `{shard}` int, slot_first long")
    return written.join(F.broadcast(starts), ["slot_task", shard]).select(*names, (F.col("slot_first") + F.col("slot_local")).alias("slot"))
