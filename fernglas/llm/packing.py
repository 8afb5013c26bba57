"""Vector bin packing of token sequences.

Every item has three sizes: tokens, segments (one) and loss-bearing tokens. A sequence is filled by the dot-product
heuristic: of the waiting items that fit its room in all three, the one goes in whose sizes have the largest dot
product with that room (each as a share of its limit). Where items may be cut, full sequences are cut from the front of
each document first; when nothing fits any longer, the item with the largest dot product is cut to fill the room, and its
rest waits on. What remains of a task's last sequence is cut into powers of two, which need no padding.

Each task packs its own partition in one pass, with at most WAITING items in memory, so there is no shuffle, and a lost
executor costs the repetition of its tasks only. Sequence numbers are unique over all partitions, not dense.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import bpe_count, text_batches, tokenizer
from .shared import bound_batches
from .textkit import release

#: Items that wait in a task; more are packed as they come, so memory is bounded.
WAITING = 4096


class Packer:
    """The waiting items of one task and the sequences made of them. Items of equal sizes are one class: a row of
    ``size`` and a queue, so that many short items cost no more than their kinds."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool) -> None:
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be at least 1")
        self.limit = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
        self.cut = cut
        self._set([])

    def _set(self, kept: list[tuple[tuple[int, int], deque]]) -> None:
        self.row = {kind: k for k, (kind, _) in enumerate(kept)}
        self.queue = [q for _, q in kept]
        self.size = np.ones((len(kept), 3))
        self.size[:, [0, 2]] = [kind for kind, _ in kept] if kept else np.zeros((0, 2))
        self.count = np.array([len(q) for q in self.queue], dtype=np.int64)

    @property
    def waiting(self) -> int:
        return int(self.count.sum())

    def add(self, sizes: list[tuple[int, int]], items: list[tuple]) -> None:
        """sizes: tokens and loss tokens of each item."""
        fresh: dict[tuple[int, int], deque] = {}
        for kind, item in zip(sizes, items):
            if (k := self.row.get(kind)) is not None:
                self.queue[k].append(item)
                self.count[k] += 1
            else:
                fresh.setdefault(kind, deque()).append(item)
        if fresh:
            self._set([(kind, self.queue[k]) for kind, k in self.row.items() if self.queue[k]] + list(fresh.items()))

    def _take(self, k: int, n: int) -> list[tuple]:
        self.count[k] -= n
        return [self.queue[k].popleft() for _ in range(n)]

    def _best_for(self, k: int, worth: np.ndarray, fits: np.ndarray, room: np.ndarray, share: np.ndarray) -> int:
        """How many items of class k go in one after another before another class is worth more or none is left."""
        loss = share @ share[k]  # what each class's worth falls by with every item of k
        slower = fits & (loss < loss[k])
        n = min(int(self.count[k]), int((room // np.maximum(self.size[k], 1e-9))[self.size[k] > 0].min()))
        if slower.any():
            n = min(n, 1 + int(((worth[k] - worth[slower]) / (loss[k] - loss[slower])).min()))
        return max(1, n)

    def fill(self, split) -> list[tuple]:
        """One sequence of the waiting items. split(item, tokens) -> (front, its loss tokens, rest, its loss tokens)."""
        room, share = self.limit.copy(), self.size / self.limit
        out, rests = [], []
        while True:
            there = self.count > 0
            fits = there & (self.size <= room).all(1)
            worth = share @ (room / self.limit)
            if fits.any():
                k = int(np.where(fits, worth, -1.0).argmax())
                n = self._best_for(k, worth, fits, room, share)
                out += self._take(k, n)
                room -= n * self.size[k]
                continue
            take = int(min(room[0], room[2]))
            if not self.cut or take < 1 or room[1] < 1 or not there.any():
                break
            k = int(np.where(there, worth, -1.0).argmax())
            front, front_loss, rest, rest_loss = split(self._take(k, 1)[0], take)
            out.append(front)
            room -= [take, 1, front_loss]
            rests.append(((int(self.size[k][0]) - take, rest_loss), rest))
        self.add([kind for kind, _ in rests], [rest for _, rest in rests])
        return out


def _first_sequence() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 33


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, max_tokens: int = 2048, max_segments: int | None = None, max_loss: int | None = None) -> DataFrame:
    """Tokens of whole texts, each followed by ``end_id``, cut freely and packed: a row per piece with doc_id, start
    (tokens of the document before it), length, tokens (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id
    and offset in the sequence. All tokens bear loss; without ``max_segments`` a sequence may hold as many segments as
    tokens. Null or empty text: the end token alone; without an end token, no piece. A text of any length is cut into
    full sequences first. Null ids are carried, repeated rows are packed each on its own. An empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    limits = max_tokens, max_segments or max_tokens, max_loss or max_tokens
    whole = min(limits[0], limits[2])
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, sequence = tokenizer(path), Packer(*limits, cut=True), _first_sequence()
        rows: list[tuple] = []

        def split(item: tuple, take: int) -> tuple:
            doc, start, ids, total = item
            return (doc, start, ids[:take], total), take, (doc, start + take, ids[take:], total), ids.size - take

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, ids.size, ids.tobytes(), total, sequence, offset))
                offset += ids.size
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 7
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            done = 0
            for part in text_batches(batch.column(1)):
                keys = batch.column(0).slice(done, len(part)).to_pylist()
                done += len(part)
                ids, at = bpe.encode_batch(part.to_pylist())
                sizes, items = [], []
                for k, doc in enumerate(keys):
                    own = ids[at[k] : at[k + 1]].astype("<u4")
                    if end_id is not None:
                        own = np.append(own, np.uint32(end_id)).astype("<u4")
                    full = own.size - own.size % whole
                    for a in range(0, full, whole):
                        put([(doc, a, own[a : a + whole], own.size)])
                    if own.size > full:
                        sizes.append((own.size - full, own.size - full))
                        items.append((doc, full, own[full:].copy(), own.size))
                packer.add(sizes, items)
                while packer.waiting > WAITING:
                    put(packer.fill(split))
                if rows:
                    yield flush()
        while packer.waiting:
            pieces = packer.fill(split)
            used = sum(p[2].size for p in pieces)
            if packer.waiting or used == limits[0]:
                put(pieces)
                continue
            for bit in reversed(range(limits[0].bit_length())):  # the last one
                if used >> bit & 1:
                    own, room = [], 1 << bit
                    while room:
                        p = pieces.pop(0)
                        if p[2].size > room:
                            p, _, rest, _ = split(p, room)
                            pieces.insert(0, rest)
                        own.append(p)
                        room -= p[2].size
                    put(own)
        yield flush()
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long")


def conversation_sizes(turns: DataFrame, path: str, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text", bearing: str = "assistant") -> DataFrame:
    """(id, tokens, loss) of each conversation: the tokens of its turns, each followed by an end token, and of those the
    ones of role ``bearing``. Null texts count as empty, null roles bear no loss; turns without an id are left out. Turns
    are counted where they lie; only the counts are grouped, with partial sums on the map side."""
    bound_batches(turns.sparkSession)
    sized = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (bpe_count(F.col(text_col), path) + 1).alias("n"), F.coalesce(F.col(role_col) == bearing, F.lit(False)).alias("bears"))
    return sized.groupBy("id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("loss"))


def pack_items(items: DataFrame, id_col: str, tokens_col: str, loss_col: str, max_tokens: int = 2048, max_segments: int = 64, max_loss: int = 1024) -> DataFrame:
    """Whole examples (instruction data), never cut: (id, tokens, loss, sequence_id, offset). An example that exceeds a
    limit by itself gets a sequence of its own; sizes that are null or negative count as 0. Null and repeated ids are
    items like others; an empty table gives no rows; other columns are not read."""
    limits = max_tokens, max_segments, max_loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence = Packer(*limits, cut=False), _first_sequence()

        def out(sequences: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for one in sequences:
                offset = 0
                for key, tokens, loss in one:
                    rows.append((key, tokens, loss, sequence, offset))
                    offset += tokens
                sequence += 1
            columns = list(zip(*rows)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), *[pa.int64()] * 4])], names=["id", "tokens", "loss", "sequence_id", "offset"])

        for batch in batches:
            rows = [(k, max(0, t or 0), max(0, n or 0)) for k, t, n in zip(*(c.to_pylist() for c in batch.columns))]
            alone = [[r] for r in rows if r[1] > max_tokens or r[2] > max_loss]
            packer.add([r[1:] for r in rows if r[1] <= max_tokens and r[2] <= max_loss], [r for r in rows if r[1] <= max_tokens and r[2] <= max_loss])
            while packer.waiting > WAITING:
                alone.append(packer.fill(None))
            yield out(alone)
        last = []
        while packer.waiting:
            last.append(packer.fill(None))
        yield out(last)

    return items.select(F.col(id_col).cast("string"), F.col(tokens_col).cast("long"), F.col(loss_col).cast("long")).mapInArrow(run, "id string, tokens long, loss long, sequence_id long, offset long")
