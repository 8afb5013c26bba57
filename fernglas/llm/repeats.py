"""Repeated passages of LENGTH bytes or more, found exactly, in any text, across texts and within one.

1. Anchors. Every window of LENGTH bytes is named by its least gram of GRAM bytes by hash (the leftmost of several), so equal
   windows have equal anchors at equal places. Windows that follow one another with the same anchor make a segment: about 1.4
   LENGTH bytes for each 140 of text. Anchors that occur once are done with: nothing there repeats.
2. Equal segments. Segments that occur twice or more, with the anchor at the same place, repeat as a whole. Of a group of copies
   of any size that is all that moves: hashes, counted before they are shuffled.
3. Index. What is left are segments that share an anchor with different ones, one text for each different segment. Those of an
   anchor meet in one index of about BLOCK bytes; each window is in one segment only, so none meets itself. Of the index's
   Burrows-Wheeler transform the runs count: text positions are sampled at run starts and run ends, and the length of the match
   with the suffix before or after is computed there only. A scan in text order streams the matching statistics: from one sample
   to the next, a match is shorter by one byte at each step. Windows whose match reaches LENGTH are marked.
4. Anchors whose segments alone exceed a block have each of their windows hashed instead and counted, spread over all tasks.
5. Spans of a text are joined to it, merged and cut out.

Hashes have 64 bits (anchor and segment together 128); equal texts are told by 128 bits of SHA-256. Texts are read in pieces of
PIECE bytes with their surroundings, so a very long one takes no more memory in step 1; a text shorter than LENGTH, an empty or a
null one has no windows and stays. Rows of equal text, of one id or of null id are rows like others. An empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, materialise, spread_join
from .textkit import mix64, powers, release

LENGTH, GRAM = 400, 128
#: Bytes of segments that are indexed at once; bytes of a text that are hashed at once.
BLOCK, PIECE = 1 << 20, 1 << 18
#: Times that a task tells of a text it meets again; more than one is all that counts.
_TWICE, _MOST_SEEN = 2, 200_000
_U = np.uint64
_PLACE = _U((1 << 21) - 1)
_CODES = np.random.default_rng(400).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)


def _sums(data: np.ndarray, kind: int) -> np.ndarray:
    """Prefix sums from which any substring's hash follows."""
    out = np.zeros(data.size + 1, dtype=np.uint64)
    np.cumsum(_CODES[kind][data] * powers(data.size)[0], out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * powers(sums.size)[1][start])


def _window_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's anchor, and the hashes of all grams."""
    sums = _sums(data, 0)
    grams = mix64((sums[gram:] - sums[:-gram]) * powers(sums.size)[1][: data.size - gram + 1])
    least = (grams & ~_PLACE) | np.arange(grams.size, dtype=np.uint64)
    wide, step = length - gram + 1, 1
    while step * 2 <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if wide > step:
        least = np.minimum(least[: least.size - (wide - step)], least[wide - step :])
    return (least & _PLACE).astype(np.int64), grams


def segments(texts: list[np.ndarray], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, start, size, anchor, segment, rows) of the segments of ``texts``, of ``length`` bytes or more each and
    fewer than 2 ** 21 together; anchor and segment are hashes. Equal segments that follow one another, as in periodic texts, are
    one of that many rows."""
    ends = np.cumsum([t.size for t in texts])
    data = np.concatenate(texts)
    place, grams = _window_anchors(data, length, gram)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[: place.size]
    whole = np.arange(place.size) + length <= ends[owner]
    new = whole.copy()  # a segment begins here
    new[1:] &= (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], place.size)
    stop = np.minimum(stop, ends[owner[start]] - length + 1) + length - 1  # windows over the end of a text are none
    content = _hashes(_sums(data, 1), start, stop)
    anchor, segment = grams[place[start]], mix64(content ^ (place[start] - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    own = owner[start]
    first = np.ones(start.size, dtype=bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(first)
    rows = np.diff(at, append=start.size)
    return own[at], start[at] - (ends[own[at]] - np.array([t.size for t in texts])[own[at]]), stop[at + rows - 1] - start[at], anchor[at], segment[at], rows


def suffix_order(text: np.ndarray, owner: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffixes of segments in order. text: a byte + 1, or 0 at the end of a segment; those ends differ and are ordered by
    their segment (owner), whose end is at ``end``. Prefix doubling that sorts only what is still undecided."""
    n, width = text.size, 7
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, dtype=np.int64)])
    key, over = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for k in range(width):
        symbol = padded[k : k + n]
        over |= symbol == 0  # what comes after an end doesn't count
        key = (key << 9) | np.where(over, 0, symbol)
    key = np.where(text == 0, key | owner, key)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = np.diff(key[order]) != 0
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while True:
        todo = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not todo.size:
            return order
        own = order[todo]
        key = rank[own] * (n + 1) + rank[np.minimum(own + width, end[own])]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[todo] = own
        new = np.ones(todo.size, dtype=bool)
        new[1:] = np.diff(key) != 0
        fresh[todo] = new
        rank[own] = np.maximum.accumulate(np.where(new, todo, 0))
        width *= 2


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes are equal from a and from b on, at most ``most``. words: the 8 bytes from each place on."""
    out, live = most.copy(), np.flatnonzero(most > 0)
    at = 0
    while live.size:
        x = words[a[live] + at] ^ words[b[live] + at]
        differ = x != 0
        low = x[differ]
        first = (np.log2((low & (~low + _U(1))).astype(np.float64)).astype(np.int64)) >> 3
        hit = live[differ]
        out[hit] = np.minimum(out[hit], at + first)
        at += 8
        live = live[~differ]
        live = live[most[live] > at]
    return out


class RunIndex:
    """The runs of the Burrows-Wheeler transform of segments (bytes, one after another, with their ``ends``) and samples at
    their ends: for run starts the length of the match with the suffix before, for run ends with the suffix after."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        sizes = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(ends.size), sizes + 1)
        self.size = owner.size
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        inside = np.arange(self.size) - self.start[owner]
        real = inside < sizes[owner]
        text = np.zeros(self.size, dtype=np.int16)
        text[real] = data.astype(np.int16) + 1
        self.rest = sizes[owner] - inside
        order = suffix_order(text, owner, np.cumsum(sizes + 1)[owner] - 1)
        before = np.where(order > 0, text[order - 1], 0)
        cut = np.ones(self.size + 1, dtype=bool)  # a run starts here; ends of segments are runs of their own
        cut[1:-1] = (before[1:] != before[:-1]) | (before[1:] == 0)
        starts, stops = np.flatnonzero(cut[:-1]), np.flatnonzero(cut[1:])
        self.runs = starts.size
        padded = np.concatenate([np.where(real, text - 1, 0).astype(np.uint8), np.zeros(8, dtype=np.uint8)])
        words = np.zeros(self.size, dtype=np.uint64)
        for k in range(8):
            words |= padded[k : k + self.size].astype(np.uint64) << _U(8 * k)

        def matched(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            a, b = order[i], order[j]
            return _common(words, a, b, np.minimum(self.rest[a], self.rest[b]))

        up, down = np.zeros(starts.size, dtype=np.int64), np.zeros(stops.size, dtype=np.int64)
        up[1:] = matched(starts[1:], starts[1:] - 1)
        down[:-1] = matched(stops[:-1], stops[:-1] + 1)
        by = np.argsort(order[starts])
        self.start_at, self.start_match = order[starts][by], up[by]
        by = np.argsort(order[stops])
        self.stop_at, self.stop_match = order[stops][by], down[by]

    def statistics(self) -> np.ndarray:
        """For each byte, in text order, the longest match of what follows it in its segment with anything else: each sample's
        match, one shorter at each step to the next sample."""
        out = np.zeros(self.size, dtype=np.int64)
        for at, match in ((self.start_at, self.start_match), (self.stop_at, self.stop_match)):
            last = np.searchsorted(at, np.arange(self.size), side="right") - 1
            streamed = match[last] - (np.arange(self.size) - at[last])
            np.maximum(out, np.where(last >= 0, streamed, 0), out=out)
        return np.minimum(out, self.rest)

    def long_matches(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, start, end) of the merged stretches of matches of at least ``length``."""
        marked = np.flatnonzero(self.statistics() >= length)
        edge = np.zeros(self.size + 1, dtype=np.int64)
        np.add.at(edge, marked, 1)
        np.add.at(edge, marked + length, -1)
        covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        begin, end = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
        owner = np.searchsorted(self.start, begin, side="right") - 1
        return owner, begin - self.start[owner], end - self.start[owner]


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ANCHORS = pa.schema([("key", pa.binary()), ("start", pa.int64()), ("size", pa.int64()), ("anchor", pa.int64()), ("segment", pa.int64()), ("rows", pa.int64())])
_SPANS = pa.schema([("key", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])
_PIECES = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("single", pa.bool_()), ("crowded", pa.bool_()), ("bytes", pa.binary())])
_CUT = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_spans: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row: bytes covered by a string of ``length`` bytes that also starts
    anywhere else are removed, in n_spans stretches. with_spans adds removed, their (start, stop) in order; null where there
    are none. gram: at most ``length``."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    key = F.unhex(F.substring("sha", 1, 32))
    rows = materialise(whole.select("id", "sha", key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes")), "repeat-rows")
    long = whole.where(F.octet_length("text") >= length).select(key.alias("key"), "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def made(some: list[tuple]) -> pa.RecordBatch:
            own, start, size, anchor, segment, rows = segments([t for _, _, t in some], length, gram)
            keys = pa.array([k for k, _, _ in some], pa.binary()).take(pa.array(own))
            return _batch(_ANCHORS, keys, start + np.array([at for _, at, _ in some])[own], size, anchor.view(np.int64), segment.view(np.int64), rows)

        for batch in batches:
            some, held = [], 0
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if seen.get(own, 0) >= _TWICE:
                    continue
                if len(seen) >= _MOST_SEEN:
                    seen.clear()
                seen[own] = seen.get(own, 0) + 1
                data = np.frombuffer(value.as_buffer(), dtype=np.uint8)
                for at in range(0, data.size - length + 1, PIECE):
                    part = data[at : at + PIECE + length - 1]
                    some.append((own, at, part))
                    held += part.size
                    if held >= PIECE:
                        yield made(some)
                        some, held = [], 0
            if some:
                yield made(some)
        release()

    found = materialise(long.mapInArrow(anchors, "key binary, start long, size long, anchor long, segment long, rows long"), "anchors")
    often = found.groupBy("anchor").agg(F.sum("rows").alias("rows"), (F.min("segment") < F.max("segment")).alias("mixed")).where("rows > 1")
    found = spread_join(found, materialise(often, "shared-anchors"), ["anchor"], "rows", ["mixed"], ["key", "start"])
    found = materialise(found.where("mixed is not null"), "shared-segments")
    mixed = found.where("mixed")
    kinds = mixed.groupBy("anchor", "segment").agg(F.sum("rows").alias("rows"), F.min(F.struct("key", "start", "size")).alias("one"))
    kinds = materialise(kinds, "segments")
    again = materialise(kinds.where("rows > 1").select("anchor", "segment", "rows"), "repeated-segments")
    equal = spread_join(mixed, again.withColumn("more", F.lit(True)), ["anchor", "segment"], "rows", ["more"], ["key", "start"]).where("more")
    spans = found.where("not mixed").select("key", "start", "size").union(equal.select("key", "start", "size"))

    # of each anchor with a segment that occurs once: every segment's text, from one place
    sizes = kinds.groupBy("anchor").agg(F.sum(F.col("one.size")).alias("bytes"), F.min("rows").alias("least"), F.count("*").alias("kinds")).where("least = 1")
    wanted = spread_join(kinds, materialise(sizes, "anchors-to-index"), ["anchor"], "kinds", ["bytes"], ["segment"]).where("bytes is not null")
    wanted = materialise(wanted.select("anchor", "segment", "one.key", "one.start", "one.size", (F.col("rows") == 1).alias("single"), (F.col("bytes") > BLOCK).alias("crowded")), "segments-to-index")

    spans = spans.groupBy("key").agg(F.collect_set(F.struct("start", "size")).alias("spans"))  # as many as a text has segments
    asked = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "segment", "start", "size", "single", "crowded")).alias("asked"))
    told = spans.join(asked, "key", "full_outer")
    texts = long.groupBy("key").agg(F.first("text").alias("text"))
    texts = materialise(texts.join(told, "key"), "texts-with-repeats")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, value, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = value.as_buffer()
                out += [(a["anchor"], a["segment"], own, a["start"], a["single"], a["crowded"], data.slice(a["start"], a["size"]).to_pybytes()) for a in asked]
            yield _batch(_PIECES, *zip(*out)) if out else _batch(_PIECES, *[[]] * 7)

    cut = texts.where("asked is not null").select("key", "text", "asked").mapInArrow(pieces, "anchor long, segment long, key binary, start long, single boolean, crowded boolean, bytes binary")
    cut = materialise(cut, "segments-with-bytes")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, now, held = [], None, 0

        def finish() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            parts = table["bytes"].to_pylist()
            made = RunIndex(np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts]))
            segment, start, stop = made.long_matches(length)
            once = table["single"].to_numpy()[segment]
            segment, at = segment[once], table["start"].to_numpy()
            yield _batch(_SPANS, table["key"].take(pa.array(segment)).combine_chunks(), at[segment] + start[once], at[segment] + stop[once])

        for batch in batches:
            anchor = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(anchor)) + 1).tolist(), len(anchor)]
            for a, b in zip(edges[:-1], edges[1:]):  # whole anchors, until there is enough for an index
                if a < b:
                    if anchor[a] != now and held >= BLOCK:
                        yield from finish()
                        held = 0
                    now = anchor[a]
                    waiting.append(batch.slice(a, b - a))
                    held += waiting[-1].column(4).nbytes
        if waiting:
            yield from finish()
        release()

    dealt = cut.where("not crowded").select("anchor", "key", "start", "single", "bytes").repartition("anchor").sortWithinPartitions("anchor", "key", "start")
    matched = dealt.mapInArrow(index, "key binary, start long, stop long")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("hash", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("single", pa.bool_())])
        for batch in batches:
            for anchor, own, start, single, value in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(value, dtype=np.uint8)
                at = np.arange(data.size - length + 1)
                hashes = _hashes(_sums(data, 1), at, at + length)
                yield _batch(schema, np.full(at.size, anchor), hashes.view(np.int64), [own] * at.size, start + at, np.full(at.size, single))

    crowded = cut.where("crowded")
    if not crowded.isEmpty():
        each = materialise(crowded.select("anchor", "key", "start", "single", "bytes").mapInArrow(windows, "anchor long, hash long, key binary, start long, single boolean"), "windows")
        twice = materialise(each.groupBy("anchor", "hash").agg(F.count("*").alias("rows")).where("rows > 1"), "repeated-windows")
        met = spread_join(each.where("single"), twice.withColumn("more", F.lit(True)), ["anchor", "hash"], "rows", ["more"], ["key", "start"]).where("more")
        matched = matched.union(met.select("key", "start", (F.col("start") + length).alias("stop")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, value, equal, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = np.frombuffer(value.as_buffer(), dtype=np.uint8)
                edge = np.zeros(data.size + 1, dtype=np.int32)
                ends = [(s["start"], s["start"] + s["size"]) for s in equal or []] + [(s["start"], s["stop"]) for s in found or []]
                np.add.at(edge, [a for a, _ in ends], 1)
                np.add.at(edge, [b for _, b in ends], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = data[~gone].tobytes()
                bounds = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                spans = [{"start": a, "stop": b} for a, b in bounds.reshape(-1, 2).tolist()]
                if spans:
                    out.append((own, data.size - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans if with_spans else None))
            yield _batch(_CUT, *zip(*out)) if out else _batch(_CUT, *[[]] * 5)

    matched = matched.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    done = texts.select("key", "text", "spans").join(matched, "key", "left").where("spans is not null or found is not null").select("key", "text", "spans", "found")
    done = materialise(done.mapInArrow(remove, "key binary, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: bigint, stop: bigint>>"), "cut-texts")
    return _with_results(rows, done if with_spans else done.drop("removed"), id_col)


def _with_results(rows: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with what was cut from their texts; rows of one text share it."""
    copies = rows.groupBy("key").agg(F.count("*").alias("rows"))
    numbers = materialise(done.join(copies, "key"), "cut-numbers")
    out = spread_join(rows, numbers, ["key"], "rows", [c for c in done.columns if c != "key"], ["id"])
    zero = F.lit(0).cast("long")
    out = out.withColumns({"n_removed": F.coalesce("n_removed", zero), "n_spans": F.coalesce("n_spans", zero), "kept_sha256": F.coalesce("kept_sha256", "sha")})
    return out.select(F.col("id").alias(id_col), "n_bytes", *(c for c in done.columns if c != "key"))
