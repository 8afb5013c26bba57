"""Byte-pair encoding and decoding of whole texts, all words of a batch at once.

Each short word is a contiguous row: its parts (the boundaries) and the ranks of its adjacent pairs. The loop scans the
ranks for the minimum, deletes that boundary and refreshes the two neighbouring ranks; words of equal length lie in one
matrix, so that one numpy step serves thousands of words. Words beyond LONG_WORD symbols take a heap over a linked list,
whose cost doesn't grow with the square of the length.

Normalisation and word classes come from Python's Unicode tables. Where the library's are of another Unicode version (code
points that Python doesn't know, and marks that came after 3.2), the text goes through the library's own normaliser and
word cutter instead, and its words are merged here like all others.

Nulls count as empty texts; empty texts give no ids and decode to ''. Results depend on the text alone, so repeated rows
get equal results. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import BLOCK_BYTES, blocks, mix64, powers, release

#: What the vocabulary's cutter takes for white space, and the endings it keeps with their apostrophe.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSETTLED = 0, 1, 2, 3, 4
_NONE = np.int64(1 << 40)
#: Longer words (in code points) are merged on a heap and not remembered.
LONG_WORD = 256
#: Distinct words remembered by a worker. Beyond it the earliest KEPT stay, which are mostly the frequent ones; what is
#: forgotten is merged anew when it comes again, so no result depends on it.
REMEMBERED, KEPT = 200_000, 100_000


def _classes() -> np.ndarray:
    """Each code point's class. _UNSETTLED: versions of Unicode may differ in its class, case, order or composition."""
    kinds = np.full(0x110000, _OTHER, dtype=np.uint8)
    old = unicodedata.ucd_3_2_0
    unsettled = []
    for c in range(0x110000):
        char = chr(c)
        major = unicodedata.category(char)
        if major == "Cn":
            kinds[c] = _UNSETTLED
        elif major[0] in "LN":
            kinds[c] = _LETTER if major[0] == "L" else _NUMBER
        if (unicodedata.combining(char) or unicodedata.decomposition(char)) and old.category(char) == "Cn":
            unsettled += [c, *(int(x, 16) for x in unicodedata.decomposition(char).split() if x[0] != "<")]
    kinds[[c for c in unsettled if c >= 0x300]] = _UNSETTLED
    kinds[_WHITE] = _SPACE
    return kinds


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Flat:
    """Rows of numbers of unequal length in one growing array."""

    def __init__(self) -> None:
        self.data, self.size = np.zeros(1024, dtype=np.int32), 0
        self.start, self.length, self.rows = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64), 0

    def add(self, data: np.ndarray, lengths: np.ndarray) -> None:
        while self.data.size < self.size + data.size:
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.start.size < self.rows + lengths.size:
            self.start, self.length = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.length, np.zeros_like(self.length)])
        self.data[self.size : self.size + data.size] = data
        self.length[self.rows : self.rows + lengths.size] = lengths
        self.start[self.rows : self.rows + lengths.size] = self.size + np.cumsum(lengths) - lengths
        self.size, self.rows = self.size + data.size, self.rows + lengths.size

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows, one after another, and their lengths."""
        lengths = self.length[rows]
        at = np.cumsum(lengths) - lengths
        return self.data[np.repeat(self.start[rows] - at, lengths) + np.arange(int(lengths.sum()))], lengths


class WordBpe:
    """Encoder and decoder of a tokenizers JSON file with word ends (``</w>``), as the tokenizers library runs it with
    add_special_tokens=False: special tokens in a text are found, the rest is NFC, lower case and cut into words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        end, alphabet = spec["model"]["end_of_word_suffix"], _byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in alphabet], dtype=np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = np.int64(len(self.token))
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.order = np.argsort(keys, kind="stable").astype(np.int64)
        self.keys = keys[self.order]
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.kinds = _classes()
        self.path, self._library = path, None
        self._forget(0)

    def _forget(self, kept: int) -> None:
        """Keep only the first rows."""
        if not kept:
            self.rows, self.hashes, self.row_of = _Flat(), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            return
        stay = self.row_of < kept
        self.hashes, self.row_of = self.hashes[stay], self.row_of[stay]
        self.rows.size, self.rows.rows = int(self.rows.start[kept]), kept

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, want), self.keys.size - 1)
        return np.where(self.keys[at] == want, self.order[at], _NONE)

    def _merge_rows(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of equal length as rows -> (row, ids of all rows, count of each), rows in the order they end."""
        row = np.arange(len(parts))
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while row.size:
            width = parts.shape[1]
            least = ranks.argmin(1) if width > 1 else np.zeros(row.size, dtype=np.int64)
            best = ranks[np.arange(row.size), least] if width > 1 else np.full(row.size, _NONE)
            over = best == _NONE
            if over.any():
                ended.append((row[over], parts[over].ravel(), np.full(int(over.sum()), width)))
                row, parts, ranks, least, best = row[~over], parts[~over], ranks[~over], least[~over], best[~over]
                if not row.size:
                    break
            here = np.arange(row.size)
            parts[here, least] = self.made[best]
            keep = np.ones(parts.shape, dtype=bool)
            keep[here, least + 1] = False
            parts = parts[keep].reshape(row.size, width - 1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[here, least] = False
            ranks = ranks[keep].reshape(row.size, width - 2)
            before, after = np.flatnonzero(least > 0), np.flatnonzero(least < width - 2)
            side = np.concatenate([before, after])
            pair = np.concatenate([least[before] - 1, least[after]])
            if side.size:
                ranks[side, pair] = self._rank(parts[side, pair], parts[side, pair + 1])
        return tuple(np.concatenate(x) for x in zip(*ended))

    def _merge_long(self, parts: list[int]) -> list[int]:
        """One long word: the same merges, from a heap of (rank, place) over a linked list."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self._rank(np.array(parts[:-1], dtype=np.int64), np.array(parts[1:], dtype=np.int64))
        heap = [(int(r), i) for i, r in enumerate(ranks) if r != _NONE]
        heapq.heapify(heap)
        index = dict(zip(self.keys.tolist(), self.order.tolist())) if not hasattr(self, "_index") else self._index
        self._index, width, dead = index, int(self.width), -1
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] == dead or j >= n or index.get(parts[i] * width + parts[j]) != rank:
                continue
            parts[i], parts[j] = int(self.made[rank]), dead
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := index.get(parts[i] * width + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := index.get(parts[before[i]] * width + parts[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [x for x in parts if x != dead]

    def _encode_words(self, words: list[str]) -> _Flat:
        """Row k: the ids of words[k]."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        at = np.cumsum(lengths) - lengths
        out, order = _Flat(), []
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            if n > LONG_WORD:
                for k in rows:
                    own = data[at[k] : at[k] + n]
                    ids = self._merge_long([*self.inner[own[:-1]].tolist(), int(self.last[own[-1]])])
                    out.add(np.array(ids, dtype=np.int32), np.array([len(ids)]))
                    order.append(np.array([k]))
                continue
            for some in np.array_split(rows, max(1, rows.size * int(n) // 400_000)):
                own = data[at[some][:, None] + np.arange(n)]
                parts = np.concatenate([self.inner[own[:, :-1]], self.last[own[:, -1:]]], axis=1)
                row, ids, count = self._merge_rows(parts)
                out.add(ids, count)
                order.append(some[row])
        placed = np.empty(len(words), dtype=np.int64)
        placed[np.concatenate(order) if order else np.zeros(0, dtype=np.int64)] = np.arange(len(words))
        out.start[: len(words)], out.length[: len(words)] = out.start[placed], out.length[placed]
        return out

    def _cut(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word; ``first``: where texts begin."""
        kind = self.kinds[points]
        begins = np.ones(points.size, dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == _NUMBER
        begins[first[first < points.size]] = True
        mark = np.flatnonzero(points == 0x27)
        mark = mark[begins[mark]]
        padded = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
        for ending in _ENDINGS if mark.size else []:
            n = len(ending)
            hit = mark[np.all([padded[mark + 1 + k] == ord(c) for k, c in enumerate(ending)], axis=0)]
            fresh = np.isin(hit + 1, first)  # the letters belong to the next text
            for k in range(1, n):
                fresh |= np.isin(hit + 1 + k, first)
            hit = hit[~fresh]
            begins[hit + 1] = False
            after = hit + 1 + n
            after = after[after < points.size]
            begins[after] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], points.size)
        words = kind[start] != _SPACE
        return start[words], end[words]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (plus the end)."""
        if self.marks and (marked := [k for k, t in enumerate(texts) if "<|" in t and self.marks.search(t)]):
            return self._encode_marked(texts, marked)
        clean = [(t if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ")).lower() for t in texts]
        whole, points, bounds = self._joined(clean)
        odd = np.flatnonzero(self.kinds[points] == _UNSETTLED)
        spans = {}
        if odd.size:
            for k in np.unique(np.searchsorted(bounds, odd, side="right") - 1).tolist():
                clean[k], spans[k] = self._by_library(texts[k])
            whole, points, bounds = self._joined(clean)
        start, end = self._cut(points, bounds[:-1])
        for k, own in spans.items():
            a, b = np.searchsorted(start, bounds[k : k + 2])
            start, end = (np.concatenate([x[:a], own[:, side] + bounds[k], x[b:]]) for side, x in enumerate((start, end)))
        hashes = self._hash(points, start, end)
        if self.rows.rows > REMEMBERED or self.rows.size > 24 * REMEMBERED:
            self._forget(KEPT if self.rows.rows > REMEMBERED else 0)
        distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, self.hashes.size - 1))
        known = self.hashes[at] == distinct if self.hashes.size else np.zeros(distinct.size, dtype=bool)
        row = np.empty(distinct.size, dtype=np.int64)
        row[known] = self.row_of[at[known]]
        new = np.flatnonzero(~known)
        if new.size:
            s, e = start[where[new]], end[where[new]]
            by_place = np.argsort(s)  # the earliest words get the lowest rows
            new, s, e = new[by_place], s[by_place], e[by_place]
            flat = self._encode_words([whole[a:b] for a, b in zip(s.tolist(), e.tolist())])
            row[new] = self.rows.rows + np.arange(new.size)
            self.rows.add(*flat.take(np.arange(new.size)))
            keep = e - s <= LONG_WORD
            hashes_now = np.concatenate([self.hashes, distinct[new[keep]]])
            order = np.argsort(hashes_now, kind="stable")
            self.hashes, self.row_of = hashes_now[order], np.concatenate([self.row_of, row[new[keep]]])[order]
        ids, lengths = self.rows.take(row[which])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.searchsorted(start, bounds)]

    @staticmethod
    def _joined(clean: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """All texts in one, its code points and where each text begins (plus the end)."""
        sizes = np.fromiter(map(len, clean), dtype=np.int64, count=len(clean))
        whole = "".join(clean)
        return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.concatenate([[0], np.cumsum(sizes)])

    def _by_library(self, text: str) -> tuple[str, np.ndarray]:
        """A text as the library normalises it, and start and end of its words."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        clean = self._library.normalizer.normalize_str(text)
        return clean, np.array([at for _, at in self._library.pre_tokenizer.pre_tokenize_str(clean)], dtype=np.int64).reshape(-1, 2)

    @staticmethod
    def _hash(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = powers(points.size)
        sums = np.zeros(points.size + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(0x51ED270B)) * np.uint64(0xD6E8FEB86659FD93) * up, out=sums[1:])
        return mix64((sums[end] - sums[start]) * down[start] ^ (end - start).astype(np.uint64))

    def _encode_marked(self, texts: list[str], marked: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """With special tokens in some texts: what stands between them is encoded on its own."""
        pieces: list[str | int] = []
        counts = np.ones(len(texts), dtype=np.int64)
        special = set(marked)
        for k, t in enumerate(texts):
            if k not in special:
                pieces.append(t)
                continue
            own, at = [], 0
            for m in self.marks.finditer(t):
                own += [t[at : m.start()], self.special[m[0]]]
                at = m.end()
            own.append(t[at:])
            counts[k] = len(own)
            pieces += own
        plain = [p for p in pieces if isinstance(p, str)]
        marks, self.marks = self.marks, None
        try:
            ids, at = self.encode_batch(plain)
        finally:
            self.marks = marks
        parts, sizes, k = [], [], 0
        for p in pieces:
            if isinstance(p, str):
                parts.append(ids[at[k] : at[k + 1]])
                k += 1
            else:
                parts.append(np.array([p], dtype=np.int32))
            sizes.append(parts[-1].size)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return np.concatenate(parts).astype(np.int32), ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """As the library does for a file without decoder: the tokens, specials too, joined by one space."""
        tokens = list(map(self.token.__getitem__, ids.tolist()))
        return [" ".join(tokens[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """Loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
        release()  # what parsing the file took
    return _LOADED[path]


def text_batches(texts: pa.Array, most_bytes: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of bounded size of a string column; nulls become empty texts."""
    yield from blocks(texts.fill_null("").cast(pa.large_string()) if texts.null_count or not pa.types.is_large_string(texts.type) else texts, most_bytes)


def bpe_encode(text: Column, path: str) -> Column:
    """The ids of each text as array<int>; null: none."""

    @F.arrow_udf("array<int>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path)
        for column in columns:
            out = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)) for part in text_batches(column) for ids, at in [bpe.encode_batch(part.to_pylist())]]
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return encode(text)


def bpe_count(text: Column, path: str) -> Column:
    """How many ids each text has; null: 0."""

    @F.arrow_udf("long")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path)
        for column in columns:
            out = [pa.array(np.diff(bpe.encode_batch(part.to_pylist())[1]), pa.int64()) for part in text_batches(column)]
            yield pa.concat_arrays(out) if out else pa.array([], pa.int64())

    return count(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """The text that each array of ids stands for; null: ''. An id outside the vocabulary raises IndexError."""

    @F.arrow_udf("string")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path)
        for column in columns:
            column = column.fill_null([]) if column.null_count else column
            at = column.offsets.to_numpy().astype(np.int64)
            yield pa.array(bpe.decode_batch(column.flatten().to_numpy(zero_copy_only=False), at - at[0]), pa.string())

    return decode(ids)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): each text encoded and decoded again in one pass; ids are decimal, joined by
    one space, since a long array costs the JVM far more than a string. Other columns of ``docs`` are not carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        decimal = list(map(str, range(len(bpe.token))))
        for batch in batches:
            done = 0
            for part in text_batches(batch.column(1)):
                ids, at = bpe.encode_batch(part.to_pylist())
                words = list(map(decimal.__getitem__, ids.tolist()))
                joined = [" ".join(words[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(np.diff(at)), pa.array(joined, pa.string()), pa.array(bpe.decode_batch(ids, at), pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
                done += len(part)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
