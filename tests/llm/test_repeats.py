"""Repeated passages against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fernglas.llm import queries, repeats

SCHEMA = "doc_id long, text string, key string, start int, rows int, sha string"


def plain(rows, length):
    """The result as a multiset, by counting all windows."""
    texts = [(text or "").encode("utf-8", "surrogatepass") for _, text in rows]
    windows = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if windows[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(bool(gone[i]) and not (i and gone[i - 1]) for i in range(len(t)))
        out[doc_id, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    out = repeats.repeated_passages(table, **options)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return Counter(tuple(r) for r in out.collect())


def random_texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé ") for _ in range(rnd.randint(1, 9)))
    passages = ["".join(word() for _ in range(rnd.randint(3, 12))) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else word() for _ in range(rnd.randint(0, 8))]
        text = "".join(parts)
        if text and rnd.random() < 0.3:  # a near copy
            at = rnd.randrange(len(text))
            texts.append(text[:at] + rnd.choice("xyz") + text[at + rnd.randint(0, 2) :])
        texts.append(text)
    return texts


ODD = [(None, "no id, no id, no id, no id"), (1, None), (1, None), (2, ""), (3, "x" * 700), (4, "ab" * 300), (5, "abc" * 100 + "abd" * 50), (6, "same row, same id, longer than a window"), (6, "same row, same id, longer than a window"), (7, "\0" * 30 + "\x01\0" * 20), (8, "é" * 50)]


@pytest.mark.parametrize(("length", "gram", "block", "piece"), [(12, 5, 1 << 20, 1 << 18), (12, 12, 1 << 20, 40), (20, 8, 60, 64), (9, 2, 1, 30)])
def test_against_counting(spark, monkeypatch, length, gram, block, piece):
    monkeypatch.setattr(repeats, "BLOCK", block)  # few bytes: each window of crowded anchors is hashed
    monkeypatch.setattr(repeats, "PIECE", piece)
    rows = list(enumerate(random_texts(length + gram), 100)) + ODD
    assert found(spark, rows, length=length, gram=gram) == plain(rows, length)


def test_production_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    passage = " ".join(str(k * 7919) for k in range(90))
    assert len(passage) > 400
    rows += [(10_000 + k, f"{k} before. {passage} after {k}.") for k in range(30)] + [(20_000 + k, passage[: 395 + k]) for k in range(8)]
    rows += [(30_000, "y" * 1_000_000), (30_001, passage * 3), (30_002, "z " * 300_000 + passage)]
    got = found(spark, rows)
    short = [r for r in rows if r[0] not in (30_000, 30_002)]
    want = plain([*short, (30_000, "y" * 2000), (30_002, "z " * 2000 + passage)], 400)
    assert {k for k in got if k[0] not in (30_000, 30_002)} == {k for k in want if k[0] not in (30_000, 30_002)}
    assert {k[:4] for k in got if k[0] >= 30_000 and k[0] != 30_001} == {(30_000, 1_000_000, 1_000_000, 1), (30_002, 600_000 + len(passage), 600_000 + len(passage), 1)}


def test_spans_and_empty(spark):
    assert found(spark, []) == Counter()
    table = spark.createDataFrame([(1, "0123456789abcdefX"), (2, "Y0123456789abcdef"), (3, "clean")], "doc_id long, text string")
    out = {r["doc_id"]: r["removed"] for r in repeats.repeated_passages(table, length=10, gram=4, with_spans=True).collect()}
    assert {k: v and [tuple(x) for x in v] for k, v in out.items()} == {1: [(0, 16)], 2: [(1, 17)], 3: None}


def test_query(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert [tuple(r) for r in queries.op11_repeats(spark, "").collect()] == [(1, 1, 0, 0, hashlib.sha256(b"a").hexdigest())]


def test_index_against_plain_suffixes():
    """Order, runs and matching statistics of small texts."""
    rnd = random.Random(3)
    for _ in range(200):
        parts = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 5))]
        made = repeats.RunIndex(np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts]))
        suffixes = [(p[i:], k, i) for k, p in enumerate(parts) for i in range(len(p) + 1)]
        ordered = sorted(suffixes, key=lambda x: ([b + 1 for b in x[0]] + [0], x[1]))
        symbols = [parts[k][i - 1] if i else None for _, k, i in ordered]
        assert made.runs == sum(i == 0 or s is None or s != symbols[i - 1] for i, s in enumerate(symbols))

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        want = {(k, i): max((common(s, t) for t, l, j in suffixes if (l, j) != (k, i)), default=0) for s, k, i in suffixes}
        got = made.statistics()
        assert [int(x) for x in got] == [want[k, i] for _, k, i in suffixes]
