"""BPE, sharding, packing, search, archives, fingerprints and personal data against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernglas.llm import ann, bpe, fingerprint, packing, pii, queries, sharding, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pii int, ids string, shard string"
ODD = [
    "", None, " ", "one", "two words", "a b c d e f g", "a b c d e f g", "ÀÉ naïve İ ΣΑΣ ½ ٤ <|endoftext|>x", "don't 'sx we'LL '' 's's", "x" * 3000 + " " + "7" * 3000,
    "mail a.b@c.de, a@b.c_d@e.f @@ a@b 1.2.3.4.5.6.7.8 256.1.1.1 007.0.00255.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 +49 (30) 1234-5678. +1 2",
    "IBAN DE89 3704 0044 0532 0130 00 ssn 078-05-1120, 078-05-1121 call 555-123-4567", "\x1ca\x1db　c​d\ne\rf\tg\x0bh", "😀 👍🏽 日本語 é é", "a@b.co" * 50, "1 " * 400,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, None, None, None, 1, "x", "y") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, 1, None, None), rows[5], rows[5]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_bpe_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, docs, odd, empty, library):
    path = queries.word_bpe_path()
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        want = Counter()
        for r in rows:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want[r["doc_id"], len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)] += 1
        got = Counter(tuple(r) for r in bpe.bpe_round_trip(table, path).collect())
        assert got == want
    back = odd.withColumn("ids", bpe.bpe_encode(F.col("text"), path)).withColumn("again", bpe.bpe_decode(F.col("ids"), path)).collect()
    for r in back:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["again"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_round_trip(empty, path).count() == 0


def test_bpe_random_texts(library):
    own, rng = bpe.WordBpe(queries.word_bpe_path()), random.Random(5)
    pool = "aAbBéÑßΣσς12½_-.,'\"<|>|\n\t\x1c\x85　日😀́'sS'tT'llreve  "
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["<|startoftext|>a<|endoftext|>"]
    ids, at = own.encode_batch(texts)
    for k, r in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == r.ids, texts[k]


def test_bpe_every_code_point(library):
    """Each code point between letters, and those that Python knows between marks; then random texts of all of them."""
    own, rng = bpe.WordBpe(queries.word_bpe_path()), random.Random(8)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    known = [c for c in every if own.kinds[c] != bpe._UNSETTLED]
    texts = [f"a{chr(c)}b" for c in every] + [f"É{chr(c)}\u0323\u0301 Σ{chr(c)}'s" for c in known]
    for pool in (every, known, [c for c in every if c < 0x3100]):
        texts += ["".join(chr(rng.choice(pool)) for _ in range(rng.randint(1, 40))) for _ in range(6000)]
    for k in range(0, len(texts), 10_000):
        part = texts[k : k + 10_000]
        ids, at = own.encode_batch(part)
        wrong = [t for t, r, a, b in zip(part, library.encode_batch(part, add_special_tokens=False), at, at[1:]) if ids[a:b].tolist() != r.ids]
        assert not wrong, list(map(ascii, wrong[:5]))


def test_bpe_forgets_without_changing_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "KEPT", 7)
    own = bpe.WordBpe(queries.word_bpe_path())
    for k in range(30):
        text = " ".join(f"w{chr(97 + (k * j) % 26)}ord{chr(97 + j)}" for j in range(12))
        assert own.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bytes_shards(spark, docs, odd, empty):
    for table in (docs, odd):
        rows = [r.asDict() for r in sharding.shard_by_bytes(table).collect()]
        texts = Counter((r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter({(i, len(t.encode()) + 1, zlib.crc32(t.encode())): n for (i, t), n in texts.items()})
        slots, sizes, of = defaultdict(list), Counter(), defaultdict(set)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            sizes[r["shard"]] += r["size"]
            of[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
        assert all(len(s) == 1 for s in of.values())
    total = sum(sizes.values())
    sizes = Counter()
    for r in sharding.shard_by_bytes(docs).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values()) / 16 and total
    assert sharding.shard_by_bytes(empty).count() == 0


def test_shards_from_bounded_runs(spark, monkeypatch):
    """Many runs of few groups a task balance as well, and equal texts stay together."""
    monkeypatch.setattr(sharding, "GROUPS", 50)
    table = spark.createDataFrame([(k, "x" * (k * 7919 % 997)) for k in range(4000)], "doc_id long, text string")
    sizes, of = Counter(), defaultdict(set)
    for r in sharding.shard_by_bytes(table, 16).collect():
        sizes[r["shard"]] += r["size"]
        of[r["text_crc32"], r["size"]].add(r["shard"])
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values()) / 16
    assert all(len(x) == 1 for x in of.values()) and sum(sizes.values()) == sum(k * 7919 % 997 + 1 for k in range(4000))


def _plain_differencing(sizes, k):
    """Karmarkar-Karp on sets of items, without numpy."""
    parts = [([s] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(p[0]) - min(p[0]))
        (a, x), (b, y) = parts.pop(), parts.pop()
        up, down = sorted(range(k), key=a.__getitem__), sorted(range(k), key=b.__getitem__, reverse=True)
        parts.append(([a[i] + b[j] for i, j in zip(up, down)], [x[i] + y[j] for i, j in zip(up, down)]))
    return parts[0][0]


def test_differencing_equals_plain(spark):
    rng = np.random.default_rng(6)
    for k in (2, 3, 5):
        sizes = rng.choice(1_000_000, 60, replace=False) + 1  # sizes without ties, whose order is free
        sums = np.zeros((60, k), dtype=np.int64)
        sums[:, 0] = sizes
        part = sharding.difference(sums)[:, 0]
        assert sorted(np.bincount(part, weights=sizes, minlength=k).astype(int)) == sorted(_plain_differencing(sizes.tolist(), k))


def test_differencing_is_tight():
    rng = np.random.default_rng(1)
    sums = np.zeros((500, 4), dtype=np.int64)
    sums[:, 0] = rng.integers(1, 10_000, 500)
    part = sharding.difference(sums)
    totals = np.bincount(part[:, 0], weights=sums[:, 0], minlength=4)
    assert totals.max() - totals.min() <= 100 and (np.sort(part, 1) == np.arange(4)).all()


def test_packing(docs, odd, empty, library):
    for table in (docs, odd):
        pieces = packing.pack_documents(table, queries.word_bpe_path()).collect()
        ids = {}
        for r in table.select("doc_id", "text").collect():
            ids.setdefault(r["doc_id"], []).append([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1])
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for p in pieces:
            assert len(p["tokens"]) == 4 * p["length"] and p["length"] > 0
            by_doc[p["doc_id"]].append(p)
            by_sequence[p["sequence_id"]].append(p)
        assert set(by_doc) == set(ids)
        for doc, own in by_doc.items():
            if len(ids[doc]) > 1:
                assert sum(p["length"] for p in own) == sum(map(len, ids[doc]))
                continue
            whole, at = ids[doc][0], 0
            for p in sorted(own, key=lambda p: p["start"]):
                assert p["start"] == at and np.frombuffer(p["tokens"], "<u4").tolist() == whole[at : at + p["length"]] and p["doc_tokens"] == len(whole)
                at += p["length"]
            assert at == len(whole)
        padding = tokens = 0
        for own in by_sequence.values():
            at = 0
            for p in sorted(own, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= 2048
            tokens += at
            padding += 2048 - at if at & (at - 1) else 0
        assert padding <= 0.01 * tokens
    assert packing.pack_documents(empty, queries.word_bpe_path()).count() == 0


def test_packing_short_texts(spark):
    table = spark.createDataFrame([(k, "red cat") for k in range(20_000)], "doc_id long, text string").repartition(2)
    used = Counter()
    for p in packing.pack_documents(table, queries.word_bpe_path()).collect():
        used[p["sequence_id"]] += p["length"]
    assert sum(used.values()) == 60_000 and max(used.values()) <= 2048
    assert sum(2048 - n for n in used.values() if n & (n - 1)) <= 600


def _plain_fill(items, limits):
    """One sequence by the heuristic itself, an item at a time: sizes of what goes in, in order."""
    room, out, left = list(limits), [], list(items)
    while fitting := [i for i in left if all(x <= r for x, r in zip((i[0], 1, i[1]), room))]:
        best = max(fitting, key=lambda i: sum(x / n * (r / n) for x, r, n in zip((i[0], 1, i[1]), room, limits)))
        left.remove(best)
        out.append(best)
        room = [r - x for r, x in zip(room, (best[0], 1, best[1]))]
    return out


def test_packer_follows_the_heuristic():
    rng = random.Random(12)
    for limits, longest in (((2048, 16, 1024), 700), ((512, 64, 200), 30), ((100, 7, 100), 9)):
        sizes = [(t, rng.randint(0, t)) for t in (rng.randint(1, longest) for _ in range(300))]
        packer = packing.Packer(*limits, cut=False)
        packer.add(sizes, [(k,) for k in range(300)])
        waiting = dict(enumerate(sizes))
        while packer.waiting:
            got = [waiting.pop(k) for (k,) in packer.fill(None)]
            assert got == _plain_fill([*got, *waiting.values()], limits)
    assert not waiting


def test_packing_conversations(spark, library):
    out = queries.pack_conversations(spark, SF).collect()
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want[str(r["conv_id"])][0] += n
        want[str(r["conv_id"])][1] += n * (r["role"] == "assistant")
    assert {r["conv_id"]: [r["tokens"], r["loss"]] for r in out} == want and len(out) == len(want)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append(r)
    for own in by.values():
        assert len(own) == 1 or (sum(r["tokens"] for r in own) <= 2048 and sum(r["loss"] for r in own) <= 1024 and len(own) <= 16)
        at = 0
        for r in sorted(own, key=lambda r: (r["offset"], r["tokens"])):
            assert r["offset"] == at
            at += r["tokens"]


def test_packing_whole_examples(spark):
    rng = random.Random(3)
    rows = [(f"c{k}", rng.randint(0, 700), rng.randint(0, 300)) for k in range(3000)] + [("long", 5000, 1), ("loss", 10, 2000), (None, None, None)]
    out = packing.pack_items(spark.createDataFrame(rows, "id string, tokens long, loss long").repartition(2), "id", "tokens", "loss").collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append(r)
    for own in by.values():
        if len(own) > 1:
            assert sum(r["tokens"] for r in own) <= 2048 and sum(r["loss"] for r in own) <= 1024 and len(own) <= 64
    assert len(by) < 1.15 * max(sum(r[1] or 0 for r in rows) / 2048, sum(r[2] or 0 for r in rows) / 1024)


def _nearest(ids, x, query, k=20):
    score = x @ x[ids.index(query)]
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-score[i], ids[i]))[:k]
    return [(ids[i], score[i]) for i in order]


def test_search_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = defaultdict(list)
    for r in queries.op5_ann(spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, own in got.items():
        want = _nearest(ids, x, q)
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(abs(s - x[ids.index(v)] @ x[ids.index(q)]) < 1e-12 for _, v, s in own)
        hits += len({v for v, _ in want} & {v for _, v, _ in own})
    assert hits >= 0.99 * 20 * len(got)


def test_search_quantised_scan_recall(spark):
    """Recall with a short candidate list, where the codes matter."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32)) * rng.gamma(2, 1, size=(4000, 1))
    table = spark.createDataFrame([(k, v.tolist(), "a") for k, v in enumerate(x)], "vec_id long, embedding array<double>, vector string").repartition(1)
    index = ann.build_index(table)
    got = defaultdict(set)
    for r in ann.search(index, index.rows.where("vec_id % 50 = 0").select("vec_id", "vector"), 20, refine=80).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len({v for v, _ in _nearest(list(range(4000)), x, q)} & own) for q, own in got.items())
    assert hits >= 0.9 * 20 * 80


def test_search_in_blocks(spark, monkeypatch):
    """Queries in several blocks and scans of few rows give what one block gives."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = ann.build_index(table)
    asked = index.rows.where("vec_id % 10 = 0").select("vec_id", "vector")
    want = sorted(map(tuple, ann.search(index, asked, 5, refine=1000).collect()))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "SCAN_ROWS", 13)
    assert sorted(map(tuple, ann.search(index, asked, 5, refine=1000).collect())) == want


def test_search_odd_vectors(spark):
    hot = [1.0, 2.0]
    rows = [(0, hot), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [float("inf"), 1.0]), (None, hot), (20, [3.0, 2.0]), (40, [1.0])] + [(k, hot) for k in range(100, 400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build_index(table)
    out = ann.search(index, index.rows.where("vec_id % 20 = 0").select("vec_id", "vector"), 20).collect()
    mine = sorted((r["rank"], r["vec_id"]) for r in out if r["query_id"] == 100)
    assert [v for _, v in mine] == [20, 0, *range(101, 119)]
    few = ann.build_index(table.where("vec_id in (0, 20)"))
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(few, few.rows.select("vec_id", "vector"), 20).orderBy("query_id").collect()] == [(0, 20), (20, 0)]
    none = ann.build_index(table.where("vec_id = 1"))
    assert ann.search(none, none.rows.select("vec_id", "vector"), 20).count() == 0


def test_archives_round_trip(spark):
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(["<p>a</p>", "<p>a</p>", "", None, "é\r\n\r\nx", "b" * 300_000, "<p>a</p>"])] + [(9, None, "c"), (10, "http://x/\r\nWARC-Type: fake ü", "d"), (None, "u", "<p>a</p>")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, first string")
    for least in (0, 1000):
        back = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(table, least_bytes=least)).collect()}
        assert len(back) == len(rows)
        for page_id, _, html in rows:
            data, r = (html or "").encode(), back[page_id]
            same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
            first = max(same) if len(data) >= least else page_id
            assert r["record_type"] == ("response" if first == page_id else "revisit") and r["refers_to"] == (None if first == page_id else first)
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == warc.digest(data)
            assert r["payload"] == (data if first == page_id else None)
    assert warc.read_archives(warc.write_archives(table.limit(0))).count() == 0


@pytest.mark.parametrize("most", [warc.BROADCAST_BYTES, 0])
def test_archives_of_repeated_pages(spark, monkeypatch, most):
    """A third of all rows is one page, and many pages repeat: few digests are broadcast, or only the hot ones."""
    monkeypatch.setattr(warc, "BROADCAST_BYTES", most)
    monkeypatch.setattr(warc, "HOT", 8)
    rows = [(k, f"http://h/{k}", "<p>hot</p>" if k % 3 == 0 else f"<p>{k % 101}</p>") for k in range(900)]
    records = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string")), with_payload=False)
    last = {h: i for i, _, h in rows}
    assert {(r["page_id"], r["refers_to"]) for r in records.collect()} == {(i, None if last[h] == i else last[h]) for i, _, h in rows}
    assert warc.broken_revisits(records).count() == 0
    broken = records.withColumn("payload_digest", F.when(F.col("page_id") == last["<p>hot</p>"], "X").otherwise(F.col("payload_digest")))
    assert [(r["refers_to"], r["revisits"]) for r in warc.broken_revisits(broken).collect()] == [(last["<p>hot</p>"], 299)]


def test_archive_reader_finds_damage(tmp_path):
    good = warc.record(1, "u", b"payload") + warc.record(2, "u", b"")
    path = tmp_path / "a"
    path.write_bytes(good)
    with path.open("rb") as f:
        assert [warc.parse(m)["page_id"] for m in warc.members(f)] == [1, 2]
    path.write_bytes(good[:-5])
    with path.open("rb") as f, pytest.raises((ValueError, zlib.error)):
        list(warc.members(f))
    member = zlib.decompress(warc.record(1, "u", b"payload"), 31)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(member.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parse(member + b"x")


def _shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def test_fingerprints(docs, odd, empty):
    for table, buckets in ((docs, 8), (docs, 1), (odd, 8)):
        rows = [(r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect()]
        rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        got = defaultdict(list)
        for r in fingerprint.compare_with_edited(table, buckets=buckets).collect():
            got[r["doc_id"]].append(r)
        assert sum(map(len, got.values())) == len(rows)
        errors, of_text = [], defaultdict(set)
        for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
            cut = len(text) // 3
            edited = text[: len(text) - cut] + after[:cut]
            want = hashlib.sha256(edited.encode()).hexdigest()
            r = next(r for r in got[doc] if r["edited_sha256"] == want and r["n_chars"] == len(text))
            of_text[text].add(r["fingerprint"])
            for estimate, a, b in ((r["near_edited"], text, edited), (r["near_next"], text, after)):
                a, b = _shingle_set(a, 5), _shingle_set(b, 5)
                errors.append(estimate - (len(a & b) / len(a | b) if a | b else 1.0))
        assert all(len(f) == 1 for f in of_text.values())
        assert np.abs(errors).mean() < 0.05 and np.abs(errors).max() < 0.3, np.abs(errors).max()
    assert fingerprint.compare_with_edited(empty).count() == 0
    prints = {r["text"]: r["f"] for r in odd.select("text", fingerprint.fingerprint(F.col("text")).alias("f")).collect()}
    assert prints[""] == prints[" "] == "" and len(prints["one"]) == fingerprint.BINS * fingerprint.BITS // 4


def _luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return [(name, a, b) for a, _, b, name in sorted(found)]


def test_personal_data(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(2)
    fuzz = ["".join(rng.choice("aB1234567890.-+@ ()é_%\n") for _ in range(rng.randint(5, 120))) for _ in range(3000)]
    fuzz = spark.createDataFrame([(k, t) for k, t in enumerate(fuzz)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    found = Counter()
    for table in (docs, fuzz):
        out = pii.find_pii(table)
        base = out.select("doc_id", "text", pii.as_text(F.filter("pii", lambda s: s["base"])).alias("base"), pii.as_text(F.col("pii")).alias("spans"), pii.redact(F.coalesce("text", F.lit("")), F.col("pii")).alias("clean"))
        for r in base.collect():
            want = base_spans(r["text"] or "")
            assert r["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want), r["text"]
            found.update(k for k, _, _ in want)
            assert {*r["base"].split(",")} - {""} <= {*r["spans"].split(",")}
            if "<" not in (r["text"] or "") and "IBAN" not in (r["text"] or ""):
                assert not [x for x in base_spans(r["clean"]) if x[0] in ("email", "card")] or r["spans"]
    assert min(found[k] for k in ("email", "ip", "card", "phone")) > 3
    special = {r["doc_id"]: r["s"] for r in pii.find_pii(odd).select("doc_id", pii.as_text(F.col("pii")).alias("s")).collect()}
    assert "iban:5:32" in special[12] and "ssn:37:48" in special[12] and "local_phone:67:79" in special[12]
    assert pii.find_pii(empty).count() == 0
