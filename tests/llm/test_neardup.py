"""Near duplicates against all pairs."""

import random
import re

import pytest

from fernglas.llm import neardup, shared


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset({tuple(words)} if words else ())


def brute_force(rows, n, percent=80):
    """doc_id -> (size, component) over all pairs of different sets."""
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    by_set, inverted = {}, {}
    for i, s in sets:
        if s:
            by_set.setdefault(s, []).append(i)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    kinds = list(by_set)
    for ids in by_set.values():
        for i in ids:
            join(ids[0], i)
    for k, s in enumerate(kinds):
        seen = {}
        for x in s:
            for other in inverted.setdefault(x, []):
                seen[other] = seen.get(other, 0) + 1
            inverted[x].append(k)
        for other, common in seen.items():
            if 100 * common >= percent * (len(s) + len(kinds[other]) - common):
                join(by_set[s][0], by_set[kinds[other]][0])
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_test_documents(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], words)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, words).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert sum(not r["kept"] for r in got.values()) > 20


@pytest.mark.parametrize("block", [1_500_000, 6_000])
def test_large_group_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(300):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        rows.append((k, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: c for i, (_, c) in brute_force(rows, 2).items()}
    assert len(set(got.values())) > 1


@pytest.mark.parametrize("block", [3_000, 20_000])
def test_groups_of_several_components_over_blocks(spark, monkeypatch, block):
    """Chains of edits, so that the ends of a group are far apart, families that share bands without a link, and texts
    that only one member of another block is linked with."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    rng = random.Random(31)
    texts = []
    for family in range(4):
        text = [f"w{k}" for k in range(50)] + [f"f{family}x{k}" for k in range(8)]
        for _ in range(60):
            text = list(text)
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(100_000)}"
            texts.append(" ".join(text))
            if rng.random() < 0.3:
                text = [f"w{k}" for k in range(50)] + [f"f{family}x{k}" for k in range(8)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    sent, whole = [], neardup._open_buckets
    monkeypatch.setattr(neardup, "_open_buckets", lambda *a: sent.append(whole(*a)) or sent[-1])
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: c for i, (_, c) in brute_force(rows, 2).items()}
    assert len(set(got.values())) > 20 and sent[0].count() > 50


def test_near_copies_over_blocks_leave_no_open_bucket(spark, monkeypatch):
    """Each text of a group that is one component goes to one block, whatever the number of blocks."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 10_000)
    sent, whole = [], neardup._open_buckets
    monkeypatch.setattr(neardup, "_open_buckets", lambda *a: sent.append(whole(*a)) or sent[-1])
    rows = [(k, " ".join([f"w{j}" for j in range(100)] + [f"own{k}"])) for k in range(400)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["component_id"] for r in got} == {0}
    assert len(sent) == 1 and sent[0].isEmpty()


def test_odd_rows(spark):
    rows = [(5, "A b c"), (3, "a  B\nc"), (9, None), (8, ""), (7, " \t"), (None, "a b c"), (2, "one"), (4, "ONE"), (6, "one two"), (5, "A b c"), (1, "a b c d e f g h i j k"), (10, "a b c d e f g h i j z")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, bands int, component string")
    out = neardup.near_duplicates(table, 2).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert got == {5: (2, 3, False), 3: (2, 3, True), 9: (0, 9, True), 8: (0, 8, True), 7: (0, 7, True), None: (2, None, True), 2: (1, 2, True), 4: (1, 2, False), 6: (1, 6, True), 1: (10, 1, True), 10: (10, 1, False)}
    assert neardup.near_duplicates(table.limit(0)).count() == 0
    assert {r["component_id"] for r in neardup.near_duplicates(table.where("doc_id = 9")).collect()} == {9}


@pytest.mark.parametrize(("hot", "nodes"), [(8, 0), (4096, 0), (4096, 1 << 18)])
def test_components_of_hot_nodes(spark, monkeypatch, hot, nodes):
    """Stars of which one has most edges, chains and pairs, with few rows counting as hot; minima broadcast or not."""
    monkeypatch.setattr(shared, "HOT_KEYS", hot)
    monkeypatch.setattr(shared, "BROADCAST_NODES", nodes)
    edges = [(5, k) for k in range(100, 400)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2001), (2001, 2001), (None, 3), (399, 2001)]
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {k: 5 for k in [5, *range(100, 400), 2000, 2001]} | {k: 1000 for k in range(1000, 1041)}
    assert got == want
    assert shared.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_hot_buckets_and_sets(spark, monkeypatch, most):
    """One set that most rows have, one band bucket of many texts, places broadcast or not, and a text of 5 MB with a near copy."""
    monkeypatch.setattr(shared, "HOT_KEYS", 8)
    monkeypatch.setattr(shared, "BROADCAST_NODES", most)
    monkeypatch.setattr(neardup, "BROADCAST_BYTES", most)
    base = [f"w{j}" for j in range(100)]
    rows = [(k, "the same words again and again") for k in range(200)]
    rows += [(1000 + k, " ".join([*base, f"own{k}"])) for k in range(60)] + [(2000 + k, f"alone {k} of its kind {k * 7}") for k in range(40)]
    long = [f"{k * 2654435761 % 1_000_003}" for k in range(750_000)]
    rows += [(3000, " ".join(long)), (3001, " ".join(long[:-1000]))]
    assert len(rows[-1][1]) > 5_000_000
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 2).collect()}
    assert got == {**{k: 0 for k in range(200)}, **{1000 + k: 1000 for k in range(60)}, **{2000 + k: 2000 + k for k in range(40)}, 3000: 3000, 3001: 3000}


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "a b c d e f"), (3, "a b c d e f"), (3, "other words in here now"), (3, "other words in here now")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), with_hash=True).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out) == [(1, 1, True), (3, 1, False), (3, 3, True), (3, 3, True)]
    assert len({r["text_hash"] for r in out}) == 2
