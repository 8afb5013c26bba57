"""The Merkle manifest against a plain tree on the driver."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fernglas.llm import manifest, queries, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, at string, path int, root int"


def h(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fanout=3):
    """The root and each node's path as (before, after)."""
    paths, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(k, min(k + fanout, len(nodes))) for k in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                step = ("".join(nodes[x] for x in run if x < k), "".join(nodes[x] for x in run if x > k))
                for m in groups[k]:
                    paths[m].append(step)
        groups = [[m for k in run for m in groups[k]] for run in runs]
        nodes = [h("".join(nodes[k] for k in run)) for run in runs]
    return nodes[0], paths


def plain(rows):
    """The result of op13 as a multiset."""
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode("utf-8", "surrogatepass")))
    made, tops = [], []
    for s in order:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r["doc_id"], r["text"], r["lang"], s, r["n_chars"]), r) for r in sources[s]), key=lambda x: x[:3])
        root, paths = tree([x[2] for x in own])
        tops.append(root)
        made.append((own, root, paths))
    root, paths = tree(tops) if tops else (None, [])
    out = Counter()
    for (own, subroot, inner), outer in zip(made, paths):
        for (_, _, digest, r), path in zip(own, inner):
            path, text, folded = path + outer, r["text"], digest
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                folded = leaf(r["doc_id"], None if text is None else text.replace("\n", ""), r["lang"], r["source"], r["n_chars"])
            for before, after in path:
                folded = h(before + folded + after)
            out[r["doc_id"], digest, subroot, root, h("".join(a + b for a, b in path)), folded, folded == root] += 1
    return out


def found(spark, monkeypatch, rows):
    monkeypatch.setattr(queries, "table", lambda *_: rows)
    out = queries.op13_manifest(spark, "")
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in out.collect())


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


def test_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(spark, monkeypatch, docs) == plain(docs.collect())


def test_odd_rows(spark, monkeypatch):
    rnd = random.Random(13)
    rows = [(None, None, None, None, None), (None, "a\nb", "en", None, 3), (5, "", "", "", 0), (5, None, "en", "", None), (7, "x\n" * 200_000, "de", "é", 400_000), (7, "😀\n", "de", "z", 2)]
    rows += [(k // 2, f"{k}\n\r\n", "en", "hot", k) for k in range(60)] + [(9, "same\n", "en", "hot", 5)] * 5  # ties and repeated rows
    rows += [(-k, "t" * k, None, "src" + str(k % 4), k) for k in range(20)]
    rnd.shuffle(rows)
    table = rows_of(spark, rows)
    assert found(spark, monkeypatch, table) == plain(table.collect())


@pytest.mark.parametrize("rows", [[], [(1, "a\n", "en", "s", 2)], [(1, "a", "en", None, 1), (2, "b", "en", "", 1)], [(k, str(k), "en", "s", 1) for k in range(4)]])
def test_small_trees(spark, monkeypatch, rows):
    table = rows_of(spark, rows)
    assert found(spark, monkeypatch, table) == plain(table.collect())


def test_numbered_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(shared, "RANGE_BYTES", 1)
    rows = [("hot" if k % 3 else f"s{k % 7}", (k * 37) % 100, k) for k in range(500)]
    table = spark.createDataFrame(rows, "g string, v long, k long")
    got = {r["k"]: (r["at"], r["n"]) for r in shared.numbered(shared.materialise(table, "t"), ["g"], ["v", "k"]).collect()}
    groups = defaultdict(list)
    for g, v, k in rows:
        groups[g].append((v, k))
    assert got == {k: (at, len(own)) for own in groups.values() for at, (_, k) in enumerate(sorted(own))}
    assert shared.numbered(shared.materialise(table.limit(0), "t"), ["g"], ["v"]).count() == 0


def test_a_changed_sibling_is_found(spark):
    docs = spark.createDataFrame([(k, str(k), "en", "s", 1) for k in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 4, "other").otherwise(F.col("text")))
    roots = [m.select(F.hex("root")).distinct().collect() for m in (manifest.manifest(docs), manifest.manifest(changed))]
    assert len(roots[0]) == 1 and roots[0] != roots[1]
