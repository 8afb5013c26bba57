"""BM25 from blocks against the formula, under changes, and what a search reads."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fernglas.operators import bm25


def plain(docs, queries, k):
    """query -> [(key, score)] by the formula."""
    tokens = {key: [t for t in _split(text) if len(t) > 1] for key, text in docs.items()}
    n, average = len(docs), sum(map(len, tokens.values())) / max(1, len(docs))
    df = Counter(t for own in tokens.values() for t in set(own))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    out = {}
    for q, text in queries.items():
        asked, scores = Counter(t for t in _split(text) if len(t) > 1), {}
        for key, own in tokens.items():
            f = Counter(own)
            scores[key] = sum(times * idf[t] * f[t] * 2.5 / (f[t] + 1.5 * (0.25 + 0.75 * len(own) / average)) for t, times in asked.items() if f[t])
        best = sorted(((round(s, 9), key) for key, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        out[q] = [(key, round(s, 6)) for s, key in best]
    return {q: hits for q, hits in out.items() if hits}


def same(a, b):
    """Equal documents in equal order, scores but for their last digits."""
    assert {q: [key for key, _ in hits] for q, hits in a.items()} == {q: [key for key, _ in hits] for q, hits in b.items()}
    assert all(abs(x - y) < 2e-6 for q in a for (_, x), (_, y) in zip(a[q], b[q]))
    return True


def _split(text):
    return "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()


def found(index, spark, queries, k):
    asked = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    out = {}
    for r in bm25.search_index(index, asked, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["key"], round(r["score"], 6)))
    return out


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = {f"d{k:04d}": " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60))) for k in range(n)}
    queries = {f"q{k}": " ".join(rnd.choices(words, weights if k % 2 else None, k=rnd.choice([1, 3, 80]))) for k in range(24)}
    return docs, queries | {"none": "zzz", "null": None}


def table(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id string, text string")


@pytest.mark.parametrize(("slice_docs", "look", "block", "pushed"), [(1024, 8, 512, 2000), (40, 2, 7, 5)])
def test_against_the_formula(spark, monkeypatch, slice_docs, look, block, pushed):
    for name, value in (("SLICE", slice_docs), ("LOOK", look), ("QUERIES_BLOCK", block), ("PUSHED", pushed)):
        monkeypatch.setattr(bm25, name, value)
    docs, queries = corpus(400, slice_docs)
    docs |= {f"x{k}": docs["d0007"] for k in range(30)} | {"empty": "", "null": None}  # ties over slices
    index = bm25.build_index(table(spark, docs), "id", F.col("text"))
    assert index.slices == -(-len(docs) // slice_docs)
    for k in (1, 10, 1000):
        assert same(found(index, spark, queries, k), plain(docs, queries, k))
    assert found(index, spark, queries, 0) == {}


def test_pruning_leaves_documents_out(monkeypatch):
    """The same k best as without, and fewer documents scored to the end."""
    import numpy as np

    rng = np.random.default_rng(6)
    own = [(12.0, 4.0, np.array([3, 50, 700]), np.array([3.0, 2.9, 2.8]))]
    own += [(0.2, 0.1, np.sort(rng.choice(1000, 600, replace=False)), rng.random(600) * 2) for _ in range(30)]
    monkeypatch.setattr(bm25, "LOOK", 1)
    few, score = bm25._best_of_slice(own, 1000, 3)
    monkeypatch.setattr(bm25, "LOOK", 10_000)
    every, whole = bm25._best_of_slice(own, 1000, 3)
    assert few.size < 100 and every.size == 1000 and np.allclose(whole[few], score)
    assert set(np.argsort(-whole)[:3].tolist()) <= set(few.tolist())


def test_changes_equal_a_rebuild(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SLICE", 30)
    docs, queries = corpus(120, 9)
    index, rnd = bm25.build_index(table(spark, docs), "id", F.col("text")), random.Random(10)
    for step in range(3):
        gone = rnd.sample(sorted(docs), 20) + ["unknown"]
        new = {f"n{step}{k}": f"w{k} w1 w2 fresh{step}" for k in range(10)} | {key: "w5 changed text" for key in rnd.sample(sorted(set(docs) - set(gone)), 5)}
        index = bm25.changed_index(index, "id", F.col("text"), table(spark, new), spark.createDataFrame([(g,) for g in gone], "id string"))
        docs = {key: text for key, text in docs.items() if key not in gone} | new
    again = bm25.build_index(table(spark, docs), "id", F.col("text"))
    rounded = lambda i: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in i.terms.collect())
    assert rounded(index) == rounded(again)
    assert sorted(map(tuple, index.lengths.collect())) == sorted(map(tuple, again.lengths.collect()))
    assert sorted(map(tuple, index.postings.select("key", "term", "f").collect())) == sorted(map(tuple, again.postings.select("key", "term", "f").collect()))
    assert same(found(index, spark, queries, 10), found(again, spark, queries, 10)) and same(found(again, spark, queries, 10), plain(docs, queries, 10))
    less = bm25.changed_index(index, "id", F.col("text"), removed=spark.createDataFrame([("n00",)], "id string"))
    assert less.lengths.count() == len(docs) - 1


def test_few_terms_read_few_blocks(spark):
    """Blocks lie by term: a search of a rare word reads one file's row group."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    index = bm25.build_index(docs, "doc_id", F.col("text"))
    rare = index.terms.where("df = 3").orderBy("term").first()["term"]

    def read(df):
        df.collect()
        todo, out = [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                node = node.executedPlan()
            if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
                out += node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return out

    total = index.blocks.count()
    assert read(index.blocks.where(F.col("term").isin([rare]))) < 0.35 * total
    assert found(index, spark, {"q": rare}, 10)["q"]


def test_no_documents(spark):
    index = bm25.build_index(table(spark, {"a": "x"}).limit(0), "id", F.col("text"))
    assert found(index, spark, {"q": "word"}, 5) == {}


def test_an_index_shuffles_each_posting_once(spark, monkeypatch):
    """Counting a document's terms takes no shuffle, blocks one; a search of many terms doesn't shuffle the blocks of all."""
    monkeypatch.setattr(bm25, "PUSHED", 1)
    docs, queries = corpus(60, 3)
    plans, keep = {}, bm25.materialise

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    index = bm25.build_index(table(spark, docs), "id", F.col("text"), lambda name, make: kept(make(), name))
    assert index.terms.count() and set(plans) == {"postings", "terms"}  # a vocabulary makes no blocks
    assert index.blocks.count()
    assert "Exchange" not in plans["postings"] and plans["blocks"].count("Exchange ") == 1, plans["blocks"]
    asked = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    found = bm25.search_index(index, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found
