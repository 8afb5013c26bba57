"""Exact medians by ranges, vectors in 16 bits, requests in flight."""

import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from fernglas.functions import vector
from fernglas.operators import evaluate, search, store
from fernglas.plans import views
from fernglas.sources import readers

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("kind", ["spread", "ties", "one value", "far"])
def test_median_by_ranges(spark, monkeypatch, kind):
    monkeypatch.setattr(evaluate, "RANGES", 7)
    monkeypatch.setattr(evaluate, "FEW", 20)
    rnd = random.Random(kind)
    make = {"spread": rnd.random, "ties": lambda: float(rnd.choice([1, 1, 1, 2, 3])), "one value": lambda: 4.0, "far": lambda: rnd.choice([-1e300, 0.0, 1e-300, 1e300])}[kind]
    for n in (1, 2, 999, 1000):
        values = [make() for _ in range(n)]
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(4)
        assert evaluate.median(rows, "x") == statistics.median(values)
    assert evaluate.ranked_values(rows, "x", [0, 500, 999, 1000]) == [*(sorted(values)[k] for k in (0, 500, 999)), None]
    assert evaluate.median(rows.limit(0), "x") is None


def test_latency_of_nothing(spark):
    assert tuple(evaluate.latency(spark.createDataFrame([], "encode_ms double, search_ms double")).first()) == (None, None, None)


def test_half_precision_storage(spark, tmp_path):
    corpus = views.corpus(spark, SF)
    halves = corpus.select("photo_id", "vec_id", "label", vector.pack_half(F.col("embedding")).alias("embedding"))
    for rows, name in ((corpus.select("photo_id", "embedding"), "full"), (halves.select("photo_id", "embedding"), "half")):
        rows.coalesce(1).write.option("compression", "none").parquet(str(tmp_path / name))
    size = {n: sum(f.stat().st_size for f in (tmp_path / n).glob("*.parquet")) for n in ("full", "half")}
    assert size["half"] < 0.6 * size["full"]
    assert halves.agg(F.max(F.octet_length("embedding"))).first()[0] == 2 * 64
    asked = views.query_vectors(spark, SF).select("query_id", "query")
    full, half = ({(r["query_id"], r["rank"]): r["score"] for r in search.search_many(readers.read_corpus(spark, str(tmp_path)) if n == "full" else spark.read.parquet(str(tmp_path / "half")), asked, 10).collect()} for n in ("full", "half"))
    assert full.keys() == half.keys() and 0 < max(abs(full[k] - half[k]) for k in full) < 1e-2
    r = store.check_half_precision(corpus, asked).first()
    assert 0 < r["max_delta"] < 1e-2 and r["probes"] == 10 and r["max_norm_error"] < 1e-2
    assert "full" in readers.read_corpus(spark, str(tmp_path)).inputFiles()[0]
    (tmp_path / "full").rename(tmp_path / "gone")
    assert "half" in readers.read_corpus(spark, str(tmp_path)).inputFiles()[0]
    with pytest.raises(FileNotFoundError, match="full.*half"):
        readers.read_corpus(spark, str(tmp_path / "none"))


def test_odd_halves(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0, None]), ("d", [float("nan"), 1.0]), ("e", [0.5, 0.5]), ("f", [1.0]), ("g", [1e30, 0.0])], "photo_id string, embedding array<float>")
    halves = rows.withColumn("embedding", vector.pack_half(F.col("embedding"))).coalesce(1)
    assert [r["photo_id"] for r in search.hits(halves, [1.0, 0.0], 9).collect()] == ["a", "e"]
    odd = halves.withColumn("embedding", F.when(F.col("photo_id") == "f", F.unhex(F.lit("00"))).otherwise(F.col("embedding")))
    assert [r["photo_id"] for r in search.hits(odd, [1.0, 0.0], 9).collect()] == ["a", "e"]
    assert halves.select(vector.unpack_half(F.col("embedding")).alias("v")).where("photo_id = 'e'").first()["v"] == [0.5, 0.5]


def test_requests_in_flight(spark):
    """120 slow answers in one task come in about a tenth of the time, in order; dead ones are null."""

    def slow(address):
        time.sleep(0.1)
        if address.endswith("7"):
            raise OSError("dead")
        return address.encode()

    rows = spark.createDataFrame([(k, None if k == 50 else f"u{k}") for k in range(120)], "k int, url string").coalesce(1)
    readers.fetch(rows.limit(1), "url", slow).collect()
    began = time.perf_counter()
    got = readers.fetch(rows, "url", slow, attempts=1).collect()
    took = time.perf_counter() - began
    assert [(r["k"], r["content"] and bytes(r["content"])) for r in got] == [(k, None if k == 50 or k % 10 == 7 else f"u{k}".encode()) for k in range(120)]
    assert took < 6


def test_a_rank_costs_few_comparisons_and_passes(spark, monkeypatch):
    """A pass compares a row with two bounds, and both middle ranks are found in one narrowing."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(evaluate, "FEW", 50)
    plans, first = [], DataFrame.first
    monkeypatch.setattr(DataFrame, "first", lambda df: (plans.append(df._jdf.queryExecution().analyzed().toString()), first(df))[1])
    rows = spark.range(4000).selectExpr("cast((id * 7919) % 4001 as double) x")
    values = sorted((k * 7919) % 4001 for k in range(4000))
    assert evaluate.ranked_values(rows, "x", [1999, 2000]) == [float(values[1999]), float(values[2000])]
    assert len(plans) <= 6 and max(map(len, plans)) < 4000


def test_building_a_graph_part_holds_little():
    """What a part of the graph takes over its vectors and links, as numpy counts it."""
    import tracemalloc

    import numpy as np

    from fernglas.operators import graph, store

    x = np.random.default_rng(3).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for make, most in ((lambda: graph.build_links(x), 200 << 20), (lambda: store.closest(np.tile(x, (4, 1)), x), 60 << 20)):
        tracemalloc.start()
        make()
        assert tracemalloc.get_traced_memory()[1] < most
        tracemalloc.stop()
