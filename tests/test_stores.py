"""Approximate stores against exact search: odd vectors, selective filters, certain results, work saved."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernglas.operators import graph, search, store
from fernglas.operators.filters import FilterSpec
from fernglas.operators.graph import GraphStore
from fernglas.operators.store import ClusteredStore

SCHEMA = "photo_id string, embedding array<float>, photo_image_url string, photo_url string, photographer_first_name string, photographer_last_name string, photo_width int, photo_height int, blur_hash string, photo_description string, ai_description string, aperture double, focal_length double, exposure_s double, iso int, camera_make string, camera_model string"
NAN, INF = float("nan"), float("inf")


def photos(spark, vectors, make=lambda k: "Canon", iso=lambda k: 100):
    rows = [(f"p{k:05d}", v, "u", "v", "Ada", "Byte", 4000, 3000, None, "d", "a", float(k % 20), 35.0, 0.01, iso(k), make(k), "m") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def lists(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["photo_id"], round(r["score"], 9)))
    return out


@pytest.fixture(scope="module")
def groups(spark):
    """3,000 unit vectors around 30 centres; 40 queries near some of them."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[::75] + 0.05 * rng.normal(size=(40, 24))
    corpus = photos(spark, x.astype(np.float32).tolist(), lambda k: "Canon" if k % 300 else "Leica", lambda k: k % 1000)
    asked = spark.createDataFrame([(f"q{k:02d}", v.tolist()) for k, v in enumerate(q)], "query_id string, query array<double>")
    return corpus.persist(), asked


@pytest.mark.parametrize("k", [1, 3, 50])
def test_a_bad_vector_costs_no_hit(spark, tmp_path, k):
    """Nulls, NaNs, infinities and other lengths in one batch, in every kind of search."""
    vectors = [[1.0, 0.0], [NAN, 0.0], [0.8, 0.6], None, [INF, 0.0], [0.0, 1.0], [1.0, None], [0.6, 0.8], [1.0], [-INF, 1.0], [], [-1.0, 0.0]]
    corpus = photos(spark, vectors).coalesce(1)
    want = [("p00000", 1.0), ("p00002", 0.8), ("p00007", 0.6), ("p00005", 0.0), ("p00011", -1.0)][:k]
    near = lambda rows: [(r["photo_id"], round(r["score"], 6)) for r in rows.collect()]
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("n", [NAN, 0.0]), ("s", [1.0]), ("z", None), ("g", [None, 1.0])], "query_id string, query array<double>")
    assert near(search.hits(corpus, [1.0, 0.0], k)) == want
    assert near(search.search(corpus, [1.0, 0.0], k)) == want
    assert near(search.similar(corpus, "p00000", k)) == [h for h in near(search.hits(corpus, [1.0, 0.0], k + 1)) if h[0] != "p00000"]
    for found in (search.search_many(corpus, asked, k), ClusteredStore.build(corpus, 2, str(tmp_path / "c")).search_many(asked, k, probe=2), GraphStore.build(corpus, str(tmp_path / "g")).search_many(asked, k)):
        assert {q: [(i, round(s, 6)) for i, s in hits] for q, hits in lists(found).items()} == {"q": want}
    for bad in ([NAN, 1.0], [INF, 0.0], [], [None, 1.0]):
        with pytest.raises(ValueError, match="finite"):
            search.hits(corpus, bad, 1)


def test_best_over_batches(spark):
    """A task sends k rows a query, however many batches it reads."""
    rng = np.random.default_rng(8)
    corpus = photos(spark, rng.normal(size=(2000, 4)).round(1).tolist()).coalesce(1)
    asked = spark.createDataFrame([(f"q{k}", v.tolist()) for k, v in enumerate(rng.normal(size=(5, 4)).round(1))], "query_id string, query array<double>")
    whole = lists(search.search_many(corpus, asked, 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert lists(search.search_many(corpus, asked, 20)) == whole
        q = np.array([r["query"] for r in asked.orderBy("query_id").collect()])
        assert corpus.select("photo_id", "embedding").mapInArrow(search.scanner(list("abcde"), q, 20), search.HITS).count() == 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_selective_filter_returns_all(spark, groups, tmp_path):
    corpus, asked = groups
    clustered, near = ClusteredStore.build(corpus, 16, str(tmp_path / "c")), GraphStore.build(corpus, str(tmp_path / "g"))
    for spec, rows in ((FilterSpec(camera_make="leica"), 10), (FilterSpec(iso_max=200, camera_make="Leica"), 3), (FilterSpec(iso_max=-1), 0)):
        for found in (clustered.search_many(asked, 10, spec, probe=2), near.search_many(asked, 10, spec)):
            assert {len(h) for h in lists(found).values()} == ({rows} if rows else set())
        assert clustered.hits([1.0] * 24, 10, spec, probe=1).count() == near.hits([1.0] * 24, 10, spec).count() == rows


def test_certain_is_exact(spark, groups, tmp_path, monkeypatch):
    corpus, asked = groups
    clustered = ClusteredStore.build(corpus, 32, str(tmp_path / "c"))
    read = []
    monkeypatch.setattr(store, "scanner", lambda ids, q, k, probes=None, run=store.scanner: read.append(int(probes.sum())) or run(ids, q, k, probes))
    for spec in (FilterSpec(), FilterSpec(iso_max=200), FilterSpec(camera_make="leica")):
        assert lists(clustered.search_many(asked, 10, spec, probe=2, certain=True)) == lists(search.search_many(corpus, asked, 10, spec))
    assert [r["photo_id"] for r in clustered.search([0.1] * 24, 5, probe=1, certain=True).collect()] == [r["photo_id"] for r in search.search(corpus, [0.1] * 24, 5).collect()]
    read.clear()
    clustered.search_many(asked, 10, probe=3).collect()
    assert read == [40 * 3]  # nothing but the probed clusters


def test_zones_leave_clusters_out(spark, tmp_path):
    corpus = photos(spark, [[math.cos(a), math.sin(a)] for a in np.linspace(0, 6, 200)], lambda k: f"Make{k // 50}", lambda k: k)
    made = ClusteredStore.build(corpus, 8, str(tmp_path / "c"))
    plan = lambda spec: made._plan(np.array([[1.0, 0.0]]), spec)[0].shape[1]
    assert plan(FilterSpec()) == 8 and plan(FilterSpec(iso_max=10)) < 4 and plan(FilterSpec(camera_make="make3")) < 8 and plan(FilterSpec(focal_min=36)) == 0
    assert ClusteredStore.open(spark, str(tmp_path / "c")).zones == made.zones


def test_graph_overlap_and_work(spark, tmp_path):
    """At k = 10, at least 0.85 of exact search's hits while under 10 % of rows are scored."""
    rows = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").selectExpr("cast(vec_id as string) as photo_id", "embedding")
    asked = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").where("vec_id % 50 = 0").selectExpr("cast(vec_id as string) as query_id", "embedding as query")
    made = GraphStore.build(rows, str(tmp_path / "g"))
    exact, found = lists(search.search_many(rows, asked, 10)), lists(made.search_many(asked, 10))
    shared = np.mean([len({i for i, _ in exact[q]} & {i for i, _ in found[q]}) / 10 for q in exact])
    work = made.work(asked, 10).agg(F.sum("scored") / F.sum("rows")).first()[0]
    scores = {(q, i): s for q, hits in exact.items() for i, s in hits}
    assert all(abs(scores[q, i] - s) < 1e-9 for q, hits in found.items() for i, s in hits if (q, i) in scores)
    print("overlap", shared, "scored", work)
    assert shared >= 0.85 and work < 0.10


def test_graph_over_parts(spark, groups, tmp_path):
    corpus, asked = groups
    made = GraphStore.build(corpus, str(tmp_path / "g"), part_rows=700)
    assert made.nodes.select("part").distinct().count() == 5
    exact, found = lists(search.search_many(corpus, asked, 10)), lists(made.search_many(asked, 10, beam=40))
    assert np.mean([len(set(exact[q]) & set(found[q])) / 10 for q in exact]) >= 0.95
    first = corpus.where("photo_id = 'p00007'").first()["embedding"]
    assert made.search(first, 3, leave_out="p00007").where("photo_id = 'p00007'").count() == 0
    assert made.search(first, 3).first()["photo_id"] == "p00007"


def test_empty_stores(spark, tmp_path):
    empty = photos(spark, [[1.0]]).limit(0)
    asked = spark.createDataFrame([("q", [1.0])], "query_id string, query array<double>")
    assert ClusteredStore.build(empty, path=str(tmp_path / "c")).search_many(asked, 3).count() == 0
    assert GraphStore.build(empty, str(tmp_path / "g")).search_many(asked, 3).count() == 0
    for kind in (ClusteredStore, GraphStore):
        with pytest.raises(FileNotFoundError, match="missing"):
            kind.open(spark, str(tmp_path / "none"))


def test_links_are_bounded():
    x = np.random.default_rng(1).normal(size=(500, 8))
    links = graph.build_links(x)
    assert links.shape == (500, graph.DEGREE) and (links != np.arange(500)[:, None]).all() and links.max() < 500
    reached, todo = {0}, [0]
    while todo:
        new = {int(j) for i in todo for j in links[i] if j >= 0} - reached
        reached |= new
        todo = list(new)
    assert len(reached) == 500
