"""Queries read every row of their tables; approximate ones are held against exact search."""

import pytest

from fernglas.functions import nearest
from fernglas.operators import search, store
from fernglas.operators.filters import FilterSpec
from fernglas.plans import queries, views

SF = "/root/testdata/sf0.01"


def _asked(spark):
    return {str(r["vec_id"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").collect()}


@pytest.mark.parametrize(("name", "table"), [("dat1_taken_at", "orders"), ("str13_numbers", "part")])
def test_a_row_each(spark, name, table):
    assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_sql_has_no_bound():
    assert not [n for n, sql in queries.oracle_sql().items() for bound in ("vec_id < ", "o_orderkey < ", "p_partkey < ", "l_orderkey < ", "item_id < ", "substr(text") if bound in sql]


def test_query_set_grows(spark):
    """Queries whose ids are divisible by 50 are searched, against all rows."""
    for name in ("win3_batch", "ret7_pool", "ret18_status", "ret15_text_image_table", "ret2_clustered"):
        assert {r["query_id"] for r in queries.queries()[name](spark, SF).select("query_id").distinct().collect()} == _asked(spark)


def test_whole_keyword_queries(spark):
    """All benchmark items are searched, by whole texts."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert sorted(views.keyword_queries(spark, SF).select("query_id", "query").collect()) == sorted(items.selectExpr("cast(item_id as string)", "text").collect())
    assert queries.queries()["ret6_bm25"](spark, SF).select("query_id").distinct().count() == items.count()
    assert queries.queries()["agg19_vocabulary"](spark, SF).where("df = 1").count() > 0


def test_clustered_recall_and_gates(spark):
    r = queries.queries()["ret9_parity"](spark, SF).first()
    assert r["passed"] and r["max_gap"] <= store.MAX_GAP and r["mean_overlap"] >= store.LEAST_OVERLAP
    made = views.clustered_store(spark, SF)
    n = views.corpus(spark, SF).count()
    assert made.rows.count() == n and len(made.centres) == round(n**0.5)
    probes = views.query_vectors(spark, SF).select("query_id", "query")
    whole = store.verify(made, views.corpus(spark, SF), probes, [FilterSpec(), FilterSpec(iso_max=3200)], 10, len(made.centres)).first()
    assert whole["max_gap"] == 0 and whole["mean_overlap"] == 1
    few = made.rows.where("cluster in (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in few and "cluster" in few.split("PartitionFilters: [")[1][:120]
    assert queries.queries()["ret9_graph_parity"](spark, SF).first()["passed"]
    with pytest.raises(FileNotFoundError, match="missing"):
        store.ClusteredStore.open(spark, "/tmp/no-such-store")


def test_search_in_blocks(spark, monkeypatch):
    """Blocks of queries and steps of few products give the same hits."""
    rows, probes = views.corpus(spark, SF), views.query_vectors(spark, SF).select("query_id", "query")
    want = sorted(search.search_many(rows, probes, 7).collect())
    monkeypatch.setattr(search, "QUERIES_BLOCK", 3)
    monkeypatch.setattr(nearest, "STEP", 500)
    assert sorted(search.search_many(rows, probes, 7).collect()) == want
    assert search.search_many(rows, probes.limit(0), 7).count() == 0


def test_search_odd_vectors(spark):
    """Ties go to the smaller id, whole groups of copies; vectors that don't fit are never found."""
    rows = [(f"c{k:03d}", [1.0, 0.0]) for k in range(300)] + [("a", [0.5, 0.5]), ("null", None), ("short", [1.0]), ("gap", [1.0, None]), ("z", [2.0, 0.0])]
    table = spark.createDataFrame(rows, "photo_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, 1.0])], "query_id string, query array<double>")
    found = {}
    for r in search.search_many(table, asked, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["photo_id"])
    assert found == {"q": ["z", "c000", "c001", "c002", "c003"], "r": ["a", "c000", "c001", "c002", "c003"]}
    assert search.search_many(table, asked, 1000).count() == 2 * 302


def test_gap_runs_bm25(spark, monkeypatch):
    """The second system of the gap is BM25: without its hits the gap is the vector search's own means."""
    got = queries.queries()["ret16_gap"](spark, SF).first()
    alone = queries.queries()["agg11_summary"](spark, SF).first()
    monkeypatch.setattr(queries.bm25, "search_index", lambda index, *a: index.lengths.selectExpr("'x' query_id", "1 rank", "key", "1.0D score").limit(0))
    without = queries.queries()["ret16_gap"](spark, SF).first()
    assert without["precision_at_k"] == alone["precision_at_k"]
    assert got != without


def test_agreement_compares_lists(spark, monkeypatch):
    """A coarse second encoder changes the lists, so they are really computed."""
    monkeypatch.setattr(queries.vector, "half_precision", lambda v: queries.F.transform(v, lambda x, i: queries.F.when(i < 8, x).otherwise(0.0).cast("float")))
    r = queries.queries()["ret11_encoder_agreement"](spark, SF).first()
    assert 0 < r["overlap"] < 1
