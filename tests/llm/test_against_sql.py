"""The queries that SQL can express against their SQL: the test tables, and a fixture of hard cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fernglas.llm import queries

SF = "/root/testdata/sf0.01"


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    out = queries.queries()[name](spark, folder)
    assert sorted(out.columns) == sorted(names)
    got, want = [tuple(r[c] for c in names) for r in out.collect()], want.fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_on_whole_tables(spark, name):
    assert same(spark, SF, name)


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hard"))
    nine = " ".join(f"w{i}" for i in range(11))
    texts = [None, "", " \t", "One", "one", "one two", "ONE\ttwo ", nine, nine + " w10 w99", nine.upper(), "Ä b", "ä b", nine + " w11 w12 w13 w14"]
    passage = "é".join(str(k * 7919) for k in range(80))
    texts += ["before " + passage, passage + "\nafter\n", passage[:395] + " cut", "one\ntwo\n", "ab" * 900]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"lang": F.lit("xx"), "source": F.expr("if(doc_id % 5 = 0, null, if(doc_id % 5 = 1, '', concat('s', doc_id % 5)))"), "n_chars": F.length("text").cast("long")}).write.parquet(folder + "/documents.parquet")
    vectors = [[1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0, None], [1.0, 0.0], [0.5, 0.5], [float("inf"), 0.0], [-1.0, 0.25]]
    rows = [(20 * i, v) for i, v in enumerate(vectors)] + [(7, [1.0, 0.0]), (9, [0.25, 0.75])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(folder + "/embeddings.parquet")
    pages = [(3, "u", "<a>"), (1, "u", "<a>"), (2, None, None), (4, "v", ""), (5, "v", "ä\r\n\r\n"), (6, "w", "x" * 100_000), (7, "w", "x" * 100_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(folder + "/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_on_hard_cases(spark, hard, name):
    assert same(spark, hard, name)
