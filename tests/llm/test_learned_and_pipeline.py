"""Language identification and toxicity on held-out rows, odd rows, and the pipeline's stages each on its own input."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fernglas.llm import langid, neardup, queries, shared, toxicity
from tests.llm.test_neardup import brute_force
from tests.llm.test_plain_operators import base_spans

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def languages(docs):
    return langid.fit_on(docs.where("doc_id % 4 <> 0"))


def test_language_of_held_out_texts(docs, languages):
    rows = langid.identify(docs.where("doc_id % 4 = 0"), languages, F.col("text")).collect()
    right = [r["lang"] == r["language_id"]["language"] for r in rows]
    assert np.mean(right) > 0.98
    assert not [r for r in rows if r["language_id"]["language"] == "und" and len(r["text"].split()) > 5]


def test_language_evidence_decides_where_text_cannot(spark, languages):
    rows = [(1, "<html lang='fr-CA'>", "http://a.b/x"), (2, "<html>", "http://a.b/de/x"), (3, "<p>", "http://shop.es/"), (4, None, None), (5, "12345 67890", "http://x.y"), (6, "<html lang=en><p>" + "die und der nicht ein mit von auch sich " * 20, "http://z.org")]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, html string, url string, host string")
    got = {r["page_id"]: r["language_id"]["language"] for r in langid.identify_pages(pages, languages).collect()}
    assert [got[k] for k in range(1, 7)] == ["fr", "de", "es", "und", "und", "de"]
    assert langid.identify_pages(pages.limit(0), languages).count() == 0
    assert {r["language_id"]["language"] for r in langid.identify_pages(pages, langid.fit([], [])).collect()} == {"und"}


def test_host_prior_helps_short_texts(spark, languages, docs):
    spanish = [r["text"] for r in docs.where("lang = 'es'").limit(30).collect()]
    rows = [(k, t, None, "host.a") for k, t in enumerate(spanish)] + [(100, "la", None, "host.a"), (101, None, None, None)]
    out = {r["doc_id"]: r["language_id"] for r in langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), languages).collect()}
    alone = langid.identify(spark.createDataFrame([(100, "la")], "doc_id long, text string"), languages, F.col("text")).first()["language_id"]
    assert out[100]["language"] == "es" and out[101]["language"] == "und" and (alone["language"] != "es" or out[100]["confidence"] > alone["confidence"])


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op9_toxicity(spark, sf).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    toxic = [r["predicted"] for r in held if labels[r["doc_id"]]]
    clean = [r["predicted"] for r in held if not labels[r["doc_id"]]]
    assert len(toxic) > 30 and np.mean(toxic) > 0.9 and np.mean(clean) < 0.02


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(rng, 3).items()}
    x, words = rng.normal(size=(6, toxicity.INPUT)), rng.integers(0, 6, (toxicity.WINDOW, 4))
    size = np.array([toxicity.WINDOW, 5, 1, 0])
    words[np.arange(toxicity.WINDOW)[:, None] >= size] = -1
    slope = rng.normal(size=4)
    g, d_x = toxicity.backward(p, x, words, toxicity.forward(p, x, words, size, keep=True), slope)
    loss = lambda: float(toxicity.forward(p, x, words, size)[0] @ slope)
    for k in ("f_in", "f_zr", "f_new", "b_in", "b_bias", "b_zr", "b_new", "att_in", "att_out", "out"):
        where = np.unravel_index(int(np.abs(g[k]).argmax()), p[k].shape)
        at = p[k][where]
        p[k][where] = at + 1e-3
        above = loss()
        p[k][where] = at - 1e-3
        slope_now = (above - loss()) / 2e-3
        p[k][where] = at
        assert abs(slope_now - g[k][where]) < 5e-3 * max(1, abs(slope_now)), k
    where = np.unravel_index(int(np.abs(d_x).argmax()), x.shape)
    x[where] += 1e-3
    above = loss()
    x[where] -= 2e-3
    assert abs((above - loss()) / 2e-3 - d_x[where]) < 5e-3


def test_windows_cover_all_words():
    at = np.array([0, 0, 1, 32, 65, 400])
    begin, size, owner = toxicity.windows_of(at)
    for text, (a, b) in enumerate(zip(at, at[1:])):
        own = [set(range(s, s + n)) for s, n, o in zip(begin, size, owner) if o == text]
        assert set().union(*own) == set(range(a, b)) and len(own) >= 1
        assert all(len(x & y) == toxicity.STRIDE for x, y in zip(own[:-1], own[1:-1]))


def test_toxicity_odd_texts(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) + (" vileword" if k % 4 == 0 else "") for k in range(400)]
    model = toxicity.train(texts, [int(k % 4 == 0) for k in range(400)])
    odd = ["", None, " ".join(rng.choices(words, k=30_000)), " ".join(rng.choices(words, k=30_000)) + " Vileword, x", "x" * 100_000, "VILEWORD", "¿"]
    table = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(odd)], "doc_id long, text string, toxicity double")
    got = [r["toxicity"] for r in toxicity.score(table, model).orderBy("doc_id").collect()]
    assert got[3] > 0.5 > got[2] and got[5] > 0.5 and got[0] == got[1] < 0.5 and got[4] < 0.5
    assert toxicity.score(table.limit(0), model).count() == 0
    for labels in ([], [0] * 5, [1] * 5):
        flat = toxicity.train(["a b"] * len(labels), labels)
        assert np.isfinite(flat.scores(pa.array(["a", ""], pa.large_string()))).all()


def test_pipeline_stages(spark, docs):
    sf, state = SF, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in state.collect()}
        out = stage(spark, state, sf)
        if name != "packing":
            assert out.columns == docs.columns
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "language_id":
            assert all(len(re.findall(r"[^\W\d_]{2,}", before[i]["text"])) < 5 for i in set(before) - set(after))
        elif name == "toxicity":
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
            assert len(toxic & set(after)) < 0.2 * len(toxic) and len(set(before) - set(after)) < 0.25 * len(before)
        elif name == "near_duplicates":
            want = brute_force([(i, r["text"]) for i, r in before.items()], 5)
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        elif name == "personal_data":
            assert set(after) == set(before)
            for i, r in after.items():
                spans = base_spans(before[i]["text"])
                assert r["n_chars"] == len(r["text"])
                for kind, a, b in spans:
                    if kind == "email":
                        assert before[i]["text"][a:b] not in r["text"]
        else:
            assert set(after) == set(before)
        state = out


def test_pipeline_odd_rows(spark):
    """Which rows each stage keeps, by id and text: a null text is judged by what is declared, an empty one of which nothing is
    known goes; rows that repeat id and text
    become one in near duplicates, one id with two texts is two documents, rows of null id stay."""
    words = "the and of to in that it is was for with are"
    other = "she said this would have been their very own house before when they came over there"
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (None, words, None, "a", 5), (None, words, None, "a", 5), (3, words + " a@b.co", "en", None, 5), (3, words + " a@b.co", "en", None, 5),
        (3, other, "en", "a", 9), (4, other, None, "b", 9), (5, words + " a@b.co", "en", "a", 5),
    ]
    rows = [(r[0] and r[0] + 900_000, *r[1:]) for r in rows]  # among others, on which models are fitted
    table = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", pii string")
    table = table.union(spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS, F.lit("y")))
    kept = lambda df: sorted((r["doc_id"] or -1, r["text"] or "") for r in df.where("doc_id is null or doc_id > 900000").collect())
    known = sorted((r[0] or -1, r[1] or "") for r in rows if r[0] != 900_002)
    one_each = [(-1, words), (-1, words), (900_003, words + " a@b.co"), (900_003, other)]
    want = {"language_id": known, "toxicity": sorted((r[0] or -1, r[1] or "") for r in rows), "near_duplicates": sorted([*one_each, (900_001, ""), (900_002, "")]), "personal_data": sorted((r[0] or -1, (r[1] or "").replace("a@b.co", "<EMAIL>")) for r in rows)}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), SF).count() == 0
        out = stage(spark, table, SF)
        if name == "packing":
            assert {(r["doc_id"], r["doc_tokens"]) for r in out.collect()} >= {(900_001, 1), (900_002, 1)} and out.where("start = 0").count() == table.count()
            continue
        assert out.columns == corpus_pipeline.COLUMNS
        assert kept(out) == want[name], name
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, SF), name)
    assert kept(docs) == sorted((i, t.replace("a@b.co", "<EMAIL>")) for i, t in [*one_each, (900_001, "")])


def test_neardup_five_words_is_default():
    assert neardup.near_duplicates.__defaults__[:2] == (5, 80)
