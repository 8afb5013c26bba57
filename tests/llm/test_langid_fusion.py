"""The fusion of all evidence recomputed by plain Python, hot hosts, repeated ids and pages that never close a tag."""

import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fernglas.llm import langid

SF = "/root/testdata/sf0.01"


def visible(html):
    return re.sub(r"(?is)<script\b.*?(?:</script>|\Z)|<style\b.*?(?:</style>|\Z)|<!--.*?(?:-->|\Z)|</?[a-z!?][^>]*(?:>|\Z)|&[a-z#0-9]{1,10};", " ", html)


def fused(pages, model):
    """page_id -> (language, confidence)."""
    names = [*model.languages, "und"]
    rows = []
    for page_id, url, html in pages:
        url, html = url or "", html or ""
        host = (re.search(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url) or [0, ""])[1].lower()
        domain = (re.search(r"([^.]+\.[^.]+)$|^([^.]+)$", host) or [""])[0]
        declared = (re.search(r"(?i)<html[^>]{0,500}?\slang\s*=\s*[\"']?([a-z]{2,3})", html) or [0, ""])[1].lower()
        codes = set(langid.COUNTRY.values())
        part = (re.search(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", url) or [0, ""])[1].lower()
        label = (re.search(r"^([a-z]{2})\.", host) or [0, ""])[1]
        suffix = part if part in codes else label if label in codes else langid.COUNTRY.get((re.search(r"\.([a-z]{2})$", host) or [0, ""])[1], "")
        rows.append((page_id, host, domain, declared, suffix, model.likelihoods(pa.array([visible(html)], pa.large_string()))[0]))
    of_host, of_domain = {}, {}
    every = Counter()
    for _, host, domain, _, _, ll in rows:
        if ll.any():
            best = int(ll.argmax())
            of_host.setdefault((host, domain), Counter())[best] += 1
            of_domain.setdefault(domain, Counter())[best] += 1
            every[best] += 1
    out = {}
    for page_id, host, domain, declared, suffix, ll in rows:
        score = ll.copy()
        h, d = of_host.get((host, domain), Counter()), of_domain.get(domain, Counter())
        for k in range(len(names)):
            overall = (every[k] + 1) / (sum(every.values()) + len(names))
            shared = (d[k] + langid.HOST_WEIGHT * overall) / (sum(d.values()) + langid.HOST_WEIGHT)
            score[k] += np.log((h[k] + langid.HOST_WEIGHT * shared) / (sum(h.values()) + langid.HOST_WEIGHT))
        for claim, chance in ((declared, langid.DECLARED), (suffix, langid.SUFFIX)):
            if claim in model.languages:
                for k, name in enumerate(names):
                    score[k] += np.log(chance if name == claim else 1 / len(model.languages) if name == "und" else (1 - chance) / max(1, len(model.languages) - 1))
        share = 1 / np.exp(score - score.max()).sum()
        sure = (ll.any() or declared in model.languages or suffix in model.languages) and share >= langid.ACCEPT
        out[page_id] = (names[int(score.argmax())] if sure else "und", share)
    return out


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit_on(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("most", [langid.HOSTS_BYTES, 0])
def test_fusion(spark, model, monkeypatch, most):
    """Also where hosts are too many to be broadcast and only hot ones are (here: of one row in eight)."""
    monkeypatch.setattr(langid, "HOSTS_BYTES", most)
    if not most:
        monkeypatch.setattr(langid, "HOT", 8)
        monkeypatch.setattr(langid, "HOSTS_BYTES", 799)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = [(10_000, None, None), (10_001, "http://hot.de/", "<html lang=de>die und der"), (10_002, "http://x.y/fr/", "<p>"), (10_003, "", "<script>never closed")]
    odd += [(11_000 + k, f"http://hot.de/{k}", "<p>and the of to in</p>" if k % 3 else "<p>und der die das ist nicht</p>") for k in range(120)]
    pages = pages.union(spark.createDataFrame(odd, "page_id long, url string, html string"))
    want = fused([tuple(r) for r in pages.collect()], model)
    out = langid.identify_pages(pages, model)
    assert out.columns == ["page_id", "url", "html", "language_id"]
    got = {r["page_id"]: tuple(r["language_id"]) for r in out.collect()}
    assert set(got) == set(want)
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want), [(i, got[i], want[i]) for i in want if got[i][0] != want[i][0]][:5]


def test_fitting_equals_plain_fitting(spark, model):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and length(trim(text)) > 0").select("text", "lang").collect()]
    assert len(rows) <= langid.SAMPLE
    plain = langid.fit([t for t, _ in rows], [x for _, x in rows])
    assert plain.languages == model.languages and np.allclose(plain.table, model.table)


def test_repeated_ids_and_names(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    many = docs.union(spark.range(3000).select(F.lit(7).alias("doc_id").cast("long"), F.lit("and the of to in that").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("n_chars")))
    assert "en" in langid.fit_on(many).languages
    named = docs.limit(5).withColumns({c: F.lit("z") for c in ("language_id", "ll", "host", "row", "score", "prior", "hot")})
    out = langid.identify_documents(named, model)
    assert out.columns == [*(c for c in named.columns if c != "language_id"), "language_id"] and {r["prior"] for r in out.collect()} == {"z"}


def test_unclosed_markup_costs_its_length(spark, model):
    for one in ("<script>ab ", "<!-- a", "<a ", "<", "<style>x", "&amp", "<html "):
        took = []
        for n in (100_000, 400_000):
            page = spark.createDataFrame([(1, "http://a.b/", one * (n // len(one)))], "page_id long, url string, html string")
            began = time.perf_counter()
            assert langid.identify_pages(page, model).count() == 1
            took.append(time.perf_counter() - began)
        assert took[1] < 3 * took[0] + 2, (one, took)


def test_fitting_makes_a_row_a_language_over_any_number_of_tasks(spark, model, monkeypatch):
    """Sums of trigrams don't multiply with the tasks that the sample's texts lie in."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: (plans.append(df), collect(df))[1])
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        again = langid.fit_on(spark.read.parquet(f"{SF}/documents.parquet").repartition(60))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert again.languages == model.languages and np.allclose(again.table, model.table)
    made, todo = [], [df._jdf.queryExecution().executedPlan() for df in plans]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if node.nodeName() == "MapInArrow":
            made.append(node.metrics().apply("pythonNumRowsReceived").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert made and max(made) <= len(model.languages) + 1
