"""Collections: changes write little, snapshots stay, a crash or a race leaves the version before."""

import random

import pytest
from pyspark.sql import functions as F

from fernglas.sources import collection
from fernglas.sources.collection import Collection, Conflict

SCHEMA = "photo_id string, v long, text string"


@pytest.fixture
def make(spark, tmp_path):
    def run(n=0, buckets=8):
        made = Collection.create(spark, f"file://{tmp_path}/c", spark.createDataFrame([], SCHEMA).schema, buckets=buckets)
        if n:
            made.upsert(rows(spark, [(f"p{k:05d}", k, "x" * 200) for k in range(n)]))
        return made

    return run


def rows(spark, some):
    return spark.createDataFrame(some, SCHEMA)


def content(df):
    return {r["photo_id"]: r["v"] for r in df.collect()}


def size(made, folder):
    return made._bytes(folder)


def test_random_changes(spark, make, monkeypatch):
    monkeypatch.setattr(collection, "MOST_CHANGES", 3)
    made, want, history = make(), {}, {}
    rnd = random.Random(4)
    for _ in range(12):
        if rnd.random() < 0.6:
            some = {f"p{rnd.randrange(30)}": rnd.randrange(1000) for _ in range(rnd.randrange(6))}
            made.upsert(rows(spark, [(k, v, None) for k, v in some.items()]))
            want |= some
        else:
            gone = [f"p{rnd.randrange(30)}" for _ in range(4)] + [None]
            made.delete(spark.createDataFrame([(k,) for k in gone], "photo_id string"))
            want = {k: v for k, v in want.items() if k not in gone}
        history[made.versions()[-1]] = dict(want)
        assert content(made.snapshot()) == want
        assert made.snapshot().count() == len(want)
    for version, then in history.items():
        assert content(made.snapshot(version)) == then
    assert {k: made.lookup(k)["v"] if made.lookup(k) else None for k in ("p0", "p1", "zz")} == {k: want.get(k) for k in ("p0", "p1", "zz")}
    assert content(Collection.open(spark, made.path).snapshot()) == want


def test_a_small_change_writes_little(spark, make):
    made = make(20_000)
    version = made.compact()
    base = sum(size(made, b["folder"]) for b in made.entry()["base"])
    made.upsert(rows(spark, [(f"p{k:05d}", -1, "y" * 200) for k in range(0, 20_000, 100)]))
    changed = sum(size(made, c["folder"]) for c in made.entry()["changes"])
    assert made.entry()["base"] == made.entry(version)["base"] and 0 < changed < 0.05 * base
    assert made.snapshot().where("v = -1").count() == 200 and made.snapshot().count() == 20_000


def test_only_touched_buckets_are_written_anew(spark, make):
    made = make(2000)
    made.compact()
    before = {b["bucket"]: b["folder"] for b in made.entry()["base"]}
    made.upsert(rows(spark, [("p00007", -7, "")]))
    made.compact()
    after = {b["bucket"]: b["folder"] for b in made.entry()["base"]}
    assert len(before) == len(after) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert made.lookup("p00007")["v"] == -7 and made.snapshot().count() == 2000


def test_crash_and_race(spark, make, monkeypatch):
    made = make(100)
    want, version = content(made.snapshot()), made.versions()[-1]
    with monkeypatch.context() as m:
        m.setattr(Collection, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            made.upsert(rows(spark, [("new", 1, "")]))
    assert content(made.snapshot()) == want and made.versions()[-1] == version
    with pytest.raises(Conflict):
        made._commit(made.entry())
    commit, lost = Collection._commit, []

    def race(self, entry):
        if not lost:
            lost.append(commit(self, {**self.entry(), "version": entry["version"]}))  # another writer comes first
        return commit(self, entry)

    monkeypatch.setattr(Collection, "_commit", race)
    made.upsert(rows(spark, [("new", 1, "")]))
    assert made.versions()[-1] == version + 2 and content(made.snapshot()) == want | {"new": 1}


def test_tagged_changes_and_bad_ones(spark, make):
    made = make(5)
    one = made.upsert(rows(spark, [("a", 1, "")]), "batch 1")
    assert made.upsert(rows(spark, [("a", 2, "")]), "batch 1") == one and made.lookup("a")["v"] == 1
    for bad in ([("a", 1, ""), ("a", 2, "")], [(None, 1, "")]):
        with pytest.raises(ValueError, match="once"):
            made.upsert(rows(spark, bad))
    with pytest.raises(ValueError, match="not columns"):
        made.upsert(rows(spark, [("b", 1, "")]).withColumn("other", F.lit(1)))
    assert made.upsert(rows(spark, [("c", 1, "")]).drop("text")) and made.lookup("c")["text"] is None
    assert made.upsert(rows(spark, [])) == made.versions()[-1]
    made.clear()
    assert made.snapshot().count() == 0 and made.lookup("a") is None
    with pytest.raises(FileNotFoundError):
        Collection.open(spark, made.path + "-none")


def test_batches_and_failing_tasks(spark, make):
    made = make()
    many = spark.range(1000).selectExpr("format_string('p%05d', id) as photo_id", "id as v", "'t' as text").repartition(3)
    assert made.ingest(many, batch=90) and not made.ingest(many)
    folder = made.entry(1)["changes"][0]["folder"]
    files = spark.read.parquet(f"{made.path}/{folder}").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 12 and max(r["count"] for r in files) <= 90
    want, version = content(made.snapshot()), made.versions()[-1]
    failing = many.withColumn("v", F.when(F.col("v") == 777, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v") + 1))
    with pytest.raises(Exception, match="lost"):
        made.upsert(failing)
    assert made.versions()[-1] == version and content(made.snapshot()) == want
    assert made.ingest(many.limit(10), reset=True) and made.snapshot().count() == 10


def test_vacuum(spark, make):
    made = make(50)
    made.upsert(rows(spark, [("a", 1, "")]))
    made.compact()
    assert made.vacuum() and made.snapshot().count() == 51 and len(made.versions()) == 1
    with pytest.raises(LookupError):
        made.entry(0)


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    made = Collection.create(spark, f"file://{tmp_path}/big", spark.createDataFrame([], SCHEMA).schema, buckets=4)
    spark.conf.set("parquet.block.size", str(64 << 10))
    try:
        made.upsert(spark.range(40_000).selectExpr("format_string('p%06d', id) as photo_id", "id as v", "sha2(cast(id as string), 256) as text"))
        made.compact()
    finally:
        spark.conf.unset("parquet.block.size")
    found = made.lookups(["p012345"])
    assert [tuple(r)[:2] for r in found.collect()] == [("p012345", 12345)]

    def scans(plan):
        out = [plan] if "Scan" in plan.nodeName() else []
        kids = plan.children()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return scans(plan.executedPlan())
        return out + [s for i in range(kids.size()) for s in scans(kids.apply(i))]

    read = scans(found._jdf.queryExecution().executedPlan())
    files = sum(s.metrics().apply("numFiles").value() for s in read if s.metrics().contains("numFiles"))
    rows_read = sum(s.metrics().apply("numOutputRows").value() for s in read)
    assert files == 1 and rows_read < 2000
    missing = made.lookups(["p999999"])
    assert missing.count() == 0
