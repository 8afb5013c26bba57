"""Hand-computed expectations: null and NaN traps, parsers, the six-photo store, metrics, maintenance, sources, service."""

import json
import math

import pytest
from pyspark.sql import functions as F

from fernglas import schema, service
from fernglas.functions import exif, text, vector
from fernglas.operators import bm25, evaluate, library, search
from fernglas.operators.filters import FilterSpec, validate
from fernglas.operators.store import ClusteredStore
from fernglas.sources import prepare, readers, writers


def values(spark, parse, raw):
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string")
    return [r["v"] for r in rows.select("k", parse(F.col("raw")).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "parse, raw, want",
    [
        (exif.parse_aperture, ["f/1.8", "1.8", "F2.0", "f/22", "", "  ", "n/a", "abc", None, "NaN", "f/0"], [1.8, 1.8, 2.0, 22.0, *[None] * 7]),
        (exif.parse_exposure, ["1/250", "1/1000", "0.5", "2", "1/250 s", "", "abc", None, "NaN", "1/0", "1/250 sec", "1d", "inf"], [0.004, 0.001, 0.5, 2.0, 0.004, *[None] * 8]),
        (exif.parse_focal_length, ["35", "35.0mm", "135 mm", "50.0", "", "mm", None, "NaN"], [35.0, 35.0, 135.0, 50.0, *[None] * 4]),
        (exif.parse_iso, ["800", "100", "200.0", "2.5", "3.5", "0.4", "", "abc", None, "NaN", "0"], [800, 100, 200, 2, 4, 0, *[None] * 5]),
        (exif.normalize_make, ["NIKON CORPORATION", "  Canon  ", "dji-x o'neil", "", " ", None], ["Nikon Corporation", "Canon", "Dji-X O'Neil", None, None, None]),
        (exif.normalize_model, ["iPhone 13 Pro", "  EOS  R5 ", "", None], ["iPhone 13 Pro", "EOS R5", None, None]),
        (exif.parse_taken_at, ["2024:07:14 18:32:01", "2024-07-14 18:32:01", "2024:7:4 8:02:1\x00", "2024:02:30 10:00:00", "14.7.2024", "0000:00:00 00:00:00", None], ["2024-07-14 18:32:01", "2024-07-14 18:32:01", "2024-07-04 08:02:01", None, None, None, None]),
        (text.tokenize, ["Golden-Hour, by the SEA!", "a dog", None], [["golden", "hour", "by", "the", "sea"], ["dog"], []]),
        (text.parse_numbers, ["1,4,7-9", "9-7", "3,3, 2", ""], [[1, 4, 7, 8, 9], [], [2, 3], []]),
    ],
)
def test_parsers(spark, parse, raw, want):
    got = values(spark, parse, raw)
    assert got == pytest.approx(want) if isinstance(want[0], float) else got == want


PHOTOS = [("p0", [1, 0, 0, 0], "Ada", "Byte", 1.8, 35, 0.004, 100, "Canon", "R5"), ("p1", [0, 1, 0, 0], "Bo", "Lin", 2.8, 50, 0.008, 400, "Nikon", "Z6"), ("p2", [0, 0, 1, 0], "Cy", "Ng", 4.0, 85, 0.016, 800, "Sony", "A7"), ("p3", [0, 0, 0, 1], "Di", "Rao", 1.4, 24, 0.002, 1600, "Canon", "R6"), ("p4", [0.8, 0.6, 0, 0], "Eve", "Sol", None, None, None, None, None, None), ("p5", [0.6, 0, 0.8, 0], "Fu", None, 2.0, 35, 0.004, 200, "Canon", "R5")]


@pytest.fixture(scope="module")
def store(spark):
    rows = [(i, [float(x) for x in v], "u", "u", a, b, 4000, 3000, None, None, None, ap, float(f) if f else None, e, iso, mk, md) for i, v, a, b, ap, f, e, iso, mk, md in PHOTOS]
    kinds = "photo_id string, embedding array<float>, photo_image_url string, photo_url string, photographer_first_name string, photographer_last_name string, photo_width int, photo_height int, blur_hash string, photo_description string, ai_description string, aperture double, focal_length double, exposure_s double, iso int, camera_make string, camera_model string"
    return spark.createDataFrame(rows, kinds)


@pytest.mark.parametrize(
    "spec, want",
    [
        (FilterSpec(aperture_max=2.0), ["p0", "p5", "p3"]),
        (FilterSpec(aperture_max=99), ["p0", "p5", "p1", "p2", "p3"]),
        (FilterSpec(iso_max=400), ["p0", "p5", "p1"]),
        (FilterSpec(focal_min=30, focal_max=60), ["p0", "p5", "p1"]),
        (FilterSpec(camera_make=" CANON "), ["p0", "p5", "p3"]),
        (FilterSpec(camera_make="Canon", aperture_max=1.9), ["p0", "p3"]),
        (FilterSpec(aperture_max=0.5), []),
        (FilterSpec(camera_make=""), []),
        (FilterSpec(), ["p0", "p4", "p5", "p1", "p2", "p3"]),
    ],
)
def test_store(store, spec, want):
    out = search.search(store, [1, 0, 0, 0], 10, spec)
    assert out.columns == schema.RESULT and [r["photo_id"] for r in out.collect()] == want
    clustered = ClusteredStore.build(store, 3)
    assert [r["photo_id"] for r in clustered.search([1, 0, 0, 0], 10, spec, probe=3).collect()] == want


def test_store_more(spark, store):
    out = search.search(store, [1, 0, 0, 0], 3).collect()
    assert [round(r["score"], 6) for r in out] == [1.0, 0.8, 0.6] and out[2]["photographer"] == "Fu"
    assert tuple(search.counts(store).first()) == (6, 5, 5)
    assert [r["photo_id"] for r in search.similar(store, "p0", 2).collect()] == ["p4", "p5"]
    assert search.similar(store, "nope") is None
    assert {r["photo_id"]: r["has_exif"] for r in search.metadata(store).collect()}["p4"] is False
    assert search.search(store, [1, 0, 0, 0], 0).count() == 0
    assert FilterSpec(2.0).document() == {"aperture": {"$lte": 2.0}} and FilterSpec().document() is None and list(FilterSpec(2.0, 100).document()) == ["$and"]
    with pytest.raises(ValueError, match="alignment"):
        search.assert_aligned(store, store.withColumn("photo_id", F.concat("photo_id", F.lit("x"))))
    with pytest.raises(ValueError, match="length mismatch"):
        search.assert_aligned(store, store.limit(3))
    for wrong in ({"q": ""}, {"k": 0}, {"k": 51}, {"spec": FilterSpec(iso_max=0)}):
        with pytest.raises(ValueError):
            validate(**({"q": "x", "k": 12, "spec": FilterSpec()} | wrong))
    nan = spark.createDataFrame([(float("nan"),), (50.0,)], "focal_length double").select(exif.number_or_null(F.col("focal_length")).alias("focal_length"))
    assert FilterSpec(focal_min=10).apply(nan).count() == 1
    with pytest.raises(Exception, match="zero vector"):
        spark.range(1).select(vector.normalise(F.array(F.lit(0.0)))).collect()


def test_service(store):
    encoder = service.StubEncoder({"dog": [1, 0, 0, 0]})
    s = service.Sources({"photos": service.SearchService(store, encoder)})
    out = s.get().search("dog", 3)
    assert out["count"] == 3 and out["filtered"] is False and out["query"] == "dog"
    assert s.get("photos").similar("p0", 3, FilterSpec(aperture_max=2.0))["results"][0]["photo_id"] == "p5"
    assert s.get().health()["exif_count"] == 5
    with pytest.raises(service.NotFound):
        s.get().similar("x")
    with pytest.raises(service.NotFound):
        s.get("other")
    with pytest.raises(service.Unavailable):
        service.Sources({}).get()
    with pytest.raises(NotImplementedError):
        s.get().search_by_image("a", b"")
    with pytest.raises(ValueError):
        service.load_encoder("none")


def test_bm25(spark):
    docs = spark.createDataFrame([("p0", "a brown dog running on a sandy beach", ""), ("p1", "a dog sleeping on a sofa", "indoor pet portrait"), ("p2", "waves on an empty beach at sunset", ""), ("p3", "snow covered mountain peaks", "alpine"), ("p4", "", "")], "photo_id string, ai string, photo string")
    caption = text.caption(F.col("ai"), F.col("photo"))
    queries = spark.createDataFrame([(q, q) for q in ("dog on a beach", "mountain", "alpine", "indoor portrait", "helicopter", "puppy")], "query_id string, query string")
    first = {r["query_id"]: r["key"] for r in bm25.search(docs, "photo_id", caption, queries, 1).collect()}
    assert first == {"dog on a beach": "p0", "mountain": "p3", "alpine": "p3", "indoor portrait": "p1"}
    assert tuple(bm25.statistics(docs, caption).first())[:2] == (5, 1)


def test_metrics(spark):
    ranked = {"a": ["a", "b", "c", "d", "e"], "b": ["a", "b"], "c": ["x", "y", "a", "z"], "d": [f"x{k}" for k in range(10)] + ["a"], "e": []}
    rows = spark.createDataFrame([(q, k + 1, p) for q, own in ranked.items() for k, p in enumerate(own)], "query_id string, rank int, photo_id string")
    queries = spark.createDataFrame([(q, "easy" if q < "c" else "jargon") for q in ranked], "query_id string, bucket string")
    relevant = spark.createDataFrame([(q, p) for q in ranked for p in "abcd" if q != "e"], "query_id string, photo_id string")
    scored = evaluate.score_queries(rows, queries, relevant)
    got = {r["query_id"]: (r["precision"], r["recall"], round(r["reciprocal_rank"], 6)) for r in scored.collect()}
    assert got == {"a": (0.4, 1.0, 1.0), "b": (0.2, 0.5, 1.0), "c": (0.1, 0.25, 0.333333), "d": (0.0, 0.0, 0.0), "e": (0.0, 0.0, 0.0)}
    assert [r["bucket"] for r in evaluate.by_bucket(scored, evaluate.BUCKETS).collect()] == ["easy", "jargon"]
    assert tuple(evaluate.summarize(scored.limit(0)).first()) == (0.0, 0.0, 0.0, 0)
    assert [r["query_id"] for r in evaluate.worst(scored, 2).collect()] == ["d", "e"]
    pool = evaluate.build_pool(spark.createDataFrame([("q", "clip", 1, "a"), ("q", "bm25", 2, "a"), ("q", "clip", 2, "b")], "query_id string, arm string, rank int, photo_id string"))
    with pytest.raises(ValueError):
        evaluate.record(pool, spark.createDataFrame([], "query_id string, judged array<string>, relevant array<string>"), "q", [3])


def test_maintenance(spark):
    scan = [("/r/a.jpg", 1.0, 10), ("/r/b.jpg", 2.0, 10), ("/r/c.jpg", 3.0, 10)]
    files = spark.createDataFrame(scan, "path string, mtime double, size long").withColumn("photo_id", text.photo_id_for(F.col("path")))
    manifest = library.coerce_manifest(library.library_rows(files))
    assert manifest.schema.names == schema.MANIFEST.names and [f.dataType for f in manifest.schema] == [f.dataType for f in schema.MANIFEST]
    assert {r["action"] for r in library.plan_changes(files, manifest, "/r").collect()} == {"unchanged"}
    other = manifest.limit(1).withColumns({"photo_id": F.lit("x"), "path": F.lit("/rr/x.jpg")})
    now = files.where("path <> '/r/c.jpg'").withColumns({"mtime": F.when(F.col("path") == "/r/a.jpg", 6.0).otherwise(F.col("mtime")), "size": F.when(F.col("path") == "/r/a.jpg", 22).otherwise(F.col("size"))})
    plan = library.plan_changes(now, manifest.union(other), "/r")
    assert {r["path"]: r["action"] for r in plan.collect()} == {"/r/a.jpg": "changed", "/r/b.jpg": "unchanged", "/r/c.jpg": "deleted"}
    done = library.apply_plan(manifest.union(other), plan, library.coerce_manifest(library.library_rows(now.where("path = '/r/a.jpg'"))))
    assert {r["path"]: r["size"] for r in done.collect()} == {"/r/a.jpg": 22, "/r/b.jpg": 10, "/rr/x.jpg": 10}


def test_sources(spark, tmp_path):
    names = [f.name for f in schema.RAW_PHOTOS.fields]
    (tmp_path / "a.tsv").write_text("\t".join(names) + "\n" + "\n".join("\t".join([f"p{k}", *["x"] * 5, "400", "300", *['5" nail' if k == 1 else "y"] * 2][: len(names) - 7] + ["f/2"] * 7) for k in range(4)) + "\n")
    raw = readers.read_tsv(spark, str(tmp_path / "a.tsv"), expected=(4, 4))
    assert raw.count() == 4 and prepare.clean(raw).schema.names == schema.PHOTOS.names
    assert prepare.slim(prepare.clean(raw)).columns == schema.SLIM
    (tmp_path / "j.json").write_text(json.dumps({"q1": {"query": "x", "bucket": "easy", "judged": ["a", "b"], "relevant": ["a"]}}))
    assert [tuple(r) for r in readers.read_judgments(spark, str(tmp_path / "j.json")).collect()] == [("q1", "x", "easy", ["a", "b"], ["a"])]
    assert readers.read_judgments(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(FileNotFoundError, match="one.*two"):
        readers.first_existing(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    for f in ("Iceland/a.jpg", "Iceland/b.JPG", "Tokyo/c.png", "notes.txt", ".trash/d.jpg"):
        (tmp_path / "My" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "My" / f).write_bytes(b"12345")
    found = readers.scan_images(spark, str(tmp_path / "My")).collect()
    assert [r["path"].rpartition("/")[2] for r in found] == ["a.jpg", "b.JPG", "c.png"] and found[0]["size"] == 5
    rows = spark.createDataFrame([(f"p{k:04d}", [1.0]) for k in range(1200)], "photo_id string, embedding array<double>")
    folder, seen = str(tmp_path / "chunks"), []

    def process(todo):
        seen.append(todo.count())
        return todo.withColumn("embedding", F.when(F.col("photo_id") != "p0007", F.col("embedding")))

    for _ in range(2):
        good, bad = writers.build_in_chunks(rows, folder, process)
    assert seen == [1200, 0] and (good.count(), bad.count()) == (1199, 1) and good.agg(F.max("chunk_id")).first()[0] == 2
    assert writers.ingest(rows, str(tmp_path / "t")) and not writers.ingest(rows, str(tmp_path / "t"))
    writers.write_table(spark.read.parquet(str(tmp_path / "t")).limit(5), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_stream(spark, tmp_path):
    from fernglas.sources.collection import Collection
    from fernglas.streaming.refresh import follow_files, refresh

    kept = Collection.create(spark, str(tmp_path / "m"), schema.MANIFEST)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(b"1")
    for n in (1, 2):
        refresh(follow_files(spark, str(tmp_path / "in")), kept, str(tmp_path / "c")).awaitTermination(120)
        assert kept.snapshot().count() == n
        (tmp_path / "in/b.jpg").write_bytes(b"2")


def test_half_precision(spark):
    out = spark.createDataFrame([([0.1, 1.0],), (None,)], "v array<float>").select(vector.half_precision(F.col("v")).alias("h")).collect()
    assert abs(out[0]["h"][0] - 0.1) < 1e-4 and out[1]["h"] is None and not math.isnan(out[0]["h"][0])
