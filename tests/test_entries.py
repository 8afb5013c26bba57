"""Command line, HTTP, tags, downloads, and sinks that survive a crash."""

import http.server
import io
import json
import math
import struct
import tarfile
import threading
import urllib.request
import zipfile

import pytest
from pyspark.sql import functions as F

from fernglas import __main__ as cli
from fernglas import http as web
from fernglas.functions.tags import read_tags
from fernglas.operators import evaluate, library, search
from fernglas.plans import views
from fernglas import service as layer
from fernglas.functions import blurhash
from fernglas.operators.graph import GraphStore
from fernglas.operators.store import ClusteredStore
from fernglas.service import SearchService, Sources, StubEncoder
from fernglas.sources import fetch, readers, writers
from fernglas.sources.collection import Collection

SF = "/root/testdata/sf0.01"


def picture(width=640, height=480, order="<", turn=1):
    """A JPEG of nothing but its tags and its frame header."""
    u16, u32 = (lambda n: struct.pack(order + "H", n)), (lambda n: struct.pack(order + "I", n))
    texts = {0x010F: b"NIKON CORPORATION\0", 0x0110: b"NIKON Z 7\0", 0x0132: b"2025:01:02 03:04:05\0"}  # the last: when it was edited
    rationals = {0x829A: (1, 500), 0x829D: (18, 10), 0x920A: (35, 1)}
    main_at, heap = 8, b""
    sub_at = main_at + 2 + 12 * 5 + 4
    heap_at = sub_at + 2 + 12 * 5 + 4

    def entry(tag, kind, n, raw):
        nonlocal heap
        if len(raw) <= 4:
            return u16(tag) + u16(kind) + u32(n) + raw.ljust(4, b"\0")
        at = heap_at + len(heap)
        heap += raw
        return u16(tag) + u16(kind) + u32(n) + u32(at)

    main = u16(5) + b"".join(entry(t, 2, len(v), v) for t, v in texts.items()) + entry(0x0112, 3, 1, u16(turn)) + entry(0x8769, 4, 1, u32(sub_at)) + u32(0)
    sub = u16(5) + b"".join(entry(t, 5, 1, u32(a) + u32(b)) for t, (a, b) in rationals.items()) + entry(0x8827, 3, 1, u16(400)) + entry(0x9003, 2, 20, b"2024:07:14 18:32:01\0") + u32(0)
    block = (b"II*\0" if order == "<" else b"MM\0*") + u32(8) + main + sub + heap
    exif = b"Exif\0\0" + block
    frame = struct.pack(">BHHB", 8, height, width, 0)
    return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_tags(order):
    t = read_tags(picture(order=order))
    assert t == {"format": "jpeg", "aperture": 1.8, "focal_length": 35.0, "exposure_s": 0.002, "iso": 400, "camera_make": "NIKON CORPORATION", "camera_model": "NIKON Z 7", "taken": "2024:07:14 18:32:01", "width": 640, "height": 480}
    assert read_tags(b"\xff\xd8\xff\xd9")["iso"] is None
    on_side = read_tags(picture(order=order, turn=6))
    assert (on_side["width"], on_side["height"]) == (480, 640)
    for bad in (b"", b"text", picture(width=60_000, height=60_000)):
        with pytest.raises(ValueError):
            read_tags(bad)
    for n in range(2, len(picture()), 7):
        read_tags(picture()[:n])  # damage is no crash


def test_kinds_of_pictures():
    block = picture()[12:][: picture().index(b"\xff\xc0") - 12]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 30, 20) + b"\x08\x02\0\0\0")
    part = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    webp = lambda *parts: b"RIFF\0\0\0\0WEBP" + b"".join(parts)
    vp8x = part(b"VP8X", b"\x08\0\0\0" + (29).to_bytes(3, "little") + (19).to_bytes(3, "little"))
    pictures = {
        "png": [png, png + chunk(b"eXIf", block)],
        "webp": [webp(vp8x), webp(vp8x, part(b"EXIF", block)), webp(part(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 30, 20))), webp(part(b"VP8L", b"\x2f" + (29 | 19 << 14).to_bytes(4, "little")))],
        "gif": [b"GIF89a" + struct.pack("<HH", 30, 20)],
        "bmp": [b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -20)],
    }
    for kind, files in pictures.items():
        for data in files:
            t = read_tags(data)
            assert (t["format"], t["width"], t["height"]) == (kind, 30, 20)
            assert t["iso"] == (400 if block in data else None)
            for n in range(len(data)):
                try:
                    read_tags(data[:n])
                except ValueError:
                    pass
    assert read_tags(block)["format"] == "tiff" and read_tags(b"\0\0\0\x18ftypheic")["format"] == "heif"


def test_cli_index(spark, tmp_path):
    root = tmp_path / "MyPhotos"
    (root / "Iceland").mkdir(parents=True)
    (root / "Iceland" / "a.jpg").write_bytes(picture())
    (root / "Iceland" / "b.jpg").write_bytes(b"no picture")
    (root / "Iceland" / "c.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 30, 20))
    run = lambda *more: cli.main(["index", "--root", str(root), "--manifest", str(tmp_path / "m"), *more], spark)
    assert run("--dry-run")[0].startswith("3 new") and not (tmp_path / "m").exists()
    lines = run()
    assert lines[0].startswith("3 new, 0 changed") and "2 photos in 1 folders, 50% with camera data" in lines and "  Nikon Corporation: 1" in lines
    rows = {r["photo_description"]: r for r in Collection.open(spark, str(tmp_path / "m")).snapshot().collect()}
    assert sorted(rows) == ["a.jpg", "c.gif"]  # what is no picture comes again next time
    assert rows["a.jpg"]["taken_at"] == "2024-07-14 18:32:01" and rows["a.jpg"]["photo_width"] == 640 and rows["c.gif"]["iso"] is None
    assert run()[0] == "1 new, 0 changed, 2 unchanged, 0 deleted"
    (root / "Iceland" / "b.jpg").unlink()
    (root / "Iceland" / "c.gif").unlink()
    assert run()[0] == "0 new, 0 changed, 1 unchanged, 1 deleted"
    assert run("--reset")[0] == "1 new, 0 changed, 0 unchanged, 0 deleted"
    with pytest.raises(SystemExit, match="no folder"):
        cli.main(["index", "--root", str(root / "none"), "--manifest", str(tmp_path / "m")], spark)


def test_cli_search_ingest(spark, tmp_path):
    views.corpus(spark, SF).write.parquet(str(tmp_path / "c"))
    lines = cli.main(["search", "--corpus", str(tmp_path / "c"), "--like", "3", "-k", "5", "--iso-max", "2000"], spark)
    assert len(lines) == 5 and lines[0].startswith(" 1  ")
    with pytest.raises(SystemExit, match="no item"):
        cli.main(["search", "--corpus", str(tmp_path / "c"), "--like", "none"], spark)
    done = cli.main(["ingest", "--corpus", str(tmp_path / "c"), "--store", str(tmp_path / "s"), "--clusters", "8", "--probe", "7", "--verify"], spark)
    assert "passed" in done[1]
    with pytest.raises(SystemExit, match="FAILED"):
        cli.main(["ingest", "--corpus", str(tmp_path / "c"), "--store", str(tmp_path / "s"), "--probe", "1", "--verify"], spark)


def test_cli_eval_label(spark, tmp_path):
    views.corpus(spark, SF).write.parquet(str(tmp_path / "c"))
    q = views.query_vectors(spark, SF).select("query_id", F.lit("easy").alias("bucket"), F.lit("brass tin").alias("text"), "query").limit(4)
    q.write.parquet(str(tmp_path / "q"))
    pool = evaluate.build_pool(search.search_many(views.corpus(spark, SF), q.select("query_id", "query"), 6).select("query_id", F.lit("clip").alias("arm"), "rank", "photo_id"))
    pool.write.parquet(str(tmp_path / "p"))
    path, ids = str(tmp_path / "j"), sorted(r["query_id"] for r in q.collect())
    for query, positions in ((ids[0], "1,3-4"), (ids[1], "2"), (ids[0], "5")):
        cli.main(["label", "--pool", str(tmp_path / "p"), "--judgments", path, "--query", query, "--positions", positions], spark)
    status = cli.main(["label", "--pool", str(tmp_path / "p"), "--judgments", path], spark)
    assert f"{ids[0]}: 6 of 6 judged, 1 relevant" in status and f"{ids[1]}: 6 of 6 judged, 1 relevant" in status
    lines = cli.main(["eval", "--corpus", str(tmp_path / "c"), "--queries", str(tmp_path / "q"), "--judgments", path], spark)
    assert lines[0] == "2 queries, 0 without an answer" and any(x.startswith("vector   all") and "R 1.000" in x for x in lines) and any(x.startswith("bm25") for x in lines)


def test_judgments_round_trip(spark, tmp_path):
    rows = [("q1", "a dog", "easy", ["a", "b"], ["a"]), ("q2", None, None, [], [])]
    table = spark.createDataFrame(rows, "query_id string, query string, bucket string, judged array<string>, relevant array<string>")
    writers.write_judgments(table, str(tmp_path / "j"))
    assert sorted(map(tuple, readers.read_judgments(spark, str(tmp_path / "j")).collect())) == rows
    writers.write_judgments(table.limit(0), str(tmp_path / "e"))
    assert readers.read_judgments(spark, str(tmp_path / "e")).count() == 0


def test_build_resumes_after_a_crash(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k:04d}",) for k in range(95)], "photo_id string")
    seen = []

    def process(some, most=None):
        seen.append(some.count())
        if most is not None and len(seen) > most:
            raise RuntimeError("lost")
        return some.withColumn("embedding", F.when(F.col("photo_id") != "0007", F.array(F.lit(1.0))))

    folder = str(tmp_path / "chunks")
    with pytest.raises(RuntimeError):
        writers.build_in_chunks(rows, folder, lambda s: process(s, 2), size=10, chunks_a_job=2)
    assert spark.read.parquet(folder).count() == 40
    more = rows.union(spark.createDataFrame([("0000a",), ("zzz",)], "photo_id string"))
    seen.clear()
    good, failed = writers.build_in_chunks(more, folder, process, size=10, chunks_a_job=2)
    assert sum(seen) == 57 and good.count() == 96 and [r[0] for r in failed.select("photo_id").collect()] == ["0007"]
    assert good.select("photo_id").distinct().count() == 96 and good.groupBy("chunk_id").count().agg(F.max("count")).first()[0] <= 10


def test_write_table_reads_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(spark.range(5), path)
    writers.write_table(spark.read.parquet(path).where("id > 1"), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_cli_texts_stores_and_pools(spark, tmp_path):
    rows = views.corpus(spark, SF)
    rows.write.parquet(str(tmp_path / "c"))
    ClusteredStore.build(rows, 8, str(tmp_path / "s"))
    vector = search.stored_vector(rows, "3")
    (tmp_path / "texts.json").write_text(json.dumps({"dog": vector}))
    run = lambda *more: cli.main([*more], spark)
    by_text = run("search", "--corpus", str(tmp_path / "c"), "--text", "dog", "--encoder", "stub", "--encoder-data", str(tmp_path / "texts.json"), "-k", "4", "--time")
    by_vector = run("search", "--corpus", str(tmp_path / "c"), "--vector", json.dumps(vector), "-k", "4", "--store", str(tmp_path / "s"), "--kind", "clustered")
    assert by_text[:4] == by_vector and by_text[4].startswith("encode ") and "search" in by_text[4]
    views.query_vectors(spark, SF).withColumn("text", F.concat(F.lit("query "), "query_id")).write.parquet(str(tmp_path / "q"))
    views.query_vectors(spark, SF).selectExpr("query_id", "reverse(query) as query").write.parquet(str(tmp_path / "r"))
    lines = run("pool", "--corpus", str(tmp_path / "c"), "--queries", str(tmp_path / "q"), "--pool", str(tmp_path / "p"), "--rephrasings", str(tmp_path / "r"))
    pool = spark.read.parquet(str(tmp_path / "p"))
    assert lines[0].endswith("candidates for 10 queries") and {x for r in pool.select("arms").collect() for x in r[0]} >= {"clip", "rephrasing1"}
    judged = pool.groupBy("query_id").agg(F.collect_list("photo_id").alias("judged"), F.slice(F.sort_array(F.collect_list("photo_id")), 1, 2).alias("relevant"))
    writers.write_judgments(judged, str(tmp_path / "j"))
    table = run("eval", "--corpus", str(tmp_path / "c"), "--queries", str(tmp_path / "q"), "--judgments", str(tmp_path / "j"), "--system", "vector", "--store", str(tmp_path / "s"), "--kind", "clustered", "--markdown", "--latency", "2")
    assert table[0].startswith("| system | bucket | P@10") and any(x.startswith("| vector | all |") for x in table) and not any("bm25" in x for x in table) and table[-1].startswith("median of 2")


def test_sequences(spark):
    a = spark.createDataFrame([(k, f"p{k}", float(k)) for k in range(100)], "at int, photo_id string, v double").repartition(5)
    for other, same in ((a.repartition(2), True), (a.withColumn("at", F.col("at").cast("long")), True), (a.withColumn("at", F.when(F.col("at") == 3, 4).when(F.col("at") == 4, 3).otherwise(F.col("at"))), False), (a.where("at < 99"), False), (a.union(a.limit(1)), False), (a.withColumn("v", F.when(F.col("at") != 5, F.col("v"))), False)):
        assert search.same_sequence(a, other, "at", "photo_id", "v") is same
    assert search.same_sequence(a.limit(0), a.limit(0), "at", "v")


def test_http(spark):
    rows = views.corpus(spark, SF).withColumn("path", F.lit(__file__))
    vector = search.stored_vector(rows, "0")
    service = SearchService(rows, StubEncoder({"dog": vector}, {b"img": vector}))
    sources = Sources({"photos": service})
    s = web.server(sources, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/api/search?q=dog&k=3") as r:
            answer = json.load(r)
        own = library.library_rows(rows.where("photo_id = '3'")).first()  # a row's own address is answered
        with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}{own['photo_url']}") as r:
            assert r.status == 200 and b"def test_http" in r.read()
        assert answer["count"] == 3 and answer["results"][0]["photo_id"] == "0" and answer["filtered"] is False
    finally:
        s.shutdown()
    codes = {t: web.respond(sources, "GET", t)[0] for t in ("/api/health", "/api/search?q=", "/api/search?q=dog&k=99", "/api/search?q=dog&iso_max=x", "/api/similar/3?k=2", "/api/similar/none", "/api/photo/3/full", "/api/photo/none/full", "/api/nothing", "/api/search?q=dog&source=other", "/health")}
    assert list(codes.values()) == [200, 422, 422, 422, 200, 404, 200, 404, 404, 404, 404]
    gone = SearchService(rows.withColumn("path", F.lit("/nowhere/a.jpg")), service.encoder)
    assert web.respond(Sources({"photos": gone}), "GET", "/api/photo/3/full")[0] == 404
    health = web.respond(sources, "GET", "/api/health")[1]
    assert (health["store"], health["source"], health["encoder"], health["supports_images"]) == ("exact", "photos", "stubencoder", True)
    assert web.respond(sources, "POST", "/api/search/by-image?k=2", b"img")[0] == 200 and web.respond(sources, "POST", "/api/search/by-image", b"x")[0] == 400
    assert web.respond(Sources({"photos": SearchService(rows, StubEncoder({}))}), "POST", "/api/search/by-image", b"x")[0] == 501
    assert web.respond(Sources({}), "GET", "/api/health")[0] == 503


def test_downloads(tmp_path):
    folder = tmp_path / "web"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("data/photos.tsv", "x\ty\n")
    with tarfile.open(folder / "b.tar", "w") as t:
        info = tarfile.TarInfo("ready.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(folder))
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{s.server_port}"
        path = str(tmp_path / "a.zip")
        stamp = fetch.download(f"{base}/a.zip", path)
        assert stamp and "GMT" in stamp and fetch.download("http://127.0.0.1:1/never", path) == stamp
        assert fetch.fetch_bundle(f"{base}/b.tar", str(tmp_path / "bundle"), "ready.txt") and not fetch.fetch_bundle("http://127.0.0.1:1/never", str(tmp_path / "bundle"), "ready.txt")
    finally:
        s.shutdown()
    fetch.extract(path, "photos.tsv", str(tmp_path / "p.tsv"))
    assert (tmp_path / "p.tsv").read_text() == "x\ty\n"
    with pytest.raises(FileNotFoundError, match="data/photos.tsv"):
        fetch.extract(path, "other.tsv", str(tmp_path / "o"))
    assert fetch.resolve("p.tsv", [str(folder), str(tmp_path)]) == str(tmp_path / "p.tsv")
    assert fetch.resolve("a.zip", [str(tmp_path)], "PLACE", {"PLACE": str(folder)}) == str(folder / "a.zip")
    with pytest.raises(FileNotFoundError, match="none of"):
        fetch.resolve("x", ["/a", "/b"])


def test_small_ones(spark):
    assert evaluate.seconds_left(100, 10, 5) == 30
    states = spark.createDataFrame([("a", "new"), ("b", "same")], "path string, state string")
    assert tuple(library.payload_total(states, spark.createDataFrame([("a", 3), ("b", 4)], "path string, size long")).first()) == (7, 1)
    assert library.touched(states.selectExpr("path photo_id"), states.selectExpr("state photo_id")).count() == 4
    r = spark.range(1).select(search.same_order(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1))).alias("x"), search.same_order(F.lit(None).cast("array<int>"), F.array(F.lit(1))).alias("y")).first()
    assert tuple(r) == (False, False)


def test_stores_and_encoders_by_kind(spark, tmp_path, monkeypatch):
    rows = views.corpus(spark, SF)
    rows.write.parquet(str(tmp_path / "c"))
    ClusteredStore.build(rows, 4, str(tmp_path / "s"))
    GraphStore.build(rows, str(tmp_path / "g"))
    vector = search.stored_vector(rows, "3")
    for path, kind in (("c", "exact"), ("g", "graph"), ("s", "Clustered ")):
        store = layer.load_store(spark, str(tmp_path / path), kind)
        answer = SearchService(rows, StubEncoder({}), store).similar("3", 4)
        assert answer["store"] == kind.strip().lower() and answer["count"] == 4 and "3" not in [r["photo_id"] for r in answer["results"]]
    assert store.search(vector, 1).first()["photo_id"] == "3"
    monkeypatch.setenv("FERNGLAS_STORE", "clustered")
    assert layer.store_kind(layer.load_store(spark, str(tmp_path / "s"))) == "clustered"
    with pytest.raises(ValueError, match="clustered, exact, graph"):
        layer.load_store(spark, str(tmp_path / "c"), "other")
    with pytest.raises(ValueError, match="stub"):
        layer.load_encoder("other")
    for kind in ("exact", "clustered", "graph"):
        with pytest.raises(FileNotFoundError):
            layer.load_store(spark, str(tmp_path / "none"), kind)


def test_pictures_are_encoded_in_batches(spark):
    known = {bytes([n]): [float(n), 1.0] for n in range(40)}
    rows = spark.createDataFrame([(n, bytearray([n])) for n in range(45)] + [(99, None)], "n int, content binary").coalesce(1)
    found = {r["n"]: r["v"] for r in rows.select("n", layer.encode_images(F.col("content"), "stub", {}, known, batch=4).alias("v")).collect()}
    assert len(found) == 46 and all(found[n] == ([float(n), 1.0] if n < 40 else None) for n in found)
    assert rows.limit(0).select(layer.encode_images(F.col("content"), "stub", {}, known)).count() == 0
    with pytest.raises(Exception, match="texts only"):
        rows.select(layer.encode_images(F.col("content"), "stub", {}, {})).collect()


def test_timings(spark):
    rows = views.corpus(spark, SF)
    times = layer.measure(SearchService(rows, StubEncoder({"dog": search.stored_vector(rows, "0")})), ["dog", "dog", "dog"], 3)
    median = evaluate.latency(times).first()
    assert times.count() == 3 and 0 < median["search_ms"] <= median["total_ms"] and layer.measure(SearchService(rows, StubEncoder({})), []).count() == 0


def test_fetch_over_http(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok")
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path)))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        rows = spark.createDataFrame([(f"http://127.0.0.1:{s.server_port}/{name}",) for name in ("a.txt", "b.txt")] + [(None,)], "url string")
        assert [r["content"] for r in readers.fetch(rows, "url").collect()] == [b"ok", None, None]
    finally:
        s.shutdown()


def blur_by_definition(code, width, height):
    """The sum of cosines, pixel by pixel."""
    value = lambda t: sum(blurhash.DIGITS.index(c) * 83 ** (len(t) - 1 - n) for n, c in enumerate(t))
    ny, nx = value(code[0]) // 9 + 1, value(code[0]) % 9 + 1
    out = []
    for y in range(height):
        for x in range(width):
            total = [0.0, 0.0, 0.0]
            for j in range(ny):
                for i in range(nx):
                    n = i + j * nx
                    for c in range(3):
                        if n == 0:
                            v = (value(code[2:6]) >> (16 - 8 * c) & 255) / 255
                            term = v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4
                        else:
                            q = (value(code[4 + 2 * n : 6 + 2 * n]) // 19 ** (2 - c) % 19 - 9) / 9
                            term = math.copysign(q * q, q) * (value(code[1]) + 1) / 166
                        total[c] += term * math.cos(math.pi * x * i / width) * math.cos(math.pi * y * j / height)
            for t in total:
                t = min(1.0, max(0.0, t))
                out.append(min(255, int((12.92 * t if t <= 0.0031308 else 1.055 * t ** (1 / 2.4) - 0.055) * 255) + 1))
    return bytes(out)


def test_blurhash(spark):
    good = ["LEHV6nWB2yk8pyo0adR*.7kCMdnj", "LGF5]+Yk^6#M@-5c,1J5@[or[Q6.", "00OZZy"]
    rows = spark.createDataFrame([(c,) for c in [*good, "", None, "LEHV6", "LEHV6nWB2yk8pyo0adR*.7kCMdn", "00OZ y"]], "code string")
    found = [r["p"] for r in rows.select(blurhash.pixels(F.col("code"), 7, 5).alias("p")).collect()]
    assert [bytes(p) for p in found[:3]] == [blur_by_definition(c, 7, 5) for c in good] and found[3:] == [None] * 5


def test_contact_sheet(spark):
    pool = spark.createDataFrame([("q", n) for n in (1, 6, 7, 14)] + [("r", 1)], "query_id string, position int")
    at = {(r["query_id"], r["position"]): (r["sheet_column"], r["sheet_row"], r["x"], r["y"]) for r in evaluate.sheet_places(pool).collect()}
    assert at == {("q", 1): (0, 0, 6, 34), ("q", 6): (5, 0, 1076, 34), ("q", 7): (0, 1, 6, 196), ("q", 14): (1, 2, 220, 358), ("r", 1): (0, 0, 6, 34)}
    assert sorted(map(tuple, evaluate.sheet_sizes(pool).collect())) == [("q", 1290, 202), ("r", 1290, 202)]
