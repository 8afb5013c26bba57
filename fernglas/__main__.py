"""Command line: search, index, ingest, eval, pool and label over tables in Parquet."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .functions.exif import normalize_make, normalize_model, parse_taken_at
from .functions.tags import SCHEMA, read_tags
from .operators import bm25, evaluate, library, search
from .operators.filters import FilterSpec, validate
from .operators.store import ClusteredStore, usable_rows, verify
from .schema import MANIFEST
from .service import ExactStore, SearchService, StubEncoder, load_encoder, load_store, measure
from .sources.collection import Collection
from .sources.readers import decode, exists, fetch, read_file, read_judgments, scan_images
from .sources.scratch import materialise
from .sources.writers import write_judgments, write_table

SHOWN = 10


def _spec(a: argparse.Namespace) -> FilterSpec:
    return FilterSpec(a.aperture_max, a.iso_max, a.focal_min, a.focal_max, a.camera_make)


def _encoder(a: argparse.Namespace):
    """The encoder of a kind; --encoder-data is what it is made from, in JSON."""
    if a.encoder_data is None:
        return load_encoder(a.encoder)
    with open(a.encoder_data) as f:
        return load_encoder(a.encoder, json.load(f))


def run_search(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """A line a hit, nearest to a text, to a stored item or to a vector; --time adds what encoding and search took."""
    rows, spec = spark.read.parquet(a.corpus), _spec(a)
    validate(a.text, a.k, spec)
    store = load_store(spark, a.store, a.kind) if a.store else ExactStore(rows)
    began = time.perf_counter()
    vector = _encoder(a).encode_text(a.text) if a.text is not None else search.stored_vector(rows, a.like) if a.like is not None else json.loads(a.vector)
    if vector is None:
        raise SystemExit(f"no item {a.like}")
    encoded = time.perf_counter()
    found = store.search(vector, a.k, spec, leave_out=a.like)
    hits = found.orderBy(F.col("score").desc(), "photo_id").collect()  # at most k rows
    done = time.perf_counter()
    ranked = spark.createDataFrame([(n, *r) for n, r in enumerate(hits, 1)], "rank int, " + ", ".join(f"{n} {t}" for n, t in found.dtypes))
    lines = ranked.select("rank", text.cli_line(F.col("rank"), F.col("score"), F.col("photographer"), F.col("focal_length"), F.col("aperture"), F.col("iso")).alias("line"))
    timed = [f"encode {(encoded - began) * 1e3:.1f} ms, search {(done - encoded) * 1e3:.1f} ms"] if a.time else []
    return [r["line"] for r in lines.orderBy("rank").collect()] + timed


def load_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Manifest rows of files, with the tags that their contents hold; files that are no pictures are left out."""
    names = fetch(files.select("path"), "path", read_file)
    tags = names.select("path", decode(F.col("content"), read_tags, SCHEMA).alias("t")).select("path", "t.*").where("format is not null")
    rows = library.library_rows(files.join(tags, "path")).withColumns({"camera_make": normalize_make(F.col("camera_make")), "camera_model": normalize_model(F.col("camera_model")), "taken_at": parse_taken_at(F.col("taken")), "photo_width": F.col("width"), "photo_height": F.col("height")})
    return library.coerce_manifest(rows)


def run_index(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Bring a manifest, which is a collection, up to date with a folder; --dry-run only tells what would be done."""
    if not exists(spark, a.root):
        raise SystemExit(f"no folder {a.root}")
    scanned = scan_images(spark, a.root)
    empty = library.coerce_manifest(scanned.limit(0))
    kept = Collection.open(spark, a.manifest) if exists(spark, a.manifest) else None
    old = empty if a.reset or kept is None else kept.snapshot()
    plan = materialise(library.plan_changes(scanned, old, a.root), "changes")  # a cached plan would come back in the next run
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    lines = [", ".join(f"{counts.get(k, 0)} {k}" for k in ("new", "changed", "unchanged", "deleted"))]
    for kind in ("new", "changed"):
        lines += [f"  {kind} {r['path']}" for r in plan.where(F.col("action") == kind).orderBy("path").limit(SHOWN).collect()]
    todo = plan.where("action in ('new', 'changed')")
    if not a.dry_run:
        kept = kept or Collection.create(spark, a.manifest, MANIFEST)
        if a.reset:
            kept.clear()
        if counts.get("deleted"):
            kept.delete(plan.where("action = 'deleted'").select("photo_id"))
        if counts.get("new") or counts.get("changed"):
            kept.upsert(load_files(spark, todo))
    now = empty if kept is None else kept.snapshot()
    if not now.isEmpty():
        s = library.stats(now).first()
        lines.append(f"{s['photos']} photos in {s['folders']} folders, {s['exif_share']:.0%} with camera data")
        lines += [f"  {r['camera_make']}: {r['photos']}" for r in library.top_makes(now).collect()]
    return lines


def run_ingest(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Build a clustered store, unless it is there, and hold it against exact search."""
    rows = spark.read.parquet(a.corpus)
    store = ClusteredStore.build(rows, a.clusters, a.store) if a.reset else ClusteredStore.get_or_create(rows, a.store, a.clusters)
    if (there := store.rows.count()) != (given := usable_rows(rows, store.centres.shape[1]).count() if len(store.centres) else 0):
        raise SystemExit(f"{there} rows stored of {given}")
    lines = [f"{there} rows"]
    if a.verify:
        probes = usable_rows(rows, store.centres.shape[1]).orderBy(F.xxhash64("photo_id", F.lit(a.seed)), "photo_id").limit(a.probes).select(F.col("photo_id").alias("query_id"), F.col("embedding").alias("query"))
        r = verify(store, rows, probes, [FilterSpec(), FilterSpec(iso_max=400), FilterSpec(aperture_max=2.8)], 10, a.probe).first()
        lines.append(f"largest gap {r['max_gap']:.2e}, mean overlap {r['mean_overlap']:.3f}: {'passed' if r['passed'] else 'FAILED'}")
        if not r["passed"]:
            raise SystemExit("\n".join(lines))
    return lines


def run_eval(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Vector search, BM25 over captions, or both: all queries, by bucket, and the worst; how long queries take one by one. Queries
    (query_id, bucket, text, query) hold the vectors that an encoder gave."""
    rows, queries, judged = spark.read.parquet(a.corpus), spark.read.parquet(a.queries), read_judgments(spark, a.judgments)
    scored, unanswerable = evaluate.drop_unanswerable(judged.select("query_id", "relevant"))
    queries = queries.join(scored.select("query_id"), "query_id")
    relevant = scored.select("query_id", F.explode("relevant").alias("photo_id"))
    store, found = load_store(spark, a.store, a.kind) if a.store else ExactStore(rows), {}
    if a.system in ("vector", "both"):
        asked = queries.select("query_id", "query")
        found["vector"] = store.search_many(asked, a.k) if a.store and not isinstance(store, ExactStore) else search.search_many(rows, asked, a.k)
    if a.system in ("bm25", "both"):
        index = bm25.build_index(rows.select("photo_id", text.caption(F.col("ai_description"), F.col("photo_description")).alias("caption")), "photo_id", F.col("caption"))
        found["bm25"] = bm25.search_index(index, queries.select("query_id", F.col("text").alias("query")), a.k).withColumnRenamed("key", "photo_id")
    systems = {n: evaluate.score_queries(hits, queries.select("query_id", "bucket"), relevant, a.k) for n, hits in found.items()}
    report = evaluate.report(systems, evaluate.BUCKETS).orderBy(F.desc("system"), F.col("bucket") != "all", "bucket").collect()
    if a.markdown:
        lines = [f"| system | bucket | P@{a.k} | R@{a.k} | MRR | n |", "|---|---|---|---|---|---|"]
        lines += [f"| {r['system']} | {r['bucket']} | {r['precision_at_k']:.3f} | {r['recall_at_k']:.3f} | {r['mrr']:.3f} | {r['n']} |" for r in report]
    else:
        lines = [f"{queries.count()} queries, {unanswerable.count()} without an answer"]
        lines += [f"{r['system']:8} {r['bucket']:14} P {r['precision_at_k']:.3f}  R {r['recall_at_k']:.3f}  MRR {r['mrr']:.3f}  n {r['n']}" for r in report]
    first = next(iter(systems))
    worst = evaluate.worst(systems[first], a.worst).join(queries.select("query_id", "text"), "query_id").orderBy("precision", "reciprocal_rank", "query_id")
    lines += [f"worst {r['query_id']} P {r['precision']:.2f} RR {r['reciprocal_rank']:.2f} {r['text']}" for r in worst.collect()]
    if a.latency and "vector" in found:
        texts = queries.orderBy("query_id").limit(a.latency).select("text", "query").collect()  # so many queries, one by one
        service = SearchService(rows, StubEncoder({r["text"]: list(r["query"]) for r in texts}), store)
        r = evaluate.latency(measure(service, [r["text"] for r in texts], a.k)).first()
        lines.append(f"median of {len(texts)}: encode {r['encode_ms']:.2f} ms, search {r['search_ms']:.2f} ms, both {r['total_ms']:.2f} ms")
    return lines


def run_pool(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Gather the candidates to judge: the first hits of vector search and of BM25 over captions for each query, and of vector
    search for its rephrasings, which are rows of --rephrasings (query_id, query)."""
    rows, queries, depth = spark.read.parquet(a.corpus), spark.read.parquet(a.queries), evaluate.DEPTHS
    index = bm25.build_index(rows.select("photo_id", text.caption(F.col("ai_description"), F.col("photo_description")).alias("caption")), "photo_id", F.col("caption"))
    arms = [("clip", search.search_many(rows, queries.select("query_id", "query"), depth["clip"])), ("bm25", bm25.search_index(index, queries.select("query_id", F.col("text").alias("query")), depth["bm25"]).withColumnRenamed("key", "photo_id"))]
    if a.rephrasings:
        other = spark.read.parquet(a.rephrasings)
        nth = other.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.xxhash64("query"))))  # a few each
        for n in range(1, (nth.agg(F.max("n")).first()[0] or 0) + 1):
            arms.append((f"rephrasing{n}", search.search_many(rows, nth.where(F.col("n") == n).select("query_id", "query"), depth["rephrasing"])))
    found = None
    for name, hits in arms:
        hits = hits.select("query_id", F.lit(name).alias("arm"), F.col("rank").cast("int").alias("rank"), "photo_id")
        found = hits if found is None else found.unionByName(hits)
    write_table(evaluate.build_pool(found), a.pool)
    pool = spark.read.parquet(a.pool)
    return [f"{pool.count()} candidates for {pool.select('query_id').distinct().count()} queries"]


def run_label(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Judge a query's candidates by their positions, or without --query show how far the judgments are."""
    pool, judged = spark.read.parquet(a.pool), read_judgments(spark, a.judgments)
    if a.query is not None:
        numbers = spark.range(1).select(text.parse_numbers(F.lit(a.positions)).alias("n")).first()["n"]
        write_judgments(evaluate.record(pool, judged, a.query, numbers), a.judgments)
        judged = read_judgments(spark, a.judgments)
    return [f"{r['query_id']}: {r['judged']} of {r['candidates']} judged, {r['relevant']} relevant" for r in evaluate.status(pool, judged).orderBy("query_id").collect()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fernglas", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=run.__doc__)
        for path in paths:
            c.add_argument(f"--{path}", required=True)
        c.set_defaults(run=run)
        return c

    c = command("search", run_search, "corpus")
    one = c.add_mutually_exclusive_group(required=True)
    one.add_argument("--text")
    one.add_argument("--like")
    one.add_argument("--vector")
    c.add_argument("--encoder")
    c.add_argument("--encoder-data")
    c.add_argument("--store")
    c.add_argument("--kind")
    c.add_argument("--time", action="store_true")
    c.add_argument("-k", type=int, default=12)
    for name, kind in (("aperture-max", float), ("iso-max", int), ("focal-min", float), ("focal-max", float), ("camera-make", str)):
        c.add_argument(f"--{name}", type=kind)
    c = command("index", run_index, "root", "manifest")
    for name in ("dry-run", "reset"):
        c.add_argument(f"--{name}", action="store_true")
    c = command("ingest", run_ingest, "corpus", "store")
    for name, value in (("clusters", 64), ("probes", 15), ("probe", 48), ("seed", 7)):
        c.add_argument(f"--{name}", type=int, default=value)
    for name in ("reset", "verify"):
        c.add_argument(f"--{name}", action="store_true")
    c = command("eval", run_eval, "corpus", "queries", "judgments")
    c.add_argument("-k", type=int, default=10)
    c.add_argument("--worst", type=int, default=5)
    c.add_argument("--system", choices=("vector", "bm25", "both"), default="both")
    c.add_argument("--store")
    c.add_argument("--kind")
    c.add_argument("--markdown", action="store_true")
    c.add_argument("--latency", type=int, default=0)
    c = command("pool", run_pool, "corpus", "queries", "pool")
    c.add_argument("--rephrasings")
    c = command("label", run_label, "pool", "judgments")
    c.add_argument("--query")
    c.add_argument("--positions", default="")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    a = parser().parse_args(argv)
    return a.run(spark or SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    print("\n".join(main()))
