"""The queries opN_<name> over the test tables: each applies one operator with its production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

WORD_BPE = "word_bpe_49k.json"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files that may be one row group, which is one task.
ONE_TASK = 64 << 20


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of a table, dealt out over all tasks if all its files are so small that few tasks would read them; else as
    they are read."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    df = df.select(*columns)
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= ONE_TASK else df


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_round_trip

    out = bpe_round_trip(dealt(table(spark, sf_dir, "documents"), "doc_id", "text"), word_bpe_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    out = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), word_bpe_path(), end_id=1, max_tokens=2048)
    return out.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: whole conversations under limits on tokens, segments and loss-bearing tokens at once."""
    from .packing import conversation_sizes, pack_items

    sizes = conversation_sizes(table(spark, sf_dir, "conversations"), word_bpe_path())
    return pack_items(sizes, "id", "tokens", "loss", max_tokens=2048, max_segments=16, max_loss=1024).withColumnRenamed("id", "conv_id")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import build_index, search

    index = build_index(table(spark, sf_dir, "embeddings"))
    return search(index, index.rows.where("vec_id % 20 = 0").select("vec_id", "vector"), 20)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    records = read_archives(write_archives(table(spark, sf_dir, "pages"), least_bytes=0), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_on, identify_pages

    out = identify_pages(table(spark, sf_dir, "pages"), fit_on(table(spark, sf_dir, "documents")), carry=["page_id"])
    return out.select("page_id", "language_id.language", "language_id.confidence")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import compare_with_edited

    return compare_with_edited(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train_on

    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), train_on(docs, table(spark, sf_dir, "labels")), out_col="score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import as_text, find_pii

    out = find_pii(dealt(table(spark, sf_dir, "documents"), "doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("pii")).alias("spans"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    ``[.!?]`` out, 3 repeats it, 4 makes it the user's. A null of any column counts as one space."""
    part = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    rows = conversations.select("conv_id", "turn", part["role"].alias("role"), part["text"].alias("text"), (F.crc32(F.concat(part["conv_id"], F.lit(":"), part["turn"])) % 20).alias("fault"))
    rows = rows.where("fault <> 0").withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.expr("if(fault = 3, array(0, 1), array(0))"))).drop("col")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repair, reports, with_ids

    conversations = table(spark, sf_dir, "conversations")
    out = with_ids(reports(materialise(repair(damaged(conversations)), "repaired")), conversations)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import COLUMNS, leaf_digest, manifest, verified

    docs = table(spark, sf_dir, "documents")
    values = {c: F.col(c) for c in COLUMNS}
    cut = leaf_digest([F.replace(v, F.lit("\n"), F.lit("")) if c == "text" else v for c, v in values.items()])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, cut)
    out = verified(manifest(docs, extra={"tampered": tampered}), F.coalesce("tampered", "leaf"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_sharding, op3_packing, pack_conversations, op4_minhash, op5_ann, op6_warc, op7_langid, op8_fingerprint, op9_toxicity, op10_pii, op11_repeats, op12_repair, op13_manifest)}


def oracle_sql() -> dict[str, str]:
    """SQL can't express the results that are trained, hashed, packed or tokenized."""
    from .oracles import ORACLES

    return dict(ORACLES)
