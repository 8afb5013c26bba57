"""From raw documents to packed training sequences, in five stages.

Language identification drops documents of no known language, toxicity those whose score reaches 0.5, near-duplicate
detection (five-word shingles, similarity 0.8) all but one document of each group; personal data are replaced by their
kind in angle brackets, and what is left is packed into sequences of 2048 tokens. All stages but the last return the
columns of ``documents``; each is written to the shared folder and read again by the next.

Rows with nulls: a null text is judged by its declared language and its source alone, and goes if they tell none; a null id,
language or source is carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglas.llm import langid, neardup, packing, pii, toxicity
from fernglas.llm.queries import table, word_bpe_path
from fernglas.llm.shared import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a known language."""
    model = langid.fit_on(docs)
    return langid.identify_documents(docs, model).where(F.col("language_id.language") != langid.UND).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score under TOXIC."""
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, out_col="toxicity").where(F.col("toxicity") < TOXIC).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group. Rows of one id are told apart by their texts; of rows that repeat
    both, one stays. Rows of null id belong to no group and stay."""
    key = ["doc_id", "text_hash"]
    found = materialise(neardup.near_duplicates(docs, words=5, percent=80, with_hash=True).select(*key, "kept"), "kept")
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    kept = rows.join(found.where("not kept").select(*key).distinct(), key, "left_anti")
    repeated = found.where("kept and doc_id is not null").groupBy(*key).count().where("count > 1").select(*key)
    if not repeated.isEmpty():
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates(key))
    return kept.select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars follows the text."""
    clean = pii.find_pii(docs.select(*COLUMNS)).withColumn("text", pii.redact(F.col("text"), F.col("pii")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack_documents(docs, word_bpe_path(), end_id=1, max_tokens=2048)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]
#: The trained stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
