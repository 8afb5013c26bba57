"""Okapi BM25 keyword ranking.

score = sum over query tokens (repeats count) of idf(t) * f * (k1 + 1) / (f + k1 * (1 - b + b * length / average)),
idf(t) = ln(N - n + 0.5) - ln(n + 0.5); a negative idf is replaced by EPSILON times the mean idf of the vocabulary.
N and the average length count empty documents. Only positive scores are returned.

Texts are tokenised once, and a document's terms are counted where its text lies: one row a document with all of them, no shuffle.
They are stored a second time by term, in blocks: the documents of a term in one slice (documents are dealt out to slices of about SLICE by a hash of the key), with the greatest f and the least
length, which bound what the block can add to a score. Blocks lie in the order of terms, so a search of few terms reads the row
groups of its terms, and a word that every document has is many blocks. Postings are shuffled once for that, as plain rows into
ranges of terms, and meet as blocks within them. Terms and blocks are made when they are first asked for: a vocabulary costs no
blocks. A search brings the blocks of its terms together by slice.
A task adds up a slice term by term, those that can add most first; once the k-th score so far is more than all terms left can add
to a document, only documents that still may reach it are looked up in them.

An index is changed without tokenising what stays: document frequencies, lengths and blocks of new documents are added, documents
that go are marked in the blocks and taken out of the counts. Keys are distinct; rows of a null key are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.scratch import materialise

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms up to which a search pushes them down to the scan; queries of a block; documents of a slice.
PUSHED, QUERIES_BLOCK, SLICE = 2000, 512, 1024
#: Terms after which a slice's k-th score is looked at, for the first time.
LOOK = 8


def tokens_of(docs: DataFrame, key: str, text: Column) -> DataFrame:
    return docs.select(F.col(key).alias("key"), tokenize(text).alias("tokens")).withColumn("length", F.size("tokens"))


def vocabulary(tokens: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(term, df, idf)."""
    return _idf(tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), tokens.count(), epsilon)


def _idf(df: DataFrame, documents: int, epsilon: float) -> DataFrame:
    raw = df.select("term", "df", (F.log(documents - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))  # one row


@dataclass(frozen=True)
class Index:
    """What a search needs: (key, length, found: terms with their f) of all documents, (term, df, idf), and blocks (term, slice,
    part, most_f, least_length, keys, fs, lengths). A block of a null term marks keys that are gone from earlier parts."""

    documents: DataFrame
    make_terms: Callable[[], DataFrame]
    make_blocks: Callable[[], DataFrame]
    slices: int
    part: int = 0

    @cached_property
    def terms(self) -> DataFrame:
        return self.make_terms()

    @cached_property
    def blocks(self) -> DataFrame:
        return self.make_blocks()

    @property
    def lengths(self) -> DataFrame:
        """(key, length, terms)."""
        return self.documents.select("key", "length", F.size("found").alias("terms"))

    @property
    def postings(self) -> DataFrame:
        """(key, length, term, f)."""
        return self.documents.select("key", "length", F.inline("found"))


def _documents(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, length, found): a document's tokens sorted, cut where they change."""
    tokens = tokens_of(docs.where(F.col(key).isNotNull()), key, text).select("key", "length", F.sort_array("tokens").alias("sorted"))
    new = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get("sorted", i) != F.get("sorted", i - 1)))
    cut = tokens.withColumn("at", F.when(F.col("length") > 0, new).otherwise(F.array().cast("array<int>")))
    each = lambda i, k: F.struct(F.get("sorted", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.col("length")) - i).alias("f"))
    return cut.select("key", "length", F.transform("at", each).alias("found"))


def _df(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("found.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")


def _blocks(documents: DataFrame, slices: int, part: int) -> DataFrame:
    found = documents.select(_slice(F.col("key"), slices).alias("slice"), "key", "length", F.inline("found"))
    listed = F.sort_array(F.collect_list(F.struct("key", "f", "length")))  # at most the documents of a slice
    # rows of a term and slice lie in one range already, so they are grouped without another shuffle
    blocks = found.repartitionByRange("term", "slice").groupBy("term", "slice").agg(F.max("f").alias("most_f"), F.min("length").alias("least_length"), listed.alias("rows"))
    blocks = blocks.select("term", "slice", F.lit(part).alias("part"), "most_f", "least_length", F.col("rows.key").alias("keys"), F.col("rows.f").alias("fs"), F.col("rows.length").alias("lengths"))
    return blocks.sortWithinPartitions("term", "slice")


def build_index(docs: DataFrame, key: str, text: Column, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None, epsilon: float = EPSILON) -> Index:
    """Tokenise ``docs`` in one pass. keep(name, make) stores a table and gives it back; by default in the shared folder."""
    keep = keep or (lambda name, make: materialise(make(), name))
    documents = keep("postings", lambda: _documents(docs, key, text))
    n = documents.count()
    slices = max(1, -(-n // SLICE))
    return Index(documents, lambda: keep("terms", lambda: _idf(_df(documents), n, epsilon)), lambda: keep("blocks", lambda: _blocks(documents, slices, 0)), slices)


def changed_index(index: Index, key: str, text: Column, added: DataFrame | None = None, removed: DataFrame | None = None, epsilon: float = EPSILON) -> Index:
    """The index after the documents of ``removed`` (column key) went and those of ``added`` came, or came in place of those of the
    same key. Only ``added`` is tokenised."""
    new = materialise(_documents(added if added is not None else removed.limit(0).withColumn(key, F.col(key)).select(key, F.lit(None).cast("string").alias("__none")), key, text if added is not None else F.col("__none")), "new-postings")
    ids = new.select("key")
    ids = ids if removed is None else ids.union(removed.select(F.col(key).alias("key")))
    gone = materialise(index.documents.select("key").join(ids, "key", "left_semi"), "gone-documents")
    documents = index.documents.join(gone, "key", "left_anti").unionByName(new)
    part = index.part + 1

    def terms() -> DataFrame:
        less = _df(index.documents.join(gone, "key", "left_semi")).select("term", (-F.col("df")).alias("df"))
        df = index.terms.select("term", "df").union(less).union(_df(new)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return materialise(_idf(df, documents.count(), epsilon), "terms")

    def blocks() -> DataFrame:
        marks = gone.groupBy(_slice(F.col("key"), index.slices).alias("slice")).agg(F.collect_list("key").alias("keys"))  # at most the documents of a slice
        none = F.lit(0).cast("int")
        marks = marks.select(F.lit(None).cast("string").alias("term"), "slice", F.lit(part).alias("part"), none.alias("most_f"), none.alias("least_length"), "keys", F.array().cast("array<int>").alias("fs"), F.array().cast("array<int>").alias("lengths"))
        return index.blocks.union(materialise(marks, "gone-blocks")).union(materialise(_blocks(new, index.slices, part), "new-blocks"))

    return Index(documents, terms, blocks, index.slices, part)


def _best_of_slice(own: list[tuple[float, float, np.ndarray, np.ndarray]], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of at least the k best of a slice's n documents, from (most, weight, documents ascending, impacts) of each
    term of a query."""
    own = sorted(own, key=lambda t: -t[0])
    rest = np.append(np.cumsum([t[0] for t in own][::-1])[::-1], 0.0)  # what terms from here on can add
    scores, look = np.zeros(n), LOOK if all(t[1] >= 0 for t in own) else len(own)
    for i, (_, weight, at, impact) in enumerate(own):
        if i == look and n > k:
            look *= 2
            floor = np.partition(scores, n - k)[n - k] - 1e-6
            if rest[i] < floor:
                stay = np.flatnonzero(scores + rest[i] >= floor)
                if stay.size * 4 < n:
                    for _, weight, at, impact in own[i:]:
                        there = np.minimum(np.searchsorted(at, stay), at.size - 1)
                        hit = at[there] == stay
                        scores[stay[hit]] += weight * impact[there[hit]]
                    return stay, scores[stay]
        scores[at] += weight * impact
    return np.arange(n), scores


def _scorer(weights: dict[str, tuple[np.ndarray, np.ndarray]], names: list[str], k: int, k1: float, b: float, average: float):
    """For mapInArrow over sorted blocks: at least the k best documents of each slice for each query. weights: of each term the
    queries and what they give it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []

        def finish() -> pa.RecordBatch:
            keys = pa.concat_arrays([w["keys"] for w in waiting])
            coded = keys.dictionary_encode()
            order = coded.dictionary.to_numpy(zero_copy_only=False)
            rank = np.argsort(np.argsort(order, kind="stable"), kind="stable")  # documents in the order of their keys
            number, ends = rank[coded.indices.to_numpy()], np.cumsum([len(w["keys"]) for w in waiting])
            n, dead = len(order), {}
            parts = [(w, number[e - len(w["keys"]) : e]) for w, e in zip(waiting, ends)]
            for w, at in parts:
                if w["term"] is None:
                    for d in at.tolist():
                        dead[d] = max(dead.get(d, 0), w["part"])
            last = np.zeros(n, dtype=np.int64)
            last[list(dead)] = list(dead.values())
            of_query: dict[int, list] = {}
            impact = lambda f, length: f * (k1 + 1) / (f + k1 * (1 - b + b * length / average))
            for w, at in parts:
                if w["term"] is None:
                    continue
                live = np.flatnonzero(last[at] <= w["part"])
                live = live[np.argsort(at[live], kind="stable")]
                if live.size:
                    added = impact(w["fs"].to_numpy()[live].astype(np.float64), w["lengths"].to_numpy()[live])
                    most = impact(float(w["most_f"]), w["least_length"])
                    for query, weight in zip(*weights[w["term"]]):
                        of_query.setdefault(query, []).append((max(0.0, weight * most), weight, at[live], added))
            out = []
            for query, own in of_query.items():
                document, score = _best_of_slice(own, n, k)
                document, score = document[score > 0], score[score > 0]
                if score.size > k:
                    edge = np.partition(score, score.size - k)[score.size - k]
                    tied = np.flatnonzero(np.abs(score - edge) <= 2e-9)[:k]  # ascending keys
                    pick = np.concatenate([np.flatnonzero(score > edge + 2e-9), tied])
                    document, score = document[pick], score[pick]
                out.append((np.full(document.size, query), document, score))
            query, document, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
            back = np.argsort(rank, kind="stable")
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(query)), coded.dictionary.take(pa.array(back[document])), pa.array(score)], names=["query_id", "key", "score"])

        for batch in batches:
            for i, (term, part, where, most, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("term", "part", "slice", "most_f", "least_length")))):
                if where != now and waiting:
                    yield finish()
                now = where
                if term is None or term in weights:
                    waiting.append({"term": term, "part": part, "most_f": most, "least_length": least, **{c: batch.column(c)[i].values for c in ("keys", "fs", "lengths")}})
        if waiting:
            yield finish()

    return run


def search_index(index: Index, queries: DataFrame, k: int, filters=None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, key, score) for ``queries`` (query_id, query: text), whose ids are distinct, in blocks whose terms' weights
    the driver holds; filters are accepted and ignored."""
    spark, kind = queries.sparkSession, index.lengths.schema["key"].dataType.simpleString()
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "key")  # sums differ in their last digits by the order of addition
    average = index.lengths.agg(F.coalesce(F.avg("length"), F.lit(0.0))).first()[0]
    found, last = None, None
    while k > 0:
        block = queries.where("query_id is not null" if last is None else F.col("query_id") > last).orderBy("query_id").limit(QUERIES_BLOCK)
        terms = block.select("query_id", F.explode_outer(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        listed = terms.join(index.terms, "term", "left").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")).toArrow()  # a block's terms
        names = sorted(set(listed["query_id"].to_pylist()))
        number, weights = {q: i for i, q in enumerate(names)}, {}
        for q, term, weight in zip(*(listed[c].to_pylist() for c in ("query_id", "term", "weight"))):
            if weight is not None:
                weights.setdefault(term, []).append((number[q], weight))
        if weights:
            wanted = sorted(weights)
            if len(wanted) <= PUSHED:
                rows = index.blocks.where(F.col("term").isin(wanted) | F.col("term").isNull() if index.part else F.col("term").isin(wanted))
            else:
                listed = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "wanted string"))  # a block's terms: the blocks of all terms aren't shuffled for them
                rows = index.blocks.join(listed, F.col("term") == F.col("wanted"), "left").where("wanted is not null or term is null").drop("wanted")
            tasks = min(index.slices, max(spark.sparkContext.defaultParallelism, index.slices // 64))
            run = _scorer({t: tuple(zip(*w)) for t, w in weights.items()}, names, k, k1, b, average)
            hits = rows.repartition(tasks, "slice").sortWithinPartitions("slice", "term").mapInArrow(run, f"query_id string, key {kind}, score double")
            hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")
            more = len(names) == QUERIES_BLOCK
            hits = materialise(hits, "keyword-hits") if found is not None or more else hits
            found = hits if found is None else found.union(hits)
        if len(names) < QUERIES_BLOCK:
            break
        last = names[-1]
    return found if found is not None else spark.createDataFrame([], f"query_id string, rank int, key {kind}, score double")


def search(docs: DataFrame, key: str, text: Column, queries: DataFrame, k: int, filters=None, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """search_index() over an index that is built for it."""
    return search_index(build_index(docs, key, text, epsilon=epsilon), queries, k, filters, k1=k1, b=b)


def statistics(docs: DataFrame, text: Column) -> DataFrame:
    """Documents, empty documents and average length."""
    return tokens_of(docs.withColumn("__key", F.lit(0)), "__key", text).agg(F.count("*").alias("documents"), F.count_if(F.col("length") == 0).alias("empty_documents"), F.avg("length").alias("average_length"))
