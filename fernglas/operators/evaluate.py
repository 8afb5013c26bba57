"""Retrieval evaluation over pooled relevance judgments, all queries in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Depths of a pool's arms, and the order of buckets in reports.
DEPTHS = {"clip": 12, "rephrasing": 6, "bm25": 12}
BUCKETS = ["easy", "compositional", "abstract", "jargon"]


def drop_unanswerable(judgments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with a relevant item, and those without."""
    return judgments.where(F.size("relevant") > 0), judgments.where(F.size("relevant") <= 0)


def score_queries(ranked: DataFrame, queries: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """A row a query: hits (flags by rank), precision = hits / k, recall = hits / relevant (0 if none), reciprocal rank.

    ranked: (query_id, rank, photo_id); queries: (query_id, bucket); relevant: (query_id, photo_id). Only the first k
    ranks count; unjudged items are not relevant.
    """
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    marked = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "photo_id", F.lit(True).alias("hit")), ["query_id", "photo_id"], "left")
    hit = F.coalesce("hit", F.lit(False))
    flags = F.transform(F.array_sort(F.collect_list(F.struct("rank", hit.alias("hit")))), lambda x: x["hit"])  # at most k a query
    per = marked.groupBy("query_id").agg(flags.alias("hits"), F.count_if(hit).alias("n_hits"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    joined = queries.join(per, "query_id", "left").join(n, "query_id", "left")
    hits = F.coalesce("n_hits", F.lit(0))
    return joined.select(
        "query_id",
        "bucket",
        (hits / F.lit(float(k))).alias("precision"),
        F.coalesce(F.try_divide(hits.cast("double"), F.col("n_relevant")), F.lit(0.0)).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"),
        F.coalesce("hits", F.array().cast("array<boolean>")).alias("hits"),
    )


def hit_flags(ranked: Column, relevant: Column, k: int) -> Column:
    """The same for arrays: whether each of the first k is relevant."""
    return F.transform(F.slice(ranked, 1, k), lambda x: F.array_contains(relevant, x))


def _means() -> list[Column]:
    return [F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in (("precision", "precision_at_k"), ("recall", "recall_at_k"), ("reciprocal_rank", "mrr"))]


def summarize(scored: DataFrame) -> DataFrame:
    """Means over queries (0 for none) and their number."""
    return scored.agg(*_means(), F.count("*").alias("n"))


def by_bucket(scored: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The same for each bucket that occurs, in the given order."""
    out = scored.groupBy("bucket").agg(*_means(), F.count("*").alias("n"))
    return out.orderBy(F.array_position(F.lit(order), F.col("bucket"))) if order else out.orderBy("bucket")


def worst(scored: DataFrame, n: int = 5) -> DataFrame:
    return scored.orderBy("precision", "reciprocal_rank", "query_id").limit(n)


def gap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Difference of two systems' means."""
    a, b = summarize(left), summarize(right)
    names = ("precision_at_k", "recall_at_k", "mrr")
    return a.select(*(F.col(n).alias(f"a_{n}") for n in names)).crossJoin(b.select(*(F.col(n).alias(f"b_{n}") for n in names))).select(*((F.col(f"a_{n}") - F.col(f"b_{n}")).alias(n) for n in names))


#: What share of the rows (one in RANGES) lies between a rank and each bound of a pass, and rows among which it is looked for at last.
RANGES, FEW = 1000, 100_000


def ranked_values(rows: DataFrame, value: str | Column, ranks: list[int]) -> list[float | None]:
    """The values at ``ranks`` (from 0) among the values that are not null, exactly and without sorting them all. Each pass cuts
    what is left at two approximate quantiles close by the rank, one on each side, counts the rows of each range and keeps that of
    the rank; when FEW rows are left, or one value, it is read off. A row costs a pass two comparisons, and the next rank begins
    where the last one ended if it lies there. What meets in one task is a count a range, or FEW rows. A rank beyond the last gives
    None."""
    values = rows.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("x")).where("x is not null")
    out: list[float | None] = []
    known = lambda left: (left, *left.agg(F.count("*"), F.min("x"), F.max("x")).first())
    whole, last = (0, *known(values)), None
    for rank in ranks:
        before, left, n, least, most = last if last and last[0] <= rank < last[0] + last[2] else whole
        while True:
            if rank - before >= n or rank < 0:
                out.append(None)
            elif least == most:
                out.append(least)
            elif n <= FEW:
                out.append(left.orderBy("x").limit(rank - before + 1).agg(F.max("x")).first()[0])
            else:
                shares = [min(1.0, max(0.0, (rank - before) / n + side / RANGES)) for side in (-1, 1)]
                bounds = sorted(set(left.agg(F.percentile_approx("x", shares, 10 * RANGES)).first()[0]))
                # a bound is a range of its own, as it may be very frequent: ranges are 1, 3, ..., bounds 2, 4, ...
                place = sum(((F.col("x") >= b).cast("int") + (F.col("x") > b).cast("int") for b in bounds), F.lit(1))
                counts = sorted(left.groupBy(place.alias("place")).count().collect())  # a row a range
                for k, c in counts:
                    if rank - before < c:
                        low, high = (bounds[k // 2 - 1],) * 2 if k % 2 == 0 else (bounds[k // 2 - 1] if k > 1 else None, bounds[k // 2] if k // 2 < len(bounds) else None)
                        break
                    before += c
                inside = F.col("x") == F.lit(low) if k % 2 == 0 else F.lit(True) if low is None else F.col("x") > F.lit(low)
                left, n, least, most = known(left.where(inside if k % 2 == 0 or high is None else inside & (F.col("x") < F.lit(high))))
                last = before, left, n, least, most
                continue
            break
    return out


def median(rows: DataFrame, value: str | Column) -> float | None:
    """The exact median, the mean of the middle two for an even number; None without values."""
    n = rows.select((F.col(value) if isinstance(value, str) else value).alias("x")).agg(F.count("x")).first()[0]
    if not n:
        return None
    low, high = ranked_values(rows, value, [(n - 1) // 2, n // 2]) if n % 2 == 0 else ranked_values(rows, value, [n // 2]) * 2
    return (low + high) / 2


def latency(timings: DataFrame) -> DataFrame:
    """Exact medians of encode, search and their sum."""
    found = [median(timings, v) for v in ("encode_ms", "search_ms", F.col("encode_ms") + F.col("search_ms"))]
    return timings.sparkSession.createDataFrame([tuple(found)], "encode_ms double, search_ms double, total_ms double")


def seconds_left(rows: int, fetched_a_second: float, encoded_a_second: float) -> float:
    """What a build of ``rows`` rows takes where fetching and encoding follow each other."""
    return rows / fetched_a_second + rows / encoded_a_second


def report(systems: dict[str, DataFrame], order: list[str] | None = None) -> DataFrame:
    """(system, bucket, precision_at_k, recall_at_k, mrr, n) of scored queries, all of them (bucket 'all') and by bucket."""
    out = None
    for name, scored in systems.items():
        rows = summarize(scored).withColumn("bucket", F.lit("all")).unionByName(by_bucket(scored, order)).withColumn("system", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("system", "bucket", "precision_at_k", "recall_at_k", "mrr", "n")


def build_pool(arms: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """Candidates of each query over all arms (query_id, arm, rank, photo_id): arms, best rank, position.

    More arms first, then the better rank, then the id.
    """
    pooled = arms.groupBy("query_id", "photo_id").agg(F.array_sort(F.collect_set("arm")).alias("arms"), F.min("rank").alias("best_rank"))
    place = Window.partitionBy("query_id").orderBy(F.size("arms").desc(), "best_rank", "photo_id")
    out = pooled.withColumn("position", F.row_number().over(place))
    return out if captions is None else out.join(captions, "photo_id", "left")


#: Columns of a contact sheet, a cell's width and height, the space between cells, the height of the heading.
SHEET_COLUMNS, CELL, PAD, HEADING = 6, (208, 156), 6, 34


def sheet_places(pool: DataFrame) -> DataFrame:
    """``pool`` with each candidate's column, row and upper left corner (x, y) on its query's contact sheet."""
    at = (F.col("position") - 1).cast("long")
    column, row = F.pmod(at, F.lit(SHEET_COLUMNS)), F.floor(at / SHEET_COLUMNS)
    return pool.withColumns({"sheet_column": column, "sheet_row": row, "x": PAD + column * (CELL[0] + PAD), "y": HEADING + row * (CELL[1] + PAD)})


def sheet_sizes(pool: DataFrame) -> DataFrame:
    """(query_id, width, height) of each query's contact sheet."""
    rows = F.ceil(F.count("*") / SHEET_COLUMNS)
    return pool.groupBy("query_id").agg(F.lit(SHEET_COLUMNS * (CELL[0] + PAD) + PAD).alias("width"), (HEADING + rows * (CELL[1] + PAD) + PAD).alias("height"))


def arm_initials(arms: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(arms, lambda a: F.substring(a, 1, 1)))), "")


def pool_totals(pool: DataFrame, judgments: DataFrame) -> DataFrame:
    """Candidates, judged and relevant items."""
    return pool.agg(F.count("*").alias("candidates")).crossJoin(judgments.agg(F.coalesce(F.sum(F.size("judged")), F.lit(0)).alias("judged"), F.coalesce(F.sum(F.size("relevant")), F.lit(0)).alias("relevant")))


def record(pool: DataFrame, judgments: DataFrame, query_id: str, positions: list[int]) -> DataFrame:
    """Judge one query's candidates: those at ``positions`` are relevant; an earlier judgment is replaced."""
    own = pool.where(F.col("query_id") == query_id)
    most = own.count()
    if wrong := [p for p in positions if not 1 <= p <= most]:
        raise ValueError(f"no candidates {wrong}; there are {most}")
    listed = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["photo_id"])  # noqa: E731  one query's pool
    entry = F.struct("position", "photo_id")
    new = own.groupBy("query_id").agg(listed(entry).alias("judged"), listed(F.when(F.col("position").isin(positions), entry)).alias("relevant"))
    return judgments.select("query_id", "judged", "relevant").where(F.col("query_id") != query_id).unionByName(new)


def status(pool: DataFrame, judgments: DataFrame) -> DataFrame:
    """Each query's candidates, and how many are judged and relevant so far."""
    n = pool.groupBy("query_id").agg(F.count("*").alias("candidates"))
    done = judgments.select("query_id", F.size("judged").alias("judged"), F.size("relevant").alias("relevant"))
    return n.join(done, "query_id", "left").select("query_id", "candidates", F.coalesce("judged", F.lit(0)).alias("judged"), F.coalesce("relevant", F.lit(0)).alias("relevant"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two stores' hits (probe, photo_id, score): largest gap of a shared id's scores, mean overlap."""
    ids = lambda t, n: t.groupBy("probe").agg(F.collect_set("photo_id").alias(n))  # noqa: E731  k a probe
    overlap = ids(a, "x").join(ids(b, "y"), "probe", "full_outer").select((F.size(F.array_intersect(F.coalesce("x", F.array().cast("array<string>")), F.coalesce("y", F.array().cast("array<string>")))) / F.greatest(F.coalesce(F.size("x"), F.lit(0)), F.lit(1))).alias("overlap"))
    both = a.select("probe", "photo_id", F.col("score").alias("s")).join(b.select("probe", "photo_id", F.col("score").alias("t")), ["probe", "photo_id"])
    gap = both.agg(F.coalesce(F.max(F.abs(F.col("s") - F.col("t"))), F.lit(0.0)).alias("max_gap"))
    return gap.crossJoin(overlap.agg(F.coalesce(F.avg("overlap"), F.lit(0.0)).alias("mean_overlap")))


def encoder_agreement(pairs: DataFrame, a: Column, b: Column, top_a: Column, top_b: Column) -> DataFrame:
    """Two encoders on the same texts: least and mean cosine of their vectors, overlap and first-hit agreement."""
    from ..functions.vector import cosine

    return pairs.agg(F.min(cosine(a, b)).alias("min_cosine"), F.avg(cosine(a, b)).alias("mean_cosine"), F.avg(F.size(F.array_intersect(top_a, top_b)) / F.greatest(F.size(top_a), F.lit(1))).alias("overlap"), F.avg((F.get(top_a, F.lit(0)) == F.get(top_b, F.lit(0))).cast("double")).alias("top_1"))
