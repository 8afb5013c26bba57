"""The driver queries of the retrieval operators, each with the DuckDB SQL of the same result.

Scores are rounded to six digits: they are sums of doubles in an order that engines choose. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exif, text, vector
from ..operators import bm25, evaluate, library, search
from ..operators.filters import FilterSpec, has_any_number, under_root
from ..operators.store import check_half_precision, random_probes, verify
from . import views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


# ---- the views in DuckDB ----


def _clean(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"


def _positive_number(x: str) -> str:
    n = f"try_cast(nullif(regexp_extract({_clean(x)}, '[-+]?\\d*\\.?\\d+'), '') as double)"
    return f"case when {n} > 0 then {n} end"


def _whole(x: str) -> str:
    return f"case when regexp_matches({x}, '^\\s*[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?\\s*$') then try_cast(trim({x}) as double) end"


def _exposure(x: str) -> str:
    t = f"trim(regexp_replace({_clean(x)}, '[sS]+$', ''))"
    num, den = _whole(f"split_part({t}, '/', 1)"), _whole(f"split_part({t}, '/', 2)")
    v = f"(case when contains({t}, '/') then ({num}) / nullif({den}, 0) else {_whole(t)} end)"
    return f"case when {v} > 0 then {v} end"


def _model(x: str) -> str:
    return f"regexp_replace({_clean(x)}, '\\s+', ' ', 'g')"


def _make(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({_model(x)}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda t: upper(t[1]) || lower(t[2:])), '')"


_RAW = "select " + ", ".join(f"{sql} as {name}" for name, sql in views.RAW.items()) + " from embeddings left join part on p_partkey = vec_id"
_TYPED = {
    "aperture": _positive_number("exif_aperture_value"),
    "focal_length": _positive_number("exif_focal_length"),
    "exposure_s": _exposure("exif_exposure_time"),
    "iso": f"cast(round_even({_positive_number('exif_iso')}, 0) as integer)",
    "camera_make": f"case when {_clean('exif_camera_make')} is not null then {_make('exif_camera_make')} end",
    "camera_model": _model("exif_camera_model"),
}
_CORPUS = f"with raw as ({_RAW}), corpus as (select raw.*, " + ", ".join(f"{sql} as {n}" for n, sql in _TYPED.items()) + " from raw)"
_FULL = "coalesce(nullif(concat_ws(' ', " + _clean("photographer_first_name") + ", " + _clean("photographer_last_name") + "), ''), 'Unknown')"
_RESULT = f"photo_id, round(score, 6) as score, photo_image_url, photo_url, {_FULL} as photographer, photo_width as width, photo_height as height, blur_hash, photo_description as description, ai_description, aperture, focal_length, exposure_s, iso, camera_make, camera_model"
_DOT = "list_inner_product(cast({} as double[]), cast({} as double[]))"
_QUERY = "(select embedding from embeddings where vec_id = {})"
_MANY = f"{_CORPUS}, q as (select cast(vec_id as varchar) as query_id, 'b' || label as bucket, label, embedding as query from embeddings where vec_id % 50 = 0)"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


# ---- exact search, filters, similar ----


def _search(k: int, spec: FilterSpec) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = views.corpus(spark, sf_dir)
        return _rounded(search.search(rows, search.stored_vector(rows, "0"), k, spec), "score")

    return run


def _search_sql(k: int, where: str) -> str:
    return f"{_CORPUS}, s as (select *, {_DOT.format('embedding', _QUERY.format(0))} as score from corpus where {where}) select {_RESULT} from s order by s.score desc, photo_id limit {k}"


for _name, _k, _spec, _where in (
    ("ret1_search", 12, FilterSpec(), "true"),
    ("ret1_search_page", 30, FilterSpec(), "true"),
    ("flt1_aperture", 10, FilterSpec(aperture_max=5.6), "aperture <= 5.6"),
    ("flt2_iso", 10, FilterSpec(iso_max=800), "iso <= 800"),
    ("flt3_focal_min", 10, FilterSpec(focal_min=35), "focal_length >= 35"),
    ("flt4_focal_max", 10, FilterSpec(focal_max=50), "focal_length <= 50"),
    ("flt5_make", 10, FilterSpec(camera_make=" BRAND#13 o'neil-corp "), "lower(camera_make) = 'brand#13 o''neil-corp'"),
    ("flt6_combined", 10, FilterSpec(11, 3200, 10, 80), "aperture <= 11 and iso <= 3200 and focal_length >= 10 and focal_length <= 80"),
    ("flt8_empty", 10, FilterSpec(aperture_max=0.1), "aperture <= 0.1"),
    ("top1_none", 0, FilterSpec(), "true"),
    ("top1_all", 5000, FilterSpec(), "true"),
):
    _add(_name, _search(_k, _spec), _search_sql(_k, _where))


def _similar(spec: FilterSpec) -> Query:
    return lambda spark, sf_dir: _rounded(search.similar(views.corpus(spark, sf_dir), "3", 12, spec), "score")


for _name, _spec, _where in (("ret4_similar", FilterSpec(), "true"), ("ret4_similar_filtered", FilterSpec(aperture_max=8), "aperture <= 8")):
    _add(_name, _similar(_spec), f"{_CORPUS}, s as (select *, {_DOT.format('embedding', _QUERY.format(3))} as score from corpus where photo_id <> '3' and {_where}) select {_RESULT} from s order by s.score desc, photo_id limit 12")


def _many(spark: SparkSession, sf_dir: str, k: int = 10, spec: FilterSpec = FilterSpec()) -> DataFrame:
    return search.search_many(views.corpus(spark, sf_dir), views.query_vectors(spark, sf_dir).select("query_id", "query"), k, spec)


_RANKED = f"{_MANY}, ranked as (select query_id, photo_id, score, row_number() over (partition by query_id order by score desc, photo_id) as rank from (select query_id, photo_id, {_DOT.format('embedding', 'query')} as score from corpus, q) qualify rank <= 10)"
_add("win3_batch", lambda s, d: _rounded(_many(s, d), "score"), f"{_RANKED} select query_id, cast(rank as integer) as rank, photo_id, round(score, 6) as score from ranked")
_add("win3_batch_filtered", lambda s, d: _rounded(_many(s, d, 5, FilterSpec(iso_max=2000)), "score"), f"{_MANY} select query_id, cast(row_number() over (partition by query_id order by score desc, photo_id) as integer) as rank, photo_id, round(score, 6) as score from (select query_id, photo_id, {_DOT.format('embedding', 'query')} as score from corpus, q where iso <= 2000) qualify rank <= 5")
_add("win2_first_hit", lambda s, d: _many(s, d).join(views.qrels(s, d), ["query_id", "photo_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank")), f"{_RANKED} select query_id, cast(min(rank) as integer) as first_rank from ranked join q using (query_id) join corpus c using (photo_id) where c.label = q.label and q.label <> 7 and photo_id <> query_id group by query_id")


def _best_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best image of each text, all texts against all images."""
    best = search.best_image_per_text(_many(spark, sf_dir, 3).drop("rank"), "query_id", "photo_id").where("best")
    return _rounded(best.drop("best"), "score")


_add("ret15_text_image_table", _best_images, f"{_RANKED} select query_id, photo_id, round(score, 6) as score from ranked where rank = 1")

# ---- counts, reports, integrity ----

_ANY = "coalesce(aperture, iso, focal_length) is not null"
_SIX = "coalesce(cast(aperture as varchar), cast(iso as varchar), cast(focal_length as varchar), cast(exposure_s as varchar), camera_make, camera_model) is not null"
_add("agg123_counts", lambda s, d: search.counts(views.corpus(s, d)), f"{_CORPUS} select count(*) as indexed, count(*) filter ({_ANY}) as exif_count, count(*) filter ({_SIX}) as metadata_count from corpus")
_REPORT = " union all ".join(f"select '{c}' as field, count({c}) as filled, round(count({c}) * 100.0 / count(*), 4) as percent, {f'cast(min({c}) as double)' if c in ('aperture', 'focal_length', 'exposure_s', 'iso') else 'cast(null as double)'} as least, {f'cast(max({c}) as double)' if c in ('aperture', 'focal_length', 'exposure_s', 'iso') else 'cast(null as double)'} as greatest, {'count(*) filter (aperture <= 1.8)' if c == 'aperture' else 'cast(null as bigint)'} as at_most_1_8 from corpus" for c in ("aperture", "focal_length", "exposure_s", "iso", "camera_make", "camera_model"))
_add("ret12_quality_report", lambda s, d: search.quality_report(views.corpus(s, d)), f"{_CORPUS} {_REPORT}")
_add("agg6_top_makes", lambda s, d: library.top_makes(views.corpus(s, d)), f"{_CORPUS} select camera_make, count(*) as photos from corpus where camera_make is not null group by camera_make order by photos desc, camera_make limit 5")
_add("jn1_integrity", lambda s, d: search.integrity(views.corpus(s, d).where("vec_id % 7 <> 0"), views.corpus(s, d).where("vec_id % 5 <> 0")), f"{_CORPUS}, a as (select photo_id from corpus where vec_id % 7 <> 0), b as (select photo_id from corpus where vec_id % 5 <> 0) select count(*) filter (b.photo_id is null) as only_left, count(*) filter (a.photo_id is null) as only_right, cast(0 as bigint) as repeated_left, cast(0 as bigint) as repeated_right from a full join b on a.photo_id = b.photo_id")
_add("flt13_any_number", lambda s, d: views.corpus(s, d).where(has_any_number()).select("photo_id"), f"{_CORPUS} select photo_id from corpus where {_ANY}")
_add("map1_has_exif", lambda s, d: search.metadata(views.corpus(s, d)).select("photo_id", F.size("fields").alias("n_fields"), F.try_element_at("fields", F.lit("camera_make")).alias("make"), "has_exif"), f"{_CORPUS} select photo_id, cast((aperture is not null)::int + (iso is not null)::int + (focal_length is not null)::int + (exposure_s is not null)::int + (camera_make is not null)::int + (camera_model is not null)::int as integer) as n_fields, lower(trim(camera_make)) as make, {_SIX} as has_exif from corpus")
_add("vec2_norms", lambda s, d: views.corpus(s, d).agg(F.round(F.max(vector.norm_error(F.col("embedding"))), 5).alias("max_norm_error"), F.round(F.min(vector.cosine(F.col("embedding"), vector.normalise(F.col("embedding")))), 6).alias("min_cosine")), "select round(max(abs(sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) - 1)), 5) as max_norm_error, 1.0::double as min_cosine from embeddings")

# ---- camera strings ----

_add("str3_to_8_exif", lambda s, d: views.corpus(s, d).select("photo_id", "aperture", "focal_length", "exposure_s", "iso", "camera_make", "camera_model"), f"{_CORPUS} select photo_id, aperture, focal_length, exposure_s, iso, camera_make, camera_model from corpus")
_add("prj2_display_rows", lambda s, d: views.corpus(s, d).select(*(c for c in search.result_columns(F.lit(0.5)))).drop("score"), f"{_CORPUS} select {_RESULT.replace('round(score, 6) as score, ', '')} from corpus")
_add("prj3_photographer", lambda s, d: views.corpus(s, d).select("photo_id", text.photographer(None, F.col("photographer_first_name"), F.col("photographer_last_name")).alias("photographer"), text.slim_photographer(F.col("photographer_first_name"), F.col("photographer_last_name")).alias("slim_photographer")), f"{_CORPUS} select photo_id, {_FULL} as photographer, coalesce({_clean("coalesce(photographer_first_name, '') || ' ' || coalesce(photographer_last_name, '')")}, 'Unknown') as slim_photographer from corpus")


def _taken_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views._read(spark, sf_dir, "orders")
    stamp = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 7 == 2, F.lit("0000:00:00 00:00:00")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return raw.select("o_orderkey", exif.parse_taken_at(stamp).alias("taken_at"))


_add("dat1_taken_at", _taken_at, "select o_orderkey, case when o_orderkey % 3 < 2 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as taken_at from orders")
_add("arr1_rationals", lambda s, d: views._read(s, d, "part").select("p_partkey", exif.rational(F.when(F.col("p_size") % 3 == 0, F.array(F.lit(1.0), F.col("p_size").cast("double"))).when(F.col("p_size") % 3 == 1, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.col("p_size").cast("double")))).alias("value")), "select p_partkey, case when p_size % 3 = 0 then 1.0::double / p_size when p_size % 3 = 2 then p_size::double end as value from part")

# ---- text functions ----

_TOKENS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: length(t) > 1)"
_add("str9_tokenize", lambda s, d: views.captions(s, d).select("doc_id", F.size(text.tokenize(F.col("text"))).alias("n_tokens"), F.md5(F.array_join(text.tokenize(F.col("text")), " ")).alias("tokens_md5")), f"select doc_id, cast(len({_TOKENS}) as integer) as n_tokens, md5(array_to_string({_TOKENS}, ' ')) as tokens_md5 from documents")
_add("str11_photo_id", lambda s, d: views._read(s, d, "documents").selectExpr("doc_id", f"{views.PATH} as path").select("doc_id", text.photo_id_for(F.col("path")).alias("photo_id")), f"select doc_id, substr(sha1({views.PATH}), 1, 16) as photo_id from documents")


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views._read(spark, sf_dir, "part")
    listed = F.concat(F.col("p_size").cast("string"), F.lit(", 3,"), (F.col("p_partkey") % 9).cast("string"), F.lit("-"), (F.col("p_partkey") % 12).cast("string"))
    return raw.select("p_partkey", F.array_join(F.transform(text.parse_numbers(listed), lambda x: x.cast("string")), " ").alias("numbers"))


_add("str13_numbers", _numbers, "select p_partkey, array_to_string(list_sort(list_distinct([p_size, 3] || case when p_partkey % 9 <= p_partkey % 12 then range(cast(p_partkey % 9 as integer), cast(p_partkey % 12 + 1 as integer)) else [] end)), ' ') as numbers from part")
_add("str10_19_captions", lambda s, d: views.corpus(s, d).select("photo_id", text.caption(F.col("ai_description"), F.col("photo_description")).alias("caption"), text.short_caption(F.col("ai_description"), F.col("photo_description"), 12).alias("short")), f"{_CORPUS} select photo_id, coalesce(ai_description, '') || ' ' || coalesce(photo_description, '') as caption, substr(coalesce(nullif(ai_description, ''), nullif(photo_description, ''), ''), 1, 12) as short from corpus")
_add("str16_escape_html", lambda s, d: views._read(s, d, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("escaped_md5")), "select page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) as escaped_md5 from pages")
_add("str17_urls", lambda s, d: views.corpus(s, d).select("photo_id", text.sized_url(F.col("photo_image_url"), 640).alias("sized"), text.credited_url(F.col("photo_url"), "app").alias("credited"), text.sized_url(F.concat(F.lit("/api/"), "photo_id"), 640).alias("local")), f"{_CORPUS} select photo_id, photo_image_url || case when contains(photo_image_url, '?') then '&' else '?' end || 'w=640&q=80&fm=jpg' as sized, photo_url || '?utm_source=app&utm_medium=referral' as credited, '/api/' || photo_id as local from corpus")
_add("mth7_aspect", lambda s, d: views.corpus(s, d).select("photo_id", text.aspect(F.col("photo_width"), F.nullif(F.col("photo_height"), F.lit(3000))).alias("aspect")), f"{_CORPUS} select photo_id, coalesce(case when photo_height <> 3000 then greatest(40.0::double, least(160.0::double, photo_height * 100.0::double / photo_width)) end, 66.7::double) as aspect from corpus")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _many(spark, sf_dir)
    best = Window.partitionBy("query_id")
    return hits.select("query_id", "rank", text.verdict(F.round("score", 6)).alias("verdict"), text.score_text(F.round("score", 2)).alias("score_text"), (F.max(F.round("score", 6)).over(best) < text.WEAK_PAGE).alias("weak_page"))


_add("mth5_6_verdicts", _verdicts, f"{_RANKED} select query_id, cast(rank as integer) as rank, case when round(score, 6) >= 0.28 then 'strong' when round(score, 6) >= 0.24 then 'decent' else 'weak' end as verdict, regexp_replace(printf('%.3f', round(score, 2)), '^0', '') as score_text, max(round(score, 6)) over (partition by query_id) < 0.26 as weak_page from ranked")
_add("str14_15_lines", lambda s, d: views.corpus(s, d).select("photo_id", text.shutter(F.col("exposure_s")).alias("shutter"), text.exif_line(F.col("camera_make"), F.col("camera_model"), F.col("focal_length"), F.col("aperture"), F.col("exposure_s"), F.col("iso")).alias("line")), f"{_CORPUS}, t as (select *, case when exposure_s >= 1 then regexp_replace(regexp_replace(printf('%.9f', exposure_s), '0+$', ''), '\\.$', '') || 's' when exposure_s > 0 then '1/' || cast(round_even(1 / exposure_s, 0) as integer) || 's' end as shutter from corpus) select photo_id, shutter, concat_ws(' · ', {_clean("concat_ws(' ', camera_make, camera_model)")}, regexp_replace(regexp_replace(printf('%.9f', focal_length), '0+$', ''), '\\.$', '') || 'mm', 'f/' || regexp_replace(regexp_replace(printf('%.9f', aperture), '0+$', ''), '\\.$', ''), shutter, 'ISO ' || iso) as line from t")
_PLAIN = "regexp_replace(regexp_replace(printf('%.9f', {}), '0+$', ''), '\\.$', '')"


def _cli_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.corpus(spark, sf_dir)
    found = search.search(rows, search.stored_vector(rows, "0"), 10)
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "photo_id"))  # ten rows
    return found.withColumn("rank", rank).select("photo_id", text.cli_line(F.col("rank"), F.round("score", 2), F.col("photographer"), F.col("focal_length"), F.col("aperture"), F.col("iso")).alias("line"))


_add("prj9_cli_lines", _cli_lines, f"{_CORPUS}, s as (select *, {_DOT.format('embedding', _QUERY.format(0))} as score, {_FULL} as who from corpus), t as (select *, row_number() over (order by score desc, photo_id) as rank from s qualify rank <= 10) select photo_id, lpad(cast(rank as varchar), 2, ' ') || '  ' || printf('%.3f', round(score, 2)) || '  ' || rpad(substr(who, 1, 22), 22, ' ') || '  ' || concat_ws(' ', 'f/' || {_PLAIN.format('aperture')}, {_PLAIN.format('focal_length')} || 'mm', 'ISO' || iso) as line from t")

# ---- BM25 ----



def _bm25_sql(docs: str, asked: str, n: str = "") -> str:
    """CTEs of BM25: docs gives (key, text), asked (query_id, text); {n}s is (query_id, key, score)."""
    return f"""{n}d as (select key, {_TOKENS} as tokens from ({docs})), {n}n as (select count(*) as n, avg(len(tokens)) as average from {n}d),
{n}qt as (select query_id, term, count(*) as times from (select query_id, unnest({_TOKENS}) as term from ({asked})) group by all),
{n}p as (select key, length, term, count(*) as f from (select key, len(tokens) as length, unnest(tokens) as term from {n}d) group by all),
{n}df as (select term, count(*) as df from {n}p group by term),
{n}raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from {n}df, {n}n), {n}idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from {n}raw) else raw end as idf from {n}raw),
{n}s as (select query_id, key, sum(times * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * length / average))) as score from {n}p join {n}qt using (term) join {n}idf using (term), {n}n group by all)"""


_BM25 = "with " + _bm25_sql("select doc_id as key, text from documents", "select cast(item_id as varchar) as query_id, text from benchmark")
_BEST = "row_number() over (partition by query_id order by round(score, 9) desc, key)"
_add("ret6_bm25", lambda s, d: _rounded(bm25.search_index(views.text_index(s, d), views.keyword_queries(s, d), 10), "score").withColumnRenamed("key", "doc_id"), f"{_BM25} select query_id, cast({_BEST} as integer) as rank, key as doc_id, round(score, 6) as score from s where score > 0 qualify rank <= 10")
_add("agg19_vocabulary", lambda s, d: views.text_index(s, d).terms.select("term", "df", F.round("idf", 6).alias("idf")), f"{_BM25} select term, df, round(idf, 6) as idf from idf")


def _changed_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The index of all documents but every seventh, every ninth of the rest taken out and the sevenths added."""
    docs = views.captions(spark, sf_dir)
    made = bm25.build_index(docs.where("doc_id % 7 <> 0"), "doc_id", F.col("text"))
    return bm25.changed_index(made, "doc_id", F.col("text"), docs.where("doc_id % 7 = 0"), docs.where("doc_id % 9 = 0 and doc_id % 7 <> 0").select("doc_id"))


_CHANGED = "with " + _bm25_sql("select doc_id as key, text from documents where doc_id % 7 = 0 or doc_id % 9 <> 0", "select cast(item_id as varchar) as query_id, text from benchmark")
_add("agg19_changed", lambda s, d: _changed_index(s, d).terms.select("term", "df", F.round("idf", 6).alias("idf")), f"{_CHANGED} select term, df, round(idf, 6) as idf from idf")
_add("ret6_changed", lambda s, d: _rounded(bm25.search_index(_changed_index(s, d), views.keyword_queries(s, d), 10), "score").withColumnRenamed("key", "doc_id"), f"{_CHANGED} select query_id, cast({_BEST} as integer) as rank, key as doc_id, round(score, 6) as score from s where score > 0 qualify rank <= 10")
_add("agg9_statistics", lambda s, d: _rounded(bm25.statistics(views.captions(s, d), F.col("text")), "average_length"), f"select count(*) as documents, count(*) filter (len(tokens) = 0) as empty_documents, round(avg(len(tokens)), 6) as average_length from (select {_TOKENS} as tokens from documents)")

# ---- evaluation ----


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_queries(_many(spark, sf_dir), views.query_vectors(spark, sf_dir).select("query_id", "bucket"), views.qrels(spark, sf_dir), 10)


_SCORED = f"""{_RANKED}, rel as (select query_id, photo_id from q join corpus c on c.label = q.label where q.label <> 7 and photo_id <> query_id),
nrel as (select query_id, count(*) as n from rel group by query_id), h as (select r.query_id, r.rank, rel.photo_id is not null as hit from ranked r left join rel on rel.query_id = r.query_id and rel.photo_id = r.photo_id),
scored as (select q.query_id, q.bucket, count(*) filter (hit) / 10.0::double as precision, coalesce(count(*) filter (hit) / any_value(n)::double, 0) as recall, coalesce(1.0::double / min(rank) filter (hit), 0) as reciprocal_rank, coalesce(any_value(n), 0) as n_relevant, array_to_string(list(cast(hit as varchar) order by rank), ',') as flags from q left join h using (query_id) left join nrel using (query_id) group by q.query_id, q.bucket)"""
_MEANS = "round(coalesce(avg(precision), 0), 6) as precision_at_k, round(coalesce(avg(recall), 0), 6) as recall_at_k, round(coalesce(avg(reciprocal_rank), 0), 6) as mrr, count(*) as n"
_RATES, _MEAN_NAMES = ("precision", "recall", "reciprocal_rank"), ("precision_at_k", "recall_at_k", "mrr")
_add("ret8_per_query", lambda s, d: _rounded(_scored(s, d), *_RATES).withColumn("hits", F.array_join(F.transform("hits", lambda x: x.cast("string")), ",")), f"{_SCORED} select query_id, bucket, round(precision, 6) as precision, round(recall, 6) as recall, round(reciprocal_rank, 6) as reciprocal_rank, n_relevant, flags as hits from scored")
_add("agg11_summary", lambda s, d: _rounded(evaluate.summarize(_scored(s, d)), *_MEAN_NAMES), f"{_SCORED} select {_MEANS} from scored")
_add("agg12_by_bucket", lambda s, d: _rounded(evaluate.by_bucket(_scored(s, d), [f"b{k}" for k in range(9, -1, -1)]), *_MEAN_NAMES), f"{_SCORED} select bucket, {_MEANS} from scored group by bucket")
_add("top4_worst", lambda s, d: _rounded(evaluate.worst(_scored(s, d).drop("hits")), *_RATES), f"{_SCORED} select query_id, bucket, round(precision, 6) as precision, round(recall, 6) as recall, round(reciprocal_rank, 6) as reciprocal_rank, n_relevant from scored order by scored.precision, scored.reciprocal_rank, query_id limit 5")


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = views.qrels(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list("photo_id")).alias("relevant"))
    return views.query_vectors(spark, sf_dir).select("query_id").join(listed, "query_id", "left").select("query_id", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant")).withColumn("judged", F.col("relevant"))


_add("flt16_unanswerable", lambda s, d: evaluate.drop_unanswerable(_judgments(s, d))[1].select("query_id"), "select cast(vec_id as varchar) as query_id from embeddings where vec_id % 50 = 0 and label = 7")


def _caption_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return bm25.search_index(views.caption_index(spark, sf_dir), views.caption_queries(spark, sf_dir), k).withColumnRenamed("key", "photo_id")


def _gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword = evaluate.score_queries(_caption_hits(spark, sf_dir), views.query_vectors(spark, sf_dir).select("query_id", "bucket"), views.qrels(spark, sf_dir), 10)
    gap = _rounded(evaluate.gap(_scored(spark, sf_dir), keyword), *_MEAN_NAMES)
    return gap.withColumns({n: F.col(n) + 0.0 for n in _MEAN_NAMES})  # no negative zero


_CAPTIONS = _bm25_sql("select photo_id as key, coalesce(ai_description, '') || ' ' || coalesce(photo_description, '') as text from corpus", "select photo_id as query_id, coalesce(ai_description, '') || ' ' || coalesce(photo_description, '') as text from corpus where vec_id % 50 = 0", "b")
_HITS_B = f"select query_id, key as photo_id, {_BEST} as rank from bs where score > 0"
_add("ret16_gap", _gap, f"""{_SCORED}, {_CAPTIONS}, branked as ({_HITS_B} qualify rank <= 10),
bh as (select r.query_id, r.rank, rel.photo_id is not null as hit from branked r left join rel on rel.query_id = r.query_id and rel.photo_id = r.photo_id),
bscored as (select q.query_id, count(*) filter (hit) / 10.0::double as precision, coalesce(count(*) filter (hit) / any_value(n)::double, 0) as recall, coalesce(1.0::double / min(rank) filter (hit), 0) as reciprocal_rank from q left join bh using (query_id) left join nrel using (query_id) group by q.query_id)
select round(a.p - b.p, 6) + 0.0::double as precision_at_k, round(a.r - b.r, 6) + 0.0::double as recall_at_k, round(a.m - b.m, 6) + 0.0::double as mrr from (select avg(precision) as p, avg(recall) as r, avg(reciprocal_rank) as m from scored) a, (select avg(precision) as p, avg(recall) as r, avg(reciprocal_rank) as m from bscored) b""")


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = views._read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("encode_ms"), (F.col("l_extendedprice") / 100).alias("search_ms"))
    return _rounded(evaluate.latency(timings), "encode_ms", "search_ms", "total_ms")


_add("agg13_latency", _latency, "select round(median(l_quantity), 6) as encode_ms, round(median(l_extendedprice / 100), 6) as search_ms, round(median(l_quantity + l_extendedprice / 100), 6) as total_ms from lineitem")


def _rephrased(spark: SparkSession, sf_dir: str, change) -> DataFrame:
    """Other vectors of the same queries, in place of an encoder's answer to other words."""
    return views.query_vectors(spark, sf_dir).select("query_id", F.transform("query", change).alias("query"))


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth, rows = evaluate.DEPTHS, views.corpus(spark, sf_dir)
    changes = (lambda x, i: F.when(i % 4 == 0, F.lit(0.0)).otherwise(x.cast("double")), lambda x, i: F.when(i % 2 == 0, x.cast("double")).otherwise(-x.cast("double")))
    arms = [("clip", _many(spark, sf_dir, depth["clip"])), *((f"rephrasing{n}", search.search_many(rows, _rephrased(spark, sf_dir, c), depth["rephrasing"])) for n, c in enumerate(changes, 1)), ("bm25", _caption_hits(spark, sf_dir, depth["bm25"]))]
    out = None
    for name, found in arms:
        found = found.select("query_id", F.lit(name).alias("arm"), F.col("rank").cast("int").alias("rank"), "photo_id")
        out = found if out is None else out.unionByName(found)
    return out


def _arm_sql(query: str, k: int) -> str:
    return f"select query_id, photo_id, row_number() over (partition by query_id order by score desc, photo_id) as rank from (select query_id, photo_id, {_DOT.format('embedding', query)} as score from corpus, q) qualify rank <= {k}"


_POOL = f"""{_MANY}, {_CAPTIONS}, base as ({_arm_sql('query', 12)}),
arms as (select query_id, 'clip' as arm, rank, photo_id from base union all select query_id, 'rephrasing1', rank, photo_id from ({_arm_sql('list_transform(cast(query as double[]), lambda x, i: case when i % 4 = 1 then 0.0::double else x end)', 6)})
union all select query_id, 'rephrasing2', rank, photo_id from ({_arm_sql('list_transform(cast(query as double[]), lambda x, i: case when i % 2 = 1 then x else -x end)', 6)}) union all select query_id, 'bm25', rank, photo_id from ({_HITS_B} qualify rank <= 12)),
pool as (select query_id, photo_id, list_sort(list_distinct(list(arm))) as arms, min(rank) as best_rank from arms group by all)"""
_add("ret7_pool", lambda s, d: evaluate.build_pool(_arms(s, d)).withColumn("arms", F.array_join("arms", ",")), f"{_POOL} select query_id, photo_id, array_to_string(arms, ',') as arms, cast(best_rank as integer) as best_rank, cast(row_number() over (partition by query_id order by len(arms) desc, best_rank, photo_id) as integer) as position from pool")
_add("arr4_arm_initials", lambda s, d: evaluate.build_pool(_arms(s, d)).groupBy(evaluate.arm_initials(F.col("arms")).alias("initials")).agg(F.count("*").alias("n")), f"{_POOL} select array_to_string(list_sort(list_distinct(list_transform(arms, lambda a: a[1]))), '') as initials, count(*) as n from pool group by 1")
_add("agg18_totals", lambda s, d: evaluate.pool_totals(evaluate.build_pool(_arms(s, d)), _judgments(s, d)), f"{_POOL}, j as (select q.query_id, count(c.photo_id) filter (q.label <> 7 and c.photo_id <> q.query_id) as n from q left join corpus c on c.label = q.label group by q.query_id) select (select count(*) from pool) as candidates, cast(sum(n) as bigint) as judged, cast(sum(n) as bigint) as relevant from j")
_add("ret18_status", lambda s, d: evaluate.status(evaluate.build_pool(_arms(s, d)), _judgments(s, d)), f"{_POOL}, j as (select q.query_id, count(c.photo_id) filter (q.label <> 7 and c.photo_id <> q.query_id) as n from q left join corpus c on c.label = q.label group by q.query_id) select p.query_id, count(*) as candidates, cast(coalesce(any_value(n), 0) as integer) as judged, cast(coalesce(any_value(n), 0) as integer) as relevant from pool p left join j using (query_id) group by p.query_id")
_add("ret18_record", lambda s, d: evaluate.record(evaluate.build_pool(_arms(s, d)), _judgments(s, d), "50", [1, 4, 7]).select("query_id", F.size("judged").alias("judged"), F.array_join("relevant", ",").alias("relevant")), f"""{_POOL}, ordered as (select *, row_number() over (partition by query_id order by len(arms) desc, best_rank, photo_id) as position from pool),
j as (select q.query_id, c.photo_id from q left join corpus c on c.label = q.label and q.label <> 7 and c.photo_id <> q.query_id)
select query_id, cast(count(*) as integer) as judged, array_to_string(list(photo_id order by position) filter (position in (1, 4, 7)), ',') as relevant from ordered where query_id = '50' group by query_id
union all select query_id, cast(count(photo_id) as integer), coalesce(array_to_string(list(photo_id order by photo_id) filter (photo_id is not null), ','), '') from j where query_id <> '50' group by query_id""")


def _probe_hits(spark: SparkSession, sf_dir: str, spec: FilterSpec) -> DataFrame:
    return _many(spark, sf_dir, 10, spec).select(F.col("query_id").alias("probe"), "photo_id", "score")


_OTHER = f"{_RANKED}, other as (select query_id, photo_id, row_number() over (partition by query_id order by score desc, photo_id) as rank from (select query_id, photo_id, {_DOT.format('embedding', 'query')} as score from corpus, q where iso <= 2000) qualify rank <= 10)"
_add("agg14_filtered_overlap", lambda s, d: _rounded(evaluate.parity(_probe_hits(s, d, FilterSpec()), _probe_hits(s, d, FilterSpec(iso_max=2000))), "max_gap", "mean_overlap"), f"{_OTHER} select 0.0::double as max_gap, round(avg(n / 10.0::double), 6) as mean_overlap from (select r.query_id, count(o.photo_id) as n from ranked r left join other o on o.query_id = r.query_id and o.photo_id = r.photo_id group by r.query_id)")
_add("set3_overlap", lambda s, d: _probe_hits(s, d, FilterSpec()).join(_probe_hits(s, d, FilterSpec(iso_max=2000)).drop("score"), ["probe", "photo_id"]).groupBy("probe").agg((F.count("*") / 10.0).alias("overlap")), f"{_OTHER} select query_id as probe, count(*) / 10.0::double as overlap from ranked join other using (query_id, photo_id) group by query_id")

# ---- incremental maintenance ----


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.plan_changes(views.scanned(spark, sf_dir), views.manifest(spark, sf_dir), "/root")


_ID = "substr(sha1(path), 1, 16) as photo_id"
_PLAN = f"""with scanned as (select *, {_ID} from (select {views.PATH} as path, cast(doc_id as double) as mtime, n_chars as size from documents where doc_id % 10 <> 3)),
docs as (select * from documents where doc_id % 10 <> 4), manifest as (select *, {_ID} from (select {views.PATH} as path, cast(doc_id as double) + case when doc_id % 10 = 5 then 5 when doc_id % 10 = 6 then 0.0005 else 0 end as mtime, n_chars + case when doc_id % 10 = 7 then 12 else 0 end as size from docs union all select '/rooted/' || cast(doc_id as varchar) || '.jpg', 1.0, 1 from docs where doc_id % 50 = 1)),
plan as (select photo_id, coalesce(s.path, m.path) as path, coalesce(s.mtime, m.mtime) as mtime, coalesce(s.size, m.size) as size, case when s.path is null then case when starts_with(m.path, '/root/') then 'deleted' end when m.path is null then 'new' when abs(s.mtime - m.mtime) > 1e-3 or s.size <> m.size then 'changed' else 'unchanged' end as action from scanned s full join manifest m using (photo_id))"""
_add("ret13_plan", _plan, f"{_PLAN} select photo_id, path, cast(mtime as double) as mtime, cast(size as bigint) as size, action from plan where action is not null")
_add("snk6_merged", lambda s, d: library.apply_plan(library.coerce_manifest(views.manifest(s, d)), _plan(s, d), library.coerce_manifest(library.library_rows(_plan(s, d).where("action in ('new', 'changed')").where("size % 3 <> 0")))).select("photo_id", "path", "mtime", "size", "photographer", "photo_description", "photo_width", "iso"), f"{_PLAN}, loaded as (select * from plan where action in ('new', 'changed') and size % 3 <> 0) select photo_id, path, cast(mtime as double) as mtime, cast(size as bigint) as size, split_part(path, '/', 3) as photographer, split_part(path, '/', 4) as photo_description, cast(0 as bigint) as photo_width, cast(null as integer) as iso from loaded union all select photo_id, path, cast(mtime as double), cast(size as bigint), null, null, 0, null from manifest where photo_id not in (select photo_id from loaded) and photo_id not in (select photo_id from plan where action = 'deleted')")
_add("ret14_stats", lambda s, d: library.stats(library.coerce_manifest(views.manifest(s, d).withColumn("iso", F.when(F.col("size") % 2 == 0, F.lit(100))))).withColumn("exif_share", F.round("exif_share", 6)), f"{_PLAN} select count(*) as photos, round(avg(cast(size % 2 = 0 as integer)), 6) as exif_share, count(distinct regexp_extract(path, '^(.*)/', 1)) as folders from manifest")
_add("flt14_under_root", lambda s, d: views.manifest(s, d).where(under_root(F.col("path"), "/root/")).agg(F.count("*").alias("n")), f"{_PLAN} select count(*) as n from manifest where starts_with(path, '/root/')")
_add("snk12_states", lambda s, d: library.file_states(views.scanned(s, d).withColumn("digest", F.col("size")), views.manifest(s, d).withColumn("digest", F.col("size"))).groupBy("state").agg(F.count("*").alias("n")), f"{_PLAN} select case when s.path is null then 'MISSING' when m.path is null then 'new' when s.size = m.size then 'same' else 'changed' end as state, count(*) as n from scanned s full join manifest m on s.path = m.path group by 1")

# ---- approximate store and encoders: no SQL says what they return ----


#: Least clusters probed, of as many as the square root of the rows; these vectors have little structure.
PROBE = 12
_PARITY_FILTERS = [FilterSpec(), FilterSpec(iso_max=3200), FilterSpec(aperture_max=8, focal_min=10)]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.query_vectors(spark, sf_dir).select("query_id", "query")


def _ranked_sql(k: int, where: str) -> str:
    scores = f"select query_id, photo_id, {_DOT.format('embedding', 'query')} as score from corpus, q where {where}"
    rank = "cast(row_number() over (partition by query_id order by score desc, photo_id) as integer)"
    return f"{_MANY} select query_id, {rank} as rank, photo_id, round(score, 6) as score from ({scores}) qualify rank <= {k}"


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = views.clustered_store(spark, sf_dir)
    return _rounded(store.search_many(_asked(spark, sf_dir), 10, FilterSpec(iso_max=3200), PROBE), "score")


def _certain(spec: FilterSpec) -> Query:
    """Probing that goes on until the hits are certain."""
    return lambda spark, sf_dir: _rounded(views.clustered_store(spark, sf_dir).search_many(_asked(spark, sf_dir), 10, spec, 4, certain=True), "score")


def _parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(verify(views.clustered_store(spark, sf_dir), views.corpus(spark, sf_dir), _asked(spark, sf_dir), _PARITY_FILTERS, 10, PROBE), "max_gap", "mean_overlap")


def _graph_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(verify(views.graph_store(spark, sf_dir), views.corpus(spark, sf_dir), _asked(spark, sf_dir), _PARITY_FILTERS, 10), "max_gap", "mean_overlap")


_add("ret2_certain", _certain(FilterSpec(iso_max=3200)), _ranked_sql(10, "iso <= 3200"))
_add("ret2_certain_make", _certain(FilterSpec(camera_make="Brand#13 O'Neil-Corp")), _ranked_sql(10, "lower(camera_make) = 'brand#13 o''neil-corp'"))
_add("ret2_graph", lambda s, d: _rounded(views.graph_store(s, d).search_many(_asked(s, d), 10, FilterSpec(iso_max=3200)), "score"))
_add("ret9_graph_parity", _graph_parity)
_ODD = "vec_id % 11 <> 3 and vec_id % 13 <> 5 and vec_id % 17 <> 7 and vec_id % 19 <> 9 and vec_id % 23 <> 4"
_add("jn2_odd_vectors", lambda s, d: _rounded(search.search_many(views.odd_corpus(s, d), _asked(s, d), 10), "score"), _ranked_sql(10, _ODD))

# ---- collections ----


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after a run, kept as a collection: deletions, then an upsert."""
    kept, plan = views.manifest_collection(spark, sf_dir), _plan(spark, sf_dir)
    kept.delete(plan.where("action = 'deleted'").select("photo_id"))
    kept.upsert(library.coerce_manifest(library.library_rows(plan.where("action in ('new', 'changed')").where("size % 3 <> 0"))))
    return kept.snapshot().select("photo_id", "path", "mtime", "size", "photographer", "photo_description", "photo_width", "iso")


_add("snk6_collection", _collected, _SQL["snk6_merged"])
_LOOKED_UP = ["photo_id", "photo_url", "aperture", "focal_length", "iso", "camera_make"]
_add("jn5_lookup", lambda s, d: views.photo_collection(s, d).lookups(["3", "77", "412", "none"]).select(*_LOOKED_UP), f"{_CORPUS} select {', '.join(_LOOKED_UP)} from corpus where photo_id in ('3', '77', '412', 'none')")


def _half(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.corpus(spark, sf_dir)
    return check_half_precision(rows, random_probes(spark, rows.select(F.size("embedding")).first()[0]))


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of all rows; first ten hits in full and half precision of the rows that are queries, null for the others."""
    rows = views.corpus(spark, sf_dir).select("photo_id", "embedding", vector.half_precision(F.col("embedding")).alias("half"))
    pairs = rows
    for name in ("embedding", "half"):
        queries_of = rows.join(views.query_vectors(spark, sf_dir).select("query_id"), F.col("photo_id") == F.col("query_id")).select("query_id", F.col(name).alias("query"))
        hits = search.search_many(rows.select("photo_id", F.col(name).alias("embedding")), queries_of, 10)
        top = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "photo_id"))), lambda x: x["photo_id"]).alias(f"top_{name}"))
        pairs = pairs.join(top.withColumnRenamed("query_id", "photo_id"), "photo_id", "left")
    return _rounded(evaluate.encoder_agreement(pairs, F.col("embedding"), F.col("half"), F.col("top_embedding"), F.col("top_half")), "min_cosine", "mean_cosine", "overlap", "top_1")


_add("ret2_clustered", _clustered)
_add("ret9_parity", _parity)
_add("ret10_half_precision", _half)
_add("ret11_encoder_agreement", _agreement)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
