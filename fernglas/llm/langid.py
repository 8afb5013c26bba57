"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: a multinomial model over hashed byte trigrams for each language, and a uniform one for "und", no known language.
  Trigrams of one text depend on each other, so the mean log likelihood counts for at most EFFECTIVE of them.
* Markup: the declared language is right with probability DECLARED.
* Address: a country suffix, or a language code as first label or path part, is right with probability SUFFIX.
* Host: how many texts of a host, of its domain and of all hosts each language has by text alone, by grouped aggregation;
  a host's shares are smoothed with its domain's, and those with the overall ones.

The model is fitted on at most SAMPLE labelled rows, chosen by a hash of their ids; all else covers every row. Texts are
scored in one pass, whose result (without the texts, unless they are to be carried) is a table in the shared folder; priors
are counted from it and joined to it. Hosts are broadcast while they are small, which is checked; beyond that only those
of at least one row in HOT, of which there are at most HOT, and the others meet their rows in a shuffle.

Null texts count as empty. A text with no trigram inside words leaves the other evidence to decide; with none of that
either, or when no language reaches ACCEPT, the answer is "und". Null hosts share one prior. An empty table gives no rows.
Repeated rows count each in their host's shares and get equal answers. A column ``language_id`` of the input is replaced;
all other names may occur in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, materialise
from .textkit import blocks, release, text_bytes

SAMPLE = 2000
BUCKETS, EFFECTIVE, DECLARED, SUFFIX, ACCEPT = 1 << 16, 60, 0.9, 0.8, 0.5
UND, HOST_WEIGHT = "und", 20.0
#: Bytes of host names that are broadcast, and the share of rows (one in HOT) from which a host is hot.
HOSTS_BYTES, HOT = 32 << 20, 4096

#: Languages of country suffixes.
COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt"}

_CLASS = np.zeros(256, dtype=np.uint32)  # 0: not a letter; ASCII letters fold their case
for _b in range(256):
    _CLASS[_b] = _b | 32 if chr(_b).isascii() and chr(_b).isalpha() else (_b if _b >= 128 else 0)


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of letters and word edges, and how many each text has (consecutive in the first)."""
    data, offsets = text_bytes(texts)
    if not data.size:
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    own = _CLASS[data]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[offsets[:-1][offsets[:-1] < data.size]] = 0
    after[offsets[1:][offsets[1:] > 0] - 1] = 0
    at = np.flatnonzero(own)
    grams = (((before[at] << 16) + (own[at] << 8) + after[at]).astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(12)).astype(np.int32) & (BUCKETS - 1)
    return grams, np.diff(np.searchsorted(at, offsets))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages, log probabilities

    def likelihoods(self, texts: pa.Array) -> np.ndarray:
        """(texts, languages + und): log likelihoods, counting at most EFFECTIVE trigrams."""
        grams, counts = _trigrams(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(counts)
        if some.size:
            starts = (np.cumsum(counts) - counts)[some]
            for k in range(len(self.languages)):
                sums[some, k] = np.add.reduceat(self.table[:, k][grams], starts)
        weight = np.minimum(counts, EFFECTIVE) / np.maximum(counts, 1)
        return np.concatenate([sums * weight[:, None], -np.log(BUCKETS) * np.minimum(counts, EFFECTIVE)[:, None]], axis=1)


def _fitted(counts: dict[str, np.ndarray]) -> LanguageModel:
    names = tuple(sorted(counts))
    table = np.stack([counts[n] for n in names], axis=1) + 0.05 if names else np.zeros((BUCKETS, 0))
    return LanguageModel(names, np.ascontiguousarray(np.log(table / table.sum(0))))


def _counts(texts: pa.Array) -> np.ndarray:
    return sum((np.bincount(_trigrams(part)[0], minlength=BUCKETS) for part in blocks(texts)), np.zeros(BUCKETS, dtype=np.int64))


def fit(texts: list[str], languages: list[str], least: int = 3) -> LanguageModel:
    """Languages of fewer than ``least`` texts are left out."""
    names = {x for x in languages if languages.count(x) >= least and x != UND}
    return _fitted({n: _counts(pa.array([t for t, x in zip(texts, languages) if x == n], pa.large_string())) for n in names})


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = 3) -> LanguageModel:
    """Fit on at most SAMPLE labelled documents. Of rows that repeat an id one counts. The sample's texts meet by
    language, so a language's trigrams are one row of BUCKETS sums over however many tasks the texts lay; the driver gets those
    and the ids of the sample."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("id is not null and lang is not null and length(trim(text)) > 0")
    ids = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    chosen = docs.sparkSession.createDataFrame([(r["id"],) for r in ids.collect()], rows.select("id").schema)
    found = rows.join(F.broadcast(chosen.distinct()), "id").groupBy("id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("row")).select("row.text", "row.lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for name in set(langs):
                own = np.flatnonzero(langs == name)
                sums[name] = sums.get(name, 0) + _counts(batch.column(0).take(pa.array(own)))
                texts[name] = texts.get(name, 0) + own.size
        kept = [name for name in sums if texts[name] >= least and name != UND]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([sums[name].tobytes() for name in kept], pa.binary())], names=["lang", "sums"])

    counted = found.repartition("lang").mapInArrow(run, "lang string, sums binary").collect()  # a row a language
    return _fitted({r["lang"]: np.frombuffer(r["sums"], dtype=np.int64) for r in counted})


def _log_likelihoods(text: Column, model: LanguageModel) -> Column:
    @F.arrow_udf("array<double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = [model.likelihoods(part) for part in blocks(column.fill_null(""))]
            flat = np.concatenate(out) if out else np.zeros((0, len(model.languages) + 1))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
        release()

    return run(text)


def _right(claim: Column, names: list[str], chance: float) -> Column:
    """For each name, the log probability of the claim; 0 where there is none or it is not one of the names."""
    other = np.log((1 - chance) / max(1, len(names) - 1))
    each = F.array(*(F.when(claim == n, F.lit(float(np.log(chance)))).otherwise(F.lit(float(other))) for n in names))
    return F.when(claim.isin(names), each).otherwise(F.array(*(F.lit(0.0) for _ in names)))


def _sum(*arrays: Column) -> Column:
    total = arrays[0]
    for a in arrays[1:]:
        total = F.zip_with(total, a, lambda x, y: x + y)
    return total


def host_priors(counted: DataFrame, names: list[str]) -> DataFrame:
    """(host, domain, n, prior): log shares of each name among a host's n texts, smoothed by domain and overall.
    ``counted`` has host, domain and one row a text with its best name; it is aggregated on the map side first."""
    per = [F.count_if(F.col("best") == k + 1).cast("double").alias(f"n{k}") for k in range(len(names))]
    hosts = materialise(counted.groupBy("host", "domain").agg(F.count("*").alias("rows"), *per), "hosts")
    domains = hosts.groupBy("domain").agg(*(F.sum(f"n{k}").alias(f"d{k}") for k in range(len(names))))
    overall = hosts.agg(*(F.sum(f"n{k}").alias(f"d{k}") for k in range(len(names)))).first()
    total = sum(x or 0.0 for x in overall)
    base = [((overall[k] or 0.0) + 1.0) / (total + len(names)) for k in range(len(names))]
    n, d = sum(F.col(f"n{k}") for k in range(len(names))), sum(F.col(f"d{k}") for k in range(len(names)))
    joined = hosts.alias("h").join(domains.alias("m"), F.expr("h.domain <=> m.domain"))
    shares = [F.log((F.col(f"n{k}") + HOST_WEIGHT * (F.col(f"d{k}") + HOST_WEIGHT * base[k]) / (d + HOST_WEIGHT)) / (n + HOST_WEIGHT)) for k in range(len(names))]
    return joined.select(F.col("h.host").alias("host"), F.col("h.domain").alias("domain"), F.col("rows").alias("n"), F.array(*shares).alias("prior"))


def _with_priors(scored: DataFrame, names: list[str]) -> DataFrame:
    """``scored`` with the prior of each row's host."""
    best = F.when(F.exists("ll", lambda x: x != 0), F.array_position(F.col("ll"), F.array_max("ll")).cast("int"))
    priors = materialise(host_priors(scored.select("host", "domain", best.alias("best")), names), "priors")
    size = priors.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("domain") + 8 * len(names) + 64), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size[0] <= HOSTS_BYTES:
        return scored.join(F.broadcast(priors.drop("n")), ["host", "domain"], "left")
    hot = (F.col("n") * HOT >= size[1]) & (F.octet_length("host") + F.octet_length("domain") <= HOSTS_BYTES // HOT)
    mine = scored.join(F.broadcast(priors.where(hot).select("host", "domain", F.col("prior").alias("hot"))), ["host", "domain"], "left")
    salt = F.concat(F.lit("\0"), F.pmod(F.xxhash64("ll"), F.lit(HOT)).cast("string"))  # rows that have their prior are spread over all tasks
    mine = mine.withColumns({c: F.when(F.col("hot").isNull(), F.col(c)).otherwise(salt) for c in ("host", "domain")})
    return mine.join(priors.where(~hot).drop("n"), ["host", "domain"], "left").withColumn("prior", F.coalesce("hot", "prior"))


def identify(docs: DataFrame, model: LanguageModel, text: Column, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, domain: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (by default all) and a struct column ``language_id`` of language ("und":
    rejected) and confidence, the posterior."""
    bound_batches(docs.sparkSession)
    names, known = [*model.languages, UND], list(model.languages)
    none = F.lit(None).cast("string")
    carried = [c for c in (carry if carry is not None else docs.columns) if c != "language_id"]
    claims = {k: (c if c is not None else none) for k, c in (("declared", declared), ("suffix", suffix))}
    places = {k: (F.coalesce(c, F.lit("")) if c is not None else F.lit("")) for k, c in (("host", host), ("domain", domain))}
    names_of = {f"carried_{k}": c for k, c in enumerate(carried)}
    scored = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in names_of.items()), _log_likelihoods(text, model).alias("ll"), *(c.alias(k) for k, c in [*claims.items(), *places.items()]))
    scored = _with_priors(materialise(scored, "language-scores"), names)

    zeros = F.array(*(F.lit(0.0) for _ in names))
    und = F.array(F.lit(float(np.log(1 / max(1, len(known))))))
    said = [F.when(F.col(k).isin(known), F.concat(_right(F.col(k), known, chance), und)).otherwise(zeros) for k, chance in (("declared", DECLARED), ("suffix", SUFFIX))] if known else []
    scored = scored.withColumn("score", _sum(F.col("ll"), F.coalesce("prior", zeros), *said))
    top = F.array_max("score")
    evidence = F.exists("ll", lambda x: x != 0) | F.coalesce(F.col("declared").isin(known) | F.lit(False), F.lit(False)) | F.coalesce(F.col("suffix").isin(known) | F.lit(False), F.lit(False))
    confidence = 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    language = F.element_at(F.array(*map(F.lit, names)), F.array_position("score", top).cast("int"))
    answer = F.when(evidence & (confidence >= ACCEPT), language).otherwise(F.lit(UND))
    answered = scored.select(*names_of, F.struct(answer.alias("language"), confidence.alias("confidence")).alias("language_id"))
    return answered.select(*(F.col(k).alias(c) for k, c in names_of.items()), "language_id")


def declared_language(html: Column) -> Column:
    """The primary code of the html element's lang attribute; null without one."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]{0,500}?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.nullif(found, F.lit(""))


def visible_text(html: Column) -> Column:
    """The text outside tags, scripts, styles and comments; what is never closed runs to the end of the page."""
    return F.regexp_replace(html, r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)|</?[a-z!?][^>]*+(?:>|\z)|&[a-z#0-9]{1,10};", " ")


def address_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def address_domain(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$|^([^.]+)$", 0)


def address_suffix(url: Column, host: Column) -> Column:
    """The language a country suffix, a first label or the first path part stands for; null where none does."""
    codes = sorted(set(COUNTRY.values()))
    country = F.create_map(*(F.lit(x) for kv in COUNTRY.items() for x in kv))
    part = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    label = F.regexp_extract(host, r"^([a-z]{2})\.", 1)
    return F.coalesce(F.when(part.isin(codes), part), F.when(label.isin(codes), label), F.try_element_at(country, F.regexp_extract(host, r"\.([a-z]{2})$", 1)))


def identify_pages(pages: DataFrame, model: LanguageModel, html_col: str = "html", url_col: str = "url", carry: list[str] | None = None) -> DataFrame:
    """Web pages: the columns ``carry`` of ``pages`` (by default all) with language_id, from their visible text, markup,
    address and host."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    host = address_host(url)
    return identify(pages, model, visible_text(html), declared_language(html), address_suffix(url, host), host, address_domain(host), carry)


def identify_documents(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Plain documents: the lang column is the declaration, the source the host."""
    return identify(docs, model, F.col(text_col), F.lower(F.col(lang_col)), None, F.col(source_col), None)
