"""The service layer: validated requests over named corpora, with timings.

Text and image encoders are handed in; none is shipped, since model weights are not part of this package.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import search as exact
from .operators.filters import FilterSpec, validate
from .operators.graph import GraphStore
from .operators.store import ClusteredStore
from .sources.collection import Collection
from .sources.readers import exists


class NotFound(LookupError):
    """An unknown item or source (404)."""


class Unavailable(RuntimeError):
    """No corpus is loaded (503)."""


class Encoder(Protocol):
    """What turns texts and pictures into unit vectors."""

    supports_images: bool

    def encode_text(self, text: str) -> list[float]: ...

    def encode_images(self, images: list[bytes]) -> list[list[float]]: ...


class Ranker(Protocol):
    """What an evaluation needs of a system."""

    def search(self, query: str, k: int) -> DataFrame: ...


@dataclass
class StubEncoder:
    """Vectors from a table of known texts; pictures only if it is given some."""

    texts: dict[str, list[float]]
    images: dict[bytes, list[float]] = field(default_factory=dict)

    @property
    def supports_images(self) -> bool:
        return bool(self.images)

    def encode_text(self, text: str) -> list[float]:
        return self.texts[text]

    def encode_images(self, images: list[bytes]) -> list[list[float]]:
        if not self.images:
            raise NotImplementedError("this encoder takes texts only")
        if any(image not in self.images for image in images):
            raise ValueError("not an image")
        return [self.images[image] for image in images]


@dataclass(frozen=True)
class ExactStore:
    """Exact search over a corpus."""

    corpus: DataFrame

    def search(self, query, k: int = 12, filters: FilterSpec | None = None, leave_out: str | None = None) -> DataFrame:
        return exact.search(self.corpus, query, k, filters, leave_out)


def open_exact(spark: SparkSession, path: str) -> ExactStore:
    """A corpus in Parquet; FileNotFoundError if there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no corpus at {path}")
    return ExactStore(spark.read.parquet(path))


#: Encoders by kind (a class) and stores by kind (opened from a session and a path); applications register theirs.
ENCODERS: dict[str, Callable[..., Encoder]] = {"stub": StubEncoder}
STORES: dict[str, Callable[..., ExactStore | ClusteredStore | GraphStore]] = {"exact": open_exact, "clustered": ClusteredStore.open, "graph": GraphStore.open}


def _of_kind(known: dict, kind: str | None, variable: str, default: str):
    name = (kind or os.environ.get(variable) or default).strip().lower()
    if name not in known:
        raise ValueError(f"unknown kind {name!r}; known: {', '.join(sorted(known))}")
    return known[name]


def load_encoder(kind: str | None = None, *args, **kwargs) -> Encoder:
    """An encoder of ``kind``, or of that in FERNGLAS_ENCODER."""
    return _of_kind(ENCODERS, kind, "FERNGLAS_ENCODER", "stub")(*args, **kwargs)


def load_store(spark: SparkSession, path: str, kind: str | None = None) -> ExactStore | ClusteredStore | GraphStore:
    """The store at ``path`` of ``kind``, or of that in FERNGLAS_STORE."""
    return _of_kind(STORES, kind, "FERNGLAS_STORE", "exact")(spark, path)


def store_kind(store: object) -> str:
    """The kind that answers name: the class without 'Store', in lower case."""
    return type(store).__name__.removesuffix("Store").lower()


@dataclass
class SearchService:
    corpus: DataFrame
    encoder: Encoder
    store: ExactStore | ClusteredStore | GraphStore | None = None  # exact search over the corpus
    source: str = "photos"
    collection: Collection | None = None  # of the same rows, for lookups by id

    def __post_init__(self) -> None:
        self.store = self.store or ExactStore(self.corpus)

    def _timed(self, query: str, vector: list[float], encode_ms: float, k: int, spec: FilterSpec, leave_out: str | None = None) -> dict:
        began = time.perf_counter()
        results = [r.asDict() for r in self.store.search(vector, k, spec, leave_out=leave_out).collect()]  # at most k rows
        return {"query": query, "k": k, "count": len(results), "filtered": spec.is_active(), "store": store_kind(self.store), "encode_ms": round(encode_ms, 2), "search_ms": round((time.perf_counter() - began) * 1e3, 3), "results": results}

    def search(self, q: str, k: int = 12, spec: FilterSpec = FilterSpec()) -> dict:
        validate(q, k, spec)
        began = time.perf_counter()
        vector = self.encoder.encode_text(q)
        return self._timed(q, vector, (time.perf_counter() - began) * 1e3, k, spec)

    def search_by_image(self, name: str, image: bytes, k: int = 12, spec: FilterSpec = FilterSpec()) -> dict:
        """NotImplementedError (501) without image support, ValueError (400) for what is no image."""
        validate(None, k, spec)
        if not self.encoder.supports_images:
            raise NotImplementedError("this encoder takes texts only")
        began = time.perf_counter()
        vector = self.encoder.encode_images([image])[0]
        return self._timed(f"image:{name}", vector, (time.perf_counter() - began) * 1e3, k, spec)

    def similar(self, photo_id: str, k: int = 12, spec: FilterSpec = FilterSpec()) -> dict:
        validate(None, k, spec)
        vector = exact.stored_vector(self.collection or self.corpus, photo_id)
        if vector is None:
            raise NotFound(photo_id)
        return self._timed(f"similar:{photo_id}", vector, 0.0, k, spec, photo_id)

    def health(self) -> dict:
        n = exact.counts(self.corpus).first()
        return {"status": "ok", "indexed": n["indexed"], "exif_count": n["exif_count"], "store": store_kind(self.store), "source": self.source, "encoder": type(self.encoder).__name__.lower(), "supports_images": self.encoder.supports_images}

    def file_path(self, photo_id: str) -> str:
        """The file of an item of the corpus, which must still be there."""
        row = None
        if "path" in self.corpus.columns:
            row = self.collection.lookup(photo_id) if self.collection else self.corpus.where(F.col("photo_id") == photo_id).select("path").first()
        if row is None or row["path"] is None or not exists(self.corpus.sparkSession, row["path"]):
            raise NotFound(photo_id)
        return row["path"]


@dataclass
class Sources:
    """Named corpora behind one interface."""

    services: dict[str, SearchService]
    default: str = "photos"

    def get(self, source: str | None = None) -> SearchService:
        if not self.services:
            raise Unavailable("no corpus is loaded")
        if (name := source or self.default) not in self.services:
            raise NotFound(name)
        return self.services[name]


def encode_texts(text: Column, kind: str, *args) -> Column:
    """A column of vectors; the encoder is loaded once in each Python worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load_encoder(kind, *args)
        for part in parts:
            yield part.map(lambda t: None if t is None else encoder.encode_text(t))

    return run(text)


def encode_images(content: Column, kind: str, *args, batch: int = 16) -> Column:
    """The same of pictures (binary), ``batch`` at a time in the order of rows. A picture that can't be read has no vector
    and costs its batch only that the others are encoded one by one; NotImplementedError of an encoder without images."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load_encoder(kind, *args)

        def encoded(images: list[bytes]) -> list:
            try:
                return list(encoder.encode_images(images)) if images else []
            except NotImplementedError:
                raise
            except Exception:  # noqa: BLE001  an unreadable picture is data here
                return [None] if len(images) == 1 else [v for image in images for v in encoded([image])]

        for part in parts:
            given = [(n, bytes(x)) for n, x in enumerate(part) if x is not None]
            out = [None] * len(part)
            for at in range(0, len(given), batch):
                some = given[at : at + batch]
                for (n, _), v in zip(some, encoded([x for _, x in some]), strict=True):
                    out[n] = v
            yield pd.Series(out, dtype=object)

    return run(content)


def measure(service: SearchService, queries: list[str], k: int = 10) -> DataFrame:
    """(query, encode_ms, search_ms) of each query, as ``evaluate.latency`` takes it. One call before them isn't timed."""
    if queries:
        service.search(queries[0], k)
    answers = [service.search(q, k) for q in queries]
    return service.corpus.sparkSession.createDataFrame([(a["query"], a["encode_ms"], a["search_ms"]) for a in answers], "query string, encode_ms double, search_ms double")
