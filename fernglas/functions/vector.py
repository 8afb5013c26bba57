"""Vector arithmetic over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product; on unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector is an error."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(F.raise_error(F.lit("a zero vector has no direction")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def from_distance(distance: Column) -> Column:
    return 1 - distance


def norm_error(v: Column) -> Column:
    return F.abs(norm(v) - 1)


def half_precision(v: Column) -> Column:
    """What is left of a vector after storage in 16 bits."""

    @F.arrow_udf("array<float>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
            at = pa.array((c.offsets.to_numpy() - c.offsets[0].as_py()).astype(np.int32))
            yield pa.ListArray.from_arrays(at, pa.array(flat), mask=c.is_null()) if c.null_count else pa.ListArray.from_arrays(at, pa.array(flat))

    return run(v)


def pack_half(v: Column) -> Column:
    """A vector as binary of two bytes a component, little-endian; null for null and for a vector with a null component. It is
    searched as it is: the scan reads half the bytes."""

    @F.arrow_udf("binary")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            flat, length = c.flatten(), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            half = flat.fill_null(0).to_numpy(zero_copy_only=False).astype("<f2")
            none = c.is_null().to_numpy(zero_copy_only=False).copy()
            if flat.null_count:
                none[np.repeat(np.arange(len(c)), length)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
            ends = np.concatenate([[0], np.cumsum(2 * length)])
            raw = half.tobytes()
            yield pa.array([None if n else raw[a:b] for n, a, b in zip(none.tolist(), ends[:-1].tolist(), ends[1:].tolist())], pa.binary())

    return run(v)


def unpack_half(v: Column) -> Column:
    """The vector of such a binary."""

    @F.arrow_udf("array<float>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield pa.array([None if x is None else np.frombuffer(x, dtype="<f2").astype(np.float32) for x in c.to_pylist()], pa.list_(pa.float32()))

    return run(v)


def literal(vector) -> Column:
    """A vector as a constant, so that a single query needs no join at all."""
    return F.lit([float(x) for x in vector]).cast("array<double>")
