"""Intermediate tables in the folder that the whole cluster shares, and tables that a session makes once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SETTING = "spark.checkpoint.dir"
_MADE: dict[tuple, str] = {}
_SCHEMAS: dict[tuple, StructType] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset and all executors are threads of this machine (tests),
    a local temporary one; on a cluster an error, as executors would write where nobody else reads."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="fernglas-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/fernglas/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it from there: it cuts the lineage, and a lost executor costs
    no recomputation of what stands before it. Returns the folder, too, for `remove`."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """stored() without the folder, which goes when the driver's JVM ends."""
    return stored(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def files_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, length and time of the files at ``paths``, which tell whether a table made from them is still right."""
    found = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``. Its schema is read from the files' footers, a job of its own, the first time only, as long as
    the files stay as they are."""
    key = (spark.sparkContext.applicationId, path, files_state(spark, [path]))
    if key in _SCHEMAS:
        return spark.read.schema(_SCHEMAS[key]).parquet(path)
    found = spark.read.parquet(path)
    _SCHEMAS[key] = found.schema
    return found


def made_once(spark: SparkSession, name: str, paths: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written to the shared folder the first time and read from there as long as the files
    at ``paths``, which it is made from, stay as they are."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), name, files_state(spark, paths))
    if key not in _MADE:
        df = make()
        _MADE[key] = scratch(spark, name)
        try:
            df.write.parquet(_MADE[key])
        except BaseException:
            del _MADE[key]
            raise
    return read_known(spark, _MADE[key])
