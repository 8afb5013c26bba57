"""Incremental maintenance of an index by snapshot difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name, parent_folder
from ..schema import API, MANIFEST
from .filters import has_exif, under_root

#: Fixed value: times that differ by less are the same.
SAME_TIME = 1e-3


def plan_changes(scanned: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """(photo_id, path, mtime, size, action): new, changed, unchanged, or deleted (gone and under ``root``)."""
    old = manifest.select("photo_id", F.col("path").alias("old_path"), F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
    joined = scanned.join(old, "photo_id", "full_outer")
    moved = (F.abs(F.col("mtime") - F.col("old_mtime")) > SAME_TIME) | (F.col("size") != F.col("old_size"))
    action = F.when(F.col("path").isNull(), F.when(under_root(F.col("old_path"), root), "deleted")).when(F.col("old_path").isNull(), "new").when(F.coalesce(moved, F.lit(True)), "changed").otherwise("unchanged")
    return joined.select("photo_id", F.coalesce("path", "old_path").alias("path"), F.coalesce("mtime", "old_mtime").alias("mtime"), F.coalesce("size", "old_size").alias("size"), action.alias("action")).where("action is not null")


def library_rows(files: DataFrame) -> DataFrame:
    """Display rows of local files."""
    url = lambda kind: F.concat(F.lit(f"{API}/photo/"), F.col("photo_id"), F.lit(f"/{kind}"))
    return files.withColumns({"photo_image_url": url("thumb"), "photo_url": url("full"), "photographer": parent_folder(F.col("path")), "photo_description": file_name(F.col("path"))})


def coerce_manifest(rows: DataFrame) -> DataFrame:
    """All columns of the manifest in order and type; missing sizes are 0, other missing values NULL."""
    made = []
    for f in MANIFEST.fields:
        value = F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if f.name in ("size", "photo_width", "photo_height"):
            value = F.coalesce(value, F.lit(0).cast("long"))
        if f.dataType.typeName() == "double":
            value = F.when(~F.isnan(value), value)
        made.append(value.alias(f.name))
    return rows.select(*made)


def upsert(old: DataFrame, new: DataFrame, key: str = "photo_id") -> DataFrame:
    return delete(old, new, key).unionByName(new, allowMissingColumns=True)


def delete(rows: DataFrame, gone: DataFrame, key: str = "photo_id") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def apply_plan(manifest: DataFrame, plan: DataFrame, loaded: DataFrame) -> DataFrame:
    """The manifest after a run. ``loaded``: rows of new and changed files that could be read; what failed to load keeps
    its old row and comes again next time."""
    return coerce_manifest(upsert(delete(manifest, plan.where("action = 'deleted'")), loaded))


def stats(manifest: DataFrame) -> DataFrame:
    """Photos, share with camera data, folders."""
    return manifest.agg(F.count("*").alias("photos"), F.coalesce(F.avg(has_exif().cast("int")), F.lit(0.0)).alias("exif_share"), F.countDistinct(F.regexp_extract("path", "^(.*)/", 1)).alias("folders"))


def top_makes(manifest: DataFrame, n: int = 5) -> DataFrame:
    return manifest.where("camera_make is not null").groupBy("camera_make").agg(F.count("*").alias("photos")).orderBy(F.col("photos").desc(), "camera_make").limit(n)


def file_states(local: DataFrame, remote: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """State of each file of a payload: MISSING, new, same or changed."""
    a, b = local.select(key, F.col(digest).alias("a")), remote.select(key, F.col(digest).alias("b"))
    state = F.when(F.col("a").isNull(), "MISSING").when(F.col("b").isNull(), "new").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def payload_total(states: DataFrame, files: DataFrame, key: str = "path", size: str = "size") -> DataFrame:
    """Bytes of a payload's files and how many are new or changed."""
    return states.join(files.select(key, size), key, "left").agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(F.col("state").isin("new", "changed")).alias("changed"))


def touched(*tables: DataFrame, key: str = "photo_id") -> DataFrame:
    """The distinct ids of several tables."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.union(t.select(key))
    return out.distinct()
