"""A Merkle manifest of a dataset: a tree of SHA-256 digests a source, a tree over the sources' roots, and proofs.

A leaf is the digest of a row's columns; a null is ``-``, a value its UTF-8 byte count, ``:`` and itself. All digests are over
their inputs set end to end, digests as lowercase hex. Within a source leaves ascend by id; every ``fanout`` consecutive nodes,
the last run maybe fewer, become the digest of the run, until one node, the subroot, is left (a lone leaf is its own). Subroots
by source, null first, give the root in the same way.

Levels are DataFrames. Going up, a node's index floor-divided by the fanout is its parent's, and the sorted array of a
parent's children is hashed and kept with it. Going down, each level's parents hand their own path, with the child's siblings
put before it, to their children, so long paths are joined to a third of the rows only, at the leaves. Runs are grouped by
(source, index), so a source that holds a third of all rows is spread like any other.

Null ids come first in their source; rows of one id follow by their leaf, so rows equal in all columns are interchangeable.
An empty table gives no rows (and has no root). Texts of any length are hashed whole, by one expression; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, numbered

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_GROUP = ["known", "key"]  # a source, as columns that hold no null


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _joined(digests: Column) -> Column:
    """Binary digests end to end."""
    return F.unhex(F.array_join(F.transform(digests, lambda d: F.hex(d)), ""))


def leaf_digest(values: list[Column]) -> Column:
    """The binary digest of a row's values."""
    texts = [v.cast("string") for v in values]
    return _digest(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)))


def proof_digest(path: Column) -> Column:
    """The hex digest of all siblings of a path, from the leaf's to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(_hex(p["before"]), _hex(p["after"]))), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The binary root that a leaf's digest and its path give."""
    return F.aggregate(path, leaf, lambda node, p: _digest(F.concat(_hex(p["before"]), _hex(node), _hex(p["after"]))))


def _grow(nodes: DataFrame, group: list[str], fanout: int, name: str) -> list[DataFrame]:
    """The levels of the trees over ``nodes`` (group, at, n, digest); from the second on with the run of each one's children."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = F.floor(F.col("at") / fanout).cast("long")
        runs = levels[-1].where("n > 1").groupBy(*group, up.alias("up"), "n").agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("run"))  # at most fanout
        runs = runs.select(*group, F.col("up").alias("at"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.transform("run", lambda x: x["digest"]).alias("run"))
        digest = _digest(F.array_join(F.transform("run", _hex), ""))
        levels.append(materialise(runs.select(*group, "at", "n", digest.alias("digest"), "run"), f"{name}-{len(levels)}"))
        most = -(-most // fanout)
    return levels


def _longer(run: Column, place: Column, path: Column) -> Column:
    """A child's path: its siblings before its parent's path."""
    before = _joined(F.slice(run, F.lit(1), place.cast("int")))
    after = _joined(F.slice(run, place.cast("int") + 2, F.size(run)))
    return F.concat(F.array(F.struct(before.alias("before"), after.alias("after"))), path)


def _descend(levels: list[DataFrame], roots: DataFrame, group: list[str], carry: list[str], fanout: int) -> DataFrame:
    """For each node above the lowest level its path to the root, from ``roots`` (group, depth, path, carry): (group, at, run,
    path, carry). Nodes that are roots of the lowest level come with a null run."""
    start = lambda d: roots.where(F.col("depth") == d).select(*group, F.lit(0).cast("long").alias("at"), "path", *carry)
    paths = start(len(levels) - 1)
    for depth in range(len(levels) - 1, 0, -1):
        found = levels[depth].select(*group, "at", "run").join(paths, [*group, "at"])
        if depth > 1:
            below = found.select(*group, F.col("at").alias("up"), "run", "path", *carry, F.posexplode("run").alias("place", "_"))
            below = below.select(*group, (F.col("up") * fanout + F.col("place")).alias("at"), _longer(F.col("run"), F.col("place"), F.col("path")).alias("path"), *carry)
            paths = below.union(start(depth - 1))
    lone = start(0).withColumn("run", F.lit(None).cast("array<binary>")).select(*group, "at", "run", "path", *carry)
    return found.select(*group, "at", "run", "path", *carry).union(lone) if len(levels) > 1 else lone


def _to_lowest(nodes: DataFrame, parents: DataFrame, group: list[str], carry: list[str], fanout: int) -> DataFrame:
    """``nodes`` with their paths, each from its parent's row."""
    up = F.floor(F.col("at") / fanout).cast("long")
    met = nodes.withColumn("up", up).join(parents.withColumnRenamed("at", "up"), [*group, "up"])
    path = F.when(F.col("run").isNull(), F.col("path")).otherwise(_longer(F.col("run"), F.col("at") % fanout, F.col("path")))
    return met.select(*nodes.columns, path.alias("path"), *carry)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", fanout: int = FANOUT, extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path, extra columns) of each row; digests are binary, path is the list, from the leaf's level
    to the root's, of the siblings (before, after) set end to end. ``extra``: expressions over ``docs``, of fixed size, carried
    along."""
    extra = extra or {}
    source = F.col(source_col).cast("string")
    made = [c.alias(f"extra_{k}") for k, c in enumerate(extra.values())]
    leaves = docs.select(source.isNotNull().alias("known"), F.coalesce(source, F.lit("")).alias("key"), F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in columns]).alias("digest"), *made)
    leaves = materialise(numbered(materialise(leaves, "leaves"), _GROUP, ["id", "digest"]), "numbered-leaves")
    levels = _grow(leaves.select(*_GROUP, "at", "n", "digest"), _GROUP, fanout, "level")

    subroots = None
    for depth, level in enumerate(levels):
        tops = level.where("n = 1").select(*_GROUP, F.lit(depth).alias("depth"), F.col("digest").alias("subroot"))
        subroots = tops if subroots is None else subroots.union(tops)
    subroots = materialise(numbered(materialise(subroots, "subroots"), [], _GROUP), "numbered-subroots")
    tops = _grow(subroots.select("at", "n", F.col("subroot").alias("digest")), [], fanout, "top")
    root = tops[-1].where("n = 1").select(F.lit(len(tops) - 1).alias("depth"), F.col("digest").alias("root"), F.array().cast("array<struct<before: binary, after: binary>>").alias("path"))
    sources = _to_lowest(subroots, _descend(tops, root, [], ["root"], fanout), [], ["root"], fanout)
    sources = materialise(sources.select(*_GROUP, "depth", "path", "subroot", "root"), "sources")

    carry = ["subroot", "root"]
    out = _to_lowest(leaves, _descend(levels, sources, _GROUP, carry, fanout), _GROUP, carry, fanout)
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", *(F.col(f"extra_{k}").alias(name) for k, name in enumerate(extra)))


def verified(rows: DataFrame, leaf: Column) -> DataFrame:
    """``rows`` of a manifest as hex, with the digest of the proof, the root that ``leaf`` folds to, and whether it is the root."""
    folded = _hex(fold(leaf, F.col("path")))
    found = rows.withColumn("folded_root", folded)
    return found.withColumns({"proof_sha256": proof_digest(F.col("path")), "verified": F.col("folded_root") == _hex(F.col("root")), **{c: _hex(F.col(c)) for c in ("leaf", "subroot", "root")}}).drop("path")
