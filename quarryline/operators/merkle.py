"""Hash trees over paths, and the comparison of two of them.

A directory's hash covers the names and hashes of its entries, so equal hashes
mean equal subtrees.  Trees are made bottom-up, a grouped round for each level;
entries are summed up rather than listed, so a directory of any size is combined
before its shuffle.  Two trees are compared top-down: a round reads one level,
and of it only the children of directories that differ.  What changed while
nobody watched is found without looking at what did not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.session import stored

ROOT = ""
#: Numbers of 60 bits that the hashes of entries are added up in.
LANES = 4
_NODES = ("parent", "path", "depth", "is_file", "hash")


def parent_of(path: Column) -> Column:
    """The directory that a path stands in; the root has no name."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def _lanes(path: Column, is_file: Column, hash_: Column) -> list[Column]:
    entry = F.sha2(F.concat(F.when(is_file, F.lit("f")).otherwise(F.lit("d")), path, F.lit("\0"), hash_), 256)
    return [F.conv(F.substring(entry, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)") for i in range(LANES)]


def tree(files: DataFrame, *, path_col: str = "path", hash_col: str = "hash", hold: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(parent, path, depth, is_file, hash) of every file and directory, the
    root included.  Paths are relative and stand once; rows without a path are left
    out, a null hash is one of its own.  ``hold`` stores each round's level."""
    path = F.col(path_col)
    leaves = files.filter(path.isNotNull()).select(parent_of(path).alias("parent"), path.alias("path"), (F.size(F.split(path, "/"))).alias("depth"), F.lit(True).alias("is_file"), F.coalesce(F.col(hash_col), F.lit("?")).alias("hash"))
    leaves = hold(leaves)
    depth = leaves.agg(F.max("depth")).first()[0] or 1
    out, below = leaves, None
    for d in range(depth, 0, -1):
        level = leaves.filter(F.col("depth") == d)
        level = level if below is None else level.unionByName(below)
        sums = level.groupBy("parent").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(_lanes(F.col("path"), F.col("is_file"), F.col("hash")))))
        digest = F.sha2(F.concat_ws(":", "n", *(f"s{i}" for i in range(LANES))), 256)
        below = sums.select(F.when(F.col("parent") != ROOT, parent_of(F.col("parent"))).alias("parent"), F.col("parent").alias("path"), F.lit(d - 1).alias("depth"), F.lit(False).alias("is_file"), digest.alias("hash"))
        below = hold(below)
        out = out.unionByName(below)
    return out.select(*_NODES)


@dataclass(frozen=True)
class Comparison:
    """``changes``: (path, change, was) with change one of added, changed,
    removed and moved; ``expanded``: (path, depth) of directories looked into."""

    changes: DataFrame
    expanded: DataFrame


def compare(old: DataFrame, new: DataFrame, *, hold: Callable[[DataFrame], DataFrame] = stored) -> Comparison:
    """What differs between two trees.  A directory on one side only is followed
    down on that side; a path that was a file and is a directory now (or the
    other way round) is removed and added.  A moved file is one whose content
    went from exactly one path to exactly one other."""
    own = lambda t, side: t.select("parent", "path", "depth", F.col("is_file").alias(f"{side}_file"), F.col("hash").alias(f"{side}_hash"))
    old, new = own(old, "old"), own(new, "new")
    frontier = old.filter(F.col("path") == ROOT).select("path", "old_hash").join(new.filter(F.col("path") == ROOT).select("path", "new_hash"), "path", "full")
    frontier = hold(frontier.filter(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select("path"))
    found, seen, depth = [], [], 0
    while not frontier.isEmpty():
        seen.append(frontier.withColumn("depth", F.lit(depth)))
        depth += 1
        into = frontier.withColumnRenamed("path", "parent")
        a, b = (t.filter(F.col("depth") == depth).join(into, "parent", "left_semi").drop("parent", "depth") for t in (old, new))
        both = a.join(b, "path", "full").filter(~(F.col("old_hash").eqNullSafe(F.col("new_hash")) & F.col("old_file").eqNullSafe(F.col("new_file"))))
        both = hold(both)
        found.append(both.filter(F.coalesce("old_file", F.lit(False)) | F.coalesce("new_file", F.lit(False))))
        frontier = both.filter(~F.coalesce("old_file", F.lit(True)) | ~F.coalesce("new_file", F.lit(True))).select("path")
    if not found:
        empty = old.limit(0)
        return Comparison(empty.select("path", F.lit("").alias("change"), F.lit("").alias("was")), empty.select("path", "depth"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    was, is_ = F.coalesce("old_file", F.lit(False)), F.coalesce("new_file", F.lit(False))
    gone = hold(rows.filter(was & ~is_).select("path", F.col("old_hash").alias("hash")))
    come = hold(rows.filter(is_ & ~was).select("path", F.col("new_hash").alias("hash")))
    once = lambda t, name: t.groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias(name)).filter("n = 1").drop("n")
    moves = hold(once(gone, "was").join(once(come, "path"), "hash").select("path", "was"))
    none = F.lit(None).cast("string").alias("was")
    changes = moves.select("path", F.lit("moved").alias("change"), "was")
    changes = changes.unionByName(rows.filter(was & is_).select("path", F.lit("changed").alias("change"), none))
    changes = changes.unionByName(come.join(moves, "path", "left_anti").select("path", F.lit("added").alias("change"), none))
    changes = changes.unionByName(gone.join(moves.select(F.col("was").alias("path")), "path", "left_anti").select("path", F.lit("removed").alias("change"), none))
    expanded = seen[0]
    for more in seen[1:]:
        expanded = expanded.unionByName(more)
    return Comparison(changes, expanded)


def save(nodes: DataFrame, path: str) -> None:
    """A tree as a table, one partition a level, sorted by directory: a round of
    a comparison reads the level it is at."""
    nodes.repartition("depth", "parent").sortWithinPartitions("depth", "parent").write.partitionBy("depth").parquet(path)


def jobs(changes: DataFrame, priority: int = 10) -> DataFrame:
    """Changes as work: (path, kind, priority)."""
    new = changes.filter("change <> 'removed'").select("path", F.lit("parse").alias("kind"))
    gone = changes.filter("change in ('removed', 'moved')").select(F.coalesce("was", "path").alias("path"), F.lit("delete").alias("kind"))
    return new.unionByName(gone).withColumn("priority", F.lit(priority))
