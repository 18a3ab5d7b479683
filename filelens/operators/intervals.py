"""Interval labels of a folder tree (J1, J2, A4, G3 for deep trees).

Folders are put in pre-order: a folder's descendants follow it without a gap. ``first`` is a folder's number in that order and ``last`` its
last descendant's, so "b lies in or below a" is ``a.first <= b.first <= a.last``, and a total over a subtree is the difference of two running
sums. Rows grow with the folders, not with folders x depth: an ancestor that holds no file itself is made once, by the first path below it that
does not share it with the path before. Order, numbers and sums come from range partitions with offsets of one row per partition.

Paths are absolute with "/"; the empty path stands for "/". In the sort key the separator is the smallest character, which no name can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import ancestors
from .ranking import counted_before, rank_within, sorted_pieces, stored_pieces

_LOWEST, _NEXT = "\x00", "\x01"


def _key(path: str) -> Column:
    """Sorts a folder before its descendants, and these before any other folder."""
    return F.when(F.col(path).isin("/", ""), F.lit("")).otherwise(F.replace(F.col(path), F.lit("/"), F.lit(_LOWEST)))


def _after(path: str) -> Column:
    """The place behind a folder's last descendant."""
    return F.concat(_key(path), F.lit(_NEXT))


def folder_nodes(folders: DataFrame, partitions: int | None = None) -> DataFrame:
    """(directory): every folder of ``folders`` (directory) and every ancestor, once."""
    named = folders.select(F.when(F.col("directory") == "", F.lit("/")).otherwise(F.col("directory")).alias("directory"))
    pieces = stored_pieces(sorted_pieces(named.where(F.col("directory").isNotNull()).distinct().withColumn("key", _key("directory")), [], ["key"], partitions))
    ends = pieces.groupBy("_pid").agg(F.max_by("directory", "_mid").alias("end"))  # a row per partition
    ends = ends.select("_pid", F.lag("end").over(Window.orderBy("_pid")).alias("end"))
    before = F.lag("directory").over(Window.partitionBy("_pid").orderBy("_mid"))
    rows = pieces.withColumn("before", before).join(F.broadcast(ends), "_pid")
    rows = rows.select("directory", F.coalesce("before", "end").alias("before"))
    # shared with the path before: that path itself or one of its ancestors
    shared = lambda x: (x == F.lit("/")) | (F.col("before") == x) | F.startswith(F.col("before"), F.concat(x, F.lit("/")))
    fresh = F.filter(F.array_distinct(ancestors(F.col("directory"))), lambda x: F.col("before").isNull() | ~shared(x))
    return rows.select(F.explode(fresh).alias("directory"))


def label_folders(folders: DataFrame, partitions: int | None = None) -> DataFrame:
    """(directory, first, last) of every folder and ancestor."""
    nodes = folder_nodes(folders, partitions).withColumn("key", _key("directory"))
    numbered = rank_within(nodes, [], ["key"], "first", partitions)
    probes = numbered.select("directory", "first", _after("directory").alias("key"))
    return (counted_before(nodes, probes, [], ["key"], "behind", partitions=partitions)
            .select("directory", "first", (F.col("behind") - 1).alias("last")))


def subtree_totals(inv: DataFrame, partitions: int | None = None) -> DataFrame:
    """(directory, total_size, file_count) of everything below each folder, as ``hierarchy.directory_sizes``."""
    per_dir = inv.groupBy("directory").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n")).where(F.col("directory").isNotNull())
    held = per_dir.select(_key("directory").alias("key"), F.struct("size", "n").alias("v"))
    nodes = folder_nodes(per_dir.select("directory"), partitions)
    edges = F.explode(F.array(F.struct(_key("directory").alias("key"), F.lit(-1).alias("sign")), F.struct(_after("directory").alias("key"), F.lit(1).alias("sign"))))
    probes = nodes.select("directory", edges.alias("e")).select("directory", "e.key", "e.sign")
    sized = counted_before(held.select("key", F.col("v.size").alias("w")), probes, [], ["key"], "size", partitions=partitions, weight="w")
    both = counted_before(held.select("key", F.col("v.n").alias("w")), sized, [], ["key"], "n", partitions=partitions, weight="w")
    return both.groupBy("directory").agg(F.sum(F.col("sign") * F.col("size")).cast("long").alias("total_size"),
                                         F.sum(F.col("sign") * F.col("n")).cast("long").alias("file_count"))


def in_or_below(folders: DataFrame, tops: DataFrame, partitions: int | None = None) -> DataFrame:
    """A4: ``folders`` (directory, …) with ``below``: whether one of ``tops`` (directory) is the folder or an ancestor. Tops open and close
    intervals; a folder lies in as many as are open before it."""
    marks = tops.select("directory").distinct().select(F.explode(F.array(
        F.struct(_key("directory").alias("key"), F.lit(1).alias("w")), F.struct(_after("directory").alias("key"), F.lit(-1).alias("w")))).alias("m")).select("m.*")
    probes = folders.withColumn("key", _key("directory"))
    return counted_before(marks, probes, [], ["key"], "open", ties=True, partitions=partitions, weight="w").withColumn("below", F.col("open") > 0).drop("key", "open")
