"""Folder hierarchy (survey §2 J1–J4, G3, A7).

Rolling sizes up a tree is "aggregate per directory, then explode ancestors,
then aggregate again": the explode multiplies distinct directories by depth,
never files by depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def ancestors(directory: Column, sep: str = "/") -> Column:
    """Array of a directory and every ancestor ('/' for the root of an absolute path)."""
    parts = F.split(directory, "\\" + sep if sep in "\\/" else sep)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))
    return F.filter(F.transform(prefixes, lambda p: F.when(p == "", F.lit(sep)).otherwise(p)),
                    lambda p: p.isNotNull())


def directory_sizes(inv: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """For every directory, bytes and files below it (recursive), root included. ``skip``: attribute columns (such as
    ``is_hidden``, ``is_system``) whose files are left out."""
    for attribute in skip:
        inv = inv.where(~F.col(attribute))
    per_dir = inv.groupBy("directory").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    exploded = per_dir.select(F.explode(F.array_distinct(ancestors(F.col("directory")))).alias("directory"), "s", "n")
    return (exploded.groupBy("directory")
            .agg(F.sum("s").cast("long").alias("total_size"), F.sum("n").cast("long").alias("file_count")))


def folder_tree(paths: DataFrame, path_col: str = "path", sep: str = "\\") -> DataFrame:
    """Tree nodes from a list of folder paths, unique by (ancestor chain, segment).

    Output (level, segment, parent_path, node_path); level starts at 1, node_path joins the
    segments with ``sep``, case-sensitive like the reference.
    """
    pattern = "\\" + sep if sep in "\\/|.$^" else sep
    distinct_paths = paths.select(F.col(path_col).alias("p")).where(F.col("p").isNotNull()).distinct()
    parts = F.split(F.col("p"), pattern)
    nodes = distinct_paths.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(
            i.alias("level"),
            F.element_at(parts, i).alias("segment"),
            F.when(i > 1, F.array_join(F.slice(parts, F.lit(1), i - 1), sep)).alias("parent_path"),
            F.array_join(F.slice(parts, F.lit(1), i), sep).alias("node_path")))).alias("n"))
    return nodes.select("n.*").distinct()


def report_paths(lines: DataFrame, field: int = 6) -> tuple[DataFrame, DataFrame]:
    """Pipe-delimited lines → (path field, its parent folder) and a reject frame.

    Lines with fewer than ``field`` fields go to the rejects (the reference throws on them).
    The parent is taken on backslash paths (``Path.GetDirectoryName`` on Windows).
    """
    parts = F.split(F.col("value"), r"\|")
    with_field = lines.select("value", F.when(F.size(parts) >= field, F.element_at(parts, field)).alias("path"))
    ok = with_field.where(F.col("path").isNotNull())
    head = F.regexp_extract("path", r"^(.*)[\\/][^\\/]*$", 1)
    parent = (F.when(~F.col("path").rlike(r"[\\/]"), F.lit(""))
               .when(head == "", F.substring("path", 1, 1))  # a file in the root keeps the root
               .otherwise(head))
    good = ok.select("path", parent.alias("directory"))
    rejects = with_field.where(F.col("path").isNull()).select(
        F.col("value").alias("path"), F.lit(f"fewer than {field} fields").alias("reason"))
    return good, rejects


def report_tree(lines: DataFrame) -> DataFrame:
    """Report reader, then the folder tree with a backslash separator."""
    good, _ = report_paths(lines)
    return folder_tree(good, "directory", "\\")


def empty_folders(directories: DataFrame, inv: DataFrame, root: str) -> DataFrame:
    """Directories strictly below ``root`` with no file and no sub-directory.

    ``directories`` lists known folders (column ``directory``); folders of the files and
    all their ancestors below the root are added, so the result needs no scan of its own.
    """
    root = root.rstrip("/")
    below = F.col("directory").startswith(root + "/")
    file_dirs = inv.select("directory").distinct()
    all_dirs = (directories.select("directory").unionByName(file_dirs)
                .select(F.explode(ancestors(F.col("directory"))).alias("directory"))
                .where(below).distinct())
    used = (file_dirs.unionByName(all_dirs.select(C.parent_directory("directory").alias("directory")))
            .distinct())
    return all_dirs.join(used, "directory", "left_anti")


def relative_directory(directory: Column, root: str) -> Column:
    """The directory with the root removed as a prefix (not every occurrence), no leading separator."""
    root = root.rstrip("/\\")
    stripped = (F.when(directory == root, F.lit(""))
                 .when(directory.startswith(root + "/") | directory.startswith(root + "\\"),
                       F.substring(directory, len(root) + 2, 1 << 30))
                 .otherwise(directory))
    return F.regexp_replace(stripped, r"^[\\/]+", "")
