"""Removal safety and review (survey §2 K4–K7, E12, E13).

A selection is a table of paths, joined to the marked inventory; nothing is
mutated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.common import attach_one_row


def unsafe_groups(members: DataFrame, selection: DataFrame) -> DataFrame:
    """K4: duplicate groups in which every member is selected.

    ``members`` is the group-member frame (duplicate_group_id, size, file_count, full_path).
    """
    sel = members.join(selection.select("full_path"), "full_path", "left_semi")
    per_group = sel.groupBy("duplicate_group_id", "size", "file_count").agg(
        F.count(F.lit(1)).alias("selected_count"))
    return (per_group.where(F.col("selected_count") == F.col("file_count"))
            .select("duplicate_group_id", C.group_label("duplicate_group_id").alias("group_label"),
                    "selected_count", F.col("file_count").alias("total_count"), "size"))


def safe_selection(members: DataFrame, selection: DataFrame, only_unsafe: bool = False) -> DataFrame:
    """K5: when some group would lose every copy, drop primaries from the selection.

    Like the reference, all primaries are dropped (also those of safe groups);
    ``only_unsafe=True`` drops only the primaries of the unsafe groups.
    """
    unsafe = unsafe_groups(members, selection)
    primaries = members.where(F.col("is_primary")).select("full_path", "duplicate_group_id")
    if only_unsafe:
        drop = primaries.join(unsafe.select("duplicate_group_id"), "duplicate_group_id", "left_semi")
    else:
        flag = unsafe.agg((F.count(F.lit(1)) > 0).alias("any_unsafe"))
        drop = attach_one_row(primaries, flag).where(F.col("any_unsafe"))
    return selection.select("full_path").join(drop.select("full_path"), "full_path", "left_anti")


def review_decisions(log: DataFrame) -> DataFrame:
    """K6: the latest decision per path wins ('mark' selects and marks, 'keep' clears both); of decisions at one time
    'keep' wins, as nothing is then lost."""
    order = F.struct("decided_at", (F.col("decision") == "keep").alias("keeps"))
    latest = log.groupBy("full_path").agg(F.max_by("decision", order).alias("decision"))
    marked = F.col("decision") == "mark"
    return latest.select("full_path", "decision", marked.alias("is_selected"), marked.alias("marked_for_removal"))


def selection_summary(shown: DataFrame, selection: DataFrame) -> DataFrame:
    """Count and bytes of the selected rows among all matching rows (``shown``: a search, uncut)."""
    sel = shown.join(selection.select("full_path"), "full_path", "left_semi")
    return sel.agg(F.count(F.lit(1)).alias("selected_files"),
                   F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("selected_bytes")) \
              .withColumn("selected_bytes_text", C.format_bytes("selected_bytes"))


def delete_summary(marked_inv: DataFrame, selection: DataFrame) -> DataFrame:
    """Count, bytes, duplicates and primaries among the selected files."""
    sel = marked_inv.join(selection.select("full_path"), "full_path", "left_semi")
    return sel.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"),
        F.count_if(F.col("is_duplicate")).alias("duplicate_files"),
        F.count_if(F.col("is_primary")).alias("primary_files"),
    ).withColumn("total_size_text", C.format_bytes("total_size"))
