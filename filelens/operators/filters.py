"""Filters, presets and the search box (survey §2 D1–D11, H5, I2, I3).

All predicates are built-in expressions; on a Parquet inventory the range
predicates (size, modified) reach the scan as ``PushedFilters``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DISPLAY_LIMIT, LARGE_LIMIT
from .common import attach_one_row

SEARCH_FIELDS = {"name": "name", "extension": "extension", "path": "full_path"}
PRESETS = ("all", "duplicates", "empty", "large", "recent")


def contains_ci(col: str | Column, text: str) -> Column:
    """Case-insensitive literal substring test (``_`` and ``%`` are plain characters)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.contains(F.lower(c), F.lit(text.lower()))


def find_files(inv: DataFrame, pattern: str, option: str = "name") -> DataFrame:
    """Name / extension / full path contains ``pattern`` (ignoring case)."""
    if option not in SEARCH_FIELDS:
        return inv
    return inv.where(contains_ci(SEARCH_FIELDS[option], pattern))


def filter_by_size(inv: DataFrame, min_size: int, max_size: int) -> DataFrame:
    """Both ends inclusive."""
    return inv.where(F.col("size").between(F.lit(min_size), F.lit(max_size)))


def filter_by_date(inv: DataFrame, start: str, end: str) -> DataFrame:
    """D3: modified between start and end, both inclusive (timestamps without zone)."""
    return inv.where(F.col("modified").between(F.lit(start).cast("timestamp_ntz"),
                                               F.lit(end).cast("timestamp_ntz")))


def preset(inv: DataFrame, name: str, as_of: str | None = None) -> DataFrame:
    """All, duplicates (primaries too), empty, large (> 100 MiB), recent (≥ as_of − 7 days)."""
    if name == "duplicates":
        return inv.where(F.col("is_duplicate"))
    if name == "empty":
        return inv.where(F.col("size") == 0)
    if name == "large":
        return inv.where(F.col("size") > LARGE_LIMIT)
    if name == "recent":
        if as_of is None:
            raise ValueError("the 'recent' preset needs an explicit as_of time")
        start = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
        return inv.where(F.col("modified") >= start)
    if name == "all":
        return inv
    raise ValueError(f"unknown preset {name!r}; choose from {PRESETS}")


def search(inv: DataFrame, text: str | None) -> DataFrame:
    """Trimmed, lower-cased text in name OR extension OR directory; blank = no filter."""
    t = (text or "").strip().lower()
    if not t:
        return inv
    return inv.where(contains_ci("name", t) | contains_ci("extension", t) | contains_ci("directory", t))


def grid_page(inv: DataFrame, preset_name: str = "all", text: str | None = None,
              as_of: str | None = None, limit: int = DISPLAY_LIMIT, after: str | None = None) -> DataFrame:
    """H5: the next ``limit`` matching rows by path behind ``after``, each carrying the full match count.

    The page is a top-k (``TakeOrderedAndProject``); the count is a separate global
    aggregate attached as one row. ``search`` of ``preset`` gives all rows (D4, D9).
    """
    matched = search(preset(inv, preset_name, as_of), text)
    rest = matched if after is None else matched.where(F.col("full_path") > F.lit(after))
    page = rest.orderBy("full_path").limit(limit)
    total = matched.agg(F.count(F.lit(1)).alias("total_matches"))
    return attach_one_row(page, total)


def selected(inv: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows whose path is in the selection table (left-semi join)."""
    return inv.join(selection.select("full_path"), "full_path", "left_semi")


def distinct_directories(inv: DataFrame) -> DataFrame:
    """I2."""
    return inv.select("directory").distinct()


def remove_paths(inv: DataFrame, removed: DataFrame) -> DataFrame:
    """Inventory without the rows that were staged (left-anti join on the path)."""
    return inv.join(removed.select("full_path"), "full_path", "left_anti")


def union_roots(*inventories: DataFrame) -> DataFrame:
    """Several listings as one (by column name)."""
    out = inventories[0]
    for other in inventories[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
