"""Profiles of an inventory (survey §2 E1–E9, H1–H5, B5).

Everything is a hash aggregate with a partial (map-side) step, or a top-k
(``TakeOrderedAndProject``); there is no global sort and no single-partition
window. The exact median works on two bounded levels of counts (see
``median_size``) instead of buffering every value in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import LARGE_LIMIT
from .common import attach_one_row
from .hierarchy import ancestors

KIB = 1024
MIB = 1024 * 1024

# Fixed values of the reference: size buckets (label, lower bound inclusive), in order.
SIZE_BUCKETS = [
    ("0-1KB", None),
    ("1KB-100KB", KIB),
    ("100KB-1MB", 100 * KIB),
    ("1MB-10MB", MIB),
    ("10MB-100MB", 10 * MIB),
    ("100MB+", 100 * MIB),
]


def totals(inv: DataFrame, approx_directories: bool = False) -> DataFrame:
    """Files, bytes, empty files, distinct parent directories, truncated average.

    ``approx_directories`` counts directories with HyperLogLog++ (no distinct shuffle).
    """
    dirs = F.approx_count_distinct("directory") if approx_directories else F.count_distinct("directory")
    return inv.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"),
        F.count_if(F.col("size") == 0).alias("empty_files"),
        dirs.alias("total_directories"),
    ).withColumn(
        "average_size",
        F.when(F.col("total_files") > 0, F.expr("total_size div total_files")).otherwise(F.lit(0)).cast("long"))


def entry_totals(entries: DataFrame) -> DataFrame:
    """E1/E2 on a listing (A1): files, bytes, empty files and *all* directories, root and
    empty ones included (the accurate count), truncated average."""
    files = ~F.col("is_dir")
    return entries.agg(
        F.count_if(files).alias("total_files"),
        F.coalesce(F.sum(F.when(files, F.col("size"))), F.lit(0)).cast("long").alias("total_size"),
        F.count_if(files & (F.col("size") == 0)).alias("empty_files"),
        F.count_if(F.col("is_dir")).alias("total_directories"),
    ).withColumn(
        "average_size",
        F.when(F.col("total_files") > 0, F.expr("total_size div total_files")).otherwise(F.lit(0)).cast("long"))


def median_size_approx(inv: DataFrame, accuracy: int = 10000) -> DataFrame:
    """E4 by option: ``percentile_approx`` (one partial/final aggregate, bounded memory)."""
    return inv.agg(F.coalesce(F.percentile_approx("size", 0.5, accuracy), F.lit(0)).cast("long").alias("median_size"))


def _running_counts(buckets: DataFrame, key: str, group_bits: int) -> DataFrame:
    """Adds ``before``/``cum``: rows in smaller keys / up to this key (``c`` = rows of the key).

    Keys are grouped by ``key >> group_bits``: a running sum over the (few) groups, then one
    per group over at most 2^group_bits keys — no window ever sees all keys at once.
    """
    grouped = buckets.withColumn("_g", F.shiftright(key, group_bits))
    groups = grouped.groupBy("_g").agg(F.sum("c").alias("_gc"))
    wg = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_gbefore", F.coalesce(F.sum("_gc").over(wg), F.lit(0)))
    wk = Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (grouped.join(groups.select("_g", "_gbefore"), "_g", "inner")
            .withColumn("cum", F.col("_gbefore") + F.sum("c").over(wk))
            .withColumn("before", F.col("cum") - F.col("c"))
            .drop("_g", "_gbefore"))


def median_size(inv: DataFrame, shift: int = 20, group_bits: int = 10) -> DataFrame:
    """Exact median of ``size`` (even count: integer mean of the two middle values; 0 if empty).

    Bounded levels instead of one task holding every value:
    1. counts per coarse bucket ``size >> shift`` (a partial aggregate) and their running sum,
       taken per group of 2^group_bits buckets plus the groups' own running sum;
    2. only inside the one or two buckets that hold the middle ranks: counts per exact size,
       running sum plus the bucket's offset.
    No window sees more than 2^group_bits buckets, the bucket groups (size range >> (shift +
    group_bits)) or 2^shift distinct sizes, whatever the row count.
    """
    sized = inv.select(F.col("size")).where(F.col("size").isNotNull())
    counts = sized.groupBy(F.shiftright("size", shift).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))  # from the same exchange: no read of its own
    # ranks of the middle values (1-based): lo = (n+1) div 2, hi = n div 2 + 1
    ranks = n.select("n", F.expr("(n + 1) div 2").alias("r_lo"), F.expr("n div 2 + 1").alias("r_hi"))
    buckets = _running_counts(counts, "bucket", group_bits)
    targets = (attach_one_row(buckets, ranks)
               .where(((F.col("r_lo") > F.col("before")) & (F.col("r_lo") <= F.col("cum")))
                      | ((F.col("r_hi") > F.col("before")) & (F.col("r_hi") <= F.col("cum"))))
               .select("bucket", "before"))
    # at most two target buckets: a proven-size broadcast
    inner = (sized.withColumn("bucket", F.shiftright("size", shift))
             .join(F.broadcast(targets), "bucket", "inner")
             .groupBy("bucket", "before", "size").agg(F.count(F.lit(1)).alias("c")))
    inner = inner.withColumn("cum", F.col("before") + F.sum("c").over(Window.partitionBy("bucket").orderBy("size")
                                                                       .rowsBetween(Window.unboundedPreceding,
                                                                                    Window.currentRow)))
    inner = inner.withColumn("first", F.col("cum") - F.col("c") + 1)
    picked = attach_one_row(inner, ranks).agg(
        F.max(F.when((F.col("r_lo") >= F.col("first")) & (F.col("r_lo") <= F.col("cum")), F.col("size"))).alias("lo"),
        F.max(F.when((F.col("r_hi") >= F.col("first")) & (F.col("r_hi") <= F.col("cum")), F.col("size"))).alias("hi"),
        F.max("n").alias("n"),
    )
    return picked.select(
        F.when(F.col("n").isNull() | (F.col("n") == 0), F.lit(0))
         .when(F.col("n") % 2 == 1, F.col("lo"))
         .otherwise(F.expr("(lo + hi) div 2")).cast("long").alias("median_size"))


def extremes(inv: DataFrame) -> DataFrame:
    """E5: largest, smallest non-empty, oldest, newest file (whole record).

    ``min_by``/``max_by`` aggregates, no sort; ties go to the smallest path.
    """
    rec = F.struct("full_path", "size", "modified")
    micros = C.epoch_micros("modified")
    rows = inv.agg(
        F.min_by(rec, F.struct((-F.col("size")).alias("k"), F.col("full_path"))).alias("largest"),
        F.min_by(F.when(F.col("size") > 0, rec),
                 F.when(F.col("size") > 0, F.struct(F.col("size").alias("k"), F.col("full_path")))).alias("smallest"),
        # a file of unknown time is neither
        F.min_by(rec, F.when(micros.isNotNull(), F.struct(micros.alias("k"), F.col("full_path")))).alias("oldest"),
        F.min_by(rec, F.when(micros.isNotNull(), F.struct((-micros).alias("k"), F.col("full_path")))).alias("newest"),
    )
    kinds = ["largest", "smallest", "oldest", "newest"]
    stacked = rows.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"{k}.full_path").alias("full_path"),
                 F.col(f"{k}.size").alias("size"), F.col(f"{k}.modified").alias("modified"))
        for k in kinds])).alias("r")).select("r.*")
    return stacked.where(F.col("full_path").isNotNull())


def extension_breakdown(inv: DataFrame) -> DataFrame:
    """Count, total, truncated average per extension ('No Extension' for none)."""
    return (inv.groupBy(C.breakdown_key("extension").alias("extension"))
            .agg(F.count(F.lit(1)).alias("file_count"),
                 F.sum("size").cast("long").alias("total_size"))
            .withColumn("average_size", F.expr("total_size div file_count").cast("long")))


def group_by_extension(inv: DataFrame) -> DataFrame:
    """E6 (members form): each file with its dot-less lower-case extension key."""
    return inv.select(C.extension_key("extension").alias("extension_key"), "full_path", "size")


def size_histogram(inv: DataFrame) -> DataFrame:
    """Six half-open buckets in one conditional aggregate; empty buckets present."""
    s = F.col("size")
    conds = []
    for i, (label, lo) in enumerate(SIZE_BUCKETS):
        hi = SIZE_BUCKETS[i + 1][1] if i + 1 < len(SIZE_BUCKETS) else None
        c = F.lit(True)
        if lo is not None:
            c = c & (s >= lo)
        if hi is not None:
            c = c & (s < hi)
        conds.append(F.count_if(c).alias(f"b{i}"))
    agg = inv.agg(*conds)
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("bucket_ord"), F.lit(label).alias("bucket"), F.col(f"b{i}").alias("file_count"))
        for i, (label, _) in enumerate(SIZE_BUCKETS)])).alias("r")).select("r.*")


def large_card(inv: DataFrame) -> DataFrame:
    """Count and bytes of files over 100 MiB."""
    big = F.col("size") > LARGE_LIMIT
    return inv.agg(F.count_if(big).alias("large_files"),
                   F.coalesce(F.sum(F.when(big, F.col("size"))), F.lit(0)).cast("long").alias("large_bytes"))


def dashboard(inv: DataFrame, duplicates: DataFrame, root: str) -> DataFrame:
    """One row of dashboard figures from one read of the inventory. Folders are ``root`` and all folders on the way to
    a file; ``duplicates`` is ``duplicate_summary``'s row."""
    figures = inv.groupBy("directory").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count_if(F.col("size") == 0).alias("e"),
        F.count_if(F.col("size") > LARGE_LIMIT).alias("ln"), F.coalesce(F.sum(F.when(F.col("size") > LARGE_LIMIT, F.col("size"))), F.lit(0)).alias("lb"))
    # a folder's own row carries the figures, its ancestors' rows only the name
    rows = figures.select(F.explode(F.concat(
        F.array(F.struct(F.col("directory").alias("d"), "n", "b", "e", "ln", "lb")),
        F.transform(ancestors(F.col("directory")), lambda a: F.struct(a.alias("d"), *[F.lit(0).cast("long").alias(c) for c in ("n", "b", "e", "ln", "lb")])))).alias("r")).select("r.*")
    folders = rows.groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "b", "e", "ln", "lb")])
    below = (F.col("d") == F.lit(root)) | F.col("d").startswith(root + "/")
    total = folders.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_files"), F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("total_size"),
                        F.count_if(below).alias("folders"), F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("empty_files"),
                        F.coalesce(F.sum("ln"), F.lit(0)).cast("long").alias("large_files"), F.coalesce(F.sum("lb"), F.lit(0)).cast("long").alias("large_bytes"))
    return attach_one_row(total, duplicates).select(
        "total_files", C.format_bytes("total_size").alias("total_size_text"), "folders", "duplicate_files", "duplicate_groups",
        C.format_bytes("wasted_bytes").alias("wasted_text"), "empty_files", "large_files", C.format_bytes("large_bytes").alias("large_size_text"))


def top_extensions_share(inv: DataFrame, n: int = 8) -> DataFrame:
    """Top-n extensions by count with their share of the shown total."""
    top = extension_breakdown(inv).orderBy(F.col("file_count").desc(), F.col("extension")).limit(n)
    shown = top.agg(F.sum("file_count").alias("shown"))
    return (attach_one_row(top, shown)
            .select("extension", "file_count",
                    (F.col("file_count") / F.col("shown")).alias("share"),
                    F.expr("file_count * 1000000 div shown").alias("share_ppm")))


def largest(inv: DataFrame, n: int = 10) -> DataFrame:
    """H1."""
    return inv.orderBy(F.col("size").desc(), F.col("full_path")).limit(n).select("full_path", "size", "modified")


def oldest(inv: DataFrame, n: int = 10) -> DataFrame:
    """H2. A file of unknown time comes last."""
    return inv.orderBy(F.col("modified").asc_nulls_last(), F.col("full_path")).limit(n).select("full_path", "size", "modified")


def newest(inv: DataFrame, n: int = 10) -> DataFrame:
    """H3."""
    return inv.orderBy(F.col("modified").desc(), F.col("full_path")).limit(n).select("full_path", "size", "modified")
