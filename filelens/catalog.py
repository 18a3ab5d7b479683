"""Registered queries: one per operator key of the survey (§2).

Every query takes ``(spark, sf_dir)``, reads the driver's tables through
``filelens.fixtures`` and returns a DataFrame. The matching DuckDB text lives in
``filelens.oracle``; column names are the same in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import columns as C
from .operators import duplicates as D
from .operators import filters as FL
from .operators import hierarchy as H
from .operators import intervals as IV
from .operators import stats as S
from .operators.common import materialize
from .plans import relocation as R
from .plans import safety as SF
from .sinks import report as RP
from .sources import inventory_source as A

# Fixed test parameters of the registered queries.
FAST_CHUNK = 64          # partial digest chunk for the small documents (reference: 64 KiB)
FAST_THRESHOLD = 1024    # partial digest from this size up (reference: 1 MiB)
SEARCH_TEXT = "  ORDERS "
DATE_FROM, DATE_TO = "1996-01-01 00:00:00", "1996-12-31 23:59:59"
SIZE_FROM, SIZE_TO = 1024, 102400

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---- shared building blocks ---------------------------------------------------------------------

def _docs(spark, sf_dir):
    return X.inv_docs(spark, sf_dir)


def _digested(spark, sf_dir, checkpoint=False):
    return D.digest_candidates(_docs(spark, sf_dir), checkpoint=checkpoint)


def _groups(docs):
    # equal digests imply equal sizes: groups need no candidate join
    return D.duplicate_groups(D.column_digests(docs))


def _members(spark, sf_dir):
    # digests feed both the group aggregate and the join back: hash once
    return D.group_members(_digested(spark, sf_dir, checkpoint=True))


def _marked(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return D.mark_inventory(docs, D.digest_candidates(docs, checkpoint=True))


# ---- F: duplicates -------------------------------------------------------------------------------

@query("duplicate_summary")
def q_duplicate_summary(spark, sf_dir):
    """E10 (flagship): groups, members, wasted bytes."""
    return D.duplicate_summary(_groups(_docs(spark, sf_dir)))


@query("duplicate_groups")
def q_duplicate_groups(spark, sf_dir):
    """among the files that share their size (G1)."""
    return D.duplicate_groups(_digested(spark, sf_dir))


@query("duplicate_groups_full")
def q_duplicate_groups_full(spark, sf_dir):
    return _groups(_docs(spark, sf_dir))


@query("duplicate_groups_fast")
def q_duplicate_groups_fast(spark, sf_dir):
    """partial digests, then full ones for the members they suspect."""
    return _fast(_docs(spark, sf_dir), FAST_CHUNK, FAST_THRESHOLD)


def _fast(docs, chunk, threshold):
    fast = materialize(D.column_digests(docs, "fast", chunk=chunk, threshold=threshold))  # narrow; read for the groups and for the filter
    return D.duplicate_groups(D.verify_groups(fast, docs))


@query("duplicate_groups_verified")
def q_duplicate_groups_verified(spark, sf_dir):
    """F5 where most partial groups are wrong: one byte at three places of a text decides."""
    return _fast(_docs(spark, sf_dir), 1, 1)


@query("candidate_count")
def q_candidate_count(spark, sf_dir):
    """E11."""
    return D.candidate_count(_docs(spark, sf_dir))


@query("hash_candidates")
def q_hash_candidates(spark, sf_dir):
    return D.hash_candidates(_docs(spark, sf_dir)).select("full_path", "size")


@query("content_md5")
def q_content_md5(spark, sf_dir):
    return D.content_digest(_docs(spark, sf_dir)).select("full_path", "hash")


@query("partial_md5")
def q_partial_md5(spark, sf_dir):
    eligible = D.hash_eligible(_docs(spark, sf_dir))
    return D.fast_digest(eligible, chunk=FAST_CHUNK, threshold=FAST_THRESHOLD).select("full_path", "size", "hash")


@query("marked_duplicates")
def q_marked_duplicates(spark, sf_dir):
    return _marked(spark, sf_dir).select("full_path", "size", "hash", "is_duplicate", "duplicate_group_id",
                                         "is_primary", "primary_file_path")


@query("primary_files")
def q_primary_files(spark, sf_dir):
    return _members(spark, sf_dir).select("full_path", "duplicate_group_id", "is_primary", "primary_file_path")


@query("duplicate_with_primary")
def q_duplicate_with_primary(spark, sf_dir):
    digested = _digested(spark, sf_dir, checkpoint=True)
    return D.with_primary_record(D.group_members(digested)).select(
        "full_path", "primary_path", "primary_size", "primary_modified", "primary_created")


@query("removable_copies")
def q_removable_copies(spark, sf_dir):
    return D.removable_copies(_members(spark, sf_dir)).select(
        "full_path", "size", "duplicate_group_id", "primary_file_path")


@query("preset_duplicates")
def q_preset_duplicates(spark, sf_dir):
    return FL.preset(_marked(spark, sf_dir), "duplicates").select("full_path", "size")


# ---- C: projections --------------------------------------------------------------------------------

@query("status_display")
def q_status_display(spark, sf_dir):
    m = _marked(spark, sf_dir)
    return m.select("full_path", C.status_display("is_primary", "is_duplicate", "size", "is_read_only").alias("status"))


@query("export_rows")
def q_export_rows(spark, sf_dir):
    return RP.export_rows(_marked(spark, sf_dir)).toDF("name", "extension", "size_text", "path", "modified_text", "duplicate", "primary_file")


@query("text_head")
def q_text_head(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.where(C.file_kind("extension") == "text").select("full_path", C.text_head("content", "size").alias("preview"))


@query("file_properties")
def q_file_properties(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("name", "full_path", C.format_bytes("size").alias("size_text"),
                    F.upper("extension").alias("type"), C.timestamp_text("created").alias("created_text"),
                    C.timestamp_text("modified").alias("modified_text"), "attributes")


@query("format_bytes")
def q_format_bytes(spark, sf_dir):
    return X.inv_orders(spark, sf_dir).select("full_path", "size", C.format_bytes("size").alias("size_text"))


@query("file_age_days")
def q_file_age_days(spark, sf_dir):
    """C7, also from dates before 1700 and a microsecond off whole days."""
    o = X.inv_orders(spark, sf_dir)
    o = o.unionByName(o.select(*[c for c in o.columns if c not in ("full_path", "modified")],
                               F.concat("full_path", F.lit("#old")).alias("full_path"),
                               F.expr("timestampadd(MICROSECOND, 1, timestampadd(DAY, -146000, "
                                      "timestampadd(SECOND, -unix_timestamp(modified) % 86400, modified)))").alias("modified")))
    return o.select("full_path", C.file_age_days("modified", F.lit(X.AS_OF).cast("timestamp_ntz")).alias("age_days"))


@query("grid_rows")
def q_grid_rows(spark, sf_dir):
    """The grid of the marked documents, with the three marks."""
    m = _marked(spark, sf_dir)
    return m.select("full_path", "name", "extension", C.format_bytes("size").alias("size_text"), "primary_file_path", "directory",
                    C.timestamp_text("modified").alias("modified_text"), "is_duplicate",
                    C.is_empty("size").alias("is_empty"), C.is_large("size").alias("is_large"))


@query("file_kind")
def q_file_kind(spark, sf_dir):
    o = X.inv_orders(spark, sf_dir)
    return o.select("full_path", C.file_kind("extension").alias("kind"),
                    C.preview_mode("extension", "size").alias("preview"))


@query("filetime_to_ts")
def q_filetime_to_ts(spark, sf_dir):
    """C14: FILETIME words made from ``modified`` with odd microseconds and ticks, turned back into a timestamp."""
    o = X.inv_orders(spark, sf_dir)
    ticks = (C.epoch_micros("modified") + F.lit(C.FILETIME_EPOCH_OFFSET_MICROS)) * 10 + (F.col("size") * 7919 + 123457) % 9999999
    words = o.withColumn("lo_u", ticks.bitwiseAND(F.lit(4294967295))).select("full_path", "modified",
                     F.shiftright(ticks, 32).cast("int").alias("hi"),
                     F.expr("cast(if(lo_u >= 2147483648, lo_u - 4294967296, lo_u) as int)").alias("lo"))
    return words.select("full_path", "modified", "hi", "lo",
                        C.filetime_to_timestamp("hi", "lo").alias("converted"))


@query("path_parts")
def q_path_parts(spark, sf_dir):
    p = X.inv_pages(spark, sf_dir)
    return p.select("page_id", "full_path", "name", "directory", "extension",
                    C.extension_key("extension").alias("extension_key"), C.stem_of("name").alias("stem"))


@query("safe_name")
def q_safe_name(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", C.safe_file_name("url").alias("safe_name"))


@query("shorten_path")
def q_shorten_path(spark, sf_dir):
    p = X.inv_pages(spark, sf_dir)
    return p.select("page_id", C.shorten_path("full_path", 60).alias("short_path"),
                    C.shorten_path("name", 50).alias("short_name"))


# ---- D: filters --------------------------------------------------------------------------------------

@query("find_by_name")
def q_find_by_name(spark, sf_dir):
    return FL.find_files(_docs(spark, sf_dir), "DOC_1", "name").select("full_path")


@query("find_by_extension")
def q_find_by_extension(spark, sf_dir):
    return FL.find_files(_docs(spark, sf_dir), "TX", "extension").select("full_path")


@query("find_by_path")
def q_find_by_path(spark, sf_dir):
    return FL.find_files(_docs(spark, sf_dir), "/SRC1", "path").select("full_path")


@query("filter_by_size")
def q_filter_by_size(spark, sf_dir):
    return FL.filter_by_size(X.inv_orders(spark, sf_dir), SIZE_FROM, SIZE_TO).select("full_path", "size")


@query("filter_by_date")
def q_filter_by_date(spark, sf_dir):
    return FL.filter_by_date(X.inv_orders(spark, sf_dir), DATE_FROM, DATE_TO).select("full_path", "modified")


@query("preset_empty")
def q_preset_empty(spark, sf_dir):
    return FL.preset(X.inv_orders(spark, sf_dir), "empty").select("full_path", "size")


@query("preset_large")
def q_preset_large(spark, sf_dir):
    return FL.preset(X.inv_orders(spark, sf_dir), "large").select("full_path", "size")


@query("preset_recent")
def q_preset_recent(spark, sf_dir):
    return FL.preset(X.inv_orders(spark, sf_dir), "recent", X.AS_OF).select("full_path", "modified")


@query("search_files")
def q_search_files(spark, sf_dir):
    """All matches."""
    return FL.search(FL.preset(X.inv_orders(spark, sf_dir), "all"), SEARCH_TEXT).select("full_path", "size")


@query("search_items")
def q_search_items(spark, sf_dir):
    """D9 over every line item."""
    return FL.search(X.inv_items(spark, sf_dir), ".TXT").select("full_path", "size")


@query("search_grid")
def q_search_grid(spark, sf_dir):
    """H5: one page of the matches, from a start key on."""
    page = FL.grid_page(X.inv_orders(spark, sf_dir), "all", SEARCH_TEXT, X.AS_OF, after="/lake/orders/F/3")
    return page.select("full_path", "size", "total_matches")


# ---- E/H: statistics -------------------------------------------------------------------------------

@query("inventory_stats")
def q_inventory_stats(spark, sf_dir):
    return S.totals(X.inv_orders(spark, sf_dir))


@query("median_size")
def q_median_size(spark, sf_dir):
    return S.median_size(X.inv_items(spark, sf_dir))


@query("extreme_files")
def q_extreme_files(spark, sf_dir):
    return S.extremes(X.inv_orders(spark, sf_dir))


@query("extension_breakdown")
def q_extension_breakdown(spark, sf_dir):
    return S.extension_breakdown(X.inv_orders(spark, sf_dir))


@query("group_by_extension")
def q_group_by_extension(spark, sf_dir):
    return S.group_by_extension(X.inv_orders(spark, sf_dir))


@query("size_histogram")
def q_size_histogram(spark, sf_dir):
    return S.size_histogram(X.inv_orders(spark, sf_dir))


@query("top8_extension_share")
def q_top8_extension_share(spark, sf_dir):
    top = S.top_extensions_share(X.inv_orders(spark, sf_dir), 8)
    return top.select("extension", "file_count", "share_ppm")


@query("largest_files")
def q_largest_files(spark, sf_dir):
    return S.largest(X.inv_orders(spark, sf_dir), 10)


@query("oldest_files")
def q_oldest_files(spark, sf_dir):
    return S.oldest(X.inv_orders(spark, sf_dir), 10)


@query("newest_files")
def q_newest_files(spark, sf_dir):
    return S.newest(X.inv_orders(spark, sf_dir), 10)


@query("dashboard_cards")
def q_dashboard_cards(spark, sf_dir):
    """One row of dashboard figures for the documents inventory."""
    docs = _docs(spark, sf_dir)
    return S.dashboard(docs, D.duplicate_summary(_groups(docs)), X.DOCS_ROOT)


@query("report_summary")
def q_report_summary(spark, sf_dir):
    """B2 summary sheet."""
    return RP.summary_rows(_marked(spark, sf_dir)).toDF("total_files", "total_size_text", "duplicate_files")


@query("report_duplicates")
def q_report_duplicates(spark, sf_dir):
    """B3 duplicates sheet."""
    return _members(spark, sf_dir).select("duplicate_group_id", "full_path", "size", "is_primary")


@query("report_extensions")
def q_report_extensions(spark, sf_dir):
    """B3 extension sheet (documents)."""
    return S.extension_breakdown(_docs(spark, sf_dir))


# ---- I/J/G: sets and hierarchy ---------------------------------------------------------------------

@query("union_roots")
def q_union_roots(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.lit("/lake").alias("root"), "full_path", "size")
    pages = X.inv_pages(spark, sf_dir).select(F.lit("/web").alias("root"), "full_path", "size")
    return FL.union_roots(docs, pages)


@query("distinct_directories")
def q_distinct_directories(spark, sf_dir):
    return FL.distinct_directories(X.inv_orders(spark, sf_dir))


@query("directory_sizes")
def q_directory_sizes(spark, sf_dir):
    return H.directory_sizes(X.inv_orders(spark, sf_dir))


@query("directory_sizes_visible")
def q_directory_sizes_visible(spark, sf_dir):
    """J1 without hidden and system files."""
    return H.directory_sizes(X.inv_orders(spark, sf_dir), ("is_hidden", "is_system"))


@query("visible_files")
def q_visible_files(spark, sf_dir):
    """A3."""
    return A.visible_only(X.inv_orders(spark, sf_dir)).select("full_path", "size")


@query("files_outside_system")
def q_files_outside_system(spark, sf_dir):
    """A4: documents as files, their language folders as folders, two of which are system folders."""
    docs = _docs(spark, sf_dir).select("full_path", "directory", "is_dir", "is_system")
    folders = docs.select(F.col("directory").alias("full_path")).distinct().select(
        "full_path", C.parent_directory("full_path").alias("directory"), F.lit(True).alias("is_dir"),
        F.col("full_path").rlike("/src[12]/(de|en)$").alias("is_system"))
    return A.without_system(docs.unionByName(folders)).select("full_path", "is_dir")


@query("folder_tree")
def q_folder_tree(spark, sf_dir):
    return H.folder_tree(X.inv_orders(spark, sf_dir).select(F.col("directory").alias("path")), "path", "/")


@query("report_paths")
def q_report_paths(spark, sf_dir):
    good, _ = H.report_paths(X.report_lines(spark, sf_dir))
    return good


@query("report_rejects")
def q_report_rejects(spark, sf_dir):
    """Report lines without a sixth field go to the reject frame."""
    _, rejects = H.report_paths(X.report_lines(spark, sf_dir))
    return rejects


@query("report_tree")
def q_report_tree(spark, sf_dir):
    return H.report_tree(X.report_lines(spark, sf_dir))


@query("empty_folders")
def q_empty_folders(spark, sf_dir):
    return H.empty_folders(X.expected_folders(spark, sf_dir), _docs(spark, sf_dir), X.DOCS_ROOT)


@query("valid_paths")
def q_valid_paths(spark, sf_dir):
    """A10: probe paths (a .txt name per document, and each document's folder) against the inventory."""
    docs = _docs(spark, sf_dir)
    base = X.table(spark, sf_dir, "documents")
    probes = (base.select(F.concat(F.lit("/lake/"), "source", F.lit("/"), "lang", F.lit("/doc_"),
                                   F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
              .unionByName(base.select(F.concat(F.lit("/lake/"), "source", F.lit("/"), "lang").alias("path")))
              .distinct())
    entries = docs.select("full_path").unionByName(docs.select(F.explode(H.ancestors(F.col("directory"))).alias("full_path")))
    return A.valid_paths(probes, entries).select("path", "is_valid")


# ---- K: plans --------------------------------------------------------------------------------------

def _selection(spark, sf_dir):
    return X.selection(spark, sf_dir)


@query("unsafe_groups")
def q_unsafe_groups(spark, sf_dir):
    return SF.unsafe_groups(_members(spark, sf_dir), _selection(spark, sf_dir))


@query("safe_selection")
def q_safe_selection(spark, sf_dir):
    return SF.safe_selection(_members(spark, sf_dir), _selection(spark, sf_dir))


@query("delete_summary")
def q_delete_summary(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    digested = D.digest_candidates(docs, checkpoint=True)
    safe = SF.safe_selection(D.group_members(digested), _selection(spark, sf_dir))
    return SF.delete_summary(D.mark_inventory(docs, digested), safe)


@query("selection_summary")
def q_selection_summary(spark, sf_dir):
    """Selection within all matches of a search on the documents."""
    return SF.selection_summary(FL.search(_docs(spark, sf_dir), "src1"), _selection(spark, sf_dir))


@query("review_decisions")
def q_review_decisions(spark, sf_dir):
    return SF.review_decisions(X.review_log(spark, sf_dir))


def _move_input(spark, sf_dir):
    return X.plan_input(spark, sf_dir).select("full_path", "name", "size")


@query("move_plan")
def q_move_plan(spark, sf_dir):
    return R.move_plan(_move_input(spark, sf_dir), X.MOVE_TARGET, X.occupied_targets(spark, sf_dir))


@query("copy_plan")
def q_copy_plan(spark, sf_dir):
    return R.copy_plan(_move_input(spark, sf_dir), X.MOVE_TARGET, X.occupied_targets(spark, sf_dir))


def _staging_existing(spark, sf_dir):
    """Files already in the staging tree: the targets of doc_id < 20, each also as stem_1.ext."""
    docs = _docs(spark, sf_dir).where("doc_id < 20")
    tdir = R.staging_target_dir(X.DOCS_ROOT)
    first = docs.select(F.concat(tdir, F.lit("/"), F.col("name")).alias("full_path"))
    second = docs.select(F.concat(tdir, F.lit("/"), C.stem_of("name"), F.lit("_1"),
                                  C.raw_extension("name")).alias("full_path"))
    return first.unionByName(second)


def _staging(spark, sf_dir):
    safe = SF.safe_selection(_members(spark, sf_dir), _selection(spark, sf_dir))
    files = _docs(spark, sf_dir).join(safe, "full_path", "left_semi").select("full_path", "name", "directory", "size")
    return R.staging_plan(files, X.DOCS_ROOT, _staging_existing(spark, sf_dir))


@query("copy_selection_plan")
def q_copy_selection_plan(spark, sf_dir):
    """K2 + K8 from a selection table: every document plus a missing twin of each one whose id
    is a multiple of 7 (missing sources become 'failed' rows)."""
    docs = _docs(spark, sf_dir)
    sel = docs.select("full_path").unionByName(
        docs.where("doc_id % 7 = 0").select(F.concat("full_path", F.lit(".missing")).alias("full_path")))
    return R.plan_selection(docs, sel, "copy", destination="/backup")


@query("staging_plan")
def q_staging_plan(spark, sf_dir):
    return _staging(spark, sf_dir)


@query("plan_summary")
def q_plan_summary(spark, sf_dir):
    return R.plan_summary(_staging(spark, sf_dir))


@query("inventory_after_staging")
def q_inventory_after_staging(spark, sf_dir):
    staged = _staging(spark, sf_dir).select(F.col("source").alias("full_path"))
    return FL.remove_paths(_docs(spark, sf_dir), staged).select("full_path", "size")


@query("folder_intervals")
def q_folder_intervals(spark, sf_dir):
    """Pre-order interval labels of all folders of the orders inventory."""
    return IV.label_folders(X.inv_orders(spark, sf_dir).select("directory"))


@query("subtree_totals")
def q_subtree_totals(spark, sf_dir):
    """J1 by running sums over interval labels."""
    return IV.subtree_totals(X.inv_orders(spark, sf_dir))
