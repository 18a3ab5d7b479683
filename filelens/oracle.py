"""DuckDB SQL for each registered query (the correctness oracle).

The inventories of ``filelens.fixtures`` are written again here as common table
expressions in DuckDB's dialect; every query text is self-contained and runs on
the pre-registered views (documents, orders, lineitem, pages, …).
"""

from __future__ import annotations

EXT = ("CASE {k} % 8 WHEN 0 THEN '.txt' WHEN 1 THEN '.TXT' WHEN 2 THEN '.md' WHEN 3 THEN '.log' "
       "WHEN 4 THEN '.json' WHEN 5 THEN '' WHEN 6 THEN '.png' ELSE '.tar.gz' END")

NAME = r"regexp_extract({p}, '([^/\\]*)$', 1)"
DIRECTORY = r"regexp_extract({p}, '^(.*)[/\\][^/\\]*$', 1)"
EXTENSION = r"lower(regexp_extract(" + NAME + r", '(\.[^.]+)$', 1))"
RAW_EXT = r"regexp_extract({n}, '(\.[^.]+)$', 1)"
ATTRS = ("concat_ws(', ', CASE WHEN is_read_only THEN 'ReadOnly' END, CASE WHEN is_hidden THEN 'Hidden' END, "
         "CASE WHEN is_system THEN 'System' END, 'Archive')")


def _parts(p: str = "full_path") -> str:
    return (f"{NAME.format(p=p)} AS name, {DIRECTORY.format(p=p)} AS directory, "
            f"{EXTENSION.format(p=p)} AS extension")


def fmt_bytes(x: str) -> str:
    units = [("TB", 1099511627776), ("GB", 1073741824), ("MB", 1048576), ("KB", 1024)]
    arms = " ".join(
        f"WHEN {x} >= {v} THEN regexp_replace(printf('%.2f', round({x} / {float(v)}, 2)), '\\.?0+$', '') || ' {u}'"
        for u, v in units)
    return f"(CASE {arms} ELSE cast({x} AS VARCHAR) || ' B' END)"


INV_DOCS = f"""
docs_base AS (
  SELECT concat('/lake/', source, '/', lang, '/doc_', cast(doc_id AS VARCHAR), {EXT.format(k='doc_id')}) AS full_path,
         cast(strlen(text) AS BIGINT) AS size,
         timestamp '2024-01-01 00:00:00' + to_minutes(cast((doc_id*7919) % 43200 AS INTEGER)) AS modified,
         timestamp '2023-01-01 00:00:00' + to_minutes(cast((doc_id*104729) % 43200 AS INTEGER)) AS created,
         doc_id % 11 = 0 AS is_read_only, doc_id % 13 = 0 AS is_hidden, doc_id % 17 = 0 AS is_system,
         doc_id, text AS content
  FROM documents),
inv_docs AS (SELECT *, {_parts()}, {ATTRS} AS attributes FROM docs_base)"""

INV_ORDERS = f"""
orders_base AS (
  SELECT concat('/lake/orders/', o_orderstatus, '/', o_orderpriority, '/c', cast(o_custkey % 50 AS VARCHAR),
                '/o_', cast(o_orderkey AS VARCHAR), {EXT.format(k='o_orderkey')}) AS full_path,
         cast(CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 89 = 0 THEN 104857600
              ELSE (((o_orderkey*2654435761) % 1048576)
                    * (CASE o_orderkey % 6 WHEN 3 THEN 8 WHEN 4 THEN 64 WHEN 5 THEN 512 ELSE 1 END))
                   // (CASE o_orderkey % 6 WHEN 0 THEN 2048 WHEN 1 THEN 32 ELSE 1 END) END AS BIGINT) AS size,
         cast(o_orderdate + to_minutes(cast(o_orderkey % 1440 AS INTEGER)) AS TIMESTAMP) AS modified,
         cast(o_orderdate - to_minutes(cast((o_orderkey*31) % 100000 AS INTEGER)) AS TIMESTAMP) AS created,
         o_orderkey % 11 = 0 AS is_read_only, o_orderkey % 13 = 0 AS is_hidden, o_orderkey % 17 = 0 AS is_system
  FROM orders),
inv_orders AS (SELECT *, {_parts()}, {ATTRS} AS attributes FROM orders_base)"""

INV_ITEMS = f"""
items_base AS (
  SELECT concat('/lake/items/', l_returnflag, l_linestatus, '/s', cast(l_suppkey AS VARCHAR), '/',
                cast(l_orderkey AS VARCHAR), '-', cast(l_partkey AS VARCHAR), '-', cast(l_linenumber AS VARCHAR),
                {EXT.format(k='l_partkey')}) AS full_path,
         cast(l_quantity AS BIGINT) * ((l_orderkey*2654435761 + l_partkey*97) % 4194304) AS size,
         cast(l_shipdate AS TIMESTAMP) AS modified
  FROM lineitem),
inv_items AS (SELECT *, {_parts()} FROM items_base)"""

INV_PAGES = f"""
pages_base AS (
  SELECT page_id, url, concat('/web/', regexp_replace(url, '^https?://([^?#]*).*$', '\\1')) AS full_path,
         cast(strlen(html) AS BIGINT) AS size
  FROM pages),
inv_pages AS (SELECT *, {_parts()} FROM pages_base)"""

CANDIDATES = """
eligible AS (SELECT * FROM inv_docs WHERE size > 0),
cand AS (SELECT * FROM eligible WHERE size IN (SELECT size FROM eligible GROUP BY size HAVING count(*) > 1))"""

DIGESTED = CANDIDATES + """,
dig AS (SELECT full_path, size, created, upper(md5(content)) AS hash FROM cand),
ranked AS (SELECT *, count(*) OVER (PARTITION BY size, hash) AS file_count,
                  first_value(full_path) OVER (PARTITION BY size, hash ORDER BY created, full_path) AS primary_path
           FROM dig),
members AS (SELECT full_path, size, hash, hash AS duplicate_group_id, file_count, primary_path,
                   full_path = primary_path AS is_primary,
                   CASE WHEN full_path = primary_path THEN '★ PRIMARY FILE' ELSE primary_path END AS primary_file_path
            FROM ranked WHERE file_count > 1),
grp AS (SELECT hash AS duplicate_group_id, size, count(*) AS file_count, (count(*) - 1) * size AS wasted_bytes
        FROM dig GROUP BY size, hash HAVING count(*) > 1),
marked AS (SELECT d.*, coalesce(g.hash, '') AS hash, m.full_path IS NOT NULL AS is_duplicate,
                  coalesce(m.duplicate_group_id, '') AS duplicate_group_id, coalesce(m.is_primary, false) AS is_primary,
                  m.primary_file_path
           FROM inv_docs d LEFT JOIN dig g USING (full_path) LEFT JOIN members m USING (full_path))"""

SELECTION = """
selection AS (SELECT full_path FROM inv_docs WHERE doc_id % 3 <> 1),
sel_members AS (SELECT * FROM members WHERE full_path IN (SELECT full_path FROM selection)),
unsafe AS (SELECT duplicate_group_id, size, file_count, count(*) AS selected_count FROM sel_members
           GROUP BY duplicate_group_id, size, file_count HAVING count(*) = file_count),
safe AS (SELECT full_path FROM selection
         WHERE full_path NOT IN (SELECT full_path FROM members WHERE is_primary
                                 AND (SELECT count(*) FROM unsafe) > 0))"""

STAGING = """
staged_files AS (
  SELECT full_path, name, size, doc_id,
         CASE WHEN directory = '/lake' THEN '/lake/FileAnalysis_Staging'
              ELSE '/lake/FileAnalysis_Staging/' || substring(directory, 7) END AS target_dir
  FROM inv_docs WHERE full_path IN (SELECT full_path FROM safe)),
existing AS (
  SELECT target_dir || '/' || name AS full_path FROM (
      SELECT name, CASE WHEN directory = '/lake' THEN '/lake/FileAnalysis_Staging'
                        ELSE '/lake/FileAnalysis_Staging/' || substring(directory, 7) END AS target_dir,
             doc_id FROM inv_docs) t WHERE doc_id < 20
  UNION ALL
  SELECT target_dir || '/' || left(name, length(name) - length(""" + RAW_EXT.format(n="name") + """)) || '_1'
         || """ + RAW_EXT.format(n="name") + """ FROM (
      SELECT name, CASE WHEN directory = '/lake' THEN '/lake/FileAnalysis_Staging'
                        ELSE '/lake/FileAnalysis_Staging/' || substring(directory, 7) END AS target_dir,
             doc_id FROM inv_docs) t WHERE doc_id < 20),
ex AS (SELECT lower(""" + DIRECTORY.format(p="full_path") + """) AS tdir_l, lower(""" + NAME.format(p="full_path") + """) AS name_l
       FROM existing),
ex_parts AS (SELECT tdir_l, name_l,
                    left(name_l, length(name_l) - length(""" + RAW_EXT.format(n="name_l") + """)) AS stem_l,
                    """ + RAW_EXT.format(n="name_l") + """ AS ext_l FROM ex),
blocked_rows AS (
  SELECT tdir_l, name_l, 0::BIGINT AS idx FROM ex_parts
  UNION
  SELECT tdir_l, regexp_extract(stem_l, '^(.*)_([1-9][0-9]{0,17})$', 1) || ext_l AS name_l,
         cast(regexp_extract(stem_l, '^(.*)_([1-9][0-9]{0,17})$', 2) AS BIGINT) AS idx
  FROM ex_parts WHERE regexp_matches(stem_l, '^(.*)_([1-9][0-9]{0,17})$')),
blocked AS (SELECT tdir_l, name_l, list_sort(list(idx)) AS b FROM blocked_rows GROUP BY tdir_l, name_l),
staged_ranked AS (
  SELECT f.*, row_number() OVER (PARTITION BY lower(target_dir), lower(name) ORDER BY full_path) - 1 AS r
  FROM staged_files f),
staged AS (
  SELECT s.full_path AS source,
         s.target_dir || '/' || CASE WHEN j = 0 THEN s.name
              ELSE left(s.name, length(s.name) - length(""" + RAW_EXT.format(n="s.name") + """)) || '_'
                   || cast(j AS VARCHAR) || """ + RAW_EXT.format(n="s.name") + """ END AS target,
         'stage' AS action, s.size
  FROM (SELECT sr.*, coalesce(list_reduce(bl.b, lambda acc, x: CASE WHEN x <= acc THEN acc + 1 ELSE acc END, sr.r),
                             sr.r) AS j
        FROM staged_ranked sr LEFT JOIN blocked bl
          ON bl.tdir_l = lower(sr.target_dir) AND bl.name_l = lower(sr.name)) s)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


def _move(action: str) -> str:
    return _with(INV_DOCS, """
plan_in AS (SELECT full_path, size, doc_id,
                   concat('doc_', cast(doc_id % 50 AS VARCHAR), CASE WHEN doc_id % 7 = 3 THEN '_' || cast(1 + doc_id % 3 AS VARCHAR) ELSE '' END,
                          """ + EXT.format(k="doc_id") + """) AS name
            FROM inv_docs),
parts AS (SELECT *, left(name, length(name) - length(""" + RAW_EXT.format(n="name") + """)) AS stem, """ + RAW_EXT.format(n="name") + """ AS ext
          FROM plan_in),
-- the loop itself, one file a turn; names of unlike extensions never meet
queue AS (SELECT *, lower(ext) AS lane, row_number() OVER (PARTITION BY lower(ext) ORDER BY full_path) AS turn FROM parts),
taken AS (SELECT lower(ext) AS lane, list(DISTINCT lower(stem || s || ext)) AS names
          FROM parts, (VALUES (''), ('_1'), ('_3')) t(s) WHERE doc_id < 10 GROUP BY lower(ext)),
replay AS (
  SELECT DISTINCT queue.lane, cast(0 AS BIGINT) AS turn, coalesce(names, []) AS names, cast(NULL AS VARCHAR) AS source,
                  cast(NULL AS VARCHAR) AS target, cast(NULL AS BIGINT) AS size
  FROM queue LEFT JOIN taken USING (lane)
  UNION ALL
  SELECT lane, turn, list_append(names, lower(target)), source, target, size
  FROM (SELECT q.lane, q.turn, r.names, q.full_path AS source, q.size,
               list_filter(list_transform(range(0, len(r.names) + 1), lambda k: q.stem || CASE WHEN k = 0 THEN '' ELSE '_' || cast(k AS VARCHAR) END || q.ext),
                           lambda c: NOT list_contains(r.names, lower(c)))[1] AS target
        FROM replay r JOIN queue q ON q.lane = r.lane AND q.turn = r.turn + 1))""").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT source, '/dest/' || target AS target, '{action}' AS action, size FROM replay WHERE turn > 0"""


def _ancestors_sql(col: str) -> str:
    """One row per (value, ancestor) as a lateral list."""
    return (f"list_transform(range(1, len(string_split({col}, '/')) + 1), "
            f"lambda i: CASE WHEN array_to_string(string_split({col}, '/')[1:i], '/') = '' THEN '/' "
            f"ELSE array_to_string(string_split({col}, '/')[1:i], '/') END)")


ORACLE: dict[str, str] = {}

# ---- F ----
ORACLE["duplicate_summary"] = _with(INV_DOCS, DIGESTED) + """
SELECT count(*) AS duplicate_groups, cast(coalesce(sum(file_count), 0) AS BIGINT) AS duplicate_files,
       cast(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS wasted_bytes FROM grp"""
ORACLE["duplicate_groups"] = _with(INV_DOCS, DIGESTED) + "\nSELECT * FROM grp"
ORACLE["duplicate_groups_full"] = _with(INV_DOCS, """
eligible AS (SELECT * FROM inv_docs WHERE size > 0),
dig AS (SELECT size, upper(md5(content)) AS hash FROM eligible)""") + """
SELECT hash AS duplicate_group_id, size, count(*) AS file_count, (count(*) - 1) * size AS wasted_bytes
FROM dig GROUP BY size, hash HAVING count(*) > 1"""
PARTIAL = ("CASE WHEN size < 1024 THEN upper(md5(content)) ELSE upper(md5(encode(content)[1:64] "
           "|| CASE WHEN size > 128 THEN encode(content)[size // 2 + 1 : size // 2 + 64] ELSE ''::BLOB END "
           "|| CASE WHEN size > 64 THEN encode(content)[size - 63 : size] ELSE ''::BLOB END)) END")
ORACLE["duplicate_groups_fast"] = ORACLE["duplicate_groups"]
ORACLE["candidate_count"] = _with(INV_DOCS, CANDIDATES) + """
SELECT count(*) AS candidate_files, cast(coalesce(sum(size), 0) AS BIGINT) AS candidate_bytes FROM cand"""
ORACLE["hash_candidates"] = _with(INV_DOCS, CANDIDATES) + "\nSELECT full_path, size FROM cand"
ORACLE["content_md5"] = _with(INV_DOCS) + "\nSELECT full_path, upper(md5(content)) AS hash FROM inv_docs"
ORACLE["partial_md5"] = _with(INV_DOCS) + f"""
SELECT full_path, size, {PARTIAL} AS hash FROM inv_docs WHERE size > 0"""
ORACLE["marked_duplicates"] = _with(INV_DOCS, DIGESTED) + """
SELECT full_path, size, hash, is_duplicate, duplicate_group_id, is_primary, primary_file_path FROM marked"""
ORACLE["primary_files"] = _with(INV_DOCS, DIGESTED) + """
SELECT full_path, duplicate_group_id, is_primary, primary_file_path FROM members"""
ORACLE["duplicate_with_primary"] = _with(INV_DOCS, DIGESTED) + """
SELECT m.full_path, m.primary_path, d.size AS primary_size, d.modified AS primary_modified,
       d.created AS primary_created
FROM members m JOIN inv_docs d ON d.full_path = m.primary_path WHERE NOT m.is_primary"""
ORACLE["removable_copies"] = _with(INV_DOCS, DIGESTED) + """
SELECT full_path, size, duplicate_group_id, primary_file_path FROM members WHERE NOT is_primary"""
ORACLE["preset_duplicates"] = _with(INV_DOCS, DIGESTED) + "\nSELECT full_path, size FROM marked WHERE is_duplicate"

# ---- C ----
ORACLE["status_display"] = _with(INV_DOCS, DIGESTED) + """
SELECT full_path, concat_ws(' | ', CASE WHEN is_primary THEN '★ PRIMARY' WHEN is_duplicate THEN '🔄 Duplicate' END,
                            CASE WHEN size = 0 THEN '📄 Empty' END, CASE WHEN size > 104857600 THEN '💎 Large' END,
                            CASE WHEN is_read_only THEN '🔒 Read-Only' END) AS status
FROM marked"""
ORACLE["export_rows"] = _with(INV_DOCS, DIGESTED) + f"""
SELECT name, extension, {fmt_bytes('size')} AS size_text, full_path AS path,
       strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified_text,
       CASE WHEN is_duplicate THEN 'Yes' ELSE 'No' END AS duplicate, coalesce(primary_file_path, '') AS primary_file
FROM marked"""
TEXT_EXTS = "('.txt', '.log', '.xml', '.json', '.csv', '.md', '.cs', '.xaml', '.html', '.css', '.js', '.py', '.java', '.cpp', '.h', '.sql')"
IMAGE_EXTS = "('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.ico', '.tiff')"
ORACLE["text_head"] = _with(INV_DOCS) + f"""
SELECT full_path,
       CASE WHEN length(content) > 10000 THEN substring(content, 1, 10000) || chr(10) || chr(10) || '... (content truncated for preview)'
            ELSE content END AS preview
FROM inv_docs WHERE lower(extension) IN {TEXT_EXTS}"""
ORACLE["file_properties"] = _with(INV_DOCS) + f"""
SELECT name, full_path, {fmt_bytes('size')} AS size_text, upper(extension) AS type,
       strftime(created, '%Y-%m-%d %H:%M:%S') AS created_text, strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified_text,
       attributes
FROM inv_docs"""
ORACLE["format_bytes"] = _with(INV_ORDERS) + f"\nSELECT full_path, size, {fmt_bytes('size')} AS size_text FROM inv_orders"
ORACLE["file_age_days"] = _with(INV_ORDERS, """
aged AS (SELECT full_path, modified FROM inv_orders
         UNION ALL SELECT full_path || '#old', modified - to_seconds(epoch_us(modified) // 1000000 % 86400) - to_days(146000)
                          + to_microseconds(1) FROM inv_orders)""") + """
SELECT full_path, (epoch_us(timestamp '2001-08-01 12:00:00') - epoch_us(modified)) // 86400000000 AS age_days FROM aged"""
ORACLE["grid_rows"] = _with(INV_DOCS, DIGESTED) + f"""
SELECT full_path, name, extension, {fmt_bytes('size')} AS size_text, primary_file_path, directory,
       strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified_text, is_duplicate, size = 0 AS is_empty, size > 104857600 AS is_large
FROM marked"""
ORACLE["file_kind"] = _with(INV_ORDERS) + f"""
SELECT full_path,
       CASE WHEN lower(extension) IN {TEXT_EXTS} THEN 'text' WHEN lower(extension) IN {IMAGE_EXTS} THEN 'image'
            ELSE 'other' END AS kind,
       CASE WHEN lower(extension) IN {TEXT_EXTS} AND size <= 1048576 THEN 'text'
            WHEN lower(extension) IN {IMAGE_EXTS} AND size <= 10485760 THEN 'image'
            ELSE 'properties' END AS preview
FROM inv_orders"""
ORACLE["filetime_to_ts"] = _with(INV_ORDERS, """
ft AS (SELECT full_path, modified, (epoch_us(modified) + 11644473600000000) * 10 + (size * 7919 + 123457) % 9999999 AS ticks FROM inv_orders),
words AS (SELECT full_path, modified, cast(ticks >> 32 AS INTEGER) AS hi,
                 cast(CASE WHEN (ticks & 4294967295) >= 2147483648 THEN (ticks & 4294967295) - 4294967296
                           ELSE ticks & 4294967295 END AS INTEGER) AS lo
          FROM ft)""") + """
SELECT full_path, modified, hi, lo,
       make_timestamp(((cast(hi AS BIGINT) << 32) | (cast(lo AS BIGINT) & 4294967295)) // 10 - 11644473600000000) AS converted
FROM words"""
ORACLE["path_parts"] = _with(INV_PAGES) + f"""
SELECT page_id, full_path, name, directory, extension,
       CASE WHEN extension = '' THEN 'No Extension' ELSE lower(ltrim(extension, '.')) END AS extension_key,
       left(name, length(name) - length({RAW_EXT.format(n='name')})) AS stem
FROM inv_pages"""
ORACLE["safe_name"] = r"""
SELECT page_id, array_to_string(list_filter(regexp_split_to_array(url, '[<>:"/\\|?*\x00-\x1f]'), lambda x: x <> ''), '_') AS safe_name
FROM pages"""
ORACLE["shorten_path"] = _with(INV_PAGES) + """
SELECT page_id, CASE WHEN length(full_path) > 60 THEN '...' || right(full_path, 57) ELSE full_path END AS short_path,
       CASE WHEN length(name) > 50 THEN '...' || right(name, 47) ELSE name END AS short_name
FROM inv_pages"""

# ---- D ----
ORACLE["find_by_name"] = _with(INV_DOCS) + "\nSELECT full_path FROM inv_docs WHERE contains(lower(name), 'doc_1')"
ORACLE["find_by_extension"] = _with(INV_DOCS) + "\nSELECT full_path FROM inv_docs WHERE contains(lower(extension), 'tx')"
ORACLE["find_by_path"] = _with(INV_DOCS) + "\nSELECT full_path FROM inv_docs WHERE contains(lower(full_path), '/src1')"
ORACLE["filter_by_size"] = _with(INV_ORDERS) + "\nSELECT full_path, size FROM inv_orders WHERE size BETWEEN 1024 AND 102400"
ORACLE["filter_by_date"] = _with(INV_ORDERS) + """
SELECT full_path, modified FROM inv_orders
WHERE modified BETWEEN timestamp '1996-01-01 00:00:00' AND timestamp '1996-12-31 23:59:59'"""
ORACLE["preset_empty"] = _with(INV_ORDERS) + "\nSELECT full_path, size FROM inv_orders WHERE size = 0"
ORACLE["preset_large"] = _with(INV_ORDERS) + "\nSELECT full_path, size FROM inv_orders WHERE size > 104857600"
ORACLE["preset_recent"] = _with(INV_ORDERS) + """
SELECT full_path, modified FROM inv_orders WHERE modified >= timestamp '2001-08-01 12:00:00' - INTERVAL 7 DAY"""
ORACLE["search_grid"] = _with(INV_ORDERS, """
matched AS (SELECT * FROM inv_orders WHERE contains(lower(name), 'orders') OR contains(lower(extension), 'orders')
                                        OR contains(lower(directory), 'orders'))""") + """
SELECT full_path, size, (SELECT count(*) FROM matched) AS total_matches
FROM (SELECT * FROM matched WHERE full_path > '/lake/orders/F/3' ORDER BY full_path LIMIT 10000) p"""
ORACLE["search_files"] = _with(INV_ORDERS) + """
SELECT full_path, size FROM inv_orders WHERE contains(lower(name), 'orders') OR contains(lower(extension), 'orders')
                                          OR contains(lower(directory), 'orders')"""
ORACLE["search_items"] = _with(INV_ITEMS) + """
SELECT full_path, size FROM inv_items WHERE contains(lower(name), '.txt') OR contains(lower(extension), '.txt')
                                         OR contains(lower(directory), '.txt')"""

# ---- E/H ----
ORACLE["inventory_stats"] = _with(INV_ORDERS) + """
SELECT count(*) AS total_files, cast(coalesce(sum(size), 0) AS BIGINT) AS total_size,
       count(*) FILTER (WHERE size = 0) AS empty_files, count(DISTINCT directory) AS total_directories,
       cast(CASE WHEN count(*) > 0 THEN coalesce(sum(size), 0) // count(*) ELSE 0 END AS BIGINT) AS average_size
FROM inv_orders"""
ORACLE["median_size"] = _with(INV_ITEMS, """
s AS (SELECT size, row_number() OVER (ORDER BY size) AS rn, count(*) OVER () AS n FROM inv_items WHERE size IS NOT NULL)""") + """
SELECT cast(coalesce(CASE WHEN max(n) % 2 = 1 THEN max(size) FILTER (WHERE rn = (n + 1) // 2)
                          ELSE (max(size) FILTER (WHERE rn = n // 2) + max(size) FILTER (WHERE rn = n // 2 + 1)) // 2
                     END, 0) AS BIGINT) AS median_size
FROM s"""
ORACLE["extreme_files"] = _with(INV_ORDERS) + """
SELECT * FROM (SELECT 'largest' AS kind, full_path, size, modified FROM inv_orders ORDER BY size DESC, full_path LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'smallest', full_path, size, modified FROM inv_orders WHERE size > 0
                         ORDER BY size, full_path LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'oldest', full_path, size, modified FROM inv_orders ORDER BY modified, full_path LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'newest', full_path, size, modified FROM inv_orders
                         ORDER BY modified DESC, full_path LIMIT 1)"""
BREAKDOWN = """
SELECT CASE WHEN extension = '' THEN 'No Extension' ELSE extension END AS extension, count(*) AS file_count,
       cast(sum(size) AS BIGINT) AS total_size, cast(sum(size) // count(*) AS BIGINT) AS average_size
FROM {t} GROUP BY 1"""
ORACLE["extension_breakdown"] = _with(INV_ORDERS) + BREAKDOWN.format(t="inv_orders")
ORACLE["group_by_extension"] = _with(INV_ORDERS) + """
SELECT CASE WHEN extension = '' THEN 'No Extension' ELSE lower(ltrim(extension, '.')) END AS extension_key,
       full_path, size FROM inv_orders"""
ORACLE["size_histogram"] = _with(INV_ORDERS) + """
SELECT * FROM (VALUES (0, '0-1KB'), (1, '1KB-100KB'), (2, '100KB-1MB'), (3, '1MB-10MB'), (4, '10MB-100MB'), (5, '100MB+'))
       b(bucket_ord, bucket)
LEFT JOIN (SELECT CASE WHEN size < 1024 THEN 0 WHEN size < 102400 THEN 1 WHEN size < 1048576 THEN 2
                       WHEN size < 10485760 THEN 3 WHEN size < 104857600 THEN 4 ELSE 5 END AS bucket_ord,
                  count(*) AS n FROM inv_orders GROUP BY 1) c USING (bucket_ord)
""".replace("SELECT * FROM (VALUES", "SELECT bucket_ord, bucket, coalesce(n, 0) AS file_count FROM (VALUES")
ORACLE["top8_extension_share"] = _with(INV_ORDERS, """
top AS (""" + BREAKDOWN.format(t="inv_orders") + """ ORDER BY file_count DESC, extension LIMIT 8)""") + """
SELECT extension, file_count,
       cast(file_count * 1000000 // (SELECT sum(file_count) FROM top) AS BIGINT) AS share_ppm FROM top"""
TOPN = "\nSELECT full_path, size, modified FROM inv_orders ORDER BY {o}, full_path LIMIT 10"
ORACLE["largest_files"] = _with(INV_ORDERS) + TOPN.format(o="size DESC")
ORACLE["oldest_files"] = _with(INV_ORDERS) + TOPN.format(o="modified")
ORACLE["newest_files"] = _with(INV_ORDERS) + TOPN.format(o="modified DESC")
ORACLE["dashboard_cards"] = _with(INV_DOCS, DIGESTED) + f"""
SELECT b.total_files, {fmt_bytes('b.total_size')} AS total_size_text, b.folders, g.duplicate_files, g.duplicate_groups,
       {fmt_bytes('g.wasted_bytes')} AS wasted_text, b.empty_files, b.large_files, {fmt_bytes('b.large_bytes')} AS large_size_text
FROM (SELECT count(*) AS total_files, cast(coalesce(sum(size), 0) AS BIGINT) AS total_size,
             (SELECT count(DISTINCT a) FROM (SELECT unnest(""" + _ancestors_sql("directory") + f""") AS a FROM inv_docs)
              WHERE a = '/lake' OR starts_with(a, '/lake/')) AS folders,
             count(*) FILTER (WHERE size = 0) AS empty_files, count(*) FILTER (WHERE size > 104857600) AS large_files,
             cast(coalesce(sum(size) FILTER (WHERE size > 104857600), 0) AS BIGINT) AS large_bytes FROM inv_docs) b,
     (SELECT count(*) AS duplicate_groups, cast(coalesce(sum(file_count), 0) AS BIGINT) AS duplicate_files,
             cast(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS wasted_bytes FROM grp) g"""
ORACLE["report_summary"] = _with(INV_DOCS, DIGESTED) + f"""
SELECT b.total_files, {fmt_bytes('b.total_size')} AS total_size_text, g.duplicate_files
FROM (SELECT count(*) AS total_files, cast(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM inv_docs) b,
     (SELECT cast(coalesce(sum(file_count), 0) AS BIGINT) AS duplicate_files FROM grp) g"""
ORACLE["report_duplicates"] = _with(INV_DOCS, DIGESTED) + """
SELECT duplicate_group_id, full_path, size, is_primary FROM members"""
ORACLE["report_extensions"] = _with(INV_DOCS) + BREAKDOWN.format(t="inv_docs")

# ---- I/J/G ----
ORACLE["union_roots"] = _with(INV_DOCS, INV_PAGES) + """
SELECT '/lake' AS root, full_path, size FROM inv_docs UNION ALL SELECT '/web' AS root, full_path, size FROM inv_pages"""
ORACLE["distinct_directories"] = _with(INV_ORDERS) + "\nSELECT DISTINCT directory FROM inv_orders"
ORACLE["directory_sizes"] = _with(INV_ORDERS, """
per_dir AS (SELECT directory, sum(size) AS s, count(*) AS n FROM inv_orders GROUP BY directory),
expl AS (SELECT DISTINCT directory, unnest(""" + _ancestors_sql("directory") + """) AS anc, s, n FROM per_dir)""") + """
SELECT anc AS directory, cast(sum(s) AS BIGINT) AS total_size, cast(sum(n) AS BIGINT) AS file_count
FROM expl GROUP BY anc"""
ORACLE["directory_sizes_visible"] = ORACLE["directory_sizes"].replace(
    "FROM inv_orders GROUP BY directory", "FROM inv_orders WHERE NOT (is_hidden OR is_system) GROUP BY directory")
ORACLE["visible_files"] = _with(INV_ORDERS) + "\nSELECT full_path, size FROM inv_orders WHERE NOT (is_hidden OR is_system)"
ORACLE["files_outside_system"] = _with(INV_DOCS) + """
SELECT full_path, false AS is_dir FROM inv_docs WHERE NOT is_system AND NOT regexp_matches(directory, '/src[12]/(de|en)$')
UNION ALL SELECT DISTINCT directory, true FROM inv_docs WHERE NOT regexp_matches(directory, '/src[12]/(de|en)$')"""
TREE = """
paths AS (SELECT DISTINCT {col} AS p FROM {src} WHERE {col} IS NOT NULL),
nodes AS (SELECT p, unnest(range(1, len(string_split(p, '{sep}')) + 1)) AS i FROM paths)"""
TREE_SELECT = """
SELECT DISTINCT cast(i AS INTEGER) AS level, string_split(p, '{sep}')[i] AS segment,
       CASE WHEN i > 1 THEN array_to_string(string_split(p, '{sep}')[1:i - 1], '{sep}') END AS parent_path,
       array_to_string(string_split(p, '{sep}')[1:i], '{sep}') AS node_path
FROM nodes"""
ORACLE["folder_tree"] = _with(INV_ORDERS, TREE.format(col="directory", src="inv_orders", sep="/")) + \
    TREE_SELECT.format(sep="/")
REPORT = """
report_lines AS (
  SELECT concat('0|1|2|3|4|', replace(full_path, '/', '\\'), '|6') AS value FROM inv_docs
  UNION ALL SELECT concat('page|', cast(page_id AS VARCHAR)) FROM pages),
report_fields AS (SELECT value, CASE WHEN len(string_split(value, '|')) >= 6 THEN string_split(value, '|')[6] END AS path
                  FROM report_lines),
report_good AS (
  SELECT path, CASE WHEN NOT regexp_matches(path, '[\\\\/]') THEN ''
                    WHEN regexp_extract(path, '^(.*)[\\\\/][^\\\\/]*$', 1) = '' THEN substring(path, 1, 1)
                    ELSE regexp_extract(path, '^(.*)[\\\\/][^\\\\/]*$', 1) END AS directory
  FROM report_fields WHERE path IS NOT NULL)"""
ORACLE["report_paths"] = _with(INV_DOCS, REPORT) + "\nSELECT path, directory FROM report_good"
ORACLE["report_tree"] = _with(INV_DOCS, REPORT, TREE.format(col="directory", src="report_good", sep="\\")) + \
    TREE_SELECT.format(sep="\\")
ORACLE["empty_folders"] = _with(INV_DOCS, """
expected AS (SELECT '/lake/' || source || '/' || l AS directory
             FROM (SELECT DISTINCT source FROM documents), unnest(['de', 'en', 'es', 'fr', 'it']) t(l)),
file_dirs AS (SELECT DISTINCT directory FROM inv_docs),
all_dirs AS (SELECT DISTINCT unnest(""" + _ancestors_sql("directory") + """) AS directory
             FROM (SELECT directory FROM expected UNION ALL SELECT directory FROM file_dirs)),
below AS (SELECT directory FROM all_dirs WHERE starts_with(directory, '/lake/')),
used AS (SELECT directory FROM file_dirs UNION SELECT """ + DIRECTORY.format(p="directory") + """ FROM below)""") + """
SELECT directory FROM below WHERE directory NOT IN (SELECT directory FROM used)"""
ORACLE["valid_paths"] = _with(INV_DOCS, """
probes AS (SELECT DISTINCT path FROM (
    SELECT '/lake/' || source || '/' || lang || '/doc_' || cast(doc_id AS VARCHAR) || '.txt' AS path FROM documents
    UNION ALL SELECT '/lake/' || source || '/' || lang FROM documents)),
known AS (SELECT full_path AS path FROM inv_docs
          UNION SELECT unnest(""" + _ancestors_sql("directory") + """) FROM inv_docs)""") + """
SELECT path, path IN (SELECT path FROM known) AS is_valid FROM probes"""

# ---- K ----
ORACLE["unsafe_groups"] = _with(INV_DOCS, DIGESTED, SELECTION) + """
SELECT duplicate_group_id, left(duplicate_group_id, 8) || '...' AS group_label, selected_count,
       file_count AS total_count, size FROM unsafe"""
ORACLE["safe_selection"] = _with(INV_DOCS, DIGESTED, SELECTION) + "\nSELECT full_path FROM safe"
ORACLE["delete_summary"] = _with(INV_DOCS, DIGESTED, SELECTION) + f"""
SELECT count(*) AS total_files, cast(coalesce(sum(size), 0) AS BIGINT) AS total_size,
       count(*) FILTER (WHERE is_duplicate) AS duplicate_files, count(*) FILTER (WHERE is_primary) AS primary_files,
       {fmt_bytes('cast(coalesce(sum(size), 0) AS BIGINT)')} AS total_size_text
FROM marked WHERE full_path IN (SELECT full_path FROM safe)"""
ORACLE["selection_summary"] = _with(INV_DOCS, """
matched AS (SELECT * FROM inv_docs WHERE contains(lower(name), 'src1') OR contains(lower(extension), 'src1')
                                      OR contains(lower(directory), 'src1')),
sel AS (SELECT * FROM matched WHERE full_path IN (SELECT full_path FROM inv_docs WHERE doc_id % 3 <> 1))""") + f"""
SELECT count(*) AS selected_files, cast(coalesce(sum(size), 0) AS BIGINT) AS selected_bytes,
       {fmt_bytes('cast(coalesce(sum(size), 0) AS BIGINT)')} AS selected_bytes_text
FROM sel"""
ORACLE["review_decisions"] = _with(INV_DOCS, """
log AS (SELECT full_path, 'mark' AS decision, modified AS decided_at FROM inv_docs WHERE doc_id % 5 = 0
        UNION ALL
        SELECT full_path, CASE WHEN doc_id % 2 = 0 THEN 'keep' ELSE 'mark' END, modified + INTERVAL 1 HOUR
        FROM inv_docs WHERE doc_id % 5 = 0
        UNION ALL SELECT full_path, 'mark', modified + INTERVAL 1 HOUR FROM inv_docs WHERE doc_id % 10 = 0),
latest AS (SELECT full_path, decision FROM log QUALIFY row_number() OVER (
             PARTITION BY full_path ORDER BY decided_at DESC, CASE decision WHEN 'keep' THEN 0 ELSE 1 END) = 1)""") + """
SELECT full_path, decision, decision = 'mark' AS is_selected, decision = 'mark' AS marked_for_removal FROM latest"""
ORACLE["move_plan"] = _move("move")
ORACLE["copy_plan"] = _move("copy")
ORACLE["staging_plan"] = _with(INV_DOCS, DIGESTED, SELECTION, STAGING) + "\nSELECT source, target, action, size FROM staged"
ORACLE["plan_summary"] = _with(INV_DOCS, DIGESTED, SELECTION, STAGING) + f"""
SELECT count(*) FILTER (WHERE action <> 'failed') AS planned_files,
       count(*) FILTER (WHERE action = 'failed') AS failed_files,
       cast(coalesce(sum(size) FILTER (WHERE action <> 'failed'), 0) AS BIGINT) AS planned_bytes,
       {fmt_bytes("cast(coalesce(sum(size) FILTER (WHERE action <> 'failed'), 0) AS BIGINT)")} AS planned_bytes_text
FROM staged"""
ORACLE["inventory_after_staging"] = _with(INV_DOCS, DIGESTED, SELECTION, STAGING) + """
SELECT full_path, size FROM inv_docs WHERE full_path NOT IN (SELECT source FROM staged)"""

ORACLE["duplicate_groups_verified"] = ORACLE["duplicate_groups"]
ORACLE["report_rejects"] = _with(INV_DOCS, REPORT) + """
SELECT value AS path, 'fewer than 6 fields' AS reason FROM report_fields WHERE path IS NULL"""
ORACLE["copy_selection_plan"] = _with(INV_DOCS) + """
SELECT full_path AS source, '/backup/' || name AS target, 'copy' AS action, size FROM inv_docs
UNION ALL
SELECT full_path || '.missing' AS source, CAST(NULL AS VARCHAR) AS target, 'failed' AS action,
       CAST(NULL AS BIGINT) AS size
FROM inv_docs WHERE doc_id % 7 = 0"""
ORACLE["folder_intervals"] = _with(INV_ORDERS, """
dirs AS (SELECT DISTINCT unnest(""" + _ancestors_sql("directory") + """) AS directory FROM inv_orders),
numbered AS (SELECT directory, row_number() OVER (ORDER BY string_split(CASE WHEN directory = '/' THEN '' ELSE directory END, '/')) - 1 AS first FROM dirs)""") + """
SELECT a.directory, a.first,
       (SELECT max(b.first) FROM numbered b WHERE b.directory = a.directory OR a.directory = '/' OR starts_with(b.directory, a.directory || '/')) AS last
FROM numbered a"""
ORACLE["subtree_totals"] = ORACLE["directory_sizes"]
