"""Duplicate detection (survey §2 F1–F7, G1, D10, E10, E11).

Plan shape for content in a column:

    scan ── md5 in the scan stage ── narrow rows (path, size, created, modified, hash)
                                      └─ groupBy(size, hash): count and oldest (created, path) in one aggregate

No exchange carries content. Equal (size, hash) implies equal size, so groups need no size pre-filter;
the candidates themselves (G1, E11) are narrow rows semi-joined on size. For files on disk the semi join
comes first, and only the candidates are read (A8). Groups are keyed by (size, hash); the group id shown to
users is the hash alone.

A size or group may hold a third of all rows. Aggregates are partial/final. The counts that the joins need anyway also say which keys are
hot (over 1 / ``HOT_SHARE`` of the counted rows, so at most ``HOT_SHARE`` keys): only these carry a salt from the path's hash, with their
statistics repeated once per salt, and are spread over ``SALTS`` tasks; every other key's statistics stay one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import PARTIAL_CHUNK, PARTIAL_THRESHOLD, PRIMARY_MARKER
from .common import materialize
from .membership import bits_for, may_hold, membership

SALTS = 32
HOT_SHARE = 1000


def _with_heat(stats: DataFrame, count: str) -> DataFrame:
    """``stats`` (one row per key) with ``_hot``: the key has over 1 / HOT_SHARE of all counted rows."""
    total = stats.agg(F.coalesce(F.sum(count), F.lit(0))).scalar()
    return stats.withColumn("_hot", F.col(count) * F.lit(HOT_SHARE) > total)


def _salted(df: DataFrame, heated: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a hot key get one of SALTS salts, the others salt 0."""
    # at most HOT_SHARE rows, whatever the input: small enough for a broadcast by its number
    hot = heated.where("_hot").select(*keys, "_hot")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("full_path"), F.lit(SALTS))).otherwise(0).cast("int")
    return df.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")


def _per_salt(heated: DataFrame) -> DataFrame:
    """The statistics of a hot key once per salt, the others once."""
    last = F.when(F.col("_hot"), F.lit(SALTS - 1)).otherwise(0)
    return heated.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")


def hash_eligible(inv: DataFrame, max_size: int | None = None) -> DataFrame:
    """Files that are not empty; ``max_size`` (exclusive) only when the caller asks for it."""
    out = inv.where(F.col("size") > 0)
    return out if max_size is None else out.where(F.col("size") < F.lit(max_size))


def hash_candidates(inv: DataFrame, max_size: int | None = None) -> DataFrame:
    """G1: eligible rows whose size occurs at least twice (salted left-semi join on size)."""
    eligible = hash_eligible(inv, max_size)
    shared = _with_heat(eligible.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "n")
    return (_salted(eligible, shared, ["size"]).join(_per_salt(shared.drop("n")), on=["size", "_salt"], how="left_semi")
            .select(*eligible.columns))


def candidate_count(inv: DataFrame) -> DataFrame:
    """How many files share their size with another one, and their bytes."""
    sizes = hash_eligible(inv).groupBy("size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("candidate_files"),
                     F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).cast("long").alias("candidate_bytes"))


def content_digest(df: DataFrame, content_col: str = "content") -> DataFrame:
    """A8/C17 for table content: upper-case MD5 of the bytes; rows with no content get ''."""
    return df.withColumn("hash", F.coalesce(C.md5_upper(F.col(content_col)), F.lit("")))


def fast_digest(df: DataFrame, content_col: str = "content", chunk: int = PARTIAL_CHUNK,
                threshold: int = PARTIAL_THRESHOLD) -> DataFrame:
    """F5 digest choice: full MD5 below ``threshold``, partial MD5 (C18) from it up."""
    full = C.md5_upper(F.col(content_col))
    part = C.partial_md5(content_col, "size", chunk)
    digest = F.coalesce(F.when(F.col("size") < threshold, full).otherwise(part), F.lit(""))
    return df.withColumn("hash", digest.alias("hash", metadata={"chunk": chunk, "threshold": threshold}))


def fast_parameters(digested: DataFrame) -> tuple[int, int]:
    """(chunk, threshold) that the column ``hash`` was made with; a frame of full digests has threshold None."""
    made = digested.schema["hash"].metadata
    return made.get("chunk", 0), made.get("threshold")


_NARROW = ("full_path", "size", "created", "modified", "hash")


def column_digests(inv: DataFrame, mode: str = "full", content_col: str = "content", chunk: int = PARTIAL_CHUNK,
                   threshold: int = PARTIAL_THRESHOLD, max_size: int | None = None) -> DataFrame:
    """Narrow digest rows of all eligible files with content in a column; content ends in the scan stage."""
    rows = hash_eligible(inv, max_size).where(F.col(content_col).isNotNull())
    rows = fast_digest(rows, content_col, chunk, threshold) if mode == "fast" else content_digest(rows, content_col)
    return rows.select(*[c for c in _NARROW if c in rows.columns])


def digest_candidates(inv: DataFrame, mode: str = "accurate", content_col: str = "content",
                      chunk: int = PARTIAL_CHUNK, threshold: int = PARTIAL_THRESHOLD, digests: DataFrame | None = None,
                      checkpoint: bool = False, max_size: int | None = None) -> DataFrame:
    """Candidates with a ``hash`` column: (full_path, size, created[, modified], hash).

    mode: ``accurate`` (only files that share their size), ``full`` (no pre-filter, F4), ``fast`` (partial MD5 from
    ``threshold`` up; a pre-filter only, see ``verify_groups``). ``digests`` (A8 output) replaces the content column for
    files on disk; when it carries the candidates' columns it is used as is. Unreadable files have an empty digest and take no part in
    groups (A11); ``digest_rejects`` lists them. ``checkpoint=True`` writes the narrow rows to the checkpoint folder, for
    callers that use them twice (groups and members).
    """
    if digests is not None:
        keep = [c for c in _NARROW if c in digests.columns or c in inv.columns]
        out = (digests if all(c in digests.columns for c in keep) else
               (hash_eligible(inv, max_size) if mode == "full" else hash_candidates(inv, max_size)).join(
                   digests.select("full_path", "hash"), "full_path", "inner"))
        out = out.where(F.col("hash") != "").select(*keep)
    else:
        out = column_digests(inv, mode, content_col, chunk, threshold, max_size)
        if mode != "full":
            out = hash_candidates(out, max_size)
    return materialize(out) if checkpoint else out


def digest_rejects(inv: DataFrame, content_col: str = "content") -> DataFrame:
    """Eligible files without readable content."""
    return hash_eligible(inv).where(F.col(content_col).isNull()).select("full_path", F.lit("no content").alias("reason"))


def suspects(fast_digested: DataFrame) -> DataFrame:
    """(size, hash, file_count) of the groups that rest on partial digests; those of smaller files are exact already."""
    threshold = fast_parameters(fast_digested)[1]
    rows = fast_digested.where(F.lit(False) if threshold is None else F.col("size") >= threshold)
    return rows.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("file_count")).where(F.col("file_count") > 1)


def suspected_members(fast_digested: DataFrame) -> DataFrame:
    """the files of suspected groups, without their partial digests: what has to be read in full (for files on disk)."""
    stats = _with_heat(suspects(fast_digested), "file_count")
    rows = _salted(fast_digested, stats, ["size", "hash"]).join(_per_salt(stats.drop("file_count")), ["size", "hash", "_salt"], "left_semi")
    return rows.select(*[c for c in fast_digested.columns if c not in ("hash", "error")])


def content_suspects(fast_digested: DataFrame, inv: DataFrame, content_col: str = "content") -> DataFrame:
    """the rows of ``inv`` with content whose partial digest may be suspected, found within the scan stage by a bounded membership
    filter. A row that passes by chance does no harm: its full digest is in no group."""
    chunk, threshold = fast_parameters(fast_digested)
    groups = suspects(fast_digested)
    bits = bits_for(groups.count())
    words = membership(groups, ["size", "hash"], bits)
    large = F.lit(False) if threshold is None else F.col("size") >= threshold
    rows = hash_eligible(inv).where(large & F.col(content_col).isNotNull())
    rows = rows.withColumn("hash", C.partial_md5(content_col, "size", chunk))
    return rows.where(may_hold(words, ["size", "hash"], bits)).drop("hash")


def verify_groups(fast_digested: DataFrame, inv: DataFrame | None = None, content_col: str = "content",
                  digests: DataFrame | None = None) -> DataFrame:
    """narrow rows whose groups have no false positives: files below the fast digests' threshold as they are (their digests are
    full ones), larger ones with full digests where a partial digest is suspected. Other content is never hashed in full.

    ``inv`` has the content in a column; for files on disk give ``digests`` instead: ``content.file_digests(suspected_members(...))``. The
    fast digests are read twice: store them (``checkpoint=True``) when they are costly.
    """
    threshold = fast_parameters(fast_digested)[1]
    small = fast_digested.where((F.lit(True) if threshold is None else F.col("size") < threshold) & (F.col("hash") != ""))
    if digests is not None:
        full = digests.where(F.col("hash") != "")
    else:
        full = content_digest(content_suspects(fast_digested, inv, content_col), content_col)
    keep = [c for c in _NARROW if c in small.columns and c in full.columns]
    return small.select(*keep).unionByName(full.select(*keep))


def group_stats(digested: DataFrame) -> DataFrame:
    """one row per duplicate group: members, and its primary's path and times. The primary is the oldest by creation time, then
    by path; a file of unknown age comes last."""
    order = [F.col("created").isNull().alias("unknown"), F.col("created").alias("created"), F.col("full_path").alias("path")]
    if "modified" in digested.columns:
        order.append(F.col("modified").alias("modified"))
    out = (digested.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("file_count"), F.min(F.struct(*order)).alias("_first"))
           .where(F.col("file_count") > 1))
    modified = F.col("_first.modified") if "modified" in digested.columns else F.lit(None).cast("timestamp_ntz")
    return out.select("size", "hash", "file_count", F.col("_first.path").alias("primary_path"),
                      F.col("_first.created").alias("primary_created"), modified.alias("primary_modified"))


def duplicate_groups(digested: DataFrame) -> DataFrame:
    """F1 result rows: group id (hash), size, members, wasted bytes."""
    return (group_stats(digested)
            .select(F.col("hash").alias("duplicate_group_id"), "size", "file_count",
                    ((F.col("file_count") - 1) * F.col("size")).alias("wasted_bytes")))


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """Groups, members (kept copy included), wasted bytes."""
    return groups.agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum("file_count"), F.lit(0)).cast("long").alias("duplicate_files"),
        F.coalesce(F.sum("wasted_bytes"), F.lit(0)).cast("long").alias("wasted_bytes"),
    )


def with_group(digested: DataFrame) -> DataFrame:
    """Digested rows with their group's statistics (null outside groups): one salted join."""
    keys = ["size", "hash"]
    stats = _with_heat(group_stats(digested), "file_count")
    return _salted(digested, stats, keys).join(_per_salt(stats), [*keys, "_salt"], "left").drop("_salt")


def _member_columns(rows: DataFrame) -> DataFrame:
    is_primary = F.col("full_path") == F.col("primary_path")
    return rows.withColumns({
        "is_duplicate": F.col("file_count").isNotNull(),
        "duplicate_group_id": F.when(F.col("file_count").isNotNull(), F.col("hash")),
        "is_primary": F.coalesce(is_primary, F.lit(False)),
        "primary_file_path": F.when(is_primary, F.lit(PRIMARY_MARKER)).otherwise(F.col("primary_path")),
    })


def group_members(digested: DataFrame) -> DataFrame:
    """members of duplicate groups with group id, primary flag and the primary's record."""
    rows = _member_columns(with_group(digested)).where("is_duplicate")
    return rows.select("full_path", "size", "hash", "duplicate_group_id", "is_duplicate", "is_primary", "primary_file_path",
                       "primary_path", "file_count", "primary_created", "primary_modified")


def mark_inventory(inv: DataFrame, digested: DataFrame) -> DataFrame:
    """the whole inventory with hash, is_duplicate, duplicate_group_id, is_primary, primary_file_path.

    ``hash`` is filled for every hashed candidate ('' for the rest); group columns only for members.
    """
    marked = _member_columns(with_group(digested)).select(
        "full_path", F.col("hash").alias("_hash"), "is_duplicate", "duplicate_group_id", "is_primary", "primary_file_path", "primary_path")
    out = inv.join(marked, "full_path", "left")
    return (out.withColumn("hash", F.coalesce(F.col("_hash"), F.lit("")))
               .withColumn("is_duplicate", F.coalesce(F.col("is_duplicate"), F.lit(False)))
               .withColumn("duplicate_group_id", F.coalesce(F.col("duplicate_group_id"), F.lit("")))
               .withColumn("is_primary", F.coalesce(F.col("is_primary"), F.lit(False)))
               .drop("_hash"))


def removable_copies(members: DataFrame) -> DataFrame:
    """group members that are not the primary."""
    return members.where(~F.col("is_primary"))


def with_primary_record(members: DataFrame) -> DataFrame:
    """for each non-primary member, the record of its primary (from the group's statistics, no join)."""
    return removable_copies(members).withColumn("primary_size", F.col("size"))
