"""Scalar functions over inventory columns (survey §2 C1–C20).

All of them are built-in Column expressions, so they stay inside whole-stage
code generation. Each takes and returns ``Column`` objects (or names).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (IMAGE_PREVIEW_LIMIT, LARGE_LIMIT, PRIMARY_MARKER,
                      TEXT_PREVIEW_CHARS, TEXT_PREVIEW_LIMIT)

# Fixed values of the reference: unit names, status texts, file kinds.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
STATUS_PRIMARY = "★ PRIMARY"
STATUS_DUPLICATE = "🔄 Duplicate"
STATUS_EMPTY = "📄 Empty"
STATUS_LARGE = "💎 Large"
STATUS_READ_ONLY = "🔒 Read-Only"
TEXT_EXTENSIONS = [".txt", ".log", ".xml", ".json", ".csv", ".md", ".cs", ".xaml",
                   ".html", ".css", ".js", ".py", ".java", ".cpp", ".h", ".sql"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico", ".tiff"]
TEXT_TOO_LARGE = "File too large to preview (>1MB). Showing file properties instead."
TRUNCATION_NOTICE = "\n\n... (content truncated for preview)"
NO_EXTENSION = "No Extension"
# Characters that are not allowed in a Windows file name: < > : " / \ | ? * and 0x00-0x1F.
INVALID_NAME_CHARS = '[<>:"/\\\\|?*\\x00-\\x1f]'
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
FILETIME_EPOCH_OFFSET_MICROS = 11644473600000000  # 1601-01-01 → 1970-01-01


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def format_bytes(size) -> Column:
    """1024-based units up to TB, at most two decimals, trailing zeros dropped.

    ``round`` first (half up), then print with two decimals and strip zeros;
    ``format_number`` alone would round half-even.
    """
    s = _c(size)
    out = F.concat(s.cast("string"), F.lit(" B"))
    for power in range(1, len(SIZE_UNITS)):
        value = F.round(s.cast("double") / F.lit(float(1024 ** power)), 2)
        text = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
        out = F.when(s >= F.lit(1024 ** power), F.concat(text, F.lit(" " + SIZE_UNITS[power]))).otherwise(out)
    return out


# Path parts use anchored patterns (one pass, no retry at every start position) and read
# their input once, so derived columns stay small when Catalyst inlines them into filters.
_NAME_RE = r"^(?:.*[/\\])?([^/\\]*)$"
_DIR_RE = r"^(.*)[/\\]"
_EXT_RE = r"^.*(\.[^.]+)$"


def file_name(path) -> Column:
    """Last path segment (after the last / or \\)."""
    return F.regexp_extract(_c(path), _NAME_RE, 1)


def parent_directory(path) -> Column:
    """Everything before the last separator ('' when there is none)."""
    return F.regexp_extract(_c(path), _DIR_RE, 1)


def raw_extension(name) -> Column:
    """From the last dot of the name, including it, case kept; '' for no dot or a trailing dot."""
    return F.regexp_extract(_c(name), _EXT_RE, 1)


def extension_of(name) -> Column:
    """From the last dot including it, lower case; '' when there is no dot."""
    return F.lower(raw_extension(name))


def extension_key(ext) -> Column:
    """Extension without dot, 'No Extension' when empty."""
    e = _c(ext)
    return F.when(e == "", F.lit(NO_EXTENSION)).otherwise(F.lower(F.regexp_replace(e, r"^\.+", "")))


def breakdown_key(ext) -> Column:
    """E6 key: the extension with its dot, 'No Extension' when empty."""
    e = _c(ext)
    return F.when(e == "", F.lit(NO_EXTENSION)).otherwise(e)


def stem_of(name) -> Column:
    """File name without its extension (case kept)."""
    n = _c(name)
    return F.left(n, F.length(n) - F.length(raw_extension(n)))


def safe_file_name(name) -> Column:
    """Split on characters not allowed in names, drop empty pieces, join with '_'."""
    parts = F.split(_c(name), INVALID_NAME_CHARS)
    return F.array_join(F.filter(parts, lambda x: x != ""), "_")


def file_age_days(modified, as_of) -> Column:
    """Whole days between modified and as_of, toward zero."""
    return _div(epoch_micros(as_of) - epoch_micros(modified), _DAY_US)


def is_empty(size) -> Column:
    """C8."""
    return _c(size) == 0


def is_large(size) -> Column:
    """Strictly more than 100 MiB."""
    return _c(size) > F.lit(LARGE_LIMIT)


def status_display(is_primary, is_duplicate, size, is_read_only) -> Column:
    """PRIMARY else Duplicate; then Empty, Large, Read-Only; joined by ' | '."""
    first = F.when(_c(is_primary), F.lit(STATUS_PRIMARY)).when(_c(is_duplicate), F.lit(STATUS_DUPLICATE))
    return F.concat_ws(
        " | ",
        first,
        F.when(is_empty(size), F.lit(STATUS_EMPTY)),
        F.when(is_large(size), F.lit(STATUS_LARGE)),
        F.when(_c(is_read_only), F.lit(STATUS_READ_ONLY)),
    )


def timestamp_text(ts) -> Column:
    """C11."""
    return F.date_format(_c(ts), TIMESTAMP_FORMAT)


def file_kind(ext) -> Column:
    """Text / image / other by lower-case extension."""
    e = F.lower(_c(ext))
    return (F.when(e.isin(TEXT_EXTENSIONS), F.lit("text"))
             .when(e.isin(IMAGE_EXTENSIONS), F.lit("image"))
             .otherwise(F.lit("other")))


def preview_mode(ext, size) -> Column:
    """Which preview the file gets: text ≤ 1 MiB, image ≤ 10 MiB, else properties."""
    kind = file_kind(ext)
    s = _c(size)
    return (F.when((kind == "text") & (s <= TEXT_PREVIEW_LIMIT), F.lit("text"))
             .when((kind == "image") & (s <= IMAGE_PREVIEW_LIMIT), F.lit("image"))
             .otherwise(F.lit("properties")))


def text_head(content, size, chars: int = TEXT_PREVIEW_CHARS, max_size: int | None = None) -> Column:
    """The first ``chars`` characters of a text, with a notice where it goes on. Only with ``max_size`` are larger
    files answered by the "too large" notice instead."""
    c = _c(content)
    head = F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit(TRUNCATION_NOTICE))).otherwise(c)
    return head if max_size is None else F.when(_c(size) > max_size, F.lit(TEXT_TOO_LARGE)).otherwise(head)


def filetime_to_timestamp(hi, lo) -> Column:
    """C14: two 32-bit FILETIME words (100 ns since 1601) → timestamp_ntz (UTC wall time).

    The low word is taken unsigned (the reference sign-extends it, which is off by ~429 s).
    """
    ticks = F.shiftleft(_c(hi).cast("long"), 32).bitwiseOR(_c(lo).cast("long").bitwiseAND(F.lit(4294967295)))
    micros = _div(ticks, 10) - F.lit(FILETIME_EPOCH_OFFSET_MICROS)
    return from_epoch_micros(micros)


# Conversions between timestamp_ntz and epoch microseconds from calendar parts only, so that
# no session time zone (and no daylight-saving gap) takes part.
_DAY_US = 86400 * 1000000


def _div(a: Column, b: int) -> Column:
    """Whole-number division toward zero; ``/`` divides as double, which is off beyond 2^53."""
    return ((a - a % F.lit(b)).cast("decimal(20,0)") / F.lit(b)).cast("long")


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 of a timestamp without zone."""
    t = _c(ts)
    clock = (F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * 1000000 \
        + (F.date_part(F.lit("SECOND"), t) * 1000000).cast("long")
    return F.unix_date(F.to_date(t)).cast("long") * _DAY_US + clock


def from_epoch_micros(micros) -> Column:
    """timestamp_ntz from microseconds since 1970-01-01 00:00."""
    m = _c(micros)
    rest = F.pmod(m, F.lit(_DAY_US))
    days = _div(m - rest, _DAY_US).cast("int")
    d = F.date_add(F.lit("1970-01-01").cast("date"), days)
    secs = (rest % 60000000).cast("decimal(16,6)") / 1000000
    return F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d),
                                _div(rest, 3600000000).cast("int"), _div(rest % 3600000000, 60000000).cast("int"), secs)


def shorten_path(path, limit: int = 60) -> Column:
    """Over ``limit`` characters → '...' + the last ``limit - 3``."""
    p = _c(path)
    return F.when(F.length(p) > limit, F.concat(F.lit("..."), F.right(p, F.lit(limit - 3)))).otherwise(p)


def group_label(group_id) -> Column:
    """First 8 characters of the group id + '...'."""
    return F.concat(F.left(_c(group_id), F.lit(8)), F.lit("..."))


def md5_upper(content) -> Column:
    """C17: MD5 as 32 upper-case hex digits (binary or UTF-8 text)."""
    return F.upper(F.md5(_c(content).cast("binary")))


def partial_md5(content: str, size: str, chunk: int) -> Column:
    """MD5 of first chunk ‖ chunk at size/2 (when size > 2·chunk) ‖ last chunk (when size > chunk).

    Bytes, not characters. Used by the fast mode from the threshold up (1 MiB by default).
    """
    b = f"cast({content} as binary)"
    return F.expr(
        f"upper(md5(concat(substring({b}, 1, {chunk}), "
        f"if({size} > {2 * chunk}, substring({b}, cast({size} div 2 + 1 as int), {chunk}), X''), "
        f"if({size} > {chunk}, substring({b}, cast({size} - {chunk} + 1 as int), {chunk}), X''))))"
    )
