"""A8, C17, C18 on real files: content digests computed where the files are.

Candidates (full_path, size) are spread by bytes — neither a size shared by a third of all files nor one
huge file may hold up a task with others — and each task streams its files
through MD5 in 1 MiB reads (``mapInPandas``: Arrow batches in and out). Files that
cannot be read get an empty digest and the error text (A11); the duplicate
operators drop them.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import materialize
from ..operators.ranking import stored_pieces
from ..schema import DIGEST_SCHEMA, PARTIAL_CHUNK, PARTIAL_THRESHOLD, TEXT_PREVIEW_CHARS, TEXT_PREVIEW_LIMIT
from ..streaming.progress import Progress

READ_BLOCK = 1024 * 1024


def md5_file(path: str) -> str:
    """C17: upper-case MD5 of the whole file."""
    h = hashlib.md5()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(READ_BLOCK), b""):
            h.update(block)
    return h.hexdigest().upper()


def partial_md5_file(path: str, size: int, chunk: int = PARTIAL_CHUNK) -> str:
    """MD5 of the first chunk, a chunk from size/2 (size > 2·chunk), the last chunk (size > chunk)."""
    h = hashlib.md5()
    with open(path, "rb") as f:
        h.update(f.read(chunk))
        if size > 2 * chunk:
            f.seek(size // 2)
            h.update(f.read(chunk))
        if size > chunk:
            f.seek(size - chunk)
            h.update(f.read(chunk))
    return h.hexdigest().upper()


def _digest_batches(mode: str, chunk: int, threshold: int, progress: Progress | None = None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes, errors = [], []
            for path, size in zip(pdf["full_path"], pdf["size"]):
                try:
                    if mode == "fast" and size is not None and size >= threshold:
                        hashes.append(partial_md5_file(path, int(size), chunk))
                    else:
                        hashes.append(md5_file(path))
                    errors.append(None)
                except OSError as e:
                    hashes.append("")
                    errors.append(f"{type(e).__name__}: {e.strerror or e}")
            out = pdf.copy()
            out["hash"] = hashes
            out["error"] = errors
            if progress is not None:
                failed = sum(e is not None for e in errors)
                progress.add(files_hashed=len(out) - failed, files_failed=failed,
                             bytes_hashed=sum(int(s) for s, e in zip(pdf["size"], errors) if e is None and s is not None))
            yield out
    return run


PASS_THROUGH = ("created", "modified")
TASK_BYTES = 256 << 20  # bytes to hash in a task (about)
FILE_COST = 64 << 10  # opening a file counts as so many bytes
_EVEN = 32  # files below 1 / 32 of a share are dealt evenly enough by a hash


def byte_balanced(files: DataFrame, task_bytes: int = TASK_BYTES, bytes_col: str = "size") -> DataFrame:
    """The rows of ``files`` (full_path, …) dealt to tasks that have at most a share of the bytes plus one file to read.

    The number of tasks follows the bytes (and keeps all cores busy with less). A task takes the files whose running sum of bytes
    begins in its share. Where every file is small against a share, a hash of the path deals them as evenly without that sum.
    """
    spark = files.sparkSession
    cost = (F.coalesce(bytes_col, F.lit(0)) + F.lit(FILE_COST)).cast("long")
    total, most = files.agg(F.coalesce(F.sum(cost), F.lit(0)), F.coalesce(F.max(cost), F.lit(0))).first()
    share = max(1, min(task_bytes, -(-total // (2 * spark.sparkContext.defaultParallelism))))
    n = max(1, -(-total // share))
    if most * _EVEN <= share:
        return files.repartition(n, F.xxhash64("full_path"))
    pieces = stored_pieces(files.withColumn("_cost", cost))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = pieces.groupBy("_pid").agg(F.sum("_cost").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    before = F.coalesce(F.sum("_cost").over(Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("_before", before).join(F.broadcast(offsets), "_pid")
    # numbers up to n from an exact running sum: dealt by number, not by a hash of it
    return placed.repartitionById(n, F.floor((F.col("_before") + F.col("_offset")) / F.lit(share)).cast("int")).select(*files.columns)


def file_digests(candidates: DataFrame, mode: str = "accurate", chunk: int = PARTIAL_CHUNK,
                 threshold: int = PARTIAL_THRESHOLD, partitions: int | None = None, task_bytes: int = TASK_BYTES,
                 progress: Progress | None = None) -> DataFrame:
    """(full_path, size, [created, modified,] hash, error) for each candidate file.

    ``mode='fast'`` uses C18 from ``threshold`` up. The candidates' ``created``/``modified``
    columns are carried through, so grouping and primary choice need no join back. Tasks are balanced by bytes (``byte_balanced``), of
    which a partial digest reads three chunks; ``partitions`` asks for a fixed number instead.
    """
    extra = [c for c in PASS_THROUGH if c in candidates.columns]
    rows = candidates.select("full_path", "size", *extra)
    made = {"chunk": chunk, "threshold": threshold} if mode == "fast" else {}
    fields = [DIGEST_SCHEMA["full_path"], DIGEST_SCHEMA["size"]] + \
        [candidates.schema[c] for c in extra] + [T.StructField("hash", T.StringType(), False, made), DIGEST_SCHEMA["error"]]
    schema = T.StructType(fields)
    if partitions:
        spread = rows.repartition(partitions, F.xxhash64("full_path"))
        return spread.mapInPandas(_digest_batches(mode, chunk, threshold, progress), schema)
    rows = materialize(rows)  # narrow; read for the bytes and for the digests
    if mode == "fast":
        read = F.when(F.col("size") >= threshold, F.least("size", F.lit(3 * chunk))).otherwise(F.col("size"))
        spread = byte_balanced(rows.withColumn("_read", read), task_bytes, "_read").drop("_read")
    else:
        spread = byte_balanced(rows, task_bytes)
    return spread.mapInPandas(_digest_batches(mode, chunk, threshold, progress), schema)


_MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"),
          (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]  # UTF-32's little-endian mark begins with UTF-16's


def read_head(path: str, chars: int, default: str = "utf-8") -> tuple[str, bool]:
    """The first ``chars`` characters of a text file, and whether it goes on. The encoding is told by a byte-order mark (else
    ``default``); only as many bytes are read as these characters need, and bytes that are no text become replacement characters."""
    with open(path, "rb") as f:
        head = f.read(4)
        mark, encoding = next(((m, e) for m, e in _MARKS if head.startswith(m)), (b"", default))
        decoder = codecs.getincrementaldecoder(encoding)("replace")
        text, rest = decoder.decode(head[len(mark):]), True
        while len(text) <= chars and rest:  # one more tells that the text goes on
            block = f.read(min(READ_BLOCK, max(64, chars + 1 - len(text))))
            rest = bool(block)
            text += decoder.decode(block, not block)
    return text[:chars], len(text) > chars


def _preview_batches(limit_bytes: int | None, chars: int, too_large: str, notice: str, default: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, size in zip(pdf["full_path"], pdf["size"]):
                if limit_bytes is not None and size is not None and size > limit_bytes:
                    out.append(too_large)
                    continue
                try:
                    text, more = read_head(path, chars, default)
                    out.append(text + notice if more else text)
                except OSError:
                    out.append(None)  # unreadable: no preview (the reference shows properties only)
            yield pd.DataFrame({"full_path": pdf["full_path"], "preview": out})
    return run


def text_previews(files: DataFrame, limit_bytes: int | None = TEXT_PREVIEW_LIMIT, chars: int = TEXT_PREVIEW_CHARS,
                  default_encoding: str = "utf-8") -> DataFrame:
    """A9 on real files: text-kind files → their first ``chars`` characters (plus the truncation notice); those over
    ``limit_bytes`` → the 'too large' notice (None: every file gets its head, however large). Each task reads its own files' heads."""
    from ..functions import columns as C
    text_files = files.where(C.file_kind("extension") == "text").select("full_path", "size")
    return text_files.mapInPandas(
        _preview_batches(limit_bytes, chars, C.TEXT_TOO_LARGE, C.TRUNCATION_NOTICE, default_encoding),
        "full_path string, preview string")


def _access_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = []
        for path in pdf["full_path"]:
            try:
                with open(path, "rb"):
                    ok.append(True)
            except OSError:
                ok.append(False)
        yield pd.DataFrame({"full_path": pdf["full_path"], "can_open": ok})


def open_check(files: DataFrame) -> DataFrame:
    """A10 ``IsFileAccessible``: can each file be opened for reading (checked by the executors)."""
    return files.select("full_path").mapInPandas(_access_batches, "full_path string, can_open boolean")
