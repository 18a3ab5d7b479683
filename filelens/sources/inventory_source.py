"""A folder tree as a DataFrame.

    entries, rejects = scan(spark, "/mnt/share")

One row per file and per directory (root included). ``scan`` lists the tree in rounds over a shared frontier: a round's work units are folders, or
hash shards of one very large folder; a task lists units, goes on into the folders it finds until it has listed its budget of
entries, and hands back what is left as units of the next round, dealt evenly to all tasks again. A deep chain is followed within a task, a huge
folder at any depth is shared by many, and no subtree belongs to a task beyond its budget. Each round is stored (Arrow batches to Parquet), so the one
listing serves entries and rejects, and a lost executor repeats a round's unit, not the scan. The driver keeps no path.

The same walk is a Python data source (``spark.read.format("file_inventory").load(root)``) for lazy reads: the driver cuts the tree into
subtrees by the folders of the first ``splitDepth`` levels, and filters on path prefix, ``is_dir``, ``is_hidden`` and ``is_system`` are pushed into the walk.

Symbolic links to directories are listed but never entered.
Entries that cannot be read are kept as rows with ``accessible = false`` and the
reason in ``attributes``; ``scan`` returns them as a separate reject frame
(path, reason) instead of dropping them silently. A name that is not text (no valid UTF-8) is such an entry.

The tree must be visible at the same path on every executor (a shared mount).
"""

from __future__ import annotations

import functools
import itertools
import os
import stat
import zlib
from collections import deque
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, Not, StringStartsWith

from ..operators.common import materialize
from ..operators.hierarchy import ancestors
from ..schema import ENTRY_SCHEMA
from ..streaming.progress import Progress


def _ts(seconds: float | None):
    if seconds is None:
        return None
    return datetime.fromtimestamp(seconds, tz=timezone.utc).replace(tzinfo=None)


def _extension(name: str) -> str:
    dot = name.rfind(".")
    if dot < 0 or dot == len(name) - 1:
        return ""
    return name[dot:].lower()


def _is_system(name: str, st: os.stat_result) -> bool:
    return bool(getattr(st, "st_file_attributes", 0) & stat.FILE_ATTRIBUTE_SYSTEM)  # where the file system has it


def _record(path: str, st: os.stat_result | None, is_dir: bool, is_link: bool, error: str | None):
    name = os.path.basename(path.rstrip("/")) or path
    directory = os.path.dirname(path.rstrip("/"))
    if st is None:
        return (path, name, "" if is_dir else _extension(name), directory, is_dir, None, None, None, None,
                False, name.startswith("."), False, is_link, error or "unreadable", False)
    read_only = not (st.st_mode & stat.S_IWUSR)
    hidden = name.startswith(".")
    system = _is_system(name, st)
    created = getattr(st, "st_birthtime", None) or st.st_ctime
    flags = [f for f, on in (("ReadOnly", read_only), ("Hidden", hidden), ("System", system),
                             ("Directory", is_dir), ("ReparsePoint", is_link)) if on]
    attrs = ", ".join(flags or ["Normal"]) if is_dir else ", ".join(flags + ["Archive"])
    return (path, name, "" if is_dir else _extension(name), directory, is_dir,
            None if is_dir else int(st.st_size), _ts(st.st_mtime), _ts(created), _ts(st.st_atime),
            read_only, hidden, system, is_link, attrs, error is None)


def _error(e: OSError) -> str:
    return f"{type(e).__name__}: {e.strerror or e}"


def _entry(ent: os.DirEntry) -> tuple[tuple, bool]:
    """(inventory tuple, descend?) for one directory entry; links to directories are not entered."""
    try:
        ent.path.encode()
    except UnicodeEncodeError:
        return _record(ent.path.encode("utf-8", "replace").decode(), None, False, False, "the name is not text"), False
    try:
        is_link = ent.is_symlink()
        st = ent.stat(follow_symlinks=False)
        is_dir = stat.S_ISDIR(st.st_mode)
        if is_link:
            try:  # a linked file is kept with its target's size when the target is reachable
                st = ent.stat(follow_symlinks=True)
                is_dir = stat.S_ISDIR(st.st_mode)
            except OSError:
                pass
        return _record(ent.path, st, is_dir, is_link, None), is_dir and not is_link
    except OSError as e:
        return _record(ent.path, None, False, False, _error(e)), False


def _entries(d: str):
    """(entry, None) of one directory, one at a time; (None, reject row) when it can't be listed."""
    try:
        with os.scandir(d) as it:
            for ent in it:
                yield ent, None
    except OSError as e:
        yield None, _record(d, None, True, False, _error(e))


def _is_folder(ent: os.DirEntry) -> bool:
    """A directory to enter (links are not)."""
    try:
        return ent.is_dir(follow_symlinks=False) and not ent.is_symlink()
    except OSError:
        return False


class Walk:
    """Lists units (folder, shard, of): the rows of a folder's entries, of one hash shard of them (of > 1), or first the folder's own
    row (shard -1). Options leave rows out before they are examined, without changing the others:

    ``prefix``: only paths that begin with it (other folders are not entered); ``only_dirs``: files are not examined; ``no_hidden``,
    ``no_system``: such rows are left out, but their folders are entered; ``skip_system``: system folders are not entered either (A4).
    """

    def __init__(self, prefix: str | None = None, only_dirs: bool = False, no_hidden: bool = False, no_system: bool = False,
                 skip_system: bool = False, flat_split: int | None = None):
        self.prefix, self.only_dirs, self.no_hidden = prefix, only_dirs, no_hidden
        self.no_system, self.skip_system, self.flat_split = no_system or skip_system, skip_system, flat_split
        self.visited = 0  # folders listed

    def push(self, f) -> bool:
        """Takes a filter on rows over, if the walk can."""
        if isinstance(f, StringStartsWith) and f.attribute == ("full_path",):
            if self.prefix is not None and not f.value.startswith(self.prefix) and not self.prefix.startswith(f.value):
                return False
            self.prefix = max(self.prefix or "", f.value, key=len)
            return True
        if isinstance(f, Not) and isinstance(f.child, EqualTo) and isinstance(f.child.value, bool):
            f = EqualTo(f.child.attribute, not f.child.value)
        if not isinstance(f, EqualTo) or not isinstance(f.value, bool):
            return False
        name = {("is_dir", True): "only_dirs", ("is_hidden", False): "no_hidden", ("is_system", False): "no_system"}.get((*f.attribute, f.value))
        if name:
            setattr(self, name, True)
        return name is not None

    def _wanted(self, rec: tuple) -> bool:
        return ((self.prefix is None or rec[0].startswith(self.prefix)) and not (self.only_dirs and not rec[4])
                and not (self.no_hidden and rec[10]) and not (self.no_system and rec[11]))

    def _enters(self, path: str) -> bool:
        return self.prefix is None or path.startswith(self.prefix) or self.prefix.startswith(path.rstrip("/") + "/")

    def _list(self, unit: tuple[str, int, int]):
        """(row, folder to enter, unit to hand back), one of them not None, for each entry of a unit."""
        d, shard, of = unit
        if shard < 0:
            row = _root_row(d)
            if self._wanted(row):
                yield row, None, None
        self.visited += 1
        found = _entries(d)
        if self.flat_split and of == 1:
            head = list(itertools.islice(found, self.flat_split + 1))
            if len(head) > self.flat_split:  # names are counted, nothing is examined here
                n = len(head) + sum(1 for _ in found)
                k = -(-n // self.flat_split)
                yield from ((None, None, (d, i, k)) for i in range(k))
                return
            found = iter(head)
        for ent, err in found:
            if err is not None:
                if shard <= 0 and self._wanted(err):
                    yield err, None, None
                continue
            if of > 1 and zlib.crc32(ent.name.encode("utf-8", "surrogateescape")) % of != shard:
                continue
            if self.only_dirs and not _maybe_folder(ent):
                continue
            rec, descend = _entry(ent)
            if self._wanted(rec):
                yield rec, None, None
            if descend and self._enters(rec[0]) and not (self.skip_system and rec[11]):
                yield None, ent.path, None

    def rows(self, units, budget: int | None = None):
        """(row, None) of every entry, or (None, unit) of what is left when ``budget`` entries have been listed."""
        listed = 0
        for unit in units:
            todo = deque([unit])
            while todo:
                if budget is not None and listed >= budget:
                    yield from ((None, x) for x in todo)
                    break
                for row, folder, back in self._list(todo.popleft()):
                    if row is not None:
                        listed += 1
                        yield row, None
                    elif folder is not None:
                        todo.append((folder, 0, 1))
                    else:
                        yield None, back


def _maybe_folder(ent: os.DirEntry) -> bool:
    """A folder or a link (whose target may be one), from the listing alone."""
    try:
        return ent.is_dir(follow_symlinks=False) or ent.is_symlink()
    except OSError:
        return True


def _walk(top: str, recursive: bool = True, shard: tuple[int, int] | None = None):
    """Entries below ``top`` (the row of ``top`` itself is listed by its parent).

    ``shard = (i, k)``: only the entries of ``top`` whose name hashes to i of k (a flat
    listing of one very large folder shared by k tasks; each lists, only 1/k are stat'ed).
    """
    return _subtree(Walk(), top, recursive, shard)


def _subtree(walk: Walk, top: str, recursive: bool, shard: tuple[int, int] | None):
    unit = (top, *(shard or (0, 1)))
    if recursive:
        yield from (row for row, _ in walk.rows([unit]))
    else:
        yield from (row for row, _, _ in walk._list(unit) if row is not None)


BATCH_ROWS = 5000  # rows handed on at a time
_ARROW = {T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(),
          T.TimestampNTZType(): pa.timestamp("us")}


def _record_batches(rows, schema: T.StructType):
    types = [_ARROW[f.dataType] for f in schema.fields]
    while part := list(itertools.islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=schema.names)


def _subdirectories(d: str) -> tuple[list[str], int]:
    """Sub-directory paths of one directory (links are not entered) and its number of entries; file entries
    are counted, not kept."""
    out, n = [], 0
    for ent, err in _entries(d):
        if err is None:
            n += 1
            if _is_folder(ent):
                out.append(ent.path)
    return out, n


class _Listing(InputPartition):
    """Directories to list on an executor: only their own entries (``recursive=False``, optionally
    one hash shard of them) or their whole subtrees."""

    def __init__(self, dirs: list[str], recursive: bool, include_root: str | None = None,
                 shard: tuple[int, int] | None = None):
        super().__init__((tuple(dirs), recursive, include_root, shard))
        self.dirs = dirs
        self.recursive = recursive
        self.include_root = include_root
        self.shard = shard


def _root_row(root: str) -> tuple:
    try:
        return _record(root, os.stat(root, follow_symlinks=False), True, os.path.islink(root), None)
    except OSError as e:
        return _record(root, None, True, False, _error(e))


class FileInventoryReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.root = os.path.abspath(options.get("path") or options.get("root") or ".")
        self.split_depth = int(options.get("splitDepth", "2"))
        self.target = int(options.get("targetPartitions", "64"))
        self.flat_split = int(options.get("flatSplitEntries", "50000"))
        self.walk = Walk(skip_system=str(options.get("skipSystem", "false")).lower() == "true")

    def pushFilters(self, filters):
        """The walk takes over what it can; the rest stays with Spark."""
        for f in filters:
            if not self.walk.push(f):
                yield f

    def partitions(self):
        # Breadth-first over directory *names* of the first levels only: the driver keeps no
        # file records. Directories above the split depth are listed flat by executors (a very
        # large one in hash shards over several tasks), the ones at the split depth are walked
        # whole by executors.
        shallow: list[tuple[str, int]] = []
        frontier = [self.root]
        for _ in range(self.split_depth):
            if len(frontier) >= self.target:
                break
            nxt = []
            for d in frontier:
                subs, n_entries = _subdirectories(d)
                nxt.extend(subs)
                shallow.append((d, n_entries))
            frontier = nxt
            if not frontier:
                break
        parts: list[InputPartition] = [_Listing([], False, self.root)]
        small = sorted(d for d, n in shallow if n <= self.flat_split)
        chunks = max(1, min(self.target, len(small)))
        for i in range(chunks):
            group = small[i::chunks]
            if group:
                parts.append(_Listing(group, False))
        for d, n in shallow:
            if n > self.flat_split:
                k = min(self.target, -(-n // self.flat_split))
                parts.extend(_Listing([d], False, None, (i, k)) for i in range(k))
        n = max(1, min(self.target, len(frontier)))
        for i in range(n):
            group = sorted(frontier)[i::n]
            if group:
                parts.append(_Listing(group, True))
        return parts

    def read(self, partition):
        yield from _record_batches(self._rows(partition), ENTRY_SCHEMA)

    def _rows(self, partition):
        walk = self.walk
        if partition.include_root is not None:
            root = partition.include_root
            row = _root_row(root)
            if walk._wanted(row):
                yield row
        for d in partition.dirs:
            if walk._enters(d):
                yield from _subtree(walk, d, partition.recursive, partition.shard)


class FileInventorySource(DataSource):
    """``spark.read.format("file_inventory").load(root)``."""

    @classmethod
    def name(cls):
        return "file_inventory"

    def schema(self):
        return ENTRY_SCHEMA

    def reader(self, schema):
        return FileInventoryReader(self.options, schema)


def _default_target(spark: SparkSession) -> int:
    try:
        return max(2, spark.sparkContext.defaultParallelism * 4)
    except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect)
        return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def register(spark: SparkSession) -> None:
    """Makes ``file_inventory`` known; its filters are pushed into the walk."""
    spark.dataSource.register(FileInventorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


_UNIT = "directory string, shard int, of int"
_ROUND = T.StructType([*(T.StructField(f.name, f.dataType) for f in ENTRY_SCHEMA.fields),
                       T.StructField("unit", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("of", T.IntegerType())])
FIRST_BUDGET, BUDGET = 500, 50_000  # entries a task lists in the first round (one task) and in later ones


def _round(options: dict, budget: int, progress: Progress | None):
    def run(batches):
        walk = Walk(**options)
        units = ((d, i, k) for b in batches for d, i, k in zip(*(c.to_pylist() for c in b.columns)))
        empty_row, no_unit = (None,) * len(ENTRY_SCHEMA), (None,) * 3
        rows = (row + no_unit if row is not None else empty_row + unit for row, unit in walk.rows(units, budget))
        for batch in _record_batches(rows, _ROUND):
            if progress is not None:
                progress.add_entries(batch)
            yield batch
    return run


def scan(spark: SparkSession, root: str, split_depth: int | None = None, target_partitions: int | None = None,
         flat_split_entries: int = 50000, budget: int = BUDGET, first_budget: int = FIRST_BUDGET, progress: Progress | None = None,
         **options) -> tuple[DataFrame, DataFrame]:
    """A1: (entries, rejects). ``entries`` holds readable files and directories, root included.

    A round has at most ``target_partitions`` tasks (default: four per core); a folder with more than ``flat_split_entries`` entries is shared by
    several. ``options``: those of ``Walk`` (``prefix``, ``only_dirs``, ``no_hidden``, ``no_system``, ``skip_system``). ``progress`` counts while the rounds
    run. ``split_depth`` has no meaning for rounds and is ignored; it is an option of the data source.
    """
    target = target_partitions or _default_target(spark)
    options["flat_split"] = flat_split_entries
    units = spark.createDataFrame([(os.path.abspath(root), -1, 1)], _UNIT).coalesce(1)
    rounds, share = [], first_budget
    while True:
        listed = materialize(units.mapInArrow(_round(options, share, progress), _ROUND))
        rounds.append(listed)
        left = listed.where(F.col("unit").isNotNull()).select(F.col("unit").alias("directory"), "shard", "of")
        n = left.count()
        if not n:
            break
        units, share = left.repartition(min(target, n)), budget
    raw = functools.reduce(DataFrame.unionAll, rounds).where(F.col("unit").isNull()).select(*ENTRY_SCHEMA.names)
    entries = raw.where(F.col("accessible"))
    rejects = raw.where(~F.col("accessible")).select(F.col("full_path").alias("path"),
                                                     F.col("attributes").alias("reason"))
    return entries, rejects


scan_balanced = scan


def files_of(entries: DataFrame) -> DataFrame:
    """The inventory: file rows only."""
    return entries.where(~F.col("is_dir"))


def visible_only(entries: DataFrame) -> DataFrame:
    """A3: without hidden or system files (directories are not tested)."""
    return entries.where(F.col("is_dir") | ~(F.col("is_hidden") | F.col("is_system")))


def without_system(entries: DataFrame) -> DataFrame:
    """A4: without system entries and all that lies below a system folder."""
    system = entries.where(F.col("is_dir") & F.col("is_system")).select(F.col("full_path").alias("above"))
    below = (entries.select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("above"))
             .join(system, "above", "left_semi").select("directory").distinct())
    return entries.where(~F.col("is_system")).join(below, "directory", "left_anti").select(*entries.columns)


def directories(entries: DataFrame, include_root: bool = True, root: str | None = None, include_system: bool = True) -> DataFrame:
    """Directory rows (root and system folders optional)."""
    d = (entries if include_system else without_system(entries)).where(F.col("is_dir"))
    if not include_root and root is not None:
        d = d.where(F.col("full_path") != os.path.abspath(root))
    return d


def valid_paths(paths: DataFrame, entries: DataFrame, col: str = "path") -> DataFrame:
    """A10: which of the given paths exist as a file or directory (left join on the listing)."""
    known = entries.select(F.col("full_path").alias(col)).distinct().withColumn("is_valid", F.lit(True))
    return paths.join(known, col, "left").withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))
