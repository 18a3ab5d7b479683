"""Move, copy and staging plans (survey §2 K1–K3, K8, J4, I3).

The reference moves files one after another and, on a name clash at the target,
tries ``stem_1.ext``, ``stem_2.ext``, … until a name is free (names compare
without case). Here a plan is a table ``(source, target, action, size)``.

Exact and distributed form of that loop:

* The candidates of a name ``s.e`` are ``s.e, s_1.e, s_2.e, …``. Files of one name take that name's free candidate
  indexes in path order, so the file at position r gets the r-th index that is not *blocked*. Blocked indexes are rows
  (folder, name, index); with j of them below it the index b - j is the position from which files go past b, so the
  r-th free index is r plus the number of blocked rows with b - j <= r: a running count in the merged order of both.
* Blocked are existing target names, and slots that a related name took first: ``x_1.txt`` is both the first
  candidate of the files named ``x_1.txt`` (the child) and the second of those named ``x.txt`` (the parent). Whoever arrives
  first by path owns it. Slots are settled level by level down the name tree. Of a parent's children by
  counter, let L be how many slots of smaller counter went to the parent. The parent's file that reaches counter k has the position
  k - (blocked below k) - (children before that kept their slot), and it comes before the child's first file when that position is below the
  number m of the parent's files with a smaller path. So the slot goes to the parent when L < m - (k - existing below k - children before);
  all terms on the right are running counts.
* L is sequential along a parent's children, but a run of children maps L to L + (how many of them lose), and each child loses
  exactly when L at the run's beginning is below a limit of its own. The limits are found in one pass over range partitions; the few
  runs of a parent that lies in several partitions are then chained by bounds from above and below that close in on the exact value.

Positions, running counts and limits come from range partitions with offsets, so a name held by a third of all files, a parent
with a million children and a folder with a million taken names are all spread over many tasks.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.common import materialize
from ..operators.hierarchy import relative_directory
from ..operators.ranking import continued_pieces, counted_before, rank_within, ranked_pieces, sorted_pieces, stored_pieces
from ..schema import STAGING_FOLDER

# A counter suffix as the reference writes it: "_" + a positive integer without leading zeros.
_COUNTER = r"^(.*)_([1-9][0-9]{0,17})$"


def _keyed(df: DataFrame) -> DataFrame:
    """Name parts and lower-case keys of a (target_dir, name) frame.

    ``parent_l``/``counter``: for a name ``s_k.e`` the name ``s.e`` it is a candidate of, and k.
    """
    stem_l = F.lower(F.col("stem"))
    return (df.withColumn("ext", C.raw_extension("name"))
              .withColumn("stem", F.left(F.col("name"), F.length("name") - F.length("ext")))
              .withColumn("tdir_l", F.lower(F.col("target_dir")))
              .withColumn("name_l", F.lower(F.col("name")))
              .withColumn("counter", F.regexp_extract(stem_l, _COUNTER, 2))
              .withColumn("parent_l", F.when(F.col("counter") != "",
                                             F.concat(F.regexp_extract(stem_l, _COUNTER, 1), F.lower(F.col("ext")))))
              .withColumn("counter", F.when(F.col("counter") != "", F.col("counter").cast("long"))))


def _target(tdir, stem, ext, idx):
    name = F.when(idx == 0, F.concat(stem, ext)).otherwise(F.concat(stem, F.lit("_"), idx.cast("string"), ext))
    return F.concat(tdir, F.lit("/"), name)


_SLOTS = ["tdir_l", "parent_l"]
_NAME = ["tdir_l", "name_l"]
FEW = 64


def _limits(batches):
    """Adds to every child of a sorted partition the ``limit``: it loses its slot when L at the beginning of its run is below it."""
    run, held = None, []  # limits of the run's earlier children, ascending
    for batch in batches:
        out = []
        for tdir, parent, z in zip(*(batch.column(c).to_pylist() for c in (*_SLOTS, "z"))):
            if (tdir, parent) != run:
                run, held = (tdir, parent), []
            low, high = 0, max(z, 0)
            while low < high:  # smallest start from which L has reached z at this child
                mid = (low + high) // 2
                if mid + len(held) - bisect_right(held, mid) >= z:
                    high = mid
                else:
                    low = mid + 1
            if low:
                insort(held, low)
            out.append(low)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "limit"])


def _exclusive_sums(order: list[tuple], losers: dict[tuple, int]) -> dict[tuple, int]:
    """Losers of the same parent in earlier runs, for every run (in order)."""
    out, total, parent = {}, 0, None
    for piece in order:
        total = 0 if piece[:2] != parent else total
        parent = piece[:2]
        out[piece] = total
        total += losers.get(piece, 0)
    return out


def _starts(pieces: DataFrame) -> dict[tuple, int]:
    """L at the beginning of every run of the parents that lie in several partitions (a number of rows below twice that of the
    partitions). Fewer children lose from a larger start, so upper bounds of all starts give lower ones and the other way round; with each
    turn at least one more run of a parent is exact."""
    spark = pieces.sparkSession
    runs = sorted(tuple(r)[:3] for r in continued_pieces(pieces, _SLOTS, F.lit(1)).collect())
    if len({r[:2] for r in runs}) == len(runs):
        return {}

    def losers(starts: dict[tuple, int]) -> dict[tuple, int]:
        rows = spark.createDataFrame([(*k, v) for k, v in starts.items()], "tdir_l string, parent_l string, _pid long, start long")
        got = pieces.join(F.broadcast(rows), [*_SLOTS, "_pid"]).groupBy(*_SLOTS, "_pid").agg(F.count_if(F.col("limit") > F.col("start")).alias("n"))
        return {tuple(r)[:3]: r["n"] for r in got.collect()}

    low = dict.fromkeys(runs, 0)
    while True:
        high = _exclusive_sums(runs, losers(low))
        if high == low:
            return low
        low = _exclusive_sums(runs, losers(high))
        if high == low:
            return low


def _settled(children: DataFrame, files: DataFrame, blocked: DataFrame, partitions: int | None) -> DataFrame:
    """Blocked rows (tdir_l, name_l, idx) that related names cause.

    ``children``: tdir_l, parent_l, name_l, counter, first_pos of the names whose parent name is in the batch as well.
    """
    spark = children.sparkSession
    out = spark.createDataFrame([], "tdir_l string, name_l string, idx long")
    pending = materialize(children)
    while not pending.isEmpty():  # a turn per counter in a name at most: bounded by the length of names
        # ready are the children whose parent is not itself waiting for its own first slot
        waiting = pending.select("tdir_l", F.col("name_l").alias("parent_l"), F.lit(True).alias("waits"))
        marked = materialize(pending.join(waiting, _SLOTS, "left"))
        kids, pending = marked.where(F.col("waits").isNull()).drop("waits"), marked.where("waits").drop("waits")
        parents = kids.select(*_SLOTS).distinct()

        def of_parents(df: DataFrame, *columns) -> DataFrame:
            return df.select("tdir_l", F.col("name_l").alias("parent_l"), *columns).join(parents, _SLOTS, "left_semi")

        taken = materialize(of_parents(blocked.unionByName(out), F.col("idx").alias("counter")))
        # a slot that exists already goes to neither side
        kids = kids.join(taken, [*_SLOTS, "counter"], "left_anti").withColumn("path", F.col("first_pos"))
        kids = rank_within(kids, _SLOTS, ["counter"], "before", partitions)
        kids = counted_before(taken, kids, _SLOTS, ["counter"], "existing", partitions=partitions)
        kids = counted_before(of_parents(files, F.col("full_path").alias("path")), kids, _SLOTS, ["path"], "earlier", partitions=partitions)
        kids = kids.withColumn("z", F.col("earlier") - (F.col("counter") - F.col("existing") - F.col("before")))
        kids = sorted_pieces(kids.select(*_SLOTS, "name_l", "counter", "z"), _SLOTS, ["counter"], partitions)
        schema = "tdir_l string, parent_l string, name_l string, counter long, z long, limit long"
        pieces = stored_pieces(kids.mapInArrow(_limits, schema))
        starts = spark.createDataFrame([(*k, v) for k, v in _starts(pieces).items()], "tdir_l string, parent_l string, _pid long, start long")
        lost = F.col("limit") > F.coalesce("start", F.lit(0))
        settled = pieces.join(F.broadcast(starts), [*_SLOTS, "_pid"], "left").select(
            "tdir_l", F.when(lost, F.col("name_l")).otherwise(F.col("parent_l")).alias("name_l"),
            F.when(lost, F.lit(0)).otherwise(F.col("counter")).cast("long").alias("idx"))
        out = out.unionByName(settled)
    return out


def _blocked(existing: DataFrame | None, like: DataFrame) -> DataFrame:
    """(tdir_l, name_l, idx): an existing name blocks its own first index, and its counter of the name it is a candidate of."""
    if existing is None:
        return like.sparkSession.createDataFrame([], "tdir_l string, name_l string, idx long")
    ex = _keyed(existing.select(C.parent_directory("full_path").alias("target_dir"), C.file_name("full_path").alias("name")))
    slots = F.array(F.struct(F.col("name_l").alias("name_l"), F.lit(0).cast("long").alias("idx")),
                    F.struct(F.col("parent_l").alias("name_l"), F.col("counter").alias("idx")))
    return ex.select("tdir_l", F.explode(slots).alias("slot")).select("tdir_l", "slot.*").where(F.col("name_l").isNotNull()).distinct()


def _passed(ranked: DataFrame, blocked: DataFrame, partitions: int | None) -> DataFrame:
    """Adds ``passed``: how many blocked indexes the file at position rank0 of its name goes past."""
    # position from which files go past a blocked index: the index less the blocked ones below it
    past = rank_within(blocked, _NAME, ["idx"], "below", partitions).select(*_NAME, (F.col("idx") - F.col("below")).alias("rank0"))
    return counted_before(past, ranked, _NAME, ["rank0"], "passed", ties=True, partitions=partitions)


def assign_targets(files: DataFrame, existing: DataFrame | None = None, action: str = "move",
                   partitions: int | None = None, few: int = FEW) -> DataFrame:
    """First-free target names for ``files`` (full_path, name, size, target_dir).

    ``existing`` (full_path) lists files already present in the target folders.
    Returns (source, target, action, size). ``partitions``: of the sorted steps (default: the session's). The
    blocked indexes of a name with at most ``few`` of them go with its files, those of the others meet their files in order.
    """
    # stored first: choosing the ranges reads the rows once more than writing them
    keyed = materialize(_keyed(files.select("full_path", "name", "size", "target_dir")))
    pieces = stored_pieces(sorted_pieces(keyed, _NAME, ["full_path"], partitions))
    ranked = ranked_pieces(pieces, _NAME)
    blocked = _blocked(existing, files)

    # names whose parent name is in the batch: few or none, as only names with a counter can be
    children = (keyed.where(F.col("parent_l").isNotNull())
                .groupBy("tdir_l", "parent_l", "name_l", "counter").agg(F.min("full_path").alias("first_pos"))
                .join(keyed.select("tdir_l", F.col("name_l").alias("parent_l")), _SLOTS, "left_semi"))
    if not children.isEmpty():
        blocked = materialize(blocked)
        blocked = blocked.unionByName(_settled(children, pieces, blocked, partitions)).distinct()

    first = F.row_number().over(Window.partitionBy(*_NAME).orderBy("idx"))
    taken = materialize(blocked.withColumn("_n", first).where(F.col("_n") <= few + 1)  # cut before anything is shuffled
                        .groupBy(*_NAME).agg(F.array_sort(F.collect_list("idx")).alias("taken")))
    past = F.aggregate(F.coalesce("taken", F.array().cast("array<bigint>")), F.col("rank0"),
                       lambda idx, b: F.when(b <= idx, idx + 1).otherwise(idx))
    out = ranked.join(taken.where(F.size("taken") <= few), _NAME, "left").withColumn("passed", past - F.col("rank0"))
    many = taken.where(F.size("taken") > few).select(*_NAME)
    if not many.isEmpty():
        full = materialize(blocked.join(many, _NAME, "left_semi"))
        out = out.drop("taken").join(many, _NAME, "left_anti").unionByName(
            _passed(ranked.join(many, _NAME, "left_semi"), full, partitions))
    return out.select(F.col("full_path").alias("source"),
                      _target(F.col("target_dir"), F.col("stem"), F.col("ext"), F.col("rank0") + F.col("passed")).alias("target"),
                      F.lit(action).alias("action"), "size")


def files_below(inv: DataFrame, folder: str) -> DataFrame:
    """Paths of the inventory's files in or below ``folder``: what a plan into it must not overwrite."""
    return inv.where(F.col("full_path").startswith(folder.rstrip("/") + "/")).select("full_path")


def move_plan(files: DataFrame, destination: str, existing: DataFrame) -> DataFrame:
    """K1: every file goes to ``destination``/name (first free name); ``existing`` lists what stands there already."""
    dest = destination.rstrip("/")
    return assign_targets(files.withColumn("target_dir", F.lit(dest)), existing, "move")


def copy_plan(files: DataFrame, destination: str, existing: DataFrame) -> DataFrame:
    """K2: as the move plan; the inventory is unchanged."""
    dest = destination.rstrip("/")
    return assign_targets(files.withColumn("target_dir", F.lit(dest)), existing, "copy")


def staging_target_dir(root: str):
    """K3 target folder: <root>/<STAGING_FOLDER>/<directory relative to root>."""
    root = root.rstrip("/")
    rel = relative_directory(F.col("directory"), root)
    base = F.lit(f"{root}/{STAGING_FOLDER}")
    return F.when(rel == "", base).otherwise(F.concat(base, F.lit("/"), rel))


def staging_plan(files: DataFrame, root: str, existing: DataFrame | None = None) -> DataFrame:
    """K3: files (full_path, name, directory, size) into the staging tree below ``root``."""
    return assign_targets(files.withColumn("target_dir", staging_target_dir(root)), existing, "stage")


def plan_for_selection(inv: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected paths with their inventory record; paths not in the inventory are kept as failed."""
    sel = selection.select("full_path").distinct()
    return sel.join(inv.select("full_path", "name", "directory", "size"), "full_path", "left") \
              .withColumn("found", F.col("size").isNotNull())


def failed_rows(sel_with_found: DataFrame, action: str) -> DataFrame:
    """Manifest rows for sources that are missing (the reference skips them silently)."""
    return sel_with_found.where(~F.col("found")).select(
        F.col("full_path").alias("source"), F.lit(None).cast("string").alias("target"),
        F.lit("failed").alias("action"), F.lit(None).cast("long").alias("size"))


def plan_summary(manifest: DataFrame) -> DataFrame:
    """K8: planned and failed counts, bytes moved."""
    ok = F.col("action") != "failed"
    return manifest.agg(
        F.count_if(ok).alias("planned_files"),
        F.count_if(~ok).alias("failed_files"),
        F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).cast("long").alias("planned_bytes"),
    ).withColumn("planned_bytes_text", C.format_bytes("planned_bytes"))


def plan_selection(inv: DataFrame, selection: DataFrame, action: str, destination: str | None = None,
                   root: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """K1–K3 from a selection table: found paths get targets, missing ones a 'failed' row (K8).

    ``action``: 'move' / 'copy' (into ``destination``) or 'stage' (below ``root``). ``existing``: a listing of the target; by
    default the inventory's own files there.
    """
    if existing is None:
        existing = files_below(inv, f"{root.rstrip('/')}/{STAGING_FOLDER}" if action == "stage" else destination)
    rows = plan_for_selection(inv, selection)
    found = rows.where(F.col("found")).drop("found")
    if action == "stage":
        planned = staging_plan(found, root, existing)
    elif action in ("move", "copy"):
        planned = (move_plan if action == "move" else copy_plan)(found, destination, existing)
    else:
        raise ValueError("action must be 'move', 'copy' or 'stage'")
    return planned.unionByName(failed_rows(rows, action))


def inventory_after_moves(inv: DataFrame, manifest: DataFrame) -> DataFrame:
    """K1: the inventory with moved rows at their new path (name and folder follow); copies,
    failed rows and staged rows are handled by the caller (copies leave the inventory as is,
    staged rows leave it: ``filters.remove_paths``)."""
    moves = (manifest.where(F.col("action") == "move")
             .select(F.col("source").alias("full_path"), F.col("target").alias("_target")))
    out = inv.join(moves, "full_path", "left")
    new_path = F.coalesce(F.col("_target"), F.col("full_path"))
    return (out.withColumn("full_path", new_path)
               .withColumn("name", C.file_name("full_path"))
               .withColumn("directory", C.parent_directory("full_path"))
               .drop("_target"))
