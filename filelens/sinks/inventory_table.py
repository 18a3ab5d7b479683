"""Writing an inventory once and querying it many times.

A listing (A1) or a derived inventory is written as Parquet, range-partitioned by
``full_path``: files of one folder sit together, each output file covers a path
range (min/max statistics let ``startswith`` filters on paths skip row groups),
and the derived columns (name, extension, directory) are stored, not recomputed
per query. ``content`` is never stored: digests are computed from the files or
the source table on demand.

A versioned inventory (``write_versioned``) can follow a plan: its rows lie in path ranges, one folder each, and a manifest names each range's
folder and first path. An update rewrites the ranges that hold a changed path, old or new, and publishes a new manifest; the other ranges' files are
shared by both versions. A reader keeps the version whose manifest it has read until ``drop_versions`` removes it.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.common import delete_path, materialize, path_exists, publish_text, read_text

INVENTORY_COLUMNS = ["full_path", "name", "extension", "directory", "is_dir", "size", "modified", "created",
                     "accessed", "is_read_only", "is_hidden", "is_system", "is_link", "attributes", "accessible"]


def write_inventory(df: DataFrame, path: str, partitions: int | None = None, keep: list[str] | None = None,
                    mode: str = "overwrite", derive: bool = False) -> str:
    """Stores ``df``. With ``derive``, name, directory and extension come from the path after the exchange: neither the sampling of the
    ranges nor the exchange carries them (a folder's extension is '')."""
    spark = df.sparkSession
    n = partitions or max(1, spark.sparkContext.defaultParallelism)
    cols = [c for c in (keep or INVENTORY_COLUMNS) if c in df.columns]
    made = {"name", "directory", "extension"} if derive else set()
    rows = df.select(*[c for c in cols if c not in made]).repartitionByRange(n, "full_path").sortWithinPartitions("full_path")
    if derive:
        extension = C.extension_of(C.file_name("full_path"))
        rows = rows.withColumns({"name": C.file_name("full_path"), "directory": C.parent_directory("full_path"),
                                 "extension": F.when(F.col("is_dir"), F.lit("")).otherwise(extension) if "is_dir" in cols else extension})
    rows.select(*cols).write.mode(mode).parquet(path)
    return path


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


MANIFEST = "_inventory.json"
RANGE_ROWS = 1_000_000  # rows of a range (about)


def write_versioned(df: DataFrame, path: str, ranges: int | None = None, keep: list[str] | None = None) -> str:
    """Stores ``df`` as version 1 of an inventory in ranges of about ``RANGE_ROWS`` rows."""
    spark = df.sparkSession
    if path_exists(spark, f"{path}/{MANIFEST}"):
        raise FileExistsError(f"an inventory stands in {path} already")
    cols = [c for c in (keep or INVENTORY_COLUMNS) if c in df.columns]
    rows = materialize(df.select(*cols))
    n = ranges or max(1, -(-rows.count() // RANGE_ROWS))
    ranged = rows.repartitionByRange(n, "full_path").withColumn("path_range", F.spark_partition_id())
    folder = _write_ranges(ranged, path)
    first = spark.read.parquet(folder).groupBy("path_range").agg(F.min("full_path").alias("first")).orderBy("path_range").collect()  # a row per range
    _publish(spark, path, {"version": 1, "columns": cols, "ranges": [{"id": r["path_range"], "first": r["first"], "folder": folder} for r in first],
                           "schema": rows.schema.jsonValue()})
    return path


def _write_ranges(rows: DataFrame, path: str) -> str:
    folder = f"{path.rstrip('/')}/data-{uuid.uuid4().hex[:12]}"
    rows.sortWithinPartitions("path_range", "full_path").write.partitionBy("path_range").parquet(folder)
    return folder


def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
    text = json.dumps(manifest)
    publish_text(spark, f"{path}/_version-{manifest['version']:06d}.json", text)
    publish_text(spark, f"{path}/{MANIFEST}", text)


def manifest_of(spark: SparkSession, path: str, version: int | None = None) -> dict:
    return json.loads(read_text(spark, f"{path}/{MANIFEST if version is None else f'_version-{version:06d}.json'}"))


def _read_ranges(spark: SparkSession, manifest: dict, ids: set[int] | None = None) -> DataFrame:
    """The rows of some ranges (all, if None) with their range."""
    folders: dict[str, list[int]] = {}
    for r in manifest["ranges"]:
        if r["folder"] and (ids is None or r["id"] in ids):
            folders.setdefault(r["folder"], []).append(r["id"])
    schema = T.StructType.fromJson(manifest["schema"]).add("path_range", T.IntegerType())
    out = spark.createDataFrame([], schema)
    for folder, held in folders.items():  # partition pruning by range: only these folders are listed and read
        out = out.unionByName(spark.read.schema(schema).parquet(folder).where(F.col("path_range").isin(held)))
    return out


def read_versioned(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The inventory of a version (the latest, if None)."""
    return _read_ranges(spark, manifest_of(spark, path, version)).drop("path_range")


def _with_range(df: DataFrame, firsts: list[str], ids: list[int], column: str) -> DataFrame:
    """Adds ``to_range``: the range of the path in ``column``. ``firsts`` has a path per range."""
    def run(batches):
        for batch in batches:
            paths = batch.column(batch.schema.get_field_index(column)).to_pylist()
            # as UTF-8, the order that Spark's ranges have
            got = [None if p is None else ids[max(0, bisect_right(keys, p.encode()) - 1)] for p in paths]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int32())], names=[*batch.schema.names, "to_range"])

    keys = [f.encode() for f in firsts]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("to_range", T.IntegerType())]))


def apply_plan(spark: SparkSession, path: str, plan: DataFrame) -> int:
    """A plan's effect on the stored inventory, as a new version: moved rows get their new path (name, folder and extension follow), staged rows leave,
    copies add a row; failed rows change nothing. Only ranges that hold an old or a new path are rewritten. Returns the version."""
    old = manifest_of(spark, path)
    ranges = old["ranges"]
    firsts, ids = [r["first"] for r in ranges], [r["id"] for r in ranges]
    changes = plan.where(F.col("action").isin("move", "stage", "copy")).select("source", "target", "action")
    changes = _with_range(changes, firsts, ids, "source").withColumnRenamed("to_range", "from_range")
    changes = materialize(_with_range(changes, firsts, ids, "target"))
    # distinct ranges: at most as many as the inventory has
    spots = changes.select(F.explode(F.array("from_range", F.when(F.col("action") != "stage", F.col("to_range")))).alias("id"))
    touched = {r["id"] for r in spots.where(F.col("id").isNotNull()).distinct().collect()}
    if not touched:
        return old["version"]
    rows = _read_ranges(spark, old, touched)
    act = changes.select(F.col("source").alias("full_path"), F.col("target").alias("_target"), F.col("action").alias("_action"), "to_range")
    met = rows.join(act, "full_path", "left")
    stay = met.where(F.col("_action").isNull() | (F.col("_action") == "copy")).select(*rows.columns)
    new = met.where(F.col("_action").isin("move", "copy")).withColumns({"full_path": F.col("_target"), "path_range": F.col("to_range")}).select(*rows.columns)
    derived = {"name": C.file_name("full_path"), "directory": C.parent_directory("full_path")}
    new = new.withColumns({c: x for c, x in derived.items() if c in rows.columns})
    if "extension" in rows.columns:
        new = new.withColumn("extension", C.extension_of("name") if "name" in rows.columns else C.extension_of(C.file_name("full_path")))
    folder = _write_ranges(stay.unionByName(new).repartition(len(touched), "path_range"), path)
    written = {r["path_range"] for r in spark.read.parquet(folder).select("path_range").distinct().collect()}
    for r in ranges:
        if r["id"] in touched:
            r["folder"] = folder if r["id"] in written else None  # nothing is left in it
    old["version"] += 1
    _publish(spark, path, old)
    return old["version"]


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes the data folders that none of the ``keep`` latest versions reads; returns how many."""
    last = manifest_of(spark, path)["version"]
    versions = [v for v in range(1, last + 1) if path_exists(spark, f"{path}/_version-{v:06d}.json")]
    held = {v: {r["folder"] for r in manifest_of(spark, path, v)["ranges"]} for v in versions}
    kept = set().union(*(held[v] for v in versions if v > last - keep))
    gone = set().union(*held.values()) - kept - {None}
    for v in versions:
        if v <= last - keep:
            delete_path(spark, f"{path}/_version-{v:06d}.json")
    for folder in gone:
        delete_path(spark, folder)
    return len(gone)
