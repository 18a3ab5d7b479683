"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a global aggregate (exactly one row) to every row of ``df``.

    The one-row frame becomes a scalar subquery (computed once, no join), so nothing
    data-sized is paired or broadcast.
    """
    packed = one_row.select(F.struct(*one_row.columns).alias("__row")).scalar()
    out = df
    for c in one_row.columns:
        out = out.withColumn(c, packed.getField(c))
    return out


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the session's ``spark.checkpoint.dir`` (a shared folder on a
    cluster) and reads it back.

    Cuts lineage: a result used twice is computed once, and a lost executor does not force a
    recompute from the source. One pass (a reliable ``checkpoint()`` would compute the plan
    twice unless cached), and the copy is columnar, so later reads prune columns.
    """
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/filelens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


_WRITTEN: list[str] = []


def _path(spark, path: str):
    """Hadoop path and its file system (any scheme)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def publish_text(spark, path: str, text: str) -> None:
    """Writes a small file beside ``path`` and renames it there: readers see the old text or the new one."""
    jvm = spark.sparkContext._jvm
    p, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, p, options)


def read_text(spark, path: str) -> str:
    """A small file's text (the readers of ``spark.read`` leave out names that begin with an underscore)."""
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete_path(spark, path: str) -> bool:
    """Deletes a folder this library wrote (through Hadoop's file system API, any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def release_materialized(spark) -> int:
    """Deletes the copies ``materialize`` wrote in this process (call when their results are no
    longer needed). Returns how many folders were removed."""
    removed = 0
    while _WRITTEN:
        removed += delete_path(spark, _WRITTEN.pop())
    return removed
