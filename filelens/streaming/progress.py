"""Run metrics while a job runs (the reference's scan and hash progress).

The reference has no stream processing; what it reports live is progress. ``Progress`` holds accumulators that tasks of a scan or of
digests add to; the driver reads them at any time, from any thread, while the job runs (a task's counts arrive when it ends). A task that
is run again after a loss counts again, as accumulators do; ``observe_scan`` and ``observe_hashing`` give exact counts of one finished job as a
side output (``pyspark.sql.Observation``).
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Progress:
    """Live counters: ``scan(..., progress=p)`` and ``file_digests(..., progress=p)`` add to them, ``p.snapshot()`` reads them."""

    NAMES = ("files_found", "directories_found", "bytes_found", "rejects", "files_hashed", "bytes_hashed", "files_failed")

    def __init__(self, spark: SparkSession):
        self._counts = {n: spark.sparkContext.accumulator(0) for n in self.NAMES}

    def add(self, **counts: int) -> None:
        """Called within tasks."""
        for name, n in counts.items():
            self._counts[name].add(int(n))

    def add_entries(self, batch: pa.RecordBatch) -> None:
        """Counts a batch of listed entries (rows without a path are none)."""
        table = pa.Table.from_batches([batch])
        table = table.filter(pc.is_valid(table["full_path"]))
        ok, is_dir = table["accessible"], table["is_dir"]
        files = table.filter(pc.and_(ok, pc.invert(is_dir)))
        self.add(files_found=len(files), directories_found=pc.sum(pc.and_(ok, is_dir)).as_py() or 0,
                 bytes_found=pc.sum(files["size"]).as_py() or 0, rejects=len(table) - (pc.sum(ok).as_py() or 0))

    def snapshot(self) -> dict[str, int]:
        """The counts of all tasks that have ended so far."""
        return {n: a.value for n, a in self._counts.items()}


def observe_scan(entries: DataFrame, name: str = "scan_progress") -> tuple[DataFrame, Observation]:
    """Counts files, directories and bytes of a listing as it is consumed."""
    obs = Observation(name)
    out = entries.observe(obs,
                          F.count_if(~F.col("is_dir")).alias("files_found"),
                          F.count_if(F.col("is_dir")).alias("directories_found"),
                          F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size"))), F.lit(0)).alias("bytes_found"))
    return out, obs


def observe_hashing(digests: DataFrame, name: str = "hash_progress") -> tuple[DataFrame, Observation]:
    """Counts digests computed and files that could not be read."""
    obs = Observation(name)
    out = digests.observe(obs,
                          F.count(F.lit(1)).alias("files_processed"),
                          F.count_if(F.col("hash") == "").alias("files_failed"))
    return out, obs
