"""Skew-safe positions and running counts inside groups.

``row_number() over (partition by key order by x)`` sends a whole group to one
task. When one key may hold a third of all rows that task becomes the job. Here
the rows are range-partitioned on (key, x) — a hot key is cut into many
partitions — and a row's position is its position in its piece (a key's rows in one
partition) plus the number of rows of the same key in earlier partitions. Only a
partition's first key can have begun in an earlier one, so the offsets are at most one
row per partition, whatever the number of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_ID_BITS = 33  # monotonically_increasing_id puts the partition index above bit 33


def sorted_pieces(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by (keys, order)."""
    # without an explicit count AQE may merge small neighbouring ranges (order is kept)
    ranged = (df.repartitionByRange(partitions, *keys, *order) if partitions
              else df.repartitionByRange(*keys, *order))
    return ranged.sortWithinPartitions(*keys, *order)


def stored_pieces(df: DataFrame) -> DataFrame:
    """Written with the row's place ``_mid`` and its partition ``_pid`` (in the order of partitions and rows).

    In the checkpoint folder: the numbers must not change between two uses or when a lost executor's partition is recomputed.
    """
    out = materialize(df.withColumn("_mid", F.monotonically_increasing_id()))
    return out.withColumn("_pid", F.shiftright("_mid", _ID_BITS))


def continued_pieces(pieces: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """(keys, _pid, _n): the pieces of the keys that may lie in several partitions. At most twice as many as partitions."""
    if not keys:  # one group: every piece
        return pieces.groupBy("_pid").agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_n"))
    firsts = pieces.groupBy("_pid").agg(F.min_by(F.struct(*keys), "_mid").alias("_k")).select("_k.*").distinct()
    # one row per partition at most: small enough for a broadcast by its number
    return (pieces.join(F.broadcast(firsts), keys, "left_semi")
            .groupBy(*keys, "_pid").agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_n")))


def _with_offsets(pieces: DataFrame, df: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """``df`` (a projection of the pieces) with ``_offset``: the weight of the key's earlier pieces."""
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (continued_pieces(pieces, keys, weight).withColumn("_offset", F.sum("_n").over(before))
               .where(F.col("_offset") != 0).drop("_n"))
    return df.join(F.broadcast(offsets), [*keys, "_pid"], "left").withColumn("_offset", F.coalesce("_offset", F.lit(0)))


def _piece(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, "_pid").orderBy("_mid")


def ranked_pieces(pieces: DataFrame, keys: list[str], out: str = "rank0") -> DataFrame:
    """The rows of stored pieces with ``out``: 0-based position within ``keys`` (not null)."""
    ranked = pieces.withColumn("_place", F.row_number().over(_piece(keys)) - 1)
    return (_with_offsets(pieces, ranked, keys, F.lit(1))
            .withColumn(out, (F.col("_offset") + F.col("_place")).cast("long"))
            .drop("_offset", "_place", "_mid", "_pid"))


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str = "rank0",
                partitions: int | None = None) -> DataFrame:
    """Adds ``out``: 0-based position of each row within ``keys`` (not null) ordered by ``order``."""
    return ranked_pieces(stored_pieces(sorted_pieces(df, keys, order, partitions)), keys, out).select(*df.columns, out)


def counted_before(rows: DataFrame, probes: DataFrame, keys: list[str], order: list[str], out: str,
                   ties: bool = False, partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Adds ``out`` to ``probes``: the number of ``rows`` with the same ``keys`` that come before it by ``order`` (with
    ``ties`` also those at its place), or the sum of their ``weight``. Either side may have hot keys; without keys all rows are one group."""
    marked = rows.select(*keys, *order, F.lit(0 if ties else 2).alias("_turn"), (F.col(weight) if weight else F.lit(1)).alias("_weight"))
    both = probes.withColumn("_turn", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    counts = F.when(F.col("_turn") != 1, F.col("_weight")).otherwise(F.lit(0))
    # rows at one place are never cut apart: the range is by (keys, order)
    ranged = sorted_pieces(both, keys, order, partitions).sortWithinPartitions(*keys, *order, "_turn")
    pieces = stored_pieces(ranged)
    running = pieces.withColumn("_before", F.sum(counts).over(_piece(keys).rowsBetween(Window.unboundedPreceding, 0)))
    return (_with_offsets(pieces, running.where(F.col("_turn") == 1), keys, counts)
            .withColumn(out, (F.col("_offset") + F.col("_before")).cast("long"))
            .select(*probes.columns, out))
