"""A bounded membership filter that runs inside a scan stage.

Keys set one bit of a bit array by their hash; a row whose bit is not set holds none of the keys. The array is a scalar subquery (an array of
64-bit words, at most ``MAX_BITS``), so a row is tested by one look-up in generated code, before anything costly is computed from it and without a
join. Rows that pass by chance must do no harm to the caller's result; more keys than the array is made for let more such rows pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 14, 1 << 27  # 2 KiB to 16 MiB
BITS_PER_KEY = 16


def bits_for(n_keys: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (n_keys * BITS_PER_KEY - 1).bit_length() if n_keys else 0))


def _bit(columns: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def membership(keys: DataFrame, columns: list[str], bits: int) -> Column:
    """The bit array of the rows of ``keys`` as one value."""
    spark = keys.sparkSession
    spot = _bit(columns, bits)
    set_words = keys.select(spot.alias("spot")).selectExpr("spot div 64 as id", "shiftleft(1L, cast(spot % 64 as int)) as w")
    words = set_words.groupBy("id").agg(F.bit_or("w").alias("w"))
    every = spark.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("long")).alias("w"))
    packed = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "w"))), lambda x: x["w"]).alias("words"))
    return packed.scalar()


def may_hold(words: Column, columns: list[str], bits: int) -> Column:
    """False only for rows that hold none of the keys."""
    spot = _bit(columns, bits)
    return F.call_function("getbit", F.get(words, F.floor(spot / F.lit(64)).cast("int")), (spot % F.lit(64)).cast("int")) == 1
