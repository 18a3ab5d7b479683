"""Helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators import common as store

#: Bytes of ASCII white space, the complement of ``[^\x20\x09-\x0D]``.
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text that numpy code handles at a time (keeps its arrays in cache, and memory bounded).
CHUNK_BYTES = 2 << 20

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def written() -> str:
    """Folder of the last copy that ``materialize`` wrote."""
    return store._WRITTEN[-1]


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Deletes copies that nothing reads any more."""
    for folder in folders:
        store._WRITTEN.remove(folder)
        store.delete_path(spark, folder)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (wraps on purpose)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def chunks(raws: list[bytes], limit: int = CHUNK_BYTES):
    """Index ranges of consecutive texts of about ``limit`` bytes together (a longer text is alone)."""
    start, total = 0, 0
    for i, x in enumerate(raws):
        if total and total + len(x) > limit:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(raws):
        yield start, len(raws)


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased), and each text's first word (one more at the end)."""
    data = _LOWER[np.frombuffer(b"\n".join(raws), dtype=np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in raws])
    inside = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    bounds = np.searchsorted(first, np.concatenate(([0], ends)))
    if not len(first):
        return np.zeros(0, dtype=np.uint64), bounds
    length = last - first
    place = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(place, length)
    power = np.full(int(length.max()), 0xD6E8FEB86659FD93, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    value = _BYTE_VALUE[data[inside]] * power[at]
    return mix64(np.add.reduceat(value, place) ^ length.astype(np.uint64)), bounds


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def schema_of(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL text with the few types the operators use."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
             "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
             "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])
